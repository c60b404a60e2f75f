"""The registered queries of this subpackage: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunkdedup, crf, decontaminate, fingerprint, langid, licensescan, linededup, merkle, packing, pii, spelling, superminhash, wrapper
from .common import table


def op1_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.articles(table(spark, sf_dir, "pages"))


def op2_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_study(table(spark, sf_dir, "documents"))


def op3_superminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_groups(table(spark, sf_dir, "documents"), words=2, threshold=0.8)


def op4_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_compression_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = F.coalesce(langid.held_out(), F.lit(False))
    told = langid.teller(spark, langid.train(docs.where(~out)))
    return docs.select("doc_id", out.alias("held_out"), told("text").alias("t")).select("doc_id", "held_out", "t.lang_pred", "t.score")


def op6_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkdedup.repeated_spans(table(spark, sf_dir, "documents"))


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.changed(table(spark, sf_dir, "documents"), key=b"key of the registered query").drop("source_hash")


def op8_minhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_template_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup(docs, counts=True)


def op10_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = F.coalesce(crf.held_out(), F.lit(False))
    model = crf.train(docs.where(~out), table(spark, sf_dir, "labels").where(~out))
    return crf.score(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.study(table(spark, sf_dir, "documents"))


def op12_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licensescan.scan(table(spark, sf_dir, "documents")).drop("spans")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.counted(table(spark, sf_dir, "documents"), every=199))


QUERIES = {
    f.__name__: f
    for f in (
        op1_wrapper_extraction,
        op2_minhash_fingerprints,
        op3_superminhash_dedup,
        op4_cutting_stock_packing,
        op5_compression_langid,
        op6_chunk_dedup,
        op7_pii_surrogates,
        op8_minhash_decontamination,
        op9_template_line_dedup,
        op10_crf_toxicity,
        op11_merkle_manifest,
        op12_license_templates,
        op13_spelling_variants,
    )
}

#: The words of a text as decontaminate.words has them, and the distinct runs of five.
_RUNS = """
SELECT {key}, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                 WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS runs
FROM (SELECT {key}, list_filter(string_split_regex(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM {table} WHERE {key} IS NOT NULL AND text IS NOT NULL)
"""

_OP8 = f"""
WITH i AS ({_RUNS.format(key="item_id", table="benchmark")}), d AS ({_RUNS.format(key="doc_id", table="documents")}),
iu AS (SELECT item_id, len(runs) AS n, unnest(runs) AS r FROM i), du AS (SELECT doc_id, unnest(runs) AS r FROM d)
SELECT item_id, doc_id, CAST(n AS BIGINT) AS n_shingles, count(DISTINCT r) AS n_shared, count(DISTINCT r) / n AS containment
FROM iu JOIN du USING (r) GROUP BY item_id, doc_id, n HAVING 100 * count(DISTINCT r) >= 80 * n
"""

#: Templates of a line: its tokens with digit fields generalised, whole and without each block.
_OP9 = """
WITH doc AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
line AS (SELECT doc_id, text, string_split(text, chr(10)) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM doc),
tok AS (SELECT doc_id, text, place, list_transform(list_filter(string_split_regex(l[place], '[ \\t\\r]+'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t FROM line),
num AS (SELECT *, len(t) AS n, CAST(ceil((len(t) - 3) / 4.0) AS BIGINT) AS w FROM tok WHERE len(t) > 0),
key AS (
  SELECT doc_id, text, place, n, -1 AS j, t AS head, [] AS tail FROM num
  UNION ALL
  SELECT doc_id, text, place, n, j, t[1:3 + j * w], t[4 + (j + 1) * w:] FROM num, (SELECT unnest([0, 1, 2, 3]) AS j) WHERE n - 3 >= 2 AND n - 3 > j * w
),
met AS (SELECT n, j, head, tail, min({'d': doc_id, 'p': place}) AS first FROM key GROUP BY ALL HAVING count(DISTINCT {'d': doc_id, 't': text}) >= 5),
gone AS (SELECT DISTINCT k.doc_id, k.text, k.place FROM key k JOIN met m USING (n, j, head, tail) WHERE k.doc_id <> m.first.d OR k.place <> m.first.p),
per AS (SELECT doc_id, text, list(place) AS places, count(*) AS c FROM gone GROUP BY ALL),
kept AS (SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS l, places, coalesce(c, 0) AS c FROM documents d LEFT JOIN per USING (doc_id, text)),
out AS (SELECT *, list_filter(l, lambda x, i: NOT list_contains(places, i)) AS rest FROM kept)
SELECT doc_id, CASE WHEN places IS NULL THEN text WHEN len(list_filter(rest, lambda x: length(trim(x)) > 0)) > 0 THEN array_to_string(rest, chr(10)) ELSE '' END AS text,
       CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(c AS BIGINT) AS n_dropped FROM out
"""

#: CRC-32 of a text without its last inversion: bytes through a table of 256 that a rule makes.
_CRC_TABLE = "crc AS (SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS tb FROM range(0, 256) r(b))"


def _crc(text: str) -> str:
    """Unsigned CRC-32 (of the polynomial that zlib has) of a text; needs the table crc beside it."""
    data = f"list_transform(range(0, strlen({text})), lambda i: CAST('0x' || hex(encode({text}))[2 * i + 1:2 * i + 2] AS BIGINT))"
    return f"xor(list_reduce({data}, lambda c, b: CAST(xor(c >> 8, tb[(xor(c, b) & 255) + 1]) AS BIGINT), CAST(4294967295 AS BIGINT)), 4294967295)"


def _merkle(levels: int = 6, above: int = 2) -> str:
    """The manifest with the levels written out: parts of up to 8 ** levels rows, 8 ** above parts."""

    def field(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"

    def nodes(name: str, k: int) -> str:
        run = "PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN"
        return f"""{name}m{k} AS (SELECT g, i, c, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pre, coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS post FROM {name}{k}),
        {name}{k + 1} AS (SELECT g, i // 8 AS i, CASE WHEN any_value(c) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h, (any_value(c) + 7) // 8 AS c FROM {name}{k} GROUP BY g, i // 8)"""

    own = " || ".join(field(c) for c in merkle.FIELDS)
    other = " || ".join(field(f"translate(text, '{merkle.UPPER}', '{merkle.LOWER}')" if c == "text" else c) for c in merkle.FIELDS)
    parts = [f"{_CRC_TABLE}, x AS (SELECT doc_id, coalesce('=' || lang, '-') AS g, sha256({own}) AS leaf, CASE WHEN doc_id IS NOT NULL AND {_crc('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN sha256({other}) END AS other FROM documents, crc)"]
    parts.append("y AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS c FROM x), n0 AS (SELECT g, i, leaf AS h, c FROM y)")
    parts += [nodes("n", k) for k in range(levels)]
    parts.append(f"s AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS place FROM n{levels}), r0 AS (SELECT '' AS g, place AS i, subroot AS h, count(*) OVER () AS c FROM s)")
    parts += [nodes("r", k) for k in range(above)]
    folded, joins, siblings = "coalesce(y.other, y.leaf)", "JOIN s USING (g)", []
    for name, n, at, tree in (("n", levels, "y.i", "y.g"), ("r", above, "s.place", "''")):
        for k in range(n):
            m = f"{name}m{k}"
            joins += f" JOIN {m} ON {m}.g = {tree} AND {m}.i = {at} // {8**k}"
            siblings.append(f"{m}.pre || {m}.post")
    steps = [f"f0 AS (SELECT y.doc_id, y.leaf, s.subroot, {' || '.join(siblings)} AS siblings, {folded} AS f, " + ", ".join(f"{name}m{k}.c AS {name}c{k}, {name}m{k}.pre AS {name}a{k}, {name}m{k}.post AS {name}b{k}" for name, n in (("n", levels), ("r", above)) for k in range(n)) + f" FROM y {joins})"]
    order = [f"{name}{{}}{k}" for name, n in (("n", levels), ("r", above)) for k in range(n)]
    for j, c in enumerate(order):
        steps.append(f"f{j + 1} AS (SELECT * REPLACE (CASE WHEN {c.format('c')} > 1 THEN sha256({c.format('a')} || f || {c.format('b')}) ELSE f END AS f) FROM f{j})")
    return f"WITH {', '.join(parts + steps)} SELECT doc_id, leaf, subroot, r{above}.h AS root, sha256(siblings) AS proof_sha256, f AS folded_root, f = r{above}.h AS verified FROM f{len(order)}, r{above}"


#: Words at one deleted code point: w is v without one, v is w without one, or both without the same place are alike.
_OP13 = f"""
WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT doc_id, translate(x, '{merkle.UPPER}', '{merkle.LOWER}') AS w, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS x FROM documents) GROUP BY ALL),
h AS (SELECT w, c, {_crc("(doc_id || ':' || w)")} AS h FROM r, crc),
v AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN w[:CAST(h % length(w) AS INT)] || w[CAST(h % length(w) AS INT) + 2:] ELSE w END AS word, c FROM h) WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v), d AS MATERIALIZED (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM p),
e AS (SELECT a.word, b.word AS other, b.n AS m FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word AND length(a.word) = length(b.word)
      UNION SELECT a.word, b.word, b.n FROM d a JOIN v b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM d a JOIN v b ON a.rest = b.word),
b AS (SELECT word, count(*) AS n_near, max(m) AS m, first(other ORDER BY m DESC, other) AS best FROM e GROUP BY word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * v.n THEN best END AS form, CASE WHEN m >= 5 * v.n THEN m END AS form_n FROM v LEFT JOIN b USING (word)),
t AS (SELECT word, word AS tip, 0 AS k FROM f UNION ALL SELECT t.word, f.form, k + 1 FROM t JOIN f ON f.word = t.tip WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(tip, k) AS root FROM t GROUP BY word) USING (word)
"""

ORACLE_SQL = {"op13_spelling_variants": _OP13, "op11_merkle_manifest": _merkle(), "op8_minhash_decontamination": _OP8, "op9_template_line_dedup": _OP9}

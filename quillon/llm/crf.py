"""Toxicity by a linear-chain conditional random field over tokens.

Tokens are words without ASCII punctuation, A-Z lower-cased; a sequence ends at a line break
or after a token followed by . ! or ?. Labels of documents become token labels first: in
toxic training documents those tokens are labelled whose word or stem occurs mostly in toxic
documents. The field has two tags; hashed features of the token and its neighbours score
them, a 2 x 2 table scores transitions, training maximises the conditional likelihood with
AdaGrad. Forward-backward marginals give each token the probability of the toxic tag; they
are summed up to a document score by a logistic curve, fitted by cross-fitting: each fold of
the sample is scored by a field of the other folds. Runs of toxic tokens are the offending
offsets.

Training reads a bounded sample of labelled rows (`sample` rows and `sample_bytes` bytes of
each class, in the order of a hash of doc_id; ties in it go by doc_id and text); scoring reads
every text whole, however long. Null and empty texts get the score of a text without any toxic
token. Repeated rows get equal scores; extra columns are ignored. With no labelled row of one
of the classes every score is the share of toxic rows (0 without labels).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_batches, forest
from .fingerprint import signatures
from .hashing import PUNCTUATION, SPACE, U, Words, chunks, mix

BITS = 18
SIZE = 1 << BITS
#: Bounds of the training sample: rows and UTF-8 bytes of each class.
SAMPLE, SAMPLE_BYTES = 1000, 32 << 20
#: Updates of the field, whatever the sample's size; folds that the curve is fitted on.
UPDATES, FOLDS = 80, 3
#: Evidence: the least share of toxic documents among those with a word, at equal class sizes; words that may count by chance.
SHARE, CHANCE = 0.75, 0.5
#: Token features: whole word, first 4 and 5 bytes, last 4 bytes, previous word, next word.
KINDS = 6
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b"\n\r.!?")] = True


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(SIZE, dtype=np.float32))
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    bias: float = -6.0
    curve: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    prior: float | None = 0.0


class Tokens:
    """Token hashes, features and sequences of a batch of texts."""

    def __init__(self, texts: list[bytes]):
        w = Words(texts, SPACE + PUNCTUATION)
        self.words, n = w, len(w.start)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(w.offsets))
        self.whole = w.hashes()
        size = w.end - w.start
        self.stem = w.span(w.start, w.start + np.minimum(size, 5))
        # a token closes its sequence if a stop byte stands before the next token
        stops = np.concatenate(([0], np.cumsum(_STOP[w.buffer])))
        nxt = np.concatenate((w.start[1:], [len(w.buffer)])) if n else w.start
        close = (stops[nxt] - stops[w.end]) > 0
        if n:
            close[-1] = True
            close[:-1] |= self.doc[1:] != self.doc[:-1]
        self.last = np.flatnonzero(close)
        self.first = np.concatenate(([0], self.last[:-1] + 1)) if len(self.last) else self.last
        before, behind = np.array([7], dtype=U), np.array([8], dtype=U)  # a text's scores must not depend on its batch
        same = ~close[:-1] if n else np.zeros(0, dtype=bool)
        prev = np.concatenate((before, np.where(same, self.whole[:-1], before))) if n else self.whole
        after = np.concatenate((np.where(same, self.whole[1:], behind), behind)) if n else self.whole
        short, tail = w.span(w.start, w.start + np.minimum(size, 4)), w.span(w.end - np.minimum(size, 4), w.end)
        parts = (self.whole, short, self.stem, tail, prev, after)
        self.features = np.stack([(mix(x + U(i * 1_000_003)) >> U(64 - BITS)).astype(np.int32) for i, x in enumerate(parts)], axis=1) if n else np.zeros((0, KINDS), dtype=np.int32)


def marginals(emit: np.ndarray, first: np.ndarray, last: np.ndarray, trans: np.ndarray, expect: bool = False):
    """P(toxic tag) of each token, by forward-backward over all sequences at once (step by step, longest first).

    emit: score of the toxic tag over the other. With expect, also the expected transition
    counts and the log partition sums.
    """
    n = len(emit)
    p = np.zeros(n)
    pair = np.zeros((2, 2))
    logz = 0.0
    if not n:
        return (p, pair, logz) if expect else p
    order = np.argsort(first - last, kind="stable")
    first, size = first[order], (last - first + 1)[order]
    m = np.exp(trans)
    e = np.exp(np.clip(emit, -30, 30))
    alpha, beta, scale = np.empty((n, 2)), np.empty((n, 2)), np.empty(n)
    longest = int(size[0])
    active = np.searchsorted(-size, -np.arange(longest), side="left")  # sequences longer than t
    a = np.stack([np.ones(len(first)), e[first]], axis=1)
    for t in range(longest):
        k = active[t]
        at = first[:k] + t
        if t:
            a = a[:k] @ m
            a[:, 1] *= e[at]
        z = a.sum(axis=1)
        a = a / z[:, None]
        alpha[at], scale[at] = a, z
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at = first[:k] + t
        b = np.ones((k, 2))
        more = active[t + 1] if t + 1 < longest else 0
        if more:
            nx = at[:more] + 1
            x = beta[nx].copy()
            x[:, 1] *= e[nx]
            b[:more] = (x @ m.T) / scale[nx][:, None]
            if expect:
                pair += (alpha[at[:more]].T @ (x / scale[nx][:, None])) * m
        beta[at] = b
    p = alpha[:, 1] * beta[:, 1]
    return (p, pair, float(np.log(scale).sum())) if expect else p


def _emit(model: Model, tok: Tokens) -> np.ndarray:
    return model.weights[tok.features].sum(axis=1, dtype=np.float64) + model.bias


def summary(p: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Per document: the largest and the second largest marginal, and the log of one plus the sum of clear marginals."""
    top = np.zeros((docs, 2))
    order = np.lexsort((-p, doc))
    nth = np.arange(len(p)) - np.searchsorted(doc[order], doc[order])
    for k in (0, 1):
        at = order[nth == k]
        top[doc[at], k] = p[at]
    return np.column_stack([top, np.log1p(np.bincount(doc, weights=np.where(p >= 0.5, p, 0.0), minlength=docs)[:docs])])


def families(texts: list[bytes], rows: int = 3) -> np.ndarray:
    """The first text of each text's family: texts that agree in a band of MinHash minima, as near copies do, are one family."""
    sig, n = signatures(texts)
    root = np.arange(len(texts))
    left, right = [], []
    some = np.flatnonzero(n)
    for i in range(0, sig.shape[1] - rows + 1, rows):
        _, first, at = np.unique(sig[some, i : i + rows], axis=0, return_index=True, return_inverse=True)
        left.append(some)
        right.append(some[first[at.ravel()]])
    for x, r in forest(np.concatenate(left).tolist(), np.concatenate(right).tolist()):
        root[x] = r
    return root


def label_tokens(tok: Tokens, toxic: np.ndarray, docs: np.ndarray | None = None, chance: float = CHANCE) -> np.ndarray:
    """Tokens whose word, or 4-byte beginning, is evidence of toxicity in the documents marked in docs.

    A word counts if SHARE of the documents that hold it are toxic at equal class sizes, and if the
    Chernoff bound of so many toxic ones among its documents lets at most `chance` of all
    words pass by chance. The bound follows the sample's size: few documents need a purer word.
    """
    out = np.zeros(len(tok.whole), dtype=bool)
    docs = np.ones(len(toxic), dtype=bool) if docs is None else docs
    n1, n0 = max(1, int((toxic & docs).sum())), max(1, int((~toxic & docs).sum()))
    base = n1 / (n1 + n0)
    for h in (tok.whole, tok.features[:, 1].astype(U)):
        once = np.unique(mix(h + mix(tok.doc.astype(U))), return_index=True)[1]  # each word once a document
        once = once[docs[tok.doc[once]]]
        word, at, counts = np.unique(h[once], return_inverse=True, return_counts=True)
        bad = np.bincount(at, weights=toxic[tok.doc[once]], minlength=len(word))
        share = ((bad + 0.1) / n1) / ((bad + 0.1) / n1 + (counts - bad + 0.5) / n0)
        rate = np.maximum(bad / counts, base)
        with np.errstate(divide="ignore", invalid="ignore"):
            surprise = counts * (rate * np.log(rate / base) + np.where(rate < 1, (1 - rate) * np.log((1 - rate) / (1 - base)), 0.0))
        listed = word[(bad >= 2) & (share >= SHARE) & (surprise >= np.log(max(2.0, (counts > 1).sum() / chance)))]
        out |= np.isin(h, listed)
    return out


def _field(tok: Tokens, y: np.ndarray, docs: np.ndarray, evidence: np.ndarray, updates: int, batch: int, seed: int) -> Model:
    """The field fitted on the documents marked in docs.

    Read are all sequences with a listed token, whose tags are toxic in toxic documents and clean
    in clean ones, and a share of the other sequences of clean documents.
    """
    model = Model(prior=None)
    rng = np.random.RandomState(seed)
    listed = label_tokens(tok, y, evidence)
    gold = listed & y[tok.doc]
    runs = np.add.reduceat(listed.astype(np.int64), tok.first) if len(tok.first) else np.zeros(0)
    own = docs[tok.doc[tok.first]] if len(tok.first) else np.zeros(0, dtype=bool)
    seen = np.flatnonzero((runs > 0) & own)
    other = np.flatnonzero((runs == 0) & own & ~y[tok.doc[tok.first]]) if len(tok.first) else seen
    pick = np.concatenate([seen, rng.permutation(other)[: max(3000, 3 * len(seen))]])
    if not len(pick):
        return model
    g2, gt = np.full(SIZE, 1e-2), np.full((2, 2), 1e-2)
    gb = 1e-2
    done = 0
    while done < updates:
        pick = rng.permutation(pick)
        for i in range(0, len(pick), batch):
            done += 1
            q = np.sort(pick[i : i + batch])
            size = tok.last[q] - tok.first[q] + 1
            off = np.concatenate(([0], np.cumsum(size)))
            at = np.repeat(tok.first[q] - off[:-1], size) + np.arange(off[-1])
            f, want = tok.features[at], gold[at]
            emit = model.weights[f].sum(axis=1, dtype=np.float64) + model.bias
            p, pair, _ = marginals(emit, off[:-1], off[1:] - 1, model.trans, expect=True)
            d = (want - p) / len(q)
            grad = np.bincount(f.ravel(), weights=np.repeat(d, KINDS), minlength=SIZE) - 1e-6 * model.weights
            used = np.flatnonzero(grad)
            g2[used] += grad[used] ** 2
            model.weights[used] += (0.5 * grad[used] / np.sqrt(g2[used])).astype(np.float32)
            inner = np.ones(off[-1], dtype=bool)
            inner[off[1:] - 1] = False
            w = want.astype(np.int64)
            seen_pair = np.bincount((w[:-1] * 2 + w[1:])[inner[:-1]], minlength=4).reshape(2, 2)
            dt = (seen_pair - pair) / len(q)
            gt += dt**2
            model.trans += 0.2 * dt / np.sqrt(gt)
            gb += d.sum() ** 2
            model.bias += 0.2 * d.sum() / np.sqrt(gb)
    return model


def fit(texts: list[str | None], toxic: list[bool], updates: int = UPDATES, batch: int = 400, seed: int = 7, folds: int = FOLDS) -> Model:
    """The field of all rows; its curve is fitted on scores that each fold's rows get from a field of the other folds.

    Near copies share a fold, and only the first of them counts as evidence for its words.
    """
    y = np.array(toxic, dtype=bool)
    if not len(y) or y.all() or not y.any():
        return Model(prior=float(y.mean()) if len(y) else 0.0)
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    tok, family = Tokens(raw), families(raw)
    first = family == np.arange(len(y))
    fold = np.zeros(len(y), dtype=np.int64)
    for c in (False, True):
        at = np.flatnonzero(first & (y == c))
        fold[at] = np.random.RandomState(seed).permutation(len(at)) % folds
    fold = fold[family]
    x = np.zeros((len(y), 3))
    for k in range(folds):
        mine = fold != k
        part = _field(tok, y, mine, mine & first, updates, batch, seed)
        x[~mine] = summary(marginals(_emit(part, tok), tok.first, tok.last, part.trans), tok.doc, len(texts))[~mine]
    model = _field(tok, y, np.ones(len(y), dtype=bool), first, updates, batch, seed)
    model.curve = _logistic(x, y)
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    a = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(a.shape[1]), np.array([0.005, *[0.5] * x.shape[1]])
    weight = np.where(y, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        w += np.linalg.solve(h, a.T @ (weight * (y - p)) - ridge * w)
    return tuple(float(v) for v in w)


def document_scores(model: Model, x: np.ndarray) -> np.ndarray:
    c = model.curve
    return 1 / (1 + np.exp(-np.clip(c[0] + x @ np.array(c[1:]), -30, 30)))


def train(labelled: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on a bounded sample of each class of labels(doc_id, toxic), in the order of a hash of doc_id; labelled(doc_id, text).

    The bounds hold after the join, so repeated doc_ids do not widen the sample: it ends with
    the row of the class that reaches `sample_bytes`, or after `sample` rows.
    """
    h = F.xxhash64("doc_id", F.lit(5))
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id is not null and toxic in (0, 1)")
    picked = known.where("toxic = 1").orderBy(h).limit(sample).unionByName(known.where("toxic = 0").orderBy(h).limit(sample))
    rows = labelled.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")  # 2 * sample rows at most
    order = Window.partitionBy("toxic").orderBy(h, "doc_id", F.xxhash64("text"))
    rows = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= sample)
    before = F.coalesce(F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before).where(F.col("before") < sample_bytes).select("text", "toxic").collect()
    rows.sort(key=lambda r: (r["toxic"], r["text"]))
    return fit([r["text"] for r in rows], [r["toxic"] == 1 for r in rows])


def _run(model: Model, b: list[bytes]):
    tok = Tokens(b)
    return tok, marginals(_emit(model, tok), tok.first, tok.last, model.trans)


def _spans(tok: Tokens, p: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, end (bytes in the text) and largest marginal of each run of tokens that reach the floor."""
    hit = np.flatnonzero(p >= floor)
    if not len(hit):
        return (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0),)
    new = np.concatenate(([True], (np.diff(hit) > 1) | (np.diff(tok.doc[hit]) > 0)))
    a = hit[new]
    z = hit[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(hit) - 1]))]
    base = tok.words.text_start[tok.doc[a]]
    return tok.doc[a], tok.words.start[a] - base, tok.words.end[z] - base, np.maximum.reduceat(p[hit], np.flatnonzero(new))


def score(docs: DataFrame, model: Model, floor: float = 0.2) -> DataFrame:
    """doc_id, score and spans (start and end byte in the UTF-8 text, p: the runs of tokens whose marginal reaches the floor) for each row."""
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the weights of 2 ** BITS features

    def run(batches):
        m = shared.value
        for pdf in batches:
            for first, b in chunks(pdf["text"], 1 << 19):
                found: list[list[dict]] = [[] for _ in b]
                if m.prior is not None:
                    s = np.full(len(b), m.prior)
                else:
                    tok, p = _run(m, b)
                    s = document_scores(m, summary(p, tok.doc, len(b)))
                    for d, *span in zip(*(x.tolist() for x in _spans(tok, p, floor)), strict=True):
                        found[d].append(dict(zip(("start", "end", "p"), span, strict=True)))
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[first : first + len(b)].to_numpy(), "score": s, "spans": pd.Series(found, dtype=object)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, score double, spans array<struct<start: long, end: long, p: double>>")


def spans(docs: DataFrame, model: Model, floor: float = 0.5) -> DataFrame:
    """doc_id, start, end (byte offsets into the UTF-8 text), p: one row for each run of toxic tokens."""
    return score(docs, model, floor).select("doc_id", F.inline("spans"))


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1

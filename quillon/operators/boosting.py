"""Gradient-boosted trees for many classes: one tree a class and round, grown by histograms.

Features are cut into quantile bins once. Pairs are kept in blocks of rows (bins, labels and scores of
all classes); a round writes the gradients of a sample of the rows, dealt by block and group of
classes. A tree level of all classes is one aggregate: every cell adds up its gradients and Hessians
by node, feature and bin, the sums of a class meet in one task, which picks the best cut of each node.
Only cuts come to the driver: as many as the trees have nodes. The scores of a round are written to
the shared folder, so a lost executor costs its blocks of that round.

Rules: softmax gradients p - y, Hessians K / (K - 1) p (1 - p); leaf weights by soft threshold L1 and
penalty L2; scores start at the logarithms of the class shares; the round of the least validation
loss counts, and training stops when it has not fallen for `patience` rounds.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import Scratch

#: Rows of a block: with 100 classes its scores take 26 MB.
BLOCK = 1 << 16
SPLITS = ("train", "valid", "test")


@dataclass(frozen=True)
class Settings:
    rounds: int = 300
    depth: int = 5
    bins: int = 32
    rate: float = 0.1
    l1: float = 0.1
    l2: float = 0.1
    features: float = 0.8
    rows: float = 0.8
    least_rows: int = 20
    least_hessian: float = 1e-3
    patience: int = 10
    seed: int = 28


@dataclass
class Round:
    """The trees of a round by class, in heap order: the children of node i are 2 i + 1 and 2 i + 2."""

    feature: np.ndarray  # classes x inner nodes, -1 where a node is not cut
    cut: np.ndarray  # the last bin that goes left
    value: np.ndarray  # classes x all nodes

    @classmethod
    def empty(cls, classes: int, depth: int) -> Round:
        inner = (1 << depth) - 1
        return cls(np.full((classes, inner), -1, dtype=np.int32), np.zeros((classes, inner), dtype=np.int32), np.zeros((classes, 2 * inner + 1)))


@dataclass
class Model:
    edges: np.ndarray  # features x (bins - 1), ascending
    start: np.ndarray  # scores before the first round
    rounds: list[Round] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)  # validation loss after each round

    @property
    def best(self) -> int:
        """Rounds that count."""
        return int(np.argmin(self.losses)) + 1 if self.losses else len(self.rounds)


def quantile_edges(pairs: DataFrame, bins: int) -> np.ndarray:
    """Cut points of every feature of pairs(x, ...) by approximate quantiles: as many numbers as features times bins."""
    width = pairs.select(F.size("x").alias("d")).first()["d"]
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    row = pairs.agg(*[F.percentile_approx(F.col("x")[i], shares, 20 * bins).alias(f"q{i}") for i in range(width)]).first()
    return np.array([row[f"q{i}"] for i in range(width)], dtype=float)


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """features x rows: the bin of each value, which is the number of cut points below it."""
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]).astype(np.uint8)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def route(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The node of one tree that every row of bins reaches after so many levels; rows stay at a node without a cut."""
    node = np.zeros(bins.shape[1], dtype=np.int64)
    rows = np.arange(bins.shape[1])
    for _ in range(levels):
        f = feature[node]
        node = np.where(f >= 0, 2 * node + 1 + (bins[f, rows] > cut[node]), node)
    return node


def threshold(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0)


def weight(g: np.ndarray, h: np.ndarray, s: Settings) -> np.ndarray:
    return -threshold(g, s.l1) / (h + s.l2) * s.rate


def chosen(s: Settings, round_: int, cls: int, features: int) -> np.ndarray:
    """The features that the tree of a class and round may cut, in order."""
    n = max(1, round(s.features * features))
    return np.sort(np.random.default_rng([s.seed, round_, cls]).permutation(features)[:n])


def histogram(bins: np.ndarray, g: np.ndarray, h: np.ndarray, node: np.ndarray, wanted: np.ndarray, features: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each wanted node (ascending, of one level), and the sums of (g, h) by feature, wanted node and bin."""
    nodes = len(wanted)
    if nodes == 1 and wanted[0] == 0:
        local, on = node, slice(None)
    else:
        place = np.full(max(int(node.max(initial=0)), *wanted.tolist(), 0) + 1, -1, dtype=np.int64)
        place[wanted] = np.arange(nodes)
        local = place[node]
        on = np.flatnonzero(local >= 0)
        local, g, h = local[on], g[on], h[on]
    base = local * width
    out = np.empty((len(features), nodes, width, 2))
    for k, f in enumerate(features):
        at = base + bins[f][on]
        out[k, :, :, 0] = np.bincount(at, g, nodes * width).reshape(nodes, width)
        out[k, :, :, 1] = np.bincount(at, h, nodes * width).reshape(nodes, width)
    return np.bincount(local, minlength=nodes), out


def best_cuts(counts: np.ndarray, hist: np.ndarray, features: np.ndarray, s: Settings) -> list[tuple]:
    """(node, feature, cut, g and h of the node, of its left side) of every node of a level; feature is -1 where no cut gains.

    Rows on a side are told from its share of the node's Hessian. Ties go to the first feature and cut.
    """
    whole = hist[0].sum(axis=1)  # nodes x (g, h)
    left = hist.cumsum(axis=2)[:, :, :-1]
    right = whole[None, :, None] - left
    score = lambda x: threshold(x[..., 0], s.l1) ** 2 / (x[..., 1] + s.l2)
    gain = score(left) + score(right) - score(whole)[None, :, None]
    least = np.maximum(s.least_hessian, (s.least_rows - 0.5) * whole[:, 1] / np.maximum(counts, 1))[None, :, None]
    gain = np.where((left[..., 1] >= least) & (right[..., 1] >= least), gain, 0.0)
    out = []
    for j in range(len(counts)):
        # cuts that part the same rows gain the same but for rounding: the first of them
        k, b = np.unravel_index(np.argmax(gain[:, j] >= gain[:, j].max() * (1 - 1e-9)), gain[:, j].shape)
        cut = gain[k, j, b] > 1e-9
        out.append((j, int(features[k]) if cut else -1, int(b), *whole[j], *(left[k, j, b] if cut else (0.0, 0.0))))
    return out


CELLS = "block int, split string, n int, bins binary, labels binary, scores binary, loss double"


def blocks(pairs: DataFrame, edges: np.ndarray, start: np.ndarray, size: int = BLOCK) -> DataFrame:
    """Blocks of rows of pairs(x, label, split): a block holds rows of one split."""
    n = pairs.count()
    classes = len(start)

    def run(batches):
        held = {s: [] for s in SPLITS}
        for p in batches:
            for s, part in p.groupby("split"):
                held[s].append((binned(np.array(part["x"].tolist(), dtype=float), edges), part["label"].to_numpy(dtype=np.int32)))
        for s, parts in held.items():
            if parts:
                b, y = np.concatenate([b for b, _ in parts], axis=1), np.concatenate([y for _, y in parts])
                for k in range(0, len(y), size):
                    m = len(y[k : k + size])
                    scores = np.broadcast_to(start.astype(np.float32), (m, classes))
                    yield pd.DataFrame([(0, s, m, b[:, k : k + size].tobytes(), y[k : k + size].tobytes(), scores.tobytes(), 0.0)], columns=[c.split()[0] for c in CELLS.split(", ")])

    rows = pairs.select("x", "label", "split").where(F.col("split").isin(*SPLITS)).repartition(max(1, -(-n // size)))
    return rows.mapInPandas(run, CELLS).withColumn("block", F.spark_partition_id() * 4 + F.when(F.col("split") == "train", 0).when(F.col("split") == "valid", 1).otherwise(2))


def _arrays(row, features: int, classes: int):
    return np.frombuffer(row.bins, dtype=np.uint8).reshape(features, row.n), np.frombuffer(row.labels, dtype=np.int32), np.frombuffer(row.scores, dtype=np.float32).reshape(row.n, classes)


def moved(cells: DataFrame, trees: Round, features: int, depth: int) -> DataFrame:
    """cells with the scores after a round, and the sum of their log losses."""
    classes = len(trees.value)

    def run(batches):
        for p in batches:
            for row in p.itertuples():
                b, y, z = _arrays(row, features, classes)
                z = z + np.stack([trees.value[c][route(b, trees.feature[c], trees.cut[c], depth)] for c in range(classes)], axis=1).astype(np.float32)
                own = softmax(z.astype(float))[np.arange(row.n), y]
                yield pd.DataFrame([(row.block, row.split, row.n, row.bins, row.labels, z.tobytes(), float(-np.log(np.maximum(own, 1e-15)).sum()))], columns=p.columns)

    return cells.mapInPandas(run, CELLS)


def gradients(cells: DataFrame, s: Settings, round_: int, features: int, classes: int, groups: int) -> DataFrame:
    """cell, n, first class, bins and gradients (classes of the group x (g, h) x rows) of this round's sample of the training rows."""
    bounds = [classes * k // groups for k in range(groups + 1)]

    def run(batches):
        for p in batches:
            for row in p.itertuples():
                b, y, z = _arrays(row, features, classes)
                on = np.flatnonzero(np.random.default_rng([s.seed, round_, row.block]).random(row.n) < s.rows) if s.rows < 1 else np.arange(row.n)
                q = softmax(z[on].astype(float))
                h = classes / max(1, classes - 1) * q * (1 - q)
                q[np.arange(len(on)), y[on]] -= 1
                few = np.ascontiguousarray(b[:, on]).tobytes()
                for k in range(groups):
                    a, e = bounds[k], bounds[k + 1]
                    both = np.stack([q[:, a:e].T, h[:, a:e].T], axis=1).astype(np.float32)
                    yield pd.DataFrame([(f"{row.block}-{k}", len(on), a, few, np.ascontiguousarray(both).tobytes())], columns=["cell", "n", "first", "bins", "both"])

    return cells.where("split = 'train'").mapInPandas(run, "cell string, n int, first int, bins binary, both binary")


SUMS = "cls int, wanted array<int>, counts binary, hist binary"
CUTS = "array<struct<node int, feature int, cut int, g double, h double, gl double, hl double>>"


def level_cuts(cells: DataFrame, trees: Round, s: Settings, round_: int, level: int, features: int, wanted: list[np.ndarray], before: DataFrame | None) -> DataFrame:
    """cls, cuts (the best of every node of a level), counts, hist of all classes: one aggregate over the gradients.

    wanted are the nodes of each class whose sums are added up; those of their siblings follow from before, the level above.
    """
    spark = cells.sparkSession

    def sums(batches):
        held = {}
        for p in batches:
            for row in p.itertuples():
                b = np.frombuffer(row.bins, dtype=np.uint8).reshape(features, row.n)
                both = np.frombuffer(row.both, dtype=np.float32).reshape(-1, 2, row.n)
                for k, (g, h) in enumerate(both):
                    c = row.first + k
                    if len(wanted[c]):
                        n, hist = histogram(b, g.astype(float), h.astype(float), route(b, trees.feature[c], trees.cut[c], level), wanted[c], chosen(s, round_, c, features), s.bins)
                        if c in held:
                            held[c][0] += n
                            held[c][1] += hist
                        else:
                            held[c] = [n, hist]
        for c, (n, hist) in held.items():
            yield pd.DataFrame({"cls": [c], "wanted": [wanted[c]], "counts": [n.astype(np.int64).tobytes()], "hist": [hist.tobytes()]})

    def pick(p: pd.DataFrame, above: pd.DataFrame | None = None) -> pd.DataFrame:
        if not len(p):
            return pd.DataFrame({x: [] for x in ("cls", "cuts", "counts", "hist")}, dtype=object)
        c = int(p["cls"].iloc[0])
        own = chosen(s, round_, c, features)
        read = lambda f: (np.frombuffer(f.counts, dtype=np.int64), np.frombuffer(f.hist).reshape(len(own), -1, s.bins, 2))
        n, h = (sum(x) for x in zip(*map(read, p.itertuples()), strict=True))
        counts, hist = np.zeros(1 << level, dtype=np.int64), np.zeros((len(own), 1 << level, s.bins, 2))
        at = wanted[c] - ((1 << level) - 1)
        counts[at], hist[:, at] = n, h
        if above is not None:
            up, top = read(next(above.itertuples()))
            counts[at ^ 1], hist[:, at ^ 1] = up[at >> 1] - n, top[:, at >> 1] - h
        rows = best_cuts(counts, hist, own, s)
        kept = level + 1 < s.depth
        cuts = [dict(zip(("node", "feature", "cut", "g", "h", "gl", "hl"), r, strict=True)) for r in rows]
        return pd.DataFrame({"cls": [c], "cuts": [cuts], "counts": [counts.tobytes() if kept else b""], "hist": [hist.tobytes() if kept else b""]})

    part = cells.coalesce(spark.sparkContext.defaultParallelism).mapInPandas(sums, SUMS)
    schema = f"cls int, cuts {CUTS}, counts binary, hist binary"
    if before is None:
        return part.groupBy("cls").applyInPandas(lambda p: pick(p), schema)
    return part.groupBy("cls").cogroup(before.select("cls", "counts", "hist").groupBy("cls")).applyInPandas(lambda p, above: pick(p, above), schema)


def grown(cells: DataFrame, s: Settings, round_: int, classes: int, features: int, scratch: Scratch) -> Round:
    """The trees of a round over its gradients, level by level."""
    trees = Round.empty(classes, s.depth)
    wanted, before = [np.zeros(1, dtype=np.int64)] * classes, None
    for level in range(s.depth):
        before = scratch.keep(f"level{level % 2}", level_cuts(cells, trees, s, round_, level, features, wanted, before))
        rows = [(r["cls"], x) for r in before.select("cls", "cuts").collect() for x in r["cuts"]]  # the level's nodes
        wanted = [[] for _ in range(classes)]
        for c, r in rows:
            node = r["node"] + (1 << level) - 1
            if level == 0:
                trees.value[c, 0] = weight(r["g"], r["h"], s)
            if r["feature"] >= 0:
                trees.feature[c, node], trees.cut[c, node] = r["feature"], r["cut"]
                trees.value[c, 2 * node + 1] = weight(r["gl"], r["hl"], s)
                trees.value[c, 2 * node + 2] = weight(r["g"] - r["gl"], r["h"] - r["hl"], s)
                wanted[c].append(2 * node + (1 if 2 * r["hl"] <= r["h"] else 2))
        wanted = [np.array(sorted(x), dtype=np.int64) for x in wanted]
        if not any(map(len, wanted)):
            break
    return trees


def fit(pairs: DataFrame, classes: int, settings: Settings | None = None, edges: np.ndarray | None = None, size: int = BLOCK) -> tuple[Model, DataFrame | None]:
    """The model of pairs(x, label, split) and label, split, probs of their validation and test rows after the best round.

    Labels are 0 to classes - 1; a class without training rows starts at the logarithm of 1e-15 and keeps
    nearly no probability. Without validation rows all rounds count; without training rows there is no model.
    """
    s = settings or Settings()
    spark = pairs.sparkSession
    shares = pairs.where("split = 'train'").groupBy("label").count().collect()  # one row a class
    if not shares:
        return Model(np.zeros((0, s.bins - 1)), np.zeros(classes)), None
    n = sum(r["count"] for r in shares)
    start = np.full(classes, np.log(1e-15))
    for r in shares:
        start[r["label"]] = np.log(r["count"] / n)
    model = Model(quantile_edges(pairs.where("split = 'train'"), s.bins) if edges is None else edges, start)
    features = len(model.edges)
    with Scratch() as scratch:
        cells = scratch.keep("cells", blocks(pairs, model.edges, start, size))
        sizes = {r["split"]: (r["n"], r["b"]) for r in cells.groupBy("split").agg(F.sum("n").alias("n"), F.count("*").alias("b")).collect()}
        groups = min(classes, max(1, -(-spark.sparkContext.defaultParallelism // sizes["train"][1])))
        best = None
        for t in range(s.rounds):
            sample = scratch.keep("sample", gradients(cells, s, t, features, classes, groups), by="cell")
            trees = grown(sample, s, t, classes, features, scratch)
            model.rounds.append(trees)
            cells = scratch.keep("cells", moved(cells, trees, features, s.depth))
            if "valid" in sizes:
                loss = cells.where("split = 'valid'").agg(F.sum("loss")).first()[0] / sizes["valid"][0]
                model.losses.append(float(loss))
            if model.best == len(model.rounds):
                best = scratch.keep("best", cells.where("split <> 'train'").select("block", "split", "n", "labels", "scores"))
            if len(model.rounds) - model.best >= s.patience:
                break
        if best is None:
            return model, None
        from ..functions.lineage import cut

        return model, cut(probabilities(best, classes))


def probabilities(cells: DataFrame, classes: int) -> DataFrame:
    """label, split, probs of the rows of cells(split, n, labels, scores)."""

    def run(batches):
        for p in batches:
            for row in p.itertuples():
                q = softmax(np.frombuffer(row.scores, dtype=np.float32).reshape(row.n, classes).astype(float))
                for k in range(0, row.n, 4096):
                    yield pd.DataFrame({"label": np.frombuffer(row.labels, dtype=np.int32)[k : k + 4096], "split": row.split, "probs": list(q[k : k + 4096])})

    return cells.select("split", "n", "labels", "scores").mapInPandas(run, "label int, split string, probs array<double>")


def predict(pairs: DataFrame, model: Model) -> DataFrame:
    """pairs with probs by the rounds that count; the vector x is dropped."""
    keep = [c for c in pairs.columns if c != "x"]
    shared = pairs.sparkSession.sparkContext.broadcast((model.edges, model.start, model.rounds[: model.best]))  # as large as the model

    def run(batches):
        edges, start, rounds = shared.value
        for p in batches:
            if len(p):
                b = binned(np.array(p["x"].tolist(), dtype=float), edges)
                z = np.tile(start, (len(p), 1))
                for r in rounds:
                    depth = (r.feature.shape[1] + 1).bit_length() - 1
                    for c in range(len(start)):
                        z[:, c] += r.value[c][route(b, r.feature[c], r.cut[c], depth)]
                yield p[keep].assign(probs=list(softmax(z)))

    return pairs.mapInPandas(run, pairs.select(*keep)._jdf.schema().toDDL() + ", probs array<double>")

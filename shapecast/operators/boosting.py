"""Gradient-boosted trees by histograms, many models in the same passes.

For squared loss a row matters only through the bins of its features, so the
training rows are first summed to cells - (batch, fold, tail of the first batch,
bins) with a count and the sum of the log target. That is exact, and a log's
statements repeat: cells are far fewer than rows, and still a distributed table.

All models - the holdout fit, the five fold fits and the deployed fit of every
version - grow in the same passes over the cells. In a pass a task adds up
residuals by (model, node, feature, bin); the sums meet by model, where the best
split of each node is found; the driver sees one split a node. Trees grow
leaf-wise, the best gain first, up to ``leaves`` leaves: a pass evaluates the
children of every leaf that may be split next, so a tree costs about one pass a
level, whatever the number of models; a model goes on to its next tree without
waiting for the others. The cells of a task are blocks of arrays that
its executor keeps. Scores of the finished trees are added to them every ``KEEP``
rounds, so a pass evaluates only a few trees.

Cuts are the distinct values of a feature (the greatest of each of ``BINS`` equal
parts by rank where there are more); they use features of all rows, no target.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..session import even_tasks, materialize
from . import metrics as M
from .features import FEATURES
from .model import N_FOLDS
from .ordinal import sorted_position

#: Bins of a feature, rounds whose trees a pass evaluates anew.
BINS, KEEP = 64, 8
#: Folds of a model's name beside 0..4: fitted on all training rows, on every row.
HOLDOUT, DEPLOYED = -1, -2


@dataclass
class Setting:
    """Fixed values of the deployed model but for the number of rounds."""
    rounds: int = 40
    rate: float = 0.12
    leaves: int = 7
    least_rows: int = 4
    l2: float = 0.0


# ---- cuts and cells ---------------------------------------------------------------

def cuts(rows: DataFrame, bins: int = BINS) -> list[np.ndarray]:
    """Ascending cut values of each feature (the last bin has none): at most bins - 1."""
    values = rows.select(F.posexplode(F.array(*[F.col(f).cast("double") for f in FEATURES])).alias("k", "v")).distinct()
    ranked = sorted_position(values, ["k"], [F.col("v").asc()], "r")
    sizes = ranked.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    part = F.when(F.col("n") <= bins, F.col("r") - 1).otherwise(F.floor((F.col("r") - 1) * bins / F.col("n")))
    found = (ranked.join(F.broadcast(sizes), "k").groupBy("k", part.alias("bin")).agg(F.max("v").alias("cut"))
             .orderBy("k", "bin").collect())          # bins x features
    out: list[list[float]] = [[] for _ in FEATURES]
    for r in found:
        out[r["k"]].append(r["cut"])
    return [np.array(c[:-1], np.float64) for c in out]


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins of rows of features: x <= cut j stays at or below bin j."""
    return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1).astype(np.uint8)


def cells(rows: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """bn, tail, fold, bins, n, y: counts and sums of the log target."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, len(FEATURES))
            b = to_bins(x, edges)
            keep = [batch.column(c) for c in ("bn", "tail", "fold", "n", "y")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array([r.tobytes() for r in b], pa.binary())], ["bn", "tail", "fold", "n", "y", "bins"])

    y = F.log("TARGET_MS")
    exact = (rows.filter(y.isNotNull()).groupBy("bn", "tail", "fold", F.array(*[F.col(f).cast("double") for f in FEATURES]).alias("x"))
             .agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("y")))
    binned = exact.select("bn", "tail", "fold", "n", "y", "x").mapInArrow(
        run, "bn int, tail boolean, fold int, n long, y double, bins binary")
    return binned.groupBy("bn", "tail", "fold", "bins").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))


def in_training(name: tuple[int, int], bn: np.ndarray, tail: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Which rows the model ``name`` = (version, fold) is fitted on."""
    b, f = name
    if f == DEPLOYED:
        return bn <= b
    train = (bn == 1) & ~tail if b == 1 else bn < b
    return train if f == HOLDOUT else train & (fold != f)


# ---- trees ------------------------------------------------------------------------

@dataclass
class Split:
    feature: int
    cut: int
    gain: float
    left: tuple[float, float]       # residual sum, rows
    right: tuple[float, float]


@dataclass
class Grown:
    """A tree while it grows. Node 0 is the root; ``kids`` of a node are numbered
    when they are evaluated; ``order`` lists the nodes that are split, in order."""
    best: dict[int, Split | None] = field(default_factory=dict)
    kids: dict[int, tuple[int, int]] = field(default_factory=dict)
    count: int = 1

    def _children(self, node: int) -> tuple[int, int]:
        if node not in self.kids:
            self.kids[node] = (self.count, self.count + 1)
            self.count += 2
        return self.kids[node]

    def order(self, leaves: int) -> tuple[list[int], list[int]]:
        """Nodes split so far, the best gain first, and those to evaluate next."""
        if 0 not in self.best:
            return [], [0]
        done, open_ = [], [0]
        while len(done) < leaves - 1:
            known = [v for v in open_ if self.best.get(v)]
            if not known:
                return done, []
            v = max(known, key=lambda i: (self.best[i].gain, -i))
            open_.remove(v)
            done.append(v)
            if len(done) == leaves - 1:
                break
            kids = self._children(v)
            missing = [k for k in kids if k not in self.best]
            if missing:
                # with them, the children of the other leaves that may be split next
                others = sorted((i for i in known if i != v), key=lambda i: -self.best[i].gain)[:leaves - 1 - len(done)]
                return done, missing + [k for i in others for k in self._children(i) if k not in self.best]
            open_ += kids
        return done, []

    def finished(self, leaves: int, rate: float, l2: float) -> tuple[list[tuple], list[float]]:
        """Splits (leaf number, feature, cut, number of the new right leaf) in order, and leaf values."""
        number, splits, values = {0: 0}, [], [0.0]
        for v in self.order(leaves)[0]:
            s, (left, right), leaf = self.best[v], self._children(v), number[v]
            number[left], number[right] = leaf, len(values)
            splits.append((leaf, s.feature, s.cut, len(values)))
            values[leaf] = rate * s.left[0] / (s.left[1] + l2)
            values.append(rate * s.right[0] / (s.right[1] + l2))
        return splits, values


def leaf_of(bins: np.ndarray, splits: Sequence[tuple]) -> np.ndarray:
    leaf = np.zeros(len(bins), np.int64)
    for at, feature, cut, new in splits:
        leaf[(leaf == at) & (bins[:, feature] > cut)] = new
    return leaf


def node_of(bins: np.ndarray, tree: Grown) -> np.ndarray:
    """The deepest evaluated or asked node of each row."""
    node, todo = np.zeros(len(bins), np.int64), [0]
    while todo:
        v = todo.pop()
        if v in tree.kids and tree.best.get(v):
            s, (left, right) = tree.best[v], tree.kids[v]
            here = node == v
            high = bins[:, s.feature] > s.cut
            node[here & ~high], node[here & high] = left, right
            todo += [left, right]
    return node


# ---- passes -----------------------------------------------------------------------

#: Cells of a block at most.
BLOCK = 8192


def _blocks(models: int):
    """Cells to blocks of arrays: bins, bn, tail, fold, n, y, and a score of each model."""
    def run(rows: Iterator[Row]) -> Iterator[tuple[np.ndarray, ...]]:
        while some := list(islice(rows, BLOCK)):
            bins = np.frombuffer(b"".join(r["bins"] for r in some), np.uint8).reshape(len(some), len(FEATURES))
            of = {c: np.array([r[c] for r in some], t) for c, t in (("bn", np.int32), ("tail", bool), ("fold", np.int32), ("n", float), ("y", float))}
            yield bins, of["bn"], of["tail"], of["fold"], of["n"], of["y"], np.zeros((len(some), models))
    return run


def _histograms(names, base, recent, growing, wanted, edges):
    """Residual sums and counts by (model, node, feature, bin) of a task's cells; only
    the bins that a feature has are passed on."""
    sizes = np.array([len(e) + 1 for e in edges])
    first, width = np.cumsum(sizes) - sizes, int(sizes.sum())

    def run(blocks: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[int, tuple[int, np.ndarray]]]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for bins, bn, tail, fold, n, y, score in blocks:
            code = bins + first
            for m, name in enumerate(names):
                at = np.flatnonzero(in_training(name, bn, tail, fold)) if wanted[m] else ()
                if not len(at):
                    continue
                b = bins[at]
                f = base[m] + score[at, m]
                for splits, values in recent[m]:
                    f = f + np.array(values)[leaf_of(b, splits)]
                g = y[at] - n[at] * f
                node = node_of(b, growing[m])
                for v in wanted[m]:
                    here = np.flatnonzero(node == v)
                    if not len(here):
                        continue
                    flat = code[at[here]].ravel()
                    h = np.concatenate([np.bincount(flat, np.repeat(g[here], len(FEATURES)), width),
                                        np.bincount(flat, np.repeat(n[at[here]], len(FEATURES)), width)])
                    sums[m, v] = sums[m, v] + h if (m, v) in sums else h
        for (m, v), h in sums.items():
            yield m, (v, h)
    return run


def best_split(sums: np.ndarray, least_rows: int, l2: float) -> Split | None:
    """The split of the highest gain (ties: first feature, lowest cut); None: no gain."""
    g, n = sums.reshape(2, len(FEATURES), BINS)
    gl, nl = np.cumsum(g, axis=1)[:, :-1], np.cumsum(n, axis=1)[:, :-1]
    gt, nt = g[0].sum(), n[0].sum()
    gr, nr = gt - gl, nt - nl
    ok = (nl >= least_rows) & (nr >= least_rows)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, gl * gl / (nl + l2) + gr * gr / (nr + l2) - gt * gt / (nt + l2), -np.inf)
    # sums in another order must not turn a tie: equal to 12 digits is equal
    top = gain.max(initial=-np.inf)
    if not top > 1e-12:
        return None
    k, c = divmod(int(np.flatnonzero(gain.ravel() >= top * (1 - 1e-12))[0]), BINS - 1)
    return Split(k, c, float(gain[k, c]), (float(gl[k, c]), float(nl[k, c])), (float(gr[k, c]), float(nr[k, c])))


def _splits(settings, edges):
    """Sums of several tasks to the best split of each (model, node)."""
    place = np.concatenate([k * BINS + np.arange(len(e) + 1) for k, e in enumerate(edges)])

    def run(parts: Iterator[tuple[int, tuple[int, np.ndarray]]]) -> Iterator[tuple[int, int, Split | None]]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for m, (v, h) in parts:
            total[m, v] = total[m, v] + h if (m, v) in total else h
        for (m, v), h in total.items():
            every = np.zeros((2, len(FEATURES) * BINS))
            every[:, place] = h.reshape(2, -1)
            yield m, v, best_split(every, settings[m].least_rows, settings[m].l2)
    return run


def _rescored(recent):
    """Adds the values of finished trees to the scores of the cells."""
    def run(blocks: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
        for bins, *rest, score in blocks:
            score = score.copy()
            for m, trees in enumerate(recent):
                for splits, values in trees:
                    score[:, m] += np.array(values)[leaf_of(bins, splits)]
            yield bins, *rest, score
    return run


class Boosted:
    """Fitted models by (version, fold); ``log_ms`` scores rows of the 13 features."""

    def __init__(self, edges: list[np.ndarray], base: dict, trees: dict, first_gains: dict | None = None):
        self.edges, self.base, self.trees, self.roots = edges, base, trees, first_gains or {}

    def log_ms(self, b: int, fold: int, x: np.ndarray) -> np.ndarray:
        bins = to_bins(x, self.edges)
        out = np.full(len(x), self.base[b, fold])
        for splits, values in self.trees[b, fold]:
            out += np.array(values)[leaf_of(bins, splits)]
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        """One row a model (its trees as JSON) and one for the cuts, as Parquet."""
        rows = [(int(b), int(f), float(self.base[b, f]), json.dumps(self.trees[b, f])) for b, f in self.trees]
        rows.append((0, 0, 0.0, json.dumps([FEATURES, [e.tolist() for e in self.edges]])))
        spark.createDataFrame(rows, "b int, fold int, base double, body string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Boosted:
        rows = spark.read.parquet(path).collect()       # the models of one training run
        names, edges = json.loads(next(r["body"] for r in rows if r["b"] == 0))
        if names != FEATURES:
            raise ValueError("the saved model reads other features")
        return cls([np.array(e) for e in edges], {(r["b"], r["fold"]): r["base"] for r in rows if r["b"]},
                   {(r["b"], r["fold"]): json.loads(r["body"]) for r in rows if r["b"]})


def model_names(versions: Sequence[int]) -> list[tuple[int, int]]:
    """Every version's holdout and fold fits, and the deployed fit of the newest."""
    return [(b, f) for b in versions for f in (HOLDOUT, *range(N_FOLDS))] + [(max(versions), DEPLOYED)]


class Growth:
    """Models ``names`` = (version, fold), each with its setting, while they grow in
    the same passes. ``active``: those that still do."""

    def __init__(self, rows: DataFrame, names: Sequence[tuple[int, int]], settings: Sequence[Setting]):
        self.names, self.settings, self.edges = list(names), list(settings), cuts(rows)
        spark, table = rows.sparkSession, materialize(cells(rows, self.edges))
        # Dealt evenly by a number of its own: the cells are few bytes, but every pass is
        # work, and each task passes on a histogram a node however few cells it has.
        table = materialize(table.repartition(even_tasks(spark, table.count()), "bins", "bn", "fold", "tail"))
        self.meet = max(1, min(len(names), spark.sparkContext.defaultParallelism))     # tasks where the sums of a model meet
        mine = table.groupBy("bn", "tail", "fold").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).collect()   # a row a batch and fold
        bn, fold = (np.array([r[c] for r in mine], np.int64) for c in ("bn", "fold"))
        tail = np.array([r["tail"] for r in mine], bool)
        n, y = (np.array([r[c] for r in mine], np.float64) for c in ("n", "y"))
        if n.sum() < M.MIN_ROWS_TO_TRAIN:       # M7
            raise ValueError(f"{int(n.sum())} rows are too few to train on; {M.MIN_ROWS_TO_TRAIN} are needed")
        self.base = []
        for name in self.names:
            at = in_training(name, bn, tail, fold)
            self.base.append(float(y[at].sum() / n[at].sum()) if n[at].sum() else float("nan"))
        self.scored = table
        # Blocks of arrays, kept by the executors (what one loses is made again from the
        # written cells): a pass is one job of two stages and plans nothing.
        self.kept = [table.rdd.mapPartitions(_blocks(len(self.names))).persist(StorageLevel.MEMORY_AND_DISK)]
        self.trees: list[list] = [[] for _ in self.names]
        self.recent: list[list] = [[] for _ in self.names]
        self.roots: list[Split | None] = [None] * len(self.names)
        self.active = set(range(len(self.names)))

    def _finish(self, m: int, tree: Grown) -> None:
        if not self.trees[m]:
            self.roots[m] = tree.best.get(0)
        done = tree.finished(self.settings[m].leaves, self.settings[m].rate, self.settings[m].l2)
        self.trees[m].append(done)
        self.recent[m].append(done)

    def grow(self, rounds: int) -> None:
        """``rounds`` more trees for every active model. No model waits for another:
        one whose tree is finished asks for its next root in the same pass."""
        left = {m: rounds for m in sorted(self.active) if rounds > 0}
        growing = [Grown() for _ in self.names]
        while left:
            wanted: list[list[int]] = [[] for _ in self.names]
            for m in list(left):
                while m in left and not (nodes := growing[m].order(self.settings[m].leaves)[1]):
                    self._finish(m, growing[m])
                    growing[m] = Grown()
                    left[m] -= 1
                    if not left[m]:
                        del left[m]
                if m in left:
                    wanted[m] = nodes
            if not left:
                break
            if max(map(len, self.recent)) >= KEEP:
                self.kept.append(self.kept[-1].mapPartitions(_rescored(self.recent)).persist(StorageLevel.MEMORY_AND_DISK))
                self.recent = [[] for _ in self.names]
            parts = self.kept[-1].mapPartitions(_histograms(self.names, self.base, self.recent, growing, wanted, self.edges))
            found = parts.partitionBy(self.meet, int).mapPartitions(_splits(self.settings, self.edges)).collect()   # one row a node
            while len(self.kept) > 1:               # the pass has made the newest
                self.kept.pop(0).unpersist()
            for m, nodes in enumerate(wanted):
                for v in nodes:
                    growing[m].best[v] = None
            for m, v, split in found:
                growing[m].best[v] = split

    def round(self) -> None:
        """One more tree for every active model."""
        self.grow(1)

    def close(self) -> None:
        """Frees the blocks."""
        for blocks in self.kept:
            blocks.unpersist()


def fit(rows: DataFrame, names: Sequence[tuple[int, int]], setting: Setting | None = None) -> Boosted:
    """Fits the models ``names`` = (version, fold) on ``versions.numbered`` rows."""
    use = setting or Setting()
    growth = Growth(rows, names, [use] * len(names))
    growth.grow(use.rounds)
    growth.close()
    return Boosted(growth.edges, dict(zip(names, growth.base)), dict(zip(names, growth.trees)), dict(zip(names, growth.roots)))


# ---- grid ---------------------------------------------------------------------------

#: 72 points: learning rate, rounds, leaves, least rows of a leaf, L2.
GRID = {"rate": (0.06, 0.12, 0.24), "rounds": (20, 40), "leaves": (3, 5, 7), "least_rows": (4, 16), "l2": (0.0, 1.0)}


def _fold_errors(model_of: list[dict[int, int]], names, base, trees, edges, b: int):
    """Sums of the relative out-of-fold error of each fit over the training rows of version b."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(len(model_of)), 0
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, len(FEATURES))
            bn, fold, a = (batch.column(c).to_numpy() for c in ("bn", "fold", "actual_ms"))
            tail = batch.column("tail").to_numpy(zero_copy_only=False)
            at = np.flatnonzero(in_training((b, HOLDOUT), bn, tail, fold))
            bins, fold, a = to_bins(x[at], edges), fold[at], a[at]
            n += len(at)
            for i, by_fold in enumerate(model_of):
                for f, m in by_fold.items():
                    here = fold == f
                    p = np.full(here.sum(), base[m])
                    for splits, values in trees[m]:
                        p += np.array(values)[leaf_of(bins[here], splits)]
                    sums[i] += (np.abs(np.exp(p) - a[here]) / a[here]).sum()
        yield pa.RecordBatch.from_arrays([pa.array([sums], pa.list_(pa.float64())), pa.array([n], pa.int64())], ["s", "n"])
    return run


def grid_search(rows: DataFrame, b: int, grid: dict | None = None, exact: bool = False, step: int = KEEP) -> list[tuple[dict, float | None]]:
    """(point, out-of-fold MAPE on the training rows of version ``b``), best
    first; the holdout is not read. All points grow in the same passes, and points
    that differ in their rounds share a fit.

    Every ``step`` rounds a fit is given up (None) if its error would stay above
    the best one reached so far even if it went on falling until the last round as
    fast as in the last ``step``. Errors fall ever more slowly, so the winner is
    kept; ``exact`` gives none up."""
    from itertools import product
    use = grid or GRID
    keys = [k for k in use if k != "rounds"]
    fits = [dict(zip(keys, v)) for v in product(*(use[k] for k in keys))]
    last, marks = max(use["rounds"]), set(use["rounds"])
    names, settings, model_of = [], [], []
    for f in fits:
        model_of.append({k: len(names) + k for k in range(N_FOLDS)})
        names += [(b, k) for k in range(N_FOLDS)]
        settings += [Setting(rounds=last, **f)] * N_FOLDS
    growth = Growth(rows, names, settings)
    seen = materialize(rows.filter((F.col("bn") <= b) & F.col("TARGET_MS").isNotNull()).select(
        "bn", "fold", "tail", F.col("TARGET_MS").cast("double").alias("actual_ms"),
        F.array(*[F.col(f).cast("double") for f in FEATURES]).alias("x")))

    def errors(live: list[int]) -> dict[int, float]:
        run = _fold_errors([model_of[i] for i in live], names, growth.base, growth.trees, growth.edges, b)
        parts = seen.mapInArrow(run, "s array<double>, n long")
        got = parts.agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(len(live))]).first()
        return {i: float(got[f"s{k}"] / got["n"] * 100.0) for k, i in enumerate(live)}

    live, result, best = list(range(len(fits))), {}, math.inf
    before = {} if exact else errors(live)
    grown = 0
    for done in sorted(marks if exact else {*range(step, last + 1, step), *marks}):
        growth.grow(done - grown)
        grown = done
        now = errors(live)
        if done in marks:
            result |= {(i, done): e for i, e in now.items()}
            best = min(best, *now.values())
        if done % step == 0 and not exact:
            best = min(best, *now.values())
            live = [i for i in live if now[i] - max(0.0, before[i] - now[i]) * (last - done) / step <= best]
            growth.active = {m for i in live for m in model_of[i].values()}
            before = now
    growth.close()
    points = [({**fits[i], "rounds": r}, result.get((i, r))) for i in range(len(fits)) for r in sorted(marks)]
    return sorted(points, key=lambda p: (p[1] is None, p[1] or 0.0, str(p[0])))


def predict(rows: DataFrame, model: Boosted, b: int, deployed: bool = False) -> DataFrame:
    """M9: every row up to version b with actual_ms, predicted_ms and in_holdout -
    holdout rows by the holdout fit, the others by the fit without their fold
    (``deployed``: all by the deployed fit, M10 and M12)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, len(FEATURES))
            use = batch.column("use").to_numpy()
            out = np.zeros(batch.num_rows)
            for f in np.unique(use):
                at = use == f
                out[at] = np.exp(model.log_ms(b, int(f), x[at]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out)], [*batch.schema.names[:-2], "predicted_ms"])

    hold = (F.col("bn") == b) if b > 1 else F.col("tail")
    use = F.lit(DEPLOYED) if deployed else F.when(hold, F.lit(HOLDOUT)).otherwise(F.col("fold"))
    seen = rows.filter(F.col("bn") <= b).select(
        "QUERY_ID", hold.cast("int").alias("in_holdout"), F.col("TARGET_MS").cast("double").alias("actual_ms"),
        F.array(*[F.col(f).cast("double") for f in FEATURES]).alias("x"), use.cast("int").alias("use"))
    return seen.mapInArrow(run, "QUERY_ID string, in_holdout int, actual_ms double, predicted_ms double")

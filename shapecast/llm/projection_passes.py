"""Near-duplicate vectors by sorted projection passes.

A pass orders the vectors of a label lexicographically by 64 concatenated
random-hyperplane bits (planes of its own) and compares neighbours: each task
reads its range in that order, block by block (``WINDOW`` vectors), and compares
a block with itself and with the one before; the blocks on both sides of a
border between ranges are compared afterwards. Passes go on until the expected
share of pairs just at the threshold that no pass has brought together is below
``1 - recall`` - measured from the data: two vectors meet if they agree on one
bit more than the whole window does - so their number follows the size and the
density of the table.

Pairs found are verified at once and only join components (a block passes on at
most one edge a vector, never its pairs). Inside a component every pair is then
compared, in tiles of ``TILE`` vectors, and links are counted there: the bounded
window loses no link of a dense group, however large, and no pair is ever a row.
That work grows with the square of the largest component. Equal vectors of a
label take part once and count as often as they occur.

Defined results: a vector that is null, empty, zero, or holds a null or
non-finite component, or whose label is null, links with nothing; neither do
vectors of different length. Each row is a vector of its own, also with a
repeated or null id: ``component_id`` is the least id that is not null in the
component (null if there is none) and ``kept`` compares null with null as equal.
An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components

#: Vectors of a block of a pass, of a tile of a component, and of a bucket of small components.
WINDOW, TILE, BUCKET = 512, 1024, 4096
BITS = 64
SEED = 20240611

PASS = "kind int, pid int, u long, v long, label string, e array<double>, met double"
PASS_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.float64()), pa.float64()]
#: Kinds of rows of a pass: an edge, a vector of a range's first or last block, a share that met.
EDGE, HEAD, TAIL, MET = range(4)


def _unit_length(e: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 (first by their largest component: no overflow, no underflow)."""
    e = e / np.abs(e).max(axis=1, keepdims=True)
    return e / np.sqrt((e * e).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def planes(number: int, size: int) -> np.ndarray:
    return np.random.default_rng((SEED, number, size)).standard_normal((size, BITS))


def _keys(number: int):
    """Adds the order key of a pass: the signs of the projections, the first plane first."""
    weight = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            key = np.zeros(batch.num_rows, np.uint64)
            for d in np.unique(sizes):
                if d not in known:
                    known[d] = planes(number, int(d))
                at = np.flatnonzero(sizes == d)
                signs = _matrix(batch.column("e").take(pa.array(at))) @ known[d] > 0
                key[at] = (signs * weight).sum(axis=1, dtype=np.uint64)
            # as a signed number of the same order
            ordered = (key ^ np.uint64(1 << 63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ordered)], [*batch.schema.names, "key"])
    return run


def _roots(linked: np.ndarray) -> np.ndarray:
    """Least place that each row reaches in a symmetric boolean matrix."""
    root = np.arange(len(linked))
    while True:
        near = np.minimum(root, np.where(linked, root[None, :], len(root)).min(axis=1, initial=len(root)))
        near = near[near]
        if (near == root).all():
            return root
        root = near


def _edges(units: np.ndarray, codes: np.ndarray, e: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """What joins the rows that link (same code, cosine of ``least`` or more): row and root."""
    linked = (e @ e.T >= least) & (codes[:, None] == codes[None, :])
    np.fill_diagonal(linked, False)
    some = np.flatnonzero(linked.any(axis=1))
    if not len(some):
        return units[:0], units[:0]
    root = some[_roots(linked[np.ix_(some, some)])]
    far = root != some
    return units[some[far]], units[root[far]]


def _met(keys: np.ndarray, labels: np.ndarray, chance: float) -> float:
    """Expected number of the window's rows that meet a partner at the threshold:
    it has to agree on one bit more than the rows of the label here do."""
    first = np.flatnonzero(np.concatenate(([True], labels[1:] != labels[:-1])))
    last = np.append(first[1:], len(labels)) - 1
    total = 0.0
    for a, b in zip(first, last):
        if a > 0 and b < len(labels) - 1:
            total += b - a + 1
        else:
            differ = (int(keys[a]) ^ int(keys[b])) & (2**BITS - 1)
            total += (b - a + 1) * chance ** min(BITS, BITS - differ.bit_length() + 1)
    return total


def _neighbours(least: float, chance: float):
    """Rows in the order of a pass to edges, border rows and the share that met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, waiting, count = TaskContext.get().partitionId(), [], 0
        before, head, met, rows = None, None, 0.0, 0

        def out(kind, u=(), v=None, label=None, e=None, share=None):
            n = len(u) if share is None else 1
            cols = [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, pid, np.int32)),
                    pa.array(u, pa.int64()) if share is None else pa.array([rows], pa.int64()),
                    pa.nulls(n, pa.int64()) if v is None else pa.array(v, pa.int64()),
                    pa.nulls(n, pa.string()) if label is None else pa.array(label, pa.string()),
                    pa.nulls(n, PASS_TYPES[5]) if e is None else pa.array(list(e), PASS_TYPES[5]),
                    pa.nulls(n, pa.float64()) if share is None else pa.array([share], pa.float64())]
            return pa.RecordBatch.from_arrays(cols, ["kind", "pid", "u", "v", "label", "e", "met"])

        def blocks():
            """Blocks of at most WINDOW rows of one length of vector, in order."""
            nonlocal waiting, count
            for batch in batches:
                sizes = batch.column("size").to_numpy()
                cut = np.flatnonzero(sizes[1:] != sizes[:-1]) + 1
                for a, b in zip(np.concatenate(([0], cut)), np.append(cut, len(sizes))):
                    if a == b:
                        continue
                    if waiting and waiting[0].column("size")[0].as_py() != sizes[a]:
                        yield pa.concat_batches(waiting)
                        waiting, count = [], 0
                    while a < b:
                        part = batch.slice(a, min(b - a, WINDOW - count))
                        waiting.append(part)
                        a, count = a + part.num_rows, count + part.num_rows
                        if count == WINDOW:
                            yield pa.concat_batches(waiting)
                            waiting, count = [], 0
            if waiting:
                yield pa.concat_batches(waiting)

        for block in blocks():
            raw = _matrix(block.column("e"))
            now = (block.column("unit").to_numpy(), np.array(block.column("label").to_pylist(), object),
                   block.column("key").to_numpy(), _unit_length(raw), raw)
            if head is None:
                head = now
                yield out(HEAD, now[0], None, now[1], now[4])
            near = before is not None and before[3].shape[1] == now[3].shape[1]
            units, labels, keys, e = (np.concatenate([a, b]) for a, b in zip(before[:4], now[:4])) if near else now[:4]
            yield out(EDGE, *_edges(units, np.unique(labels, return_inverse=True)[1], e, least))
            met += _met(keys, labels, chance) * len(now[0]) / len(units)
            rows += len(now[0])
            before = now
        if before is not None:
            yield out(TAIL, before[0], None, before[1], before[4])
            yield out(MET, share=met)
    return run


def _border(least: float):
    """The last block of a range and the first of the next one to edges."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, same in rows.groupby(rows["e"].map(len)):
            units, labels = same["u"].to_numpy(), np.unique(same["label"].to_numpy(), return_inverse=True)[1]
            found.append(_edges(units, labels, _unit_length(np.stack(same["e"].to_numpy())), least))
        u, v = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"u": u, "v": v})
    return run


def _count(least: float):
    """Links of the vectors of tiles i and j of a component (of whole small components)."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        i, j = key[1], key[2]
        units, links = [], []
        rows = rows.sort_values("root", kind="stable")
        root = rows["root"].to_numpy()
        first = np.flatnonzero(np.concatenate(([True], root[1:] != root[:-1])))
        sizes = np.diff(np.append(first, len(root)))
        unit, copies = rows["unit"].to_numpy(), rows["copies"].to_numpy()
        if i != j:
            side = rows["tile"].to_numpy() == i
            e = _unit_length(np.stack(rows["e"].to_numpy()))
            hit = e[side] @ e[~side].T >= least
            units, links = [unit[side], unit[~side]], [hit @ copies[~side], hit.T @ copies[side]]
        else:
            length = rows["e"].map(len).to_numpy()
            for n, d in sorted(set(zip(sizes.tolist(), length[first].tolist()))):
                at = first[(sizes == n) & (length[first] == d)][:, None] + np.arange(n)
                step = max(1, 4_000_000 // (n * n))
                for k in range(0, len(at), step):
                    some = at[k:k + step]
                    e = _unit_length(np.stack(rows["e"].to_numpy()[some.reshape(-1)])).reshape(len(some), n, d)
                    hit = e @ e.transpose(0, 2, 1) >= least
                    hit[:, np.arange(n), np.arange(n)] = False
                    units.append(unit[some].reshape(-1))
                    links.append((hit * copies[some][:, None, :]).sum(axis=2).reshape(-1))
        return pd.DataFrame({"unit": np.concatenate(units), "links": np.concatenate(links).astype(np.int64)})
    return run


def find_edges(units: DataFrame, least: float, recall: float) -> DataFrame:
    """u, v: enough verified pairs to join what the passes found."""
    chance = 1 - math.acos(least) / math.pi
    missed, passes = 1.0, []
    while not passes or missed > 1 - recall:
        keyed = units.select("unit", "label", F.size("e").alias("size"), "e").mapInArrow(
            _keys(len(passes)), "unit long, label string, size int, e array<double>, key long")
        order = ["label", "size", "key", "unit"]
        dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
        done = written(dealt.mapInArrow(_neighbours(least, chance), PASS), f"pass-{len(passes)}")
        rows, met = done.where(F.col("kind") == MET).agg(F.sum("u"), F.sum("met")).first()
        if not rows:
            break
        missed *= 1 - met / rows
        passes.append(done.withColumn("turn", F.lit(len(passes))))
    if not passes:
        return units.select(F.col("unit").alias("u"), F.col("unit").alias("v"))
    table = passes[0]
    for p in passes[1:]:
        table = table.unionByName(p)
    # each range's next one that has rows: two numbers a range
    has = [tuple(r) for r in table.where(F.col("kind") == TAIL).select("turn", "pid").distinct().orderBy("turn", "pid").collect()]
    after = [(*a, b[1]) for a, b in zip(has, has[1:]) if a[0] == b[0]]
    edges = table.where(F.col("kind") == EDGE).select("u", "v")
    if not after:
        return edges
    after = units.sparkSession.createDataFrame(after, "turn int, pid int, gap int")
    ends = table.where(F.col("kind").isin(HEAD, TAIL))
    tails = ends.where(F.col("kind") == TAIL).join(after, ["turn", "pid"])
    heads = ends.where(F.col("kind") == HEAD).join(after.select("turn", F.col("gap").alias("pid"), "gap"), ["turn", "pid"])
    met = tails.unionByName(heads).select("turn", "gap", "u", "label", "e")
    return edges.unionByName(met.groupBy("turn", "gap").applyInPandas(_border(least), "u long, v long"))


def link(vectors: DataFrame, threshold: float = 0.93, recall: float = 0.99) -> DataFrame:
    """vec_id, n_links (other vectors of the label with a cosine of ``threshold`` or
    more), component_id (least id reached by links), kept, of every row."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                          F.col("embedding").cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & finite & F.exists("e", lambda x: x != 0), F.lit(False))
    rows = written(rows.withColumn("h", F.when(usable, F.xxhash64("label", "e"))), "vectors")
    units = (rows.where("h is not null").groupBy("label", "h", "e").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
             .withColumn("unit", F.monotonically_increasing_id()))
    units = written(units, "units")
    joined = components(written(find_edges(units, threshold, recall), "found"))
    members = written(joined.unionByName(joined.select(F.col("root").alias("node"), "root").distinct())
                      .withColumnRenamed("node", "unit"), "members")
    sizes = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    buckets = max(1, members.count() // BUCKET)
    dealt = members.join(sizes, "root").withColumns({
        "tile": F.pmod(F.xxhash64("unit"), F.col("tiles")).cast("int"),
        "bucket": F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("root"), F.lit(buckets))).otherwise(-1 - F.col("root"))})
    # a tile meets each tile of its component once
    meet = (dealt.join(units.select("unit", "copies", "e"), "unit")
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
            .select("bucket", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "root", "tile", "unit", "copies", "e"))
    found = meet.groupBy("bucket", "i", "j").applyInPandas(_count(threshold), "unit long, links long")
    links = found.groupBy("unit").agg(F.sum("links").alias("links"))
    named = units.join(members, "unit", "left").withColumn("root", F.coalesce("root", "unit"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    known = named.join(ids, "root").join(links, "unit", "left").select(
        "label", "h", "e", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = rows.where("h is not null").join(known, ["h", "label", "e"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("h is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

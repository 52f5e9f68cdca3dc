"""The prefix trie of conversations by adaptive radix trees over turn ids.

Every distinct turn (role, text) gets an 8-byte number, so a conversation is a
key of fixed-width big-endian ids. The keys are range-sorted with their
conversation ids - a hot first turn, or a conversation with very many copies, is
cut into as many ranges as it needs - and each task builds an adaptive radix
tree (growing node layouts, compressed paths) of its range. Only depths that are
a multiple of 8 bytes are nodes of the trie; bytes at which a tree merely
branches inside an id are not.

A node that is not a beginning of its range's first or last key lies in one
range: it is finished there. The others ("open": at most two paths a range) are
summed over the ranges by the SHA-256 of their path. What two neighbouring
ranges both count - the common beginning of the last key of one and the first
key of the other - is taken off by that border's corrections. The ids that end
in an open node are hashed from pieces in order, streaming.

Defined results: null role or text is empty text, as the contract says; turns of
a conversation are ordered by number, null first, equal numbers by role, then
text (repeated rows are turns of their own); rows without a ``conv_id`` belong to
no conversation and are left out; ``%`` of a negative id keeps its sign. An empty
table gives no row. A conversation's ids (8 bytes a turn) are held in one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .radix_tree import Tree

WIDTH = 8
#: Turns of conversations whose tree one task holds, and ids of a piece that is hashed.
TURNS, PIECE = 300_000, 100_000
#: Turns that a conversation may take from another one.
MOST_SHARED = 5
EMPTY = hashlib.sha256(b"").hexdigest()

#: Kinds of rows of a task: finished nodes, finished nodes below an open one, open nodes, ids that end in an open node, first and last key.
DONE, BELOW, OPEN, ENDS, SPAN = range(5)
MEASURES = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
FIELDS = [("kind", pa.int32()), ("pid", pa.int32()), ("part", pa.int32()), ("name", pa.binary()), ("above", pa.binary()),
          *[(m, pa.int64()) for m in MEASURES], ("ends", pa.string()), ("first", pa.binary()), ("last", pa.binary()), ("sizes", pa.list_(pa.int64()))]
SCHEMA = ", ".join(f"{n} { {'int32': 'int', 'binary': 'binary', 'int64': 'long', 'string': 'string', 'list<item: int64>': 'array<long>'}[str(t)]}" for n, t in FIELDS)
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_rows(convs: DataFrame) -> DataFrame:
    """conv_id, turn, place (among turns of one number), id, size (code points) of every turn."""
    rows = convs.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("role", "text"))
    named = written(rows.groupBy("h", "role", "text").agg(F.length("text").cast("long").alias("size"))
                    .withColumn("id", F.monotonically_increasing_id()), "turns")
    slim = written(rows.join(named, ["h", "role", "text"]).select("conv_id", "turn", "id", "size"), "turn-rows")
    # different turns of one number: by role and text
    tied = slim.groupBy("conv_id", "turn").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b")
    if tied.isEmpty():
        return slim.withColumn("place", F.lit(0).cast("long"))
    same = (slim["conv_id"] == tied["conv_id"]) & slim["turn"].eqNullSafe(tied["turn"])
    ids = slim.join(tied, same, "left_semi").select("id").distinct()
    order = ["role", "text"]
    placed = written(named.join(ids, "id", "left_semi").repartitionByRange(*order).sortWithinPartitions(*order)
                     .select("id", F.monotonically_increasing_id().alias("place")), "tied-turns")
    return slim.join(placed, "id", "left").withColumn("place", F.coalesce("place", F.lit(0).cast("long")))


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, key (ids of the rebuilt conversation), sizes."""
    own = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        (F.col("turn").isNotNull()).alias("numbered"), "turn", "place", "id", "size"))).alias("own"))
    own = own.select("conv_id", F.transform("own", lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))).alias("own"))
    own = written(own, "conversations")
    heads = own.select(F.col("conv_id").alias("base"), F.slice("own", 1, MOST_SHARED).alias("head"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("int")
    joined = (own.withColumns({"h": taken, "base": F.col("conv_id") - F.col("conv_id") % 100}).join(heads, "base", "left"))
    whole = joined.select("conv_id", F.concat(
        F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast("array<struct<id:long,size:long>>")),
        F.slice("own", F.col("h") + 1, F.size("own"))).alias("seq"))
    key = F.unhex(F.array_join(F.transform("seq", lambda t: F.lpad(F.hex(t["id"]), 2 * WIDTH, "0")), ""))
    return whole.select("conv_id", key.alias("key"), F.transform("seq", lambda t: t["size"]).alias("sizes"))


def _names(key: bytes) -> list[bytes]:
    """SHA-256 of each turn-aligned beginning of a key, the empty one first."""
    running = hashlib.sha256()
    out = [running.digest()]
    for at in range(0, len(key), WIDTH):
        running.update(key[at:at + WIDTH])
        out.append(running.digest())
    return out


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys in order to the nodes of this range's tree."""
    pid, tree, first, last = TaskContext.get().partitionId(), Tree(), None, None
    for batch in batches:
        for conv, key, sizes in zip(batch.column("conv_id").to_pylist(), batch.column("key").to_pylist(), batch.column("sizes")):
            if last is None or key != last[0]:
                last = key, sizes.values.to_numpy() if len(sizes) else ()
                first = key if first is None else first
            tree.add(key, conv, last)
    if last is None:
        return
    rows: list[dict] = [dict(kind=SPAN, pid=pid, first=first, last=last[0], sizes=list(last[1]))]
    ways = [(tree.way(k), _names(k)) for k in (first, last[0])]
    below: dict[int, tuple] = {}
    for node, above in tree.upwards():
        end = above + len(node.path)
        kids = [below.pop(id(kid)) for _, kid in node.kids.items()]
        n, leaves, saved = (sum(k[i] for k in kids) for i in range(3))
        n += len(node.values)
        least = min([k[3] for k in kids] + node.values[:1])
        waiting = [row for k in kids for row in k[4]]
        names = next((names for way, names in ways if id(node) in way), None)
        # aligned depths on the node's path, the deepest first; the root is one, too
        for at in range(end - end % WIDTH, above if node is not tree.root else -1, -WIDTH):
            depth = at // WIDTH
            ends = node.values if at == end else []
            saved += (n - 1) * int(node.key[1][depth - 1]) if depth else 0
            leaves = leaves if waiting else 1
            row = dict(kind=OPEN if names else DONE, pid=pid, depth=depth, conv_id=least, n_convs=n, n_children=len(waiting),
                       n_leaves=leaves, saved_tokens=saved)
            if names:
                row |= dict(name=names[depth], above=names[depth - 1] if depth else None)
                rows += [dict(kind=ENDS, pid=pid, part=i, name=names[depth], ends=",".join(map(str, ends[i:i + PIECE])))
                         for i in range(0, len(ends), PIECE)]
            else:
                row["ends"] = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
            for w in waiting:
                if row["kind"] == DONE:
                    w["parent_conv_id"] = least
                elif w["kind"] == DONE:
                    w |= dict(kind=BELOW, above=row["name"])
            rows.append(row)
            waiting = [row]
        below[id(node)] = (n, leaves, saved, least, waiting)
    for at in range(0, len(rows), 20_000):
        some = rows[at:at + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array([r.get(f) for r in some], t) for f, t in FIELDS], [f for f, _ in FIELDS])


def _border(rows: pd.DataFrame) -> pd.DataFrame:
    """The last key of a range and the first of the next one to what both count."""
    left, right = (rows[rows["side"] == s].iloc[0] for s in (0, 1))
    a, b, same = left["key"], right["key"], 0
    while same < min(len(a), len(b)) // WIDTH and a[same * WIDTH:(same + 1) * WIDTH] == b[same * WIDTH:(same + 1) * WIDTH]:
        same += 1
    names, sizes = _names(a[:same * WIDTH]), [0, *left["sizes"]][:same + 1]
    out, twice = [], 0
    for depth in range(same, -1, -1):
        twice += int(sizes[depth])
        # a leaf on the left: the node at which both part is counted as a leaf there
        out.append((names[depth], -(depth < same), -(len(a) == same * WIDTH), twice))
    return pd.DataFrame(out, columns=["name", "n_children", "n_leaves", "saved_tokens"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of ids in order to one hash for each node."""
    name, running = None, None
    for batch in batches:
        out = []
        for now, piece in zip(batch.column("name").to_pylist(), batch.column("ends").to_pylist()):
            if now != name:
                if name is not None:
                    out.append((name, running.hexdigest()))
                name, running = now, hashlib.sha256()
            else:
                running.update(b",")
            running.update(piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.string())], ["name", "ends"])
    if name is not None:
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([running.hexdigest()])], ["name", "ends"])


def trie(convs: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256 of every node of the trie of the rebuilt conversations."""
    spark = convs.sparkSession
    keys = written(rebuilt(turn_rows(convs)), "keys")
    turns = keys.agg(F.sum(F.size("sizes") + 1)).first()[0]
    ranges = max(1, -(-(turns or 0) // TURNS))
    dealt = keys.repartitionByRange(ranges, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    found = written(dealt.select("conv_id", "key", "sizes").mapInArrow(_grow, SCHEMA), "trie")
    spans = found.where(F.col("kind") == SPAN)
    # each range's next one that has rows: two numbers a range
    has = [r[0] for r in spans.select("pid").orderBy("pid").collect()]
    after = spark.createDataFrame(list(zip(has, has[1:])), "pid int, gap int")
    lefts = spans.join(after, "pid").select("gap", F.lit(0).alias("side"), F.col("last").alias("key"), "sizes")
    rights = spans.join(after.select(F.col("gap").alias("pid")), "pid").select(
        F.col("pid").alias("gap"), F.lit(1).alias("side"), F.col("first").alias("key"), F.lit(None).cast("array<long>").alias("sizes"))
    twice = lefts.unionByName(rights).groupBy("gap").applyInPandas(
        _border, "name binary, n_children long, n_leaves long, saved_tokens long")
    parts = found.where(F.col("kind") == OPEN).select("name", "above", *[m for m in MEASURES if m != "parent_conv_id"])
    opened = (parts.unionByName(twice, allowMissingColumns=True).groupBy("name").agg(
        F.max("above").alias("above"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        *[F.sum(m).alias(m) for m in ("n_convs", "n_children", "n_leaves", "saved_tokens")]))
    pieces = found.where(F.col("kind") == ENDS).select("name", "pid", "part", "ends")
    ends = pieces.repartition("name").sortWithinPartitions("name", "pid", "part").mapInArrow(_hashed, "name binary, ends string")
    opened = written(opened.join(ends, "name", "left").withColumn("ends", F.coalesce("ends", F.lit(EMPTY))), "open-nodes")
    parents = opened.select(F.col("name").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    under = found.where(F.col("kind") == BELOW).select("above", *[m for m in MEASURES if m != "parent_conv_id"], "ends")
    joined = under.unionByName(opened.select(*under.columns).where("above is not null")).join(parents, "above").drop("above")
    top = opened.where("above is null").select(*[m for m in MEASURES if m != "parent_conv_id"], "ends", F.lit(None).cast("long").alias("parent_conv_id"))
    done = found.where(F.col("kind") == DONE).select(*MEASURES, "ends")
    return done.unionByName(joined).unionByName(top).withColumnRenamed("ends", "ends_sha256").select(*RESULT)

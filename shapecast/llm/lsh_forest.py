"""Near-duplicate join on word n-grams by a MinHash LSH forest.

Copies (equal n-gram sets) are folded into classes first. Each class has a
signature of ``TREES`` sequences of ``DEPTH`` minima: its paths in as many
prefix tries. Prefixes start at full depth and are shortened until a pair at
the threshold shares a prefix in some trie with the target recall
(1 - (1 - s^d)^trees); classes with equal prefixes are joined to the least of
them, and the connected groups of these stars are the candidates. Within a
group every pair is verified exactly on the n-gram sets, so what a trie missed
is found there as well. Large groups are cut into blocks that meet two by two;
a task counts the links of its block pair and passes on one row for each class,
never the pairs. Components of the verified links give the classes of the result.

Defined cases: a text of fewer words than the n-gram has one n-gram of all of
them; a text without words (null, empty, blank) is alone in its class, with no
links; rows without an id are joined as any other, a class of only such rows
has a null id; repeated rows are copies; an empty table gives no rows; very
long texts are taken whole; extra columns are ignored. Work within a group of
different texts grows with the square of its size: exact link counts need that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, texts, written
from .components import components
from .hashing import shingles

TREES, DEPTH = 24, 8
BLOCK = 1500
#: n-grams in up to so many classes of a block pair are counted by their pairs, others by matrix products.
RARE = 16
_R = np.random.default_rng(7)
_XOR = _R.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32)
_MUL = _R.integers(0, 2**31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signature(grams: np.ndarray) -> np.ndarray:
    """Minima of ``TREES * DEPTH`` hash functions, one trie after the other."""
    out = np.full(TREES * DEPTH, 2**32 - 1, np.uint32)
    low = (grams >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(low), 2048):
        h = low[at:at + 2048, None] ^ _XOR
        h *= _MUL
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        np.minimum(out, h.min(axis=0), out=out)
    return out


def prefix_depth(threshold: float, recall: float) -> int:
    """Shortens the matched prefix until the recall at the threshold is reached."""
    depth = DEPTH
    while depth > 1 and 1 - (1 - threshold**depth) ** TREES < recall:
        depth -= 1
    return depth


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_hash, copy (hash of the n-gram set; null: no words), sig of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies, sigs = [], []
            for t in batch.column("text").to_pylist():
                g = shingles(t, width)
                copies.append(hashlib.blake2b(g.tobytes(), digest_size=16).digest() if len(g) else None)
                sigs.append(signature(g).astype(">u4").tobytes() if len(g) else None)
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), pa.array(copies, pa.binary()),
                                   pa.array(sigs, pa.binary())], ["doc_id", "text_hash", "copy", "sig"])

    rows = texts(docs).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, copy binary, sig binary")


def candidate_edges(classes: DataFrame, depth: int) -> DataFrame:
    """(u, v): classes with an equal prefix of a trie, joined to the least of them."""
    size = 4 * DEPTH
    path = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64(
        t, F.substring("sig", t * size + 1, F.lit(4 * depth))))
    keys = classes.select("copy", F.posexplode(path).alias("tree", "key"))
    heads = keys.groupBy("tree", "key").agg(F.min("copy").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return keys.join(heads, ["tree", "key"]).where("copy <> v").select(F.col("copy").alias("u"), "v").distinct()


def _shared(a: list[np.ndarray], b: list[np.ndarray], same: bool) -> np.ndarray:
    """Sizes of the intersections of every set of ``a`` with every set of ``b``."""
    out = np.zeros((len(a), len(b)), np.float32)
    hashes = np.concatenate([*a, *([] if same else b)])
    node = np.repeat(np.arange(len(a) + (0 if same else len(b))), [len(x) for x in (a if same else a + b)])
    order = np.argsort(hashes, kind="stable")
    hashes, node = hashes[order], node[order]
    first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
    size = np.diff(np.append(first, len(hashes)))
    flat = out.reshape(-1)
    side = 0 if same else len(a)
    for f in range(2, RARE + 1):
        at = first[size == f]
        if not len(at):
            continue
        group = node[at[:, None] + np.arange(f)]
        for i in range(f):
            for j in range(f):
                if i != j:
                    x, y = group[:, i], group[:, j] - side
                    ok = np.ones(len(x), bool) if same else (x < len(a)) & (y >= 0)
                    np.add.at(flat, x[ok] * len(b) + y[ok], 1)
    many = first[size > RARE]
    sizes = size[size > RARE]
    for k in range(0, len(many), 1024):
        at, n = many[k:k + 1024], sizes[k:k + 1024]
        column = np.repeat(np.arange(len(at)), n)
        row = node[np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        dense = np.zeros((len(a) + (0 if same else len(b)), len(at)), np.float32)
        dense[row, column] = 1
        out += dense[:len(a)] @ (dense if same else dense[len(a):]).T
    return out


def _local_roots(linked: np.ndarray) -> np.ndarray:
    """Least index reachable in a symmetric boolean matrix."""
    root = np.arange(len(linked))
    while True:
        near = np.where(linked, root[None, :], len(root)).min(axis=1, initial=len(root))
        new = np.minimum(root, near)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verify(width: int, threshold: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        i, j = key[1], key[2]
        rows = rows.drop_duplicates("copy").sort_values("copy")
        left, right = rows[rows["block"] == i], rows[rows["block"] == j]
        a = [shingles(t, width) for t in left["text"]]
        b = a if i == j else [shingles(t, width) for t in right["text"]]
        if not a or not b:
            return pd.DataFrame({"copy": [], "links": [], "root": []})
        both = _shared(a, b, i == j)
        na, nb = (np.array([len(x) for x in s], np.float64) for s in (a, b))
        # exact in integers: shared / union >= threshold
        union = na[:, None] + nb[None, :] - both
        hit = both * 10_000 >= union * round(threshold * 10_000)
        if i == j:
            np.fill_diagonal(hit, False)
            names, whole = left["copy"].to_numpy(), hit
            links = hit.sum(1)
        else:
            names = np.concatenate([left["copy"].to_numpy(), right["copy"].to_numpy()])
            whole = np.zeros((len(names), len(names)), bool)
            whole[:len(a), len(a):] = hit
            whole[len(a):, :len(a)] = hit.T
            links = np.concatenate([hit.sum(1), hit.sum(0)])
        root = _local_roots(whole)
        some = links > 0
        return pd.DataFrame({"copy": names[some], "links": links[some].astype(np.int64), "root": names[root[some]]})
    return run


def join_classes(docs: DataFrame, width: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """doc_id, text_hash, copy, class_id (least doc_id of the connected group),
    copy_id (least doc_id with an equal n-gram set), n_links (different sets of
    similarity ``threshold`` or more) of every row."""
    with small_batches(docs.sparkSession):
        signed = written(_signed(docs, width), "signatures")
    classes = (signed.where("copy is not null").groupBy("copy")
               .agg(F.min(F.struct("doc_id", "text_hash")).alias("row"), F.min("doc_id").alias("copy_id"), F.min("sig").alias("sig")))
    classes = written(classes.select("copy", "copy_id", "row.doc_id", "row.text_hash", "sig"), "classes")
    groups = components(candidate_edges(classes, prefix_depth(threshold, recall)))
    roots = groups.select(F.col("root").alias("node"), "root").distinct()
    members = written(groups.unionByName(roots).withColumnRenamed("node", "copy"), "groups")
    sizes = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("copy"), F.col("blocks")).cast("int"))
    # a block meets each block of its group once
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    meet = dealt.select("root", "copy", "block", every).select(
        "root", "copy", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    own = texts(docs).withColumn("text_hash", F.xxhash64("text"))
    named = meet.join(classes.select("copy", "doc_id", "text_hash"), "copy")
    have = named.join(own.withColumnRenamed("doc_id", "own_id"), (F.col("own_id").eqNullSafe(F.col("doc_id")))
                      & (own["text_hash"] == named["text_hash"])).select("root", "i", "j", "copy", "block", "text")
    found = written(have.groupBy("root", "i", "j").applyInPandas(_verify(width, threshold), "copy binary, links long, root binary"), "links")
    links = found.groupBy("copy").agg(F.sum("links").alias("n_links"))
    joined = components(found.where("copy <> root").select(F.col("copy").alias("u"), F.col("root").alias("v")))
    named = (classes.select("copy", "copy_id").join(links, "copy", "left")
             .join(joined.withColumnRenamed("node", "copy"), "copy", "left")
             .withColumn("root", F.coalesce("root", "copy")))
    least = named.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    per_copy = named.join(least, "root").select("copy", "copy_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return (signed.drop("sig").join(per_copy, "copy", "left")
            .select("doc_id", "text_hash", "copy", F.when(F.col("copy").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                    F.when(F.col("copy").isNull(), F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
                    F.coalesce("n_links", F.lit(0)).alias("n_links")))


def drop_near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row of each class stays (the least id, then the least text hash), with
    all its columns, one without an id only where none has one; rows without words stay."""
    found = join_classes(docs, width, threshold)
    keep = (found.where("copy is not null").groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("k"))
            .select("k.doc_id", "k.text_hash").distinct())
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # join and window have the same plain keys (no null in them), so texts are dealt once
    same = ["_none", "_d", "_h"]
    keep = keep.select(F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_d"), F.col("text_hash").alias("_h"),
                       F.lit(True).alias("_kept"))
    own = F.col("doc_id").cast("long")
    marked = docs.withColumns({"_none": own.isNull(), "_d": F.coalesce(own, F.lit(0)), "_h": F.xxhash64(text)})
    joined = marked.join(keep, same, "left")
    blank = ~text.rlike("[^\\x20\\x09-\\x0D]")
    # repeated rows of one id and text: one of them
    one = joined.where(F.col("_kept") & ~blank).withColumn(
        "_n", F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(1)))).where("_n = 1").drop("_n")
    return one.unionByName(joined.where(blank)).select(*docs.columns)

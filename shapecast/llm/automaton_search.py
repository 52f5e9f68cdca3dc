"""Ranked lexical search by one scan of the documents with an Aho-Corasick automaton.

The terms of all items form one automaton; a term is guarded by a space on both
sides and the text is brought to the same form (A-Z lower-cased, every delimiter
a space), so that an output is always a whole term. The scan gives each
document its number of terms and the frequency of every item term in it; there
is no index of the documents. The counts are written once; document frequencies
and lengths are summed from them, then each task scores its documents for all
items of the automaton and passes on its ``k`` best for each item.

An automaton holds at most about ``MOST_TERMS`` (item, term) entries, or one
item if that has more: with more items the table of items is split by a hash
and the documents are scanned once for each part. Only that bounded part
passes the driver and is sent to the workers.

Defined results: a null or empty text has no term and counts in nothing; a null
or repeated ``doc_id`` is a document of its own for each row (null ids rank
last among equal scores); rows of one ``item_id`` (null is one, too) are one
item with the terms of all of them; an item without a term, or an empty table
on either side, gives no row. Columns other than the ids and texts are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import texts, written

#: Terms are the maximal runs of these characters.
TERM_RE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (item, term) entries of one automaton.
MOST_TERMS = 500_000
#: Cells (documents x items) scored at a time, and candidates kept before they are cut to the best.
CELLS, KEPT = 2_000_000, 400_000
#: Characters of documents that a worker holds as counts before it passes them on.
CHARS = 16_000_000

#: What each byte of a text becomes: delimiters a space, A-Z lower case.
FORM = bytes(c if c >= 0x80 or chr(c).isalnum() and not chr(c).isupper() else ord(chr(c).lower()) if chr(c).isalnum() else 32
             for c in range(256))


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, times: the terms of each item with their repeats."""
    found = F.regexp_extract_all(F.col("text").cast("string"), F.lit(TERM_RE), F.lit(0))
    return (items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(found).alias("term"))
            .withColumn("term", F.translate("term", UPPER, LOWER))
            .groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times")))


def formed(text: bytes) -> bytes:
    """The text with a guard at both ends, every delimiter a space, A-Z lower-cased."""
    return b" " + text.translate(FORM) + b" "


def term_count(text: bytes) -> int:
    """Terms of a formed text: a term begins after a space."""
    word = np.frombuffer(text, np.uint8) != 32
    return int(np.count_nonzero(word[1:] & ~word[:-1]))


def automaton(terms: list[str]):
    """Outputs are places in ``terms``; bytes are looked at as characters."""
    import ahocorasick
    found = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        found.add_word(f" {t.encode().decode('latin-1')} ", i)
    if terms:
        found.make_automaton()
    return found


def _scan(terms):
    """(doc_id, text) to doc_id, n, the terms found and how often."""
    names = ["doc_id", "n", "terms", "tfs"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, rows, size = automaton(terms.value), [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text").cast(pa.binary())):
                raw = formed(text.as_py())
                n = term_count(raw)
                if not n:
                    continue
                hits = np.fromiter(map(itemgetter(1), machine.iter(raw.decode("latin-1"))), np.int32) if len(machine) else np.empty(0, np.int32)
                found, tf = np.unique(hits, return_counts=True)
                rows.append((doc_id.as_py(), n, found, tf))
                size += len(raw)
                if size > CHARS:
                    yield out()
                    rows, size = [], 0
        yield out()
    return run


class Best:
    """The ``k`` highest scores of each item so far, ties to the smaller id, null ids last."""

    def __init__(self, k: int, items: int):
        self.k, self.least, self.size = k, np.zeros(items, np.int64), 0
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, ids: np.ndarray, no_id: np.ndarray, scores: np.ndarray) -> None:
        doc, item = np.nonzero((scores > 0) & (scores >= self.least[None, :]))
        self.parts.append((item, scores[doc, item], no_id[doc], ids[doc]))
        self.size += len(item)
        if self.size > KEPT:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        item, score, no_id, ids = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else (np.empty(0, np.int64),) * 4
        order = np.lexsort((ids, no_id, -score, item))
        item, score, no_id, ids = (x[order] for x in (item, score, no_id, ids))
        first = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1]))) if len(item) else np.empty(0, np.int64)
        sizes = np.diff(np.append(first, len(item)))
        place = np.arange(len(item)) - np.repeat(first, sizes)
        full = sizes >= self.k
        self.least[item[first[full]]] = score[first[full] + self.k - 1]
        top = place < self.k
        self.parts = [tuple(x[top] for x in (item, score, no_id, ids))]
        self.size = len(self.parts[0][0])
        return self.parts[0]


def _rank(sent, k: int):
    """Counts of documents to the task's best rows of each item."""
    names = ["item", "doc_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, first, item_of, times, items, total_n, total_l = sent.value
        per_term = np.diff(first)
        # floats are exact below 2^53; an item's score is below its repeats x weights x 10^6
        most = np.bincount(item_of, weights=times * np.repeat(weight, per_term).astype(np.float64), minlength=items).max(initial=0) * 1e6
        best = Best(k, items)
        for batch in batches:
            step = max(1, CELLS // max(1, items))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids = part.column("doc_id")
                n = part.column("n").to_numpy()
                sizes = np.diff(part.column("terms").offsets.to_numpy())
                term = part.column("terms").flatten().to_numpy()
                tf = part.column("tfs").flatten().to_numpy()
                doc = np.repeat(np.arange(len(n)), sizes)
                m = 100 - 25 + (25 * n * total_n) // total_l
                gain = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
                wide = per_term[term]
                entry = np.repeat(first[term], wide) + np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
                cell = np.repeat(doc, wide) * items + item_of[entry]
                add = np.repeat(gain, wide) * times[entry]
                if most < 2**53:
                    scores = np.bincount(cell, weights=add, minlength=len(n) * items).astype(np.int64)
                else:
                    scores = np.zeros(len(n) * items, np.int64)
                    np.add.at(scores, cell, add)
                best.add(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), scores.reshape(len(n), items))
        item, score, no_id, ids = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids, pa.int64(), mask=no_id.astype(bool)),
                                          pa.array(score, pa.int64())], names)
    return run


def _part(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """The best documents of the items of one bounded part."""
    spark = docs.sparkSession
    rows = wanted.select("item_id", "term", "times").toPandas()
    terms, term_of = np.unique(rows["term"].to_numpy(dtype=object), return_inverse=True)
    items = sorted({(i is None or i != i, 0 if i is None or i != i else int(i)) for i in rows["item_id"].tolist()})
    number = {x: i for i, x in enumerate(items)}
    item_of = np.array([number[(i is None or i != i, 0 if i is None or i != i else int(i))] for i in rows["item_id"].tolist()], np.int64)
    order = np.argsort(term_of, kind="stable")
    first = np.concatenate(([0], np.cumsum(np.bincount(term_of, minlength=len(terms))))).astype(np.int64)
    named = spark.sparkContext.broadcast(list(terms))
    counts = written(docs.mapInArrow(_scan(named), "doc_id long, n long, terms array<int>, tfs array<long>"), "term-counts")
    total = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = np.zeros(len(terms), np.int64)
    held = counts.select(F.explode("terms").alias("t")).groupBy("t").count().toPandas()
    df[held["t"].to_numpy(np.int64)] = held["count"]
    weight = np.array([math.floor(1000 * math.log((2 * total[0] + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    sent = spark.sparkContext.broadcast((weight, first, item_of[order], rows["times"].to_numpy(np.int64)[order], len(items), total[0], total[1]))
    found = counts.mapInArrow(_rank(sent, k), "item int, doc_id long, score long")
    place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(n, None if none else i) for n, (none, i) in enumerate(items)], "item int, item_id long")
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the ``k`` documents of the highest
    scores above 0 for each item, equal scores by ascending id."""
    wanted = written(item_terms(items), "item-terms")
    parts = -(-wanted.count() // MOST_TERMS)
    if not parts:
        return wanted.select("item_id", F.lit(1).alias("rank"), F.col("item_id").alias("doc_id"), F.col("times").alias("score"))
    rows = texts(docs)
    split = wanted.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)))
    found = [_part(rows, split.where(F.col("part") == p), k) for p in range(parts)]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out

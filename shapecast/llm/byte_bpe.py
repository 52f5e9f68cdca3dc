"""Byte-level BPE by Spark's higher-order functions.

The rank file becomes a literal in the plan: buckets of pairs of adjacent pieces,
(id, id) -> id of both joined. ``merged`` folds the ranked merges over the ids of
a word's bytes: the state holds the pieces' ids and the rank of every adjacent
pair; a step joins the leftmost pair of least rank and looks up only the two
pairs that are new. A whole word that has a rank is taken as it is.

A text is split into words by the tokenizer's pattern. Distinct words are
folded: frequent ones (``HEAD_WORDS`` at most, ``HEAD_BYTES`` long at most, so
the table sent to the workers has a fixed bound) for the whole corpus, all
others in the block of documents where they occur. Which words are frequent is
counted on ``HEAD_DOCS`` documents about; it only decides where a word is
folded. Blocks pass on the ids of their texts with marks for the other words,
so no text is shuffled. Decoding concatenates the binary pieces of the ids.

Defined cases: a null text is empty and has no tokens; repeated rows are
encoded each; very long texts and words are encoded whole; an empty table gives
no rows; extra columns are ignored. Ids that are no rank raise in ``decode``.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import texts, written

#: Buckets of the pairs (a prime), bits of a byte's place in a word, a first id's factor in a pair.
BUCKETS, PLACE_BITS, ID = 65521, 31, 1 << 24
PLACE = 1 << PLACE_BITS
HEAD_WORDS = 300_000
HEAD_BYTES = 32
#: Documents of a block: by number and by characters.
BLOCK_DOCS, BLOCK_CHARS = 512, 1_000_000
#: Documents on which words are counted for the head.
HEAD_DOCS = 40_000
#: Chunks of text whose ids a worker remembers.
CACHE = 200_000
#: Ids from here on stand for the words a block folds itself.
MARK = 1 << 31
#: Chunks whose letters are plain, and the pattern's words in them.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch
PLAIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+").findall
#: Distinct words a task holds before it passes their counts on.
COUNT_FLUSH = 200_000
NONE = 1 << 31
RESULT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                    ("decoded_sha256", pa.string())])


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def byte_ids(ranks: dict[bytes, int]) -> np.ndarray:
    """The id of each byte."""
    return np.array([ranks[bytes([b])] for b in range(256)], "<i4")


def pair_literal(ranks: dict[bytes, int]) -> Column:
    """The rank map by pairs of adjacent pieces, (id, id) -> id of both joined, as
    a column that the optimizer folds into one literal."""
    buckets: list[dict] = [{"k": [], "v": []} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if a is not None and b is not None:
                pair = a * ID + b
                buckets[pair % BUCKETS]["k"].append(pair)
                buckets[pair % BUCKETS]["v"].append(rank)
    return F.from_json(F.lit(json.dumps(buckets)), "array<struct<k:array<bigint>,v:array<bigint>>>")


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def merged(start: Column, literal: Column) -> Column:
    """Ids (array<int>) of one word given as the ids of its bytes, two at least. The
    state holds the pieces' ids between two marks, and for each adjacent pair its
    rank and place in one number, so the least one is the leftmost of least rank."""
    def fold(table: Column) -> Column:
        def key(a: Column, b: Column, place: Column) -> Column:
            pair = a * ID + b
            bucket = F.get(table, F.pmod(pair, F.lit(BUCKETS)).cast("int"))
            rank = F.get(bucket["v"], (F.array_position(bucket["k"], pair) - 1).cast("int"))
            return F.coalesce(rank, F.lit(NONE)) * PLACE + place

        ids = F.concat(F.array(F.lit(-1).cast("bigint")), F.transform(start, lambda x: x.cast("bigint")), F.array(F.lit(-1).cast("bigint")))
        first = _let(ids, lambda p: F.struct(p.alias("p"), F.transform(
            F.slice(p, 1, F.size(p) - 1), lambda x, i: key(x, F.get(p, i + 1), i.cast("bigint"))).alias("r")))

        def step(s: Column, _: Column) -> Column:
            def join(m: Column) -> Column:
                p, r, least, i = m["p"], m["r"], m["least"], m["i"]
                new, n = F.shiftright(least, PLACE_BITS), F.size(m["r"]) + 2
                left = F.get(r, i - 2).bitwiseAND(F.lit(PLACE - 1))       # the place of the pair before
                return F.struct(
                    F.concat(F.slice(p, 1, i - 1), F.array(new), F.slice(p, i + 2, n)).alias("p"),
                    F.concat(F.slice(r, 1, i - 2), F.array(key(F.get(p, i - 2), new, left), key(
                        new, F.get(p, i + 1), least.bitwiseAND(F.lit(PLACE - 1)))), F.slice(r, i + 2, n)).alias("r"))

            least = _let(F.array_min(s["r"]), lambda v: F.when(v < F.lit(NONE * PLACE), F.struct(
                s["p"].alias("p"), s["r"].alias("r"), v.alias("least"), F.array_position(s["r"], v).cast("int").alias("i"))))
            return _let(least, lambda m: F.when(m.isNull(), s).otherwise(join(m)))

        return F.aggregate(F.sequence(F.lit(2), F.size(start)), first, step,
                           lambda s: F.transform(F.slice(s["p"], 2, F.size(s["p"]) - 2), lambda x: x.cast("int")))

    return _let(F.struct(literal.alias("t")), lambda t: fold(t["t"]))


class Splitter:
    """Words of a text by the pattern. A text is first cut at single spaces (no
    word crosses from a non-space to a space), so that the pattern runs once for
    each distinct chunk; texts with longer white space around spaces run whole."""

    def __init__(self, pattern: str):
        import public_tokenizers
        import regex
        self.find = regex.compile(pattern).findall
        self.plain = pattern == public_tokenizers.PATTERN
        self.unsafe = regex.compile(r"\s | \s").search

    def chunks(self, text: str) -> tuple[list[str], list[str]]:
        """(words at the start or of an unsafe text, chunks that follow a space each)."""
        if not text:
            return [], []
        if self.unsafe(text):
            return self.find(text), []
        first, *rest = text.split(" ")
        return self.find(first), rest

    def words(self, chunk: str) -> list[bytes]:
        find = PLAIN_WORDS if self.plain and PLAIN(chunk) else self.find
        return [w.encode() for w in find(" " + chunk)]


def word_counts(docs: DataFrame, pattern: str) -> DataFrame:
    """(word binary, n): every word of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(pattern)
        chunks: Counter = Counter()
        heads: Counter = Counter()

        def flush():
            count: Counter = Counter()
            for w, n in heads.items():
                count[w.encode()] += n
            for c, n in chunks.items():
                for w in split.words(c):
                    count[w] += n
            chunks.clear()
            heads.clear()
            return pa.record_batch([pa.array(count.keys(), pa.binary()), pa.array(count.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                first, rest = split.chunks(text)
                heads.update(first)
                chunks.update(rest)
                if len(chunks) + len(heads) > COUNT_FLUSH:
                    yield flush()
        yield flush()

    return (texts(docs).select("text").mapInArrow(run, "word binary, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def head_words(counts: DataFrame, most: int = HEAD_WORDS) -> DataFrame:
    """The most frequent words, ``most`` at most: all that occur more often than a bound."""
    short = counts.where(F.octet_length("word") <= HEAD_BYTES)
    steps = short.groupBy(F.least("n", F.lit(100_000)).alias("n")).count().orderBy(F.desc("n")).collect()
    total, least = 0, None
    for r in steps:
        total += r["count"]
        if total > most:
            break
        least = r["n"]
    return short.where(F.lit(False)) if least is None else short.where(F.col("n") >= least)


_KNOWN: dict[str, tuple[dict, dict]] = {}


def _memory(key: str, head) -> tuple[dict, dict]:
    """A worker's words and chunks, kept between its tasks of one run."""
    if key not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[key] = (head.value, {})
    return _KNOWN[key]


def decode(ids: np.ndarray, pieces: list[bytes]) -> bytes:
    return b"".join(map(pieces.__getitem__, ids.tolist()))


def _start(words: list[bytes], bytes_to_ids: np.ndarray) -> pa.Array:
    """The ids of the bytes of each word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = bytes_to_ids[np.frombuffer(b"".join(words), np.uint8)]
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat, pa.int32()))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Blocks of documents: doc_ids, marked (their ids, words that the block folds
    as ``MARK`` and up) and folded (the ids of those words)."""
    spark: SparkSession = docs.sparkSession
    literal, bytes_to_ids = pair_literal(ranks), byte_ids(ranks)
    slices = max(1, docs.count() // HEAD_DOCS)
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(slices)) == 0)
    head = head_words(written(word_counts(some, pattern), "words")).repartition(spark.sparkContext.defaultParallelism)
    whole = spark.sparkContext.broadcast(ranks)

    def unranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w for w in batch.column("word").to_pylist() if w not in whole.value]
            yield pa.record_batch([pa.array(words, pa.binary()), _start(words, bytes_to_ids)], ["word", "start"])

    got = (head.select("word").mapInArrow(unranked, "word binary, start array<int>")
           .select("word", merged(F.col("start"), literal).alias("ids")).toArrow())
    table = {w: r.to_bytes(4, "little") for w, r in ranks.items()}
    table |= {w: np.array(i, "<u4").tobytes() for w, i in zip(got["word"].to_pylist(), got["ids"].to_pylist())}
    sent, key = spark.sparkContext.broadcast(table), uuid.uuid4().hex

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(pattern)
        words, chunks = _memory(key, sent)

        def block(ids, some):
            cut = [split.chunks(t) for t in some]
            rare: dict[bytes, bytes] = {}
            mine: dict[str, bytes] = {}

            def word(w):
                if w in words:
                    return words[w]
                if w not in rare:
                    rare[w] = (MARK + len(rare)).to_bytes(4, "little")
                return rare[w]

            for c in set().union(*(rest for _, rest in cut)).difference(chunks):
                own, before = split.words(c), len(rare)
                mine[c] = b"".join(map(word, own))
                if len(chunks) < CACHE and len(rare) == before and not any(w in rare for w in own):
                    chunks[c] = mine[c]
            out = [b"".join([word(w.encode()) for w in first]) + b"".join([chunks[c] if c in chunks else mine[c] for c in rest])
                   for first, rest in cut]
            return pa.record_batch([pa.array([ids], pa.list_(pa.int64())), pa.array([out], pa.list_(pa.binary())),
                                    pa.ListArray.from_arrays(pa.array([0, len(rare)], pa.int32()), _start(list(rare), bytes_to_ids))],
                                   ["doc_ids", "marked", "rare"])

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_DOCS):
                part = batch.slice(at, BLOCK_DOCS)
                ids, some, size = [], [], 0
                for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    if some and size + len(t) > BLOCK_CHARS:
                        yield block(ids, some)
                        ids, some, size = [], [], 0
                    ids.append(i)
                    some.append(t)
                    size += len(t)
                yield block(ids, some)

    dealt = texts(docs).mapInArrow(blocks, "doc_ids array<long>, marked array<binary>, rare array<array<int>>")
    return dealt.select("doc_ids", "marked", F.transform("rare", lambda w: merged(w, literal)).alias("folded"))


def _ids_of(batch: pa.RecordBatch) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of the blocks' documents, the marks replaced by the words' ids."""
    for ids, marked, folded in zip(*(batch.column(c) for c in ("doc_ids", "marked", "folded"))):
        sizes = np.array([len(x) for x in folded.values], np.int64) if len(folded) else np.empty(0, np.int64)
        flat = folded.values.flatten().to_numpy(zero_copy_only=False).astype("<u4") if len(folded) else np.empty(0, "<u4")
        first = np.cumsum(sizes) - sizes
        for i, raw in zip(ids.as_py(), marked.as_py()):
            out = np.frombuffer(raw, "<u4")
            at = np.flatnonzero(out >= MARK)
            if len(at):
                word = (out[at] - MARK).astype(np.int64)
                n = np.ones(len(out), np.int64)
                n[at] = sizes[word]
                whole = np.repeat(out, n)
                places = (np.cumsum(n) - n)[at]
                inside = np.arange(n[at].sum()) - np.repeat(np.cumsum(n[at]) - n[at], n[at])
                whole[np.repeat(places, n[at]) + inside] = flat[np.repeat(first[word], n[at]) + inside]
                out = whole
            yield i, out


def digests(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Per document: token count, SHA-256 of its ids and of the bytes they decode to."""
    pieces = [b""] * (max(ranks.values()) + 1)
    for p, r in ranks.items():
        pieces[r] = p
    table = encoded.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = table.value
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            rows = [(i, len(ids), sha(ids.tobytes()), sha(decode(ids, piece))) for i, ids in _ids_of(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), RESULT.types)], schema=RESULT) if rows \
                else pa.RecordBatch.from_pylist([], schema=RESULT)

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_ids(encoded: DataFrame) -> DataFrame:
    """Per document its ids: doc_id, ids array<int>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_ids_of(batch))
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()),
                                   pa.array([r[1].astype(np.int32) for r in rows], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return encoded.mapInArrow(run, "doc_id long, ids array<int>")

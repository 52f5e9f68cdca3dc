"""Best-fit packing with Martello-Toth dominance reduction.

Documents become token ids (a public vocabulary, end id appended); only longer
ones are cut, into pieces of ``capacity`` tokens. Pieces of one length are
interchangeable, so the packing problem is the histogram of lengths: at most
``capacity`` numbers however many documents there are. On that histogram small
sets are first fixed for good where no other filling of their sequence can be
better (a piece that nothing fits beside; a pair that fills the sequence; the
largest partner where no two others fit; a pair whose members are each at least
as large as in any other feasible pair where no three fit). The instance
shrinks with every set fixed, and best fit, largest first, packs the rest. The
outcome is a list of slots (length, range of ranks, first sequence, offset)
whose size is bounded by the number of lengths, not of pieces; the pieces find
their place by their rank among those of their length, which Spark counts in
two levels so that one very common length is no hot group.

Defined cases: a null or empty text is the end id alone; rows with equal ids
and texts are separate documents and get places of their own; an empty table
gives no rows; very long texts are cut; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, texts, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
CUT = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PLACED = PIECES + ", sequence_id long, offset long"
#: Words, and chunks of a text (between white space), whose ids a worker remembers.
CACHE, CHUNKS = 500_000, 300_000
#: Longer chunks are encoded each time.
CACHE_BYTES = 64
#: Parts into which the pieces of one length are dealt to be numbered.
RANK_PARTS = 256


#: Chunks in which letters are plain: their words are told apart and lower-cased here.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch
PLAIN_ASCII = re.compile(b"[!-~]+").fullmatch
#: The vocabulary's own pattern, for lower-cased plain chunks.
PLAIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+").findall
ASCII_WORDS = re.compile(b"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\\sa-z0-9]+").findall


class ChunkEncoder:
    """Ids of a text as little-endian unsigned 32-bit bytes. The vocabulary never
    joins across white space, so a text is encoded chunk by chunk, and a plain
    chunk word by word; each distinct one is encoded once. The memory for chunks
    and words is bounded: chunks stop being added, words start anew when full."""

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(vocabulary)
        self.known: dict[bytes, bytes] = {}
        self.words: dict[bytes, bytes] = {}
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _ids(self, some: list[str]) -> list[list[int]]:
        """Ids only: no places of the tokens in the text are kept."""
        return [e.ids for e in self.tok.encode_batch_fast(some, add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> None:
        """Words are encoded many in a text: each one's last id is marked as such."""
        for at in range(0, len(new), 5000):
            some = new[at:at + 5000]
            ids = np.array(self._ids([b" ".join(some).decode()])[0], "<u4")
            last = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(last) != len(some):
                raise ValueError("the vocabulary does not mark the ends of words")
            raw = ids.tobytes()
            self.words.update((w, raw[a:b]) for w, a, b in zip(some, [0, *last], last))

    def __call__(self, chunks_of: list[list[bytes]]) -> list[bytes]:
        known, words = self.known, self.words
        if len(words) > CACHE:
            words.clear()
        mine: dict[bytes, bytes] = {}
        parts, odd = {}, []
        distinct = set().union(*chunks_of)
        new = distinct.difference(known)
        single: dict[bytes, bytes] = {}
        for c in new:
            if c.isalpha():                     # of bytes: ASCII letters
                single[c] = c.lower()
            elif c.isascii() and b"<|" not in c and PLAIN_ASCII(c):
                parts[c] = ASCII_WORDS(c.lower())
            elif "<|" not in (text := c.decode()) and PLAIN(text):
                parts[c] = [w.encode() for w in PLAIN_WORDS(text.lower())]
            else:
                odd.append(c)
        self._learn(list(set(single.values()).union(*parts.values()).difference(words)))
        for c, ids in zip(odd, self._ids([c.decode() for c in odd])):
            mine[c] = np.array(ids, "<u4").tobytes()
        mine.update(zip(single, map(words.__getitem__, single.values())))
        for c, p in parts.items():
            mine[c] = words[p[0]] if len(p) == 1 else b"".join([words[w] for w in p])
        here = mine | {c: known[c] for c in distinct.difference(new)}      # small: its entries stay near
        room = CHUNKS - len(known)
        if room > 0:
            known.update((c, x) for c, x in itertools.islice(mine.items(), room) if len(c) <= CACHE_BYTES)
        return [b"".join(map(here.__getitem__, c)) for c in chunks_of]


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(vocabulary: str) -> ChunkEncoder:
    """A worker's encoder, kept between its tasks."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = ChunkEncoder(vocabulary)
    return _ENCODERS[vocabulary]


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int = 1) -> DataFrame:
    """One row per piece of every document: its place in it, length and checksum."""
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            ids_of = batch.column("doc_id").to_pylist()
            for at in range(0, len(raw), 1000):
                out = []
                for doc, ids in zip(ids_of[at:at + 1000], encode([r.split() for r in raw[at:at + 1000]])):
                    ids += end
                    for k, b in enumerate(range(0, len(ids), step)):
                        piece = ids[b:b + step]
                        out.append((doc, k, b // 4, len(piece) // 4, zlib.crc32(piece)))
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), CUT)], schema=CUT)

    return texts(docs).mapInArrow(run, PIECES)


def _reduce(count: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fixes dominating sets, lowering ``count`` (by length) in place."""
    fixed = []

    def largest(most: int, without: tuple[int, ...]) -> int:
        """The largest length up to ``most`` of which a piece is left beside those named."""
        x = most
        while x > 0:
            left = np.flatnonzero(count[1:x + 1])
            if not len(left):
                return 0
            x = int(left[-1]) + 1
            if count[x] > without.count(x):
                return x
            x -= 1
        return 0

    def smallest(k: int, without: int) -> list[int]:
        out: list[int] = []
        for x in np.flatnonzero(count):
            n = int(count[x]) - (x == without)
            out += [int(x)] * min(max(n, 0), k - len(out))
            if len(out) >= k:
                break
        return out

    def times(members: tuple[int, ...]) -> int:
        return min(int(count[x]) // members.count(x) for x in set(members))

    for size in range(capacity, 0, -1):
        while count[size]:
            rest = capacity - size
            p = largest(rest, (size,))
            least = smallest(3, size)
            if not p:
                members = (size,)
            elif p == rest or len(least) < 2 or least[0] + least[1] > rest:
                members = (size, p)
            elif len(least) < 3 or sum(least) > rest:
                q = largest(rest - p, (size, p))
                half = largest(rest // 2, (size,))      # no pair has a larger lesser member
                if not q or q < half:
                    break
                members = (size, p, q)
            else:
                break
            m = times(members)      # taking pieces away only raises the smallest: it stays dominating
            for x in members:
                count[x] -= m
            fixed.append((members, m))
    return fixed


def _best_fit(count: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, largest first, on groups of sequences that are filled alike."""
    open_: list[list] = [[] for _ in range(capacity + 1)]   # by free space
    room = np.zeros(capacity + 1, bool)

    def put(free: int, members: tuple[int, ...], n: int) -> None:
        if n:
            open_[free].append((members, n))
            room[free] = True

    for size in range(capacity, 0, -1):
        n = int(count[size])
        while n:
            fits = np.flatnonzero(room[size:])
            free = size + int(fits[0]) if len(fits) else capacity
            members, groups = open_[free].pop() if len(fits) else ((), n)
            if len(fits) and not open_[free]:
                room[free] = False
            each = free // size
            full = min(groups, n // each)
            put(free - each * size, members + (size,) * each, full)
            n -= full * each
            if full < groups:
                part = min(n, each) if n < each else 0
                if part:
                    put(free - part * size, members + (size,) * part, 1)
                    n -= part
                    full += 1
                if len(fits):
                    put(free, members, groups - full)
    return [g for groups in open_ for g in groups]


def plan_sequences(histogram: dict[int, int], capacity: int) -> pd.DataFrame:
    """Slots: pieces of ``length`` with ranks from ``low`` to below ``high`` (among
    those of that length) go to sequence ``first`` + rank - low, at ``offset``."""
    count = np.zeros(capacity + 1, np.int64)
    for k, v in histogram.items():
        count[k] = v
    groups = _reduce(count, capacity) + _best_fit(count, capacity)
    used: dict[int, int] = {}
    slots, first = [], 0
    for members, n in groups:
        offset = 0
        for x in members:
            low = used.get(x, 0)
            slots.append((x, low, low + n, first, offset))
            used[x] = low + n
            offset += x
        first += n
    if used != {k: v for k, v in histogram.items() if v}:
        raise AssertionError("the plan does not hold every piece")
    return pd.DataFrame(slots, columns=["length", "low", "high", "first", "offset"])


def place(pieces: DataFrame, slots: pd.DataFrame) -> DataFrame:
    """Every piece with its sequence and offset. ``pieces`` must be a written table."""
    part = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_PARTS)).alias("part")
    dealt = pieces.select("*", part)
    before = (dealt.groupBy("length", "part").count()
              .withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count"))
              .drop("count"))
    inside = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("inside", inside).join(before, ["length", "part"])
    slots = slots.sort_values(["length", "low"])
    key = (slots["length"].to_numpy(np.int64) << 48) + slots["low"].to_numpy(np.int64)
    base = (slots["first"] - slots["low"]).to_numpy(np.int64)
    offsets = slots["offset"].to_numpy(np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rank = batch.pop("rank").to_numpy(np.int64)
            at = np.searchsorted(key, (batch["length"].to_numpy(np.int64) << 48) + rank, side="right") - 1
            yield batch.assign(doc_id=batch["doc_id"].astype("Int64"), sequence_id=base[at] + rank, offset=offsets[at])

    return (ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("inside") + F.col("before")).alias("rank"))
            .mapInPandas(run, PLACED))


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    with small_batches(docs.sparkSession):
        pieces = written(cut_pieces(docs, vocabulary, capacity, end_id), "pieces")
    # at most ``capacity`` rows, whatever the input
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    return place(pieces, plan_sequences(histogram, capacity))

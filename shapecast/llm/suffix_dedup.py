"""Removal of repeated substrings, decided by suffix arrays of linear grouping construction.

Every string of ``LENGTH`` bytes (a window) has an anchor: the leftmost of its
least-hashed grams of ``GRAM`` bytes. Equal windows have equal anchors at equal
offsets, so windows meet by the hash of their anchor, and a third of the corpus
in copies meets at as many anchors. The windows of one anchor's place are a
segment; a segment whose whole content starts earlier elsewhere is covered, and
copies are combined before the shuffle. What differs around an anchor that
occurs in several segments is decided on the bytes: the segments' contexts, the
anchor being one symbol, form a string whose suffix array (``lyndon_suffixes``)
brings equal windows together; all but the earliest of them are covered.
Contexts that no other can match over a window's length are left out before,
and bytes that match no other context are trimmed, which changes no window.

Earlier means: a smaller doc_id, or the same document and an earlier start.
Defined cases: a null text is empty; a null id is smaller than all others; rows
that repeat an id and a text are one document and get equal results; rows that
repeat an id with other texts are ordered by a 64-bit hash of the text; texts
under ``LENGTH`` bytes lose nothing; an empty table gives no rows; very long
texts are taken whole, in overlapping parts; extra columns are ignored.
Segments are equal when their 64-bit hashes are, without a look at the bytes: a
collision could cover bytes wrongly, with a chance of about 3e-2 in 1e9 different
segments and 3e-8 in 1e6. Contexts around an anchor are compared by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts, written
from .hashing import Ranges
from .lyndon_suffixes import suffix_arrays

LENGTH, GRAM = 100, 40
REACH = LENGTH - GRAM            # bytes of a window beside its anchor
PART = 1 << 22                   # starts of a text that are handled at once
#: Text that a task combines before the shuffle.
COMBINE = 8 << 20
#: Bytes of text for each task that sorts anchors: their segments are about twice as
#: many bytes, and a worker holds them in several copies.
TASK_TEXT = 8 << 20
#: Rows whose texts and spans are Python objects at once.
ROWS = 500
NO_ID = -(2**63)
#: A string of the suffix arrays: 0 ends it, 1 is between contexts, 2 an anchor, bytes follow.
END, GAP, ANCHOR, BYTE = 0, 1, 2, 3
#: Symbols that are ordered at once.
LOCKSTEP = 2_000_000


def _place(text: Column) -> Column:
    return F.xxhash64(text)


def _several(docs: DataFrame) -> DataFrame:
    """doc of the ids (null: NO_ID) that stand for more than one text: only their
    rows are told apart by the hash of the text."""
    rows = texts(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), _place(F.col("text")).alias("h"))
    found = rows.groupBy("doc").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b")
    return written(found.select("doc", F.lit(True).alias("several")), "several")


def _documents(docs: DataFrame, several: DataFrame) -> DataFrame:
    """doc (the id, or NO_ID), tag (64 bits of a hash of the text where the id has
    several texts, else 0), text."""
    rows = texts(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "text")
    return rows.join(several, "doc", "left").select(
        "doc", F.when(F.col("several"), _place(F.col("text"))).otherwise(F.lit(0).cast("long")).alias("tag"), "text")


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum over every ``width`` neighbours."""
    out, done = keys, 1
    while 2 * done <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    if done < width:
        out = np.minimum(out[:len(out) - (width - done)], out[width - done:])
    return out


def segments(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """anchor hash, segment hash, first start, windows, anchor's offset, of a text's segments."""
    found = []
    for at in range(0, len(data) - LENGTH + 1, PART):
        part = data[at:at + PART + LENGTH - 1]
        hashes = Ranges(part)
        grams = hashes.every(GRAM)
        keys = (grams & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=np.uint64)
        anchor = (_least(keys, REACH + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        n = np.diff(np.append(first, len(anchor)))
        place = anchor[first]
        found.append((grams[place], hashes(first, first + n - 1 + LENGTH), first + at, n, place - first))
    if not found:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))


def _pack(start, n, offset) -> np.ndarray:
    return (start << 12) | ((n - 1) << 6) | offset


def _unpack(pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """First start, windows, anchor's offset."""
    return pos >> 12, ((pos >> 6) & 63) + 1, pos & 63


ROW = ["anchor", "segment", "doc", "tag", "pos"]
SCHEMA = "anchor long, segment long, doc long, tag long, pos long"
SPAN = "doc long, tag long, start long, stop long"


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of the documents; of equal ones in a task's part only the earliest
    goes on, the others are spans already (segment 0, their place in anchor and pos)."""
    held: list[tuple] = []
    size = 0

    def combine():
        held.sort(key=lambda x: (x[0], x[1]))
        parts = [segments(np.frombuffer(raw, np.uint8)) for _, _, raw in held]
        n = [len(p[0]) for p in parts]
        anchor, segment, start, windows, offset = (np.concatenate([p[i] for p in parts]) for i in range(5))
        doc, tag = (np.repeat(np.array([h[i] for h in held], np.int64), n) for i in (0, 1))
        pos = _pack(start, windows, offset)
        anchor, segment = anchor.view(np.int64), (segment | np.uint64(1)).view(np.int64)
        _, first, same = np.unique(segment, return_index=True, return_inverse=True)
        # equal rows (a repeated document) are the same place
        keep = (first[same] == np.arange(len(segment)))
        again = ~keep & ~((doc == doc[first[same]]) & (tag == tag[first[same]]) & (pos == pos[first[same]]))
        out = [np.concatenate([x[keep], x[again]]) for x in (anchor, segment, doc, tag, pos)]
        out[1][keep.sum():] = 0
        out[0][keep.sum():] = out[2][keep.sum():]
        return pa.record_batch([pa.array(x) for x in out], ROW)

    for batch in batches:
        for doc, tag, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "tag", "text"))):
            raw = text.encode("utf-8", "replace")
            if len(raw) >= LENGTH:
                held.append((doc, tag, raw))
                size += len(raw)
            if size >= COMBINE:
                yield combine()
                held, size = [], 0
    if held:
        yield combine()


def _columns(batches: Iterator[pa.RecordBatch], names: list[str]) -> list[np.ndarray]:
    got = [[b.column(c).to_numpy(zero_copy_only=False) for c in names] for b in batches]
    return [np.concatenate([g[i] for g in got]) if got else np.empty(0, np.int64) for i in range(len(names))]


def _first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the anchors dealt to this task: covered segments as (doc, pos, null), and
    the earliest of each segment of an anchor that has several as (doc, pos, anchor)."""
    anchor, segment, doc, tag, pos = _columns(batches, ROW)
    done = segment == 0
    out = [(doc[done], tag[done], pos[done], None)]
    anchor, segment, doc, tag, pos = (x[~done] for x in (anchor, segment, doc, tag, pos))
    by = np.lexsort((_unpack(pos)[0], tag, doc, segment, anchor))
    anchor, segment, doc, tag, pos = (x[by] for x in (anchor, segment, doc, tag, pos))
    new_anchor = np.ones(len(anchor), bool)
    new_anchor[1:] = anchor[1:] != anchor[:-1]
    new = new_anchor.copy()
    new[1:] |= segment[1:] != segment[:-1]
    same = ~new
    same[1:] &= ~((doc[1:] == doc[:-1]) & (tag[1:] == tag[:-1]) & (pos[1:] == pos[:-1]))       # a repeated row is the same place
    # of equal rows that follow the first one as well
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    same &= ~((doc == doc[first]) & (tag == tag[first]) & (pos == pos[first]))
    out.append((doc[same], tag[same], pos[same], None))
    if len(anchor):
        kinds = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_anchor))
        several = new & (np.repeat(kinds, np.diff(np.append(np.flatnonzero(new_anchor), len(anchor)))) > 1)
        out.append((doc[several], tag[several], pos[several], anchor[several]))
    for d, t, p, a in out:
        if len(d):
            yield pa.record_batch([pa.array(d), pa.array(t), pa.array(p), pa.array(a) if a is not None else pa.nulls(len(d), pa.int64())],
                                  ["doc", "tag", "pos", "anchor"])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes to the left and right of the anchors asked for, of each document."""
    for batch in _slices(batches):
        for doc, tag, text, asked in zip(*(batch.column(c).to_pylist() for c in ("doc", "tag", "text", "asked"))):
            raw = text.encode("utf-8", "replace")
            pos = np.array(sorted({a["pos"] for a in asked}), np.int64)
            start, n, offset = _unpack(pos)
            anchors = {a["pos"]: a["anchor"] for a in asked}
            left = [raw[s:s + o] for s, o in zip(start.tolist(), offset.tolist())]
            right = [raw[s + o + GRAM:s + k - 1 + LENGTH] for s, k, o in zip(start.tolist(), n.tolist(), offset.tolist())]
            yield pa.record_batch([pa.array([anchors[p] for p in pos.tolist()], pa.int64()), pa.array([doc] * len(pos), pa.int64()),
                                   pa.array([tag] * len(pos), pa.int64()), pa.array(pos), pa.array(left, pa.binary()), pa.array(right, pa.binary())],
                                  ["anchor", "doc", "tag", "pos", "left", "right"])


def _common(group: np.ndarray, sides: list[bytes]) -> np.ndarray:
    """Longest prefix that each string shares with another one of its group."""
    n = len(sides)
    width = 64
    flat = np.zeros((n, width), np.uint8)
    size = np.array([len(s) for s in sides], np.int64)
    for i, s in enumerate(sides):
        flat[i, :len(s)] = np.frombuffer(s, np.uint8)
    words = flat.view(">u8").astype(np.uint64)
    by = np.lexsort((size, *(words[:, i] for i in reversed(range(width // 8))), group))
    rows, ordered, g = flat[by], size[by], group[by]
    equal = (rows[1:] == rows[:-1])
    shared = np.where(equal.all(1), width, equal.argmin(1))
    shared = np.where(g[1:] == g[:-1], np.minimum(shared, np.minimum(ordered[1:], ordered[:-1])), -1)
    best = np.full(n, -1, np.int64)
    best[by[1:]] = shared
    best[by[:-1]] = np.maximum(best[by[:-1]], shared)
    return best


def repeated_windows(anchor: np.ndarray, rank: np.ndarray, left: list[bytes], right: list[bytes]) -> list[tuple[int, int, int]]:
    """(context, least offset, largest offset) of covered windows: those that a
    context of a smaller rank with the same anchor holds as well. ``left`` and
    ``right`` are the bytes beside the anchor, REACH at most."""
    a = _common(anchor, [s[::-1] for s in left])
    b = _common(anchor, right)
    use = np.flatnonzero((a >= 0) & (b >= 0) & (a + b >= REACH))
    spans: list[tuple[int, int, int]] = []
    # equal contexts: the one of the least rank stands for all, the others are covered
    named: dict[tuple, int] = {}
    for i in use[np.argsort(rank[use], kind="stable")].tolist():
        key = (int(anchor[i]), left[i][len(left[i]) - a[i]:], right[i][:b[i]])
        if key in named:
            spans.append((i, REACH - int(b[i]), int(a[i])))
        else:
            named[key] = i
    kept = np.array(sorted(named.values(), key=lambda i: (anchor[i], rank[i])), np.int64)
    kinds = anchor[kept]
    edges = np.flatnonzero(np.concatenate(([True], kinds[1:] != kinds[:-1]))) if len(kept) else np.empty(0, np.int64)
    ends = np.append(edges[1:], len(kept))
    sizes = np.add.reduceat(a[kept] + b[kept] + 2, edges) + 1 if len(kept) else np.empty(0, np.int64)
    # strings of like length advance together
    order = np.argsort(sizes, kind="stable")
    order = order[ends[order] - edges[order] > 1]
    some: list[int] = []
    total = 0
    for k, g in enumerate(order.tolist()):
        some.append(g)
        total += int(sizes[g])
        if total >= LOCKSTEP or k == len(order) - 1:
            spans += _windows_of([kept[edges[x]:ends[x]] for x in some], a, b, left, right, rank)
            some, total = [], 0
    return spans


def _windows_of(groups, a, b, left, right, rank) -> list[tuple[int, int, int]]:
    pieces, low, high, of, offset = [], [], [], [], []
    at = 0
    for group in groups:
        low.append(at)
        for i in group.tolist():
            text = left[i][len(left[i]) - a[i]:], right[i][:b[i]]
            symbols = np.empty(a[i] + b[i] + 2, np.int64)
            symbols[:a[i]] = np.frombuffer(text[0], np.uint8)
            symbols[a[i] + 1:-1] = np.frombuffer(text[1], np.uint8)
            symbols += BYTE
            symbols[a[i]], symbols[-1] = ANCHOR, GAP
            pieces.append(symbols)
            of.append(np.full(len(symbols), i))
            # the anchor's offset in the window that starts here; -1: no window does
            here = a[i] - np.arange(len(symbols))
            offset.append(np.where(here >= REACH - b[i], here, -1))
            at += len(symbols)
        pieces.append(np.array([END]))
        of.append(np.array([-1]))
        offset.append(np.array([-1]))
        at += 1
        high.append(at)
    symbols, of, offset = (np.concatenate(x) for x in (pieces, of, offset))
    order = suffix_arrays(symbols, np.array(low), np.array(high))
    # equal windows are neighbours: REACH bytes and the anchor's symbol agree
    starts = offset[order] >= 0
    pair = np.flatnonzero(starts[1:] & starts[:-1])
    for k in range(REACH + 1):
        pair = pair[symbols[order[pair] + k] == symbols[order[pair + 1] + k]]
    together = np.zeros(len(order), bool)
    together[pair + 1] = True                                # equal to the window before it
    number = np.cumsum(~together)
    inside = np.zeros(len(order), bool)
    inside[pair] = inside[pair + 1] = True
    places = order[inside]
    if not len(places):
        return []
    kind, context, off = number[inside], of[places], offset[places]
    least = np.full(kind.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, kind, rank[context])
    late = rank[context] > least[kind]
    context, off = context[late], off[late]
    by = np.lexsort((off, context))
    context, off = context[by], off[by]
    if not len(context):
        return []
    new = np.ones(len(context), bool)
    new[1:] = (context[1:] != context[:-1]) | (off[1:] != off[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(context)) - 1
    return list(zip(context[first].tolist(), off[first].tolist(), off[last].tolist()))


def _order_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered spans of the contexts of the anchors dealt to this task."""
    held = list(batches)
    anchor, doc, tag, pos = _columns(held, ["anchor", "doc", "tag", "pos"])
    left, right = ([x for b in held for x in b.column(c).to_pylist()] for c in ("left", "right"))
    if not len(anchor):
        return
    start, n, offset = _unpack(pos)
    by = np.lexsort((start, tag, doc))
    rank = np.empty(len(by), np.int64)
    same = np.zeros(len(by), bool)
    same[1:] = (doc[by][1:] == doc[by][:-1]) & (tag[by][1:] == tag[by][:-1]) & (pos[by][1:] == pos[by][:-1])
    rank[by] = np.cumsum(~same)
    # a window of which the anchor lies at offset o starts at start + offset - o
    spans = repeated_windows(anchor, rank, left, right)
    if spans:
        i, low, high = (np.array(x, np.int64) for x in zip(*spans))
        first = start[i] + offset[i] - high
        yield pa.record_batch([pa.array(doc[i]), pa.array(tag[i]), pa.array(first),
                               pa.array(start[i] + offset[i] - low + LENGTH)], ["doc", "tag", "start", "stop"])


def anchor_tasks(docs: DataFrame) -> int:
    """Tasks to deal the anchors to. Their number follows the text, so that what a
    worker holds at once does not grow with the corpus."""
    size = docs.select(F.sum(F.octet_length(F.col("text").cast("string"))).alias("n")).first()["n"] or 0
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_TEXT))


def covered_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents as doc, tag, text; spans doc, tag, start, stop in bytes, which may
    overlap; the ids with several texts)."""
    several = _several(docs)
    rows, tasks = _documents(docs, several), anchor_tasks(docs)
    dealt = rows.mapInArrow(_segment_rows, SCHEMA).repartition(tasks, "anchor")
    first = written(dealt.mapInArrow(_first_rows, "doc long, tag long, pos long, anchor long"), "segments")
    start = F.shiftright("pos", 12)
    whole = first.where("anchor is null").select("doc", "tag", start.alias("start"), (
        start + F.shiftright("pos", 6).bitwiseAND(F.lit(63)) + LENGTH).alias("stop"))
    asked = (first.where("anchor is not null").select("doc", "tag", F.struct("pos", "anchor").alias("a"))
             .groupBy("doc", "tag").agg(F.collect_list("a").alias("asked")))
    contexts = (rows.join(asked, ["doc", "tag"]).select("doc", "tag", "text", "asked")
                .mapInArrow(_contexts, "anchor long, doc long, tag long, pos long, left binary, right binary").repartition(tasks, "anchor"))
    return rows, whole.unionByName(contexts.mapInArrow(_order_contexts, SPAN)), several


def _merged(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((x["start"], x["stop"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for s, e in spans:
        out.append(raw[at:s])
        at = e
    return b"".join(out) + raw[at:]


def _with_spans(docs: DataFrame) -> DataFrame:
    rows, spans, _ = covered_spans(docs)
    by = spans.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return rows.join(by, ["doc", "tag"], "left")


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the removed runs, of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows = []
            for doc, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "spans"))):
                raw, runs = text.encode("utf-8", "replace"), _merged(spans)
                rows.append((None if doc == NO_ID else doc, len(raw), sum(e - s for s, e in runs), len(runs),
                             hashlib.sha256(_kept(raw, runs)).hexdigest(), [{"start": s, "stop": e} for s, e in runs]))
            run_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            types = [pa.int64()] * 4 + [pa.string(), run_type]
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)],
                                  ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "runs"])

    return _with_spans(docs).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
                                        "runs array<struct<start:long,stop:long>>")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the covered bytes taken out of ``text``; a character that loses
    a byte goes as a whole. All rows and columns stay."""
    columns, (_, spans, several) = docs.columns, covered_spans(docs)
    by = spans.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("_spans"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    several = several.withColumnsRenamed({"doc": "_doc", "several": "_several"})
    keyed = docs.withColumn("_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).join(several, "_doc", "left")
    keyed = keyed.withColumn("_tag", F.when(F.col("_several"), _place(text)).otherwise(F.lit(0).cast("long")))
    by = by.withColumnsRenamed({"doc": "_doc", "tag": "_tag"})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            new = [t if found is None else _kept(t.encode("utf-8", "replace"), _merged(found)).decode("utf-8", "ignore")
                   for t, found in zip(*(batch.column(c).to_pylist() for c in ("text", "_spans")))]
            yield pa.record_batch([pa.array(new, pa.string()) if c == "text" else batch.column(c) for c in columns], columns)

    return keyed.join(by, ["_doc", "_tag"], "left").select(*columns, "_spans").mapInArrow(cut, docs.schema)

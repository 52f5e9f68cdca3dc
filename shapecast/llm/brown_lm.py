"""Brown class-based bigram model by exchange clustering, and its scores.

Training counts cover every training row. Classes are found in two steps. First
exchange clustering on a matrix of units - one of the most frequent words, or all
other words of one hashed ending (three bytes), ``UNITS`` squared cells whatever
the corpus: a unit moves to the class that raises the class bigram likelihood
most, unit by unit with counts kept up, until nothing moves or ``ROUNDS`` have
passed. Then every other word of the lexicon has an exchange step of its own: it
is taken out of its ending's class and put into the one in which its own
neighbours' classes raise the likelihood most. Those classes are a column of the
lexicon. Only words that are in no training row have the class of their ending.

P(w | before) = P(class(w) | class(before)) P(w | class(w)). Transitions are
interpolated with the classes' own frequencies (Witten-Bell), emissions are
discounted by class, the discount going to unknown words as one type.

The ``HEAD`` most frequent words (a fixed bound) are sent to the workers; all
other words of the texts get their counts and classes by a join on the word. A
text moves as a byte a token, its classes, on which the class bigrams are counted
and the transitions are scored.

Defined cases: a null text is empty and has the end token alone; a row without
an id counts as one of id '' (it is learnt from, not held out); repeated rows
count and are scored each; with no training row every probability is that of
an unknown word; an empty table gives no rows; very long texts are taken whole;
extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts, written

CLASSES, ROUNDS = 64, 8
UNITS, ENDINGS = 2048, 512
HEAD, HEAD_BYTES = 300_000, 40
END = b"\n"                    # no word holds it
COUNT_FLUSH = 300_000
#: Words whose units a worker remembers.
CACHE = 300_000


def tokens(text: str) -> list[bytes]:
    """A-Z in lower case; words between white space; one end."""
    out = text.encode("utf-8", "replace").lower().split()
    out.append(END)
    return out


def _remainder() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: Counter = Counter()

    def flush():
        out = pa.record_batch([pa.array(count.keys(), pa.binary()), pa.array(count.values(), pa.int64())], ["word", "n"])
        count.clear()
        return out

    for batch in batches:
        for text in batch.column("text").to_pylist():
            count.update(tokens(text))
            if len(count) > COUNT_FLUSH:
                yield flush()
    yield flush()


def lexicon(rows: DataFrame) -> DataFrame:
    """(word binary, n) of the rows' texts; combined in the tasks, then by word."""
    return rows.select("text").mapInArrow(_counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(words: DataFrame, most: int) -> dict[bytes, tuple]:
    """The most frequent words with their other columns, ``most`` at most: all above a count (words that tie there are left out)."""
    short = words.where(F.octet_length("word") <= HEAD_BYTES)
    steps = short.groupBy("n").count().orderBy(F.desc("n"))
    total, least = 0, None
    for r in steps.toLocalIterator():
        total += r["count"]
        if total > most:
            break
        least = r["n"]
    if least is None:
        return {}
    got = short.where(F.col("n") >= least).toArrow()
    return dict(zip(got["word"].to_pylist(), zip(*(got[c].to_pylist() for c in got.column_names if c != "word"))))


def leading(words: DataFrame, most: int) -> list[bytes]:
    """The ``most`` first words by count, ties by the word, whatever the counts are."""
    short = words.where(F.octet_length("word") <= HEAD_BYTES)
    return [bytes(r["word"]) for r in short.orderBy(F.desc("n"), "word").limit(most).collect()]


class Units:
    """The unit of a word: its own if it is frequent, else that of its ending."""

    def __init__(self, own: list[bytes]):
        self.endings = ENDINGS
        self.own = {w: ENDINGS + i for i, w in enumerate(own)}

    def of(self, word: bytes) -> int:
        got = self.own.get(word)
        return zlib.crc32(word[-3:]) % self.endings if got is None else got


_UNITS: dict[str, dict[bytes, int]] = {}


def unit_bigrams(rows: DataFrame, units: Units) -> np.ndarray:
    """UNITS x UNITS counts of (unit, next unit); a text starts after an end."""
    sent, key = rows.sparkSession.sparkContext.broadcast(units), uuid.uuid4().hex
    n = UNITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = sent.value
        known = _UNITS.setdefault(key, {})
        total = np.zeros(n * n, np.int64)
        end = u.of(END)

        def unit(w):
            got = known.get(w)
            if got is None:
                got = u.of(w)
                if len(known) < CACHE:
                    known[w] = got
            return got

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = [end]
                for text in batch.column("text")[at:at + 256].to_pylist():
                    part += map(unit, tokens(text))
                ids = np.array(part, np.int64)
                total += np.bincount(ids[:-1] * n + ids[1:], minlength=n * n)
        cell = np.flatnonzero(total)
        bounds = np.searchsorted(cell, np.arange(n + 1) * n)
        rows_ = [i for i in range(n) if bounds[i] < bounds[i + 1]]
        parts = [(cell[bounds[i]:bounds[i + 1]] - i * n, total[cell[bounds[i]:bounds[i + 1]]]) for i in rows_]
        yield pa.record_batch([pa.array(rows_, pa.int32()),
                               pa.array([zlib.compress(c.astype("<u2").tobytes(), 1) for c, _ in parts], pa.binary()),
                               pa.array([zlib.compress(v.astype("<u4").tobytes(), 1) for _, v in parts], pa.binary())], ["unit", "next", "n"])

    def add(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            for c, v in zip(batch["next"], batch["n"]):
                total[np.frombuffer(zlib.decompress(c), "<u2")] += np.frombuffer(zlib.decompress(v), "<u4")
        yield pd.DataFrame({"unit": [key[0]], "n": [total.astype("<i8").tobytes()]})

    got = (rows.select("text").mapInArrow(count, "unit int, next binary, n binary")
           .groupBy("unit").applyInPandas(add, "unit int, n binary"))
    out = np.zeros((n, n), np.int64)
    for r in got.toLocalIterator():                          # UNITS rows of fixed size at most
        out[r["unit"]] = np.frombuffer(r["n"], "<i8")
    return out


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each unit. The likelihood that counts: sum f(N_cd) - sum f(N_c.) - sum f(N_.d), f(x) = x ln x."""
    n = len(bigrams)
    total = bigrams.sum(0) + bigrams.sum(1)
    order = np.argsort(-total, kind="stable")
    order = order[total[order] > 0]
    of = np.zeros(n, np.int64)
    of[order] = np.arange(len(order)) % classes
    one = np.zeros((n, classes))
    one[np.arange(n), of] = 1
    one[total == 0] = 0
    forward, backward = bigrams @ one, bigrams.T @ one      # unit to class, class to unit
    pairs = one.T @ forward
    for _ in range(rounds):
        moves = 0
        for u in order.tolist():
            a, own = of[u], float(bigrams[u, u])
            to, fro = forward[u].copy(), backward[u].copy()
            # the unit taken out of its class
            to[a] -= own
            fro[a] -= own
            rest = pairs.copy()
            rest[a] -= to
            rest[:, a] -= fro
            rest[a, a] -= own
            rows, columns = rest.sum(1), rest.sum(0)
            # put into each class b: row b gains to, column b gains fro, the corner both and its own pairs
            f = _xlogx(rest)
            corner = rest.diagonal() + to + fro + own
            gain = (_xlogx(rest + to) - f).sum(1) + (_xlogx(rest + fro[:, None]) - f).sum(0)
            gain += _xlogx(corner) + _xlogx(rest.diagonal()) - _xlogx(rest.diagonal() + to) - _xlogx(rest.diagonal() + fro)
            out, into = to.sum() + own, fro.sum() + own
            gain -= _xlogx(rows + out) - _xlogx(rows) + _xlogx(columns + into) - _xlogx(columns)
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9 * abs(gain[a]):
                continue
            moves += 1
            of[u] = b
            rest[b] += to
            rest[:, b] += fro
            rest[b, b] += own
            pairs = rest
            forward[:, a] -= bigrams[:, u]
            forward[:, b] += bigrams[:, u]
            backward[:, a] -= bigrams[u]
            backward[:, b] += bigrams[u]
        if not moves:
            break
    return of


class Neighbours(dict):
    """Numbers of words: a frequent one has its class, another ``CLASSES`` and up, as they come."""

    def __init__(self, units: Units, of: np.ndarray):
        super().__init__({w: int(of[u]) for w, u in units.own.items()})
        self.units, self.of, self.frequent = units, of, dict(self)
        self.words: list[bytes] = []
        self.classes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = got = CLASSES + len(self.words)
        self.words.append(word)
        self.classes.append(int(self.of[self.units.of(word)]))
        return got

    def restart(self) -> None:
        self.clear()
        self.update(self.frequent)
        self.words, self.classes = [], []


def neighbours(rows: DataFrame, units: Units, of: np.ndarray) -> DataFrame:
    """Of each word without a unit of its own: (word, codes, ns) - how often it stands
    between two classes, code = class before * (CLASSES + 1) + class after, the number
    CLASSES standing for the word itself; a row for each part."""
    sent, k = rows.sparkSession.sparkContext.broadcast((units, of)), CLASSES + 1
    cells = k * k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Neighbours(*sent.value)
        found: list[np.ndarray] = []

        def flush():
            cell, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
            bounds = pa.array(np.searchsorted(cell, np.arange(len(known.words) + 1) * cells), pa.int32())
            out = pa.record_batch([pa.array(known.words, pa.binary()), pa.ListArray.from_arrays(bounds, pa.array((cell % cells).astype(np.int32))),
                                   pa.ListArray.from_arrays(bounds, pa.array(n, pa.int64()))], ["word", "codes", "ns"])
            known.restart()
            found.clear()
            return out

        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = [END]
                for text in batch.column("text")[at:at + 256].to_pylist():
                    part += tokens(text)
                ids = np.fromiter(map(known.__getitem__, part), np.int64, len(part))
                c = ids.copy()
                rest = np.flatnonzero(ids >= CLASSES)
                c[rest] = np.array(known.classes, np.int64)[ids[rest] - CLASSES]
                before, after = (np.where(ids[rest + d] == ids[rest], CLASSES, c[rest + d]) for d in (-1, 1))
                found.append((ids[rest] - CLASSES) * cells + before * k + after)
                held += len(rest)
                if len(known.words) > COUNT_FLUSH or held > 10 * COUNT_FLUSH:
                    yield flush()
                    held = 0
        yield flush()

    return rows.select("text").mapInArrow(run, "word binary, codes array<int>, ns array<long>")


def own_step(row: np.ndarray, code: np.ndarray, n: np.ndarray, of: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Class of each word by its neighbours (``n`` times ``code`` of word ``row``): it is
    taken out of its class ``of`` and put where the likelihood of ``pairs``, the class
    bigrams, is highest (the first of equals), as in ``exchange``. No empty class is filled."""
    k, size, f = len(pairs), len(of), _xlogx
    to, fro = (np.bincount(row * (k + 1) + c, n, size * (k + 1)).reshape(size, k + 1) for c in (code % (k + 1), code // (k + 1)))
    own, to, fro = to[:, k:], to[:, :k], fro[:, :k]
    every, diagonal = np.arange(size), pairs.diagonal()
    gain, stay = np.zeros((size, k)), np.zeros(size)
    # row b of the pairs gains the classes after, column b those before
    for side, other, p in ((to, fro, pairs), (fro, to, pairs.T)):
        w, c = np.nonzero(side)
        if len(w):
            first = np.flatnonzero(np.diff(w, prepend=-1))
            gain[w[first]] += np.add.reduceat(f(p.T[c] + side[w, c][:, None]) - f(p.T[c]), first)
        # what the word gave to its old class is gone from there
        now, mine = p.T[of], side[every, of][:, None]
        gain += f(now - other + mine) - f(now - other) - f(now + mine) + f(now)
        total, whole = side.sum(1)[:, None] + own, p.sum(1)
        gain -= f(whole + total) - f(whole)
        kept = f(p[of]) - f(p[of] - side)
        kept[every, of] = 0
        stay += kept.sum(1) - (f(whole[of]) - f(whole[of] - total[:, 0]))
    gain += f(diagonal + to + fro + own) - f(diagonal + to) - f(diagonal + fro) + f(diagonal)
    corner = diagonal[of]
    gain[every, of] = stay + f(corner) - f(corner - to[every, of] - fro[every, of] - own[:, 0])
    gain[:, (pairs.sum(0) + pairs.sum(1)) == 0] = -np.inf
    top = gain.max(1, keepdims=True)
    return (gain >= top - 1e-9 * np.abs(top)).argmax(1)


def classed(rows: DataFrame, words: DataFrame, units: Units, of: np.ndarray, pairs: np.ndarray) -> DataFrame:
    """The lexicon with every word's class: word, n, class. ``pairs``: class bigrams of the units."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                mine = np.array([of[units.of(w)] for w in some.column("word").to_pylist()], np.int64)
                codes, ns = (some.column(c).flatten() for c in ("codes", "ns"))     # lists of parts
                parts = np.repeat(np.arange(some.num_rows), some.column("codes").value_lengths().to_numpy())
                row = np.repeat(parts, codes.value_lengths().to_numpy())
                code, n = codes.flatten().to_numpy(), ns.flatten().to_numpy()
                got = own_step(row, code, n, mine, pairs)
                total = np.bincount(row, n, some.num_rows).astype(np.int64)
                yield pa.record_batch([some.column("word"), pa.array(total), pa.array(got, pa.int32())], ["word", "n", "class"])

    rest = (neighbours(rows, units, of).groupBy("word").agg(F.collect_list("codes").alias("codes"), F.collect_list("ns").alias("ns"))
            .mapInArrow(run, "word binary, n long, class int"))
    own = rows.sparkSession.createDataFrame([(w, int(of[u])) for w, u in units.own.items()], "word binary, class int")
    return words.join(F.broadcast(own), "word").select("word", "n", "class").unionByName(rest)


def emissions(stats: dict[int, tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each class's tokens, discount and log10 of an unknown word."""
    size, discount, unknown = np.zeros(CLASSES), np.full(CLASSES, 0.5), np.zeros(CLASSES)
    for c, (total, kinds, once, twice) in stats.items():
        size[c] = total
        discount[c] = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)
        unknown[c] = np.log10(discount[c] * kinds / total)
    return size, discount, unknown


class Brown:
    """Class of each unit, log10 transitions, and each class's tokens, discount and log10 unknown."""

    def __init__(self, units: Units, of: np.ndarray, pairs: np.ndarray, stats: dict[int, tuple[int, int, int, int]]):
        self.units, self.of = units, of
        size = pairs.sum(0).astype(float)
        prior = (size + 0.5) / (size.sum() + 0.5 * len(size))
        kinds, out = (pairs > 0).sum(1), pairs.sum(1)
        self.step = np.log10((pairs + np.maximum(kinds, 1)[:, None] * prior) / (out + np.maximum(kinds, 1))[:, None])
        self.tokens, self.discount, self.unknown = emissions(stats)

    def class_of(self, word: bytes) -> int:
        """Of a frequent or an unknown word; the others have theirs in the lexicon."""
        return int(self.of[self.units.of(word)])


def class_stats(words: DataFrame) -> dict[int, tuple[int, int, int, int]]:
    """Class -> (tokens, words, words seen once, twice), over the whole lexicon."""
    by = words.groupBy("class").agg(
        F.sum("n"), F.count(F.lit(1)), F.count(F.when(F.col("n") == 1, 1)), F.count(F.when(F.col("n") == 2, 1)))
    return {r[0]: tuple(r)[1:] for r in by.collect()}


ROW = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, emit double, codes binary"
PART = f"rid long, {ROW}, at int, word binary, class int"


def _logs(n: np.ndarray, c: np.ndarray, stats, n_train: int, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """log10 base and emission of words of counts ``n`` and classes ``c``."""
    size, discount, unknown = emissions(stats)
    emit = np.where(n > 0, np.log10((n - discount[c]).clip(1e-9) / size[c].clip(1)), unknown[c])
    return np.log10((n + 0.5) / (n_train + 0.5 * (kinds + 1))), emit


def _parts(head, units, of, stats, n_train: int, kinds: int):
    """Of each row the terms and classes of the head's words, and a row for each place of another word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, u = head.value, units.value
        index = {w: i for i, w in enumerate(words)}
        count, class_of = (np.array([x[i] for x in words.values()] + [0], np.int64) for i in (0, 1))
        base, emit = _logs(count, class_of, stats, n_train, kinds)
        base[-1] = emit[-1] = 0
        rid = TaskContext.get().partitionId() << 33
        get = index.get
        names = [x.split()[0] for x in PART.split(", ")]
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int32(), pa.binary(), pa.int32()]
        whole, places = [True] * 8 + [False] * 3, [True] + [False] * 7 + [True] * 3
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                rows, tails = [], []
                for doc, held, text in zip(*(some.column(c).to_pylist() for c in ("doc_id", "held_out", "text"))):
                    t = tokens(text)
                    ids = np.array([get(w, -1) for w in t], np.int64)
                    rest = np.flatnonzero(ids < 0).tolist()
                    tails += [(rid, i, t[i], int(of[u.of(t[i])])) for i in rest]
                    rows.append((rid, doc, held, len(t), len(t) - len(rest), float(base[ids].sum()), float(emit[ids].sum()),
                                 class_of[ids].astype(np.uint8).tobytes()))
                    rid += 1
                for found, here in ((rows, whole), (tails, places)):
                    if found:
                        column = iter(zip(*found))
                        yield pa.record_batch([pa.array(next(column), t) if h else pa.nulls(len(found), t) for h, t in zip(here, types)], names)
    return run


def _filled(stats, n_train: int, kinds: int):
    """Rows of ``_parts`` with the counts and classes that the join found for their other words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            got = batch.column("tail")
            many = got.value_lengths().fill_null(0).to_numpy()
            values = got.flatten()
            at, n, c = (values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            row = np.repeat(np.arange(size), many)
            base, emit = _logs(n, c, stats, n_train, kinds)
            raw, length = batch.column("codes").to_pylist(), batch.column("n_tokens").to_numpy()
            codes, first = np.frombuffer(b"".join(raw), np.uint8).copy(), np.cumsum(length) - length
            codes[first[row] + at] = c
            data = codes.tobytes()
            add = lambda name, w: batch.column(name).to_numpy() + np.bincount(row, w, size)
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), batch.column("n_tokens"),
                                   pa.array(add("n_known", n > 0).astype(np.int64)), pa.array(add("base", base)), pa.array(add("emit", emit)),
                                   pa.array([data[a:a + k] for a, k in zip(first.tolist(), length.tolist())], pa.binary())],
                                  [x.split()[0] for x in ROW.split(", ")])
    return run


def _steps(batch: pa.RecordBatch, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class before, class) of every token, and where the rows begin; a text starts after an end."""
    length = batch.column("n_tokens").to_numpy()
    c = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).astype(np.int64)
    first = np.cumsum(length) - length
    before = np.concatenate(([start], c[:-1]))
    before[first] = start
    return before, c, first


def class_bigrams(coded: DataFrame, start: int) -> np.ndarray:
    """CLASSES x CLASSES counts of (class, next class) of the rows."""
    k = CLASSES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            if batch.num_rows:
                before, c, _ = _steps(batch, start)
                total += np.bincount(before * k + c, minlength=k * k)
        cell = np.flatnonzero(total)
        yield pa.record_batch([pa.array(cell, pa.int64()), pa.array(total[cell], pa.int64())], ["cell", "n"])

    out = np.zeros(k * k, np.int64)
    for r in coded.select("n_tokens", "codes").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]                              # CLASSES squared rows at most
    return out.reshape(k, k)


class Learnt:
    """Units and their classes, the classed lexicon (written), its tokens and words, and each class's statistics."""

    def __init__(self, rows: DataFrame):
        words = written(lexicon(rows), "lexicon")
        self.total, self.kinds = words.select(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        own = leading(words, UNITS - ENDINGS - 1)
        self.units = Units([END, *(w for w in own if w != END)][:UNITS - ENDINGS])
        bigrams = unit_bigrams(rows, self.units)
        self.of = exchange(bigrams)
        one = np.zeros((UNITS, CLASSES))
        one[np.arange(UNITS), self.of] = 1
        self.words = written(classed(rows, words, self.units, self.of, one.T @ bigrams @ one), "classed")
        self.stats = class_stats(self.words)
        self.start = int(self.of[self.units.of(END)])

    def coded(self, rows: DataFrame) -> DataFrame:
        """The rows (with held_out) with their counts, base and emission sums and a class a token (written)."""
        send = rows.sparkSession.sparkContext.broadcast
        parts = written(rows.mapInArrow(_parts(send(frequent(self.words, HEAD)), send(self.units), self.of, self.stats, self.total, self.kinds), PART), "parts")
        tail = (parts.where("word is not null").select("rid", "at", "word", F.col("class").alias("spare")).join(self.words, "word", "left")
                .groupBy("rid").agg(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("class", "spare").alias("class"))).alias("tail")))
        whole = parts.where("word is null").drop("at", "word", "class").join(tail, "rid", "left")
        return written(whole.mapInArrow(_filled(self.stats, self.total, self.kinds), ROW), "coded")

    def model(self, coded: DataFrame) -> Brown:
        return Brown(self.units, self.of, class_bigrams(coded, self.start), self.stats)


def train(rows: DataFrame) -> tuple[Brown, DataFrame, int, int]:
    """The model, the classed lexicon (written), its tokens and its words."""
    learnt = Learnt(rows)
    return learnt.model(learnt.coded(rows.withColumn("held_out", F.lit(False)))), learnt.words, learnt.total, learnt.kinds


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    rows = texts(docs).withColumn("held_out", _remainder() == 1)
    learnt = Learnt(rows.where(~F.col("held_out")))
    coded = learnt.coded(rows)
    step, start = learnt.model(coded.where(~F.col("held_out"))).step, learnt.start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                before, c, first = _steps(batch, start)
                s = batch.column("emit").to_numpy() + np.add.reduceat(step[before, c], first)
                yield pa.record_batch([*(batch.column(x) for x in ("doc_id", "held_out", "n_tokens", "n_known", "base")), pa.array(s)],
                                      ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    got = coded.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return got.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(learnt.total).cast("long").alias("train_tokens"), "base_score", "score")

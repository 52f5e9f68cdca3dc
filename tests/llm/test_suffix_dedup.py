import hashlib
import random

import numpy as np
import pytest

from shapecast.llm import suffix_dedup
from shapecast.llm.lyndon_suffixes import suffix_arrays
from shapecast.llm.suffix_dedup import remove_repeats, removals


def brute(rows):
    order = sorted(range(len(rows)), key=lambda k: (-2**63 if rows[k][0] is None else rows[k][0]))
    seen, out = set(), {}
    for k in order:
        raw = (rows[k][1] or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - 99):
            w = raw[s:s + 100]
            if w in seen:
                gone[s:s + 100] = True
            seen.add(w)
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = int(np.sum(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        out[k] = (rows[k][0], len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return sorted(out.values(), key=str)


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefghij é") for _ in range(n))
    passages = [text(rng.choice([60, 99, 100, 101, 150, 400])) for _ in range(8)]
    rows = []
    for i in range(120):
        parts = [text(rng.randrange(0, 120)) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 20)
            parts.insert(rng.randrange(4), p[a:] if rng.random() < 0.3 else p)
        rows.append((rng.randrange(10**6) * 200 + i, "".join(parts)))
    rows += [(5, rows[3][1]), (6, rows[3][1] + "x"), (7, "y" + rows[3][1]), (-4, rows[9][1])]
    rows += [(8, "ab" * 300), (9, "ab" * 250 + "c" + "ab" * 90), (10, "z" * 1000), (11, None), (12, ""), (13, "z" * 99), (14, "z" * 100)]
    # one passage before and after which many texts differ
    shared = text(130)
    rows += [(1000 + k, text(rng.randrange(0, 40)) + shared + text(rng.randrange(0, 80))) for k in range(60)]
    return rows


@pytest.mark.parametrize("seed,part,combine", [(0, 1 << 22, 8 << 20), (1, 150, 500), (2, 1 << 22, 1)])
def test_equals_brute_force(docs_of, monkeypatch, seed, part, combine):
    monkeypatch.setattr(suffix_dedup, "PART", part)
    monkeypatch.setattr(suffix_dedup, "COMBINE", combine)
    rows = corpus(seed)
    rows += [(None, rows[0][1] + "tail" * 30)]
    got = removals(docs_of(rows, "tag")).drop("runs").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_repeated_rows_are_one_document(docs_of):
    t = "".join(chr(97 + (i * i) % 23) for i in range(300))
    got = [tuple(r)[:4] for r in removals(docs_of([(1, t), (1, t), (2, t)])).collect()]
    assert sorted(got)[-1] == (2, 300, 300, 1) and sorted(got)[0] == sorted(got)[1]


def test_text_without_its_repeats(docs_of):
    t = "é".join(chr(97 + (i * 7) % 25) * (i % 3) for i in range(120))
    docs = docs_of([(1, t), (2, "start " + t + " end"), (3, None), (4, "short")], "stop")
    out = remove_repeats(docs)
    assert out.columns == docs.columns
    by = {r.doc_id: r.text for r in out.collect()}
    assert by[3] is None and by[4] == "short" and by[1].startswith(t[:20]) and len(by[2]) < 20 and by[2].startswith("start")


def test_suffix_arrays_of_many_strings():
    rng = np.random.default_rng(0)
    for _ in range(60):
        strings = [np.append(rng.integers(1, rng.integers(2, 6), rng.integers(0, 50)), 0) for _ in range(rng.integers(1, 6))]
        high = np.cumsum([len(s) for s in strings])
        low = high - [len(s) for s in strings]
        symbols = np.concatenate(strings)
        got = suffix_arrays(symbols, low, high)
        for a, b in zip(low, high):
            assert got[a:b].tolist() == sorted(range(a, b), key=lambda i: symbols[i:b].tolist())


def test_empty(docs_of):
    assert removals(docs_of([])).count() == 0


def test_many_texts_without_an_id(docs_of):
    """Each loses its own repeat and nothing of another's, however many share the missing (or one) id."""
    rng = random.Random(9)
    rows, want = [], {}
    for i in range(6000):
        own = "".join(rng.choice("abcdefghijklmnop") for _ in range(120))
        text = "x" * rng.randrange(30) + own + f" {i} " + own
        rows.append((None if i % 2 else 7, text))
        want[text] = brute([(0, text)])[0][1:]
    got = removals(docs_of(rows, "tag")).collect()
    assert sorted((r["doc_id"], *list(r)[1:5]) for r in got if r["doc_id"]) == sorted((7, *want[t]) for i, t in rows if i)
    assert sorted(tuple(r)[1:5] for r in got if r["doc_id"] is None) == sorted(want[t] for i, t in rows if i is None)
    kept = {r["text"] for r in remove_repeats(docs_of(rows, "tag")).collect()}
    assert {hashlib.sha256(t.encode()).hexdigest() for t in kept} == {w[3] for w in want.values()}


def test_workers_hold_a_share_of_the_text_that_does_not_grow(docs_of, monkeypatch):
    """Tasks of the anchors follow the bytes of text, and texts become Python objects a few rows at a time."""
    rng = random.Random(4)
    own = ["".join(rng.choice("abcdefgh") for _ in range(150)) for _ in range(20)]
    docs = docs_of([(i, f"{i} " + own[i % 20] + own[i // 20]) for i in range(60)] + [(60, None)], "tag")
    usual = sorted(map(tuple, remove_repeats(docs).collect()), key=str)
    monkeypatch.setattr(suffix_dedup, "TASK_TEXT", 1000)
    monkeypatch.setattr(suffix_dedup, "ROWS", 3)
    tasks = suffix_dedup.anchor_tasks(docs)
    size = sum(len(r["text"] or "") for r in docs.collect())
    assert tasks == -(-size // 1000) > docs.sparkSession.sparkContext.defaultParallelism
    out = remove_repeats(docs)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "RepartitionByExpression [anchor" in plan and f", {tasks}" in plan
    assert sorted(map(tuple, out.collect()), key=str) == usual and out.schema == docs.schema
    big = docs.select("doc_id", "text")
    batch = next(iter(big.toArrow().to_batches()))
    assert max(b.num_rows for b in suffix_dedup._slices([batch])) == 3

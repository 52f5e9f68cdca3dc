import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest


from shapecast.llm import brown_lm
from shapecast.llm.brown_lm import END, exchange, score, tokens, train
from shapecast.llm.common import texts


def corpus(n=200):
    """Two languages: a word tells which words follow."""
    rng = random.Random(5)
    a, b = ([f"{p}{i}" for i in range(40)] for p in "ab")
    rows = [(i, " ".join(rng.choice(a if i % 2 else b) + rng.choice(["", "", "x"]) for _ in range(rng.randint(20, 60)))) for i in range(n)]
    return rows + [(900, None), (901, ""), (902, "ÉA Éa a1\x0bA1\x1cq  b2\n"), (None, "a1 a2"), (3, rows[3][1]), (903, "new " * 5000), (904, "rare" + "z" * 3000)]


def brute(rows):
    learn = [t or "" for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    count = Counter(w for t in learn for w in tokens(t))
    total, kinds = sum(count.values()), len(count)
    out = []
    for i, t in rows:
        w = tokens(t or "")
        held = zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
        out.append((i, held, len(w), sum(count[x] > 0 for x in w), total,
                    sum(math.log10((count[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w)))
    return out, count


@pytest.mark.parametrize("head", [300_000, 5])
def test_equals_brute_force(spark, docs_of, monkeypatch, head):
    monkeypatch.setattr(brown_lm, "HEAD", head)
    rows = corpus()
    docs = docs_of(rows, "word")
    got = sorted(score(docs).collect(), key=lambda r: str((r.doc_id, r.n_tokens)))
    want, count = brute(rows)
    want.sort(key=lambda r: str((r[0], r[2])))
    assert [tuple(r)[:5] for r in got] == [w[:5] for w in want]
    assert [r.base_score for r in got] == pytest.approx([w[5] for w in want], rel=1e-9)
    # the model's own formula, written out
    learn = texts(docs).where(brown_lm._remainder() != 1)
    model, _, _, _ = train(learn)
    by = {str((i, len(tokens(t or "")))): t for i, t in rows}
    for r in got[::9]:
        t, before, s = tokens(by[str((r.doc_id, r.n_tokens))] or ""), model.class_of(END), 0.0
        for w in t:
            c = model.class_of(w)
            s += model.step[before, c] + (math.log10((count[w] - model.discount[c]) / model.tokens[c]) if count[w] else model.unknown[c])
            before = c
        assert r.score == pytest.approx(s, rel=1e-9)
    held = [r for r in got if r.held_out and r.n_known > 10]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


def test_probabilities_sum_to_one(docs_of):
    docs = docs_of(corpus())
    model, words, _, _ = train(texts(docs))
    assert np.allclose((10**model.step).sum(1), 1)
    mass = {}
    for r in words.collect():
        c = model.class_of(bytes(r.word))
        mass[c] = mass.get(c, 10 ** model.unknown[c]) + (r.n - model.discount[c]) / model.tokens[c]
    assert all(abs(v - 1) < 1e-9 for v in mass.values())


def test_exchange_raises_the_likelihood_and_finds_the_classes():
    rng = np.random.default_rng(2)
    side = np.arange(60) % 2
    rate = np.where(side[:, None] == side[None, :], 9.0, 0.5)
    bigrams = rng.poisson(rate)

    def value(of, k):
        one = np.eye(k)[of]
        n = one.T @ bigrams @ one
        f = brown_lm._xlogx
        return f(n).sum() - f(n.sum(0)).sum() - f(n.sum(1)).sum()

    of = exchange(bigrams, 2, 10)
    assert len(set(zip(of, side))) == 2
    start = np.arange(60) % 7
    assert value(exchange(bigrams, 7, 5), 7) >= value(start, 7)


def test_empty(docs_of):
    assert score(docs_of([])).count() == 0
    only = score(docs_of([(2, "a b")])).collect()
    assert len(only) == 1 and math.isfinite(only[0].score)


def test_units_are_chosen_by_rank_whatever_the_counts(spark):
    """More words above a million, and more that tie at the top, than there are units."""
    words = [(f"w{i:02d}".encode(), 5_000_000 - i // 6) for i in range(30)]
    table = spark.createDataFrame(words[::-1], "word binary, n long")
    assert brown_lm.leading(table, 8) == [w for w, _ in words[:8]] and brown_lm.leading(table, 4) == [w for w, _ in words[:4]]
    assert set(brown_lm.frequent(table, 8)) == {w for w, _ in words[:6]}


def test_every_word_has_an_exchange_step_of_its_own(docs_of, monkeypatch):
    """More words than units: classes and scores against the likelihood written out."""
    for name, value in (("UNITS", 24), ("ENDINGS", 4), ("HEAD", 30)):
        monkeypatch.setattr(brown_lm, name, value)
    rows = corpus()
    docs = docs_of(rows)
    learn = [t or "" for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    model, words, _, _ = train(texts(docs).where(brown_lm._remainder() != 1))
    lexicon = {bytes(r["word"]): (r["n"], r["class"]) for r in words.collect()}
    _, count = brute(rows)
    assert {w: n for w, (n, _) in lexicon.items()} == count
    own = set(model.units.own)
    k, near = brown_lm.CLASSES, {}
    pairs = np.zeros((k, k))
    for t in learn:
        way = [END, *tokens(t)]
        for a, b in zip(way, way[1:]):
            pairs[model.class_of(a), model.class_of(b)] += 1
            for w in {a, b}:
                near.setdefault(w, Counter())[a, b] += 1
    f = brown_lm._xlogx

    def likelihood(w, c):
        """With the word moved from its ending's class to c."""
        moved = pairs.copy()
        for (a, b), n in near[w].items():
            moved[model.class_of(a), model.class_of(b)] -= n
            moved[c if a == w else model.class_of(a), c if b == w else model.class_of(b)] += n
        return f(moved).sum() - f(moved.sum(0)).sum() - f(moved.sum(1)).sum()

    rest = [w for w in lexicon if w not in own]
    assert len(rest) > 100
    used = np.flatnonzero(pairs.sum(0) + pairs.sum(1))
    for w in rest:
        assert likelihood(w, lexicon[w][1]) == pytest.approx(max(likelihood(w, c) for c in used), rel=1e-10, abs=1e-6), w
    assert any(lexicon[w][1] != model.class_of(w) for w in rest)     # more than its ending tells
    by = {str((i, len(tokens(t or "")))): t for i, t in rows}
    of = lambda w: lexicon[w][1] if w in lexicon else model.class_of(w)
    for r in score(docs).collect():
        before, s = model.class_of(END), 0.0
        for w in tokens(by[str((r.doc_id, r.n_tokens))] or ""):
            c = of(w)
            s += model.step[before, c] + (math.log10((count[w] - model.discount[c]) / model.tokens[c]) if count[w] else model.unknown[c])
            before = c
        assert r.score == pytest.approx(s, rel=1e-9)

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shapecast.llm import automaton_search
from shapecast.llm.automaton_search import formed, search, term_count

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def brute(docs, items, k):
    own = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    own = [d for d in own if d[2]]
    n_docs, total = len(own), sum(d[2] for d in own)
    df = Counter(t for _, c, _ in own for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, []).extend(terms(t))
    out = []
    for item, ts in wanted.items():
        rows = []
        for i, c, n in own:
            m = 100 - 25 + (25 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in ts if c[t])
            if s > 0:
                rows.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(rows)[:k])]
    return sorted(out, key=repr)


def frames(spark, docs, items):
    return (spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit(1)).withColumn("n", F.lit("x")).repartition(3),
            spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit(2)))


WORDS = ["alpha", "Beta", "été", "ÉTÉ", "x1", "1", "naïve", "a", "b", "co_op", "日本", "tail", "Alphabet", " ", "z"]


def corpus(seed, n):
    rng = random.Random(seed)
    docs = [(rng.choice([i, i, i, 5]), rng.choice([" ", "-", "\n", ", "]).join(rng.choices(WORDS, range(1, 16), k=rng.randint(0, 40)))) for i in range(n)]
    docs += [(900, None), (901, ""), (902, "...!"), (None, "alpha alpha tail"), (None, "z"), (903, "tail " * 30_000), (904, "same words"), (905, "same words")]
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 12)))) for i in range(12)] + [(3, "tail alpha"), (50, None), (51, "--"), (None, "same words words"), (52, "unseen")]
    return docs, items


@pytest.mark.parametrize("seed,most,kept", [(1, 500_000, 400_000), (2, 20, 15)])
def test_equals_brute_force(spark, monkeypatch, seed, most, kept):
    """Once in one part, once with the items in several parts and small buffers."""
    monkeypatch.setattr(automaton_search, "MOST_TERMS", most)
    monkeypatch.setattr(automaton_search, "KEPT", kept)
    monkeypatch.setattr(automaton_search, "CELLS", 40 if seed == 2 else 2_000_000)
    docs, items = corpus(seed, 80)
    got = search(*frames(spark, docs, items), k=7)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items, 7)


def test_empty_tables(spark):
    docs, items = corpus(3, 5)
    assert search(*frames(spark, [], items)).count() == 0
    assert search(*frames(spark, docs, [])).count() == 0
    assert search(*frames(spark, [(1, None)], items)).count() == 0


def test_terms_are_those_of_the_pattern():
    for text in ("a_b c", "É-É", "`x{y}z~", "\x00a\x7fb", "A1\u0085b", "", "[]", "日本 語"):
        assert term_count(formed(text.encode())) == len(terms(text))

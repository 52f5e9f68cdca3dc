import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapecast.llm import lsh_forest
from shapecast.llm.components import components
from shapecast.llm.lsh_forest import drop_near_duplicates, join_classes, prefix_depth


def grams(t):
    w = (t or "").split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def brute(rows):
    sets = [grams(t) for _, t in rows]
    different = list({s for s in sets if s is not None})
    ids = defaultdict(list)
    for (i, _), s in zip(rows, sets):
        ids[s].append(i)
    near = {s: [] for s in different}
    for x in range(len(different)):
        for y in range(x):
            a, b = different[x], different[y]
            if len(a & b) >= 0.8 * len(a | b) - 1e-9:
                near[a].append(b)
                near[b].append(a)
    root, out = {}, []
    for s in different:
        if s not in root:
            todo, seen = [s], {s}
            while todo:
                for y in near[todo.pop()]:
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
            name = min((i for y in seen for i in ids[y] if i is not None), default=None)
            root |= dict.fromkeys(seen, name)
    for (i, _), s in zip(rows, sets):
        out.append((i, i, i, 0) if s is None else (i, root[s], min((k for k in ids[s] if k is not None), default=None), len(near[s])))
    return sorted(out, key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(5000)
    rows, n = [], 0
    for _ in range(30):
        base = [word() for _ in range(rng.choice([8, 40, 150]))]
        for k in range(rng.choice([1, 2, 6])):
            t = list(base)
            for _ in range(k * len(t) // 60):
                t[rng.randrange(len(t))] = word()
            rows.append((n, " ".join(t)))
            n += 1
    base = [word() for _ in range(120)]
    for k in range(70):                      # a group of many near copies, and of copies
        t = list(base)
        if k % 3:
            t[rng.randrange(120)] = word()
        rows.append((n + k, " ".join(t)))
    return rows + [(900, None), (901, ""), (902, " \n "), (903, "three words only"), (904, "three  words\nonly"), (None, rows[0][1]), (0, rows[0][1]),
                   (905, "x " * 20_000), (906, "x " * 900), (None, "alone without an id or any other thing")]


def signature_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "class_id", "copy_id", "n_links").collect()), key=str)


@pytest.mark.parametrize("block", [1500, 9])
def test_equals_brute_force(docs_of, monkeypatch, block):
    monkeypatch.setattr(lsh_forest, "BLOCK", block)
    rows = corpus()
    assert signature_rows(join_classes(docs_of(rows, "copy"))) == brute(rows)


def test_one_of_each_group_stays(docs_of):
    rows = corpus()
    docs = docs_of(rows, "class_id")
    out = drop_near_duplicates(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    blank = [i for i, t in rows if grams(t) is None]
    want = {c for i, c, _, _ in brute(rows) if c is not None and i not in blank}
    assert sorted(i for i in ids if i is not None and i not in blank) == sorted(want)
    assert sorted(i for i in ids if i in blank) == blank


def test_prefixes_shorten_to_the_recall():
    assert prefix_depth(0.8, 0.999) == 6 and prefix_depth(1.0, 0.999) == lsh_forest.DEPTH and prefix_depth(0.1, 0.9999) == 1


def test_shared_counts_are_exact():
    rng = np.random.default_rng(0)
    for same in (True, False):
        a, b = ([np.unique(rng.integers(0, 300, 60, dtype=np.uint64)) for _ in range(n)] for n in (40, 25))
        b = a if same else b
        got = lsh_forest._shared(a, b, same)
        want = np.array([[len(np.intersect1d(x, y)) for y in b] for x in a])
        off = ~np.eye(len(a), len(b), dtype=bool) if same else np.ones_like(want, bool)
        assert (got[off] == want[off]).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}


def test_empty(docs_of):
    assert join_classes(docs_of([])).count() == 0
    assert drop_near_duplicates(docs_of([]).where(F.lit(True))).count() == 0


def test_texts_are_dealt_once_to_be_kept_and_numbered(spark, docs_of):
    """Between the window that leaves one of repeated rows and the join below it there is no exchange."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        out = drop_near_duplicates(docs_of([(1, "a b c d e f"), (1, "a b c d e f"), (None, "g h i"), (None, "g h i"), (2, "")]))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "2", "None"]
    finally:
        spark.conf.set(name, before)
    assert "Exchange" not in plan.split(" Window [")[1].split("SortMergeJoin")[0]

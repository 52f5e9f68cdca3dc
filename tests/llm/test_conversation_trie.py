import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from shapecast.llm import conversation_trie
from shapecast.llm.conversation_trie import trie
from shapecast.llm.radix_tree import Few, Indexed, Tree, Whole

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = tuple(own.get(base, [])[:h] + ts[h:])
    members, ends = {}, {}
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
        ends.setdefault(s, []).append(c)
    kids, leaves, saved = {}, {}, {}
    for s in members:
        if s:
            kids[s[:-1]] = kids.get(s[:-1], 0) + 1
    for s, m in members.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] = leaves.get(s[:d], 0) + (s not in kids)
            saved[s[:d]] = saved.get(s[:d], 0) + (len(m) - 1) * (len(s[-1][1]) if s else 0)
    return sorted(((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), kids.get(s, 0), leaves[s], saved[s],
                    hashlib.sha256(",".join(map(str, sorted(ends.get(s, [])))).encode()).hexdigest()) for s, m in members.items()), key=repr)


def conversations(seed, n):
    """Few different turns, so that beginnings are shared; a hot first turn, copies, one long conversation, odd rows."""
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-150, 900), n):
        turns = rng.randint(1, 7)
        rows += [(c, t, rng.choice(["user", "bot"]), "hello" if t == 0 and rng.random() < 0.6 else rng.choice(["a", "bé", "日本語", "x" * 50])) for t in range(turns)]
    rows += [(c, t, "user", "copy") for c in range(1000, 1100) for t in range(3)]
    rows += [(1200, t, "user", str(t % 3)) for t in range(300)] + [(1201, t, "user", str(t % 3)) for t in range(300)]
    rows += [(1300, None, None, None), (1301, None, "user", "null"), (1301, 0, "user", "first"), (1301, None, "bot", "null"), (1302, 5, "", None),
             (1303, 1, "user", "tie"), (1303, 1, "user", "tie"), (1303, 1, "a", "tie"), (1304, 1, "a", "tie"), (1304, 1, "user", "tie"),
             (None, 0, "user", "nobody"), (1400, 0, "user", ""), (1401, 0, "user", None)]
    return rows


@pytest.mark.parametrize("seed,n,turns,piece", [(1, 150, 300_000, 100_000), (2, 150, 90, 3), (3, 60, 11, 1)])
def test_equals_brute_force(spark, monkeypatch, seed, n, turns, piece):
    """In one range, and in ranges that cut through hot beginnings and copies."""
    monkeypatch.setattr(conversation_trie, "TURNS", turns)
    monkeypatch.setattr(conversation_trie, "PIECE", piece)
    rows = conversations(seed, n)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit(1)).withColumn("id", F.lit("x")).repartition(3)
    got = trie(df)
    assert got.columns == conversation_trie.RESULT
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_empty(spark):
    assert trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trie(spark.createDataFrame([(None, 0, "user", "x")], SCHEMA)).count() == 0


@pytest.mark.parametrize("kids,layout", [(4, Few), (16, Few), (17, Indexed), (48, Indexed), (49, Whole), (256, Whole)])
def test_layouts_grow(kids, layout):
    order = list(range(kids))
    random.Random(kids).shuffle(order)
    tree = Tree()
    for b in order:
        tree.add(bytes([7, b, 9, b]), b, None)
    tree.add(b"\x07", "end", None)
    node = tree.root.kids.get(7)
    assert isinstance(node.kids, layout) and node.path == b"\x07" and node.values == ["end"]
    assert [b for b, _ in node.kids.items()] == sorted(order)
    assert all(node.kids.get(b).path == bytes([b, 9, b]) and node.kids.get(b).values == [b] for b in order)

import re

from pyspark.sql import functions as F

from shapecast.llm import rule_cascade
from shapecast.llm.rule_cascade import cascade, default_rules, judge, measures, rank_rules


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, covered = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i:i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered.update(i + k for i in at for k in range(8))
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered),
            n < 20 or 100 * len(covered) > 30 * n)


SENTENCE = "the quick brown fox jumps over the lazy dog and runs far away from here"
ROWS = [(1, SENTENCE), (2, f"{SENTENCE}\n{SENTENCE}\n\n \n{SENTENCE} end"), (3, None), (4, ""), (5, "x " * 500), (6, "a\x0bb\x0cc\rd é è #*$%&|<>"),
        (7, " ".join(f"word{i}" for i in range(3000))), (8, " ".join(f"w{i % 900}" for i in range(3000))), (9, " ".join(f"LOUD{chr(65 + i)}" for i in range(26))),
        (None, "no id " + SENTENCE * 2), (1, SENTENCE), (10, "z" * 50_000), (11, "\U0001F600 " * 30)]


def test_measures(docs_of):
    got = judge(docs_of(ROWS, "words")).collect()
    assert sorted(map(str, (tuple(r)[:7] for r in got))) == sorted(map(str, ((i, *brute(t)) for i, t in ROWS)))
    assert all(not r.kept for r in got if r.base_failed)
    assert {r.doc_id: r.kept for r in got}[7] and not {r.doc_id: r.kept for r in got}[9]


def test_order_changes_no_verdict(docs_of):
    m = measures(docs_of(ROWS))
    rules = default_rules()
    names = rank_rules(m, rules)
    assert sorted(names) == sorted(rules)
    got = [m.select(F.count(F.when(cascade(rules, o).isNull(), 1))).first()[0] for o in (names, names[::-1])]
    assert got[0] == got[1]


def test_cheap_selective_rules_first(docs_of, monkeypatch):
    m = measures(docs_of([(i, "a b") for i in range(50)]))
    clock = iter([0, 1, 1, 2, 2, 12])
    monkeypatch.setattr(rule_cascade.time, "perf_counter", lambda: next(clock))
    rules = {"never": F.lit(False), "always": F.col("n_words") > 0, "slow": F.col("n_words") > 0}
    assert rank_rules(m, rules) == ["always", "slow", "never"]


def test_empty(docs_of):
    assert judge(docs_of([])).count() == 0

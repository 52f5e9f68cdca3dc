import hashlib
import math
import random
import re
from collections import Counter

from shapecast.llm.disclosure import find_spans, report, sanitise

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(d[::-1])) % 10 == 0


def base(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    ok = [(EMAIL, lambda m: True), (IP, lambda m: all(int(p) <= 255 for p in m.group().split("."))),
          (CARD, lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))), (PHONE, lambda m: 9 <= len(digits(m)) <= 15)]
    return sorted((m.start(), k, m.end(), m.group()) for k, (p, f) in enumerate(ok) for m in p.finditer(t) if f(m))


NAMES = ["email", "ip", "card", "phone", "term"]


def listed(spans):
    return ",".join(f"{NAMES[k]}:{s}:{e}" for s, k, e, _ in sorted(spans))


def brute(rows, threshold=0.9, support=3):
    near = []
    for i, t in rows:
        t = t or ""
        b = base(t)
        got = []
        for s, k, e, v in b:
            ent = f"{k}:" + (v.lower() if k < 2 else re.sub("[^0-9]", "", v))
            a0 = max(0, s - 200, t.rfind("\n", 0, s) + 1)
            e0 = t.find("\n", e)
            z = min(len(t) if e0 < 0 else e0, e + 200)
            for lo, hi in ((a0, s), (e, z)):
                part = t[lo:hi]
                for m in re.finditer(r"(?<![^\W\d_])[^\W\d_]{3,}(?![^\W\d_])", part):
                    if hi - lo == 200 and ((lo < s and m.start() == 0) or (lo >= e and m.end() == 200)):
                        continue
                    x, y = lo + m.start(), lo + m.end()
                    if not any(x < q and p < y for p, _, q, _ in b):
                        got.append((ent, m.group().lower(), (x, 4, y, m.group())))
        near.append((i, t, b, got))
    n_et, n_e, n_t = Counter(), Counter(), Counter()
    for _, t, b, got in near:
        n_et.update({(a, w) for a, w, _ in got})
        n_e.update({a for a, _, _ in got})
        n_t.update({w for w in re.split(r"[\W\d_]+", t.lower()) if len(w) > 2})
    N = len(rows)
    risky = {p for p, c in n_et.items() if c >= support and n_e[p[0]] < N
             and math.log(c * N) - math.log(n_e[p[0]] * n_t[p[1]]) >= threshold * math.log(N / n_e[p[0]]) - 1e-12}
    out = []
    for i, t, b, got in near:
        terms = {s for a, w, s in got if (a, w) in risky}
        c = Counter(k for _, k, _, _ in b)
        out.append((i, c[0], c[1], c[2], c[3], hashlib.sha256(listed(b).encode()).hexdigest(), listed([*b, *terms])))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "and", "river", "stone", "blue", "été"]) for _ in range(40))) for i in range(60)]
    for i in range(5):
        rows.append((100 + i, f"the river\nmanager Zoltan wrote from zoltan.k@mail.example.org and the stone {i}\nother river"))
        rows.append((120 + i, f"Kasparov blue +1 (555) 010-2345{i % 2} the and 10.0.0.{i} 300.1.1.1"))
    rows += [(200, None), (201, ""), (202, "4111 1111 1111 1111 x 4111-1111-1111-1112 é 378282246310005"),
             (203, "a@b.co_x@d.ef,..a@b@c.de a@b c@d. %+@-.- 1.2.3.4.5.6.7.8 0001.2.3.255 1.2.3"), (204, "5" * 3000 + "@x.y" + "é" * 10),
             (205, "+1" + " " * 500 + "2 +12345678 +123456789 +1(2).3-4 567890123456"), (206, "w" * 30_000), (207, "1-" * 20_000 + "1"),
             (None, "null id zoltan.k@mail.example.org manager"), (100, rows[60][1]), (208, "日本 a.b@c.日 x@y.zz日 \U0001F600 q@r.st")]
    return rows


def test_equals_brute_force(docs_of):
    rows = corpus()
    got = report(find_spans(docs_of(rows, "key"))).collect()
    assert sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in got), key=str) == brute(rows)
    spans = {r.doc_id: r.spans for r in got}
    assert "term" in spans[101] and "term" not in spans[1]


def test_sanitised_text(docs_of):
    docs = docs_of(corpus(), "terms")
    out = sanitise(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    by = {r.doc_id: r.text for r in out.collect()}
    assert "zoltan.k@" not in by[101] and "[EMAIL]" in by[101] and "Zoltan" not in by[101] and "[TERM]" in by[101]
    assert by[1] == dict(corpus())[1] and by[200] is None and "+1" not in by[121]


def test_empty(docs_of):
    assert report(find_spans(docs_of([]))).count() == 0


def brute_whole(rows, threshold=0.9, support=3):
    """Terms of the whole text, wherever the entity is."""
    found = []
    for i, t in rows:
        b, blank = base(t or ""), list(t or "")
        for s, _, e, _ in b:
            blank[s:e] = " " * (e - s)
        found.append((i, t or "", b, [(m.group().lower(), (m.start(), 4, m.end(), m.group())) for m in re.finditer(
            r"(?<![^\W\d_])[^\W\d_]{3,}(?![^\W\d_])", "".join(blank))] if b else []))
    entity = lambda k, v: f"{k}:" + (v.lower() if k < 2 else re.sub("[^0-9]", "", v))
    n_et, n_e, n_t = Counter(), Counter(), Counter()
    for _, t, b, words in found:
        mine = {entity(k, v) for _, k, _, v in b}
        n_e.update(mine)
        n_et.update({(e, w) for e in mine for w, _ in words})
        n_t.update({w for w in re.split(r"[\W\d_]+", t.lower()) if len(w) > 2})
    n = len(rows)
    risky = {p for p, c in n_et.items() if c >= support and n_e[p[0]] < n and n_t[p[1]]
             and math.log(c * n) - math.log(n_e[p[0]] * n_t[p[1]]) >= threshold * math.log(n / n_e[p[0]]) - 1e-12}
    return sorted(((i, listed([*b, *{s for w, s in words if any((entity(k, v), w) in risky for _, k, _, v in b)}]))
                   for i, _, b, words in found), key=str)


def test_terms_of_the_whole_text(docs_of):
    """A term 900 characters and two lines away from the entity, and one that is twice in the row."""
    rows = corpus() + [(300 + i, "Vesnin lives here\n" + "the and river " * 70 + f"\nto a.v@x.org x{i} Vesnin") for i in range(8)]
    rows += [(400, "ab" * 300 + "c@d.ef" * 40 + " one two " * 50)]
    got = find_spans(docs_of(rows, "key"), context=None)
    assert sorted(((r.doc_id, r.spans) for r in report(got).collect()), key=str) == brute_whole(rows)
    spans = {r.doc_id: r.spans for r in report(got).collect()}
    assert "term:0:6" in spans[300] and spans[300].count("term") >= 2
    assert "Vesnin" not in {r.doc_id: r.text for r in sanitise(docs_of(rows), context=None).collect()}[301]
    assert report(find_spans(docs_of([]), context=None)).count() == 0

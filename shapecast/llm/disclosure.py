"""Sanitisation of personal data by what terms disclose, in DataFrame functions only.

Base spans (e-mail, IP, card, phone) are found by patterns and checked. Their
values are the protected entities. A term (a word of three letters or more beside
the base spans) discloses entity e as far as the corpus says so:
PMI(e; t) = ln(n(e,t) N / (n(e) n(t))), with rows as the unit of co-occurrence.
Where PMI reaches ``threshold`` times ln(N / n(e)), the information that e itself
carries, and the pair is in ``support`` rows or more, the term's occurrences with
e become spans of kind ``term``; they are removed with the entity, or generalised
to a placeholder. With ``context`` None, as the query and the pipeline ask for,
every term of the whole text counts; a number bounds the characters to either
side of the entity, on its line.

A pattern's places follow from the lengths of its matches and of the texts
between them. Patterns are possessive where giving back could not help, so very
long runs cost linear time and no deep recursion.

Defined cases: a null text is empty and has no spans; a null id is kept and
read as such; repeated rows count as rows and get equal spans; an empty table
gives no rows; very long texts are searched whole; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts, written

KINDS = ("email", "ip", "card", "phone", "term")
#: A run of a pattern's first class starts where none precedes, or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this cannot hold the kind.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
TERM = r"(?<!\p{L})\p{L}{3,}(?!\p{L})"
CONTEXT = 200
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _located(text: Column, pattern: str, kind: int, offset: Column | None = None, wanted=None) -> Column:
    """Matches of the pattern with their places (code points, end exclusive); ``wanted``
    tells of a match whether it is listed."""
    offset = F.lit(0) if offset is None else offset
    more = lambda out, m, one: F.concat(out, one) if wanted is None else F.when(wanted(m), F.concat(out, one)).otherwise(out)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def walk(both: Column) -> Column:
        step = lambda s, x: _let(F.struct((s["at"] + x["gap"]).alias("a"), F.length(x["m"]).alias("n")), lambda p: F.struct(
            (p["a"] + p["n"]).alias("at"),
            more(s["out"], x["m"], F.array(F.struct(p["a"].alias("start"), F.lit(kind).alias("kind"),
                                                    (p["a"] + p["n"]).alias("end"), x["m"].alias("value")))).alias("out")))
        steps = F.zip_with(both["m"], F.slice(both["g"], F.lit(1), F.size(both["m"])),
                           lambda m, g: F.struct(m.alias("m"), F.length(g).alias("gap")))
        return F.aggregate(steps, F.struct(offset.alias("at"), F.array().cast(SPAN).alias("out")), step, lambda s: s["out"])

    return _let(found, lambda m: F.when(F.size(m) == 0, F.array().cast(SPAN)).otherwise(
        _let(F.struct(m.alias("m"), gaps.alias("g")), walk)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check sum holds; ``digits`` has 12 to 19 digits."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: _let(d.cast("int"),
                       lambda v: F.when(i % 2 == 0, v).when(v > 4, 2 * v - 9).otherwise(2 * v)))
    return F.aggregate(each, F.lit(0), lambda a, v: a + v) % 10 == 0


def _valid(kind: str, span: Column) -> Column:
    value = span["value"]
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return _let(_digits(value), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Valid spans of the base kinds, by start, then kind."""
    parts = []
    for i, kind in enumerate(KINDS[:4]):
        spans = F.filter(_located(text, PATTERNS[kind], i), partial(_valid, kind))
        need = text.rlike("[0-9]{2}|[0-9][\\x20-][0-9]") if NEEDS[kind] is None else F.contains(text, F.lit(NEEDS[kind]))
        parts.append(F.when(need, spans).otherwise(F.array().cast(SPAN)))
    return F.sort_array(F.concat(*parts))


def _entity(span: Column) -> Column:
    """What is protected: the kind and the value, letter case and separators aside."""
    value = F.when(span["kind"].isin(0, 1), F.lower(span["value"])).otherwise(_digits(span["value"]))
    return F.concat(span["kind"].cast("string"), F.lit(":"), value)


def _terms(text: Column, span: Column, context: int) -> Column:
    """Terms near the span: same line, ``context`` characters to either side, whole words."""
    low = F.greatest(span["start"] - context, F.lit(0))
    cut = F.substring_index(F.substring(text, low + 1, span["start"] - low), "\n", -1)
    # a word that the window or the span cuts is left out
    left = F.when(F.length(cut) == context, F.regexp_replace(cut, r"^\p{L}+", "")).otherwise(cut)
    wide = F.substring_index(F.substring(text, span["end"] + 1, F.lit(context)), "\n", 1)
    right = F.when(F.length(wide) == context, F.regexp_replace(wide, r"\p{L}+$", "")).otherwise(wide)
    return F.concat(_located(left, TERM, 4, span["start"] - F.length(left)), _located(right, TERM, 4, span["end"]))


def _free(terms: Column, spans: Column) -> Column:
    return F.filter(terms, lambda t: ~F.exists(spans, lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"])))


def disclosures(pairs: DataFrame, entities: DataFrame, document_frequency: DataFrame, rows: int,
                threshold: float, support: int) -> DataFrame:
    """(entity, term) pairs beyond the threshold. ``pairs``: entity, term and
    ``entities``: entity, each once for a row."""
    pairs = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_et")).where(F.col("n_et") >= support)
    entities = entities.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    both = pairs.join(entities, "entity").join(document_frequency, "term")
    return both.where(_risky(rows, threshold)).select("entity", "term")


def _risky(rows: int, threshold: float) -> Column:
    """Whether the pair's PMI, from n_et, n_e and n_t, reaches its threshold."""
    n = F.lit(float(rows))
    pmi = F.log(F.col("n_et") * n) - F.log(F.col("n_e") * F.col("n_t").cast("double"))
    return (F.col("n_e") < rows) & (pmi >= threshold * F.log(n / F.col("n_e")))


def _frequency(docs: DataFrame) -> DataFrame:
    """term, n_t: in how many rows a term is, over the whole corpus; combined before the shuffle."""
    words = F.array_distinct(F.split(F.lower(F.col("text")), r"[^\p{L}]+"))
    return (texts(docs).select(F.explode(words).alias("term")).where(F.length("term") >= 3)
            .groupBy("term").agg(F.count(F.lit(1)).alias("n_t")))


def _beside(text: Column, spans: Column) -> Column:
    """The text with the spans made blank: what is left keeps its places."""
    def step(s: Column, x: Column) -> Column:
        low = F.greatest(s["at"], x["start"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(
            s["out"], F.substring(text, s["at"] + 1, low - s["at"]), F.repeat(F.lit(" "), F.greatest(x["end"] - low, F.lit(0)))).alias("out"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                       lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def _whole_rows(docs: DataFrame, threshold: float, support: int) -> DataFrame:
    """``find_spans`` with the terms of whole texts. A row's entities and terms meet by
    its key; before that, entities and terms go that no pair beyond the threshold
    can hold: n(e,t) <= n(e), so PMI bounds n(t) by N (n(e) / N)^threshold."""
    rows = texts(docs).withColumn("key", F.xxhash64("doc_id", "text")).withColumn("base", base_spans(F.col("text")))
    some = F.size("base") > 0
    kept = written(rows.select("doc_id", "key", "base", F.when(some, _beside(F.col("text"), F.col("base"))).alias("beside"),
                               F.when(some, F.array_distinct(F.transform("base", _entity))).alias("entities")), "base-spans")
    holding, total = kept.where("beside is not null"), kept.count()
    # rows of one key are equal: m of them
    each = written(holding.select("key", F.explode("entities").alias("entity")).groupBy("key", "entity").agg(F.count(F.lit(1)).alias("m")), "entities")
    sizes = each.groupBy("entity").agg(F.sum("m").alias("n_e")).where((F.col("n_e") >= support) & (F.col("n_e") < total))
    often = written(each.join(sizes, "entity"), "often")
    found = F.array_distinct(F.transform(F.regexp_extract_all("beside", F.lit(TERM), F.lit(0)), F.lower))
    alive = often.groupBy("key").agg(F.max("m").alias("m"))
    terms = holding.dropDuplicates(["key"]).join(alive, "key").select("key", "m", F.explode(found).alias("term"))
    most = often.agg(F.max("n_e")).first()[0] or 0                      # one number
    bound = lambda n: F.pow(n / float(max(total, 1)), F.lit(threshold)) * float(total) * (1 + 1e-9)
    terms = written(terms, "terms")
    common = terms.groupBy("term").agg(F.sum("m").alias("n_h")).where(F.col("n_h") >= support).select("term")
    possible = _frequency(docs).where(F.col("n_t") <= bound(F.lit(float(most)))).join(common, "term")
    pairs = (often.join(terms.join(possible, "term").select("key", "term", "n_t"), "key").where(F.col("n_t") <= bound(F.col("n_e")))
             .groupBy("entity", "term").agg(F.sum("m").alias("n_et"), F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t"))
             .where(F.col("n_et") >= support))
    risky = pairs.where(_risky(total, threshold)).select("entity", "term")
    added = often.join(risky, "entity").groupBy("key").agg(F.collect_set("term").alias("risky"))
    plain = kept.where("beside is null").select("doc_id", "key", "base", F.array().cast(SPAN).alias("terms"))
    spans = _located(F.col("beside"), TERM, 4, wanted=lambda m: F.array_contains("risky", F.lower(m)))
    marked = holding.join(added, "key", "left").select(
        "doc_id", "key", "base", F.when(F.col("risky").isNull(), F.array().cast(SPAN)).otherwise(spans).alias("terms"))
    return plain.unionByName(marked)


def find_spans(docs: DataFrame, threshold: float = 0.9, support: int = 3, context: int | None = CONTEXT) -> DataFrame:
    """doc_id, key (of id and text), base (spans), terms (spans the method adds)."""
    if context is None:
        return _whole_rows(docs, threshold, support)
    text = F.col("text")
    rows = texts(docs).withColumn("key", F.xxhash64("doc_id", "text"))
    spans = rows.withColumn("base", base_spans(text))
    near = F.transform("base", lambda s: F.struct(_entity(s).alias("entity"), _free(_terms(text, s, context), F.col("base")).alias("terms")))
    kept = written(spans.select("doc_id", "key", "base", F.when(F.size("base") > 0, near).alias("near")), "base-spans")
    holding = kept.where("near is not null")
    each = (holding.select("key", F.explode("near").alias("x")).select("key", "x.entity", F.explode("x.terms").alias("span"))
            .withColumn("term", F.lower("span.value")))
    pair = F.transform("near", lambda x: F.transform(x["terms"], lambda t: F.struct(
        x["entity"].alias("entity"), F.lower(t["value"]).alias("term"))))
    pairs = holding.select(F.explode(F.array_distinct(F.flatten(pair))).alias("p")).select("p.*")
    entities = holding.select(F.explode(F.array_distinct(F.transform("near", lambda x: x["entity"]))).alias("entity"))
    risky = disclosures(pairs, entities, _frequency(docs), kept.count(), threshold, support)
    added = (each.join(risky, ["entity", "term"]).groupBy("key").agg(F.sort_array(F.collect_set("span")).alias("terms")))
    # only the rows with an entity take part in the join back
    plain = kept.where("near is null").select("doc_id", "key", "base", F.array().cast(SPAN).alias("terms"))
    marked = holding.join(added, "key", "left").select(
        "doc_id", "key", "base", F.coalesce("terms", F.array().cast(SPAN)).alias("terms"))
    return plain.unionByName(marked)


def _same(i: int, kind: Column) -> Column:
    return kind == i


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def report(found: DataFrame) -> DataFrame:
    """The contract's columns of ``find_spans``."""
    base, every = F.col("base"), F.sort_array(F.concat("base", "terms"))
    kinds = F.transform(base, lambda s: s["kind"])
    count = [F.size(F.filter(kinds, partial(_same, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return found.select("doc_id", *count, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(every).alias("spans"),
                        F.size("terms").cast("long").alias("n_term"))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind; of overlapping spans the first counts, and their union goes."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(s: Column, x: Column) -> Column:
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], F.when(
            x["start"] >= s["at"], F.concat(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.get(names, x["kind"])))
            .otherwise(F.lit(""))).alias("out"))

    return F.aggregate(F.sort_array(spans), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                       lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame, threshold: float = 0.9, support: int = 3, context: int | None = CONTEXT) -> DataFrame:
    """``docs`` with the spans replaced in ``text``; all rows and columns stay."""
    found = find_spans(docs, threshold, support, context).select("key", F.concat("base", "terms").alias("_spans"))
    found = found.where(F.size("_spans") > 0).dropDuplicates(["key"]).withColumnRenamed("key", "_key")
    keyed = docs.withColumn("_key", F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    out = keyed.join(found, "_key", "left")
    new = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(sanitised(F.col("text"), F.col("_spans")))
    return out.select(*[new.alias("text") if c == "text" else F.col(c) for c in docs.columns])

"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a condition on a row's measures that is true for a text to be
rejected. On a sample (rows whose id hash falls into a fixed slice,
``SAMPLE_ROWS`` of them about) each rule's rejection rate is counted and its
cost timed; the cascade then evaluates the rules by rejection per cost in one
nested CASE, so that a text stops at the first rule that rejects it. The order
changes the time only: the verdict is the same for any order.

The measures of the contract are computed for every text. Words found in a
repeated 8-word window: the words' hashes are combined by doubling (1, 2, 4, 8
words); only texts with two equal windows have these sorted and covered.

Defined cases: a null text is empty, has no words and fails the base rules;
repeated rows are judged each; long texts are measured whole; an empty table
gives no rows; columns beside id and text are ignored.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_RE, texts

WINDOW = 8
SAMPLE_ROWS = 2000
SPACE = "[\\x20\\x09-\\x0D]+"


def _shifted(hashes: Column, by: int) -> Column:
    """Hashes of twice the words: each joined with the one ``by`` places on."""
    n = F.greatest(F.size(hashes) - by, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(by + 1), n), lambda a, b: F.xxhash64(a, b))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, text, words and the measures of the contract."""
    text = F.col("text")
    n = F.col("n_words")
    out = texts(docs).withColumn("words", F.filter(F.split(text, SPACE), lambda w: w != ""))
    out = out.withColumn("n_words", F.size("words").cast("long"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_RE))
    out = out.withColumns({
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "lines": lines,
        "h1": F.transform("words", lambda w: F.xxhash64(w)),
    })
    out = out.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    out = out.withColumn("h2", _shifted(F.col("h1"), 1)).withColumn("h4", _shifted(F.col("h2"), 2))
    out = out.withColumn("h8", _shifted(F.col("h4"), 4))
    # only texts with equal windows: windows in the order of their hash, then the
    # starts of those that have an equal neighbour, in the order of the text
    placed = F.sort_array(F.transform("h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("placed", F.when(F.size(F.array_distinct("h8")) < F.size("h8"), placed))
    twice = F.filter("placed", lambda x, k: (F.get("placed", k - 1)["h"] == x["h"]) | (F.get("placed", k + 1)["h"] == x["h"]))
    out = out.withColumn("starts", F.when(F.col("placed").isNotNull(), F.sort_array(F.transform(twice, lambda x: x["i"])))
                         .otherwise(F.array().cast("array<int>")))
    # each start adds the words up to the next start
    gaps = F.transform("starts", lambda s, k: F.least(F.coalesce(F.get("starts", k + 1) - s, F.lit(WINDOW)), F.lit(WINDOW)))
    out = out.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g))
    out = out.withColumn("base_failed", (n < 20) | (100 * F.col("n_repeat_words") > 30 * n))
    return out.select("doc_id", "text", "words", "lines", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", "base_failed")


def default_rules() -> dict[str, Column]:
    """Rejecting conditions beside the base ones; measures are columns of ``measures``."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    letters = F.length(F.regexp_replace(F.col("text"), "[^\\p{L}]", ""))
    upper = F.length(F.regexp_replace(F.col("text"), "[^\\p{Lu}]", ""))
    return {
        "symbols": F.col("n_symbols") > F.col("n_words") * 0.5,
        "mean_word_short": F.col("word_chars") < 2 * n,
        "mean_word_long": F.col("word_chars") > 25 * n,
        "repeated_lines": (F.size("lines") >= 4) & (F.col("n_dup_lines") > 0.5 * F.size("lines")),
        "shouting": (upper > 0.6 * letters),
        "few_letters": letters < 0.3 * F.col("word_chars"),
    }


def rank_rules(measured: DataFrame, rules: dict[str, Column], sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names by rejection per cost, both taken from the sample."""
    total = measured.select("doc_id").count()
    if not total:
        return list(rules)
    slices = max(1, total // sample_rows)
    # the sample's bound is documented; it only orders the rules
    sample = measured.where(F.pmod(F.xxhash64("doc_id"), F.lit(slices)) == 0).limit(4 * sample_rows).coalesce(1).cache()
    try:
        size = max(1, sample.count())
        worth = {}
        for name, rule in rules.items():
            began = time.perf_counter()
            hits = sample.select(F.count(F.when(rule, 1))).first()[0]
            worth[name] = (hits + 0.5) / (size + 1) / max(time.perf_counter() - began, 1e-3)
    finally:
        sample.unpersist()
    return sorted(rules, key=lambda name: -worth[name])


def cascade(rules: dict[str, Column], order: list[str]) -> Column:
    """Name of the first rule, in ``order``, that rejects; null: kept."""
    out = F.lit(None).cast("string")
    for name in reversed(order):
        out = F.when(rules[name], F.lit(name)).otherwise(out)
    return out


def judge(docs: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, the measures, base_failed, kept, and the rule that rejected."""
    measured = measures(docs)
    rules = default_rules() if rules is None else rules
    verdict = F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(rules, rank_rules(measured, rules)))
    return measured.withColumn("rejected_by", verdict).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.col("rejected_by").isNull().alias("kept"), "rejected_by")

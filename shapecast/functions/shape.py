"""Statement shape as column expressions (no Python UDF, no parser object).

Each function takes a string Column holding SQL text and returns a Column, so
``df.select(...)`` extracts the shape of every statement of a query log in the
JVM, wherever the rows live. Plain functions run inside whole-stage code
generation; the higher-order ones (transform, filter, aggregate) are evaluated
row by row beside it.

The patterns below are fixed values: they define which answers count as right
(tables named after FROM/JOIN, CTE names, flags, LIMIT, WHERE predicates and
the literal they compare against).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: the patterns the shape is read with -----------------------
COMMENT_RE = r"(?s)--[^\n]*|/\*.*?\*/"
JOIN_RE = r"(?i)\bjoin\b"
GROUP_BY_RE = r"(?i)\bgroup\s+by\b"
ORDER_BY_RE = r"(?i)\border\s+by\b"
WINDOW_RE = r"(?i)\bover\s*\("
LIMIT_RE = r"(?i)\blimit\s+(\d+)"
CONJUNCTION_RE = r"(?i)\b(?:and|or)\b"
COMPARISON_RE = r"(?:<=|>=|<>|!=|<|>|=)\s*(-?\d+(?:\.\d+)?)"
CLAUSE_END_WORDS = r"group\s+by|order\s+by|having|limit|window|qualify"
LITERAL_RE = r"'[^']*'|\b\d+(?:\.\d+)?\b"
# -------------------------------------------------------------------------------

# After each WHERE keyword (the split keeps the keyword with the part before).
_AFTER_WHERE = r"(?i)(?<=\bwhere\b)"
# Tokens of a clause: brackets, clause-ending keywords at a word start, and
# maximal runs of other characters that contain no bracket and no keyword
# start (so the fold below takes a handful of steps per clause, not one per
# word).
_KW = r"\b(?:" + CLAUSE_END_WORDS + r")\b"
_TOKEN_RE = r"(?i)\(|\)|" + _KW + r"|(?:(?!" + _KW + r")[^()])+"
_END_TOKEN_RE = r"(?i)^(?:" + CLAUSE_END_WORDS + r")$"
# Upper-case forms, matched against upper(text): no case folding per match and
# no lambda per element.
_CTE_UP = r"(?:\bWITH\b|,)\s*([A-Z_][A-Z0-9_]*)\s+AS\s*\("
_FROM_JOIN_LAST_UP = r"\b(?:FROM|JOIN)\s+(?=[A-Z_])(?:[A-Z0-9_]*\.)*([A-Z0-9_]*)"


def clean(text: Column) -> Column:
    """Comments replaced by a space; NULL text reads as ''."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), COMMENT_RE, " ")


def ctes(t: Column) -> Column:
    """Lower-case names of common table expressions."""
    return F.transform(F.regexp_extract_all(F.upper(t), F.lit(_CTE_UP), 1), F.lower)


def tables(t: Column) -> Column:
    """Tables after FROM/JOIN, last dotted part, first-seen order, no CTEs,
    upper-case. ``array_except`` keeps first occurrences in order and drops
    the CTE names in one pass."""
    up = F.upper(t)
    return F.array_except(F.regexp_extract_all(up, F.lit(_FROM_JOIN_LAST_UP), 1),
                          F.regexp_extract_all(up, F.lit(_CTE_UP), 1))


def n_joins(t: Column) -> Column:
    return F.regexp_count(t, F.lit(JOIN_RE)).cast("int")


def flag(t: Column, pattern: str) -> Column:
    return F.when(t.rlike(pattern), F.lit(1)).otherwise(F.lit(0))


def limit_rows(t: Column) -> Column:
    """The largest LIMIT n, else 0; a number beyond 2^63 counts as 2^63 - 1."""
    values = F.transform(F.regexp_extract_all(t, F.lit(LIMIT_RE), 1),
                         lambda v: F.coalesce(v.try_cast("bigint"), F.lit(2**63 - 1)))
    return F.coalesce(F.array_max(values), F.lit(0).cast("bigint"))


def where_clauses(t: Column) -> Column:
    """The text of every WHERE clause, each cut at the end of its own bracket
    level or at a clause keyword (group by, order by, having, limit, window,
    qualify) on that level. A nested WHERE gives its own clause as well.

    Per WHERE: tokenise the text after it and fold over the tokens with
    (depth, stopped, kept length); the clause is the kept prefix. Linear in the
    text after each WHERE; nothing leaves the row.
    """
    parts = F.split(t, _AFTER_WHERE)
    n = F.size(parts)

    def suffix(i):  # text after the i-th WHERE (i from 1)
        return F.array_join(F.slice(parts, i + 1, n), "")

    def cut(s):
        tokens = F.regexp_extract_all(s, F.lit(_TOKEN_RE), 0)
        start = F.struct(F.lit(0).alias("d"), F.lit(False).alias("stop"),
                         F.lit(0).alias("len"))

        def step(acc, tok):
            d, stop, ln = acc["d"], acc["stop"], acc["len"]
            keep = lambda depth: F.struct(depth.alias("d"), F.lit(False).alias("stop"),
                                          (ln + F.length(tok)).alias("len"))
            halt = F.struct(d.alias("d"), F.lit(True).alias("stop"), ln.alias("len"))
            return (F.when(stop, acc)
                    .when(tok == "(", keep(d + 1))
                    .when(tok == ")", F.when(d == 0, halt).otherwise(keep(d - 1)))
                    .when((d == 0) & tok.rlike(_END_TOKEN_RE), halt)
                    .otherwise(keep(d)))

        folded = F.aggregate(tokens, start, step)
        return F.substring(s, 1, folded["len"])

    idx = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    return F.when(n > 1, F.transform(idx, lambda i: cut(suffix(i)))).otherwise(
        F.array().cast("array<string>"))


def n_predicates(clauses: Column) -> Column:
    """Per clause 1 + the number of AND/OR (BETWEEN a AND b counts two)."""
    return F.aggregate(clauses, F.lit(0),
                       lambda acc, c: acc + 1 + F.regexp_count(c, F.lit(CONJUNCTION_RE)))


def predicate_literal(clauses: Column) -> Column:
    """The largest number right of a comparison in any WHERE, else 0.0."""
    values = F.flatten(F.transform(
        clauses, lambda c: F.transform(F.regexp_extract_all(c, F.lit(COMPARISON_RE), 1),
                                       lambda v: v.cast("double"))))
    return F.coalesce(F.array_max(values), F.lit(0.0))


def query_hash(text: Column) -> Column:
    """SHA-256 of the text, first 32 hex digits."""
    return F.substring(F.sha2(text, 256), 1, 32)


def parameterized_hash(text: Column) -> Column:
    """X11: the same after quoted strings and bare numbers became '?'."""
    return query_hash(F.regexp_replace(text, LITERAL_RE, "?"))

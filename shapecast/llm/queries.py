"""The queries of this subpackage: name -> (builder, SQL twin or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn: Builder) -> Builder:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return wrap


@query("op10_warc_round_trip")
def op10_warc_round_trip(spark, sf_dir):
    """Every page into archives and back."""
    from .warc_shards import read_archives, write_archives
    return read_archives(*write_archives(table(spark, sf_dir, "pages")))


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark, sf_dir):
    """Every document into sequences of at most 4096 tokens."""
    import public_tokenizers

    from .fit_packing import pack
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 4096, 1)


@query("op5_byte_bpe")
def op5_byte_bpe(spark, sf_dir):
    """Every text to ids and back."""
    import public_tokenizers

    from .byte_bpe import digests, encode, load_ranks
    ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return digests(encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)


OP2_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings
  where embedding is not null and list_count(embedding) = len(embedding)
    and len(list_filter(embedding, lambda x: not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score
  from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as place from scored)
select query_id, cast(place as integer) as rank, vec_id, score from ranked where place <= 20"""


@query("op2_pivot_top_k", OP2_SQL)
def op2_pivot_top_k(spark, sf_dir):
    """The 20 highest inner products of every twentieth vector over all others."""
    from pyspark.sql import functions as F

    from .pivot_search import top_k
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


OP6_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (
  select doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
win as (
  select doc_id, i, array_to_string(ws[i:i + 7], ' ') as g
  from (select doc_id, ws, unnest(generate_series(1, len(ws) - 7)) as i from w)),
rep as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from win) where c > 1),
cov as (
  select doc_id, count(distinct i + k) as n from rep, (select unnest(generate_series(0, 7)) as k) group by doc_id),
m as (
  select w.doc_id, t, ls, len(ws)::bigint as n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
         coalesce(cov.n, 0)::bigint as n_repeat_words,
         length(regexp_replace(t, '[^\p{L}]', '', 'g')) as letters,
         length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) as uppers
  from w left join cov using (doc_id)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or n_symbols > n_words * 0.5 or word_chars < 2 * greatest(n_words, 1)
            or word_chars > 25 * greatest(n_words, 1) or (len(ls) >= 4 and n_dup_lines > 0.5 * len(ls))
            or uppers > 0.6 * letters or letters < 0.3 * word_chars) as kept
from b"""


@query("op6_rule_cascade", OP6_SQL)
def op6_rule_cascade(spark, sf_dir):
    """Measures and verdict of every text."""
    from .rule_cascade import judge
    return judge(table(spark, sf_dir, "documents")).drop("rejected_by")


@query("op3_disclosure")
def op3_disclosure(spark, sf_dir):
    """Personal data, and the terms that disclose it, in every text."""
    from .disclosure import find_spans, report
    return report(find_spans(table(spark, sf_dir, "documents"), context=None))


@query("op8_kneser_ney_quality")
def op8_kneser_ney_quality(spark, sf_dir):
    """Perplexity and verdict of every text."""
    from .kneser_ney import classify
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_lsh_forest_join")
def op7_lsh_forest_join(spark, sf_dir):
    """Class, copies and links of every text, at a similarity of 0.8 on five words."""
    from .lsh_forest import join_classes
    return join_classes(table(spark, sf_dir, "documents")).drop("text_hash", "copy")


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark, sf_dir):
    """What stays of every text when strings of 100 bytes that start earlier are removed."""
    from .suffix_dedup import removals
    return removals(table(spark, sf_dir, "documents")).drop("runs")


@query("op1_brown_lm")
def op1_brown_lm(spark, sf_dir):
    """Every text under the class model learnt from the rows that are not held out."""
    from .brown_lm import score
    return score(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
with d as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
sized as (select r, doc_id, ts, len(ts)::bigint as n from d where len(ts) > 0),
total as (select count(*)::bigint as all_n, sum(n)::bigint as all_l from sized),
tf as (select r, term, count(*)::bigint as tf from (select r, unnest(ts) as term from sized) group by all),
df as (select term, count(*)::bigint as df from tf group by all),
items as (
  select item_id, term, count(*)::bigint as times from (
    select item_id, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark) group by all),
weighed as (
  select item_id, term, times * floor(1000 * ln((2 * all_n + 2)::double / (2 * df + 1)::double))::bigint as w
  from items join df using (term), total),
scored as (
  select item_id, r, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * all_n) // all_l))))::bigint as score
  from weighed join tf using (term) join sized using (r), total group by all),
ranked as (
  select *, row_number() over (partition by item_id order by score desc, doc_id nulls last) as place from scored where score > 0)
select item_id, place::integer as rank, doc_id, score from ranked where place <= 20"""


@query("op12_automaton_search", OP12_SQL)
def op12_automaton_search(spark, sf_dir):
    """The 20 best documents of every benchmark item."""
    from .automaton_search import search
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)


@query("op11_projection_passes")
def op11_projection_passes(spark, sf_dir):
    """Links and component of every vector among those of its label, cosine 0.93 or more."""
    from .projection_passes import link
    return link(table(spark, sf_dir, "embeddings"))


OP13_SQL = """
with own as (
  select conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
                       order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as turns
  from conversations where conv_id is not null group by conv_id),
taken as (
  select conv_id, turns, xor(4294967295, list_reduce(
           [4294967295::bigint] || flatten(list_transform(string_split(conv_id::varchar, ''),
             lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])),
           lambda a, b: case when b >= 0 then xor(a, b) else xor(a >> 1, 3988292384 * (a & 1)) end)) % 6 as h from own),
whole as (
  select a.conv_id, list_concat(coalesce(b.turns[1:h], []), a.turns[h + 1:]) as seq
  from taken a left join own b on b.conv_id = a.conv_id - a.conv_id % 100),
begun as (select conv_id, d, seq[1:d] as way, d = len(seq) as ended from (select *, unnest(range(0, len(seq) + 1)) as d from whole)),
node as (
  select way, d, min(conv_id) as conv_id, count(*) as n_convs, case when d = 0 then 0 else length(any_value(way[d].text)) end as size,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ended), '')) as ends_sha256
  from begun group by way, d),
kids as (select way[1:d - 1] as way, count(*) as n_children from node where d > 0 group by 1),
full_node as (select node.*, coalesce(n_children, 0) as n_children from node left join kids using (way)),
sums as (
  select way, sum((n_convs - 1) * size) as saved_tokens, sum((n_children = 0)::int) as n_leaves
  from (select u.way[1:k] as way, n_convs, size, n_children from full_node u, unnest(range(0, u.d + 1)) as t(k)) group by way)
select f.conv_id, f.d::bigint as depth, p.conv_id as parent_conv_id, f.n_convs::bigint as n_convs, f.n_children::bigint as n_children,
       n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens, f.ends_sha256
from full_node f join sums using (way) left join node p on f.d > 0 and p.way = f.way[1:f.d - 1]"""


@query("op13_conversation_trie", OP13_SQL)
def op13_conversation_trie(spark, sf_dir):
    """Every node of the trie of the rebuilt conversations."""
    from .conversation_trie import trie
    return trie(table(spark, sf_dir, "conversations"))

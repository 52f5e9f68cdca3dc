"""SQL text for the driver's DuckDB oracle (and for Spark SQL users).

``PRELUDE`` defines ``qlog``, ``qcal`` and ``qtables`` over the testdata views;
it runs unchanged in Spark SQL (session time zone UTC) and in DuckDB. The
``*_CTES`` blocks extend it; ``q(...)`` glues a prelude, extra CTEs and a final
select into one statement. Every DataFrame query in ``plans`` has its twin
here, written independently in plain SQL.
"""

from __future__ import annotations

PRELUDE = """
with knobs as (
  select event_id as seq, event_id % 60 as tmpl, user_id % 4 as v, (event_id + user_id) % 3 as w,
         cast(substr(cast(ts as varchar(30)), 9, 2) as integer) as dom, value
  from events),
spec as (
  select seq, tmpl, dom, value, tmpl % 4 as fact_idx,
         case tmpl % 4 when 0 then 'lineitem' when 1 then 'orders' when 2 then 'events' else 'part' end as fact,
         cast(floor(tmpl / 4) as bigint) % 4 as n_joins,
         cast(floor(tmpl / 16) as bigint) % 2 as gb,
         cast(floor(tmpl / 32) as bigint) % 2 as win,
         case v when 0 then 20 when 1 then 150 when 2 then 450 else 900 end as lit,
         case tmpl % 3 when 0 then 0 when 1 then 100 else 1000 end as lim,
         case w when 0 then 'X-Small' when 1 then 'Small' else 'Medium' end as warehouse_size,
         case w when 0 then 1 when 1 then 2 else 4 end as threads
  from knobs),
qlog as (
  select seq,
    concat('q', cast(seq as varchar(20))) as query_id,
    concat('batch_0', cast(least(6, 1 + cast(floor((dom - 1) / 5) as integer)) as varchar(10))) as query_tag,
    concat('t', lpad(cast(tmpl + 1 as varchar(10)), 2, '0')) as template_id,
    warehouse_size,
    concat('with filtered as (select f.k, f.amount from ', fact, ' as f',
      case when n_joins >= 1 then ' inner join customer on f.k = customer.c_custkey' else '' end,
      case when n_joins >= 2 then ' inner join supplier on f.k = supplier.s_suppkey' else '' end,
      case when n_joins >= 3 then ' inner join nation on f.k = nation.n_nationkey' else '' end,
      ' where cast(substr(f.code, 3, 3) as integer) < ', cast(lit as varchar(10)), ')',
      case when win = 1 then ', ranked as (select filtered.*, row_number() over (partition by k order by amount desc) as amount_rank from filtered)' else '' end,
      ' select count(*) as c from ', case when win = 1 then 'ranked' else 'filtered' end,
      case when gb = 1 then ' group by k' else '' end,
      case when lim > 0 then concat(' limit ', cast(lim as varchar(10))) else '' end) as query_text,
    round((20 + 10 * fact_idx) * (1 + 0.35e0 * n_joins) * (1 + 0.5e0 * lit / 1000) * (1 + 0.4e0 * gb)
          * (1 + 0.6e0 * win) / threads * (1 + value / 2000), 3) as execution_ms,
    row_number() over (partition by least(6, 1 + cast(floor((dom - 1) / 5) as integer)) order by seq) - 1 as pos
  from spec),
qcal as (
  select query_tag, pos, 0.25e0 * (1 + 0.01e0 * (pos % 70) / 10) as seconds from qlog where pos % 10 = 0
  union all
  select query_tag, max(pos) + 1 as pos, 0.25e0 as seconds from qlog group by query_tag having (max(pos) + 1) % 10 <> 0),
qtables as (
  select 'LINEITEM' as table_name, count(*) as row_count, count(*) * 120 as bytes from lineitem union all
  select 'ORDERS', count(*), count(*) * 80 from orders union all
  select 'EVENTS', count(*), count(*) * 60 from events union all
  select 'PART', count(*), count(*) * 90 from part union all
  select 'CUSTOMER', count(*), count(*) * 70 from customer union all
  select 'SUPPLIER', count(*), count(*) * 50 from supplier union all
  select 'NATION', count(*), count(*) * 20 from nation)
"""

# Shape columns of every qlog statement, DuckDB dialect. RE2 has no
# look-behind, so the WHERE clause is matched as "text with balanced brackets
# (two levels) up to the first unmatched closing bracket": the rule of X7 for
# every statement qlog writes.
SHAPE_CTES = r"""
cleaned as (
  select *, regexp_replace(coalesce(query_text, ''), '--[^\n]*|/\*.*?\*/', ' ', 'gs') as t
  from qlog),
parsed as (
  select *,
    list_transform(regexp_extract_all(t, '(?i)(?:\bwith\b|,)\s*([a-z_][a-z0-9_]*)\s+as\s*\(', 1),
                   lambda x: lower(x)) as ctes,
    list_transform(regexp_extract_all(t, '(?i)\b(?:from|join)\s+([a-z_][a-z0-9_.]*)', 1),
                   lambda x: lower(string_split(x, '.')[-1])) as names,
    regexp_extract_all(t, '(?i)\bwhere\b((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)', 1) as clauses
  from cleaned),
shaped as (
  select *,
    list_transform(list_filter(names, lambda x, i: list_position(names, x) = i
                                            and not list_contains(ctes, x)),
                   lambda x: upper(x)) as tables,
    cast(len(regexp_extract_all(t, '(?i)\bjoin\b')) as integer) as n_joins,
    case when regexp_matches(t, '(?i)\bgroup\s+by\b') then 1 else 0 end as has_group_by,
    case when regexp_matches(t, '(?i)\border\s+by\b') then 1 else 0 end as has_order_by,
    case when regexp_matches(t, '(?i)\bover\s*\(') then 1 else 0 end as has_window,
    coalesce(list_max(list_transform(regexp_extract_all(t, '(?i)\blimit\s+(\d+)', 1),
                                     lambda x: cast(x as bigint))), 0) as limit_rows,
    cast(coalesce(list_sum(list_transform(clauses, lambda c:
        1 + len(regexp_extract_all(c, '(?i)\b(?:and|or)\b')))), 0) as integer) as n_predicates,
    coalesce(list_max(flatten(list_transform(clauses, lambda c: list_transform(
        regexp_extract_all(c, '(?:<=|>=|<>|!=|<|>|=)\s*(-?\d+(?:\.\d+)?)', 1),
        lambda v: cast(v as double))))), 0.0) as predicate_literal
  from parsed),
sized as (
  select s.*, cast(len(s.tables) as integer) as n_tables,
    coalesce((select sum(c.row_count) from qtables c where list_contains(s.tables, c.table_name)), 0)
      as table_rows,
    coalesce((select sum(c.bytes) from qtables c where list_contains(s.tables, c.table_name)), 0)
      as table_bytes,
    cast((select count(*) from qtables c where list_contains(s.tables, c.table_name)) as integer)
      as tables_known,
    case s.warehouse_size when 'X-Small' then 1 when 'Small' then 2 when 'Medium' then 4 else 0 end
      as warehouse_threads
  from shaped s)"""


def q(*parts: str) -> str:
    """PRELUDE + extra CTE blocks + the final select (the last part)."""
    *ctes, final = parts
    body = PRELUDE.rstrip()
    for block in ctes:
        body += ",\n" + block.strip()
    if VERSION_CTES in ctes:        # the least squares of the versions is solved step by step
        body = body.replace("with knobs", "with recursive knobs", 1)
    return body + "\n" + final.strip()

# Training rows: calibrated target (needs BRACKET_CTES from q_calibrate) and
# the prior over strictly earlier batches of the same parameterised hash.
TRAIN_CTES = r"""
hashed as (select query_id, seq,
  substr(sha256(regexp_replace(query_text, '''[^'']*''|\b\d+(?:\.\d+)?\b', '?', 'g')), 1, 32) as ph
  from qlog),
tr as (select i.query_id, i.query_tag, h.ph, h.seq,
  round(i.execution_ms / (i.cal_s / base.b), 3) as target_ms,
  round(i.cal_s / base.b, 6) as machine_factor
  from interp i join hashed h on h.query_id = i.query_id cross join base),
pb as (select ph, query_tag, sum(cast(round(target_ms * 1000) as bigint)) as s, count(*) as n
       from tr group by ph, query_tag),
pw as (select ph, query_tag,
  sum(s) over (partition by ph order by query_tag rows between unbounded preceding and 1 preceding) as cs,
  sum(n) over (partition by ph order by query_tag rows between unbounded preceding and 1 preceding) as cn
  from pb),
trp as (select tr.*, case when coalesce(pw.cn, 0) > 0 then 1 else 0 end as has_prior,
  case when coalesce(pw.cn, 0) > 0 then cast((2 * pw.cs + pw.cn) // (2 * pw.cn) as double) / 1000 end as prior_ms
  from tr join pw on pw.ph = tr.ph and pw.query_tag = tr.query_tag)"""

# The 13 features (needs SHAPE_CTES and TRAIN_CTES).
FEATURE_CTES = r"""
feat as (select s.query_id, s.query_tag, s.template_id, s.warehouse_size, t.seq,
  log10(greatest(cast(s.table_rows as double), 1.0)) as log_table_rows,
  log10(greatest(cast(s.table_bytes as double), 1.0)) as log_table_bytes,
  cast(s.n_tables as double) as n_tables, cast(s.n_joins as double) as n_joins,
  cast(s.has_group_by as double) as has_group_by, cast(s.has_order_by as double) as has_order_by,
  cast(s.has_window as double) as has_window,
  log10(cast(s.limit_rows as double) + 1.0) as log_limit_rows,
  cast(s.n_predicates as double) as n_predicates, s.predicate_literal,
  cast(s.warehouse_threads as double) as warehouse_threads,
  cast(t.has_prior as double) as has_prior,
  case when t.has_prior = 1 then log10(coalesce(t.prior_ms, 0) + 1.0) else 0.0 end as log_prior_ms,
  t.target_ms, t.machine_factor, t.has_prior as has_prior_int, t.prior_ms
  from sized s join trp t on t.query_id = s.query_id)"""


def _poisson_sql(u: str, kmax: int = 12) -> str:
    """Poisson(1) by inverse CDF; the same constants as metrics.poisson_cdf."""
    import math
    cdf, term, parts = 0.0, math.exp(-1.0), []
    for k in range(kmax + 1):
        cdf += term
        term /= (k + 1)
        parts.append(f"when {u} < {cdf!r} then {k}")
    return "case " + " ".join(parts) + f" else {kmax + 1} end"


def _products(columns: list[str]) -> str:
    """Rows of the normal equations of (1, columns) with the target's products last."""
    z = ["1", *columns, "y"]
    return "[" + ", ".join("[" + ", ".join(f"cast(sum({a} * {b}) as double)" for b in z) + "]" for a in z[:-1]) + "]"


def _fitted(columns: list[str]) -> str:
    return "c[1] + " + " + ".join(f"c[{i + 2}] * {f}" for i, f in enumerate(columns))


#: The 13 features by name (the contract's order).
FEATURE_NAMES = ["log_table_rows", "log_table_bytes", "n_tables", "n_joins", "has_group_by", "has_order_by",
                 "has_window", "log_limit_rows", "n_predicates", "predicate_literal", "warehouse_threads",
                 "has_prior", "log_prior_ms"]

# Versions over cumulative batch prefixes, one-feature OLS scored out of
# sample (needs SHAPE, BRACKET, TRAIN and FEATURE CTEs).
VERSION_CTES = r"""
vt as (select query_tag, row_number() over (order by query_tag) as bn
       from (select distinct query_tag from qlog) d),
meta as (select count(*) as nb, min(query_tag) as first_tag from vt),
n1t as (select count(*) as n1 from qlog where query_tag = (select first_tag from meta)),
vbase as (select f.query_id, f.query_tag, l.pos, vt.bn, f.log_table_rows as x, ln(f.target_ms) as y,
    f.target_ms as a, l.execution_ms,
    cast(('0x' || substr(md5(f.query_id), 1, 8)) as bigint) % 5 as fold
  from feat f join qlog l on l.query_id = f.query_id join vt on vt.query_tag = f.query_tag),
vrows as (select r.*, p.b,
    case when p.b > 1 then (case when r.bn = p.b then 1 else 0 end)
         else (case when r.pos >= floor(n1t.n1 * 0.7e0) then 1 else 0 end) end as in_holdout
  from vbase r cross join n1t
  join (select unnest(range(1, (select nb from meta) + 1)) as b) p on p.b >= r.bn),
pf as (select b, fold, cast(count(*) as double) as n, sum(x) as sx, sum(y) as sy, sum(x * x) as sxx,
    sum(x * y) as sxy from vrows where in_holdout = 0 group by b, fold),
tot as (select b, sum(n) as tn, sum(sx) as tsx, sum(sy) as tsy, sum(sxx) as tsxx, sum(sxy) as tsxy
        from pf group by b),
co1 as (select pf.b, pf.fold, tn - n as n_, tsx - sx as sx_, tsy - sy as sy_, tsxx - sxx as sxx_,
    tsxy - sxy as sxy_ from pf join tot on tot.b = pf.b),
co2 as (select b, fold, n_, sx_, sy_,
    case when n_ * sxx_ - sx_ * sx_ <> 0 then (n_ * sxy_ - sx_ * sy_) / (n_ * sxx_ - sx_ * sx_)
         else 0.0 end as sb from co1),
coef_o as (select b, fold, sb, (sy_ - sb * sx_) / n_ as sa from co2),
ch1 as (select b, tn, tsx, tsy, case when tn * tsxx - tsx * tsx <> 0
    then (tn * tsxy - tsx * tsy) / (tn * tsxx - tsx * tsx) else 0.0 end as hb from tot),
coef_h as (select b, hb, (tsy - hb * tsx) / tn as ha from ch1),
vscored as (select v.b, v.query_id, v.query_tag, v.in_holdout, v.execution_ms, v.a as actual_ms,
    case when v.in_holdout = 1 then exp(h.ha + h.hb * v.x) else exp(o.sa + o.sb * v.x) end
      as predicted_ms
  from vrows v left join coef_o o on o.b = v.b and o.fold = v.fold
  left join coef_h h on h.b = v.b),
hmean as (select b, avg(log10(actual_ms)) as m from vscored where in_holdout = 1 group by b),
hm as (select v.b, cast(count(*) as integer) as n_holdout_rows,
    avg(abs(predicted_ms - actual_ms) / actual_ms) * 100.0 as mape,
    avg(abs(predicted_ms - actual_ms)) as mae,
    sum((log10(actual_ms) - log10(predicted_ms)) * (log10(actual_ms) - log10(predicted_ms))) as res,
    sum((log10(actual_ms) - hmean.m) * (log10(actual_ms) - hmean.m)) as tot
  from vscored v join hmean on hmean.b = v.b where in_holdout = 1 group by v.b),

tm as (select b, cast(count(*) as integer) as n_train_rows,
    avg(abs(predicted_ms - actual_ms) / actual_ms) * 100.0 as cv
  from vscored where in_holdout = 0 group by b),
hdraw as (select v.b, abs(v.predicted_ms - v.actual_ms) / v.actual_ms * 100.0 as e,
    (cast(('0x' || substr(md5(v.query_id), 9, 8)) as ubigint) + cast(d.draw as ubigint) * 2654435769::ubigint)
      % 4294967296::ubigint as x, d.draw
  from vscored v cross join range(1, DRAWS + 1) as d(draw) where v.in_holdout = 1),
mix1 as (select b, e, draw, (xor(x, x >> 16) * 2246822507::ubigint) % 4294967296::ubigint as x from hdraw),
mix2 as (select b, e, draw, (xor(x, x >> 13) * 3266489909::ubigint) % 4294967296::ubigint as x from mix1),
mix3 as (select b, e, draw, cast(xor(x, x >> 16) as double) / 4294967296.0 as u from mix2),
bdraw as (select b, draw, sum(w * e) / sum(w) as m from (select b, draw, e, POISSON as w from mix3) s
  group by b, draw),
ci as (select b, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi from bdraw group by b),
bx as (select v.b, v.in_holdout, v.y, f.* from vrows v join feat f on f.query_id = v.query_id),
bmom as (select b, PRODUCTS as g from bx where in_holdout = 0 group by b),
bsolve as (select b, 0 as k, g, list_transform(g, lambda r, i: r[i]) as raw, []::boolean[] as used from bmom
  union all
  select b, k + 1, case when p then list_transform(g, lambda r, i: list_transform(r, lambda x, j:
      case when i = k + 1 then x / g[k + 1][k + 1] else x - r[k + 1] * g[k + 1][j] / g[k + 1][k + 1] end)) else g end,
    raw, list_append(used, p)
  from (select *, g[k + 1][k + 1] > 1e-9 * raw[k + 1] as p from bsolve where k < 14) s),
bcoef as (select b, list_transform(g, lambda r, i: case when used[i] then r[15] else 0.0 end) as c from bsolve where k = 14),
bbase as (select bx.b, avg(abs(exp(FITTED) - target_ms) / target_ms) * 100.0 as base
  from bx join bcoef on bcoef.b = bx.b where in_holdout = 1 group by bx.b),
dig as (select b, 'v' || cast(b as varchar) || '-' || substr(sha256(cast(count(*) as varchar) || ':'
      || cast(sum(cast(h as decimal(20, 0))) as varchar) || ':' || cast(bit_xor(h) as varchar)), 1, 8)
      as model_version
    from (select b, cast(('0x' || substr(sha256(query_id || ':'
            || cast(cast(round(execution_ms * 1000) as bigint) as varchar)), 1, 15)) as bigint) as h
          from vscored) s group by b),
vmetrics as (select hm.b, dig.model_version,
    (select max(query_tag) from vscored s where s.b = hm.b) as trained_at,
    coalesce(tm.n_train_rows, 0) as n_train_rows, hm.n_holdout_rows,
    round(hm.mape, 3) as holdout_mape_pct, round(ci.lo, 3) as mape_ci_low_pct,
    round(ci.hi, 3) as mape_ci_high_pct,
    round(case when tot > 0 then 1.0 - res / tot else 0.0 end, 4) as holdout_r2,
    round(hm.mae, 3) as holdout_mae_ms, round(tm.cv, 3) as cv_mape_pct,
    round(bbase.base, 3) as baseline_mape_pct,
    (hm.mape <= 15.0 and case when tot > 0 then 1.0 - res / tot else 0.0 end >= 0.90) as passes_gate
  from hm left join bbase on bbase.b = hm.b left join tm on tm.b = hm.b left join ci on ci.b = hm.b join dig on dig.b = hm.b),
latest as (select v.*, dig.model_version from vscored v join dig on dig.b = v.b
           where v.b = (select max(b) from vscored)),
detail as (select l.model_version, l.query_id, s.template_id, s.template_label,
    s.query_tag as batch_name, s.warehouse_size,
    cast(s.n_tables as double) as n_tables, cast(s.n_joins as double) as n_joins,
    cast(s.has_group_by as double) as has_group_by, cast(s.has_order_by as double) as has_order_by,
    cast(s.has_window as double) as has_window, s.predicate_literal,
    cast(s.table_rows as double) as table_rows,
    round(l.actual_ms, 3) as actual_ms, round(l.predicted_ms, 3) as predicted_ms,
    round(round(l.predicted_ms, 3) - round(l.actual_ms, 3), 3) as error_ms,
    round(abs(l.predicted_ms - l.actual_ms) / l.actual_ms * 100.0, 3) as abs_pct_error,
    case when l.in_holdout = 1 then 'holdout' else 'cross_validated' end as prediction_scope
  from latest l join labelled s on s.query_id = l.query_id),
sla as (select template_id, max(template_label) as template_label,
    cast(count(query_id) as integer) as queries,
    median(actual_ms) as p50a, median(predicted_ms) as p50p, max(actual_ms) as wa,
    max(predicted_ms) as wp,
    cast(sum(cast(abs_pct_error as decimal(18,3))) as double) / count(abs_pct_error) as mp
  from detail where template_id is not null group by template_id),
sla_out as (select template_id, template_label, queries, round(p50a, 3) as p50_actual_ms,
    round(p50p, 3) as p50_predicted_ms, round(wa, 3) as worst_actual_ms,
    round(wp, 3) as worst_predicted_ms, round(mp, 3) as mean_abs_pct_error,
    case when wp > 200.0 and wa > 200.0 then 'breach_called'
         when not wp > 200.0 and not wa > 200.0 then 'inside_sla'
         when wa > 200.0 then 'missed_breach' else 'false_alarm' end as sla_verdict,
    200.0 as sla_ms from sla)""".replace("POISSON", _poisson_sql("u")).replace("DRAWS", "2000").replace(
    "PRODUCTS", _products(FEATURE_NAMES)).replace("FITTED", _fitted(FEATURE_NAMES))

# Shape rows with the template label (needs SHAPE_CTES).
LABEL_CTES = r"""
labelled as (select z.*, concat_ws(' · ', sp.fact,
    cast(sp.n_joins as varchar) || case when sp.n_joins = 1 then ' join' else ' joins' end,
    case when sp.gb = 1 then 'group by' else 'no group by' end,
    case when sp.win = 1 then 'window' end,
    case when sp.lim > 0 then 'limit ' || cast(sp.lim as varchar) else 'no limit' end) as template_label
  from sized z join spec sp on sp.seq = z.seq)"""

"""Trust in every analysis of an audit log made from the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyglass.operators import profile as P, trust as X
from tallyglass.sources import catalog
from workload import base
from workload.base import AS_OF, profile_sql, query, tables
from workload.joins import KEY_MAPPINGS_SQL, key_mappings
from workload.segments import rounded

NAMED_SQL = f"""(select *, [lower(string_split(t, '.')[-1]) for t in tables_used]
  as names, [lower(string_split(c, '.')[-1]) for c in columns_used] as cols
  from {base.AUDIT_SQL})"""

SUBS_SQL = f"""(
with a as {NAMED_SQL},
q as (select analysis_id, avg(score) as q from (select analysis_id, unnest(names) as t from a)
  join {base.QUALITY_SQL} s on s.table_name = t group by all),
c as (select analysis_id, bool_or(status in ('validated', 'corrected')) as decided,
    bool_or(status = 'proposed') as proposed
  from (select analysis_id, unnest(names) as t from a) x
  join {KEY_MAPPINGS_SQL} on km.table_name = t group by all),
r as (select a.analysis_id, bool_and(e.kind = 'declared' or e.status = 'validated') as trusted
  from a join {base.EDGES_SQL.replace('as edges(', 'as e(')}
    on list_contains(names, e.from_table) and list_contains(names, e.to_table) group by all)
select a.analysis_id, coalesce(q, 0.7) as quality_sub, q is not null as scored,
  case when c.analysis_id is null then 0.5 when decided and not proposed then 1.0
    when decided then 0.8 else 0.6 end as concepts_sub,
  case when len(names) < 2 then 1.0 when r.analysis_id is null then 0.9 when trusted then 1.0
    else 0.6 end as relations_sub,
  1.0 as query_sub,
  case when row_count = 0 then 0.0 else greatest(0, 1 - case when sampled then 0.4 else 0 end
    - case when truncated then 0.4 else 0 end) end as coverage_sub,
  greatest(0, 1 - 0.34 * n_assumptions) as hypotheses_sub,
  len(names) as used, row_count, sampled, truncated, n_assumptions
from a left join q on q.analysis_id = a.analysis_id
left join c on c.analysis_id = a.analysis_id left join r on r.analysis_id = a.analysis_id)"""

CONFIDENCE_SQL = f"""(select *, 0.35 * quality_sub + 0.25 * concepts_sub + 0.18 * relations_sub
  + 0.12 * query_sub + 0.06 * coverage_sub + 0.04 * hypotheses_sub as score from {SUBS_SQL})"""


FACTORS_SQL = """coalesce(nullif(concat_ws('; ',
  case when used > 0 and not scored then 'quality unknown'
    when scored and quality_sub < 0.95 then 'quality below 95%' end,
  case when used > 0 and concepts_sub = 0.5 then 'no concept known'
    when concepts_sub = 0.8 then 'some concepts only proposed'
    when concepts_sub = 0.6 then 'concepts not validated' end,
  case when relations_sub = 0.6 then 'inferred relations' end,
  case when row_count = 0 then 'no rows' end,
  case when row_count > 0 and sampled then 'sample only' end,
  case when row_count > 0 and truncated then 'truncated' end,
  case when n_assumptions > 0 then 'assumptions made' end), ''), 'all signals good')"""


def confidence(spark, sf):
    return X.confidence(base.audit(spark, sf), base.quality_scores(spark, sf),
                        key_mappings(spark), base.edges(spark))


SUBS = ["quality_sub", "concepts_sub", "relations_sub", "query_sub", "coverage_sub",
        "hypotheses_sub"]


@query("X1_confidence", "select analysis_id, round(score, 6) as score, "
       + ", ".join(f"round(cast({s} as double), 6) as {s}" for s in SUBS)
       + f", {FACTORS_SQL} as factors from {CONFIDENCE_SQL}")
def _(spark, sf):
    return rounded(confidence(spark, sf).drop("breakdown"), "score", *SUBS).withColumn(
        "factors", F.array_join("factors", "; "))


@query("X1_confidence_breakdown", f"""
select factor, weight, round(sum(part), 4) as contribution, count(*) as n from (
""" + " union all ".join(
    f"select '{n}' as factor, cast({round(w * 100)} as bigint) as weight, "
    f"{n}_sub * {w} as part from {SUBS_SQL}"
    for n, w in base.fixed.CONFIDENCE_WEIGHTS.items()) + ") group by all")
def _(spark, sf):
    weights = F.create_map(*[v for n, w in base.fixed.CONFIDENCE_WEIGHTS.items()
                             for v in (F.lit(n), F.lit(w))])
    subs = F.create_map(*[v for n in base.fixed.CONFIDENCE_WEIGHTS
                          for v in (F.lit(n), F.col(f"{n}_sub"))])
    listed = confidence(spark, sf).select(subs.alias("subs"), F.inline("breakdown"))
    return rounded(listed.groupBy("factor", F.col("weight_pct").cast("bigint").alias("weight"))
                   .agg(F.sum(subs_value("subs") * weights[F.col("factor")])
                        .alias("contribution"), F.count("*").alias("n")),
                   "contribution", digits=4)


def subs_value(column):
    return F.element_at(F.col(column), F.col("factor"))


@query("X2_relation_subscore", f"""
select cast(relations_sub as double) as relations_sub, count(*) as n from {SUBS_SQL} group by all
""")
def _(spark, sf):
    return confidence(spark, sf).groupBy("relations_sub").agg(F.count("*").alias("n"))


@query("X3_coverage_and_hypotheses", f"""
select round(cast(coverage_sub as double), 4) as coverage_sub,
  round(cast(hypotheses_sub as double), 4) as hypotheses_sub, count(*) as n
from {SUBS_SQL} group by all
""")
def _(spark, sf):
    return base.audit(spark, sf).select(
        F.round(X.coverage_subscore(), 4).alias("coverage_sub"),
        F.round(X.hypothesis_subscore(), 4).alias("hypotheses_sub"),
    ).groupBy("coverage_sub", "hypotheses_sub").agg(F.count("*").alias("n"))


def profiles(spark, sf):
    known = tables(spark, sf, ["lineitem"])
    known["orders"] = base.orders_plus(spark, sf)
    known["customer"] = base.contacts(spark, sf)
    return P.profile_all(known)


CHECKS_SQL = f"""(
with a as {NAMED_SQL},
p as (select table_name, lower(column_name) as name, ordinal, detected_type, max_value,
    1 - non_null_count / cast(sample_size as double) as null_rate
  from ({profile_sql(base.plain_part('lineitem'), base.ORDERS_PART, base.CONTACTS_PART)})),
k as (
  select a.*, p.name, list_contains(cols, name) as used,
    (list_position(names, table_name), ordinal) as place,
    regexp_matches(name, '(?i)amount|price|montant|revenue|ca\\b|total|net') as money,
    contains(name, 'ttc') as gross, null_rate,
    starts_with(detected_type, 'datetime') or regexp_matches(name, '(?i)date|_at$|jour|day')
      as dated,
    coalesce(try_cast(left(max_value, 10) as date) > date '{AS_OF}', false) as future
  from a join p on list_contains(names, table_name)),
j as (
  select analysis_id, bool_or(money and used) as measured,
    bool_or(money and gross) and not bool_or(money and gross and used) as risky,
    bool_or(dated and (used or aggregates)) as has_dates,
    bool_or(dated and (used or aggregates) and (future or null_rate >= 0.1)) as bad_dates,
    arg_min(name, place) filter (dated and (used or aggregates) and (future or null_rate >= 0.1))
      as first_date,
    string_agg(distinct name, ',' order by name) filter (money and used) as amounts,
    arg_max(name, (null_rate, name)) filter (used and null_rate >= 0.3) as emptiest,
    bool_or(used and null_rate >= 0.3) as empty
  from k group by all)
select a.analysis_id, 'measure' as "check", case when risky then 'warn' else 'pass' end as result,
  'amount: ' || amounts as detail
from a join j on j.analysis_id = a.analysis_id where measured
union all
select analysis_id, 'dates', case when bad_dates then 'warn' else 'pass' end,
  coalesce('look at ' || first_date, 'plausible') from j where has_dates
union all
select a.analysis_id, 'nulls', case when empty then 'warn' else 'pass' end,
  coalesce(emptiest || ' is mostly NULL', 'few NULL')
from a left join j on j.analysis_id = a.analysis_id where len(cols) > 0
union all
select analysis_id, 'row_count', case when row_count = 0 then 'fail' when truncated then 'warn'
  else 'pass' end, case when row_count = 0 then 'empty' when truncated then 'truncated'
    else row_count || ' rows' end from a)"""


def checks(spark, sf):
    return X.checks(base.audit(spark, sf), profiles(spark, sf), AS_OF)


@query("X4_checks", f"select * from {CHECKS_SQL}")
def _(spark, sf):
    return checks(spark, sf)


@query("X5_reliability", f"""
with t as (select analysis_id, count(*) filter (result = 'fail') as f,
    count(*) filter (result = 'warn') as w,
    coalesce(max(result) filter ("check" = 'nulls'), 'pass') as nulls,
    coalesce(max(result) filter ("check" = 'dates'), 'pass') as dates
  from {CHECKS_SQL} group by all),
s as (select c.analysis_id, concepts_sub, relations_sub, hypotheses_sub, nulls, dates, greatest(0, least(1, score - 0.2 * coalesce(f, 0)
    - 0.05 * coalesce(w, 0))) as s, a.row_count, causal, has_drivers
  from {CONFIDENCE_SQL} c left join t on t.analysis_id = c.analysis_id
  join {base.AUDIT_SQL} a on a.analysis_id = c.analysis_id)
select analysis_id, cast(round_even(cast(s * 100 as double), 0) as int) as percent,
  case when row_count = 0 then 1 else
    cast(least(5, greatest(1, round_even(cast(s * 5 as double), 0))) as int) end as stars,
  case when causal and not has_drivers then 'cannot_conclude' end as verdict,
  concat_ws(',', case concepts_sub when 1.0 then 'ok' when 0.8 then 'ok' when 0.5 then 'warn'
      else 'fail' end,
    case when nulls = 'pass' then 'ok' else 'warn' end,
    case when relations_sub = 1 then 'ok' else 'warn' end,
    case when dates = 'pass' then 'ok' else 'warn' end,
    case when hypotheses_sub >= 0.66 then 'ok' else 'warn' end) as factors
from s
""")
def _(spark, sf):
    return X.rate_analyses(
        base.audit(spark, sf), profiles(spark, sf), AS_OF, base.quality_scores(spark, sf),
        key_mappings(spark), base.edges(spark)).withColumn("factors", F.concat_ws(
            ",", *[f"factors.{f}" for f in ("concepts", "nulls", "relations", "dates",
                                            "hypotheses")]))


PROOF_SQL = f"""(
with a as (select * from {NAMED_SQL} where len(names) > 0),
cat as (select table_name, lower(column_name) as c from {base.columns_sql(base.ALL)}),
f as (
  select analysis_id, names[1] as t, n_assumptions,
    (select count(*) from (select unnest(cols) as x) where x in (select c from cat)) as needed,
    (select count(*) from (select unnest(cols) as x)
      where x in (select c from cat where table_name = names[1])) as present
  from a),
g as (
  select f.*, case when needed = 0 then 100
      else cast(round_even(present / cast(needed as double) * 100, 0) as int) end as coverage_pct,
    cast(round_even(score * 100, 0) as int) as quality_pct,
    (select min(concept) from {KEY_MAPPINGS_SQL}
      where km.table_name = t and km.status in ('validated', 'corrected')) as concept
  from f left join {base.QUALITY_SQL} q on q.table_name = t)
select analysis_id, t as table_name, coverage_pct, cast(needed as int) as columns_needed,
  cast(present as int) as columns_present, quality_pct, concept,
  case when n_assumptions >= 3 or coalesce(quality_pct < 70, false) then 'weak'
    when (coalesce(quality_pct >= 98, false) or concept is not null) and n_assumptions = 0
      then 'strong'
    when n_assumptions >= 1 or coalesce(quality_pct < 90, false) then 'medium'
    when quality_pct is not null then 'strong' else 'medium' end as level
from g)"""


@query("X6_table_proof", f"select * from {PROOF_SQL}")
def _(spark, sf):
    columns = catalog.table_columns(spark, tables(spark, sf), "main")
    return X.table_proof(base.audit(spark, sf), columns, base.quality_scores(spark, sf),
                         key_mappings(spark))


@query("X7_sources", f"""
with x as (select analysis_id, unnest(names) as t, unnest(range(len(names))) as pos
  from {NAMED_SQL})
select analysis_id, t as table_name, case when pos = 0 then 'main' else 'joined' end as role,
  cast(round_even(score * 100, 0) as int) as quality_pct,
  case when coalesce(round_even(score * 100, 0) < 70, false) then 'weak'
    when round_even(score * 100, 0) >= 98 then 'strong'
    when round_even(score * 100, 0) < 90 then 'medium'
    when score is not null then 'strong' else 'medium' end as level
from x left join {base.QUALITY_SQL} q on q.table_name = t
""")
def _(spark, sf):
    return X.sources(base.audit(spark, sf), base.quality_scores(spark, sf))

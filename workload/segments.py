"""What drives the order amount: orders joined to customers, in all dimensions at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyglass.functions.buckets import Bands, month_key, year_key
from tallyglass.operators import profile as P, segments as G
from tallyglass.operators.segments import Dimension
from tallyglass.plans import analysis
from tallyglass.sources import catalog
from workload import base
from workload.base import profile_sql, query, table, tables

AMOUNT = "cast(o_totalprice + (age - 18) * 1800 as decimal(18,2))"
BASE_SQL = (f"(select o.*, c.*, {AMOUNT} as amount from orders o "
            f"join {base.CONTACTS_SQL} c on o_custkey = c_custkey)")
DIMENSIONS_SQL = {
    "o_orderstatus": ("categorical", "o_orderstatus"),
    "o_orderpriority": ("categorical", "o_orderpriority"),
    "c_mktsegment": ("categorical", "c_mktsegment"),
    "age (band)": ("band", "concat(cast(18 + cast(trunc((age - 18) / 11.0) as bigint) * 11 as "
                           "varchar), '–', cast(28 + cast(trunc((age - 18) / 11.0) as bigint) "
                           "* 11 as varchar))"),
    "year": ("temporal", "strftime(o_orderdate, '%Y')"),
    "o_orderdate (month)": ("temporal", "strftime(o_orderdate, '%Y-%m')"),
    "delivery": ("categorical", "delivery"),
}


def base_table(spark, sf):
    return table(spark, sf, "orders").join(
        base.contacts(spark, sf), F.col("o_custkey") == F.col("c_custkey")
    ).withColumn("amount", F.expr(AMOUNT))


def dims():
    return [
        Dimension.category("o_orderstatus"), Dimension.category("o_orderpriority"),
        Dimension.category("c_mktsegment"), Dimension.band("age", Bands(18, 11)),
        Dimension("year", "temporal", "o_orderdate", year_key("o_orderdate")),
        Dimension.month("o_orderdate"), Dimension.category("delivery"),
    ]


def segments(spark, sf):
    return G.segment_by(base_table(spark, sf), dims(), "amount")


SEGMENTS_SQL = "(select *, total / cast(n as double) as avg from (" + " union all ".join(
    f"select '{name}' as dimension, '{kind}' as kind, {label} as label, count(*) as n, "
    f"sum(amount) as total from {BASE_SQL} where {label} is not null group by 3"
    for name, (kind, label) in DIMENSIONS_SQL.items()
) + ") qualify count(*) over (partition by dimension) between 2 and 25)"

STATS_SQL = f"""(
select dimension, kind, count(*) as groups, max(share) as top_share, sum(share * share) as hhi,
  stddev_pop(avg) / avg(avg) as cv,
  stddev_pop(avg) / avg(avg) + greatest(sum(share * share) - 1.0 / count(*), 0)
    + case when count(*) <= 8 then 0.03 else 0 end as power,
  arg_min(label, (-cast(total as double), label)) as top_label
from (select *, greatest(cast(total as double), 0)
        / sum(greatest(cast(total as double), 0)) over (partition by dimension) as share
      from {SEGMENTS_SQL})
group by dimension, kind)"""
RANKED_SQL = (f"(select *, cast(row_number() over (order by power desc, dimension) as int) "
              f"as place from {STATS_SQL})")


@query("G1_fact_table", f"""
select s.table_name, count(e.to_table) as n_outgoing, any_value(n_rows) as n_rows
from {base.sizes_sql(base.ALL)} s left join {base.EDGES_SQL} e on e.from_table = s.table_name
group by s.table_name order by n_outgoing desc, n_rows desc, s.table_name limit 1
""".replace("edges(from_table", "e(from_table").replace(") e on", ") on"))
def _(spark, sf):
    return G.pick_fact(catalog.row_counts(tables(spark, sf)), base.edges(spark))


ALL_PARTS = [base.plain_part(n) for n in base.ALL]


@query("G2_measure_choice", f"""
select table_name, min_by(column_name, ordinal) filter (
    kind in ('integer', 'number') and pii_type is null
    and not regexp_matches(lower(column_name), '(^id|_id|key)$')
    and (""" + " or ".join(f"contains(lower(column_name), '{h}')"
                           for h in base.fixed.MEASURE_HINTS) + f""")) as measure
from ({profile_sql(*ALL_PARTS)}) group by table_name
""")
def _(spark, sf):
    known = tables(spark, sf)
    profiles = P.profile_all(known)
    columns = catalog.build_catalog(known, P.primary_keys(profiles))[1]
    return G.pick_measure(columns, profiles)


def knowledge(spark, sf, names=("region", "nation", "customer", "orders")):
    return analysis.learn(tables(spark, sf, names))


@query("G3_candidate_dimensions", """
select dimension, kind, count(*) as groups, cast(sum(n) as bigint) as n from (
  select 'o_orderstatus' as dimension, 'categorical' as kind, o_orderstatus as label,
    count(*) as n from orders group by all
  union all select 'o_orderpriority', 'categorical', o_orderpriority, count(*) from orders
    group by all
  union all select 'o_orderdate by month', 'temporal', strftime(o_orderdate, '%Y-%m'), count(*)
    from orders group by all
  union all select 'c_mktsegment (customer)', 'categorical', c_mktsegment, count(*)
    from orders join customer on o_custkey = c_custkey group by all
  union all select 'c_acctbal bands (customer)', 'band',
    cast(cast(trunc((c_acctbal - lo) / width) as bigint) as varchar), count(*)
    from orders join customer on o_custkey = c_custkey,
      (select trunc(min(c_acctbal)) as lo,
        greatest(1, round_even((max(c_acctbal) - min(c_acctbal)) / 5, 0)) as width from customer)
    group by all)
group by all
""")
def _(spark, sf):
    known = knowledge(spark, sf)
    subject = analysis.choose_subject(known, "orders")
    return G.segment_by(subject.base, subject.dims, max_groups=10_000).groupBy(
        "dimension", "kind").agg(F.count("*").alias("groups"), F.sum("n").alias("n"))


@query("G4_numeric_bands", """
with lim as (select trunc(min(l_extendedprice)) as lo,
  cast(greatest(1, round_even((max(l_extendedprice) - min(l_extendedprice)) / 5, 0)) as bigint)
    as width from lineitem),
b as (select cast(trunc((l_extendedprice - lo) / width) as bigint) as band,
  cast(lo as bigint) as lo, width from lineitem, lim)
select band, concat(cast(lo + band * width as varchar), '–',
  cast(lo + band * width + width - 1 as varchar)) as label, count(*) as n
from b group by band, lo, width
""")
def _(spark, sf):
    return G.numeric_bands(table(spark, sf, "lineitem"), "l_extendedprice")


@query("G5_month_and_year_keys", """
select strftime(l_shipdate, '%Y-%m') as month, strftime(l_shipdate, '%Y') as year, count(*) as n
from lineitem group by all
""")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy(
        month_key("l_shipdate").alias("month"), year_key("l_shipdate").alias("year")
    ).agg(F.count("*").alias("n"))


def rounded(df, *columns, digits=6):
    return df.select(*[
        F.round(F.col(c).cast("double"), digits).alias(c) if c in columns else F.col(c)
        for c in df.columns
    ])


@query("G6_segmentation", f"""
select dimension, kind, label, n, cast(total as double) as total, round(avg, 4) as avg
from {SEGMENTS_SQL}
""")
def _(spark, sf):
    return rounded(segments(spark, sf).withColumn("total", F.col("total").cast("double")),
                   "avg", digits=4)


MORE_SQL = {f"order day {d}": f"cast((o_orderkey + {d}) % {d + 2} as varchar)" for d in range(10)}


@query("G6_segmentation_by_ten", " union all ".join(
    f"select '{name}' as dimension, {label} as label, count(*) as n from orders group by 2"
    for name, label in MORE_SQL.items()))
def _(spark, sf):
    ten = [Dimension(name, "categorical", "o_orderkey", F.expr(label.replace("varchar", "string")))
           for name, label in MORE_SQL.items()]
    return G.segment_by(table(spark, sf, "orders"), ten).select("dimension", "label", "n")


@query("G7_segment_stats", f"""
select dimension, kind, groups, round(top_share, 6) as top_share, round(hhi, 6) as hhi,
  round(cv, 6) as cv, round(power, 6) as power, top_label from {STATS_SQL}
""")
def _(spark, sf):
    return rounded(G.segment_stats(segments(spark, sf)), "top_share", "hhi", "cv", "power")


TOP_SQL = f"""
select r.place, s.dimension, s.rank, s.label, cast(s.total as double) as value,
  round(s.share, 4) as share, s.n, round(s.avg, 4) as avg
from (select *, cast(row_number() over (partition by dimension order by total desc, label) as int)
        as rank, total / sum(total) over (partition by dimension) * 100 as share
      from {SEGMENTS_SQL}) s
join {RANKED_SQL} r on r.dimension = s.dimension
"""


@query("G8_top_segments", f"{TOP_SQL} where place <= 4 and rank <= 4")
def _(spark, sf):
    groups = segments(spark, sf)
    return rounded(G.top_segments(groups, G.segment_stats(groups)), "share", "avg", digits=4)


@query("G9_drivers", f"""
with spread as (
  select dimension, count(avg) as k, min(avg) as lo, max(avg) as hi,
    arg_min(label, (avg, label)) as low_label, arg_max(label, (avg, label)) as high_label
  from {SEGMENTS_SQL} group by dimension)
select place, r.dimension,
  case when k >= 3 and hi / lo >= 1.2 then 'gradient' else 'concentration' end as driver,
  case when k >= 3 and hi / lo >= 1.2 then low_label else top_label end as from_label,
  case when k >= 3 and hi / lo >= 1.2 then high_label end as to_label,
  round(case when k >= 3 and hi / lo >= 1.2 then hi / lo else top_share end, 6) as strength
from {RANKED_SQL} r join spread s on s.dimension = r.dimension where place <= 3
""")
def _(spark, sf):
    groups = segments(spark, sf)
    return rounded(G.drivers(groups, G.segment_stats(groups)), "strength")


CROSSTAB_SQL = f"""(
select {DIMENSIONS_SQL['age (band)'][1]} as a, c_mktsegment as b, count(*) as n,
  sum(amount) as total
from {BASE_SQL} group by all)"""


def cross(spark, sf, k=None):
    return G.crosstab(base_table(spark, sf), Dimension.band("age", Bands(18, 11)),
                      Dimension.category("c_mktsegment"), "amount", k)


@query("G10_crosstab", f"""select a, b, n, cast(total as double) as total from {CROSSTAB_SQL}
order by total desc, a, b limit 12""")
def _(spark, sf):
    return cross(spark, sf, 12).withColumn("total", F.col("total").cast("double"))


@query("G10_crosstab_margins", f"""
select a, b, cast(grouping(a, b) as int) as grouping_id, cast(sum(n) as bigint) as n,
  cast(sum(total) as double) as total
from {CROSSTAB_SQL} where a is not null and b is not null group by cube (a, b)
""")
def _(spark, sf):
    return G.crosstab_margins(base_table(spark, sf), Dimension.band("age", Bands(18, 11)),
                              Dimension.category("c_mktsegment"), "amount").withColumn(
        "total", F.col("total").cast("double"))


@query("G11_dominant_cell", f"""
select a, b, cast(total as double) as value, round(share, 6) as share
from (select *, cast(total as double) / sum(cast(total as double)) over () as share
      from {CROSSTAB_SQL}) order by total desc, a, b limit 1
""")
def _(spark, sf):
    return rounded(G.dominant_cell(cross(spark, sf)), "share")


# One year out of seven far above the others.
SKEWED = "case when cast(o_orderdate as string) like '1998%' then amount * 9 else amount end"


@query("G12_atypical_segments", f"""
select dimension, label, round(avg, 4) as avg, round(m, 4) as mean_of_means
from (select *, avg(avg) over w as m, stddev_pop(avg) over w as sd, count(avg) over w as k
      from {SEGMENTS_SQL.replace("sum(amount)", f"sum({SKEWED})")}
      window w as (partition by dimension))
where k >= 4 and sd > 0 and avg - m > 2 * sd
qualify row_number() over (partition by dimension order by total desc, label) = 1
""")
def _(spark, sf):
    groups = G.segment_by(base_table(spark, sf), dims(), F.expr(SKEWED))
    return rounded(G.atypical_segments(groups), "avg", "mean_of_means", digits=4)


@query("G13_segment_flags", f"""
with ranked as (select * from {RANKED_SQL}),
dom as (select a, b, share from (
  select *, cast(total as double) / sum(cast(total as double)) over () as share
  from {CROSSTAB_SQL}) order by total desc, a, b limit 1),
flags as (
  select 'concentration' as flag, dimension, top_label as label, top_share as strength
  from ranked where place = 1 and top_share > 0.5
  union all select 'target', 'crosstab', a || ' / ' || b, share from dom
  union all select * from (select 'axis', dimension, top_label, cv from ranked where cv > 0.3
    order by place limit 1))
select flag, dimension, label, round(strength, 6) as strength from flags
union all select 'balanced', null, null, null where not exists (select 1 from flags)
""")
def _(spark, sf):
    stats = G.segment_stats(segments(spark, sf))
    return rounded(G.segment_flags(stats, cross(spark, sf)), "strength")


DEEP_SEGMENTS = f"({TOP_SQL} where place <= 4 and rank <= 4)"


@query("G14_deep_analysis", f"""
with ranked as (select * from {RANKED_SQL}),
spread as (
  select dimension, count(avg) as k, min(avg) as lo, max(avg) as hi,
    arg_min(label, (avg, label)) as low_label, arg_max(label, (avg, label)) as high_label
  from {SEGMENTS_SQL} group by dimension)
select 'segment' as section, dimension, label, cast(null as varchar) as other,
  round(value, 4) as value, n from {DEEP_SEGMENTS}
union all
select 'driver', r.dimension,
  case when k >= 3 and hi / lo >= 1.2 then 'gradient' else 'concentration' end,
  case when k >= 3 and hi / lo >= 1.2 then low_label || ' -> ' || high_label else top_label end,
  round(case when k >= 3 and hi / lo >= 1.2 then hi / lo else top_share end, 4), null
from ranked r join spread s on s.dimension = r.dimension where place <= 3
union all
select 'atypical', dimension, label, null, round(avg, 4), null
from (select *, avg(avg) over w as m, stddev_pop(avg) over w as sd, count(avg) over w as k
      from {SEGMENTS_SQL} window w as (partition by dimension))
where k >= 4 and sd > 0 and avg - m > 2 * sd
qualify row_number() over (partition by dimension order by total desc, label) = 1
""")
def _(spark, sf):
    subject = analysis.Subject("orders", base_table(spark, sf), "amount", dims())
    report = analysis.deep_analysis(subject)
    # The crosstab and its flags have queries of their own (G10, G11, G13).
    return rounded(report.where("section in ('segment', 'driver', 'atypical')").drop(
        "place", "share"), "value", digits=4)


# What the catalog of these four tables leads to: orders, o_totalprice, and these dimensions.
CATALOG_BASE = "(select *, cast(o_totalprice as decimal(18,2)) as amount from orders " \
               "join customer on o_custkey = c_custkey)"
BAND = "(select cast(trunc(min(c_acctbal)) as bigint) as lo, greatest(1, cast(round_even(" \
       "(max(c_acctbal) - min(c_acctbal)) / 5, 0) as bigint)) as width from customer)"
START = f"(select cast(trunc((c_acctbal - lo) / width) as bigint) * width + lo from {BAND})"
CATALOG_DIMENSIONS = {
    "o_orderstatus": ("categorical", "o_orderstatus"),
    "o_orderdate by month": ("temporal", "strftime(o_orderdate, '%Y-%m')"),
    "o_orderpriority": ("categorical", "o_orderpriority"),
    "c_acctbal bands (customer)": (
        "band", f"concat(cast({START} as varchar), '–', cast({START} + (select width from {BAND}) - 1 "
                "as varchar))"),
    "c_mktsegment (customer)": ("categorical", "c_mktsegment"),
}
CATALOG_SEGMENTS = "(select *, total / cast(n as double) as avg from (" + " union all ".join(
    f"select '{name}' as dimension, '{kind}' as kind, label, count(*) as n, sum(amount) as total "
    f"from (select {label} as label, amount from {CATALOG_BASE}) where label is not null group by 3"
    for name, (kind, label) in CATALOG_DIMENSIONS.items()
) + ") qualify count(*) over (partition by dimension) between 2 and 25)"
CATALOG_CELLS = " union all ".join(
    f"select '{x}' as x, '{y}' as y, a, b, count(*) as n, sum(amount) as total "
    f"from (select {CATALOG_DIMENSIONS[x][1]} as a, {CATALOG_DIMENSIONS[y][1]} as b, amount "
    f"from {CATALOG_BASE}) where a is not null and b is not null group by a, b"
    for x in CATALOG_DIMENSIONS for y in CATALOG_DIMENSIONS if x != y)


@query("G14_deep_analysis_of_the_catalog", f"""
with s as {CATALOG_SEGMENTS},
ranked as (select *, cast(row_number() over (order by power desc, dimension) as int) as place
  from {STATS_SQL.replace(SEGMENTS_SQL, 's')}),
top as (select r.place, s.dimension, s.label, s.n, cast(total as double) as value,
    cast(row_number() over (partition by s.dimension order by total desc, label) as int) as rank,
    cast(total as double) / sum(cast(total as double)) over (partition by s.dimension) * 100 as share
  from s join ranked r on r.dimension = s.dimension),
spread as (select dimension, count(avg) as k, min(avg) as lo, max(avg) as hi,
    arg_min(label, (avg, label)) as low_label, arg_max(label, (avg, label)) as high_label
  from s group by dimension),
pair as (select (select dimension from ranked where place = 1) as x, dimension as y from ranked
  where place > 1 order by (select kind from ranked where place = 1) <> 'temporal'
    and kind = 'temporal', place limit 1),
cells as (select c.* from ({CATALOG_CELLS}) c join pair on pair.x = c.x and pair.y = c.y),
flags as (
  select 'concentration' as flag, dimension, top_label as label, top_share as strength
  from ranked where place = 1 and top_share > 0.5
  union all select * from (select 'target', 'crosstab', a || ' / ' || b,
    cast(total as double) / sum(cast(total as double)) over () from cells order by total desc, a, b
    limit 1)
  union all select * from (select 'axis', dimension, top_label, cv from ranked where cv > 0.3
    order by place limit 1))
select 'segment' as section, rank as place, dimension, label, cast(null as varchar) as other,
  round(value, 4) as value, round(share, 6) as share, n from top where place <= 4 and rank <= 4
union all
select 'driver', place, r.dimension,
  case when k >= 3 and hi / lo >= 1.2 then 'gradient' else 'concentration' end,
  case when k >= 3 and hi / lo >= 1.2 then low_label || ' -> ' || high_label else top_label end,
  round(case when k >= 3 and hi / lo >= 1.2 then hi / lo else top_share end, 4), null, null
from ranked r join spread p on p.dimension = r.dimension where place <= 3
union all
select 'atypical', 1, dimension, label, null, round(avg, 4), null, null
from (select *, avg(avg) over w as m, stddev_pop(avg) over w as sd, count(avg) over w as k
      from s window w as (partition by dimension))
where k >= 4 and sd > 0 and avg - m > 2 * sd
qualify row_number() over (partition by dimension order by total desc, label) = 1
union all
select * from (select 'crosstab', 1, x || ' x ' || y, a, b, round(cast(total as double), 4), null, n
  from cells order by total desc, a, b limit 6)
union all
select 'flag', 1, dimension, label, flag, round(strength, 4), null, null from (
  select * from flags union all select 'balanced', null, null, null where not exists (from flags))
""")
def _(spark, sf):
    report = analysis.deep_analysis(analysis.choose_subject(knowledge(spark, sf)),
                                    F.col("o_totalprice").cast("decimal(18,2)"))
    return rounded(rounded(report, "value", digits=4), "share")


@query("V1_investigation", f"""
with ranked as (select *, cast(row_number() over (order by power desc, dimension) as int) as pl
  from {STATS_SQL}),
line as (select strftime(o_orderdate, '%Y-%m') as p, cast(sum(amount) as double) as v
  from {BASE_SQL} group by all),
direction as (select case when pct < -2 then 'down' when pct > 2 then 'up' else 'stable' end
  from (select (max_by(v, p) - min_by(v, p)) / abs(min_by(v, p)) * 100 as pct from line)),
spread as (
  select dimension, count(avg) as k, min(avg) as lo, max(avg) as hi,
    arg_min(label, (avg, label)) as low_label, arg_max(label, (avg, label)) as high_label
  from {SEGMENTS_SQL} group by dimension),
found as (select r.dimension, case when k >= 3 and hi / lo >= 1.2
    then 'gradient ' || low_label || ' -> ' || high_label else 'concentration ' || top_label end
    as finding
  from ranked r join spread s on s.dimension = r.dimension)
select r.pl as step_no, s.dimension as step, s.label, round(s.value, 4) as value, s.rank as place,
  finding as detail
from ({TOP_SQL}) s join ranked r on r.dimension = s.dimension
join found f on f.dimension = s.dimension where s.rank <= 4
union all select 0, 'trend', min(p), round(min_by(v, p), 4), 1, (from direction) from line
union all select 0, 'trend', max(p), round(max_by(v, p), 4), 2, (from direction) from line
union all select 0, 'trend', arg_min(p, (v, p)), round(min(v), 4), 3, (from direction) from line
union all select 99, d, 'rejected', null, 1, 'no usable groups' from (values {", ".join(f"('{d}')" for d in DIMENSIONS_SQL)})
  as t(d) where d not in (select dimension from {SEGMENTS_SQL})
""")
def _(spark, sf):
    subject = analysis.Subject("orders", base_table(spark, sf), "amount", dims())
    return rounded(analysis.investigate(subject, "o_orderdate"), "value", digits=4)


@query("V2_key_drivers", f"""
select place, dimension, label, share from ({TOP_SQL}) where place <= 3 and rank = 1
""")
def _(spark, sf):
    groups = segments(spark, sf)
    return rounded(G.key_drivers(groups, G.segment_stats(groups)), "share", digits=4)


@query("W1_projection", f"""
select count(*) as n, round(cast(sum(amount) as double), 4) as total,
  round(avg(cast(amount as double)), 4) as mean,
  round(cast(sum(amount) as double) * 1.1, 2) as projected,
  round(cast(sum(amount) as double) * 1.1 - cast(sum(amount) as double), 2) as delta,
  cast(10 as double) as pct
from {BASE_SQL}
""")
def _(spark, sf):
    return rounded(rounded(G.project(base_table(spark, sf), "amount", 10), "total", "mean",
                           digits=4), "projected", "delta", digits=2)


@query("W2_gain_allocation", f"""
select dimension, rank, label, round(share, 6) as share, round(gain, 2) as gain from (
  select dimension, label,
    cast(row_number() over (order by total desc, label) as int) as rank,
    cast(total as double) / sum(cast(total as double)) over () as share,
    0.1 * sum(cast(total as double)) over ()
      * cast(total as double) / sum(cast(total as double)) over () as gain
  from {SEGMENTS_SQL} where dimension = 'c_mktsegment')
where rank <= 4
""")
def _(spark, sf):
    groups = segments(spark, sf)
    plan = G.project(base_table(spark, sf), "amount", 10)
    return rounded(rounded(G.allocate_gain(
        groups, plan.select("delta").scalar(), "c_mktsegment"), "share"), "gain", digits=2)


@query("W2_what_if", f"""
with whole as (select cast(sum(amount) as double) as total from {BASE_SQL})
select round(w.total, 4) as total, round(w.total * 1.1, 2) as projected,
  round(w.total * 1.1 - w.total, 2) as delta, dimension, rank, label, round(share, 6) as share,
  round((w.total * 1.1 - w.total) * share, 2) as gain
from (select dimension, label, cast(row_number() over (order by total desc, label) as int) as rank,
    cast(total as double) / sum(cast(total as double)) over () as share
  from {SEGMENTS_SQL} where dimension = 'o_orderstatus'), whole w
where rank <= 4
""")
def _(spark, sf):
    subject = analysis.Subject("orders", base_table(spark, sf), "amount", dims())
    return rounded(rounded(rounded(analysis.what_if(subject, 10), "share"), "total", digits=4),
                   "projected", "delta", "gain", digits=2)

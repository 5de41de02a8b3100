"""Orders by month and events by day, read for what stands out."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyglass.functions.buckets import time_bucket
from tallyglass.operators import series as T
from workload.base import query, table
from workload.segments import rounded

# A series with a planted collapse, a planted jump and a rising end.
AMOUNT = ("cast(case when strftime(o_orderdate, '%Y-%m') = '1997-03' then o_totalprice * 0.2 "
          "when strftime(o_orderdate, '%Y-%m') = '1999-06' then o_totalprice * 3 "
          "when o_orderdate >= timestamp '2001-01-01' then o_totalprice * 2 "
          "else o_totalprice end as decimal(18,2))")
SPARK_AMOUNT = AMOUNT.replace("strftime(o_orderdate, '%Y-%m')",
                              "date_format(o_orderdate, 'yyyy-MM')").replace(
    "timestamp '2001", "timestamp_ntz '2001")
LINE_SQL = (f"(select strftime(o_orderdate, '%Y-%m') as period, cast(sum({AMOUNT}) as double) "
            f"as value from orders where o_orderdate is not null group by all)")


def line(spark, sf):
    return T.monthly_series(table(spark, sf, "orders"), "o_orderdate", F.expr(SPARK_AMOUNT))


@query("T1_monthly_series", f"select period, round(value, 2) as value from {LINE_SQL}")
def _(spark, sf):
    return rounded(line(spark, sf), "value", digits=2)


@query("T1_monthly_counts", """
select strftime(l_shipdate, '%Y-%m') as period, cast(count(*) as double) as value
from lineitem group by all
""")
def _(spark, sf):
    return T.monthly_series(table(spark, sf, "lineitem"), "l_shipdate")


ENDS = f"""(select count(*) as n, min(period) as first_period, min_by(value, period)
  as first_value, max(period) as last_period, max_by(value, period) as last_value,
  arg_min(period, (value, period)) as low_period, min(value) as low_value,
  (max_by(value, period) - min_by(value, period)) / abs(min_by(value, period)) * 100 as pct
  from {LINE_SQL})"""


@query("T2_trend", f"""
select case when pct < 0 then 'trend' else 'opportunity' end as category,
  case when pct <= -25 then 'high' when pct < 0 then 'medium' else 'low' end as severity,
  case when pct < 0 then 'important' else 'opportunity' end as level,
  first_period, round(first_value, 2) as first_value, last_period,
  round(last_value, 2) as last_value, round(pct, 4) as pct
from {ENDS} where n >= 3 and abs(pct) >= 5
""")
def _(spark, sf):
    return rounded(rounded(T.trend(line(spark, sf)), "first_value", "last_value", digits=2),
                   "pct", digits=4)


@query("T3_period_drops", f"""
select period, round(previous, 2) as previous, round(value, 2) as value,
  round((previous - value) / previous * 100, 4) as drop_pct
from (select *, lag(value) over (order by period) as previous from {LINE_SQL})
where (value - previous) / previous <= -0.3
""")
def _(spark, sf):
    return rounded(rounded(T.period_drops(line(spark, sf)), "previous", "value", digits=2),
                   "drop_pct", digits=4)


OUTLIERS_SQL = f"""(select * from (select *, avg(value) over () as mean,
  stddev_pop(value) over () as sd, count(*) over () as n from {LINE_SQL})
  where n >= 6 and sd > 0 and abs(value - mean) > 2 * sd)"""


@query("T4_outlier_periods", f"""
select period, round(value, 2) as value, round(mean, 2) as mean, round(sd, 2) as sd
from {OUTLIERS_SQL}
""")
def _(spark, sf):
    return rounded(T.outliers(line(spark, sf)), "value", "mean", "sd", digits=2)


@query("T5_trend_step", f"""
select case when pct < -2 then 'down' when pct > 2 then 'up' else 'stable' end as direction,
  first_period, round(first_value, 2) as first_value, last_period,
  round(last_value, 2) as last_value, low_period, round(low_value, 2) as low_value,
  round(pct, 4) as pct from {ENDS}
""")
def _(spark, sf):
    return rounded(rounded(T.trend_step(line(spark, sf)), "first_value", "last_value",
                           "low_value", digits=2), "pct", digits=4)


DAILY_SQL = """(select cast(date_trunc('day', ts) as date) as day,
  cast(sum(cast(value as decimal(18,2))) as double) as value from events group by all)"""


def daily(spark, sf):
    return table(spark, sf, "events").groupBy(time_bucket("ts", "day").alias("day")).agg(
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"))


@query("T6_read_series", f"""
select case when pct > 5 then 'rise' when pct < -5 then 'fall' else 'stable' end as direction,
  first_value, last_value, round(pct, 4) as pct, max_value, max_period, min_value, min_period
from (select min_by(value, day) as first_value, max_by(value, day) as last_value,
  (max_by(value, day) - min_by(value, day)) / abs(min_by(value, day)) * 100 as pct,
  max(value) as max_value, arg_min(day, (-value, day)) as max_period,
  min(value) as min_value, arg_min(day, (value, day)) as min_period, count(*) as n
  from {DAILY_SQL}) where n >= 3
""")
def _(spark, sf):
    return rounded(T.read_series(daily(spark, sf), "day", "value"), "pct", digits=4)


@query("T7_ruptures", f"""
select day as period, previous, value, round((value - previous) / abs(previous) * 100, 4) as pct
from (select *, lag(value) over (order by day) as previous from {DAILY_SQL})
where abs(value - previous) / abs(previous) > 0.05
""")
def _(spark, sf):
    return rounded(T.ruptures(daily(spark, sf), "day", "value", threshold=0.05), "pct", digits=4)


@query("T7_ruptures_of_raw_events", """
select event_type, ts as period, previous, value,
  round((value - previous) / abs(previous) * 100, 4) as pct
from (select *, lag(value) over (partition by event_type order by ts) as previous from events)
where abs(value - previous) / abs(previous) > 0.3
""")
def _(spark, sf):
    return rounded(T.ruptures(table(spark, sf, "events"), "ts", "value", keys=("event_type",)),
                   "pct", digits=4)


@query("T8_concentration", """
select top_label, top_value, total, round(top_value / total * 100, 4) as share,
  top_value / total > 0.5 as concentrated, round(top_value / least, 4) as spread,
  top_value / least > 10 as wide
from (select arg_min(p_type, (-v, p_type)) as top_label, max(v) as top_value, sum(v) as total,
  min(v) as least from (
    select p_type, cast(sum(p_size * case when p_type = 'ECONOMY' then 40 else 1 end) as double)
      as v from part group by p_type))
""")
def _(spark, sf):
    sizes = table(spark, sf, "part").groupBy("p_type").agg(
        F.expr("cast(sum(p_size * case when p_type = 'ECONOMY' then 40 else 1 end) as double)")
        .alias("v"))
    return rounded(T.concentration(sizes, "p_type", "v"), "share", "spread", digits=4)


@query("T9_result_outliers", """
select o_orderkey as label, value, round(mean, 4) as mean
from (select *, avg(value) over () as mean, stddev_samp(value) over () as sd from (
  select o_orderkey, case when o_orderkey % 40 = 3 then o_totalprice * 9 else o_totalprice end
    as value from orders))
where abs(value - mean) > 2 * sd order by o_orderkey limit 3
""")
def _(spark, sf):
    odd = table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "case when o_orderkey % 40 = 3 then o_totalprice * 9 else o_totalprice end as value")
    return rounded(T.result_outliers(odd, "value", "o_orderkey"), "mean", digits=4)

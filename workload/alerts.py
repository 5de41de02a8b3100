"""Alerts on the test tables, their replay over daily values, and product metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyglass.functions.buckets import time_bucket
from tallyglass.operators import alerts as M
from tallyglass.session import ensure_checkpoint_dir
from tallyglass.streaming import alerts as owned
from workload import base
from workload.base import query, table, tables
from workload.shapes import _definitions

ALERTS = [
    ("many_orders", "orders", "count(*)", None, None, "gt", 100.0),
    ("revenue", None, None, None, "revenue", "lt", 1e15),
    ("returned", "lineitem", "count(*)", "l_returnflag = 'R'", None, "gt", 1e9),
    ("returned_quantity", "lineitem", "sum(l_quantity)", "l_returnflag = 'R'", None, "pct_drop",
     20.0),
    ("customers", "customer", "count(*)", None, None, "pct_change", 10.0),
    ("mean_size", "part", "avg(p_size)", None, None, "pct_change", 10.0),
    ("nothing", "part", "sum(p_size)", "p_size < 0", None, "gt", 1.0),
]
STATE = [("returned_quantity", 1e9, 5.0, "ok"), ("mean_size", 0.0, None, "ok"),
         ("many_orders", 7.0, 6.0, "ok"), ("nothing", 4.0, 3.0, "ok")]
ALERT_SCHEMA = ("alert_id string, table_name string, expression string, filter string, "
                "definition string, comparison string, threshold double")
STATE_SCHEMA = ("alert_id string, last_value double, previous_value double, "
                "last_status string")


def alerts(spark):
    return spark.createDataFrame(ALERTS, ALERT_SCHEMA)


def state(spark):
    return spark.createDataFrame(STATE, STATE_SCHEMA)


def values(spark, sf):
    return M.alert_values(alerts(spark), tables(spark, sf), _definitions(spark))


VALUES_SQL = """(
select 'many_orders' as alert_id, cast(count(*) as double) as value from orders
union all select 'revenue', cast(sum(cast(o_totalprice as decimal(18,2))) as double) from orders
union all select 'returned', count(*) from lineitem where l_returnflag = 'R'
union all select 'returned_quantity', sum(l_quantity) from lineitem where l_returnflag = 'R'
union all select 'customers', count(*) from customer
union all select 'mean_size', avg(p_size) from part
union all select 'nothing', sum(p_size) from part where p_size < 0)"""
RULES_SQL = "(values " + ", ".join(
    f"('{a[0]}', '{a[5]}', {a[6]})" for a in ALERTS) + ") as r(alert_id, comparison, threshold)"
STATE_SQL = "(values " + ", ".join(
    f"('{s[0]}', {s[1]}, {'null' if s[2] is None else s[2]}, '{s[3]}')" for s in STATE
) + ") as st(alert_id, last_value, previous_value, last_status)"
FIRED = """case when value is null then 'error'
  when comparison = 'gt' and value > threshold then 'triggered'
  when comparison = 'lt' and value < threshold then 'triggered'
  when comparison = 'pct_drop' and previous <> 0
    and -(value - previous) / abs(previous) * 100 > threshold then 'triggered'
  when comparison = 'pct_change' and previous <> 0
    and abs((value - previous) / abs(previous) * 100) > threshold then 'triggered'
  else 'ok' end"""
SAID = """case when value is null then 'no value'
  when comparison like 'pct%' and previous is null then printf('first value %.2f', value)
  when comparison like 'pct%' and previous = 0 then 'previous value is zero'
  when comparison like 'pct%' then printf('%.1f%% (%.2f to %.2f)',
    (value - previous) / abs(previous) * 100, previous, value)
  else printf('value %.2f against %.2f', value, cast(threshold as double)) end"""
EVALUATED_SQL = f"""(select v.alert_id, value, previous, {FIRED} as status, {SAID} as message
from {VALUES_SQL} v join {RULES_SQL} on r.alert_id = v.alert_id
left join (select alert_id, cast(last_value as double) as previous from {STATE_SQL}) s
  on s.alert_id = v.alert_id)"""


@query("M1_alert_values", f"select alert_id, round(value, 4) as value from {VALUES_SQL}")
def _(spark, sf):
    return values(spark, sf).select("alert_id", F.round("value", 4).alias("value"))


BROKEN = [("bad_column", "orders", "sum(no_such_column)", None, None, "gt", 1.0),
          ("no_table", None, "count(*)", None, None, "gt", 1.0),
          ("lost_table", "no_such_table", "count(*)", None, None, "gt", 1.0)]


@query("M1_values_beside_failing_alerts", f"""
select alert_id, round(value, 4) as value, false as failed from {VALUES_SQL}
union all select x, null, true from (values ('bad_column'), ('no_table'), ('lost_table')) as t(x)
""")
def _(spark, sf):
    every = alerts(spark).union(spark.createDataFrame(BROKEN, ALERT_SCHEMA))
    return M.alert_values(every, tables(spark, sf), _definitions(spark)).select(
        "alert_id", F.round("value", 4).alias("value"), F.col("error").isNotNull().alias("failed"))


def evaluated(spark, sf):
    return M.evaluate_alerts(values(spark, sf), alerts(spark), state(spark))


@query("M2_alert_conditions", f"""
select alert_id, round(value, 4) as value, previous, status, message from {EVALUATED_SQL}
""")
def _(spark, sf):
    return evaluated(spark, sf).withColumn("value", F.round("value", 4))


DAYS = """(select event_type as alert_id, cast(date_trunc('day', ts) as date) as "at",
  case when day(ts) % 9 = 0 then null else cast(sum(cast(value as decimal(18,2))) as double) end
  as value from events group by event_type, cast(date_trunc('day', ts) as date), day(ts))"""
HISTORY_RULES = [("view", "pct_drop", 30.0), ("click", "gt", 3000.0), ("error", "lt", 3000.0),
                 ("signup", "pct_change", 25.0), ("purchase", "pct_drop", 10.0)]
HISTORY_RULES_SQL = "(values " + ", ".join(
    str(r) for r in HISTORY_RULES) + ") as r(alert_id, comparison, threshold)"


@query("M2_alert_history", f"""
select h.alert_id, h."at", value, previous, {FIRED} as status
from (select *, last_value(value ignore nulls) over (partition by alert_id order by "at"
    rows between unbounded preceding and 1 preceding) as previous from {DAYS}) h
join {HISTORY_RULES_SQL} on r.alert_id = h.alert_id
""")
def _(spark, sf):
    days = table(spark, sf, "events").groupBy(
        F.col("event_type").alias("alert_id"), time_bucket("ts", "day").alias("at")
    ).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value")).withColumn(
        "value", F.when(F.dayofmonth("at") % 9 != 0, F.col("value")))
    rules = spark.createDataFrame(HISTORY_RULES, "alert_id string, comparison string, "
                                                 "threshold double")
    return M.evaluate_history(days, rules)


@query("M3_rolled_state", f"""
select coalesce(e.alert_id, s.alert_id) as alert_id,
  round(coalesce(value, last_value), 4) as last_value,
  cast(case when value is not null then last_value else previous_value end as double)
    as previous_value,
  coalesce(status, last_status) as last_status
from {EVALUATED_SQL} e full join (select * from {STATE_SQL}) s on s.alert_id = e.alert_id
""")
def _(spark, sf):
    return M.roll_state(state(spark), evaluated(spark, sf)).withColumn(
        "last_value", F.round("last_value", 4))


@query("M3_alert_events", f"""
select alert_id, timestamp '2024-02-01 00:00:00' as at, round(value, 4) as value, status,
  message
from {EVALUATED_SQL}
""")
def _(spark, sf):
    past = spark.createDataFrame(
        [], "alert_id string, at timestamp_ntz, value double, status string, message string")
    at = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    return M.alert_events(past, evaluated(spark, sf), at).withColumn(
        "value", F.round("value", 4))


AS_OF = "2024-01-30 12:00:00"


def metrics_sql(days: int, by: str | None = None) -> str:
    def n(*states):
        listed = ", ".join(f"'{s}'" for s in states)
        return f"count(*) filter (status in ({listed}))"

    def rate(a, b):
        return f"round({a} / cast(nullif({b}, 0) as double), 4)"

    return f"""select {by + ', ' if by else ''}{days} as window_days, count(*) as total,
      {n('ok')} as n_ok, {n('clarification')} as n_clarification,
      {n('unanswerable')} as n_unanswerable, {n('blocked')} as n_blocked, {n('error')} as n_error,
      round(avg(duration_ms) filter (status = 'ok'), 2) as avg_duration_ms,
      round(avg(confidence) filter (status = 'ok'), 2) as avg_confidence,
      round(avg(estimated_cost) filter (status = 'ok'), 2) as avg_cost,
      {rate(n('ok'), 'count(*)')} as resolution_rate,
      {rate(n('clarification'), 'count(*)')} as clarification_rate,
      {rate(n('ok'), n('ok', 'blocked', 'error'))} as validation_rate
    from {base.AUDIT_SQL} where created_at >= timestamp '{AS_OF}' - interval {days} days
    {'group by ' + by if by else ''}"""


@query("N1_product_metrics", metrics_sql(30))
def _(spark, sf):
    return M.product_metrics(base.audit(spark, sf), AS_OF)


@query("N1_product_metrics_by_kind", metrics_sql(7, "event_type"))
def _(spark, sf):
    return M.product_metrics(base.audit(spark, sf), AS_OF, days=7, by="event_type")


USAGE = ["case event_type when 'view' then 'report_open' when 'click' then 'chart_export' "
         "when 'purchase' then 'insight_drill' when 'signup' then 'whatif_run' else 'hack' end "
         "as event",
         "case when user_id % 7 = 0 then '' else concat('u', cast(user_id % 30 as string)) end "
         "as label"]
USAGE_SQL = f"(select {', '.join(USAGE)} from events)"


@query("N2_usage_by_event", f"""
select event, count(*) as n from {USAGE_SQL} where event <> 'hack' group by event
""")
def _(spark, sf):
    return M.usage(table(spark, sf, "events").selectExpr(*USAGE))[0]


@query("N2_usage_top_keys", f"""
select case when label <> '' then event || ':' || label else event end as key, count(*) as n
from {USAGE_SQL} where event <> 'hack' group by 1 order by n desc, key limit 20
""")
def _(spark, sf):
    return M.usage(table(spark, sf, "events").selectExpr(*USAGE))[1]


WATCHED = [
    ("many", "events", "count(*)", None, None, "gt", 4.0),
    ("views", "events", "count(*)", "event_type = 'view'", None, "pct_drop", 1.0),
    ("spent", "events", "sum(cast(value as decimal(18,2)))", "event_type = 'purchase'", None,
     "pct_change", 0.5),
    ("users", "events", "count(distinct user_id)", None, None, "lt", 10.0),
    ("nothing", "events", "sum(value)", "event_type = 'none'", None, "gt", 0.0),
]
WATCHED_RULES = "(values " + ", ".join(
    f"('{a[0]}', '{a[5]}', {a[6]})" for a in WATCHED) + ") as r(alert_id, comparison, threshold)"
BATCHES = "(select *, event_id % 2 as batch from events)"
WATCHED_SQL = f"""(
select 'many' as alert_id, batch, cast(count(*) as double) as value from {BATCHES} group by batch
union all select 'views', batch, cast(count(*) filter (event_type = 'view') as double) from {BATCHES}
  group by batch
union all select 'spent', batch, cast(sum(cast(value as decimal(18,2)))
  filter (event_type = 'purchase') as double) from {BATCHES} group by batch
union all select 'users', batch, cast(count(distinct user_id) as double) from {BATCHES} group by batch
union all select 'nothing', batch, null from {BATCHES} group by batch)"""
WATCHED_EVENTS_SQL = f"""(
select *, {FIRED} as status, {SAID} as message from (
  select *, lag(value) over (partition by alert_id order by batch) as previous,
    (select max(ts) from events e where e.event_id % 2 = w.batch) as "at" from {WATCHED_SQL} w)
join {WATCHED_RULES} using (alert_id))"""


def watched(spark, sf):
    """The events come in two loads; after each one, a trigger takes what is new."""
    store = f"{ensure_checkpoint_dir(spark)}/alerts-{uuid.uuid4().hex}"
    rows = table(spark, sf, "events")
    rules = spark.createDataFrame(WATCHED, ALERT_SCHEMA)
    for load in (0, 1):
        rows.where(F.col("event_id") % 2 == load).write.mode("append").parquet(f"{store}/source")
        owned.watch(spark, f"{store}/source", rows.schema, "events", rules, store, "ts"
                    ).awaitTermination()
    return store


@query("M2_events_of_a_stream", f"""
select alert_id, batch, "at", round(value, 4) as value, round(previous, 4) as previous, status,
  message
from {WATCHED_EVENTS_SQL}
""")
def _(spark, sf):
    return owned.events(spark, watched(spark, sf)).withColumns(
        {c: F.round(c, 4) for c in ("value", "previous")})


@query("M3_state_of_a_stream", f"""
select alert_id, round(value, 4) as last_value, round(previous, 4) as previous_value,
  status as last_status
from {WATCHED_EVENTS_SQL} where batch = 1
""")
def _(spark, sf):
    return owned.state(spark, watched(spark, sf)).withColumns(
        {c: F.round(c, 4) for c in ("last_value", "previous_value")})

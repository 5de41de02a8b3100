"""The shapes a measure question can take."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyglass.functions.buckets import UNITS, time_bucket
from tallyglass.operators import query as Q
from workload.base import query, table, tables

MONEY = "cast(o_totalprice as decimal(18,2))"


def _orders(spark, sf):
    return table(spark, sf, "orders").withColumn("o_totalprice", F.expr(MONEY))


@query("Q1_preview", """
select c_custkey, c_name, c_nationkey from customer order by c_custkey limit 100
""")
def _(spark, sf):
    return Q.preview(table(spark, sf, "customer"), 100, max_cols=3, order_by="c_custkey")


@query("Q2_row_count", "select count(*) as total from lineitem")
def _(spark, sf):
    return Q.count_rows(table(spark, sf, "lineitem"))


@query("Q3_count_by_status", "select o_orderstatus, count(*) as total from orders group by 1")
def _(spark, sf):
    return Q.count_by(table(spark, sf, "orders"), "o_orderstatus")


@query("Q3_count_by_week", """
select cast(date_trunc('week', o_orderdate) as date) as week, count(*) as total
from orders group by 1
""")
def _(spark, sf):
    return Q.count_by(table(spark, sf, "orders"), ("o_orderdate", "week"))


@query("Q4_total", f"select sum({MONEY}) as sum_o_totalprice from orders")
def _(spark, sf):
    return Q.aggregate(_orders(spark, sf), "o_totalprice", "sum")


@query("Q4_average", "select round(avg(l_quantity), 6) as avg_l_quantity from lineitem")
def _(spark, sf):
    return Q.aggregate(table(spark, sf, "lineitem"), "l_quantity", "avg").select(
        F.round("avg_l_quantity", 6).alias("avg_l_quantity"))


@query("Q5_sum_by_month", f"""
select cast(date_trunc('month', o_orderdate) as date) as month, sum({MONEY}) as sum_o_totalprice
from orders group by 1
""")
def _(spark, sf):
    return Q.aggregate_by(_orders(spark, sf), "o_totalprice", "sum", ("o_orderdate", "month"))


@query("Q5_average_by_priority", """
select o_orderpriority, round(avg(o_totalprice), 4) as avg_o_totalprice from orders group by 1
""")
def _(spark, sf):
    return Q.aggregate_by(table(spark, sf, "orders"), "o_totalprice", "avg", "o_orderpriority"
                          ).select("o_orderpriority",
                                   F.round("avg_o_totalprice", 4).alias("avg_o_totalprice"))


@query("Q6_time_buckets", " union all ".join(
    f"select '{u}' as unit, cast(date_trunc('{u}', l_shipdate) as date) as bucket, "
    f"count(*) as n from lineitem group by 2" for u in UNITS))
def _(spark, sf):
    # All five units from one scan and one shuffle.
    cells = F.array(*[F.struct(F.lit(u).alias("unit"),
                               time_bucket("l_shipdate", u).alias("bucket")) for u in UNITS])
    return table(spark, sf, "lineitem").select(F.inline(cells)).groupBy("unit", "bucket").agg(
        F.count("*").alias("n"))


@query("Q7_top_orders", """
select * from orders order by o_totalprice desc nulls last, o_orderkey limit 10
""")
def _(spark, sf):
    return Q.top_n(table(spark, sf, "orders"), "o_totalprice", 10, tie="o_orderkey")


DEFINITIONS = [
    ("revenue", "measure", "orders", "sum(cast(o_totalprice as decimal(18,2)))", None),
    ("open_revenue", "measure", "orders", "sum(cast(o_totalprice as decimal(18,2)))",
     "o_orderstatus = 'O'"),
    ("big", "segment", "orders", None, "o_totalprice > 300000"),
    ("loyal", "segment", "customer", None,
     "c_custkey in (select o_custkey from orders group by o_custkey having count(*) >= 12)"),
]


def _definitions(spark):
    return spark.createDataFrame(DEFINITIONS, Q.DEFINITION_SCHEMA)


@query("Q8_measure_total", f"select sum({MONEY}) as revenue from orders")
def _(spark, sf):
    return Q.measure(_definitions(spark), "revenue", tables(spark, sf, ["orders"]))


@query("Q8_measure_by_month_in_segment", f"""
select cast(date_trunc('month', o_orderdate) as date) as month, sum({MONEY}) as open_revenue
from orders where o_orderstatus = 'O' and o_totalprice > 300000 group by 1
""")
def _(spark, sf):
    return Q.measure(_definitions(spark), "open_revenue", tables(spark, sf, ["orders"]),
                     ("o_orderdate", "month"), ("big",))


LOYAL = "c_custkey in (select o_custkey from orders group by o_custkey having count(*) >= 12)"


@query("Q9_segment_count", f"select count(*) as total from customer where {LOYAL}")
def _(spark, sf):
    return Q.segment(_definitions(spark), "loyal", tables(spark, sf, ["customer", "orders"]))


@query("Q9_segment_list", f"""
select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer where {LOYAL}
order by c_custkey limit 100
""")
def _(spark, sf):
    return Q.segment(_definitions(spark), "loyal", tables(spark, sf, ["customer", "orders"]),
                     "list", order_by="c_custkey")


OLD_DEFS = ["concat('def_', cast(p_partkey as string)) as name", "'measure' as kind",
            "lower(p_type) as table_name", "concat('sum(', p_brand, ')') as expression",
            "cast(null as string) as filter"]
NEW_DEFS = ["concat('def_', cast(s_suppkey * 3 as string)) as name",
            "case when s_suppkey % 2 = 0 then 'measure' else 'segment' end as kind",
            "'supplier' as table_name",
            "case when s_suppkey % 4 = 0 then '' else 'avg(x)' end as expression",
            "case when s_suppkey % 3 = 0 then null else s_name end as filter"]


@query("Q10_upsert_definitions", f"""
with new as (select {', '.join(NEW_DEFS)} from supplier),
valid as (select * from new where (kind = 'measure' and coalesce(expression, '') <> '')
  or (kind = 'segment' and coalesce(filter, '') <> ''))
select {', '.join(OLD_DEFS)} from part
where concat('def_', cast(p_partkey as string)) not in (select name from valid)
union all select * from valid
""")
def _(spark, sf):
    return Q.upsert_definitions(table(spark, sf, "part").selectExpr(*OLD_DEFS),
                                table(spark, sf, "supplier").selectExpr(*NEW_DEFS))

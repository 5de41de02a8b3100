"""Quality scores of tables with planted defects."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyglass.functions import fixed
from tallyglass.operators import profile as P, quality as D, relations as R
from workload import base
from workload.base import AS_OF, profile_sql, query
from workload.joins import measured_sql, planted

PARTS = (base.CONTACTS_PART, base.ORDERS_PART)
KEYS = [("customer", "c_custkey"), ("orders", "o_orderkey")]
OWN_WEIGHTS = {"completeness": 0.5, "freshness": 0.05, "taste": 0.9}


def scored(spark, sf, weights=None):
    profiles = P.profile_all({
        "customer": base.contacts(spark, sf), "orders": base.orders_plus(spark, sf)})
    keys = spark.createDataFrame(KEYS, "table_name string, column_name string")
    measured = R.measure_relations(base.edges(spark), planted(spark, sf))
    return D.quality_columns(profiles, measured, keys, AS_OF, weights)


def dimensions_sql(weights=None) -> str:
    """(table, column, dimension, applicable, score, weight): one row per column and dimension."""
    w = {**fixed.QUALITY_WEIGHTS, **{k: v for k, v in (weights or {}).items()
                                     if k in fixed.QUALITY_WEIGHTS}}
    return f"""(
    with p as ({profile_sql(*PARTS)}),
    q as (
      select p.*, k.c is not null as is_pk, m.ratio,
        starts_with(detected_type, 'datetime') or
          regexp_matches(lower(declared_type), 'date|time') as temporal,
        try_cast(left(max_value, 10) as date) as latest
      from p
      left join (values ('customer', 'c_custkey'), ('orders', 'o_orderkey')) as k(t, c)
        on k.t = p.table_name and k.c = p.column_name
      left join (select from_table, from_column, min(ratio) as ratio from {measured_sql()}
        group by all) m on m.from_table = p.table_name and m.from_column = p.column_name),
    s as (
      select table_name, column_name, non_null_count / cast(sample_size as double) as completeness,
        case when format_checked is not null and non_null_count > 0
          then 1 - invalid_count / cast(non_null_count as double) end as validity,
        case when (is_pk or coalesce(pii_type in ('email', 'iban', 'siret'), false) or
            (not temporal and distinct_count / cast(nullif(non_null_count, 0) as double) >= 0.98
             and non_null_count > 20)) and non_null_count > 0
          then least(1.0, distinct_count / cast(non_null_count as double)) end as uniqueness,
        ratio as consistency,
        case when temporal and latest is not null then
          case when date '{AS_OF}' - latest <= 90 then 1.0
               when date '{AS_OF}' - latest >= 730 then 0.0
               else 1 - (date '{AS_OF}' - latest - 90) / 640.0 end end as freshness
      from q)
    """ + " union all ".join(
        f"select table_name, column_name, '{d}' as dimension, {d} is not null as applicable, "
        f"cast({d} as double) as score, cast({v} as double) as weight from s"
        for d, v in w.items()) + ")"


def columns_score_sql(weights=None) -> str:
    return (f"(select table_name, column_name, coalesce(sum(weight * score) filter (applicable) / "
            f"nullif(sum(weight) filter (applicable), 0), 1.0) as score "
            f"from {dimensions_sql(weights)} group by all)")


def _one_dimension(code: str, name: str):
    @query(f"{code}_{name}", f"""
    select table_name, column_name, applicable, round(score, 6) as score
    from {dimensions_sql()} where dimension = '{name}'
    """)
    def _(spark, sf):
        return D.quality_dimensions(scored(spark, sf)).where(F.col("dimension") == name).select(
            "table_name", "column_name", "applicable", F.round("score", 6).alias("score"))


for _code, _name in zip(("D1", "D2", "D3", "D4", "D5"), fixed.QUALITY_WEIGHTS):
    _one_dimension(_code, _name)


@query("D6_own_weights", f"""
select table_name, column_name, round(score, 6) as score from {columns_score_sql(OWN_WEIGHTS)}
""")
def _(spark, sf):
    return scored(spark, sf, OWN_WEIGHTS).select(
        "table_name", "column_name", F.round("score", 6).alias("score"))


@query("D7_column_scores", f"""
select d.table_name, d.column_name, round(c.score, 6) as column_score, dimension, applicable,
  round(d.score, 6) as score, weight
from {dimensions_sql()} d join {columns_score_sql()} c
  on c.table_name = d.table_name and c.column_name = d.column_name
""")
def _(spark, sf):
    return scored(spark, sf).select(
        "table_name", "column_name", F.round("score", 6).alias("column_score"),
        F.inline("dimensions"),
    ).select("table_name", "column_name", "column_score", F.col("name").alias("dimension"),
             "applicable", F.round("score", 6).alias("score"), "weight")


USAGE_SQL = f"""(
select string_split(t, '.')[-1] as table_name, string_split(c, '.')[-1] as column_name,
  count(*) as n_uses
from (select t, unnest(columns_used) as c
      from (select unnest(tables_used) as t, columns_used from {base.AUDIT_SQL}))
group by all)"""

TABLE_SCORES_SQL = f"""(
select c.table_name, sum((1 + coalesce(n_uses, 0)) * score) / sum(1 + coalesce(n_uses, 0))
  as score, count(*) as n_columns
from {columns_score_sql()} c left join {USAGE_SQL} u
  on u.table_name = c.table_name and u.column_name = c.column_name
group by c.table_name)"""


@query("D8_table_scores", f"""
select table_name, round(score, 6) as score, n_columns from {TABLE_SCORES_SQL}
""")
def _(spark, sf):
    usage = D.column_usage(base.audit(spark, sf))
    return D.quality_tables(scored(spark, sf), usage).withColumn("score", F.round("score", 6))


@query("D9_relation_scores", f"""
select from_table, from_column, to_table, to_column, round(ratio, 9) as score,
  concat(orphans, ' orphans in ', total) as detail from {measured_sql()}
""")
def _(spark, sf):
    measured = R.measure_relations(base.edges(spark), planted(spark, sf))
    return D.quality_relations(measured).withColumn("score", F.round("score", 9))


@query("D10_base_score", f"""
select round(avg(score), 6) as score, count(*) as tables_scored,
  cast(sum(n_columns) as bigint) as columns_scored, (select count(*) from {base.EDGES_SQL}) as relations_scored
from {TABLE_SCORES_SQL}
""")
def _(spark, sf):
    columns = scored(spark, sf)
    measured = R.measure_relations(base.edges(spark), planted(spark, sf))
    usage = D.column_usage(base.audit(spark, sf))
    return D.quality_base(D.quality_tables(columns, usage), columns,
                          D.quality_relations(measured)).withColumn("score", F.round("score", 6))


@query("D11_column_usage", f"select * from {USAGE_SQL}")
def _(spark, sf):
    return D.column_usage(base.audit(spark, sf))

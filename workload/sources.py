"""Files, catalog, signatures, samples, bounds, governance, exports, audit log."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyglass.operators import profile as profiling, semantics
from tallyglass.session import ensure_checkpoint_dir
from tallyglass.sources import access, catalog, delimited, sinks
from workload import base
from workload.base import query, table, tables


def _scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("A1_delimited_orders", """
select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders
""")
def _(spark, sf):
    path = _scratch(spark, "delimited")
    table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.regexp_replace(F.col("o_totalprice").cast("string"), r"\.", ",").alias("o_totalprice"),
        "o_orderpriority",
    ).write.option("header", True).option("sep", ";").csv(path)
    return delimited.read_delimited(spark, path)


ALL = list(base.SCHEMA)


@query("A2_catalog_tables", f"""
select 'main' as schema_name, table_name, 'table' as kind, n_rows,
  case table_name when 'orders' then 'sales orders' end as comment
from {base.sizes_sql(ALL)}
""")
def _(spark, sf):
    known = tables(spark, sf)
    return catalog.build_catalog(known, comments={"orders": "sales orders"})[0]


CATALOG_SQL = f"""
select c.table_name, c.column_name, c.ordinal, c.data_type, true as nullable,
  k.column_name is not null as is_pk
from {base.columns_sql(ALL)} c
left join {base.unique_keys_sql(ALL)} k
  on k.table_name = c.table_name and k.column_name = c.column_name
"""


@query("A2_catalog_columns", CATALOG_SQL)
def _(spark, sf):
    return catalog.build_catalog(tables(spark, sf))[1].drop("schema_name", "default_value")


SIGNATURE_SQL = f"""
with line as (
  select table_name, concat_ws(',', column_name, data_type, 'true', cast(is_pk as varchar)) as l
  from ({CATALOG_SQL})),
parts as (
  select 'table' as scope, table_name, sha256(string_agg(l, '|' order by l)) as signature
  from line group by table_name
  union all
  select 'relations', '*', sha256(string_agg(l, '|' order by l)) from (
    select concat_ws(',', from_table, from_column, to_table, to_column, kind) as l
    from {base.EDGES_SQL}))
select * from parts
union all
select 'total', '*', sha256(string_agg(l, '|' order by l)) from (
  select concat_ws(',', scope, table_name, signature) as l from parts)
"""


@query("A3_schema_signature", SIGNATURE_SQL)
def _(spark, sf):
    columns = catalog.build_catalog(tables(spark, sf))[1]
    return catalog.schema_signature(columns, base.edges(spark))


@query("A4_snapshot_history", f"""
with scan as ({SIGNATURE_SQL}),
old as (
  select 1 as version, sha256(string_agg(concat_ws(',', scope, table_name, signature), '|'
    order by concat_ws(',', scope, table_name, signature))) as signature,
    cast(count(*) as int) as table_count
  from scan where scope = 'table' and table_name <> 'labels')
select version, signature, table_count, false as is_current from old
union all
select 2, max(case when scope = 'total' then signature end),
  cast(count(*) filter (scope = 'table') as int), true from scan
""")
def _(spark, sf):
    columns = catalog.build_catalog(tables(spark, sf))[1]
    none = spark.createDataFrame(
        [], "version int, signature string, table_count int, is_current boolean")
    before = catalog.schema_signature(columns.where("table_name <> 'labels'"))
    first = catalog.append_snapshot(none, before)
    now = catalog.schema_signature(columns, base.edges(spark))
    # A scan that finds nothing new must not add a version.
    return catalog.append_snapshot(catalog.append_snapshot(first, now), now)


@query("A5_sampled_scan", """
select count(*) as n, sum(cast(l_extendedprice as decimal(18,2))) as total from lineitem
where substring(md5(cast(l_orderkey as varchar)), 1, 8) < '40000000'
""")
def _(spark, sf):
    return access.sampled(table(spark, sf, "lineitem"), 0.25, "l_orderkey").agg(
        F.count("*").alias("n"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("total"),
    )


@query("A6_bounded_union", """
select least(count(*), 10000) as n, count(*) > 10000 as truncated
from (select o_orderkey from orders union select l_orderkey from lineitem)
""")
def _(spark, sf):
    both = table(spark, sf, "orders").select("o_orderkey").union(
        table(spark, sf, "lineitem").select("l_orderkey")).distinct()
    return access.bounded(both, 10_000).groupBy("truncated").agg(F.count("*").alias("n"))


EXCEPTIONS = [("sales", "supplier", None), ("sales", "Customer", "c_acctbal"),
              ("sales", "orders", "O_TOTALPRICE"), ("risk", "lineitem", None)]
EXCEPTIONS_SQL = ("(values ('sales', 'supplier', null), ('sales', 'Customer', 'c_acctbal'), "
                  "('sales', 'orders', 'O_TOTALPRICE'), ('risk', 'lineitem', null)) "
                  "as x(space, table_name, column_name)")


def _exceptions(spark):
    return spark.createDataFrame(
        EXCEPTIONS, "space string, table_name string, column_name string")


@query("A7_governed_counts", " union all ".join(
    f"select '{t}' as table_name, '{c}' as column_name, count({c}) as non_null_count from {t}"
    for t in base.ALL if t != "supplier"
    for c, _ in base.SCHEMA[t] if c not in ("c_acctbal", "o_totalprice")
))
def _(spark, sf):
    seen = access.govern(tables(spark, sf),
                         _exceptions(spark), "sales")
    return catalog.union_all([
        profiling.quick_counts(df, name) for name, df in seen.items()
    ]).select("table_name", "column_name", "non_null_count")


@query("A7_governance_view", f"""
select c.table_name, c.column_name, c.data_type, s.n_rows,
  not exists (select 1 from {EXCEPTIONS_SQL} where space = 'sales'
    and lower(x.table_name) = c.table_name and x.column_name is null) as table_enabled,
  not exists (select 1 from {EXCEPTIONS_SQL} where space = 'sales'
    and lower(x.table_name) = c.table_name and lower(x.column_name) = c.column_name)
    as column_enabled
from {base.columns_sql(base.ALL)} c join {base.sizes_sql(base.ALL)} s
  on s.table_name = c.table_name
""")
def _(spark, sf):
    sizes, columns = catalog.build_catalog(tables(spark, sf))
    return access.governance_view(columns, _exceptions(spark), "sales").join(
        sizes.select("table_name", "n_rows"), "table_name")


@query("A8_dictionary_export", f"""
select m.concept, description, array_to_string(synonyms, ';') as synonyms, table_name,
  column_name, status, confidence, rationale
from {base.MAPPINGS_SQL} m join {base.LEXICON_SQL} on lexicon.concept = m.concept
where status <> 'rejected'
""")
def _(spark, sf):
    exported = sinks.export_dictionary(base.mappings(spark, sf), semantics.concepts(spark))
    path = _scratch(spark, "dictionary")
    sinks.write_dictionary(exported, path, "json")
    return spark.read.schema(exported.schema).json(path)


@query("A9_audit_log", f"""
select cast(created_at as date) as day, status, count(*) as n, cast(sum(row_count) as bigint) as row_total,
  count(*) filter (truncated) as n_truncated, cast(sum(len(tables_used)) as bigint) as n_tables
from {base.AUDIT_SQL} group by all
""")
def _(spark, sf):
    path = _scratch(spark, "audit")
    sinks.append_audit(base.audit(spark, sf), path)
    return sinks.read_audit(spark, path).groupBy("day", "status").agg(
        F.count("*").alias("n"), F.sum("row_count").alias("row_total"),
        F.count_if("truncated").alias("n_truncated"),
        F.sum(F.size("tables_used")).alias("n_tables"),
    )

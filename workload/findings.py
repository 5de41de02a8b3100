"""Proactive findings on tables with planted defects."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyglass.operators import findings as I, profile as P, relations as R
from tallyglass.plans import analysis
from tallyglass.session import ensure_checkpoint_dir
from workload import base
from workload.base import profile_sql, query
from workload.joins import measured_sql, planted
from workload.segments import knowledge, rounded
from workload.series import AMOUNT, ENDS, LINE_SQL, OUTLIERS_SQL, line

SHOWN = ["category", "severity", "level", "table_name", "column_name", "period", "figure"]
PARTS = (base.CONTACTS_PART, base.ORDERS_PART)

RELATIONS_SQL = f"""(
select 'incoherent_relation' as category,
  case when (1 - ratio) * 100 >= 5 then 'high' else 'medium' end as severity,
  case when (1 - ratio) * 100 >= 5 then 'critical' else 'important' end as level,
  from_table as table_name, from_column as column_name, cast(null as varchar) as period,
  (1 - ratio) * 100 as figure
from {measured_sql()} where ratio < 0.999)"""
COLUMNS_SQL = f"""(
select 'suspicious_column' as category,
  case when coalesce(invalid_count, 0) = 0 and null_rate >= 0.6 then 'high' else 'medium' end
    as severity,
  case when coalesce(invalid_count, 0) = 0 and null_rate >= 0.6 then 'critical'
    else 'important' end as level,
  table_name, column_name, cast(null as varchar) as period,
  case when invalid_count > 0 then invalid_count else null_rate * 100 end as figure
from (select *, 1 - non_null_count / cast(sample_size as double) as null_rate
      from ({profile_sql(*PARTS)}))
where invalid_count > 0 or null_rate >= 0.3)"""
SERIES_SQL = f"""(
select case when pct < 0 then 'trend' else 'opportunity' end as category,
  case when pct <= -25 then 'high' when pct < 0 then 'medium' else 'low' end as severity,
  case when pct < 0 then 'important' else 'opportunity' end as level, 'orders' as table_name,
  cast(null as varchar) as column_name, last_period as period, pct as figure
from {ENDS} where n >= 3 and abs(pct) >= 5
union all
select 'anomaly', 'high', 'critical', 'orders', null, period, (previous - value) / previous * 100
from (select *, lag(value) over (order by period) as previous from {LINE_SQL})
where (value - previous) / previous <= -0.3
union all
select 'anomaly', 'medium', 'important', 'orders', null, period, value from {OUTLIERS_SQL})"""
ALL_SQL = (f"(select * from {RELATIONS_SQL} union all select * from {COLUMNS_SQL} "
           f"union all select * from {SERIES_SQL})")


def profiles(spark, sf):
    return P.profile_all({"customer": base.contacts(spark, sf),
                          "orders": base.orders_plus(spark, sf)})


def measured(spark, sf):
    return R.measure_relations(base.edges(spark), planted(spark, sf))


def every(spark, sf):
    return I.relation_findings(measured(spark, sf)).unionByName(
        I.column_findings(profiles(spark, sf))
    ).unionByName(I.series_findings(line(spark, sf), "orders"))


ROUNDED = ", ".join(c if c != "figure" else "round(figure, 4) as figure" for c in SHOWN)


@query("I1_relation_findings", f"select {ROUNDED} from {RELATIONS_SQL}")
def _(spark, sf):
    return rounded(I.relation_findings(measured(spark, sf)).select(*SHOWN), "figure", digits=4)


@query("I2_column_findings", f"select {ROUNDED} from {COLUMNS_SQL}")
def _(spark, sf):
    return rounded(I.column_findings(profiles(spark, sf)).select(*SHOWN), "figure", digits=4)


ORDER = ("list_position(['critical', 'important', 'opportunity', 'info'], level), "
         "list_position(['high', 'medium', 'low'], severity), category desc, table_name, "
         "column_name nulls last, period nulls last")


@query("I3_ranked_findings", f"select {ROUNDED} from {ALL_SQL} order by {ORDER} limit 12")
def _(spark, sf):
    return rounded(I.rank_findings(every(spark, sf), 12).select(*SHOWN), "figure", digits=4)


PLAIN = ("region", "nation", "customer", "orders")
PLAIN_COLUMNS_SQL = COLUMNS_SQL.replace(
    profile_sql(*PARTS), profile_sql(*[base.plain_part(n) for n in PLAIN]))
PLAIN_SERIES_SQL = SERIES_SQL.replace(AMOUNT, "cast(o_totalprice as decimal(18,2))")


@query("I3_discoveries_of_the_catalog", f"""
select {ROUNDED} from (select * from {PLAIN_COLUMNS_SQL} union all select * from {PLAIN_SERIES_SQL})
order by {ORDER} limit 12
""")
def _(spark, sf):
    found = analysis.discover(knowledge(spark, sf, PLAIN), max_items=12,
                              measure=F.col("o_totalprice").cast("decimal(18,2)"))
    return rounded(found.select(*SHOWN), "figure", digits=4)


EVERY_COLUMNS_SQL = COLUMNS_SQL.replace(
    profile_sql(*PARTS), profile_sql(*[base.plain_part(n) for n in base.ALL]))
EVERY_RELATIONS_SQL = RELATIONS_SQL.replace(measured_sql(), measured_sql(planted_orders=False))


@query("I3_discoveries_of_all_tables", f"""
select {ROUNDED} from {EVERY_COLUMNS_SQL} union all select {ROUNDED} from {PLAIN_SERIES_SQL}
union all select {ROUNDED} from {EVERY_RELATIONS_SQL}
""")
def _(spark, sf):
    found = analysis.discover(knowledge(spark, sf, base.ALL), fact="orders",
                              measure=F.col("o_totalprice").cast("decimal(18,2)"))
    return rounded(found.select(*SHOWN), "figure", digits=4)


@query("I3_discoveries_less_hidden", f"""
select {ROUNDED} from {PLAIN_COLUMNS_SQL}
where table_name <> 'customer' and column_name <> 'o_orderpriority'
union all select {ROUNDED} from {PLAIN_SERIES_SQL}
""")
def _(spark, sf):
    found = analysis.discover(
        knowledge(spark, sf, PLAIN), hidden_tables=("Customer",),
        hidden_columns=(("ORDERS", "O_OrderPriority"),),
        measure=F.col("o_totalprice").cast("decimal(18,2)"))
    return rounded(found.select(*SHOWN), "figure", digits=4)


NAMES_SQL = ", ".join(f"('category', '{c}')" for c in I.CATEGORIES) + ", " + ", ".join(
    f"('level', '{c}')" for c in I.LEVELS)


@query("I4_finding_counts", f"""
with f as {ALL_SQL}
select counted, name, (select count(*) from f where (counted = 'category' and category = name)
  or (counted = 'level' and level = name)) as n
from (values {NAMES_SQL}) as x(counted, name)
""")
def _(spark, sf):
    return I.finding_counts(every(spark, sf))


def lines_sql(parts, quality_filter="true") -> str:
    """(component, table_name, column_name, line) as fingerprints rest on them."""
    return f"""(
    select 'schema' as component, e.from_table as table_name, e.from_column as column_name,
      concat_ws(':', e.from_table, e.from_column, e.to_table, status, printf('%.6f', ratio)) as line
    from {base.EDGES_SQL.replace('as edges(', 'as e(')} join {measured_sql()} m
      on m.from_table = e.from_table and m.from_column = e.from_column
    union all
    select 'profiles', table_name, column_name, concat_ws(':', table_name, column_name,
      printf('%.6f', 1 - non_null_count / cast(sample_size as double)),
      coalesce(cast(invalid_count as varchar), '-'), detected_type, coalesce(pii_type, '-'))
    from ({profile_sql(*parts)})
    union all
    select 'quality', table_name, null, concat_ws(':', table_name, '-', printf('%.4f', score))
    from {base.QUALITY_SQL} where {quality_filter})"""


def fingerprint_sql(parts, quality_filter="true") -> str:
    def digest(component, prefix=""):
        return (f"(select substring(sha256('{prefix}' || concat_ws(':', count(*), coalesce(sum(cast("
                f"'0x' || substring(sha256(line), 1, 15) as bigint)), 0))), 1, 12) "
                f"from l where component = '{component}') as {component}")

    return (f"with l as {lines_sql(parts, quality_filter)} select {digest('schema', '|')}, "
            f"{digest('profiles')}, {digest('quality')}")


def _combined(sql: str) -> str:
    return (f"select *, substring(sha256(concat_ws('+', schema, profiles, quality)), 1, 12) "
            f"as combined from ({sql})")


def rests_on(spark, sf, profile_df, quality_df):
    relations = base.edges(spark).join(measured(spark, sf), R.EDGE)
    return relations, profile_df, quality_df.withColumn("column_name", F.lit(None).cast("string"))


def print_of(spark, sf, profile_df, quality_df):
    return I.fingerprint(*rests_on(spark, sf, profile_df, quality_df))


def tree_of(spark, sf, profile_df, quality_df):
    return I.fingerprint_tree(*rests_on(spark, sf, profile_df, quality_df))


@query("I5_fingerprint", _combined(fingerprint_sql(PARTS)))
def _(spark, sf):
    return print_of(spark, sf, profiles(spark, sf), base.quality_scores(spark, sf))


@query("I6_stale_reason", f"""
with a as ({fingerprint_sql(PARTS)}),
b as ({fingerprint_sql((base.CONTACTS_PART,), "table_name <> 'part'")})
select a.schema = b.schema and a.profiles = b.profiles and a.quality = b.quality as reusable,
  concat_ws(',', case when a.schema <> b.schema then 'schema' end,
    case when a.profiles <> b.profiles then 'profiles' end,
    case when a.quality <> b.quality then 'quality' end) as reasons
from a, b
""")
def _(spark, sf):
    scores = base.quality_scores(spark, sf)
    before = print_of(spark, sf, profiles(spark, sf), scores)
    now = print_of(spark, sf, P.profile_all({"customer": base.contacts(spark, sf)}),
                   scores.where("table_name <> 'part'"))
    return I.stale_reason(before, now).withColumn("reasons", F.array_join("reasons", ","))


@query("I6_changed_columns", f"""
with a as (select component, table_name, column_name, string_agg(line, '|' order by line) as line
    from {lines_sql(PARTS)} group by 1, 2, 3),
b as (select component, table_name, column_name, string_agg(line, '|' order by line) as line
    from {lines_sql((base.CONTACTS_PART,), "table_name <> 'part'")} group by 1, 2, 3)
select coalesce(a.component, b.component) as component,
  coalesce(a.table_name, b.table_name) as table_name,
  coalesce(a.column_name, b.column_name) as column_name,
  case when a.line is null then 'added' when b.line is null then 'removed' else 'changed' end
    as change
from a full join b on a.component = b.component and a.table_name = b.table_name
  and a.column_name is not distinct from b.column_name
where a.line is distinct from b.line
""")
def _(spark, sf):
    scores = base.quality_scores(spark, sf)
    before = tree_of(spark, sf, profiles(spark, sf), scores)
    now = tree_of(spark, sf, P.profile_all({"customer": base.contacts(spark, sf)}),
                  scores.where("table_name <> 'part'"))
    return I.changes(before, now)


@query("I6_reused_findings", f"select {ROUNDED}, true as reused from {ALL_SQL}")
def _(spark, sf):
    folder = f"{ensure_checkpoint_dir(spark)}/findings-{uuid.uuid4().hex}"

    def find():
        return every(spark, sf).select(*SHOWN)

    _, first = analysis.reuse_findings(spark, folder, "v1", find)
    again, reused = analysis.reuse_findings(spark, folder, "v1", find)
    return rounded(again, "figure", digits=4).withColumn("reused", F.lit(reused and not first))

"""Relations between the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyglass.operators import paths, relations as R
from tallyglass.sources import catalog
from workload import base
from workload.base import ALL, EDGES, STAR, query, tables

STEM = "regexp_replace(bare, '(_id|id|_key|key)$', '')"


@query("J1_inferred_relations", f"""
with cols as (
  select c.*, regexp_replace(lower(c.column_name), '^[a-z]_', '') as bare, s.n_rows,
    k.column_name is not null as is_pk,
    count(k.column_name) over (partition by c.table_name) as n_keys
  from {base.columns_sql(ALL)} c join {base.sizes_sql(ALL)} s on s.table_name = c.table_name
  left join {base.unique_keys_sql(ALL)} k
    on k.table_name = c.table_name and k.column_name = c.column_name
  where true),
stems as (select *, {STEM} as stem from cols
  where regexp_matches(bare, '.(_id|id|_key|key)$') and data_type in ('int', 'bigint')),
spelled as (
  select *, 1 as rank, stem as spelling from stems
  union all select *, 2, stem || 's' from stems
  union all select *, 3, stem || 'es' from stems
  union all select *, 4, left(stem, length(stem) - 1) || 'ies' from stems
    where right(stem, 1) = 'y'),
hits as (
  select f.table_name as ft, f.column_name as fc, t.table_name as tt, t.column_name as tc,
    rank, stem
  from spelled f join cols t on t.is_pk and t.n_keys = 1 and lower(t.table_name) = spelling
  where f.table_name <> t.table_name
  union all
  select f.table_name, f.column_name, t.table_name, t.column_name, 9, stem
  from stems f join cols t on t.is_pk and t.n_keys = 1 and t.bare = f.bare
  where f.table_name <> t.table_name and (not f.is_pk or f.n_rows < t.n_rows
    or (f.n_rows = t.n_rows and f.table_name < t.table_name))),
best as (select *, row_number() over (partition by ft, fc order by rank, tt) as rn from hits)
select ft as from_table, fc as from_column, tt as to_table, tc as to_column,
  'inferred' as kind, 'proposed' as status, cast(case when stem = tt then 0.8 else 0.65 end
  as double) as confidence
from best where rn = 1
""")
def _(spark, sf):
    sizes, columns = catalog.build_catalog(tables(spark, sf))
    return R.infer_relations(columns, sizes)


def planted(spark, sf):
    known = tables(spark, sf, STAR)
    known["orders"] = base.orders_plus(spark, sf)
    return known


def measured_sql(edges=EDGES, planted_orders=True) -> str:
    """Integrity and cardinality of each edge, written out edge by edge."""
    def source(name):
        return base.ORDERS_PLUS_SQL if planted_orders and name == "orders" else name

    branches = []
    for ft, fc, tt, tc, *_ in edges:
        branches.append(f"""
          select '{ft}' as from_table, '{fc}' as from_column, '{tt}' as to_table,
            '{tc}' as to_column, count(*) as total,
            count(*) filter (not exists (select 1 from {source(tt)} t where t.{tc} = f.{fc}))
              as orphans,
            count(distinct f.{fc}) as distinct_from,
            case when count(*) = count(distinct f.{fc}) then '1' else 'n' end as from_side,
            (select case when coalesce(max(n), 1) > 1 then 'n' else '1' end from (
               select count(*) as n from {source(tt)} t
               where t.{tc} in (select {fc} from {source(ft)}) group by t.{tc})) as to_side
          from {source(ft)} f where f.{fc} is not null""")
    return ("(select from_table, from_column, to_table, to_column, total, orphans, "
            "distinct_from, 1 - orphans / cast(total as double) as ratio, "
            "from_side || '-' || to_side as cardinality from ("
            + " union all ".join(branches) + "))")


@query("J2_integrity", f"""
select from_table, from_column, to_table, to_column, total, orphans, distinct_from,
  round(ratio, 9) as ratio from {measured_sql()}
""")
def _(spark, sf):
    return R.integrity(base.edges(spark), planted(spark, sf)).withColumn(
        "ratio", F.round("ratio", 9))


ODD_EDGES = EDGES + [
    ("customer", "c_custkey", "orders", "o_custkey", 0.5),
    ("customer", "c_nationkey", "supplier", "s_nationkey", 0.5),
]


def odd_edges(spark):
    return spark.createDataFrame(
        [(*e[:4], "inferred", "proposed", e[4]) for e in ODD_EDGES],
        base.edges(spark).schema)


@query("J3_cardinality", f"""
select from_table, from_column, to_table, to_column, cardinality from {measured_sql(ODD_EDGES)}
""")
def _(spark, sf):
    return R.cardinality(odd_edges(spark), planted(spark, sf))


@query("J4_star_join", """
select p_type, s_nationkey, o_orderstatus, count(*) as n,
  sum(cast(l_extendedprice as decimal(18,2))) as total
from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
join supplier on l_suppkey = s_suppkey group by all
""")
def _(spark, sf):
    joined = R.star("lineitem", base.edges(spark), tables(spark, sf, STAR))
    return joined.groupBy(
        F.col("part__p_type").alias("p_type"), F.col("supplier__s_nationkey").alias("s_nationkey"),
        F.col("orders__o_orderstatus").alias("o_orderstatus"),
    ).agg(F.count("*").alias("n"),
          F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("total"))


DECISIONS = [("lineitem", "l_suppkey", "supplier", "s_suppkey", "reject"),
             ("orders", "o_custkey", "customer", "c_custkey", "validate"),
             ("nation", "n_regionkey", "region", "r_regionkey", "reject")]


def reviewed(spark):
    relations = base.edges(spark).withColumn(
        "kind", F.when(F.col("to_table") == "region", "declared").otherwise(F.col("kind")))
    decisions = spark.createDataFrame(
        DECISIONS, "from_table string, from_column string, to_table string, to_column string, "
                   "action string")
    return R.review_relations(relations, decisions)


REVIEWED_SQL = f"""(
select from_table, from_column, to_table, to_column, confidence,
  case when to_table = 'region' then 'declared' when from_column = 'o_custkey' then 'validated'
    else kind end as kind,
  case when from_column = 'o_custkey' then 'validated' when from_column = 'l_suppkey'
    then 'rejected' else status end as status
from {base.EDGES_SQL})"""


@query("J5_reviewed_relations", f"""
select r.*, m.orphans from {REVIEWED_SQL} r join {measured_sql()} m
  using (from_table, from_column, to_table, to_column)
where status <> 'rejected'
""")
def _(spark, sf):
    usable = reviewed(spark).where("status <> 'rejected'")
    counted = R.measure_relations(usable, planted(spark, sf))
    return usable.join(counted.select(*R.EDGE, "orphans"), R.EDGE)


KEY_MAPPINGS = [("orders", "o_orderkey", "Commande", "validated"),
                ("orders", "o_totalprice", "Montant", "corrected"),
                ("customer", "c_custkey", "Client", "validated"),
                ("customer", "c_name", "Nom", "validated"),
                ("part", "p_partkey", "Produit", "proposed"),
                ("lineitem", "l_orderkey", "Commande", "validated")]
KEY_MAPPINGS_SQL = "(values " + ", ".join(
    str(m) for m in KEY_MAPPINGS) + ") as km(table_name, column_name, concept, status)"


def key_mappings(spark):
    return spark.createDataFrame(
        KEY_MAPPINGS, "table_name string, column_name string, concept string, status string")


@query("J6_graph_nodes", f"""
with decided as (
  select km.table_name, max(case when k.column_name is not null then concept end) as entity,
    string_agg(distinct concept, ',' order by concept) as concepts
  from {KEY_MAPPINGS_SQL} left join {base.unique_keys_sql(ALL)} k
    on k.table_name = km.table_name and k.column_name = km.column_name
  where status in ('validated', 'corrected') group by 1)
select s.table_name, entity, coalesce(concepts, '') as concepts, n_rows,
  (select count(*) from {base.columns_sql(ALL)} c where c.table_name = s.table_name)
    as n_columns,
  round(score, 4) as quality, 'table' as kind
from {base.sizes_sql(ALL)} s left join decided d on d.table_name = s.table_name
left join {base.QUALITY_SQL} q on q.table_name = s.table_name
""")
def _(spark, sf):
    sizes, columns = catalog.build_catalog(tables(spark, sf))
    return R.graph_nodes(sizes, columns, key_mappings(spark), base.quality_scores(spark, sf)
                         ).withColumn("concepts", F.array_join("concepts", ","))


@query("J7_graph_edges", f"""
select r.*, m.cardinality, round(m.ratio, 9) as ratio, concat_ws('; ',
  case r.kind
    when 'declared' then 'Declared foreign key: ' || r.from_table || '.' || r.from_column
      || ' references ' || r.to_table || '.' || r.to_column
    when 'inferred' then 'Inferred by naming: ' || r.from_table || '.' || r.from_column
      || ' points to ' || r.to_table || '.' || r.to_column
    else 'Confirmed by a person' end,
  'cardinality ' || m.cardinality,
  case when m.ratio < 0.999 then printf('%.1f%%', (1 - m.ratio) * 100) || ' orphans' end)
  as reason
from {REVIEWED_SQL} r join {measured_sql()} m
  using (from_table, from_column, to_table, to_column)
""")
def _(spark, sf):
    counted = R.measure_relations(base.edges(spark), planted(spark, sf))
    return R.graph_edges(reviewed(spark), counted).withColumn("ratio", F.round("ratio", 9))


@query("J8_fanout_check", f"""
select from_table, from_column, to_table, to_column, cardinality,
  case when cardinality in ('1-n', 'n-n') then 'warn' else 'pass' end as result
from {measured_sql(ODD_EDGES)}
where from_table in ('customer', 'orders', 'supplier')
  and to_table in ('customer', 'orders', 'supplier')
""")
def _(spark, sf):
    counted = R.measure_relations(odd_edges(spark), planted(spark, sf))
    return R.fanout_check(counted, ["customer", "orders", "supplier"])


def steps_sql(edges=EDGES) -> str:
    """Both directions of each edge with fan-out and share of matched rows, edge by edge."""
    parts = []
    for a, c, b, d, _ in edges:
        source = base.ORDERS_PLUS_SQL if a == "orders" else a
        target = base.ORDERS_PLUS_SQL if b == "orders" else b
        parts.append(f"""
          select '{a}' as a, '{c}' as c, '{b}' as b, '{d}' as d,
            cast(sum(n * m) as double) as pairs, sum(n) as n, sum(m) as m,
            sum(n) filter (m is not null) as met_n, sum(m) filter (n is not null) as met_m
          from (select {c} as k, count(*) as n from {source} where {c} is not null group by 1)
          full join (select {d} as k, count(*) as m from {target} where {d} is not null group by 1)
            using (k)""")
    facts = " union all ".join(parts)
    return f"""(
      select a as source, c as source_column, b as target, d as target_column,
        coalesce(pairs / met_n, 0) as fan_out, coalesce(met_n / n, 0) as kept from ({facts})
      union all
      select b, d, a, c, coalesce(pairs / met_m, 0), coalesce(met_m / m, 0) from ({facts}))"""


def paths_sql(start: str, most: int) -> str:
    return f"""(
      with recursive walk(at_table, visited, path, hops, fan_out, kept, multiplies) as (
        select '{start}', ['{start}'], '{start}', 0, 1e0, 1e0, false
        union all
        select s.target, list_append(w.visited, s.target),
          w.path || ' -[' || s.source_column || '=' || s.target_column || ']-> ' || s.target,
          w.hops + 1, w.fan_out * s.fan_out, w.kept * s.kept, w.multiplies or s.fan_out > 1
        from walk w join {steps_sql()} s on s.source = w.at_table
        where w.hops < {most} and not list_contains(w.visited, s.target))
      select at_table as end_table, path, hops, round(fan_out, 6) as fan_out,
        round(kept, 6) as kept, multiplies from walk where hops > 0)"""


def walked(spark, sf, start, most, end=None):
    steps = paths.edge_steps(base.edges(spark), planted(spark, sf))
    return paths.join_paths(steps, start, end, most)


def shown(df):
    return df.withColumns({c: F.round(c, 6) for c in ("fan_out", "kept")})


@query("J4_join_paths", f"select * from {paths_sql('lineitem', 4)} where end_table = 'region'")
def _(spark, sf):
    return shown(walked(spark, sf, "lineitem", 4, "region"))


@query("J8_path_fan_out", f"select * from {paths_sql('customer', 4)}")
def _(spark, sf):
    return shown(walked(spark, sf, "customer", 4))


@query("J8_safest_paths", f"""
select * from {paths_sql('supplier', 4)}
qualify row_number() over (partition by end_table order by fan_out, -kept, hops, path) = 1
""")
def _(spark, sf):
    return paths.safest_paths(shown(walked(spark, sf, "supplier", 4)))

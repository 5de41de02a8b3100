"""Column roles and distributions."""

from __future__ import annotations

from tallyglass.operators import result
from workload import base
from workload.base import query, table
from workload.segments import rounded


def roles_sql(source: str, columns) -> str:
    branches = []
    for name, type_name in columns:
        kind = base.kind_of(type_name)
        c = f'"{name}"'
        v = f"trim(cast({c} as varchar))"
        dated = f"coalesce(bool_and(regexp_matches({v}, {base._re(base.fixed.ROLE_DATE)})), false)"
        number = "true" if kind in ("integer", "number") else (
            f"coalesce(bool_and(regexp_matches({v}, {base._re(base.fixed.ROLE_NUMBER)})), false)"
            if kind == "text" else "false")
        temporal = "true" if kind == "temporal" else dated if kind == "text" else "false"
        is_id = bool(base.re_search(base.fixed.ROLE_ID_NAME, name))
        is_time = bool(base.re_search(base.fixed.ROLE_TIME_NAME, name))
        branches.append(
            f"select '{name}' as column_name, case when count({c}) = 0 then 'other' "
            f"when {temporal} then 'temporal' when {number} and {is_id} then 'categorical' "
            f"when {number} and {is_time} and count(distinct {c}) > 2 then 'temporal' "
            f"when {number} then 'numeric' "
            f"when count(distinct {c}) <= greatest(30, count({c}) // 2) then 'categorical' "
            f"else 'other' end as role from {source} as src")
    return " union all ".join(branches)


@query("H1_roles_of_contacts", roles_sql(base.CONTACTS_SQL, base.CONTACTS_SCHEMA))
def _(spark, sf):
    return result.column_roles(base.contacts(spark, sf))


@query("H1_roles_of_orders", roles_sql(base.ORDERS_PLUS_SQL, base.ORDERS_PLUS_SCHEMA))
def _(spark, sf):
    return result.column_roles(base.orders_plus(spark, sf))


@query("H1_roles_of_conversations", roles_sql("conversations", base.SCHEMA["conversations"]))
def _(spark, sf):
    return result.column_roles(table(spark, sf, "conversations"))


@query("H2_histogram", """
with e as (select min(l_extendedprice) as lo, (max(l_extendedprice) - min(l_extendedprice)) / 12
  as width from lineitem),
c as (select cast(least(11, floor((l_extendedprice - lo) / width)) as int) as bin,
  count(*) as n from lineitem, e group by 1)
select cast(i as int) as bin, round(lo + i * width, 4) as low, round(lo + (i + 1) * width, 4)
  as high, coalesce(n, 0) as n
from range(12) as r(i) cross join e left join c on c.bin = i
""")
def _(spark, sf):
    return rounded(result.histogram(table(spark, sf, "lineitem"), "l_extendedprice"), "low",
                   "high", digits=4)

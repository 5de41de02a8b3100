"""Registration, the tables, and the views with planted defects that both engines build alike."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyglass.functions import fixed
from tallyglass.session import configure, load_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# table -> (column, type) in file order
SCHEMA = {
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                 ("c_acctbal", "double"), ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"),
                 ("s_acctbal", "double")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"),
             ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"),
               ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                 ("l_linenumber", "int"), ("l_quantity", "double"),
                 ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
                 ("l_returnflag", "string"), ("l_linestatus", "string"),
                 ("l_shipdate", "timestamp_ntz")],
    "events": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
               ("event_type", "string"), ("value", "double"), ("props", "string")],
    "documents": [("doc_id", "bigint"), ("text", "string"), ("lang", "string"),
                  ("source", "string"), ("n_chars", "bigint")],
    "embeddings": [("vec_id", "bigint"), ("embedding", "array<float>"), ("label", "int")],
    "pages": [("page_id", "bigint"), ("url", "string"), ("html", "string")],
    "benchmark": [("item_id", "bigint"), ("text", "string")],
    "labels": [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
    "conversations": [("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"),
                      ("text", "string")],
}
STAR = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents",
        "labels"]
ALL = list(SCHEMA)
EDGES = [
    ("customer", "c_nationkey", "nation", "n_nationkey", 0.8),
    ("labels", "doc_id", "documents", "doc_id", 0.65),
    ("lineitem", "l_orderkey", "orders", "o_orderkey", 0.65),
    ("lineitem", "l_partkey", "part", "p_partkey", 0.8),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey", 0.65),
    ("nation", "n_regionkey", "region", "r_regionkey", 0.8),
    ("orders", "o_custkey", "customer", "c_custkey", 0.65),
    ("supplier", "s_nationkey", "nation", "n_nationkey", 0.8),
]
AS_OF = "2002-01-01"


def query(name: str, sql: str | None = None):
    """Register a Spark query and, where SQL can say the same, its oracle."""
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str, names=None) -> dict[str, DataFrame]:
    return load_tables(spark, sf_dir, list(names or SCHEMA))


def kind_of(type_name: str) -> str:
    return {"string": "text", "int": "integer", "bigint": "integer", "double": "number",
            "timestamp_ntz": "temporal", "boolean": "boolean"}.get(type_name, "other")


# --- planted views: one list of expressions, read by both engines ----------------------------

CONTACTS = [
    "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment",
    "case when c_custkey % 13 = 0 then null when c_custkey % 50 = 0 then 'not-an-email' "
    "else concat('client', cast(c_custkey as string), '@example.com') end as email",
    "concat('+33', lpad(cast(c_custkey as string), 9, '6')) as phone",
    "concat('FR76', lpad(cast(c_custkey as string), 23, '0')) as iban",
    "lpad(cast(c_custkey as string), 14, '1') as siret",
    "case when c_custkey % 5 < 3 then null else concat('10.0.', cast(c_custkey % 250 as string), "
    "'.7') end as host",
    "cast(18 + (c_custkey * 13) % 55 as int) as age",
    "case when c_custkey % 3 = 0 then null else 'door' end as delivery",
    "cast(cast(c_acctbal as decimal(18,2)) as string) as balance_text",
    "case when c_custkey % 2 = 0 then 'yes' else 'no' end as opted_in",
]
CONTACTS_SCHEMA = [
    *SCHEMA["customer"], ("email", "string"), ("phone", "string"), ("iban", "string"),
    ("siret", "string"), ("host", "string"), ("age", "int"), ("delivery", "string"),
    ("balance_text", "string"), ("opted_in", "string"),
]
ORDERS_PLUS = [
    "o_orderkey", "case when o_orderkey % 70 = 0 then -1 else o_custkey end as o_custkey",
    "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
    "cast(cast(o_orderdate as date) as string) as date_text",
    "cast(o_orderkey as string) as key_text",
]
ORDERS_PLUS_SCHEMA = [*SCHEMA["orders"], ("date_text", "string"), ("key_text", "string")]
AMOUNTS = [
    "l_orderkey", "l_linenumber", "l_quantity as quantity", "l_extendedprice as list_price",
    "cast(l_extendedprice * (1 - l_discount) as double) as net_price",
    "cast(l_extendedprice * (1 + l_tax) as double) as amount_ttc",
    "l_shipdate as shipped_at", "l_returnflag as returnflag",
]
AMOUNTS_SCHEMA = [
    ("l_orderkey", "bigint"), ("l_linenumber", "int"), ("quantity", "double"),
    ("list_price", "double"), ("net_price", "double"), ("amount_ttc", "double"),
    ("shipped_at", "timestamp_ntz"), ("returnflag", "string"),
]
# A growing mapping history: one row per part.
MAPPINGS = [
    "lower(p_type) as table_name", "concat('Col_', cast(p_partkey as string)) as column_name",
    "case p_size % 4 when 0 then 'Montant' when 1 then 'Client' when 2 then 'Date' "
    "else 'Nom' end as concept",
    "cast((p_size % 10) / 10.0 as double) as confidence", "p_name as rationale",
    "case p_partkey % 5 when 0 then 'validated' when 1 then 'corrected' when 2 then 'rejected' "
    "else 'proposed' end as status",
    "p_partkey % 7 = 0 as needs_arbitration",
]
AUDIT = [
    "event_id as analysis_id", "ts as created_at", "user_id", "event_type",
    "concat('about ', event_type) as question", "'select' as query",
    "case when event_id % 97 = 0 then EMPTY when event_id % 4 = 0 then LIST('orders') "
    "when event_id % 4 = 1 then LIST('main.orders', 'customer') "
    "when event_id % 4 = 2 then LIST('lineitem', 'part', 'supplier') "
    "else LIST('elsewhere') end as tables_used",
    "case event_id % 3 when 0 then LIST('o_totalprice', 'o_orderdate') "
    "when 1 then LIST('customer.c_acctbal', 'l_tax') else LIST('o_orderstatus') end "
    "as columns_used",
    "case when value > 150 then 'blocked' when event_type = 'error' then 'error' "
    "when event_type = 'signup' then 'clarification' "
    "when event_type = 'purchase' and event_id % 3 = 0 then 'unanswerable' else 'ok' end "
    "as status",
    "cast(null as string) as block_reason",
    "cast(value * 100 as double) as estimated_cost",
    "case when event_id % 17 = 0 then 0 else event_id % 500 + 1 end as row_count",
    "case when event_id % 11 = 0 then null else cast(floor(value * 10) as bigint) end "
    "as duration_ms",
    "event_id % 23 = 0 as truncated", "event_id % 19 = 0 as sampled",
    "event_id % 5 as n_assumptions",
    "case when event_id % 13 = 0 then null else cast((user_id % 10) / 10.0 as double) end "
    "as confidence",
    "event_id % 2 = 0 as aggregates", "event_id % 29 = 0 as causal",
    "event_id % 58 <> 0 as has_drivers",
]
# Table quality that moves with the data.
QUALITY = {
    "orders": "avg(case when o_orderkey % 70 = 0 then 0e0 else 1e0 end)",
    "customer": "avg(case when c_custkey % 13 = 0 then 0e0 else 1e0 end)",
    "lineitem": "avg(case when l_linenumber > 5 then 0e0 else 1e0 end)",
    "part": "avg(case when p_size > 30 then 0e0 else 1e0 end)",
}


def _spark_lists(text: str) -> str:
    return text.replace("EMPTY", "cast(array() as array<string>)").replace("LIST(", "array(")


def _duck_lists(text: str) -> str:
    return text.replace("EMPTY", "cast([] as varchar[])").replace("LIST(", "list_value(")


def contacts(spark, sf):
    return table(spark, sf, "customer").selectExpr(*CONTACTS)


def orders_plus(spark, sf):
    return table(spark, sf, "orders").selectExpr(*ORDERS_PLUS)


def amounts(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(*AMOUNTS)


def mappings(spark, sf):
    return table(spark, sf, "part").selectExpr(*MAPPINGS)


def audit(spark, sf):
    return table(spark, sf, "events").selectExpr(*[_spark_lists(e) for e in AUDIT])


def quality_scores(spark, sf):
    parts = [
        table(spark, sf, name).agg(F.expr(e).cast("double").alias("score")).select(
            F.lit(name).alias("table_name"), "score")
        for name, e in QUALITY.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def edges(spark):
    """The known relations of the star, as a catalog would list them."""
    return spark.createDataFrame(
        [(*e[:4], "inferred", "proposed", e[4]) for e in EDGES],
        "from_table string, from_column string, to_table string, to_column string, "
        "kind string, status string, confidence double",
    )


CONTACTS_SQL = f"(select {', '.join(CONTACTS)} from customer)"
ORDERS_PLUS_SQL = f"(select {', '.join(ORDERS_PLUS)} from orders)"
AMOUNTS_SQL = f"(select {', '.join(AMOUNTS)} from lineitem)"
MAPPINGS_SQL = f"(select {', '.join(MAPPINGS)} from part)"
AUDIT_SQL = f"(select {', '.join(_duck_lists(e) for e in AUDIT)} from events)"
QUALITY_SQL = "(" + " union all ".join(
    f"select '{t}' as table_name, cast({e} as double) as score from {t}"
    for t, e in QUALITY.items()) + ")"
EDGES_SQL = "(values " + ", ".join(
    f"('{a}', '{b}', '{c}', '{d}', 'inferred', 'proposed', cast({e} as double))"
    for a, b, c, d, e in EDGES
) + ") as edges(from_table, from_column, to_table, to_column, kind, status, confidence)"
LEXICON_SQL = "(values " + ", ".join(
    f"('{e['concept']}', '{e['description']}', "
    + ("cast([] as varchar[])" if not e["name_hints"] else
       "[" + ", ".join(f"'{h}'" for h in e["name_hints"]) + "]") + ")"
    for e in fixed.LEXICON
) + ") as lexicon(concept, description, synonyms)"


# --- oracle side of a profile: one branch per column -----------------------------------------

re_search = re.search


def _re(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def facts_sql(name: str, source: str, columns) -> str:
    """SQL for the raw facts of every column of one table."""
    branches = []
    for i, (column, type_name) in enumerate(columns, start=1):
        kind = kind_of(type_name)
        c = f'"{column}"'
        v = f"trim(cast({c} as varchar), chr(32)||chr(9)||chr(10)||chr(13)||chr(12)||chr(11))"
        tested = kind in ("text", "integer")
        number = kind in ("integer", "number")
        extremes = kind != "other"
        filled = f"length({v}) > 0"

        def hits(test):
            return f"count(*) filter ({filled} and {test})" if tested else "0"

        def every(test):
            if not tested:
                return "false"
            return f"coalesce(bool_and({test}) filter ({filled}), true)"

        def bad(pattern):
            if not tested:
                return "0"
            return f"count(*) filter ({c} is not null and not regexp_matches({v}, {_re(pattern)}))"

        dated = f"regexp_matches({v}, {_re(fixed.DATE_LIKE)})"
        pii = []
        for kind_name, pattern in fixed.PII_PATTERNS.items():
            test = f"regexp_matches({v}, {_re(pattern)}) and not {dated}"
            if kind_name == "phone":
                digits = f"length(regexp_replace({v}, '\\D', '', 'g'))"
                test += f" and {digits} between 10 and 15"
            pii.append(f"{hits(test)} as pii_{kind_name}")
        booleans = ", ".join(f"'{b}'" for b in fixed.TEXT_BOOLEANS)
        number_test = (f"(regexp_matches({v}, {_re(fixed.TEXT_INTEGER)}) "
                       f"or regexp_matches({v}, {_re(fixed.TEXT_DECIMAL)}))")
        extreme_low = f"cast(min({c}) as varchar)" if extremes else "cast(null as varchar)"
        extreme_high = f"cast(max({c}) as varchar)" if extremes else "cast(null as varchar)"
        mean = f"cast(avg({c}) as double)" if number else "cast(null as double)"
        date_test = f"regexp_matches({v}, {_re(fixed.TEXT_DATE)})"
        integer_test = f"regexp_matches({v}, {_re(fixed.TEXT_INTEGER)})"
        branches.append(
            f"select '{name}' as table_name, '{column}' as column_name, {i} as ordinal, "
            f"'{type_name}' as declared_type, '{kind}' as kind, count(*) as sample_size, "
            f"count({c}) as non_null_count, count(*) - count({c}) as null_count, "
            f"count(distinct {c}) as distinct_count, {extreme_low} as min_value, "
            f"{extreme_high} as max_value, {mean} as mean_value, "
            f"avg(length(cast({c} as varchar))) as avg_length, "
            f"count(*) filter ({filled}) as filled, {', '.join(pii)}, "
            f"{every(date_test)} as is_date, {every(integer_test)} as is_integer, "
            f"{every(number_test)} as is_number, "
            f"{every(f'lower({v}) in ({booleans})')} as is_boolean, "
            + ", ".join(f"{bad(p)} as bad_{f}" for f, p in fixed.FORMATS.items())
            + f" from {source} as src"
        )
    return " union all ".join(branches)


def profile_sql(*parts) -> str:
    """SQL for finished profiles; each part is (name, source, columns)."""
    facts = " union all ".join(facts_sql(*p) for p in parts)
    by_value = "case " + " ".join(
        f"when filled > 0 and pii_{p} >= 0.8 * filled then '{p}'" for p in fixed.PII_PATTERNS
    ) + " end"
    by_name = "case " + " ".join(
        "when " + " or ".join(f"contains(lower(column_name), '{h}')" for h in hints)
        + f" then '{p}'" for p, hints in fixed.PII_NAME_HINTS.items()
    ) + " end"
    invalid = "case format_checked " + " ".join(
        f"when '{f}' then bad_{f}" for f in fixed.FORMATS) + " end"
    return f"""
      select *, {invalid} as invalid_count from (
        select *, case when kind = 'text' and non_null_count > 0 then
            case when pii_type in ('email', 'phone', 'iban', 'siret') then pii_type
                 when detected_type = 'datetime (text)' then 'date'
                 when detected_type = 'integer (text)' then 'integer'
                 when detected_type = 'numeric (text)' then 'numeric' end
          end as format_checked
        from (
          select *,
            case when kind = 'integer' then 'integer' when kind = 'number' then 'numeric'
                 when kind = 'boolean' then 'boolean' when kind = 'temporal' then 'datetime'
                 when kind <> 'text' or filled = 0 then 'text'
                 when is_date then 'datetime (text)' when is_integer then 'integer (text)'
                 when is_number then 'numeric (text)' when is_boolean then 'boolean (text)'
                 else 'text' end as detected_type,
            coalesce({by_value}, {by_name}) as pii_type,
            case when {by_value} is not null then 'values'
                 when {by_name} is not null then 'name' end as found_by
          from ({facts})))"""


CONTACTS_PART = ("customer", CONTACTS_SQL, CONTACTS_SCHEMA)
ORDERS_PART = ("orders", ORDERS_PLUS_SQL, ORDERS_PLUS_SCHEMA)
AMOUNTS_PART = ("amounts", AMOUNTS_SQL, AMOUNTS_SCHEMA)


def plain_part(name: str):
    return (name, name, SCHEMA[name])


def unique_keys_sql(names) -> str:
    """(table_name, column_name) of key-named integer columns that are unique and full."""
    checks = []
    for name in names:
        for column, type_name in SCHEMA[name]:
            low = column.lower()
            if type_name in ("int", "bigint") and (low == "id" or low.endswith(("_id", "key"))):
                checks.append(
                    f"select '{name}' as table_name, '{column}' as column_name from {name} "
                    f"having count(*) = count({column}) and count(*) = count(distinct {column}) "
                    f"and count(*) > 0")
    return "(" + " union all ".join(checks) + ")"


def columns_sql(names) -> str:
    """(table_name, column_name, ordinal, data_type) as the catalog lists them."""
    kinds = ("case column_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' "
             "when 'VARCHAR' then 'string' when 'DOUBLE' then 'double' "
             "when 'TIMESTAMP' then 'timestamp_ntz' when 'FLOAT[]' then 'array<float>' end")
    return "(" + " union all ".join(
        f"select '{n}' as table_name, column_name, "
        f"cast(row_number() over () as int) as ordinal, {kinds} as data_type "
        f"from (describe {n})" for n in names) + ")"


def sizes_sql(names) -> str:
    return "(" + " union all ".join(
        f"select '{n}' as table_name, count(*) as n_rows from {n}" for n in names) + ")"

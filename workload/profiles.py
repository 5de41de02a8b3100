"""Column profiles of the test tables and of views with planted defects."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyglass.operators import distinct, profile as P, stored
from tallyglass.session import ensure_checkpoint_dir
from tallyglass.sources.catalog import union_all
from workload import base
from workload.base import profile_sql, query, table, tables

FLAT = ["table_name", "column_name", "ordinal", "declared_type", "sample_size", "null_count",
        "non_null_count", "null_rate", "distinct_count", "distinct_ratio", "min_value",
        "max_value", "mean_value", "avg_length", "detected_type", "pii_type", "format_checked",
        "invalid_count"]
# Digits kept; a mean of cents over 60,000 rows can end exactly half way at six.
RATES = {"null_rate": 6, "distinct_ratio": 6, "mean_value": 7, "avg_length": 6}


def flat(df, columns=None):
    """Profile columns that SQL shows alike, rates rounded."""
    return df.select(*[
        F.round(c, RATES[c]).alias(c) if c in RATES else F.col(c) for c in columns or FLAT
    ])


def flat_sql(*parts, columns=None, where="true") -> str:
    expressions = {
        "null_rate": "round(1 - non_null_count / cast(sample_size as double), 6) as null_rate",
        "distinct_ratio": "round(distinct_count / cast(nullif(non_null_count, 0) as double), 6) "
                          "as distinct_ratio",
        "mean_value": "round(mean_value, 7) as mean_value",
        "avg_length": "round(avg_length, 6) as avg_length",
    }
    shown = ", ".join(expressions.get(c, c) for c in columns or FLAT)
    return f"select {shown} from ({profile_sql(*parts)}) where {where}"


def contacts_profile(spark, sf):
    return P.profile(base.contacts(spark, sf), "customer")


def orders_profile(spark, sf):
    return P.profile(base.orders_plus(spark, sf), "orders")


@query("C1_profile_customer", flat_sql(base.CONTACTS_PART))
def _(spark, sf):
    return flat(contacts_profile(spark, sf))


@query("C1_profile_lineitem", flat_sql(base.plain_part("lineitem")))
def _(spark, sf):
    return flat(P.profile(table(spark, sf, "lineitem"), "lineitem"))


NULLS = ["table_name", "column_name", "null_count", "non_null_count", "null_rate"]


@query("C2_null_rates", flat_sql(base.CONTACTS_PART, columns=NULLS))
def _(spark, sf):
    return flat(contacts_profile(spark, sf), NULLS)


DISTINCT = ["table_name", "column_name", "distinct_count", "distinct_ratio"]


@query("C3_distinct_counts", flat_sql(base.plain_part("pages"), base.plain_part("conversations"),
                                      columns=DISTINCT))
def _(spark, sf):
    return flat(union_all([P.profile(table(spark, sf, n), n)
                           for n in ("pages", "conversations")]), DISTINCT)


@query("C4_top_values", " union all ".join(
    f"select '{c}' as column_name, cast(row_number() over (order by count(*) desc, "
    f"cast({c} as varchar)) as int) as rank, cast({c} as varchar) as value, count(*) as n "
    f"from orders where {c} is not null group by {c} "
    f"qualify row_number() over (order by count(*) desc, cast({c} as varchar)) <= 10"
    for c, _ in base.SCHEMA["orders"]
))
def _(spark, sf):
    return P.top_values(table(spark, sf, "orders"))


@query("C4_top_texts", """
select 'text' as column_name, cast(row_number() over (order by n desc, shown) as int) as rank,
  value, n
from (select text as value, case when length(text) > 256 then sha256(text) else text end as shown,
        count(*) as n from documents where text is not null group by text)
qualify row_number() over (order by n desc, shown) <= 10
""")
def _(spark, sf):
    return P.top_values(table(spark, sf, "documents"), columns=["text"])


@query("C5_extremes", flat_sql(base.plain_part("events"), base.plain_part("embeddings"),
                               columns=["table_name", "column_name", "min_value", "max_value"]))
def _(spark, sf):
    return flat(union_all([P.profile(table(spark, sf, n), n) for n in ("events", "embeddings")]),
                ["table_name", "column_name", "min_value", "max_value"])


@query("C6_means", flat_sql(base.plain_part("part"),
                            columns=["table_name", "column_name", "mean_value"]))
def _(spark, sf):
    return flat(P.profile(table(spark, sf, "part"), "part"),
                ["table_name", "column_name", "mean_value"])


@query("C7_text_lengths", flat_sql(base.plain_part("documents"),
                                   columns=["table_name", "column_name", "avg_length"]))
def _(spark, sf):
    return flat(P.profile(table(spark, sf, "documents"), "documents"),
                ["table_name", "column_name", "avg_length"])


@query("C8_hidden_types", f"""
select column_name, detected_type from ({profile_sql(base.ORDERS_PART)})
union all select column_name, detected_type from ({profile_sql(base.CONTACTS_PART)})
""")
def _(spark, sf):
    return P.detect_types(base.orders_plus(spark, sf)).unionByName(
        P.detect_types(base.contacts(spark, sf)))


FORMATS = ["table_name", "column_name", "detected_type", "pii_type", "format_checked"]


@query("C9_expected_formats", flat_sql(base.CONTACTS_PART, base.ORDERS_PART, columns=FORMATS))
def _(spark, sf):
    return flat(contacts_profile(spark, sf).unionByName(orders_profile(spark, sf)), FORMATS)


CHECKED = {"email": "email", "phone": "phone", "iban": "iban", "siret": "siret",
           "balance_text": "numeric", "opted_in": "integer"}


@query("C10_validity", " union all ".join(
    f"select '{c}' as column_name, '{f}' as format_checked, count({c}) as checked, "
    f"count(*) filter (not regexp_matches(trim({c}), {base._re(base.fixed.FORMATS[f])})) "
    f"as invalid_count from {base.CONTACTS_SQL}" for c, f in CHECKED.items()))
def _(spark, sf):
    return P.validity(base.contacts(spark, sf), CHECKED)


@query("C11_personal_data", f"""
select column_name, pii_type, found_by from ({profile_sql(base.CONTACTS_PART)})
""")
def _(spark, sf):
    return P.detect_pii(base.contacts(spark, sf))


@query("C12_key_candidates", " union all ".join(
    f"select '{t}' as table_name, '{c}' as column_name, {i} as ordinal, "
    f"count(distinct {c}) as distinct_count from {t} "
    f"having count(*) = count({c}) and count(*) = count(distinct {c})"
    for t in base.ALL
    for i, (c, _) in enumerate(base.SCHEMA[t], start=1)))
def _(spark, sf):
    return P.key_candidates(P.profile_all(tables(spark, sf)))


EVERYTHING = ["table_name", "column_name", "sample_size", "null_count", "distinct_count",
              "detected_type", "pii_type", "invalid_count"]


@query("C13_profile_all_tables", flat_sql(*[base.plain_part(t) for t in base.SCHEMA],
                                          columns=EVERYTHING))
def _(spark, sf):
    return flat(P.profile_all(tables(spark, sf)), EVERYTHING)


@query("C13_reprofile_one_table", flat_sql(base.plain_part("supplier"), base.plain_part("nation"),
                                           columns=EVERYTHING))
def _(spark, sf):
    known = tables(spark, sf, ["supplier", "nation"])
    stale = P.profile_all({"supplier": known["supplier"].limit(0), "nation": known["nation"]})
    return flat(P.profile_all(known, only="supplier", existing_df=stale), EVERYTHING)


@query("C1_profile_by_summaries", flat_sql(base.plain_part("lineitem"), base.plain_part("orders"),
                                           base.plain_part("documents")))
def _(spark, sf):
    """As a large table is profiled: no value of a whole-number column is shuffled."""
    return flat(P.profile_all(tables(spark, sf, ("lineitem", "orders", "documents")),
                              small_bytes=0))


INTEGERS = [(t, c) for t, columns in base.SCHEMA.items() for c, kind in columns
            if kind in ("int", "bigint")]


@query("C3_distinct_by_bitmaps", " union all ".join(
    f"select '{t}' as table_name, '{c}' as column_name, count(*) as row_count, "
    f"count({c}) as non_null_count, count(distinct {c}) as distinct_count from {t}"
    for t, c in INTEGERS))
def _(spark, sf):
    return distinct.distinct_numbers(tables(spark, sf))


@query("C12_unique_numbers", " union all ".join(
    f"select '{t}' as table_name, '{c}' as column_name, count(distinct {c}) as distinct_count "
    f"from {t} having count(*) = count({c}) and count(*) = count(distinct {c}) and count(*) > 0"
    for t, c in INTEGERS))
def _(spark, sf):
    return distinct.unique_numbers(tables(spark, sf))


@query("C13_incremental_profile", f"""
select table_name, column_name, ordinal, declared_type, sample_size as row_count, null_count,
  non_null_count, round(1 - non_null_count / cast(sample_size as double), 6) as null_rate,
  case when kind = 'integer' then distinct_count end as distinct_count,
  kind = 'integer' as distinct_is_exact, min_value, max_value, round(mean_value, 7) as mean_value,
  round(avg_length, 6) as avg_length
from ({profile_sql(base.plain_part("events"))})
""")
def _(spark, sf):
    """The events come in two loads; each leaves its state, and the states fold into the profile."""
    store = f"{ensure_checkpoint_dir(spark)}/profile-{uuid.uuid4().hex}"
    rows = table(spark, sf, "events")
    for load in (0, 1):
        part = rows.where(F.col("event_id") % 2 == load).withColumn("__load", F.lit(f"load {load}"))
        stored.profile_state(part, "__load").write.mode("append").parquet(store)
    known = stored.profile_of_state(spark.read.parquet(store), "events")
    return known.withColumns({
        "distinct_count": F.when(F.col("distinct_is_exact"), F.col("distinct_count")),
        "null_rate": F.round("null_rate", 6), "mean_value": F.round("mean_value", 7),
        "avg_length": F.round("avg_length", 6)})


@query("A4_profile_of_files", flat_sql(base.plain_part("supplier"), columns=[
    "column_name", "sample_size", "null_count", "min_value", "max_value"]))
def _(spark, sf):
    """A folder of files is profiled, then again with more files: only the new ones are read."""
    folder = f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"
    rows = table(spark, sf, "supplier")
    for load in (0, 1):
        rows.where(F.col("s_suppkey") % 2 == load).write.mode("append").parquet(f"{folder}/data")
        stored.refresh(spark, f"{folder}/data", f"{folder}/state")
    return stored.stored_profile(spark, f"{folder}/data", f"{folder}/state", "supplier").select(
        "column_name", F.col("row_count").alias("sample_size"), "null_count", "min_value",
        "max_value")

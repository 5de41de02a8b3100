from __future__ import annotations

import pytest

from tallyglass.operators import alerts, quality, relations, trust

PROFILE = ("table_name string, column_name string, declared_type string, sampled boolean, "
           "null_count bigint, non_null_count bigint, distinct_count bigint, "
           "distinct_ratio double, max_value string, detected_type string, pii_type string, "
           "format_checked string, invalid_count bigint")
MEASURED = ("from_table string, from_column string, to_table string, to_column string, "
            "total bigint, orphans bigint, ratio double")


def scores(spark, row, measured=(), keys=(), weights=None, as_of="2024-06-01"):
    profile = spark.createDataFrame([("t", "c", *row)], PROFILE)
    result = quality.quality_columns(
        profile, spark.createDataFrame(list(measured), MEASURED),
        spark.createDataFrame(list(keys), "table_name string, column_name string"), as_of,
        weights).first()
    return result.score, {d.name: d.score for d in result.dimensions}


def test_completeness_alone_is_the_score(spark):
    row = ("string", False, 10, 90, 5, 5 / 90, None, "text", None, None, None)
    total, parts = scores(spark, row)
    assert parts["completeness"] == pytest.approx(0.9) and total == pytest.approx(0.9)
    assert [n for n, s in parts.items() if s is not None] == ["completeness"]


def test_weights_are_shared_among_dimensions_that_apply(spark):
    row = ("string", False, 0, 100, 100, 1.0, None, "text", "email", "email", 20)
    total, parts = scores(spark, row)
    assert parts["validity"] == pytest.approx(0.8) and parts["uniqueness"] == 1.0
    assert total == pytest.approx((0.30 + 0.25 * 0.8 + 0.15) / 0.70)


@pytest.mark.parametrize("latest, expected", [
    ("2024-05-01", 1.0), ("2022-01-01", 0.0), ("2023-06-02 10:00:00", 1 - (365 - 90) / 640),
])
def test_freshness_fades_between_90_and_730_days(spark, latest, expected):
    row = ("date", False, 0, 10, 10, 1.0, latest, "datetime", None, None, None)
    assert scores(spark, row)[1]["freshness"] == pytest.approx(expected)
    assert scores(spark, row)[1]["uniqueness"] is None


def test_worst_relation_decides_consistency(spark):
    row = ("bigint", False, 0, 10, 3, 0.3, "9", "integer", None, None, None)
    measured = [("t", "c", "a", "id", 10, 1, 0.9), ("t", "c", "b", "id", 10, 4, 0.6)]
    assert scores(spark, row, measured)[1]["consistency"] == pytest.approx(0.6)


def test_no_rows_is_complete(spark):
    row = ("string", False, 0, 0, 0, None, None, "text", None, None, None)
    assert scores(spark, row)[0] == 1.0


def test_unknown_weight_names_are_ignored():
    own = quality.resolve_weights({"completeness": 0.9, "taste": 1})
    assert own["completeness"] == 0.9 and "taste" not in own


AUDIT = ("analysis_id bigint, tables_used array<string>, columns_used array<string>, "
         "row_count bigint, sampled boolean, truncated boolean, n_assumptions bigint, "
         "aggregates boolean, causal boolean, has_drivers boolean")


def test_confidence_without_any_knowledge_stays_neutral(spark):
    audit = spark.createDataFrame(
        [(1, ["nowhere"], [], 5, False, False, 0, False, False, True)], AUDIT)
    none = spark.createDataFrame([], "table_name string, score double")
    mappings = spark.createDataFrame([], "table_name string, status string")
    edges = spark.createDataFrame(
        [], "from_table string, to_table string, kind string, status string")
    row = trust.confidence(audit, none, mappings, edges).first()
    assert row.score == pytest.approx(0.35 * 0.7 + 0.25 * 0.5 + 0.18 + 0.12 + 0.06 + 0.04)
    assert "quality unknown" in row.factors and "no concept known" in row.factors
    assert row.breakdown[0].contribution_pct >= row.breakdown[-1].contribution_pct


def test_fanout_future_dates_and_empty_results_are_noticed(spark):
    audit = spark.createDataFrame([
        (1, ["orders", "customers"], ["amount"], 5, False, False, 0, True, False, True),
        (2, ["orders"], ["day"], 0, False, False, 0, False, True, False),
    ], AUDIT)
    profile = spark.createDataFrame([
        ("orders", "amount", 1, 0.5, "9", "numeric"),
        ("orders", "amount_ttc", 2, 0.0, "9", "numeric"),
        ("orders", "day", 3, 0.0, "2999-01-01", "datetime"),
    ], "table_name string, column_name string, ordinal int, null_rate double, "
       "max_value string, detected_type string")
    measured = spark.createDataFrame(
        [("customers", "orders", "1-n")], "from_table string, to_table string, cardinality string")
    found = {(r.analysis_id, r.check): r.result for r in trust.checks(
        audit, profile, "2024-01-01", measured).collect()}
    assert found[1, "join_fanout"] == "warn" and found[1, "measure"] == "warn"
    assert found[1, "nulls"] == "warn" and found[1, "dates"] == "warn"
    assert found[2, "row_count"] == "fail" and found[2, "dates"] == "warn"
    assert (2, "join_fanout") not in found and (2, "measure") not in found


@pytest.mark.parametrize("quality_pct, concept, assumptions, expected", [
    (99, False, 0, "strong"), (95, True, 0, "strong"), (95, False, 0, "strong"),
    (85, False, 0, "medium"), (99, False, 1, "medium"), (60, True, 0, "weak"),
    (99, True, 3, "weak"), (None, False, 0, "medium"),
])
def test_evidence_levels(spark, quality_pct, concept, assumptions, expected):
    from pyspark.sql import functions as F

    level = trust.evidence_level(F.lit(quality_pct).cast("int"), F.lit(concept), F.lit(False),
                                 F.lit(assumptions))
    assert spark.range(1).select(level).first()[0] == expected


@pytest.mark.parametrize("comparison, threshold, before, value, expected", [
    ("gt", 100.0, None, 150.0, "triggered"), ("gt", 100.0, None, 100.0, "ok"),
    ("lt", 10.0, None, 5.0, "triggered"), ("pct_drop", 20.0, 1000.0, 500.0, "triggered"),
    ("pct_drop", 20.0, None, 500.0, "ok"), ("pct_drop", 20.0, 0.0, 500.0, "ok"),
    ("pct_change", 20.0, 100.0, 130.0, "triggered"), ("pct_change", 20.0, 100.0, 110.0, "ok"),
    ("gt", 1.0, 1.0, None, "error"),
])
def test_alert_conditions(spark, comparison, threshold, before, value, expected):
    values = spark.createDataFrame([("a", value)], "alert_id string, value double")
    rules = spark.createDataFrame(
        [("a", comparison, threshold)], "alert_id string, comparison string, threshold double")
    state = spark.createDataFrame(
        [("a", before, None, "new")],
        "alert_id string, last_value double, previous_value double, last_status string")
    done = alerts.evaluate_alerts(values, rules, state)
    assert done.first().status == expected
    rolled = alerts.roll_state(state, done).first()
    assert rolled.last_value == (before if value is None else value)
    assert rolled.previous_value == (None if value is None else before)


def test_windows_of_product_metrics_are_bounded(spark):
    with pytest.raises(ValueError):
        alerts.product_metrics(spark.range(1), "2024-01-01", days=0)


def edges_frame(spark, *edges):
    return spark.createDataFrame(
        [(*e, "inferred", "proposed", 0.8) for e in edges],
        "from_table string, from_column string, to_table string, to_column string, kind string, "
        "status string, confidence double")


def test_keys_of_different_types_are_compared_by_value(spark):
    tables = {"a": spark.sql("select 1L as k, -0.0D as f, '7' as t union all select 2L, 1.5D, 'x'"),
              "b": spark.sql("select cast(1 as decimal(10,2)) as k, 0 as f, 7 as t "
                             "union all select 2, 3, 8")}
    edges = edges_frame(spark, ("a", "k", "b", "k"), ("a", "f", "b", "f"), ("a", "t", "b", "t"))
    orphans = {r.from_column: r.orphans for r in relations.integrity(edges, tables).collect()}
    assert orphans == {"k": 0, "f": 1, "t": 1}


def test_two_edges_to_one_table_and_all_linked_tables(spark):
    tables = {"orders": spark.sql("select 1 as billing, 2 as shipping, 1 as c, 1 as d, 1 as e"),
              "address": spark.sql("select 1 as id, 'Lyon' as city union all select 2, 'Lille'")}
    tables |= {n: spark.sql(f"select 1 as id, '{n}' as name") for n in ("cc", "dd", "ee")}
    edges = edges_frame(
        spark, ("orders", "billing", "address", "id"), ("orders", "shipping", "address", "id"),
        ("orders", "c", "cc", "id"), ("orders", "d", "dd", "id"), ("orders", "e", "ee", "id"))
    row = relations.star("orders", edges, tables).first()
    assert row["address_by_billing__city"] == "Lyon"
    assert row["address_by_shipping__city"] == "Lille"
    assert (row["cc__name"], row["dd__name"], row["ee__name"]) == ("cc", "dd", "ee")
    one = relations.star("orders", edges, tables, {"cc"})
    assert [c for c in one.columns if "__" in c] == ["cc__id", "cc__name"]


def test_only_a_table_with_one_key_is_pointed_to(spark):
    columns = spark.createDataFrame(
        [("store", "id", "bigint", True), ("store", "legacy_key", "bigint", True),
         ("item", "id", "bigint", True), ("sale", "store_id", "bigint", False),
         ("sale", "item_id", "bigint", False)],
        "table_name string, column_name string, data_type string, is_pk boolean")
    sizes = spark.createDataFrame([("store", 3), ("item", 3), ("sale", 9)],
                                  "table_name string, n_rows bigint")
    rows = relations.infer_relations(columns, sizes).collect()
    assert [(r.from_column, r.to_table, r.to_column) for r in rows] == [("item_id", "item", "id")]

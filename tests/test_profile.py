from __future__ import annotations

import hashlib

import pytest

from tallyglass.operators import profile as P


def one(df, column):
    return {r.column_name: r for r in df.collect()}[column]


@pytest.mark.parametrize("column, values, expected", [
    ("v", ["post@museum.example", "kim+news@harbour.example", "info@lab-7.example"], "email"),
    ("v", ["DE89370400440532013000", "GB82WEST12345698765432"], "iban"),
    ("v", ["40483304800022", "55210055400013", "78467169500087"], "siret"),
    ("v", ["+33145678901", "0478123456", "+33 4 91 22 33 44"], "phone"),
    ("v", ["203.0.113.9", "198.51.100.77", "192.0.2.1"], "ipv4"),
    ("built_on", ["1998-02-17", "2001-10-08", "2019-06-23"], None),
    ("v", ["post@museum.example", "kim@harbour.example", "unknown"], None),
    ("work_email", ["-"], "email"),
    ("nom_agent", ["-"], "name"),
    ("v", [None, "\t", ""], None),
])
def test_personal_data(spark, column, values, expected):
    df = spark.createDataFrame([(v,) for v in values], f"`{column}` string")
    assert one(P.detect_pii(df), column).pii_type == expected


def test_share_of_values_counts_rows_not_distinct_values(spark):
    rows = [("post@museum.example",)] * 8 + [("none",), ("later",)]
    df = spark.createDataFrame(rows, "c string")
    assert one(P.detect_pii(df), "c").pii_type == "email"


def test_whole_numbers_can_look_like_telephones(spark):
    df = spark.createDataFrame([(33145678901,), (33478123456,)], "a bigint")
    assert one(P.detect_pii(df), "a").pii_type == "phone"
    small = spark.createDataFrame([(1,), (2,)], "a bigint")
    assert one(P.detect_pii(small), "a").pii_type is None


@pytest.mark.parametrize("values, expected", [
    (["2024-01-01", "2024-02-01 10:00"], "datetime (text)"),
    (["1", "-2", " 3 "], "integer (text)"),
    (["1", "2.5", "3,5"], "numeric (text)"),
    (["oui", "NON", "yes"], "boolean (text)"),
    (["1", "x"], "text"),
    ([None, ""], "text"),
])
def test_hidden_types(spark, values, expected):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    assert P.detect_types(df).first().detected_type == expected


def test_profile_of_a_small_table(spark):
    df = spark.createDataFrame(
        [(1, "a"), (2, "a"), (3, None), (4, "b")], "id bigint, word string")
    word = one(P.profile(df, "t"), "word")
    assert (word.null_count, word.non_null_count, word.distinct_count) == (1, 3, 2)
    assert word.null_rate == pytest.approx(0.25)
    assert [(v.value, v["count"]) for v in word.top_values] == [("a", 2), ("b", 1)]
    key = one(P.profile(df, "t"), "id")
    assert (key.min_value, key.max_value, key.mean_value) == ("1", "4", 2.5)
    keys = P.primary_keys(P.profile(df, "t")).collect()
    assert [(r.table_name, r.column_name) for r in keys] == [("t", "id")]


def test_long_texts_are_counted_whole_and_come_back_whole(spark):
    long_a, long_b = "x" * 5000 + "a", "x" * 5000 + "b"
    df = spark.createDataFrame([(long_a,), (long_a,), (long_b,), ("short",)], "doc string")
    found = P.profile(df, "t").first()
    assert found.distinct_count == 3
    assert found.top_values[0].value == long_a and found.top_values[0]["count"] == 2
    order = sorted([long_b, "short"], key=lambda v: (
        hashlib.sha256(v.encode()).hexdigest() if len(v) > 256 else v))
    assert [v.value for v in found.top_values[1:]] == order


def test_nested_and_binary_columns_have_no_extremes(spark):
    df = spark.createDataFrame([([1, 2], bytearray(b"x")), (None, None)], "a array<int>, b binary")
    rows = {r.column_name: r for r in P.profile(df, "t").collect()}
    assert rows["a"].min_value is None and rows["b"].max_value is None
    assert rows["a"].distinct_count == 1 and rows["b"].null_count == 1


def test_broken_table_is_reported_and_others_go_on(spark):
    class Broken:
        @property
        def schema(self):
            raise ValueError("no such file")

    good = spark.createDataFrame([(1,)], "id bigint")
    failed = {}
    rows = P.profile_all({"bad": Broken(), "good": good}, failed=failed).collect()
    assert [r.table_name for r in rows] == ["good"] and failed == {"bad": "no such file"}


def test_top_values_use_one_shared_shuffle_and_a_limit_before_it(spark):
    df = spark.range(1000).selectExpr("id", "cast(id % 7 as string) as word")
    plan = P.top_values(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2

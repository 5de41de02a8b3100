"""What keeps large tables cheap: candidates, bitmaps, stored state, streams, ranges and hash trees."""

from __future__ import annotations

import datetime
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyglass.functions.ordering import cut_points, previous_value, range_of
from tallyglass.operators import distinct, findings, heavy, paths, profile as P, segments, stored
from tallyglass.operators.segments import Dimension
from tallyglass.streaming import alerts as owned


@pytest.fixture(scope="module")
def columns(spark):
    """Columns of every kind of frequency: (c, item) rows, and their values by column."""
    rng = random.Random(5)
    values = {
        1: ["hot"] * 900 + [f"v{i}" for i in range(100)],
        2: [f"v{rng.randrange(300)}" for _ in range(3000)],
        3: [f"u{i}" for i in range(2000)],
        4: [f"w{i // 3}" for i in range(6000)] + ["w1"] * 4,
        5: ["only"], 6: [],
        7: [f"z{i % 12}" for i in range(24)],
    }
    rows = [(c, "=" + v) for c, many in values.items() for v in many]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "c int, item string").repartition(6), values


@pytest.mark.parametrize("tracked", [64, heavy.TRACKED])
def test_top_items_are_exact(spark, columns, tracked, monkeypatch):
    monkeypatch.setattr(heavy, "COLUMNS_AT_ONCE", 3)
    df, values = columns
    got = {(r.c, r["rank"]): (r["item"][1:], r.n)
           for r in heavy.top_items(df, list(values), 10, tracked).collect()}
    want = {(c, i): pair for c, many in values.items() for i, pair in enumerate(sorted(
        Counter(many).items(), key=lambda x: (-x[1], x[0]))[:10], 1)}
    assert got == want


def test_bitmaps_count_close_numbers_and_refuse_scattered_ones(spark):
    rng = random.Random(1)
    low = -(1 << 63)
    rows = [(i % 700 - 350, rng.randrange(low, -low), None) for i in range(40_000)]
    rows += [(None, low, None), (0, low, None), (-32768, low + 1, None), (32768, 0, None)]
    df = spark.createDataFrame(rows, "near bigint, far bigint, none int").repartition(4)
    _, values = distinct.whole_numbers({"t": df})
    assert distinct.dense(values) == {1: True, 2: False}
    got = {r.column_name: (r.row_count, r.non_null_count, r.distinct_count)
           for r in distinct.distinct_numbers({"t": df, "u": df.select(F.lit("x"))}).collect()}
    for i, name in enumerate(("near", "far", "none")):
        known = [r[i] for r in rows if r[i] is not None]
        assert got[name] == (len(rows), len(known), len(set(known)))
    _, both = distinct.whole_numbers({"t": df})
    exact = {r.c: r.distinct_count for r in distinct.by_bitmaps(both.where("v between -40000 and 40000")).collect()}
    assert exact[1] == got["near"][2]
    edge = spark.createDataFrame([(low,), (low + 1,), (low,), (-low - 1,), (0,), (-1,)], "v bigint")
    assert distinct.distinct_numbers({"e": edge}).first().distinct_count == 5
    keys = spark.range(1000).selectExpr("id", "id % 999 as almost", "if(id = 3, null, id) as gap")
    assert [r.column_name for r in distinct.unique_numbers({"k": keys}).collect()] == ["id"]
    assert distinct.unique_numbers({"k": keys.limit(0)}).isEmpty()


ODD = ("id bigint, price decimal(10,2), whole decimal(12,0), ratio float, day date, flag boolean, "
       "note string, tags array<string>, raw binary")


@pytest.fixture(scope="module")
def odd_table(spark):
    rng = random.Random(7)
    rows = [(i, Decimal(rng.randrange(-500, 99_999)) / 100, Decimal(i * 7), rng.random(),
             datetime.date(2020, 1, 1) + datetime.timedelta(rng.randrange(900)), rng.random() < .5,
             rng.choice([None, "", " ", "a note", "x" * 300, "y" * 300]), ["p", "q"][: i % 3], b"\x00\xff")
            for i in range(400)]
    return spark.createDataFrame(rows + [(None,) * 9, rows[3]], ODD).repartition(3)


def test_large_and_small_profiles_agree(spark, odd_table):
    for df in (odd_table, odd_table.limit(0), odd_table.where("id is null")):
        small, large = (sorted(map(str, P.profile(df, "t", small_bytes=n).collect()))
                        for n in (1 << 40, -1))
        assert small == large


def test_stored_states_fold_into_the_profile(spark, odd_table):
    cut = odd_table.withColumn("__part", F.expr("cast(id % 4 as string)"))
    state = stored.profile_state(cut, "__part")
    assert state.select("part").distinct().count() == 5  # NULL is a part
    got = {r.column_name: r for r in stored.profile_of_state(state, "t").collect()}
    want = {r.column_name: r for r in P.profile(odd_table, "t").collect()}
    assert got.keys() == want.keys()
    for name, row in got.items():
        for fact in ("ordinal", "declared_type", "row_count", "null_count", "non_null_count"):
            assert row[fact] == want[name][fact], (name, fact)
        if name not in ("tags", "raw"):
            assert (row.min_value, row.max_value) == (want[name].min_value, want[name].max_value)
        assert row.avg_length == pytest.approx(want[name].avg_length), name
        assert row.distinct_count == pytest.approx(want[name].distinct_count, rel=.05)
        if want[name].mean_value is not None:
            assert row.mean_value == pytest.approx(want[name].mean_value)
    assert got["id"].distinct_is_exact and got["id"].distinct_count == 400
    assert not got["note"].distinct_is_exact
    twice = stored.merge_states(stored.merge_states(state, "part"))
    assert sorted(map(str, stored.profile_of_state(twice, "t").collect())) == sorted(
        map(str, stored.profile_of_state(state, "t").collect()))


def test_refresh_reads_only_new_and_replaced_files(spark, tmp_path):
    folder, store = str(tmp_path / "data"), str(tmp_path / "state")
    rows = spark.range(1000).selectExpr("id", "id % 10 as digit")
    rows.where("id < 600").coalesce(2).write.parquet(folder + "/a")
    assert stored.refresh(spark, folder, store) == {"files": 2, "read": 2}
    assert stored.refresh(spark, folder, store) == {"files": 2, "read": 0}
    rows.where("id >= 600").coalesce(1).write.parquet(folder + "/b")
    assert stored.refresh(spark, folder, store) == {"files": 3, "read": 1}

    def known():
        return {r.column_name: (r.row_count, r.distinct_count, r.max_value)
                for r in stored.stored_profile(spark, folder, store, "t").collect()}

    assert known() == {"id": (1000, 1000, "999"), "digit": (1000, 10, "9")}
    rows.where("id between 600 and 649").coalesce(1).write.mode("overwrite").parquet(folder + "/b")
    assert stored.refresh(spark, folder, store)["read"] == 1
    assert known() == {"id": (650, 650, "649"), "digit": (650, 10, "9")}


RULES = [("many", "t", "count(*)", None, None, "gt", 5.0),
         ("sum", "t", "sum(v)", None, None, "pct_drop", 10.0),
         ("bad", "t", "sum(nothing)", None, None, "gt", 1.0)]
RULE = ("alert_id string, table_name string, expression string, filter string, definition string, "
        "comparison string, threshold double")


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    store, rules = str(tmp_path / "store"), spark.createDataFrame(RULES, RULE)
    first, second = spark.range(10).selectExpr("id as v"), spark.range(3).selectExpr("id as v")
    owned.apply_batch(first, 0, "t", rules, store)
    owned.apply_batch(second, 1, "t", rules, store)

    def rows():
        return (sorted(map(str, owned.events(spark, store).drop("at").collect())),
                sorted(map(str, owned.state(spark, store).collect())))

    before = rows()
    owned.apply_batch(second, 1, "t", rules, store)
    assert rows() == before
    owned.apply_batch(first, 0, "t", rules, store)
    assert rows() == before
    state = {r.alert_id: r for r in owned.state(spark, store).collect()}
    assert (state["sum"].previous_value, state["sum"].last_value) == (45, 3)
    assert state["sum"].last_status == "triggered" and state["many"].last_status == "ok"
    assert state["bad"].last_status == "error" and state["bad"].last_value is None


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    folder, store = str(tmp_path / "in"), str(tmp_path / "store")
    rules = spark.createDataFrame(RULES[:1], RULE)
    for load in range(3):
        spark.range(load * 4).selectExpr("id as v").coalesce(1).write.mode("append").parquet(folder)
        owned.watch(spark, folder, "v bigint", "t", rules, store).awaitTermination()
    owned.watch(spark, folder, "v bigint", "t", rules, store).awaitTermination()
    got = {r.batch: r.value for r in owned.events(spark, store).collect()}
    assert [v for _, v in sorted(got.items())][-2:] == [4.0, 8.0]


def steps(spark, *rows):
    return spark.createDataFrame(
        [(a, "k", b, "k", float(fan), float(kept)) for a, b, fan, kept in rows],
        "source string, source_column string, target string, target_column string, fan_out double, "
        "kept double")


def test_paths_stop_at_cycles_and_multiply(spark):
    df = steps(spark, ("a", "b", 1, .5), ("b", "a", 4, 1), ("b", "c", 3, 1), ("c", "a", 1, 1),
               ("a", "c", 2, 1), ("c", "b", 1, 1))
    got = {r.path: r for r in paths.join_paths(df, "a", most_hops=5).collect()}
    assert set(got) == {"a -[k=k]-> b", "a -[k=k]-> b -[k=k]-> c", "a -[k=k]-> c",
                        "a -[k=k]-> c -[k=k]-> b"}
    far = got["a -[k=k]-> b -[k=k]-> c"]
    assert (far.hops, far.fan_out, far.kept, far.multiplies) == (2, 3, .5, True)
    best = {r.end_table: r.path for r in paths.safest_paths(paths.join_paths(df, "a")).collect()}
    assert best == {"b": "a -[k=k]-> b", "c": "a -[k=k]-> c"}
    assert paths.join_paths(df, "a' or true").isEmpty()
    assert paths.join_paths(df.limit(0), "a", "c").isEmpty()
    with pytest.raises(ValueError):
        paths.join_paths(df, "a", most_hops=7)


def test_steps_of_relations_with_orphans_and_repeats(spark):
    tables = {"f": spark.createDataFrame([(1,), (1,), (2,), (9,), (None,)], "k int"),
              "d": spark.createDataFrame([("1",), ("2",), ("2",), ("3",), (None,)], "k string")}
    edge = "from_table string, from_column string, to_table string, to_column string, status string"
    relations = spark.createDataFrame([("f", "k", "d", "k", "proposed"),
                                       ("d", "k", "f", "k", "rejected")], edge)
    got = {r.source: r for r in paths.edge_steps(relations, tables).collect()}
    assert got["f"].fan_out == pytest.approx(4 / 3) and got["f"].kept == pytest.approx(3 / 4)
    assert got["d"].fan_out == pytest.approx(4 / 3) and got["d"].kept == pytest.approx(3 / 4)


def test_ranges_hold_equal_shares_though_one_minute_holds_a_third(spark):
    df = spark.range(9000).selectExpr(
        "if(id % 2 = 0, 'hot', 'cold') as k",
        "timestamp_ntz '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0, "
        "if(id < 3000, id / 100D, id * 60)) as t", "if(id % 5 = 0, null, cast(id as double)) as v")
    position = F.unix_micros(F.col("t").cast("timestamp"))
    cuts = cut_points(df, position, rows=500)
    assert len(cuts) == 17
    sizes = df.groupBy(range_of(position, cuts).alias("r")).count().collect()
    assert len(sizes) == 18 and max(r["count"] for r in sizes) <= 550
    got = {r.t: r.p for r in previous_value(df, "t", "v", "p", ("k",), rows=500).collect()}
    last, want = {}, {}
    for r in sorted(df.collect(), key=lambda r: r.t):
        want[r.t] = last.get(r.k)
        if r.v is not None:
            last[r.k] = r.v
    assert got == want


def test_previous_value_by_numbers_and_null_keys(spark):
    rows = [(k, i / 4, float(i)) for i in range(200) for k in ("a", None)]
    df = spark.createDataFrame(rows, "k string, at double, v double")
    got = {(r.k, r.at): r.p for r in previous_value(df, "at", "v", "p", ("k",), rows=30).collect()}
    assert got == {(k, i / 4): (i - 1.0 if i else None) for i in range(200) for k in ("a", None)}
    assert previous_value(df.limit(0), "at", "v", "p", ("k",)).isEmpty()


def lines(spark, *rates):
    relations = spark.createDataFrame(
        [("f", "k", "d", "proposed", .5)],
        "from_table string, from_column string, to_table string, status string, ratio double")
    profile = spark.createDataFrame(
        [(t, c, r, None, "text", None) for t, c, r in rates],
        "table_name string, column_name string, null_rate double, invalid_count bigint, "
        "detected_type string, pii_type string")
    quality = spark.createDataFrame([("f", None, .5)],
                                    "table_name string, column_name string, score double")
    return relations, profile, quality


def test_fingerprint_trees_name_what_changed(spark):
    before = lines(spark, ("f", "a", .1), ("f", "b", .2), ("g", "a", .3), ("h", "a", .1))
    now = lines(spark, ("f", "b", .25), ("g", "a", .3), ("f", "a", .1), ("i", "a", .1))
    old, new = (findings.fingerprint_tree(*x) for x in (before, now))
    got = sorted(tuple(r) for r in findings.changes(old, new).collect())
    assert got == [("profiles", "f", "b", "changed"), ("profiles", "h", "a", "removed"),
                   ("profiles", "i", "a", "added")]
    assert findings.changes(old, old).isEmpty()
    again = findings.fingerprint_tree(before[0], before[1].orderBy(F.desc("null_rate")), before[2])
    assert sorted(map(str, again.collect())) == sorted(map(str, old.collect()))
    assert {r.level for r in old.collect()} == {0, 1, 2}


def test_crosstab_margins_are_sums_of_the_cells(spark):
    df = spark.createDataFrame([("x", "p", 1.0), ("x", "q", 2.0), ("y", "p", 4.0), ("y", None, 8.0),
                                (None, "q", 9.0), ("x", "p", None)], "d string, e string, v double")
    got = {(r.grouping_id, r.a, r.b): (r.n, r.total) for r in segments.crosstab_margins(
        df, Dimension.category("d"), Dimension.category("e"), "v").collect()}
    assert got[0, "x", "p"] == (2, 1.0) and got[1, "x", None] == (3, 3.0)
    assert got[2, None, "p"] == (3, 5.0) and got[3, None, None] == (4, 7.0)
    assert segments.crosstab_margins(df.limit(0), Dimension.category("d"),
                                     Dimension.category("e")).isEmpty()

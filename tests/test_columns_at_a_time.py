"""Large files are read a column at a time, with the rows of a table read at once."""

from __future__ import annotations

from tallyglass.operators import profile as P, relations as R, result
from tallyglass.session import ADVISED, configure


def test_a_large_file_is_profiled_a_column_at_a_time(spark, tmp_path, monkeypatch):
    rows = spark.range(300).selectExpr(
        "id", "cast(id % 7 as tinyint) as small", "if(id % 5 = 0, null, id) as gaps",
        "case id % 6 when 0 then 0.0D when 1 then -0.0D when 2 then double('nan') when 3 then null "
        "when 4 then double('infinity') else id / 3 end as number",
        "cast(if(id % 2 = 0, 0.1, -0.0) as float) as narrow",
        "timestamp_ntz'2024-02-29 23:59:59.000001' + make_interval(0, 0, 0, cast(id % 9 as int)) as at",
        "date_add(date'2020-01-01', cast(id % 4 as int)) as day", "id % 3 = 0 as flag",
        "cast(id % 8 as decimal(10, 2)) as price", "array(id % 2) as list",
        "case id % 4 when 0 then null when 1 then ' ' when 2 then repeat(string(id % 10), 300) "
        "else concat('33', lpad(string(id), 9, '6')) end as word",
        "string(date_add(date'2020-01-01', cast(id % 50 as int))) as day_text")
    rows.write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t").where("id >= 0")
    assert not P.cells({"t": df}).typed
    want = sorted(map(str, P.profile(df, "t").collect()))
    roles = sorted(result.column_roles(df).collect())
    monkeypatch.setattr(P, "COLUMNWISE_BYTES", 0)
    source = P.cells({"t": df})
    assert len(source.typed) == 5  # whole numbers, two kinds of fractions, times and dates
    assert sorted(map(str, P.profile(df, "t").collect())) == want
    assert sorted(result.column_roles(df).collect()) == roles
    monkeypatch.setattr(P, "COLUMNWISE_PARTS", 2)
    assert sorted(map(str, P.profile(df, "t").collect())) == want
    numbers = df.select("id", "number")
    only_numbers = P.cells({"t": numbers})
    assert only_numbers.texts is None
    assert result.column_roles(numbers).count() == 2
    # A task that reads a split meets the values of one column, not of all.
    monkeypatch.undo()
    monkeypatch.setattr(P, "COLUMNWISE_BYTES", 0)
    one = spark.read.parquet(f"{tmp_path}/t").coalesce(1)
    assert not P.cells({"t": one}).typed  # no plain file
    tasks = P.cells({"t": df}).texts.selectExpr(
        "spark_partition_id() as p", "c").distinct().groupBy("p").count()
    assert {r["count"] for r in tasks.collect()} == {1}


def test_roles_of_a_large_file_are_counted_a_column_at_a_time(spark, tmp_path, monkeypatch):
    spark.range(50).selectExpr("id", "string(id) as word").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    want = sorted(result.column_roles(df).collect())
    monkeypatch.setattr(P, "COLUMNWISE_BYTES", 0)
    found = result.column_roles(df)
    assert sorted(found.collect()) == want
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_relations_of_a_large_file_are_measured_an_edge_at_a_time(spark, tmp_path, monkeypatch):
    spark.range(40).selectExpr(
        "if(id % 9 = 0, null, id % 12) as a_id", "cast(id % 3 as string) as b_id"
    ).write.parquet(f"{tmp_path}/f")
    spark.range(10).selectExpr("id as a_id").write.parquet(f"{tmp_path}/a")
    spark.range(2).selectExpr("id as b_id").write.parquet(f"{tmp_path}/b")
    tables = {n: spark.read.parquet(f"{tmp_path}/{n}") for n in "fab"}
    edges = spark.createDataFrame([("f", "a_id", "a", "a_id"), ("f", "b_id", "b", "b_id")], R.EDGE)
    want = sorted(R.measure_relations(edges, tables).collect())
    assert [(r.total, r.orphans) for r in want] == [(35, 6), (40, 13)]
    monkeypatch.setattr(P, "COLUMNWISE_BYTES", 0)
    found = R.measure_relations(edges, tables)
    assert sorted(found.collect()) == want
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_shuffled_partitions_are_small_where_the_application_sets_nothing(spark):
    started_with = spark.sparkContext.getConf()
    configure(spark)
    for key, value in ADVISED.items():
        assert spark.conf.get(key) == started_with.get(key, value)

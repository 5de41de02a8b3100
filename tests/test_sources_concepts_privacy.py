from __future__ import annotations

import pytest

from tallyglass.operators import privacy, query, relations, semantics
from tallyglass.sources import access, catalog, delimited, sinks


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_delimited_file_with_bom_blank_header_and_decimal_comma(spark, tmp_path):
    path = write(tmp_path, "Ventes 2024.csv",
                 "﻿id;produit;;montant\n1;Stylo;x;2,50\n2;;y;3\n3;Livre;;10,1\n")
    df = delimited.read_delimited(spark, path)
    assert dict(df.dtypes) == {"id": "bigint", "produit": "string", "col_2": "string",
                               "montant": "double"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [
        (1, "Stylo", "x", 2.5), (2, None, "y", 3.0), (3, "Livre", None, 10.1)]
    assert delimited.table_name(path) == "ventes_2024"
    assert delimited.table_name("/a/2024.csv") == "t_2024"


def test_delimited_types_use_every_row_and_quotes_may_span_lines(spark, tmp_path):
    body = "a,b\n" + "".join(f"{i},1\n" for i in range(600)) + "600,oops\n"
    df = delimited.read_delimited(spark, write(tmp_path, "t.csv", body))
    assert dict(df.dtypes) == {"a": "bigint", "b": "string"} and df.count() == 601
    spanning = write(tmp_path, "s.csv", 'a,b\n1,"two\nlines"\n2,x\n')
    spanned = delimited.read_delimited(spark, spanning, multi_line=True)
    assert spanned.orderBy("a").first().b == "two\nlines"


def test_delimiter_is_decided_by_all_lines_and_an_odd_quote_spoils_one(spark, tmp_path):
    late = write(tmp_path, "late.csv", "a;b\n" + "1,5;2\n" * 500 + "3;4\n")
    assert delimited.read_delimited(spark, late).count() == 501
    odd = write(tmp_path, "odd.csv", 'a,b\n1,x\n2,"open\n3,y\n4,z\n')
    assert delimited.read_delimited(spark, odd).count() == 4


def test_bounded_flags_only_what_was_really_cut(spark):
    df = spark.range(10)
    assert access.bounded(df, 10).first().truncated is False
    assert access.bounded(df, 9).first().truncated is True
    assert access.bounded(df, 9).count() == 9


def test_hidden_tables_and_columns_reach_nobody_in_the_team(spark):
    columns = spark.createDataFrame(
        [("Orders", "Amount", "int"), ("Orders", "id", "int"), ("staff", "id", "int")],
        "table_name string, column_name string, data_type string")
    off = spark.createDataFrame(
        [("a", "orders", "amount"), ("a", "STAFF", None), ("b", "orders", None)],
        "space string, table_name string, column_name string")
    seen = access.visible_columns(columns, off, "a").collect()
    assert [(r.table_name, r.column_name) for r in seen] == [("Orders", "id")]
    tables = {"Orders": spark.createDataFrame([(1, 2)], "Amount int, id int"),
              "staff": spark.createDataFrame([(1,)], "id int")}
    left = access.govern(tables, off, "a")
    assert list(left) == ["Orders"] and left["Orders"].columns == ["id"]
    assert set(access.govern(tables, off, "c")) == {"Orders", "staff"}


def test_sample_is_asked_for_and_the_same_everywhere(spark):
    df = spark.range(1_200_000)
    assert access.sampled(df, 1.0, "id").count() == 1_200_000
    part = access.sampled(df, 0.1, "id")
    assert abs(part.count() - 120_000) < 2_000
    some = access.sampled(df.where("id % 7 = 0"), 0.1, "id")
    assert some.join(part, "id", "left_anti").count() == 0
    assert access.sampled(df, 0.0, "id").count() == 0


def test_snapshot_versions_move_only_on_change(spark):
    none = spark.createDataFrame(
        [], "version int, signature string, table_count int, is_current boolean")
    columns = spark.createDataFrame(
        [("t", "a", "int", True, False)],
        "table_name string, column_name string, data_type string, nullable boolean, "
        "is_pk boolean")
    first = catalog.append_snapshot(none, catalog.schema_signature(columns))
    again = catalog.append_snapshot(first, catalog.schema_signature(columns))
    assert again.count() == 1
    changed = columns.selectExpr("table_name", "column_name", "'bigint' as data_type",
                                 "nullable", "is_pk")
    third = catalog.append_snapshot(again, catalog.schema_signature(changed)).orderBy("version")
    assert [(r.version, r.is_current) for r in third.collect()] == [(1, False), (2, True)]


def test_audit_rows_need_all_columns(spark, tmp_path):
    with pytest.raises(ValueError):
        sinks.append_audit(spark.range(1), str(tmp_path / "log"))


def test_grouping_key_is_never_the_measure(spark):
    with pytest.raises(ValueError):
        query.aggregate_by(spark.range(3), "id", "sum", "id")


def test_plural_and_exact_table_names_are_found(spark):
    sizes = spark.createDataFrame(
        [("orders", 10), ("city", 3), ("cities", 5), ("stores", 4)],
        "table_name string, n_rows bigint")
    columns = spark.createDataFrame([
        ("orders", "id", "bigint", True), ("orders", "store_id", "int", False),
        ("orders", "city_id", "int", False), ("orders", "note_id", "string", False),
        ("cities", "id", "bigint", True), ("stores", "id", "bigint", True),
        ("city", "code", "string", False),
    ], "table_name string, column_name string, data_type string, is_pk boolean")
    found = {r.from_column: (r.to_table, r.confidence) for r in
             relations.infer_relations(columns, sizes).collect() if r.from_table == "orders"}
    assert found["store_id"] == ("stores", 0.65) and found["city_id"] == ("cities", 0.65)
    assert "note_id" not in found


def test_integrity_is_exact_when_target_keys_repeat_and_one_value_dominates(spark):
    left = spark.createDataFrame([(1,)] * 70 + [(2,)] * 20 + [(9,)] * 10 + [(None,)] * 5, "a int")
    right = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    edges = spark.createDataFrame(
        [("l", "a", "r", "id")],
        "from_table string, from_column string, to_table string, to_column string")
    row = relations.measure_relations(edges, {"l": left, "r": right}).first()
    assert (row.total, row.orphans, row.distinct_from) == (100, 10, 3)
    assert row.ratio == pytest.approx(0.9) and row.cardinality == "n-n"


def test_empty_side_counts_as_whole(spark):
    edges = spark.createDataFrame(
        [("l", "a", "r", "id")],
        "from_table string, from_column string, to_table string, to_column string")
    empty = spark.createDataFrame([], "a int")
    row = relations.measure_relations(
        edges, {"l": empty, "r": spark.createDataFrame([(1,)], "id int")}).first()
    assert (row.total, row.ratio) == (0, 1.0)


def proposed(spark, *rows):
    df = spark.createDataFrame(
        [(*r,) for r in rows],
        "table_name string, column_name string, pii_type string, detected_type string")
    return {r.column_name: r for r in semantics.propose_concepts(df).collect()}


def test_concepts_from_names_and_content(spark):
    found = proposed(
        spark, ("customers", "email", "email", "text"), ("orders", "amount_ttc", None, "numeric"),
        ("orders", "amount_note", None, "text"), ("customers", "id", None, "integer"),
        ("orders", "created_at", None, "datetime"), ("orders", "zzz", None, "text"))
    assert (found["email"].concept, found["email"].confidence) == ("Email", 0.9)
    assert (found["amount_ttc"].concept, found["amount_ttc"].confidence) == ("Montant", 0.7)
    assert "amount_note" not in found and "zzz" not in found
    assert (found["id"].concept, found["id"].confidence) == ("Client", 0.8)
    assert (found["created_at"].concept, found["created_at"].confidence) == ("Date", 0.85)


def test_net_and_gross_amounts_must_be_arbitrated(spark):
    df = spark.createDataFrame(
        [("p", "net_price", "Montant", 0.7, ""), ("o", "amount_ttc", "Montant", 0.7, ""),
         ("o", "day", "Date", 0.7, "")],
        "table_name string, column_name string, concept string, confidence double, "
        "rationale string")
    flagged = {r.column_name: r for r in semantics.flag_arbitration(df).collect()}
    assert flagged["net_price"].needs_arbitration and flagged["amount_ttc"].needs_arbitration
    assert not flagged["day"].needs_arbitration
    alone = semantics.flag_arbitration(df.where("column_name <> 'net_price'")).collect()
    assert not any(r.needs_arbitration for r in alone)


@pytest.mark.parametrize("basis, convention, chosen", [
    (None, None, "amount_ttc"), ("net", None, "net_price"), (None, "net", "net_price"),
    ("gross", "net", "amount_ttc"),
])
def test_measure_arbitration(spark, basis, convention, chosen):
    columns = spark.createDataFrame(
        [("o", "amount", 1, "double", False), ("o", "net_price", 2, "double", False),
         ("o", "amount_ttc", 3, "decimal(10,2)", False)],
        "table_name string, column_name string, ordinal int, data_type string, is_pk boolean")
    rows = semantics.arbitrate_measures(columns, basis, convention).collect()
    assert [r.column_name for r in rows if r.chosen] == [chosen]
    assert [r.column_name for r in rows if r.recommended] == ["amount_ttc"]


PEOPLE = [("Ann", "a@x.fr", 1), ("Bob", None, 2), ("Ann", "a@x.fr", 3)]


def test_tokens_are_stable_and_text_comes_back(spark):
    df = spark.createDataFrame(PEOPLE, "full_name string, email string, amount int")
    safe, mapping = privacy.pseudonymize(df, {"full_name": "name", "email": "email"})
    rows = {r.amount: r for r in safe.collect()}
    assert rows[1].full_name == rows[3].full_name != rows[2].full_name
    mail = rows[1].email
    assert rows[2].email is None and mail.startswith("EMAIL-") and mail[6:].isdigit()
    texts = spark.createDataFrame(
        [(1, f"{rows[1].full_name} wrote; {mail}, {mail}1, NOM-999 x{mail}"), (1, mail), (2, None)],
        "id int, note string")
    back = [(r.id, r.note) for r in privacy.reidentify(texts, mapping, "id", ["note"]).collect()]
    assert sorted(back, key=str) == sorted(
        [(1, f"Ann wrote; a@x.fr, {mail}1, NOM-999 x{mail}"), (1, "a@x.fr"), (2, None)], key=str)


def test_tokens_keep_values_apart_and_need_the_salt(spark, tmp_path):
    df = spark.range(1200).selectExpr("concat('p', id) as who")
    tokens = {r.token for r in privacy.token_mapping(df, {"who": "name"}).collect()}
    assert len(tokens) == 1200
    other = {r.token for r in privacy.token_mapping(df, {"who": "name"}, "salt").collect()}
    assert not tokens & other
    folder = str(tmp_path / "mapping")
    stored = privacy.store_mapping(privacy.token_mapping(df, {"who": "name"}), folder)
    assert stored.count() == 1200
    privacy.forget_mapping(spark, folder)
    assert not (tmp_path / "mapping").exists()

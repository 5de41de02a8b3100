"""Relations between tables: inferred, measured, reviewed, and shown as an entity graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, functions as F, types as T

from tallyglass.functions.text import percent
from tallyglass.operators.profile import columnwise
from tallyglass.sources.catalog import union_all

INTEGER_TYPES = ("tinyint", "smallint", "int", "bigint")
EDGE = ["from_table", "from_column", "to_table", "to_column"]


def _bare(column: Column) -> Column:
    """Column name in lower case without a one-letter table prefix (`o_custkey` -> `custkey`)."""
    return F.regexp_replace(F.lower(column), r"^[a-z]_", "")


def infer_relations(
    columns_df: DataFrame, tables_df: DataFrame, declared_df: DataFrame | None = None
) -> DataFrame:
    """Propose foreign keys by naming.

    An integer column `<stem>_id`, `<stem>id` or `<stem>key` points to the table called like the
    stem (0.8) or its plural (0.65), or, failing that, to the one table whose primary key has the
    same name (0.65). Only a table with exactly one key column can be pointed to: with two, nothing
    tells which is meant. Two primary keys of one name point from the smaller table to the larger.
    """
    sizes = tables_df.select(F.col("table_name").alias("_sized"), "n_rows")
    whole = columns_df.where(F.col("data_type").isin(*INTEGER_TYPES)).withColumn(
        "bare", _bare(F.col("column_name"))
    )
    single = columns_df.where("is_pk").groupBy(F.col("table_name").alias("_single")).agg(
        F.count("*").alias("_keys")).where("_keys = 1")
    keys = whole.where("is_pk").join(single, F.col("table_name") == F.col("_single")).join(
        sizes, F.col("table_name") == F.col("_sized")
    ).select(
        F.col("table_name").alias("to_table"), F.col("column_name").alias("to_column"),
        F.col("bare").alias("key_name"), F.col("n_rows").alias("to_rows"),
    )
    pointing = whole.join(sizes, F.col("table_name") == F.col("_sized")).where(
        F.col("bare").rlike(r".(_id|id|_key|key)$")
    ).select(
        F.col("table_name").alias("from_table"), F.col("column_name").alias("from_column"),
        F.col("bare").alias("from_bare"), F.col("is_pk").alias("from_pk"),
        F.col("n_rows").alias("from_rows"),
        F.regexp_replace("bare", r"(_id|id|_key|key)$", "").alias("stem"),
    )
    if declared_df is not None:
        pointing = pointing.join(declared_df, ["from_table", "from_column"], "left_anti")

    stem = F.col("stem")
    plural_y = F.when(stem.endswith("y"), F.concat(F.expr("left(stem, length(stem) - 1)"),
                                                   F.lit("ies")))
    spelled = F.array(stem, F.concat(stem, F.lit("s")), F.concat(stem, F.lit("es")), plural_y)
    by_table = pointing.select("*", F.posexplode(spelled).alias("rank", "spelling")).join(
        keys, F.col("spelling") == F.lower("to_table")
    ).where(F.lower("from_table") != F.lower("to_table"))
    by_key = pointing.select("*", F.lit(9).alias("rank"), stem.alias("spelling")).join(
        keys, F.col("from_bare") == F.col("key_name")
    ).where("from_table <> to_table").where(
        "not from_pk or from_rows < to_rows or (from_rows = to_rows and from_table < to_table)"
    )
    shape = [*EDGE, "stem", "rank"]
    best = F.min_by(F.struct("to_table", "to_column", "stem"), F.struct("rank", "to_table"))
    return by_table.select(shape).unionByName(by_key.select(shape)).groupBy(
        "from_table", "from_column"
    ).agg(best.alias("hit")).select(
        "from_table", "from_column", "hit.to_table", "hit.to_column",
        F.lit("inferred").alias("kind"), F.lit("proposed").alias("status"),
        F.when(F.col("hit.stem") == F.lower("hit.to_table"), 0.8).otherwise(0.65)
        .alias("confidence"),
    )


def common_type(left: T.DataType, right: T.DataType) -> str:
    """The type in which two keys are compared, so that equal values have equal text."""
    types = (left, right)
    if all(isinstance(t, (T.IntegralType)) for t in types):
        return "bigint"
    if all(isinstance(t, (T.IntegralType, T.DecimalType)) for t in types):
        scale = max(t.scale if isinstance(t, T.DecimalType) else 0 for t in types)
        return f"decimal(38,{min(scale, 18)})"
    if all(isinstance(t, T.NumericType) for t in types):
        return "double"
    if all(isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) for t in types):
        return "timestamp"
    return "string"


def _edge_values(edges: list, tables: dict[str, DataFrame], side: str) -> DataFrame:
    """(e, v, t, n): how often each value occurs on one side of each edge; a large file is read an
    edge at a time, any other table once.

    Whole numbers travel as such (v), all else as text of the edge's common type (t). Counting
    before the join means a value that fills a third of a table travels as one row.
    """
    table_of, column_of = f"{side}_table", f"{side}_column"
    parts = []
    for name in sorted({e[table_of] for e in edges}):
        structs = []
        for i, e in enumerate(edges):
            if e[table_of] != name:
                continue
            kind = common_type(*(tables[e[f"{s}_table"]].schema[e[f"{s}_column"]].dataType
                                 for s in ("from", "to")))
            value = f"try_cast(`{e[column_of]}` as {kind})"
            if kind == "bigint":
                number, text = value, "cast(null as string)"
            else:
                value = f"{value} + 0.0D" if kind == "double" else value
                number, text = "cast(null as bigint)", f"cast({value} as string)"
            structs.append((f"{i} as e", f"{number} as v", f"{text} as t"))
        if columnwise(tables[name]):  # so that a task counts the values of one edge
            parts += [tables[name].selectExpr(*struct) for struct in structs]
        else:
            rows = ", ".join(f"struct({', '.join(struct)})" for struct in structs)
            parts.append(tables[name].selectExpr(f"inline(array({rows}))"))
    return union_all(parts).where("v is not null or t is not null").groupBy("e", "v", "t").agg(
        F.count("*").alias("n"))


def measure_relations(relations_df: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Integrity and cardinality of every relation in one job.

    Returns the edge with total, orphans, distinct_from, ratio and cardinality. Exact even when
    the target key repeats. The relation list is catalog-sized and read by the driver.
    """
    edges = [
        r.asDict() for r in relations_df.select(*EDGE).distinct().orderBy(*EDGE).collect()
        if r.from_table in tables and r.to_table in tables
    ]
    known = relations_df.sparkSession.createDataFrame(
        [(i, *(e[c] for c in EDGE)) for i, e in enumerate(edges)],
        "e int, " + ", ".join(f"{c} string" for c in EDGE),
    )
    if not edges:
        counts = relations_df.sparkSession.createDataFrame(
            [], "e int, total bigint, orphans bigint, distinct_from bigint, n_from bigint, "
                "n_to bigint")
    else:
        left = _edge_values(edges, tables, "from")
        right = _edge_values(edges, tables, "to").withColumnRenamed("n", "m")
        same = [left[c].eqNullSafe(right[c]) for c in ("v", "t")]
        counts = left.join(right, [left.e == right.e, *same], "left").groupBy(left.e).agg(
            F.sum("n").alias("total"),
            F.sum(F.when(F.col("m").isNull(), F.col("n"))).alias("orphans"),
            F.count("*").alias("distinct_from"), F.max("n").alias("n_from"),
            F.max("m").alias("n_to"),
        )
    return known.join(counts, "e", "left").selectExpr(
        *EDGE, "coalesce(total, 0) as total", "coalesce(orphans, 0) as orphans",
        "coalesce(distinct_from, 0) as distinct_from",
        "coalesce(1 - coalesce(orphans, 0) / total, 1.0D) as ratio",
        "concat(if(total is null or n_from > 1, 'n', '1'), '-', if(n_to > 1, 'n', '1')) "
        "as cardinality",
    )


def integrity(relations_df: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    return measure_relations(relations_df, tables).drop("cardinality")


def cardinality(relations_df: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """`1-1`, `n-1`, `1-n` or `n-n`, from how often a value repeats on each side."""
    return measure_relations(relations_df, tables).select(*EDGE, "cardinality")


def edges_of(fact: str, relations_df: DataFrame) -> dict[str, Row]:
    """The edges that leave a table, by name: the table pointed to, and where two edges point to the
    same one, also the column (`address_by_billing_id`)."""
    edges = relations_df.where(
        (F.col("from_table") == fact) & (F.col("status") != "rejected")
    ).orderBy("from_column", "to_table", "to_column").collect()
    targets = [e.to_table for e in edges]
    return {e.to_table if targets.count(e.to_table) == 1 else f"{e.to_table}_by_{e.from_column}": e
            for e in edges}


def star(
    fact: str, relations_df: DataFrame, tables: dict[str, DataFrame],
    only: set[str] | None = None,
) -> DataFrame:
    """The fact table joined to the tables it points to, one hop; `only` names the edges wanted.

    Linked columns are named `<edge>__<column>` (see `edges_of`); unused ones are pruned by the
    optimizer, and a linked table is broadcast by size, not by wish.
    """
    joined = tables[fact]
    for name, e in edges_of(fact, relations_df).items():
        if only is None or name in only:
            linked = tables[e.to_table]
            linked = linked.select(*[F.col(c).alias(f"{name}__{c}") for c in linked.columns])
            joined = joined.join(linked, F.col(e.from_column) == F.col(f"{name}__{e.to_column}"))
    return joined


def review_relations(relations_df: DataFrame, decisions_df: DataFrame) -> DataFrame:
    """Apply validate / reject decisions; a declared relation is not up for review."""
    decided = F.col("action").isNotNull() & (F.col("kind") != "declared")
    validated = decided & (F.col("action") == "validate")
    return relations_df.join(decisions_df.select(*EDGE, "action"), EDGE, "left").select(
        *EDGE,
        F.when(validated, "validated").otherwise(F.col("kind")).alias("kind"),
        F.when(validated, "validated").when(decided, "rejected").otherwise(F.col("status"))
        .alias("status"),
        "confidence",
    )


def graph_nodes(
    tables_df: DataFrame, columns_df: DataFrame, mappings_df: DataFrame, quality_df: DataFrame
) -> DataFrame:
    """One node per table: entity concept, all its concepts, rows, columns and quality."""
    decided = mappings_df.where("status in ('validated', 'corrected')").join(
        columns_df.select("table_name", "column_name", "is_pk"), ["table_name", "column_name"],
        "left",
    ).groupBy("table_name").agg(
        F.max(F.when(F.col("is_pk"), F.col("concept"))).alias("entity"),
        F.sort_array(F.collect_set("concept")).alias("concepts"),
    )
    widths = columns_df.groupBy("table_name").agg(F.count("*").alias("n_columns"))
    scores = quality_df.select("table_name", F.round("score", 4).alias("quality"))
    return (
        tables_df.join(widths, "table_name", "left").join(decided, "table_name", "left")
        .join(scores, "table_name", "left")
        .select(
            "table_name", "entity",
            F.coalesce("concepts", F.array().cast("array<string>")).alias("concepts"),
            "n_rows", F.coalesce("n_columns", F.lit(0)).alias("n_columns"), "quality", "kind",
        )
    )


def graph_edges(relations_df: DataFrame, measured_df: DataFrame) -> DataFrame:
    """One edge per relation with a plain-language reason."""
    source = F.concat_ws(".", "from_table", "from_column")
    target = F.concat_ws(".", "to_table", "to_column")
    reason = (
        F.when(F.col("kind") == "declared",
               F.concat(F.lit("Declared foreign key: "), source, F.lit(" references "), target))
        .when(F.col("kind") == "inferred",
              F.concat(F.lit("Inferred by naming: "), source, F.lit(" points to "), target))
        .when(F.col("kind") == "validated", F.lit("Confirmed by a person"))
        .otherwise(F.concat(F.lit("Relation "), F.col("kind")))
    )
    orphans = F.when(F.col("ratio") < 0.999,
                     F.concat(percent(1 - F.col("ratio")), F.lit(" orphans")))
    measured = measured_df.select(*EDGE, "ratio", "cardinality")
    return relations_df.join(measured, EDGE, "left").select(
        *EDGE, "kind", "status", "confidence", "cardinality", "ratio",
        F.concat_ws("; ", reason, F.concat(F.lit("cardinality "), F.col("cardinality")), orphans)
        .alias("reason"),
    )


def fanout_check(
    measured_df: DataFrame, used_tables: list[str], aggregates: bool = True,
    distinct: bool = False,
) -> DataFrame:
    """Relations that would count rows twice when an analysis joins both ends and aggregates."""
    both = F.col("from_table").isin(*used_tables) & F.col("to_table").isin(*used_tables)
    risky = F.col("cardinality").isin("1-n", "n-n") & F.lit(aggregates and not distinct)
    return measured_df.where(both).select(
        *EDGE, "cardinality", F.when(risky, "warn").otherwise("pass").alias("result")
    )

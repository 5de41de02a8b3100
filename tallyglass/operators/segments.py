"""What drives a measure: segmentation by many dimensions in one job, and how to read it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyglass.functions import fixed, kinds
from tallyglass.functions.buckets import Bands, month_key
from tallyglass.operators import relations


@dataclass(frozen=True)
class Dimension:
    """A way to cut a table: `base` is the column behind it, `expr` its group label."""

    name: str
    kind: str  # categorical | temporal | band
    base: str
    expr: Column
    linked: str | None = None

    @staticmethod
    def category(column: str, name: str | None = None, linked: str | None = None) -> "Dimension":
        return Dimension(name or column, "categorical", column, F.col(column).cast("string"),
                         linked)

    @staticmethod
    def month(column: str, name: str | None = None, linked: str | None = None,
              in_text: bool = False) -> "Dimension":
        """Months of a date; of one kept as text, values that are no real date are left out."""
        moment = F.col(column).try_cast("timestamp") if in_text else F.col(column)
        return Dimension(name or f"{column} (month)", "temporal", column, month_key(moment),
                         linked)

    @staticmethod
    def band(column: str, bands: Bands, name: str | None = None, linked: str | None = None
             ) -> "Dimension":
        return Dimension(name or f"{column} (band)", "band", column,
                         bands.label(bands.index(F.col(column))), linked)


# --- what to analyse: choices made on the catalog --------------------------------------------

def pick_fact(tables_df: DataFrame, relations_df: DataFrame) -> DataFrame:
    """The table that points to the most others, then the longest."""
    outgoing = relations_df.where("status <> 'rejected'").groupBy(
        F.col("from_table").alias("table_name")
    ).agg(F.count("*").alias("n_outgoing"))
    return tables_df.join(outgoing, "table_name", "left").select(
        "table_name", F.coalesce("n_outgoing", F.lit(0)).alias("n_outgoing"), "n_rows"
    ).orderBy(F.desc("n_outgoing"), F.desc_nulls_last("n_rows"), "table_name").limit(1)


def pick_measure(
    columns_df: DataFrame, profile_df: DataFrame, count_only: bool = False
) -> DataFrame:
    """Per table the first numeric, non-key, non-personal column with an additive name.

    `measure` is NULL where rows should be counted instead; ages and years are never summed.
    """
    name = F.lower("column_name")
    additive = F.lit(False)
    for hint in fixed.MEASURE_HINTS:
        additive = additive | name.contains(hint)
    key_like = F.col("is_pk") | name.rlike("(^id|_id|key)$")
    usable = (
        F.col("data_type").rlike("^(tinyint|smallint|int|bigint|float|double|decimal)")
        & additive & ~key_like & F.col("pii_type").isNull() & F.lit(not count_only)
    )
    pii = profile_df.select("table_name", "column_name", "pii_type")
    return columns_df.join(pii, ["table_name", "column_name"], "left").groupBy("table_name").agg(
        F.min_by("column_name", F.when(usable, F.col("ordinal"))).alias("measure")
    )


def candidate_dimensions(
    fact: str, columns_df: DataFrame, profile_df: DataFrame, relations_df: DataFrame,
    measure: str | None = None,
) -> list[Dimension]:
    """Dimensions of the fact table and of all that it points to, read from the catalog.

    Dates become months, numbers become bands, text is used with 2 to 25 values; keys, personal
    data and the measure are left out. Columns of a linked table are `<edge>__<column>`, as the
    star join names them.
    """
    edges = relations.edges_of(fact, relations_df)
    rows = columns_df.where(
        F.col("table_name").isin(fact, *{e.to_table for e in edges.values()})
    ).join(profile_df.drop("ordinal"), ["table_name", "column_name"], "left").orderBy(
        "table_name", "ordinal").collect()
    found: list[Dimension] = []
    for edge, table in [(None, fact), *((name, e.to_table) for name, e in edges.items())]:
        for row in (r for r in rows if r.table_name == table):
            if not row.pii_type and not (edge is None and row.column_name == measure):
                found += _dimension_of(row, edge)
    return found


def _dimension_of(row, linked: str | None) -> list[Dimension]:
    column = row.column_name if linked is None else f"{linked}__{row.column_name}"
    suffix = "" if linked is None else f" ({linked})"
    kind = kinds.kind_of_name(row.data_type)
    if kind == "temporal" or (row.detected_type or "").startswith("datetime"):
        return [Dimension.month(column, f"{row.column_name} by month{suffix}", linked,
                                kind == "text")]
    if row.is_pk or kinds.is_key_name(row.column_name):
        return []
    if kind in ("integer", "number"):
        if row.min_value is None or row.max_value is None:
            return []
        bands = Bands.between(float(row.min_value), float(row.max_value))
        if bands is None:
            return []
        return [Dimension.band(column, bands, f"{row.column_name} bands{suffix}", linked)]
    distinct, ratio = row.distinct_count, row.distinct_ratio
    few = distinct is None or fixed.MIN_GROUPS <= distinct <= fixed.MAX_GROUPS
    if few and not (ratio is not None and ratio > fixed.MAX_CATEGORY_RATIO):
        return [Dimension.category(column, f"{row.column_name}{suffix}", linked)]
    return []


def numeric_bands(df: DataFrame, column: str, bands: int = fixed.BANDS) -> DataFrame:
    """(band, label, n) for equal-width integer bands between the smallest and largest value."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    cut = None if low is None else Bands.between(float(low), float(high), bands)
    if cut is None:
        return df.sparkSession.createDataFrame([], "band bigint, label string, n bigint")
    counted = df.where(F.col(column).isNotNull()).groupBy(
        cut.index(F.col(column)).alias("band")
    ).agg(F.count("*").alias("n"))
    return counted.select("band", cut.label(F.col("band")).alias("label"), "n")


# --- segmentation ----------------------------------------------------------------------------

def segment_by(
    df: DataFrame, dims: list[Dimension], measure: str | Column | None = None,
    max_groups: int = fixed.MAX_GROUPS,
) -> DataFrame:
    """(dimension, kind, label, n, total, avg) for all dimensions in one shuffle.

    Each row is sent to all dimensions at once and summed on the map side, so neither the number
    of dimensions nor a dominant value adds data to the shuffle. A dimension is kept only with
    2 to 25 groups (see `rejected_dimensions`); NULL labels are not a group. No dimensions give no
    rows.
    """
    value = F.lit(None).cast("double") if measure is None else (
        F.col(measure) if isinstance(measure, str) else measure
    )
    cells = F.array(*[
        F.struct(F.lit(d.name).alias("dimension"), F.lit(d.kind).alias("kind"),
                 d.expr.cast("string").alias("label"))
        for d in dims
    ]) if dims else F.expr("cast(array() as array<struct<dimension:string,kind:string,label:string>>)")
    groups = df.select(value.alias("_v"), F.inline(cells)).where("label is not null").groupBy(
        "dimension", "kind", "label"
    ).agg(F.count("*").alias("n"), F.sum("_v").alias("total"))
    # One group more than allowed is enough to see that a dimension has too many: each task
    # passes on only so many rows per dimension, and nothing is computed twice to count them.
    first = Window.partitionBy("dimension").orderBy("label")
    seen = groups.withColumn("_i", F.row_number().over(first)).where(
        F.col("_i") <= max_groups + 1
    ).withColumn("_k", F.count("*").over(Window.partitionBy("dimension")))
    return seen.where(F.col("_k").between(fixed.MIN_GROUPS, max_groups)).select(
        "dimension", "kind", "label", "n", "total", (F.col("total") / F.col("n")).alias("avg")
    )


def rejected_dimensions(segments_df: DataFrame, dims: list[Dimension]) -> DataFrame:
    """(dimension, kind): those that were tried and have no usable number of groups."""
    tried = segments_df.sparkSession.createDataFrame(
        [(d.name, d.kind) for d in dims], "dimension string, kind string")
    return tried.join(segments_df.select("dimension").distinct(), "dimension", "left_anti")


def _weight() -> Column:
    """Share weight of a group: its positive total, or its rows where nothing is measured."""
    return F.when(F.col("total").isNull(), F.col("n").cast("double")).otherwise(
        F.greatest(F.col("total").cast("double"), F.lit(0.0)))


def _standing() -> Column:
    return F.coalesce(F.col("total").cast("double"), F.col("n").cast("double"))


def segment_stats(segments_df: DataFrame) -> DataFrame:
    """Per dimension: groups, top share, Herfindahl index, variation of means, power."""
    shares = segments_df.withColumn("_w", _weight()).withColumn(
        "share", F.col("_w") / F.nullif(
            F.sum("_w").over(Window.partitionBy("dimension")), F.lit(0.0))
    )
    mean = F.col("avg").cast("double")
    stats = shares.groupBy("dimension", "kind").agg(
        F.count("*").alias("groups"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("top_share"),
        F.coalesce(F.sum(F.col("share") * F.col("share")), F.lit(0.0)).alias("hhi"),
        F.coalesce(F.stddev_pop(mean) / F.nullif(F.avg(mean), F.lit(0.0)), F.lit(0.0))
        .alias("cv"),
        F.count(mean).alias("_measured"),
        F.min_by("label", F.struct(-_standing(), F.col("label"))).alias("top_label"),
    )
    even = 1 / F.col("groups")
    bonus = F.when(F.col("groups") <= fixed.READABLE_GROUPS, fixed.READABLE_BONUS).otherwise(0.0)
    # A dimension whose weights sum to nothing has no power at all.
    power = F.when(F.col("hhi") == 0, 0.0).otherwise(
        F.col("cv") + F.greatest(F.col("hhi") - even, F.lit(0.0)) + bonus
    )
    cv = F.when((F.col("_measured") < 2) | (F.col("hhi") == 0), 0.0).otherwise(F.col("cv"))
    return stats.withColumn("cv", cv).select(
        "dimension", "kind", "groups", "top_share", "hhi", "cv", power.alias("power"),
        "top_label",
    )


def ranked(stats_df: DataFrame) -> DataFrame:
    """Dimensions by power; as few rows as dimensions, so one ordered window is enough."""
    return stats_df.withColumn(
        "place", F.row_number().over(Window.orderBy(F.desc("power"), "dimension"))
    )


def top_segments(
    segments_df: DataFrame, stats_df: DataFrame, d: int = 4, g: int = 4
) -> DataFrame:
    """The leading groups of the strongest dimensions with value, share, rows and mean."""
    in_dim = Window.partitionBy("dimension")
    places = ranked(stats_df).where(F.col("place") <= d).select("dimension", "place")
    value = _standing()
    ordered = in_dim.orderBy(value.desc(), "label")
    return segments_df.withColumn("rank", F.row_number().over(ordered)).withColumn(
        "share", F.coalesce(value / F.nullif(F.sum(value).over(in_dim), F.lit(0.0)) * 100,
                            F.lit(0.0))
    ).where(F.col("rank") <= g).join(places, "dimension").select(
        "place", "dimension", "rank", "label", value.alias("value"), "share", "n", "avg"
    )


def drivers(segments_df: DataFrame, stats_df: DataFrame, top: int = 3) -> DataFrame:
    """Why the strongest dimensions matter: a gradient of means, or one concentrated group."""
    mean = F.col("avg").cast("double")
    spread = segments_df.groupBy("dimension").agg(
        F.count(mean).alias("measured"),
        F.min_by(F.struct(F.col("label").alias("label"), mean.alias("avg")),
                 F.struct(mean, F.col("label"))).alias("low"),
        F.max_by(F.struct(F.col("label").alias("label"), mean.alias("avg")),
                 F.struct(mean, F.col("label"))).alias("high"),
    )
    ratio = F.col("high.avg") / F.nullif(F.col("low.avg"), F.lit(0.0))
    steep = F.coalesce((F.col("measured") >= 3) & (ratio >= fixed.GRADIENT), F.lit(False))
    return ranked(stats_df).where(F.col("place") <= top).join(spread, "dimension").select(
        "place", "dimension",
        F.when(steep, "gradient").otherwise("concentration").alias("driver"),
        F.when(steep, F.col("low.label")).otherwise(F.col("top_label")).alias("from_label"),
        F.when(steep, F.col("high.label")).alias("to_label"),
        F.when(steep, ratio).otherwise(F.col("top_share")).alias("strength"),
    )


def crosstab(
    df: DataFrame, dim_a: Dimension, dim_b: Dimension, measure: str | Column | None = None,
    k: int | None = None,
) -> DataFrame:
    """All cells of two dimensions, or the first k by measure (or rows); none without both labels."""
    value = F.lit(None).cast("double") if measure is None else (
        F.col(measure) if isinstance(measure, str) else measure
    )
    cells = df.select(
        dim_a.expr.cast("string").alias("a"), dim_b.expr.cast("string").alias("b"),
        value.alias("_v"),
    ).where("a is not null and b is not null").groupBy("a", "b").agg(
        F.count("*").alias("n"), F.sum("_v").alias("total")
    )
    return cells if k is None else cells.orderBy(_standing().desc(), "a", "b").limit(k)


def crosstab_margins(
    df: DataFrame, dim_a: Dimension, dim_b: Dimension, measure: str | Column | None = None,
) -> DataFrame:
    """Cells, row and column totals and the grand total of two dimensions, from one shuffle.

    grouping_id: 0 for a cell, 1 where `b` is summed over, 2 where `a` is, 3 for the grand total. Rows
    without one of the labels are in no cell and no margin, so margins are the sums of the cells.
    """
    value = F.lit(None).cast("double") if measure is None else (
        F.col(measure) if isinstance(measure, str) else measure
    )
    labelled = df.select(
        dim_a.expr.cast("string").alias("a"), dim_b.expr.cast("string").alias("b"),
        value.alias("_v"),
    ).where("a is not null and b is not null")
    # Rows are summed into cells before they are multiplied by the grouping sets.
    cells = labelled.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("_v").alias("total"))
    return cells.cube("a", "b").agg(
        F.grouping_id().cast("int").alias("grouping_id"), F.sum("n").alias("n"),
        F.sum("total").alias("total"),
    ).where("n is not null")


def dominant_cell(crosstab_df: DataFrame) -> DataFrame:
    """The top cell and its share of all cells given."""
    listed = crosstab_df.withColumn("value", _standing())
    # Equal cells: the first in label order, as the crosstab lists them.
    first = F.min_by(F.struct("a", "b"), F.struct(-F.col("value"), F.col("a"), F.col("b")))
    return listed.agg(
        first.alias("cell"), F.max("value").alias("value"), F.sum("value").alias("sum")
    ).where("cell is not null").select(
        "cell.a", "cell.b", "value",
        F.coalesce(F.col("value") / F.nullif(F.col("sum"), F.lit(0.0)), F.lit(0.0))
        .alias("share"),
    )


def second_dimension(stats_df: DataFrame, bases: dict[str, str]) -> tuple[str, str] | None:
    """The two dimensions worth crossing, chosen on one row per dimension.

    The second is the next strongest on another column; time only joins time or stands last.
    """
    order = ranked(stats_df).orderBy("place").select("dimension", "kind").collect()
    if len(order) < 2:
        return None
    first = order[0]
    others = [r for r in order[1:] if bases[r.dimension] != bases[first.dimension]]
    telling = [r for r in others if first.kind == "temporal" or r.kind != "temporal"]
    choice = (telling or others or [None])[0]
    return None if choice is None else (first.dimension, choice.dimension)


def atypical_segments(segments_df: DataFrame) -> DataFrame:
    """Per dimension the first group whose mean is over two deviations above the mean of means."""
    mean = F.col("avg").cast("double")
    in_dim = Window.partitionBy("dimension")
    far = segments_df.withColumn("_m", F.avg(mean).over(in_dim)).withColumn(
        "_sd", F.stddev_pop(mean).over(in_dim)
    ).withColumn("_k", F.count(mean).over(in_dim)).where(
        (F.col("_k") >= 4) & (F.col("_sd") > 0) & (mean - F.col("_m") > 2 * F.col("_sd"))
    )
    first = F.row_number().over(in_dim.orderBy(_standing().desc(), "label"))
    return far.withColumn("_first", first).where("_first = 1").select(
        "dimension", "label", mean.alias("avg"), F.col("_m").alias("mean_of_means")
    )


def segment_flags(stats_df: DataFrame, crosstab_df: DataFrame) -> DataFrame:
    """(flag, dimension, label, strength): what the recommendations rest on."""
    order = ranked(stats_df)
    concentrated = order.where("place = 1 and top_share > 0.5").select(
        F.lit("concentration").alias("flag"), "dimension", F.col("top_label").alias("label"),
        F.col("top_share").alias("strength"),
    )
    target = dominant_cell(crosstab_df).select(
        F.lit("target").alias("flag"), F.lit("crosstab").alias("dimension"),
        F.concat_ws(" / ", "a", "b").alias("label"), F.col("share").alias("strength"),
    )
    axis = order.where("cv > 0.3").orderBy("place").limit(1).select(
        F.lit("axis").alias("flag"), "dimension", F.col("top_label").alias("label"),
        F.col("cv").alias("strength"),
    )
    raised = concentrated.unionByName(target).unionByName(axis)
    none = raised.agg(F.count("*").alias("k")).where("k = 0").select(
        F.lit("balanced").alias("flag"), F.lit(None).cast("string").alias("dimension"),
        F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("strength"),
    )
    return raised.unionByName(none)


def key_drivers(segments_df: DataFrame, stats_df: DataFrame, top: int = 3) -> DataFrame:
    """The strongest dimensions with their leading group and its share of the whole."""
    return top_segments(segments_df, stats_df, d=top, g=1).select(
        "place", "dimension", "label", "share"
    )


def project(df: DataFrame, measure: str | Column, pct: float) -> DataFrame:
    """What-if: rows, total and mean of a measure, and its total after a change in percent."""
    value = F.col(measure) if isinstance(measure, str) else measure
    base = df.agg(F.count("*").alias("n"), F.sum(value).cast("double").alias("total"),
                  F.avg(value).cast("double").alias("mean"))
    after = F.col("total") * F.lit(1 + pct / 100)
    return base.select(
        "n", "total", "mean", after.alias("projected"), (after - F.col("total")).alias("delta"),
        F.lit(float(pct)).alias("pct"),
    )


def allocate_gain(
    segments_df: DataFrame, delta: float | Column, dimension: str, top: int = 4
) -> DataFrame:
    """A gain spread over the leading groups of one dimension, by their share of the total."""
    only = segments_df.where(F.col("dimension") == dimension)
    whole = Window.partitionBy("dimension")
    share = F.col("total") / F.nullif(F.sum("total").over(whole), F.lit(0))
    rank = F.row_number().over(whole.orderBy(F.desc("total"), "label"))
    gain = delta if isinstance(delta, Column) else F.lit(float(delta))
    return only.withColumn("share", share.cast("double")).withColumn("rank", rank).where(
        F.col("rank") <= top
    ).select("dimension", "rank", "label", "share", (gain * F.col("share")).alias("gain"))

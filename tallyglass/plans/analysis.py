"""Deep analysis, investigation, discoveries and the profile-to-quality chain."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyglass.functions import fixed
from tallyglass.operators import (
    findings, profile as profiling, quality, relations, segments, semantics, series,
)
from tallyglass.sources import catalog


@dataclass
class Knowledge:
    """What is known about a set of tables; every frame is catalog-sized."""

    tables: dict[str, DataFrame]
    tables_df: DataFrame
    columns_df: DataFrame
    profile_df: DataFrame
    relations_df: DataFrame
    measured_df: DataFrame = field(default=None)


def learn(tables: dict[str, DataFrame], schema: str = "main") -> Knowledge:
    """Profile all tables, find their keys and relations, and measure those.

    Each frame is kept in memory: it has one row per table, column or relation, is read many
    times by later steps, and is computed again from the tables if an executor is lost.
    """
    profile_df = profiling.profile_all(tables).persist()
    keys = profiling.primary_keys(profile_df)
    tables_df, columns_df = catalog.build_catalog(tables, keys, schema)
    tables_df, columns_df = tables_df.persist(), columns_df.persist()
    relations_df = relations.infer_relations(columns_df, tables_df).persist()
    measured_df = relations.measure_relations(relations_df, tables).persist()
    return Knowledge(tables, tables_df, columns_df, profile_df, relations_df, measured_df)


@dataclass
class Subject:
    """A fact table joined to what it points to, its measure and its dimensions."""

    fact: str
    base: DataFrame
    measure: str | None
    dims: list[segments.Dimension]


def without(
    known: Knowledge, hidden_tables: tuple[str, ...] = (),
    hidden_columns: tuple[tuple[str, str], ...] = (),
) -> Knowledge:
    """What is known, less hidden tables and (table, column) pairs; names in any case."""
    tables = {t.lower() for t in hidden_tables}
    columns = {(t.lower(), c.lower()) for t, c in hidden_columns}
    if not tables and not columns:
        return known

    def seen(df: DataFrame, *names: tuple[str, str]) -> DataFrame:
        """Rows in which none of the (table, column) names is hidden."""
        for table, column in names:
            if tables:
                df = df.where(~F.lower(table).isin(*tables))
            if column in df.columns:
                for t, c in sorted(columns):
                    df = df.where(~((F.lower(table) == t) & (F.lower(column) == c)))
        return df

    own = ("table_name", "column_name")
    ends = (("from_table", "from_column"), ("to_table", "to_column"))
    left = {
        name: df.drop(*[c for c in df.columns if (name.lower(), c.lower()) in columns])
        for name, df in known.tables.items() if name.lower() not in tables
    }
    return Knowledge(left, seen(known.tables_df, own), seen(known.columns_df, own),
                     seen(known.profile_df, own), seen(known.relations_df, *ends),
                     seen(known.measured_df, *ends))


def choose_subject(
    known: Knowledge, fact: str | None = None, measure: str | None = None,
    count_only: bool = False, hidden_tables: tuple[str, ...] = (),
    hidden_columns: tuple[tuple[str, str], ...] = (),
) -> Subject:
    """Fact table, measure and dimensions, chosen on the visible catalog where not given."""
    known = without(known, hidden_tables, hidden_columns)
    if fact is None:
        fact = segments.pick_fact(known.tables_df, known.relations_df).first().table_name
    if measure is None:
        picked = segments.pick_measure(known.columns_df, known.profile_df, count_only)
        measure = picked.where(F.col("table_name") == fact).first().measure
    dims = segments.candidate_dimensions(
        fact, known.columns_df, known.profile_df, known.relations_df, measure
    )
    joined = relations.star(
        fact, known.relations_df, known.tables, {d.linked for d in dims if d.linked})
    return Subject(fact, joined, measure, dims)


def _value(subject: Subject, measure: Column | None) -> Column | None:
    """What is summed: the measure as it is, unless the caller gives another expression."""
    if measure is not None:
        return measure
    return None if subject.measure is None else F.col(subject.measure)


def _section(df, section, place, dimension, label, other, value, share, n) -> DataFrame:
    none = F.lit(None)
    return df.select(
        F.lit(section).alias("section"), place.cast("int").alias("place"),
        dimension.cast("string").alias("dimension"), label.cast("string").alias("label"),
        (none if other is None else other).cast("string").alias("other"),
        value.cast("double").alias("value"),
        (none if share is None else share).cast("double").alias("share"),
        (none if n is None else n).cast("bigint").alias("n"),
    )


def deep_analysis(subject: Subject, measure: Column | None = None) -> DataFrame:
    """Everything worth saying about one subject, as one result set by section.

    Segments are at most 25 rows per dimension; they are computed once, kept, and read by all
    sections.
    """
    value = _value(subject, measure)
    groups = segments.segment_by(subject.base, subject.dims, value).persist()
    stats = segments.segment_stats(groups)
    col = F.col
    parts = [
        _section(segments.top_segments(groups, stats), "segment", col("rank"), col("dimension"),
                 col("label"), None, col("value"), col("share"), col("n")),
        _section(segments.drivers(groups, stats), "driver", col("place"), col("dimension"),
                 col("driver"), F.concat_ws(" -> ", "from_label", "to_label"), col("strength"),
                 None, None),
        _section(segments.atypical_segments(groups), "atypical", F.lit(1), col("dimension"),
                 col("label"), None, col("avg"), None, None),
    ]
    bases = {d.name: d.base for d in subject.dims}
    pair = segments.second_dimension(stats, bases)
    if pair:
        by_name = {d.name: d for d in subject.dims}
        cells = segments.crosstab(subject.base, by_name[pair[0]], by_name[pair[1]], value)
        cells = cells.persist()
        shown = cells.withColumn("value", F.coalesce(col("total").cast("double"),
                                                     col("n").cast("double")))
        parts += [
            _section(shown.orderBy(F.desc("value"), "a", "b").limit(fixed.CROSSTAB_REPORTED),
                     "crosstab", F.lit(1),
                     F.lit(" x ".join(pair)), col("a"), col("b"), col("value"), None, col("n")),
            _section(segments.segment_flags(stats, cells), "flag", F.lit(1), col("dimension"),
                     col("label"), col("flag"), col("strength"), None, None),
        ]
    return catalog.union_all(parts)


def investigate(
    subject: Subject, date_col: str | None = None, measure: Column | None = None,
    steps: int | None = None,
) -> DataFrame:
    """(step_no, step, label, value, place, detail): trend first, then the dimensions by power.

    All dimensions are measured and ranked; `steps` asks for the strongest only. Those without a
    usable number of groups are listed as rejected.
    """
    value, dims = _value(subject, measure), subject.dims
    top = len(dims) if steps is None else steps
    groups = segments.segment_by(subject.base, dims, value).persist()
    stats = segments.segment_stats(groups)
    driven = segments.drivers(groups, stats, top=top).select(
        "dimension", F.concat_ws(" ", "driver", F.concat_ws(" -> ", "from_label", "to_label"))
        .alias("finding"),
    )
    figures = segments.top_segments(groups, stats, d=top, g=4).join(
        driven, "dimension"
    ).select(
        F.col("place").alias("step_no"), F.col("dimension").alias("step"), "label",
        F.col("value").cast("double").alias("value"), F.col("rank").alias("place"),
        F.col("finding").alias("detail"),
    )
    rejected = segments.rejected_dimensions(groups, dims).select(
        F.lit(99).alias("step_no"), F.col("dimension").alias("step"), F.lit("rejected").alias("label"),
        F.lit(None).cast("double").alias("value"), F.lit(1).alias("place"),
        F.lit("no usable groups").alias("detail"),
    )
    found = figures.unionByName(rejected)
    if date_col is not None:
        line = series.monthly_series(subject.base, date_col, value)
        first = series.trend_step(line)
        points = F.array(*[
            F.struct(F.lit(i).alias("place"), F.col(f"{point}_period").alias("label"),
                     F.col(f"{point}_value").alias("value"))
            for i, point in enumerate(("first", "last", "low"), start=1)
        ])
        found = found.unionByName(first.select("direction", F.inline(points)).select(
            F.lit(0).alias("step_no"), F.lit("trend").alias("step"), "label", "value", "place",
            F.col("direction").alias("detail"),
        ))
    return found


def what_if(
    subject: Subject, pct: float, measure: Column | None = None, top: int = 4
) -> DataFrame:
    """A change of the measure in percent, spread over the leading groups of one dimension.

    (total, projected, delta, dimension, rank, label, share, gain). The dimension is the first of
    the subject's that has a usable number of groups; without one there are no rows.
    """
    value = _value(subject, measure)
    plan = segments.project(subject.base, value, pct)
    groups = segments.segment_by(subject.base, subject.dims, value)
    usable = {r.dimension for r in groups.select("dimension").distinct().collect()}
    chosen = next((d.name for d in subject.dims if d.name in usable), "")
    spread = segments.allocate_gain(
        groups, plan.select("delta").scalar(), chosen, top)
    facts = plan.select(F.struct("total", "projected", "delta").alias("facts")).scalar()
    return spread.withColumn("facts", facts).select(
        "facts.*", "dimension", "rank", "label", "share", "gain")


def reuse_findings(spark: SparkSession, folder: str, fingerprint: str, find) -> tuple[DataFrame, bool]:
    """(findings, whether they were reused): those stored under an unchanged fingerprint.

    Otherwise `find()` is run, and its result is stored in the shared folder for the next time.
    """
    place = f"{folder.rstrip('/')}/{fingerprint}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
    reused = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    if not reused:
        find().write.mode("overwrite").parquet(place)
    return spark.read.parquet(place), reused


def discover(
    known: Knowledge, fact: str | None = None, hidden_tables: tuple[str, ...] = (),
    hidden_columns: tuple[tuple[str, str], ...] = (), max_items: int | None = None,
    measure: Column | None = None,
) -> DataFrame:
    """Ranked findings: broken relations, suspicious columns, and the key measure over time.

    Hidden tables and columns take no part; a fact table without a date has no series.
    """
    known = without(known, hidden_tables, hidden_columns)
    parts = [findings.relation_findings(known.measured_df),
             findings.column_findings(known.profile_df)]
    dated = known.profile_df.where("detected_type like 'datetime%'").orderBy(
        "table_name", "ordinal").select("table_name", "column_name").collect()
    dates = {}
    for row in dated:
        dates.setdefault(row.table_name, row.column_name)
    if fact is None and dates:
        with_dates = known.tables_df.where(F.col("table_name").isin(*dates))
        fact = segments.pick_fact(with_dates, known.relations_df).first().table_name
    if fact in dates:
        if measure is None:
            picked = segments.pick_measure(known.columns_df, known.profile_df)
            name = picked.where(F.col("table_name") == fact).first().measure
            measure = None if name is None else F.col(name)
        line = series.monthly_series(known.tables[fact], dates[fact], measure)
        parts.append(findings.series_findings(line, fact))
    return findings.rank_findings(catalog.union_all(parts), max_items)


def map_concepts(
    profile_df: DataFrame, existing_df: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(mappings, counts): columns proposed, flagged, corrected by what people confirmed, and merged.

    Decisions in `existing_df` stay as they are and teach the proposals of columns of the same name.
    """
    proposed = semantics.flag_arbitration(semantics.propose_concepts(profile_df))
    taught = semantics.apply_learning(
        proposed, profile_df, semantics.learned_patterns(existing_df))
    return semantics.merge_proposals(existing_df, taught)


def score_quality(
    known: Knowledge, usage_df: DataFrame, as_of: str, weights: dict[str, float] | None = None
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(columns, tables, relations, base) quality of everything known."""
    columns = quality.quality_columns(
        known.profile_df, known.measured_df, known.columns_df.where("is_pk"), as_of, weights
    )
    tables = quality.quality_tables(columns, usage_df)
    edges = quality.quality_relations(known.measured_df)
    return columns, tables, edges, quality.quality_base(tables, columns, edges)

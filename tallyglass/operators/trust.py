"""How far an analysis can be trusted: confidence, checks, reliability, proof.

An audit log grows without end while the situations in it, which tables and columns an analysis
used, hardly do. So each distinct situation is rated once, with what is known about tables folded
into one small map per kind (`table -> score`, `table -> columns` …), and rows look their
situation up. The log itself is neither exploded nor shuffled, whatever table dominates it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tallyglass.functions import fixed

PARTS = tuple(fixed.CONFIDENCE_WEIGHTS)
MOST_SITUATIONS = 20_000


def _short(names: Column) -> Column:
    return F.transform(names, lambda t: F.lower(F.element_at(F.split(t, r"\."), -1)))


def _lookup(df: DataFrame, key: str, value: Column) -> Column:
    """A catalog-sized table as one map, to be set beside the rows of another table."""
    pairs = df.groupBy(F.lower(key).alias("k")).agg(value.alias("v"))
    return pairs.agg(F.map_from_entries(F.collect_list(F.struct("k", "v")))).scalar()


def _found(names: Column, table: Column) -> Column:
    """Values of the names that the map knows, in order."""
    return F.filter(
        F.transform(names, lambda n: F.try_element_at(table, n)), lambda v: v.isNotNull()
    )


def _clamp(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.nullif(
        F.size(values), F.lit(0))


def _edges(relations_df: DataFrame) -> Column:
    return relations_df.agg(F.collect_list(F.struct(
        F.lower("from_table").alias("a"), F.lower("to_table").alias("b"), "kind", "status"
    ))).scalar()


def _involved(edges: Column, names: Column) -> Column:
    return F.filter(edges, lambda e: F.array_contains(names, e.a) & F.array_contains(names, e.b))


def _trusted(e: Column) -> Column:
    return (e["status"] == "validated") | (e["kind"] == "declared")


def by_situation(
    df: DataFrame, parts: dict[str, Column], rate: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """The rows with `parts` and what `rate` adds to a table of them, done once for each combination.

    The combinations are counted when this is called. Up to MOST_SITUATIONS they are broadcast; more
    are joined as Spark sees fit, on their hash and on the parts themselves.
    """
    rows = df.withColumns(parts)
    seen = rows.select(*parts).distinct()
    few = seen.count() <= MOST_SITUATIONS
    rated = rate(seen)
    added = [c for c in rated.columns if c not in parts]
    rated = rated.select(*[F.col(p).alias(f"_of{p}") for p in parts], *added,
                         F.xxhash64(*parts).alias("_of"))
    same = F.xxhash64(*parts) == F.col("_of")
    for p in parts:
        same = same & F.col(p).eqNullSafe(F.col(f"_of{p}"))
    return rows.join(F.broadcast(rated) if few else rated, same).select(*rows.columns, *added)


# --- sub-scores ------------------------------------------------------------------------------

def relation_subscore(names: Column, edges: Column) -> Column:
    """1.0 for one table or trusted links, 0.6 for inferred ones, 0.9 where none is known."""
    involved = _involved(edges, names)
    return (
        F.when(F.size(names) < 2, 1.0).when(F.size(involved) == 0, 0.9)
        .when(F.forall(involved, _trusted), 1.0).otherwise(0.6)
    )


def coverage_subscore() -> Column:
    """0 for an empty result; sampling and truncation each take 0.4."""
    lost = F.when(F.col("sampled"), 0.4).otherwise(0.0) + F.when(
        F.col("truncated"), 0.4).otherwise(0.0)
    return F.when(F.col("row_count") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - lost))


def hypothesis_subscore() -> Column:
    return F.greatest(F.lit(0.0), 1 - 0.34 * F.col("n_assumptions"))


def quality_subscore(names: Column, scores: Column) -> Column:
    """Mean score of the tables used; 0.7 where none was scored."""
    return F.coalesce(_mean(_found(names, scores)), F.lit(0.7))


def concept_subscore(names: Column, statuses: Column) -> Column:
    """1.0 decided, 0.8 decided and proposed, 0.6 only proposed or rejected, 0.5 none."""
    seen = F.array_distinct(F.flatten(_found(names, statuses)))
    decided = F.arrays_overlap(seen, F.array(F.lit("validated"), F.lit("corrected")))
    return (
        F.when(F.size(seen) == 0, 0.5)
        .when(decided & ~F.array_contains(seen, "proposed"), 1.0)
        .when(decided, 0.8).otherwise(0.6)
    )


def confidence(
    audit_df: DataFrame, quality_df: DataFrame, mappings_df: DataFrame, relations_df: DataFrame
) -> DataFrame:
    """Weighted confidence of every analysis with its sub-scores, factors and breakdown.

    `audit_df`: analysis_id, tables_used, row_count, sampled, truncated, n_assumptions.
    """
    return _scored(audit_df, quality_df, mappings_df, relations_df).select(
        "analysis_id", "score", *[f"{n}_sub" for n in PARTS], "factors", "breakdown")


def _scored(
    audit_df: DataFrame, quality_df: DataFrame, mappings_df: DataFrame, relations_df: DataFrame
) -> DataFrame:
    """The audit rows with their confidence beside them."""
    names, scores = F.col("_names"), F.col("_scores")

    def rate(situations: DataFrame) -> DataFrame:
        return situations.select(
            "*", _edges(relations_df).alias("_edges"),
            _lookup(quality_df, "table_name", F.max("score")).alias("_scores"),
            _lookup(mappings_df, "table_name", F.collect_set("status")).alias("_statuses"),
        ).select(
            "_names", quality_subscore(names, scores).alias("quality_sub"),
            concept_subscore(names, F.col("_statuses")).alias("concepts_sub"),
            relation_subscore(names, F.col("_edges")).alias("relations_sub"),
            F.size(_found(names, scores)).alias("_scored"),
        )

    rows = by_situation(audit_df, {"_names": _short("tables_used")}, rate).withColumns({
        "query_sub": F.lit(1.0), "coverage_sub": coverage_subscore(),
        "hypotheses_sub": hypothesis_subscore()})
    sub = {name: F.col(f"{name}_sub") for name in PARTS}
    score = F.lit(0.0)
    for name, weight in fixed.CONFIDENCE_WEIGHTS.items():
        score = score + sub[name] * weight
    said = F.array(
        F.when((F.size("_names") > 0) & (F.col("_scored") == 0), "quality unknown")
        .when((F.col("_scored") > 0) & (sub["quality"] < 0.95), "quality below 95%"),
        F.when((F.size("_names") > 0) & (sub["concepts"] == 0.5), "no concept known")
        .when(sub["concepts"] == 0.8, "some concepts only proposed")
        .when(sub["concepts"] == 0.6, "concepts not validated"),
        F.when(sub["relations"] == 0.6, "inferred relations"),
        F.when(F.col("row_count") == 0, "no rows"),
        F.when((F.col("row_count") > 0) & F.col("sampled"), "sample only"),
        F.when((F.col("row_count") > 0) & F.col("truncated"), "truncated"),
        F.when(F.col("n_assumptions") > 0, "assumptions made"),
    )
    factors = F.filter(said, lambda f: f.isNotNull())
    breakdown = F.array(*[
        F.struct(
            F.round(sub[n] * w * 100, 1).alias("contribution_pct"), F.lit(n).alias("factor"),
            F.lit(round(w * 100)).alias("weight_pct"),
            F.round(sub[n] * 100).alias("subscore_pct"),
        )
        for n, w in fixed.CONFIDENCE_WEIGHTS.items()
    ])
    return rows.select(
        *[c for c in audit_df.columns if c not in ("score", "factors", "breakdown")],
        _clamp(score).alias("score"), *[sub[n].alias(f"{n}_sub") for n in PARTS],
        F.when(F.size(factors) == 0, F.array(F.lit("all signals good"))).otherwise(factors)
        .alias("factors"),
        F.sort_array(breakdown, asc=False).alias("breakdown"),
    )


# --- checks ----------------------------------------------------------------------------------

def checks(
    audit_df: DataFrame, profile_df: DataFrame, as_of: str, measured_df: DataFrame | None = None
) -> DataFrame:
    """(analysis_id, check, result, detail): what was tested, one row per test that applies.

    Amount basis, dates, NULLs in used columns, join fan-out (for analyses that join and
    aggregate) and the row count.
    """
    return _checked(audit_df, profile_df, as_of, measured_df).select(
        "analysis_id", F.inline("_checks"))


def _checked(
    audit_df: DataFrame, profile_df: DataFrame, as_of: str, measured_df: DataFrame | None = None
) -> DataFrame:
    """The audit rows with the array of their checks beside them."""
    facts = F.struct(
        F.col("ordinal").alias("ordinal"), F.lower("column_name").alias("name"),
        F.coalesce("null_rate", F.lit(0.0)).alias("null_rate"),
        F.expr("try_cast(left(max_value, 10) as date)").alias("latest"),
        F.col("detected_type").alias("type"),
    )
    names, used = F.col("_names"), F.col("_cols")
    money = F.filter("_known", lambda p: p["name"].rlike(fixed.MONEY_CHECK_NAME))
    used_money = F.filter(money, lambda p: F.array_contains(used, p["name"]))
    is_gross = lambda p: p["name"].rlike(fixed.GROSS_CHECK_NAME)
    risky_basis = F.exists(money, is_gross) & ~F.exists(used_money, is_gross)
    dates = F.filter("_known", lambda p: (
        p["type"].startswith("datetime") | p["name"].rlike(fixed.DATE_CHECK_NAME)
    ) & (F.array_contains(used, p["name"]) | F.col("_aggregates")))
    today = F.lit(as_of).cast("date")
    wrong = F.filter(dates, lambda p: F.coalesce(p["latest"] > today, F.lit(False)) | (
        p["null_rate"] >= 0.1))
    empty = F.filter("_known", lambda p: F.array_contains(used, p["name"]) & (
        p["null_rate"] >= 0.3))
    worst = F.array_max(F.transform(empty, lambda p: F.struct(
        p["null_rate"].alias("null_rate"), p["name"].alias("name"))))
    size = F.col("row_count")

    def check(name, applies, result, detail):
        return F.when(applies, F.struct(
            F.lit(name).alias("check"), result.alias("result"), detail.alias("detail")
        ))

    def listed(profiles):
        return F.array_join(F.array_sort(F.array_distinct(
            F.transform(profiles, lambda p: p["name"]))), ",")

    tests = [
        check("measure", F.size(used_money) > 0, F.when(risky_basis, "warn").otherwise("pass"),
              F.concat(F.lit("amount: "), listed(used_money))),
        check("dates", F.size(dates) > 0, F.when(F.size(wrong) > 0, "warn").otherwise("pass"),
              F.when(F.size(wrong) > 0, F.concat(
                  F.lit("look at "), F.try_element_at(wrong, F.lit(1))["name"]))
              .otherwise("plausible")),
        check("nulls", (F.size(used) > 0) | (F.size(empty) > 0),
              F.when(F.size(empty) > 0, "warn").otherwise("pass"),
              F.when(F.size(empty) > 0, F.concat(worst["name"], F.lit(" is mostly NULL")))
              .otherwise("few NULL")),
    ]
    beside = [_lookup(profile_df, "table_name", F.sort_array(F.collect_list(facts)))
              .alias("_profiles")]
    if measured_df is not None:
        doubled = (F.size(_involved(F.col("_wide"), names)) > 0) & F.col("_aggregates")
        tests.append(check(
            "join_fanout", F.size(names) > 1, F.when(doubled, "warn").otherwise("pass"),
            F.when(doubled, "rows may be counted twice").otherwise("no fan-out")))
        beside.append(measured_df.where("cardinality in ('1-n', 'n-n')").agg(
            F.collect_list(F.struct(F.lower("from_table").alias("a"),
                                    F.lower("to_table").alias("b")))).scalar().alias("_wide"))

    def rate(situations: DataFrame) -> DataFrame:
        return situations.select("*", *beside).withColumn(
            "_known", F.flatten(_found(names, F.col("_profiles")))
        ).select("_names", "_cols", "_aggregates",
                 F.filter(F.array(*tests), lambda c: c.isNotNull()).alias("_tested"))

    rows = check("row_count", F.lit(True), F.when(size == 0, "fail").when(
        F.col("truncated"), "warn").otherwise("pass"),
        F.when(size == 0, "empty").when(F.col("truncated"), "truncated")
        .otherwise(F.concat(size.cast("string"), F.lit(" rows"))))
    situation = {"_names": _short("tables_used"), "_cols": _short("columns_used"),
                 "_aggregates": F.col("aggregates")}
    return by_situation(audit_df, situation, rate).select(
        *audit_df.columns, F.concat("_tested", F.array(rows)).alias("_checks"))


def reliability(
    checks_df: DataFrame, confidence_df: DataFrame, audit_df: DataFrame | None = None
) -> DataFrame:
    """Confidence less 0.20 per failed and 0.05 per warned check, as percent and stars.

    With `audit_df` (row_count, causal, has_drivers) an empty result gets one star, and an
    analysis that asks for a cause without any driver gets the verdict `cannot_conclude`.
    """
    tallied = checks_df.groupBy("analysis_id").agg(
        F.count_if(F.col("result") == "fail").alias("n_fail"),
        F.count_if(F.col("result") == "warn").alias("n_warn"),
        F.max(F.when(F.col("check") == "nulls", F.col("result"))).alias("nulls"),
        F.max(F.when(F.col("check") == "dates", F.col("result"))).alias("dates"),
        F.max(F.when(F.col("check") == "row_count", F.col("result"))).alias("rows"),
    )
    joined = confidence_df.join(tallied, "analysis_id", "left")
    if audit_df is not None:
        flags = audit_df.select("analysis_id", "causal", "has_drivers")
        joined = joined.join(flags, "analysis_id", "left")
    return _rated(joined, audit_df is not None)


def rate_analyses(
    audit_df: DataFrame, profile_df: DataFrame, as_of: str, quality_df: DataFrame,
    mappings_df: DataFrame, relations_df: DataFrame, measured_df: DataFrame | None = None,
) -> DataFrame:
    """What `reliability` says, straight from the log, which is neither exploded nor shuffled.

    Checks stay an array of their row, and are counted in the projection that scores it.
    """
    checked = _checked(audit_df, profile_df, as_of, measured_df)
    rows = _scored(checked, quality_df, mappings_df, relations_df)

    def having(result: str) -> Column:
        return F.size(F.filter("_checks", lambda c: c["result"] == result))

    def of(check: str) -> Column:
        return F.try_element_at(F.filter("_checks", lambda c: c["check"] == check),
                                F.lit(1))["result"]

    return _rated(rows.withColumns({
        "n_fail": having("fail"), "n_warn": having("warn"), "nulls": of("nulls"),
        "dates": of("dates"), "rows": of("row_count")}), True)


def _rated(joined: DataFrame, flagged: bool) -> DataFrame:
    """(analysis_id, percent, stars, factors, verdict) of rows with scores and counted checks."""
    fails, warns = F.coalesce("n_fail", F.lit(0)), F.coalesce("n_warn", F.lit(0))
    score = _clamp(F.col("score") - 0.20 * fails - 0.05 * warns)
    stars = F.when(F.col("rows") == "fail", 1).otherwise(
        F.least(F.lit(5), F.greatest(F.lit(1), F.bround(score * 5).cast("int"))))
    verdict = F.lit(None).cast("string")
    if flagged:
        verdict = F.when(F.col("causal") & ~F.col("has_drivers"), "cannot_conclude")

    def ok(test, otherwise):
        return F.when(test, "ok").otherwise(otherwise)

    factors = F.struct(
        ok(F.col("concepts_sub").isin(1.0, 0.8),
           F.when(F.col("concepts_sub") == 0.5, "warn").otherwise("fail")).alias("concepts"),
        ok(F.coalesce(F.col("nulls"), F.lit("pass")) == "pass", F.lit("warn")).alias("nulls"),
        ok(F.col("relations_sub") == 1.0, F.lit("warn")).alias("relations"),
        ok(F.coalesce(F.col("dates"), F.lit("pass")) == "pass", F.lit("warn")).alias("dates"),
        # One assumption gives 1 - 0.34, which is a little under 0.66 in binary.
        ok(F.round("hypotheses_sub", 6) >= 0.66, F.lit("warn")).alias("hypotheses"),
    )
    return joined.select(
        "analysis_id", F.bround(score * 100).cast("int").alias("percent"), stars.alias("stars"),
        factors.alias("factors"), verdict.alias("verdict"),
    )


# --- proof -----------------------------------------------------------------------------------

def evidence_level(
    quality_pct: Column, concept: Column, inferred: Column, assumptions: Column
) -> Column:
    """`strong`, `medium` or `weak`."""
    high = F.coalesce(quality_pct >= 98, F.lit(False)) | concept
    return (
        F.when((assumptions >= 3) | F.coalesce(quality_pct < 70, F.lit(False)), "weak")
        .when(high & ~inferred & (assumptions == 0), "strong")
        .when(inferred | (assumptions >= 1) | F.coalesce(quality_pct < 90, F.lit(False)),
              "medium")
        .when(quality_pct.isNotNull(), "strong").otherwise("medium")
    )


def table_proof(
    audit_df: DataFrame, columns_df: DataFrame, quality_df: DataFrame, mappings_df: DataFrame
) -> DataFrame:
    """Why this table: share of the needed real columns it has, its quality, its concept."""
    decided = mappings_df.where("status in ('validated', 'corrected')")
    names = F.collect_set(F.lower("column_name"))
    table = F.col("table_name")
    rows = audit_df.select(
        "analysis_id", "n_assumptions", _short("columns_used").alias("_cols"),
        F.try_element_at(_short("tables_used"), F.lit(1)).alias("table_name"),
        columns_df.agg(names).scalar().alias("_all"),
        _lookup(columns_df, "table_name", names).alias("_by_table"),
        _lookup(quality_df, "table_name", F.max("score")).alias("_scores"),
        _lookup(decided, "table_name", F.min("concept")).alias("_concepts"),
    ).where(table.isNotNull())
    rows = rows.withColumn(
        "_needed", F.filter("_cols", lambda c: F.array_contains(F.col("_all"), c))
    ).withColumn("_own", F.coalesce(F.try_element_at("_by_table", table),
                                    F.array().cast("array<string>")))
    present = F.filter("_needed", lambda c: F.array_contains(F.col("_own"), c))
    rows = rows.select(
        "analysis_id", "table_name", "n_assumptions",
        F.size("_needed").alias("columns_needed"), F.size(present).alias("columns_present"),
        F.bround(F.nullif(F.try_element_at("_scores", table), F.lit(0.0)) * 100)
        .cast("int").alias("quality_pct"),
        F.try_element_at("_concepts", table).alias("concept"),
    )
    coverage = F.coalesce(
        F.bround(F.col("columns_present") / F.nullif(F.col("columns_needed"), F.lit(0)) * 100),
        F.lit(100.0),
    ).cast("int")
    return rows.select(
        "analysis_id", "table_name", coverage.alias("coverage_pct"), "columns_needed",
        "columns_present", "quality_pct", "concept",
        evidence_level(F.col("quality_pct"), F.col("concept").isNotNull(), F.lit(False),
                       F.col("n_assumptions")).alias("level"),
    )


def sources(audit_df: DataFrame, quality_df: DataFrame) -> DataFrame:
    """Tables an analysis rests on, the first as `main` and others as `joined`, with quality."""
    scores = _lookup(quality_df, "table_name", F.max("score"))
    listed = audit_df.select(
        "analysis_id", F.posexplode(F.array_distinct(_short("tables_used"))).alias("pos", "t")
    )
    quality = F.bround(F.try_element_at(scores, F.col("t")) * 100).cast("int")
    no = F.lit(False)
    return listed.select(
        "analysis_id", F.col("t").alias("table_name"),
        F.when(F.col("pos") == 0, "main").otherwise("joined").alias("role"),
        quality.alias("quality_pct"),
    ).withColumn("level", evidence_level(F.col("quality_pct"), no, no, F.lit(0)))

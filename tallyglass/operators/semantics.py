"""Columns mapped to business concepts, with human decisions that are never overwritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyglass.functions import fixed
from tallyglass.functions.text import contains_any, has_word, quoted

DECIDED = ("validated", "corrected", "rejected")
COLUMN = ["table_name", "column_name"]


def concepts(spark, lexicon=fixed.LEXICON) -> DataFrame:
    """The lexicon as a table: concept, description, synonyms, origin."""
    return spark.createDataFrame(
        [(e["concept"], e["description"], list(e["name_hints"]), "system") for e in lexicon],
        "concept string, description string, synonyms array<string>, origin string",
    )


def _lexicon_sql(lexicon) -> str:
    """The lexicon as one literal array, so that a column weighs all of it in one row."""
    def words(values):
        listed = ", ".join(quoted(v) for v in values)
        return f"array({listed})" if values else "cast(array() as array<string>)"

    return "array(" + ", ".join(
        f"named_struct('rank', {i}, 'concept', {quoted(e['concept'])}, "
        f"'name_hints', {words(e['name_hints'])}, "
        f"'table_hints', {words(e.get('table_hints', ()))}, "
        f"'pii', {quoted(e['pii']) if e.get('pii') else 'cast(null as string)'}, "
        f"'temporal', {str(bool(e.get('temporal'))).lower()}, "
        f"'numeric_only', {str(bool(e.get('numeric_only'))).lower()})"
        for i, e in enumerate(lexicon)) + ")"


def _first_hint(hints: str, name: str, words: str) -> str:
    """First hint the name answers to: a suffix (`_at`), a whole word, or a part of 4+ letters."""
    return (f"try_element_at(filter({hints}, h -> if(startswith(h, '_'), endswith({name}, h), "
            f"array_contains({words}, h) or (length(h) >= 4 and contains({name}, h)))), 1)")


def _signals_sql(lexicon) -> str:
    """What speaks for each concept: content, name, table."""
    return f"""transform({_lexicon_sql(lexicon)}, e -> named_struct(
      'rank', e.rank, 'concept', e.concept,
      'content', case when e.pii = pii_type then 0.9D
        when e.temporal and startswith(detected_type, 'datetime') then 0.75D else 0D end,
      'hint', {_first_hint('e.name_hints', 'low_name', 'name_words')},
      'fits', not e.numeric_only or detected_type in ('integer', 'numeric'),
      'table_hint', if(column_name in ('id', concat(rtrim('s', table_name), '_id')),
        {_first_hint('e.table_hints', 'low_table', 'table_words')}, null)))"""


CANDIDATES = """transform(signals, s -> named_struct(
  'confidence', greatest(s.content,
    case when s.hint is not null and s.fits then if(s.content >= 0.7D, 0.85D, 0.7D) end,
    case when s.table_hint is not null then 0.8D end),
  'order', -s.rank, 'concept', s.concept,
  'rationale', concat_ws(' ; ',
    case when s.content = 0.9D then concat('values look like ', pii_type)
      when s.content = 0.75D then 'values are points in time' end,
    case when s.hint is not null then
      concat('name says ', s.hint, if(s.fits, '', ' but values are not numbers')) end,
    case when s.table_hint is not null then concat('key of table ', table_name) end)))"""


def propose_concepts(profile_df: DataFrame, lexicon=fixed.LEXICON) -> DataFrame:
    """The best concept per column, never validated by itself; the earlier one wins a tie.

    The lexicon is a short list, so each column weighs all of it in one row: no join at all.
    """
    found = profile_df.selectExpr(
        *COLUMN, "pii_type", "detected_type", "lower(column_name) as low_name",
        "lower(table_name) as low_table",
        "split(lower(column_name), '[_\\\\W]+') as name_words",
        "split(lower(table_name), '[_\\\\W]+') as table_words",
    ).selectExpr(*COLUMN, "pii_type", f"{_signals_sql(lexicon)} as signals").selectExpr(
        *COLUMN, f"array_max({CANDIDATES}) as b").where("b.confidence > 0")
    return found.select(
        *COLUMN, "b.concept", F.round("b.confidence", 2).alias("confidence"), "b.rationale"
    )


def amount_variant(name: Column) -> Column:
    """`net`, `gross` or NULL, by the words of an amount column."""
    net = has_word(name, fixed.NET_TOKENS) | contains_any(name, fixed.NET_PARTS)
    gross = has_word(name, fixed.GROSS_TOKENS) | contains_any(name, fixed.GROSS_PARTS)
    return F.when(net, "net").when(gross, "gross")


def flag_arbitration(proposals_df: DataFrame) -> DataFrame:
    """Mark every amount column when net, gross or unmarked amounts exist side by side.

    The note says how many there are of each kind; which they are, the rows themselves tell.
    """
    amount = F.col("concept") == "Montant"
    marked = proposals_df.withColumn(
        "variant", F.when(amount, amount_variant(F.col("column_name")))
    )
    kinds = ("net", "gross", "unmarked")
    seen = marked.where(amount).agg(*[
        F.count_if(F.coalesce("variant", F.lit("unmarked")) == kind).alias(kind) for kind in kinds])
    clash = sum(((F.col(kind) > 0).cast("int") for kind in kinds), F.lit(0)) > 1
    listing = seen.select(F.when(clash, F.concat_ws(", ", *[
        F.concat_ws(" ", F.col(kind).cast("string"), F.lit(kind)) for kind in kinds]))).scalar()
    note = F.when(amount, listing)
    return marked.select(
        *COLUMN, "concept", "confidence", "rationale", "variant",
        note.isNotNull().alias("needs_arbitration"),
        F.concat(F.lit("Several kinds of amount: "), note).alias("arbitration_note"),
    )


def learned_patterns(mappings_df: DataFrame) -> DataFrame:
    """Per column name the concept people confirmed most often, and how often."""
    votes = mappings_df.where("status in ('validated', 'corrected')").groupBy(
        F.lower("column_name").alias("name"), "concept"
    ).agg(F.count("*").alias("support"))
    # The smallest of (-support, concept) is the strongest, ties by name.
    return votes.groupBy("name").agg(
        F.min(F.struct((-F.col("support")).alias("s"), "concept")).alias("b")
    ).select("name", "b.concept", (-F.col("b.s")).alias("support"))


def apply_learning(
    proposals_df: DataFrame, profile_df: DataFrame, learned_df: DataFrame
) -> DataFrame:
    """Strengthen, replace or create proposals from what people confirmed elsewhere."""
    learned = learned_df.select(
        F.col("name").alias("_name"), F.col("concept").alias("_concept"),
        F.col("support").alias("_support"),
    )
    known = profile_df.select(*COLUMN).join(
        learned, F.lower("column_name") == F.col("_name"), "left"
    ).join(proposals_df, COLUMN, "left")
    n = F.col("_support")
    taught, fresh = F.col("_concept").isNotNull(), F.col("concept").isNull()
    same = F.col("concept") == F.col("_concept")
    note = F.format_string("learned from %d decisions", n)
    return known.where(taught | ~fresh).select(
        *COLUMN,
        F.coalesce("_concept", "concept").alias("concept"),
        F.when(~taught, F.col("confidence"))
        .when(fresh, F.least(F.lit(0.9), 0.8 + 0.03 * n))
        .when(same, F.round(F.least(F.lit(0.98), F.col("confidence") + 0.05 + 0.02 * n), 2))
        .otherwise(F.round(F.least(F.lit(0.95), 0.85 + 0.03 * n), 2)).alias("confidence"),
        F.when(~taught, F.col("rationale")).when(
            ~fresh & same, F.concat_ws(" ; ", "rationale", note)).otherwise(note)
        .alias("rationale"),
        F.when(taught & (fresh | ~same), F.lit(False))
        .otherwise(F.col("needs_arbitration")).alias("needs_arbitration"),
    )


MAPPING = [*COLUMN, "concept", "confidence", "rationale", "status", "needs_arbitration"]


def merge_proposals(
    existing_df: DataFrame, proposals_df: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(mappings, counts): decisions stay, open proposals are refreshed or replaced."""
    decided = existing_df.where(F.col("status").isin(*DECIDED)).select(*COLUMN).distinct()
    open_now = existing_df.where("status = 'proposed'")
    usable = proposals_df.join(decided, COLUMN, "left_anti")
    fresh = usable.select(
        *COLUMN, "concept", "confidence", "rationale", F.lit("proposed").alias("status"),
        "needs_arbitration",
    )
    untouched = existing_df.join(usable, COLUMN, "left_anti").select(*MAPPING)
    same = open_now.select(*COLUMN, "concept").distinct().withColumn("_open", F.lit(True))
    kept = decided.withColumn("_kept", F.lit(True))
    fates = proposals_df.join(same, [*COLUMN, "concept"], "left").join(kept, COLUMN, "left")
    is_kept = F.coalesce("_kept", F.lit(False))
    is_open = F.coalesce("_open", F.lit(False))
    counts = fates.agg(
        F.count_if(~is_kept & ~is_open).alias("proposed"),
        F.count_if(~is_kept & is_open).alias("updated"),
        F.count_if(is_kept).alias("kept_decisions"),
        F.count_if("needs_arbitration").alias("arbitrations"),
    )
    return untouched.unionByName(fresh), counts


def review_mappings(
    mappings_df: DataFrame, concepts_df: DataFrame, decisions_df: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(mappings, concepts) after validate / reject / correct decisions.

    A correction needs a concept; it also teaches that concept the column name as a synonym.
    """
    valid = decisions_df.where(
        "action in ('validate', 'reject') or (action = 'correct' and new_concept is not null)"
    ).select(*COLUMN, "action", "new_concept")
    joined = mappings_df.join(valid, COLUMN, "left")
    action = F.col("action")
    reviewed = joined.select(
        *COLUMN,
        F.when(action == "correct", F.col("new_concept")).otherwise(F.col("concept"))
        .alias("concept"),
        "confidence", "rationale",
        F.when(action == "validate", "validated").when(action == "reject", "rejected")
        .when(action == "correct", "corrected").otherwise(F.col("status")).alias("status"),
        F.when(action.isin("validate", "correct"), F.lit(False))
        .otherwise(F.col("needs_arbitration")).alias("needs_arbitration"),
    )
    taught = joined.where(action == "correct").groupBy(F.col("new_concept").alias("concept")).agg(
        F.collect_set(F.lower("column_name")).alias("_new")
    )
    none = F.array().cast("array<string>")
    enriched = concepts_df.join(taught, "concept", "full").select(
        "concept", F.coalesce("description", F.lit("")).alias("description"),
        F.when(F.col("_new").isNull(), F.col("synonyms")).otherwise(F.sort_array(F.array_union(
            F.coalesce("synonyms", none), F.coalesce("_new", none)))).alias("synonyms"),
        F.coalesce("origin", F.lit("user")).alias("origin"),
    )
    return reviewed, enriched


def dictionary(mappings_df: DataFrame, concepts_df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(concept, table, column) and (table, word), one row each, from decided mappings only.

    A concept may have very many columns: whoever exports the dictionary folds the rows.
    """
    decided = mappings_df.where("status in ('validated', 'corrected')")
    by_concept = decided.select("concept", *COLUMN).distinct()
    words = F.transform(
        F.concat(F.array("concept"), F.coalesce("synonyms", F.array().cast("array<string>"))),
        F.lower,
    )
    by_table = decided.select("table_name", "concept").distinct().join(
        concepts_df, "concept", "left"
    ).select("table_name", F.explode(words).alias("word")).distinct()
    return by_concept, by_table


def synonym_history(concepts_df: DataFrame, decisions_df: DataFrame) -> DataFrame:
    """(concept, word, valid_from, valid_to): every synonym as a row, with the time it holds.

    Words of the lexicon hold always (NULL ends). A correction teaches its concept the column's name
    from `decided_at` on, until a later correction gives that name to another concept. Of
    several corrections of a name at one moment the last concept by name counts. Only the decisions
    of one name are ever ordered together.
    """
    taught = decisions_df.where("action = 'correct' and new_concept is not null").groupBy(
        F.lower("column_name").alias("word"), "decided_at"
    ).agg(F.max("new_concept").alias("concept"))
    by_word = Window.partitionBy("word").orderBy("decided_at")
    changed = taught.withColumn("_before", F.lag("concept").over(by_word)).where(
        ~F.col("concept").eqNullSafe(F.col("_before")))
    rows = changed.select(
        "concept", "word", F.col("decided_at").alias("valid_from"),
        F.lead("decided_at").over(by_word).alias("valid_to"))
    none = F.lit(None).cast(decisions_df.schema["decided_at"].dataType)
    return concepts_df.select(
        "concept", F.explode("synonyms").alias("word"), none.alias("valid_from"),
        none.alias("valid_to")).unionByName(rows)


def synonyms_as_of(history_df: DataFrame, moment: Column) -> DataFrame:
    """(concept, word) that hold at a moment; an end is the first moment at which a row does not."""
    return history_df.where(
        (F.col("valid_from").isNull() | (F.col("valid_from") <= moment))
        & (F.col("valid_to").isNull() | (F.col("valid_to") > moment))
    ).select("concept", "word").distinct()


def words_as_of(mappings_df: DataFrame, history_df: DataFrame, moment: Column) -> DataFrame:
    """(table, word): each decided concept of a table, and its synonyms at a moment, a row each."""
    decided = mappings_df.where("status in ('validated', 'corrected')").select(
        "table_name", "concept").distinct()
    words = synonyms_as_of(history_df, moment).select("concept", F.lower("word").alias("word"))
    return decided.select("table_name", F.lower("concept").alias("word")).unionByName(
        decided.join(words, "concept").select("table_name", "word")).distinct()


def money_basis(name: Column) -> Column:
    """`gross`, `net` or NULL for a money column; gross words win."""
    gross = has_word(name, fixed.BASIS_GROSS_TOKENS) | F.lower(name).contains("_ttc")
    net = has_word(name, fixed.BASIS_NET_TOKENS) | contains_any(name, ("_ht", "net_price"))
    return F.when(gross, "gross").when(net, "net")


def arbitrate_measures(
    columns_df: DataFrame, basis: str | None = None, convention: str | None = None
) -> DataFrame:
    """Amount columns of each table with the recommended and the chosen one.

    An explicit basis wins, then the company's convention, then gross, then the first column.
    `columns_df`: table_name, column_name, ordinal, data_type, is_pk.
    """
    name = F.col("column_name")
    money = columns_df.where(
        F.col("data_type").rlike("int|decimal|double|float") & ~F.col("is_pk")
        & ~F.lower("column_name").endswith("id") & name.rlike(fixed.MONEY_NAME)
    ).withColumn("basis", money_basis(name))
    wanted = F.lit(None).cast("int")
    for rank, choice in enumerate((basis, convention)):
        if choice:
            wanted = F.coalesce(wanted, F.when(F.col("basis") == choice, rank))
    order = F.struct(
        F.coalesce(wanted, F.when(F.col("basis") == "gross", 2), F.lit(3)).alias("w"),
        F.col("ordinal").alias("o"), name.alias("c"),
    )
    by_gross = F.struct((F.coalesce(F.col("basis"), F.lit("")) != "gross").alias("w"),
                        F.col("ordinal").alias("o"), name.alias("c"))
    picks = money.groupBy("table_name").agg(
        F.min(order).alias("chosen_key"), F.min(by_gross).alias("gross_key")
    )
    advised = F.when(~F.col("gross_key.w"), F.col("gross_key.c")).otherwise(F.col("chosen_key.c"))
    return money.join(picks, "table_name").select(
        "table_name", "column_name", "basis",
        (name == advised).alias("recommended"), (name == F.col("chosen_key.c")).alias("chosen"),
    )

"""Business concepts proposed, learned, merged and reviewed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyglass.functions import fixed
from tallyglass.operators import profile as P, semantics as S
from tallyglass.sources import catalog
from tallyglass.plans import analysis
from workload import base
from workload.base import profile_sql, query, table, tables

PARTS = (base.CONTACTS_PART, base.ORDERS_PART, base.AMOUNTS_PART, base.plain_part("part"))


def profiles(spark, sf):
    return P.profile_all({
        "customer": base.contacts(spark, sf), "orders": base.orders_plus(spark, sf),
        "amounts": base.amounts(spark, sf), "part": table(spark, sf, "part"),
    })


def _hint_sql(name: str, hints) -> str:
    tests = []
    for hint in hints:
        if hint.startswith("_"):
            test = f"ends_with(lower({name}), '{hint}')"
        else:
            test = (f"list_contains(string_split_regex(lower({name}), '[_\\W]+'), '{hint}')")
            if len(hint) >= 4:
                test += f" or contains(lower({name}), '{hint}')"
        tests.append(f"when {test} then '{hint}'")
    return f"case {' '.join(tests)} end" if tests else "cast(null as varchar)"


def proposals_sql() -> str:
    """Candidates concept by concept, then the best per column."""
    branches = []
    for order, entry in enumerate(fixed.LEXICON):
        pii = f"coalesce(pii_type = '{entry['pii']}', false)" if entry.get("pii") else "false"
        time = "starts_with(detected_type, 'datetime')" if entry.get("temporal") else "false"
        fits = "detected_type in ('integer', 'numeric')" if entry.get("numeric_only") else "true"
        hint = _hint_sql("column_name", entry["name_hints"])
        table_hint = _hint_sql("table_name", entry.get("table_hints", ()))
        branches.append(f"""
          select table_name, column_name, '{entry['concept']}' as concept, {order} as rank,
            concat_ws(' ; ', case when c0 = 0.9 then 'values look like ' || pii_type
                when c0 = 0.75 then 'values are points in time' end,
              case when hint is not null then 'name says ' || hint || case when {fits} then ''
                else ' but values are not numbers' end end,
              case when th is not null and (column_name = 'id'
                or column_name = rtrim(table_name, 's') || '_id')
                then 'key of table ' || table_name end) as rationale,
            greatest(c0, case when hint is not null and {fits}
                then case when c0 >= 0.7 then 0.85 else 0.7 end end,
              case when th is not null and (column_name = 'id'
                or column_name = rtrim(table_name, 's') || '_id') then 0.8 end) as confidence
          from (select *, case when {pii} then 0.9 when {time} then 0.75 else 0.0 end as c0,
                  {hint} as hint, {table_hint} as th from p)""")
    return f"""(
      with p as ({profile_sql(*PARTS)}), candidates as ({' union all '.join(branches)})
      select table_name, column_name, concept, cast(confidence as double) as confidence, rationale
      from candidates where confidence > 0
      qualify row_number() over (partition by table_name, column_name
        order by confidence desc, rank) = 1)"""


@query("E1_concept_proposals", f"select * from {proposals_sql()}")
def _(spark, sf):
    return S.propose_concepts(profiles(spark, sf))


NAMES = ("concat(replace(p_name, ' ', '_'), case p_size % 5 when 0 then '_ht' when 1 then '_ttc' "
         "when 2 then '_net' when 3 then '_gross_total' else '_total' end)")


def _variant_sql(name: str) -> str:
    words = f"string_split_regex(lower({name}), '[_\\W]+')"

    def has(tokens):
        return f"list_has_any({words}, [" + ", ".join(f"'{t}'" for t in tokens) + "])"

    def part(parts):
        return " or ".join(f"contains(lower({name}), '{p}')" for p in parts)

    return (f"case when {has(fixed.NET_TOKENS)} or {part(fixed.NET_PARTS)} then 'net' "
            f"when {has(fixed.GROSS_TOKENS)} or {part(fixed.GROSS_PARTS)} then 'gross' end")


@query("E2_amount_variants", f"""
select name, {_variant_sql('name')} as variant, count(*) as n
from (select {NAMES} as name from part) group by all
""")
def _(spark, sf):
    return table(spark, sf, "part").select(F.expr(NAMES).alias("name")).groupBy(
        "name", S.amount_variant(F.col("name")).alias("variant")
    ).agg(F.count("*").alias("n"))


@query("E3_arbitration", f"""
with p as (select *, case when concept = 'Montant' then {_variant_sql('column_name')} end
  as variant from {proposals_sql()}),
clash as (select count(distinct variant) > 1 or (count(distinct variant) = 1
    and count(*) filter (variant is null) > 0) as clash,
  count(*) filter (variant = 'net') || ' net, ' || count(*) filter (variant = 'gross')
    || ' gross, ' || count(*) filter (variant is null) || ' unmarked' as listing
  from p where concept = 'Montant')
select table_name, column_name, concept, variant, concept = 'Montant' and clash
  as needs_arbitration,
  case when concept = 'Montant' and clash then 'Several kinds of amount: ' || listing end
  as arbitration_note
from p, clash
""")
def _(spark, sf):
    return S.flag_arbitration(S.propose_concepts(profiles(spark, sf))).drop(
        "confidence", "rationale")


# Confirmed mappings that repeat column names, one per part.
HISTORY = [
    "lower(p_type) as table_name",
    "concat(case when p_size % 2 = 0 then 'Col_' else 'col_' end, p_brand) as column_name",
    *[e for e in base.MAPPINGS if " as concept" in e or " as status" in e],
]
HISTORY_SQL = f"(select {', '.join(HISTORY)} from part)"
LEARNED_SQL = f"""(
select name, concept, n as support from (
  select lower(column_name) as name, concept, count(*) as n from {HISTORY_SQL}
  where status in ('validated', 'corrected') group by all)
qualify row_number() over (partition by name order by n desc, concept) = 1)"""


def history(spark, sf):
    return table(spark, sf, "part").selectExpr(*HISTORY)


@query("E4_learned_patterns", f"select * from {LEARNED_SQL}")
def _(spark, sf):
    return S.learned_patterns(history(spark, sf))


# Profiled columns to apply learning to: one per supplier; proposals for part of them.
SEEN = ["concat('t', cast(s_nationkey as string)) as table_name",
        "concat('COL_Brand#', cast(s_suppkey as string)) as column_name"]
PROPOSED = [*SEEN, "case when s_suppkey % 3 = 0 then 'Montant' else 'Nom' end as concept",
            "cast(0.7 as double) as confidence", "s_name as rationale",
            "s_suppkey % 4 = 0 as needs_arbitration"]
OPEN = "s_acctbal > 2000"


@query("E5_applied_learning", f"""
with seen as (select {', '.join(SEEN)} from supplier),
prop as (select {', '.join(PROPOSED)} from supplier where {OPEN})
select s.table_name, s.column_name, coalesce(l.concept, p.concept) as concept,
  round(case when l.concept is null then p.confidence
    when p.concept is null then least(0.9, 0.8 + 0.03 * support)
    when p.concept = l.concept then least(0.98, p.confidence + 0.05 + 0.02 * support)
    else least(0.95, 0.85 + 0.03 * support) end, 6) as confidence,
  case when l.concept is not null and (p.concept is null or p.concept <> l.concept) then false
    else p.needs_arbitration end as needs_arbitration,
  case when l.concept is null then p.rationale when p.concept = l.concept
    then concat_ws(' ; ', p.rationale, 'learned from ' || support || ' decisions')
    else 'learned from ' || support || ' decisions' end as rationale
from seen s left join {LEARNED_SQL} l on l.name = lower(s.column_name)
left join prop p on p.table_name = s.table_name and p.column_name = s.column_name
where l.concept is not null or p.concept is not null
""")
def _(spark, sf):
    supplier = table(spark, sf, "supplier")
    learned = S.learned_patterns(history(spark, sf))
    return S.apply_learning(
        supplier.where(OPEN).selectExpr(*PROPOSED), supplier.selectExpr(*SEEN), learned
    ).withColumn("confidence", F.round("confidence", 6))


# New proposals for the mapped columns, with concepts that sometimes differ.
FRESH = ["lower(p_type) as table_name",
         "concat('Col_', cast(p_partkey as string)) as column_name",
         "case p_size % 3 when 0 then 'Montant' when 1 then 'Client' else 'Date' end as concept",
         "cast(0.75 as double) as confidence", "'again' as rationale",
         "p_size % 11 = 0 as needs_arbitration"]
UNSEEN = ["lower(p_type) as table_name",
          "concat('New_', cast(p_partkey as string)) as column_name", *FRESH[2:]]


def fresh(spark, sf):
    part = table(spark, sf, "part")
    return part.selectExpr(*FRESH).unionByName(part.selectExpr(*UNSEEN))


FRESH_SQL = (f"(select {', '.join(FRESH)} from part union all "
             f"select {', '.join(UNSEEN)} from part)")


@query("E6_merged_mappings", f"""
with m as {base.MAPPINGS_SQL}, f as {FRESH_SQL}
select table_name, column_name, concept, confidence, rationale, status, needs_arbitration
from m where status in ('validated', 'corrected', 'rejected')
union all
select f.table_name, f.column_name, f.concept, f.confidence, f.rationale, 'proposed',
  f.needs_arbitration
from f left join m on m.table_name = f.table_name and m.column_name = f.column_name
where coalesce(m.status, 'proposed') = 'proposed'
""")
def _(spark, sf):
    return S.merge_proposals(base.mappings(spark, sf), fresh(spark, sf))[0]


@query("E6_merge_counts", f"""
with m as {base.MAPPINGS_SQL}, f as {FRESH_SQL}
select count(*) filter (coalesce(m.status, 'proposed') = 'proposed'
    and (m.concept is null or m.concept <> f.concept)) as proposed,
  count(*) filter (m.status = 'proposed' and m.concept = f.concept) as updated,
  count(*) filter (m.status in ('validated', 'corrected', 'rejected')) as kept_decisions,
  count(*) filter (f.needs_arbitration) as arbitrations
from f left join m on m.table_name = f.table_name and m.column_name = f.column_name
""")
def _(spark, sf):
    return S.merge_proposals(base.mappings(spark, sf), fresh(spark, sf))[1]


@query("E6_concept_chain", f"""
with p as (select *, case when concept = 'Montant' then {_variant_sql('column_name')} end
  as variant from {proposals_sql()}),
clash as (select count(distinct variant) > 1 or (count(distinct variant) = 1
    and count(*) filter (variant is null) > 0) as clash from p where concept = 'Montant')
select 'elsewhere' as table_name, 'EMAIL' as column_name, 'Contrat' as concept,
  'validated' as status, false as needs_arbitration
union all
select table_name, column_name, case when lower(column_name) = 'email' then 'Contrat'
  else concept end, 'proposed', lower(column_name) <> 'email' and concept = 'Montant' and clash
from p, clash
""")
def _(spark, sf):
    said = spark.createDataFrame(
        [("elsewhere", "EMAIL", "Contrat", 1.0, "said", "validated", False)],
        "table_name string, column_name string, concept string, confidence double, "
        "rationale string, status string, needs_arbitration boolean")
    return analysis.map_concepts(profiles(spark, sf), said)[0].select(
        "table_name", "column_name", "concept", "status", "needs_arbitration")


DECISIONS = ["lower(p_type) as table_name",
             "concat('Col_', cast(p_partkey as string)) as column_name",
             "case p_size % 4 when 0 then 'validate' when 1 then 'reject' when 2 then 'correct' "
             "else 'ponder' end as action",
             "case when p_partkey % 3 = 0 then null when p_partkey % 3 = 1 then 'Magasin' "
             "else 'Contrat' end as new_concept"]
DECIDED_SQL = f"""(select m.*, d.action, d.new_concept from {base.MAPPINGS_SQL} m left join
  (select * from (select {', '.join(DECISIONS)} from part)
   where action in ('validate', 'reject') or (action = 'correct' and new_concept is not null)) d
  on d.table_name = m.table_name and d.column_name = m.column_name)"""


def reviewed(spark, sf):
    decisions = table(spark, sf, "part").selectExpr(*DECISIONS)
    return S.review_mappings(base.mappings(spark, sf), S.concepts(spark), decisions)


@query("E7_reviewed_mappings", f"""
select table_name, column_name, case when action = 'correct' then new_concept else concept end
  as concept, confidence, rationale,
  case action when 'validate' then 'validated' when 'reject' then 'rejected'
    when 'correct' then 'corrected' else status end as status,
  case when action in ('validate', 'correct') then false else needs_arbitration end
  as needs_arbitration
from {DECIDED_SQL}
""")
def _(spark, sf):
    return reviewed(spark, sf)[0]


@query("E7_enriched_concepts", f"""
select coalesce(l.concept, t.concept) as concept, word
from (select concept, unnest(synonyms) as word from {base.LEXICON_SQL}) l
full join (select distinct new_concept as concept, lower(column_name) as word
  from {DECIDED_SQL} where action = 'correct') t using (concept, word)
""")
def _(spark, sf):
    return reviewed(spark, sf)[1].select("concept", F.explode("synonyms").alias("word"))


VALID_SQL = f"(select * from {base.MAPPINGS_SQL} where status in ('validated', 'corrected'))"


@query("E8_dictionary_concepts", f"""
select distinct concept, table_name, column_name from {VALID_SQL}
""")
def _(spark, sf):
    by_concept, _ = S.dictionary(base.mappings(spark, sf), S.concepts(spark))
    return by_concept


@query("E8_dictionary_tables", f"""
select table_name, word from (
  select table_name, lower(concept) as word from {VALID_SQL}
  union select table_name, lower(w) from (
    select table_name, unnest(synonyms) as w from {VALID_SQL} v
    join {base.LEXICON_SQL} on lexicon.concept = v.concept))
""")
def _(spark, sf):
    _, by_table = S.dictionary(base.mappings(spark, sf), S.concepts(spark))
    return by_table


# Corrections with their dates; the same names are corrected again and again.
DATED = ["lower(p_type) as table_name", "concat('Col_', cast(p_size as string)) as column_name",
         "case p_partkey % 4 when 0 then 'validate' else 'correct' end as action",
         "case p_partkey % 3 when 0 then 'Magasin' when 1 then 'Contrat' else 'Montant' end "
         "as new_concept",
         "cast(date '2024-01-01' + cast(p_partkey * 7 % 400 as int) as date) as decided_at"]
HISTORY_OF_WORDS_SQL = f"""(
with t as (select lower(column_name) as word, decided_at, max(new_concept) as concept
  from (select {', '.join(DATED)} from part) where action = 'correct' group by 1, 2),
c as (select *, lag(concept) over (partition by word order by decided_at) as before from t)
select concept, word, decided_at as valid_from,
  lead(decided_at) over (partition by word order by decided_at) as valid_to
from c where concept is distinct from before
union all select concept, unnest(synonyms), null, null from {base.LEXICON_SQL})"""
MOMENT = "2024-07-01"
WORDS_AS_OF_SQL = f"""(select distinct concept, word from {HISTORY_OF_WORDS_SQL}
where (valid_from is null or valid_from <= date '{MOMENT}')
  and (valid_to is null or valid_to > date '{MOMENT}'))"""


def words_through_time(spark, sf):
    return S.synonym_history(S.concepts(spark), table(spark, sf, "part").selectExpr(*DATED))


@query("E7_synonyms_through_time", f"select * from {HISTORY_OF_WORDS_SQL}")
def _(spark, sf):
    return words_through_time(spark, sf)


@query("E8_words_as_of", f"""
select distinct table_name, lower(concept) as word from {VALID_SQL}
union select table_name, lower(w.word) from {VALID_SQL} v
  join {WORDS_AS_OF_SQL} w on w.concept = v.concept
""")
def _(spark, sf):
    return S.words_as_of(base.mappings(spark, sf), words_through_time(spark, sf),
                         F.lit(MOMENT).cast("date"))


@query("E9_measure_arbitration", f"""
select 'amounts' as table_name, c as column_name, basis, rec as recommended, cho as chosen,
  (select count(*) from lineitem) as n_rows
from (values ('net_price', 'net', false, true), ('amount_ttc', 'gross', true, false))
  as x(c, basis, rec, cho)
""")
def _(spark, sf):
    known = {"amounts": base.amounts(spark, sf), "part": table(spark, sf, "part")}
    keys = catalog.unique_keys(tables(spark, sf, ["part"]))
    sizes, columns = catalog.build_catalog(known, keys)
    return S.arbitrate_measures(columns, convention="net").join(
        sizes.select("table_name", "n_rows"), "table_name")

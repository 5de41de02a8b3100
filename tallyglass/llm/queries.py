"""The operators as queries over the whole test tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyglass.llm import (
    bpe, contamination, lexical, minhash, pii, ppm, repeats, secrets, simhash, toxicity, urls,
    vptree, whitening,
)
from tallyglass.llm.common import held_out, table

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir), with its SQL if there is any."""
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return register


@query("op5_simhash_golay")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def tokenizer(spark: SparkSession, name: str = "byte_bpe_50k.tiktoken"):
    """Ranks and pattern of a public tokenizer; its file's place is a parameter."""
    import public_tokenizers

    return bpe.read_ranks(spark, public_tokenizers.path(name)), public_tokenizers.PATTERN


#: The pattern of the public tokenizers begins a piece at a space between two visible characters, and
#: a space with nothing but letters after it is one piece.
CUTS, ONE_PIECE = bpe.SINGLE_SPACES, r"^\p{L}+$"


@query("op9_bpe_monoid")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = tokenizer(spark)
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks, pattern, cuts=CUTS,
                          one_piece=ONE_PIECE).select(
        "doc_id", F.expr("length(token_ids) div 4").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op2_secrets_ownership")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("repository", F.concat_ws(
        "/", "source", "lang"))
    found = secrets.scan(docs, repository="repository")

    def number(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    live = F.size(F.filter("spans", lambda s: secrets.looks_live(s))).cast("long")
    return found.select(
        "doc_id", *[number(k).alias(f"n_{k}") for k, *_ in secrets.BASE],
        F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"), live.alias("n_live"))


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]
LISTED_HOSTS = r"(^|[.-])(casino|bets|pills)([.-]|$)"


@query("op8_urls_blocked_bloom", """
with h as (
  select page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages),
c as (
  select *, regexp_replace(regexp_replace(host, '^(?:www|m)\\.', ''), ':(?:80|443)?$', '')
    || regexp_replace(regexp_replace(path, '/index\\.html?$|\\.html?$', ''), '/+$', '') as canonical
  from h),
l as (
  select distinct canonical from c
  where canonical <> '' and regexp_matches(host, '(^|[.-])(casino|bets|pills)([.-]|$)')),
r(verdict, name, start) as (
  values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
    ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
j as (
  select c.*, l.canonical is not null as listed,
    (select max_by({'rule': name || start, 'verdict': verdict}, length(name || start)) from r
     where (host = name or ends_with(host, '.' || name)) and starts_with(path, start)) as fit
  from c left join l using (canonical))
select page_id, host, path, fit.rule as rule,
  coalesce(fit.verdict, case when listed then 'block' else 'allow' end) as verdict, listed
from j""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    name, page = urls.host(F.col("url")), urls.path(F.col("url"))
    listed = pages.where(F.regexp_like(name, F.lit(LISTED_HOSTS))).select(
        urls.canonical(name, page).alias("canonical"))
    return urls.judge(pages, listed, RULES)


@query("op6_nearest_vptree")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vptree.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> dict:
    """Learned only from documents whose crc32 of the id leaves a remainder by 5."""
    return toxicity.fit(docs, labels.where(~held_out("doc_id", 5)))


@query("op10_toxicity_gru")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", held_out("doc_id", 5).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op7_contamination_cgk")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", (F.size("found") > 0).alias("contaminated"),
        F.transform("found", lambda x: x["item"]).alias("item_ids"),
        F.array_min(F.transform("found", lambda x: x["distance"])).alias("least_distance"))


@query("op3_repeats_difference_cover")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_scores_ppm")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


@query("op1_pii_feistel")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents"), "a key for the test tables")


@query("op11_minhash_tensored")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op12_search_aho_corasick", r"""
with d as (
  select doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: t <> '') as terms
  from documents),
i as (
  select item_id, unnest(list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: t <> '')) as term
  from benchmark),
asked as (select item_id, term, count(*) as repeats from i group by all),
whole as (
  select count(*) filter (len(terms) > 0) as docs, cast(sum(len(terms)) as bigint) as terms from d),
tf as (
  select doc_id, n, term, count(*) as tf
  from (select doc_id, len(terms) as n, unnest(terms) as term from d)
  where term in (select term from asked) group by all),
df as (select term, count(*) as df from tf group by term),
scored as (
  select item_id, doc_id, cast(sum(
    repeats * cast(floor(1000 * ln((2 * docs + 2) / cast(2 * df + 1 as double))) as bigint)
    * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // whole.terms)))) as bigint)
    as score
  from tf join df using (term) join asked using (term) cross join whole
  group by all)
select item_id, cast(row_number() over w as int) as rank, doc_id, score
from scored where score > 0
window w as (partition by item_id order by score desc, doc_id)
qualify row_number() over w <= 20""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_whitening_cholesky_jacobi")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))

"""Secret scan: patterns find candidates, and how widely the corpus shares each decides on it.

Candidates of all texts are hashed, and each hash is counted by distinct repositories and owners.
A value that many owners carry in many repositories is an example that was copied about; one that
stays with few owners, or in one repository under several owners (a fork), looks like a live
credential. Base patterns are always reported. Opaque tokens (long runs of
mixed letters and digits), which alone would be too vague, are reported only where they look live.
So are private keys: a key is its whole block up to the END line, or without one the lines of base64
that follow, and what is counted is its body without line breaks.
Only DataFrame functions are used. Counting sums before it shuffles, and the counts of values that
occur in very many places are broadcast where their number allows, so rows never gather at a value
that a third of them hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyglass.llm.common import prepare
from tallyglass.llm.spans import matches, placed, replaced

#: Kind, pattern, group that is the secret, least length of it; base kinds in order.
KEYWORDS = ("[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
            "|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]")
BASE = (
    ("assign", f"({KEYWORDS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", "AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", "(?<![0-9a-f])[0-9a-f]{16,}", 0, 16),
)
#: Of a private key's block. Repeated groups are possessive: these need no stack in Java.
END = "-----END [A-Z ]{0,40}PRIVATE KEY-----"
BREAK = r"(?:\s|\\[nr])"
BODY = (rf"(?:[^-]++|-(?!----))*+(?={END})"
        rf"|(?:{BREAK}{{1,8}}+(?:Proc-Type|DEK-Info):[^\r\n\\]{{0,200}}+)*+"
        rf"(?:{BREAK}{{0,8}}+[A-Za-z0-9+/]{{16,}}+={{0,2}}+)*+"
        rf"(?:{BREAK}{{1,8}}+[A-Za-z0-9+/]{{1,15}}+(?:={{1,2}}+|(?<=[\r\n][A-Za-z0-9+/]{{1,15}})"
        r"(?=[\r\n]|\z)))?+")
ADDED = (
    ("pem", f"-----BEGIN [A-Z ]{{0,40}}PRIVATE KEY-----({BODY})(?:{END})?", 1, 1),
    ("opaque", "(?<![A-Za-z0-9_-])(?=[A-Za-z_-]{0,200}[0-9])(?=[0-9_-]{0,200}[A-Za-z])"
               "[A-Za-z0-9_-]{20,}", 0, 20),
)
COPIED_OWNERS = COPIED_REPOSITORIES = 3
HOT_PLACES, MOST_HOT = 1000, 100_000
MARK = "<secret>"


def _text() -> Column:
    return F.coalesce(F.col("__text"), F.lit(""))


def _long_enough(spans: Column, least: int) -> Column:
    return F.filter(spans, lambda s: F.char_length(s["value"]) >= least)


def _value(kind: str, match: Column, group: Column) -> Column:
    """What counts of a match: its group; of a key, the body without breaks, or a lone header."""
    if kind != "pem":
        return group
    body = F.regexp_replace(group, BREAK, "")
    return F.when(body == "", match).otherwise(body)


def _values(kind: str, found: Column, groups: Column) -> Column:
    return F.zip_with(found, groups, lambda m, g: _value(kind, m, g))


def candidates(docs: DataFrame, keep: tuple, owner: str, repository: str, text: str) -> DataFrame:
    """The kept columns, owner, repository, the text where there are candidates, and their spans."""
    out = docs.select(*keep, F.col(owner).cast("string").alias("__owner"),
                      F.col(repository).cast("string").alias("__repo"),
                      F.col(text).cast("string").alias("__text"))
    kinds = (*BASE, *ADDED)
    out = out.select("*", *[matches(_text(), p).alias(f"__m_{k}") for k, p, _, _ in kinds])
    spans = {}
    for rank, (kind, pattern, group, least) in enumerate(kinds):
        found = F.col(f"__m_{kind}")
        values = F.when(F.size(found) > 0, _values(
            kind, found, matches(_text(), pattern, group))) if group else found
        spans[kind] = _long_enough(placed(_text(), pattern, found, values, kind, rank), least)
    return out.select(
        *keep, "__owner", "__repo", "__text",
        F.array_sort(F.concat(*[spans[k] for k, *_ in BASE])).alias("__base"),
        F.array_sort(F.concat(*[spans[k] for k, *_ in ADDED])).alias("__added"))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repositories, n_places) of each candidate value in the whole corpus."""
    return found.select("__owner", "__repo", F.explode(F.concat("__base", "__added")).alias("s")
                        ).groupBy(F.sha2("s.value", 256).alias("hash")).agg(
        F.countDistinct("__owner").alias("n_owners"),
        F.countDistinct("__repo").alias("n_repositories"), F.count("*").alias("n_places"))


def _counted(hashes: DataFrame, counts: DataFrame) -> DataFrame:
    """Each (__key, hash) with the hash's counts. A hash of more than HOT_PLACES places, of which there
    are few, is not gathered: up to MOST_HOT of them are broadcast."""
    counts = counts.checkpoint()
    hot = counts.where(F.col("n_places") > HOT_PLACES)
    if not 0 < hot.count() <= MOST_HOT:
        return hashes.join(counts, "hash")
    rare = counts.where(F.col("n_places") <= HOT_PLACES)
    return hashes.join(F.broadcast(hot), "hash").unionByName(
        hashes.join(F.broadcast(hot.select("hash")), "hash", "left_anti").join(rare, "hash"))


def looks_live(span: Column, copied: int = COPIED_OWNERS,
               repositories: int = COPIED_REPOSITORIES) -> Column:
    """Whether few owners, or few repositories, hold the value of a span of a scanned row."""
    seen = F.element_at("owners", F.sha2(span["value"], 256))
    within = F.element_at("repositories", F.sha2(span["value"], 256))
    return (seen < copied) | (within < repositories)


def scan(docs: DataFrame, keep: tuple = ("doc_id",), owner: str = "source",
         repository: str = "source", text: str = "text", copied: int = COPIED_OWNERS,
         copied_repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """One row per row of docs: the kept columns, base and spans (arrays of start, rank, stop, kind,
    value), owners and repositories (maps from a value's hash to its numbers of distinct ones), and,
    where there are candidates, __text.

    Null texts are empty and have empty arrays. Null owners and repositories count as none. Repeated
    rows stay. An empty table gives no rows. Columns of docs other than those named are not read.
    """
    prepare(docs.sparkSession)
    found = candidates(docs, keep, owner, repository, text).withColumn(
        "__key", F.when(F.size("__base") + F.size("__added") > 0, F.sha2(
            F.to_json(F.struct(F.struct(*keep).alias("k"), "__base", "__added")), 256))).withColumn(
        "__text", F.when(F.col("__key").isNotNull(), F.col("__text"))).checkpoint()
    held = found.where("__key is not null")
    hashes = held.select("__key", F.explode(F.array_distinct(F.transform(
        F.concat("__base", "__added"), lambda s: F.sha2(s["value"], 256)))).alias("hash")).distinct()
    owners = _counted(hashes, ownership(held)).groupBy("__key").agg(*[F.map_from_entries(
        F.collect_list(F.struct("hash", f"n_{name}"))).alias(name)
        for name in ("owners", "repositories")])
    nothing = F.expr("cast(map() as map<string,bigint>)")
    joined = held.join(owners, "__key", "left").unionByName(found.where("__key is null").withColumns(
        {"owners": nothing, "repositories": nothing}))

    def live(s):
        return looks_live(s, copied, copied_repositories)

    def apart(s, keys):
        within = F.exists(keys, lambda k: (k["start"] <= s["start"]) & (s["stop"] <= k["stop"]))
        return (s["kind"] == "pem") | ~within & ~F.exists(
            "__base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))

    added = F.flatten(F.transform(  # the keys of a text are filtered out once, not for each span
        F.array(F.filter("__added", lambda s: s["kind"] == "pem")),
        lambda keys: F.filter("__added", lambda s: live(s) & apart(s, keys))))
    return joined.select(*keep, F.col("__text"), F.col("__base").alias("base"),
                         F.array_sort(F.concat("__base", added)).alias("spans"), "owners",
                         "repositories")


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"],
                                                                 s["stop"])), ",")


def redact(scanned: DataFrame, copied: int = COPIED_OWNERS,
           copied_repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """Scanned rows with every live-looking secret of __text replaced; copied examples stay.

    Kinds are replaced one after the other, each in a projection of its own, so that the
    expressions do not grow into one another. Private keys come first, as other kinds may lie in
    them. Rows without such secrets are left alone.
    """
    for kind, pattern, group, _ in (ADDED[0], *BASE, *ADDED[1:]):
        live = F.transform(F.filter("spans", _is_live(kind, copied, copied_repositories)),
                           lambda s: s["value"])
        out = scanned.withColumn("__live", live).withColumn(
            "__hits", F.when(F.size("__live") > 0, matches(_text(), pattern)))
        text = replaced(_text(), pattern, F.col("__hits"), _marked(kind, pattern, group))
        scanned = out.withColumn(
            "__text", F.when(F.size("__live") > 0, text).otherwise(F.col("__text"))
        ).drop("__live", "__hits")
    return scanned


def _is_live(kind: str, copied: int, repositories: int):
    return lambda s: (s["kind"] == kind) & looks_live(s, copied, repositories)


def _marked(kind: str, pattern: str, group: int):
    def change(m):
        value = _value(kind, m, F.regexp_extract(m, pattern, group)) if group else m
        return F.when(F.array_contains("__live", value), F.lit(MARK)).otherwise(m)
    return change

"""URL verdicts: host and path rules first, then a list of canonical URLs behind a Bloom filter.

The filter is blocked: a hash chooses one block of eight words of 32 bits, and five more bits of it each set
one bit in a word.
Blocks are built by bitwise-or sums and joined to the pages; where the filter is small enough by its
counted size, it is broadcast. Pages that may be listed go to an exact join with the list, which
removes the false positives; all others never meet the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WORDS = 8
KEYS_IN_BLOCK = 16
BROADCAST_BYTES = 64 << 20
BLOCK_BYTES = 72


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end; A-Z in lower case; else empty."""
    return _lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; empty without `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def canonical(host_: Column, path_: Column) -> Column:
    """One spelling for a page: no `www.` or `m.`, no port 80 or 443, no index page, `.html` or
    closing slashes; query and fragment are gone already."""
    name = F.regexp_replace(F.regexp_replace(host_, r"^(?:www|m)\.", ""), r":(?:80|443)?$", "")
    page = F.regexp_replace(F.regexp_replace(path_, r"/index\.html?$|\.html?$", ""), r"/+$", "")
    return F.concat(name, page)


def rule_of(host_: Column, path_: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest of (verdict, host, path) that fits, or null.

    A rule fits its host and all subdomains, if the path begins with the rule's.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host_ == name) | F.endswith(host_, F.lit("." + name))) & F.startswith(
            path_, F.lit(start))
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"),
                                    F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _bits(key: Column) -> list[Column]:
    """For each word of a block, the bit that a key sets there."""
    h = F.xxhash64(key)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 5 * i).bitwiseAND(
        F.lit(31).cast("long")).cast("int")) for i in range(WORDS)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), key), F.lit(blocks))


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, words) of a filter over the column `canonical`; blocks without a key are absent."""
    bits = [b.alias(f"b{i}") for i, b in enumerate(_bits(F.col("canonical")))]
    return listed.select(_block(F.col("canonical"), blocks).alias("block"), *bits).groupBy(
        "block").agg(F.array(*[F.bit_or(f"b{i}") for i in range(WORDS)]).alias("words"))


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]],
          page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of every row of pages.

    listed has the column `canonical`; repeats and nulls in it are harmless, and it may be empty.
    Null URLs and those without `://` have an empty host and path, and are allowed. Repeated pages
    stay. Other columns of either table are not read.
    """
    listed = listed.select("canonical").where("canonical != ''").distinct()
    blocks = max(1, listed.count() // KEYS_IN_BLOCK)
    pages = pages.select(F.col(page_id).alias("page_id"), host(F.col(url)).alias("host"),
                         path(F.col(url)).alias("path"))
    pages = pages.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("fit"),
                         canonical(F.col("host"), F.col("path")).alias("canonical"))
    words = bloom(listed, blocks)
    if blocks * BLOCK_BYTES <= BROADCAST_BYTES:
        words = F.broadcast(words)
    may = F.lit(True)
    for i, bit in enumerate(_bits(F.col("canonical"))):
        may = may & (F.get("words", F.lit(i)).bitwiseAND(bit) != 0)
    tested = pages.withColumn("block", _block(F.col("canonical"), blocks)).join(
        words, "block", "left").withColumn("may", F.coalesce(may, F.lit(False)))
    hits = tested.where("may").join(listed.withColumn("is_listed", F.lit(True)), "canonical", "left")
    rest = tested.where("not may").withColumn("is_listed", F.lit(False))
    both = hits.select(*(names := ["page_id", "host", "path", "fit", "is_listed"])).union(
        rest.select(*names))
    found = F.coalesce("is_listed", F.lit(False))
    return both.select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.when(found, "block").otherwise("allow")).alias("verdict"),
        found.alias("listed"))

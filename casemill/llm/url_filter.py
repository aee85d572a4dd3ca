"""URL filter (operator 1): a blocked Bloom filter lets possible hits through to an exact hash join.

Defined results: a null url, or one without "://", has an empty host and path, no canonical
form, and is never listed. Repeated rows are judged alike, each on its own. An empty list
blocks nothing; an empty table gives no rows. Further columns of `pages` aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small

#: Words of 32 bits in a block; one bit of each word is set for a key.
WORDS = 8
BITS_PER_KEY = 12
#: Blocks that may be broadcast: 2**18 blocks hold 8 MB of bits, for about 5.6 million urls.
MOST_BLOCKS = 1 << 18


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(verdict, host, slash + path)


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end; only A-Z become lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """host without www. and default ports, path without closing slashes, sorted parameters
    without tracking ones; no scheme, no fragment. Null if the url has no "://"."""
    host = F.regexp_replace(host_of(url), r"^www\.|:(?:80|443)$", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    wanted = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(?:utm_[^=]*|ref|gclid|fbclid)(?:=|$)")))
    tail = F.when(F.size(wanted) > 0, F.concat(F.lit("?"), F.array_join(wanted, "&"))).otherwise("")
    return F.when(url.contains("://"), F.concat(host, path, tail))


def rule_column(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule's text, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(rule.text)).otherwise(out)
    return out


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks).cast("long"))


def _bits(key: Column) -> list[Column]:
    second = F.xxhash64(key, F.lit("bits"))
    one = F.lit(1).cast("long")
    return [F.call_function("shiftleft", one, F.shiftright(second, 5 * i).bitwiseAND(F.lit(31)).cast("int")) for i in range(WORDS)]


def bloom_blocks(listed: DataFrame, key: str, n_keys: int, bits_per_key: int = BITS_PER_KEY) -> tuple[DataFrame, int]:
    """One row (block, w0..w7) for each block in use, and the number of blocks."""
    n_blocks = max(1, -(-n_keys * bits_per_key // (32 * WORDS)))
    rows = listed.select(_block(F.col(key), n_blocks).alias("block"), *(b.alias(f"w{i}") for i, b in enumerate(_bits(F.col(key)))))
    return rows.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS))), n_blocks


def hit_in_block(key: Column, n_blocks: int, prefix: str = "") -> Column:
    """Whether a row of bloom_blocks, its columns' names prefixed, is the key's, with all its bits."""
    hit = _block(key, n_blocks) == F.col(f"{prefix}block")
    for i, bit in enumerate(_bits(key)):
        hit = hit & (F.col(f"{prefix}w{i}").bitwiseAND(bit) == bit)
    return hit


def possible_hits(rows: DataFrame, key: str, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """The rows whose key may be listed. The filter is broadcast while it has at most
    MOST_BLOCKS blocks; a larger one meets the distinct keys by a shuffle on the block."""
    probe = rows.filter(F.col(key).isNotNull())
    return probe.join(small(blocks, n_blocks, MOST_BLOCKS), hit_in_block(F.col(key), n_blocks), "left_semi").select(*rows.columns)


def listed_pages(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """Distinct (page_id, url) of pages whose canonical url is in listed(canonical)."""
    urls = listed.select(F.col("canonical").alias("listed")).filter("listed is not null").distinct()
    blocks, n_blocks = bloom_blocks(urls, "listed", urls.count())
    keyed = pages.select("page_id", "url", canonical(F.col("url")).alias("canonical"))
    hits = possible_hits(keyed, "canonical", blocks, n_blocks)
    return hits.join(urls, F.col("canonical") == F.col("listed"), "left_semi").select("page_id", "url").distinct()


def judge(pages: DataFrame, listed: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict, listed for every page.

    The exact join's result meets the pages again by (page_id, url), null-safe on both.
    """
    url = F.col("url")
    found = listed_pages(pages, listed).select(F.col("page_id").alias("__id"), F.col("url").alias("__url"), F.lit(True).alias("__listed"))
    base = pages.select("page_id", "url")
    joined = base.join(found, base.page_id.eqNullSafe(F.col("__id")) & (base.url == F.col("__url")), "left")
    own = {r.text: r.verdict for r in rules}
    rule = rule_column(F.col("host"), F.col("path"), rules)
    by_rule = F.lit(None).cast("string")
    for text, verdict in own.items():
        by_rule = F.when(F.col("rule") == text, F.lit(verdict)).otherwise(by_rule)
    return (
        joined.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.coalesce("__listed", F.lit(False)).alias("listed"))
        .withColumn("rule", rule)
        .withColumn("verdict", F.coalesce(by_rule, F.when(F.col("listed"), "block").otherwise("allow")))
        .select("page_id", "host", "path", "rule", "verdict", "listed")
    )

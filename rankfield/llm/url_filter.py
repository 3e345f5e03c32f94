"""URL filter: longest host/path rule, then a blocked Bloom filter over a list.

The list's canonical URLs are folded into a blocked Bloom filter (256-bit blocks
of four 64-bit words, eight bits a key). Pages without a rule are tested against
it; the few possible hits go through an exact join with the list, so false positives
never reach the verdict. That join hashes a broadcast list while the list is counted to
be small, and sorts both sides, which may spill, beyond that. Pages are read once.

Defined results: a null URL, or one without ``://``, has an empty host and path,
matches no rule and is never listed. Null or repeated list entries are ignored.
Repeated pages are judged each. Extra columns are kept out of the way: the result
holds the key column and the verdict columns only.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfield.llm.common import cut, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 4


def url_host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """Scheme, fragment, ``www.``/``m.``, port, trailing slash or ``.html`` and
    tracking parameters go; the other parameters are sorted. Null if no host."""
    host = F.regexp_replace(F.regexp_replace(url_host(url), r"^(www|m)\.", ""), r":\d+$", "")
    path = F.regexp_replace(url_path(url), r"(\.html?|/+)$", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[^=]*|ref)(=|$)")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(host == "", F.lit(None).cast("string")).otherwise(F.concat(host, path, tail))


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; both null where none does.

    ``rules`` holds (verdict, host, path). Equal lengths: longer host, then block.
    """
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block"))
    rule = verdict = F.lit(None).cast("string")
    for said, rule_host, rule_path in reversed(ranked):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _probe(url: Column, n_blocks: int) -> list[Column]:
    """Block number and the bit mask of each word for one canonical URL."""
    place, bits = F.xxhash64(url), F.xxhash64(url, F.lit("bits"))

    def bit(i: int) -> Column:
        place_in_word = F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        return F.call_function("shiftleft", F.lit(1).cast("long"), place_in_word)

    masks = [bit(2 * w).bitwiseOR(bit(2 * w + 1)).alias(f"_mask{w}") for w in range(WORDS)]
    return [F.pmod(place, F.lit(n_blocks).cast("long")).alias("_block"), *masks]


def bloom_blocks(listed: DataFrame, n_blocks: int) -> DataFrame:
    """The filter as a table: one row for each block that has a bit set."""
    probes = listed.select(*_probe(F.col("_url"), n_blocks))
    return probes.groupBy("_block").agg(*[F.bit_or(f"_mask{w}").alias(f"_word{w}") for w in range(WORDS)])


def filter_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    key: str = "page_id",
    url: str = "url",
    listed_url: str = "url",
    bits_per_key: int = 16,
    broadcast_bytes: int = 32 << 20,
) -> DataFrame:
    """Judge every page: key, host, path, rule, verdict, listed.

    The filter (blocks x 40 bytes) and the list are each broadcast only while their
    counted size is at most ``broadcast_bytes``; else they are joined by sorting.
    """
    names = stored(listed.select(canonical_url(listed[listed_url]).alias("_url")).where("_url is not null").distinct(), "listed-urls")
    size = names.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("_url") + 32), F.lit(0)).alias("bytes")).first()
    n_blocks = max(1, -(-size.n * bits_per_key // 256))
    fits = lambda n: "broadcast" if n <= broadcast_bytes else "merge"
    blocks = cut(bloom_blocks(names, n_blocks)).hint(fits(n_blocks * 40))

    host, path = url_host(pages[url]), url_path(pages[url])
    rule, said = best_rule(host, path, rules)
    judged = pages.select(pages[key].alias(key), host.alias("host"), path.alias("path"), rule.alias("rule"), said.alias("_said"), canonical_url(pages[url]).alias("_url"))
    probed = judged.select("*", *_probe(F.col("_url"), n_blocks)).join(blocks, "_block", "left")
    passes = F.col("rule").isNull() & F.col("_url").isNotNull()
    for w in range(WORDS):
        passes = passes & (F.col(f"_word{w}").bitwiseAND(F.col(f"_mask{w}")) == F.col(f"_mask{w}"))
    probed = stored(probed.select(key, "host", "path", "rule", "_said", F.when(F.coalesce(passes, F.lit(False)), F.col("_url")).alias("_maybe")), "probed-pages")
    columns = [key, "host", "path", "rule"]
    missed = probed.where("_maybe is null").select(*columns, F.coalesce("_said", F.lit("allow")).alias("verdict"), F.lit(False).alias("listed"))
    exact = names.select(F.col("_url").alias("_maybe"), F.lit(True).alias("_listed")).hint(fits(size.bytes))
    found = F.coalesce("_listed", F.lit(False))
    hits = probed.where("_maybe is not null").join(exact, "_maybe", "left").select(*columns, F.when(found, "block").otherwise("allow").alias("verdict"), found.alias("listed"))
    return missed.unionByName(hits)

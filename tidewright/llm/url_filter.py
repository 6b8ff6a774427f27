"""URL rules behind a blocked Bloom filter, in DataFrame functions only.

The listed canonical URLs (host followed by path) fill a filter of 512-bit
blocks, eight words with one bit each.  A URL's candidates, one for each shape
(number of host labels, path length) that the list has, are tested against it;
possible hits alone meet the list in an equi-join on the exact string, which
removes false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS_PER_BLOCK = 8
BITS_PER_URL = 16
MAX_BLOCKS = 1 << 15

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def canonical_host(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*", 0), _UPPER, _UPPER.lower())


def canonical_path(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*([^?#]*)", 1)


def _place(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block of a key, and for each word of the block the mask of its bit."""
    h = F.xxhash64(key)
    masks = [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(h, F.lit(j)), F.lit(64)).cast("int")) for j in range(WORDS_PER_BLOCK)]
    return F.pmod(h, F.lit(blocks)).cast("int"), masks


def bloom_words(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """One row with all words of the filter; at most MAX_BLOCKS * 512 bits."""
    block, masks = _place(F.col(key), blocks)
    set_words = (
        keys.select(F.posexplode(F.array(*masks)).alias("j", "mask"), block.alias("block"))
        .groupBy((F.col("block") * WORDS_PER_BLOCK + F.col("j")).alias("at"))
        .agg(F.bit_or("mask").alias("word"))
    )
    slots = keys.sparkSession.range(blocks * WORDS_PER_BLOCK).select(F.col("id").cast("int").alias("at"))
    full = slots.join(set_words, "at", "left").select(F.struct("at", F.coalesce("word", F.lit(0).cast("long")).alias("word")).alias("s"))
    return full.agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["word"]).alias("words"))


def _might_hold(words: Column, key: Column, blocks: int) -> Column:
    block, masks = _place(key, blocks)
    tests = [F.get(words, block * WORDS_PER_BLOCK + j).bitwiseAND(mask) != 0 for j, mask in enumerate(masks)]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict.

    ``rules`` has host, path (a leading slash included) and action.  A rule fits
    its host and every subdomain if the URL's path starts with the rule's; the
    longest rule (host and path together, then host) wins, and ``block`` wins
    over ``allow`` for one URL listed as both.  URLs without a rule are allowed,
    as a list filter passes what it does not hold.  A null URL, or one without
    ``://``, has an empty host and path.  Repeated rows and null ids are judged
    row by row; other columns are not read; empty tables give empty results.
    """
    listed = (
        rules.filter("host is not null and path is not null")
        .groupBy(F.concat("host", "path").alias("key"))
        .agg(F.first("host").alias("h"), F.first("path").alias("p"), F.max("action").alias("action"))
    )
    # Path lengths by number of host labels: bounded by the longest listed URL, not by the list, and read as one row.
    shapes = listed.groupBy(F.size(F.split("h", r"\.")).alias("labels")).agg(F.collect_set(F.length("p")).alias("lengths"))
    shapes = shapes.agg(F.map_from_entries(F.collect_list(F.struct("labels", "lengths"))).alias("shapes")).scalar()
    blocks = min(MAX_BLOCKS, max(1, -(-listed.count() * BITS_PER_URL // (64 * WORDS_PER_BLOCK))))
    words = bloom_words(listed, "key", blocks).scalar()

    host, path = F.col("host"), F.col("path")
    end = lambda labels: F.array_join(F.slice("parts", F.size("parts") - labels + 1, labels), ".")
    fitting = lambda labels: F.filter(F.element_at("shapes", labels), lambda n: n <= F.length(path))
    made = lambda labels: F.transform(fitting(labels), lambda n: F.concat(end(labels), F.substring(path, F.lit(1), n)))
    base = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), canonical_host(F.col(url_col)).alias("host"), canonical_path(F.col(url_col)).alias("path"))
    cut = base.withColumns({"parts": F.split("host", r"\."), "shapes": shapes, "words": words})
    candidates = F.flatten(F.transform(F.filter(F.map_keys("shapes"), lambda labels: labels <= F.size("parts")), made))
    tested = cut.withColumn("possible", F.filter(candidates, lambda k: _might_hold(F.col("words"), k, blocks))).drop("words", "shapes", "parts")
    hits = tested.select("row", "id", "host", "path", F.explode_outer("possible").alias("key")).join(listed, "key", "left")
    best = F.max_by(F.struct("key", "action"), F.when(F.col("action").isNotNull(), F.struct(F.length("key"), F.length("h"))))
    return (
        hits.groupBy("row", "id", "host", "path")
        .agg(best.alias("best"))
        .select(F.col("id").alias(id_col), "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.action", F.lit("allow")).alias("verdict"))
    )

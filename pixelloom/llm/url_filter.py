"""URL filters: a blocked Bloom filter of the listed entries, then an exact hash join. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm.common import free_name, join_groups, others, store

#: Bits of the Bloom filter for each listed key (false positives: about 0.2 %), and words of 32 bits in a block: each key sets a bit in each word.
BITS_PER_KEY, WORDS = 16, 8
#: Largest filter to broadcast; a larger one is joined by a shuffle on the block.
BROADCAST_BYTES = 32 << 20
#: Bytes that a row of a broadcast table takes beside its strings, about.
ROW_BYTES = 64


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased; empty for null or without ://."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(entry, action) rows of a short list; an entry is a host and a path, like example.net/en/."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(e).alias("entry"), F.lit(a).alias("action")) for e, a in rules])))


def _keyed(rules: DataFrame) -> DataFrame:
    """Rules with host, path and the key (host, directory of the path) under which they are listed; one row for an entry, block before allow."""
    host = F.translate(F.regexp_extract("entry", "^([^/]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract("entry", "(?s)^[^/]*(.*)", 1)
    return (
        rules.where("entry is not null and action is not null").groupBy("entry").agg(F.max("action").alias("action"))
        .select("entry", "action", host.alias("r_host"), path.alias("r_path")).where("r_host <> ''")
        .withColumn("r_dir", F.regexp_extract("r_path", "(?s)^(.*/)?", 0))
    )


def _key(host: Column, at: Column) -> Column:
    return F.concat(host, F.lit("\n"), at)


def _mask(key: Column, i: int) -> Column:
    """The bit that a key sets in word i."""
    return F.call_function("shiftleft", F.lit(1), F.pmod(F.xxhash64(key, F.lit(i)), F.lit(32)).cast("int"))


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """Blocked Bloom filter of the column key: (block, w0 .. w7), one row for each block with a bit set."""
    aggs = [F.bit_or(_mask(F.col("key"), i)).alias(f"w{i}") for i in range(WORDS)]
    return keys.groupBy(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block")).agg(*aggs)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """pages plus host, path, rule and verdict.

    A rule fits its host and all subdomains if the url's path starts with the rule's path. Of the rules that fit, the one with the longest
    host + path wins (then the longer host). No rule: null, and verdict default. Null urls and urls without :// have empty host and path, and
    no rule fits. Repeated pages are each judged; any other columns are kept as they are, and those named as a result's, in any case, are
    replaced (the url's own too, if it has such a name). Very long urls are read whole. Empty tables of pages or rules are fine.

    Each distinct (host, path) yields keys (suffix of the host, directory of the path), no longer than the longest listed. The Bloom filter
    drops nearly all keys that are not listed, the hash join on the key the rest; then the path's beginning is compared.
    """
    listed = _keyed(rules)
    n, labels, depth, size = listed.agg(
        F.count("*"), F.max(F.size(F.split("r_host", r"\."))), F.max(F.length("r_dir") - F.length(F.replace("r_dir", F.lit("/")))), F.sum(2 * F.octet_length("entry") + ROW_BYTES)
    ).first()
    keep = others(pages, ["host", "path", "rule", "verdict"])
    address = free_name(keep, "address")
    read = pages.withColumn(address, F.col(url)).select(*keep, host_of(F.col(address)).alias("host"), path_of(F.col(address)).alias("path"))
    if not n:
        return read.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    blocks = max(1, -(-n * BITS_PER_KEY // (32 * WORDS)))
    keys = listed.select(_key(F.col("r_host"), F.col("r_dir")).alias("key")).distinct()
    words = bloom(keys, blocks)
    if blocks * (8 + 4 * WORDS) <= BROADCAST_BYTES:
        words = F.broadcast(words)
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."))
    steps = F.split("path", "/")
    dirs = F.transform(
        F.sequence(F.lit(0), F.least(F.size(steps) - 1, F.lit(depth))),
        lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(steps, 1, k), "/"), F.lit("/"))),
    )
    asked = (
        read.where("host <> ''").select("host", "path").distinct()
        .select("host", "path", F.explode(suffixes).alias("suffix"), dirs.alias("dirs"))
        .select("host", "path", "suffix", F.explode("dirs").alias("dir"))
        .withColumn("key", _key(F.col("suffix"), F.col("dir"))).withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    )
    set_bits = [F.col(f"w{i}").bitwiseAND(_mask(F.col("key"), i)) != 0 for i in range(WORDS)]
    possible = asked.join(words, "block")
    for bit in set_bits:
        possible = possible.where(bit)
    if size <= BROADCAST_BYTES:
        listed = F.broadcast(listed)
    hits = possible.join(listed, (F.col("suffix") == F.col("r_host")) & (F.col("dir") == F.col("r_dir"))).where(F.startswith("path", "r_path"))
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("entry").alias("len"), F.length("r_host").alias("host_len"), "entry", "action")).alias("best"))
    best = store(best.select("host", "path", F.col("best.entry").alias("rule"), F.col("best.action").alias("verdict")), "url-verdicts")
    size = best.agg(F.sum(F.octet_length("host") + F.octet_length("path") + F.octet_length("rule") + ROW_BYTES)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        found = read.join(F.broadcast(best), ["host", "path"], "left")
    else:  # an address that very many pages have isn't brought to one task; pages without host stay where they are
        rows = free_name(read.columns, "rows")
        counts = read.where("host <> ''").groupBy("host", "path").agg(F.count("*").alias(rows))
        counted = store(best.join(counts, ["host", "path"]), "url-counts")
        found = join_groups(read.where("host <> ''"), counted, ["host", "path"], rows, read.count(), "left").drop(rows)
        found = found.unionByName(read.where("host = ''").withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(None).cast("string")))
    return found.select(*keep, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))

"""Sharding by extendible hashing: a directory indexed by hash-prefix bits, in which only oversized buckets split. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import store

#: Bits in each of the two hashes of a row: of its key, then of its key and place, for keys that repeat.
BITS = 60


def key_hash(key: Column) -> Column:
    """The first 60 bits of the key's MD5, as a long; null as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def shard(docs: DataFrame, max_bytes: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of docs: key, n_bytes, depth, shard, shard_bytes, fits.

    shard is the prefix of the key's hash, depth bits as a string of 0 and 1: the shortest for which the rows that share it have at most
    max_bytes bytes of UTF-8 text, or are one row. All prefixes together are the directory; a bucket splits on one more bit only if it is
    too large. A row that is larger than max_bytes by itself has a shard for itself and fits is false. Rows with equal keys (a hot key too)
    stay together while they fit, beyond that a hash of their place splits them, evenly; rows that agree in all bits of both hashes stay together
    and, if too large, don't fit. Null texts have 0 bytes, null keys hash as empty.
    Empty tables give no rows; other columns play no part.

    Bytes are summed by prefix before they are shuffled, at the depth that one round looks ahead; only rows of cells that are too large even
    there go to the next round.
    """
    rows = docs.select(
        F.col(key).alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), key_hash(F.col(key)).alias("h0"),
        F.monotonically_increasing_id().alias("place"),
    )
    rows = store(rows.withColumn("h1", key_hash(F.concat_ws("#", F.col("key").cast("string"), F.col("place").cast("string")))).drop("place"), "shard-rows")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth, ahead, done = 0, max(4, min(22, math.ceil(math.log2(max(1, total / max_bytes))) + 4)), []
    while True:
        second, at = divmod(depth, BITS)
        ahead = min(ahead, BITS - at)
        h, base = f"h{second}", ["h0"] if second else []
        cell = F.shiftright(h, BITS - at - ahead)
        cells = rows.groupBy(*base, cell.alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        levels = cells.withColumn("up", F.explode(F.sequence(F.lit(0), F.lit(ahead)))).withColumn("prefix", F.call_function("shiftright", "cell", "up"))
        sums = levels.groupBy(*base, "up", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("n_rows"))
        good = sums.where((F.col("shard_bytes") <= max_bytes) | (F.col("n_rows") == 1))
        best = levels.join(good, [*base, "up", "prefix"]).groupBy(*base, "cell").agg(F.max_by(F.struct("up", "prefix", "shard_bytes"), "up").alias("best"))
        directory = store(best, "shard-directory")
        placed = rows.withColumn("cell", cell).join(directory, [*base, "cell"], "left")
        bits = F.lpad(F.bin("best.prefix"), F.lit(at + ahead) - F.col("best.up"), "0") if not second else F.concat(F.lpad(F.bin("h0"), BITS, "0"), F.lpad(F.bin("best.prefix"), F.lit(at + ahead) - F.col("best.up"), "0"))
        d = F.lit(depth + ahead) - F.col("best.up")
        found = placed.where("best is not null")
        last = depth + ahead >= 2 * BITS
        done.append(
            found.select("key", "n_bytes", d.cast("int").alias("depth"), F.when(d == 0, F.lit("")).otherwise(bits).alias("shard"), F.col("best.shard_bytes").alias("shard_bytes"))
        )
        rest = placed.where("best is null").select("key", "n_bytes", "h0", "h1")
        rows = store(rest, "shard-rest")
        if rows.isEmpty():
            break
        if last:  # rows that agree in all bits of both hashes can't be split further
            sums = rows.groupBy("h0", "h1").agg(F.sum("n_bytes").alias("shard_bytes"))
            whole = F.concat(*[F.lpad(F.bin(h), BITS, "0") for h in ("h0", "h1")])
            done.append(rows.join(sums, ["h0", "h1"]).select("key", "n_bytes", F.lit(2 * BITS).cast("int").alias("depth"), whole.alias("shard"), "shard_bytes"))
            break
        depth, ahead = depth + ahead, 12
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select(F.col("key").alias(key), "n_bytes", "depth", "shard", "shard_bytes", (F.col("shard_bytes") <= max_bytes).alias("fits"))

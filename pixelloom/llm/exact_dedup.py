"""Exact dedup: a persistent digest index, bucketed and sorted by hash, to which new data comes by a sort-merge anti-join. DataFrame functions only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm.common import free_name, join_groups, lower_ascii, store

#: Rows of ids to be broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def normalised(text: Column) -> Column:
    """A-Z lower-cased, null as empty."""
    return lower_ascii(F.coalesce(text, F.lit("")))


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


class DigestIndex:
    """Digests seen so far: table (digest binary, keep_id long, batch string), bucketed and sorted by digest in the session's warehouse.

    batch says with which call of resolve() an entry came. The warehouse must be shared by driver and executors, as it is on a cluster. All runs
    that share an index must use the same number of buckets, and come one after the other.
    """

    def __init__(self, spark: SparkSession, table: str | None = None, buckets: int | None = None):
        self.spark, self.table = spark, table or f"digest_index_{uuid.uuid4().hex}"
        self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, entries: DataFrame) -> None:
        """Add (digest, keep_id, batch) rows whose digests are new. Each append adds files to the buckets, dealt so that a bucket gets one."""
        out = entries.select("digest", "keep_id", "batch").repartition(self.buckets, "digest")
        out.write.bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").mode("append").saveAsTable(self.table)

    def unseen(self, entries: DataFrame) -> DataFrame:
        """The entries whose digest isn't in the index: a sort-merge anti-join that doesn't shuffle the index."""
        return entries.join(self.read().hint("merge").select("digest"), "digest", "left_anti")

    def compact(self) -> None:
        """One sorted file for each bucket again, after many appends."""
        whole, other = store(self.read(), "digest-index"), f"{self.table}_new"
        self.spark.sql(f"DROP TABLE IF EXISTS {other}")
        DigestIndex(self.spark, other, self.buckets).append(whole)
        self.drop()
        self.spark.sql(f"ALTER TABLE {other} RENAME TO {self.table}")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def resolve(docs: DataFrame, index: DigestIndex, text: str = "text", doc_id: str = "doc_id", batch: str | None = None) -> DataFrame:
    """Append docs' new digests to index and say what becomes of each row: doc_id, digest, keep_id, group_size, kept.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty. Of equal texts in docs the largest doc_id stays, unless
    the index had the text before: then its earlier doc_id stays and none of docs. Null doc_ids come after all others. Of repeated rows (same
    doc_id, equal text) one is kept. group_size counts the rows of docs with that text. Other columns play no part.

    batch names this data, by default anew for each call. A call that is made again with the same batch and data, as after a crash, gives the same
    rows: entries that came with it count as new, and nothing is appended twice.
    """
    batch = batch or uuid.uuid4().hex
    rows = store(docs.select(F.col(doc_id).alias("doc_id"), digest_of(F.col(text)).alias("digest")), "digests")
    same = store(rows.groupBy("digest", "doc_id").agg(F.count("*").alias("n")), "digest-rows")
    entries = same.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    entries = store(entries, "digest-groups")
    if not index.exists():
        index.append(entries.limit(0).withColumn("batch", F.lit(batch)))  # an empty table
    index.append(store(index.unseen(entries).withColumn("batch", F.lit(batch)), "digest-fresh"))
    held = entries.drop("keep_id").join(index.read().hint("merge"), "digest")
    fates = store(held.select("digest", "group_size", "keep_id", (F.col("batch") == batch).alias("here")), "digest-fates")  # the caller may drop the index
    each = join_groups(same, fates, ["digest"], "group_size", rows.count()).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    kept = F.col("here") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return each.select("doc_id", "digest", "keep_id", "group_size", kept.alias("kept"))


def dedup(docs: DataFrame, index: DigestIndex | None = None, text: str = "text", doc_id: str = "doc_id", batch: str | None = None) -> DataFrame:
    """The rows of docs that resolve() keeps, with all their columns, whatever their names; of repeated rows (same doc_id, equal text) any one.

    Only ids and digests are shuffled: rows whose fate isn't to stay as they are, found by id and then by digest, are taken out of docs.
    """
    spark = docs.sparkSession
    own = index or DigestIndex(spark)
    fate = resolve(docs, own, text, doc_id, batch).groupBy("digest", "doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    fate = store(fate.where("not kept or n > 1"), "fates")  # of a repeated row that is kept only one stays
    if index is None:
        own.drop()
    names = [free_name(docs.columns, n) for n in ("gone_key", "gone_digest", "gone_again")]
    key, digest, again = names
    told = fate.select(_key(F.col("doc_id"), F.col("digest")).alias(key), F.col("digest").alias(digest), F.col("kept").alias(again))
    if fate.count() <= BROADCAST_IDS:
        told = F.broadcast(told)
    own_digest = digest_of(docs[text])
    met = (_key(docs[doc_id], own_digest) == told[key]) & (own_digest == told[digest])
    once = docs.join(told, met, "left_anti")
    if fate.where("kept").isEmpty():
        return once
    twice = docs.join(told.where(F.col(again)).drop(again), met, "inner")  # whole rows are grouped only where they repeat
    return once.union(twice.dropDuplicates([key, digest]).drop(key, digest))


def _key(doc_id: Column, digest: Column) -> Column:
    """What rows are joined by before digests are compared; rows without id are spread by their digest."""
    return F.when(doc_id.isNull(), F.xxhash64(digest)).otherwise(F.xxhash64(doc_id))

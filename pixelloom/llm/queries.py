"""The queries op1_ .. op10_ over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm import bpe, exact_dedup, jaccard_join, language_id, packing, quality, sharding, token_counts, topk, url_filter
from pixelloom.llm.common import store

#: (entry, action) of op3; fixed by its contract.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.encode(docs, tokenizer_path(), decoded="decoded")
    return done.select(
        "doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.rules_frame(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = r"""
WITH rules(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
read AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*', 0, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path
  FROM cut)
SELECT p.page_id, p.host, p.path, b.host || b.path AS rule, coalesce(b.verdict, 'allow') AS verdict
FROM read p LEFT JOIN LATERAL (
  SELECT r.host, r.path, r.verdict FROM rules r
  WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  ORDER BY length(r.host) + length(r.path) DESC LIMIT 1) b ON true
"""


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = exact_dedup.DigestIndex(spark)
    fates = exact_dedup.resolve(docs, index)
    index.drop()  # the keepers have been read from it and stored
    return fates.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP8_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY h ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)
"""

def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.groups(docs, words=3, percent=90, links=True).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer_path(), tokens=4096)


def held_out(modulus: int, rest: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == rest


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(~held_out(4, 2)))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held_out(4, 2), F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "rejected")


#: Bytes of a shard in op6.
SHARD_BYTES = 1 << 20


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs, SHARD_BYTES)


OP6_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
levels AS (SELECT doc_id, n_bytes, h, unnest(range(0, 41))::INT AS depth FROM d),
sums AS (SELECT *, h >> (60 - depth) AS prefix, sum(n_bytes) OVER w AS b, count(*) OVER w AS n FROM levels WINDOW w AS (PARTITION BY depth, h >> (60 - depth))),
least AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS k FROM sums WHERE b <= {SHARD_BYTES} OR n = 1)
SELECT doc_id, n_bytes, depth, CASE depth WHEN 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard, b::BIGINT AS shard_bytes, b <= {SHARD_BYTES} AS fits
FROM least WHERE k = 1
"""


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of all documents are stored first: the model is learnt from those that labels covers, and all are scored."""
    docs = store(quality.describe(table(spark, sf_dir, "documents").select("doc_id", "text")), "quality-features")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.learn(docs, labels.where(~held_out(5, 0)))
    found = quality.score_described(docs, model)
    return found.select(
        "doc_id", F.coalesce(held_out(5, 0), F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"),
        F.when(F.col("quality_score") >= quality.CUT, 1).otherwise(0).alias("predicted"),
    )


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0, k=10, scale=1024.0)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after three edits of every document: its first word goes, a remark comes in at the middle, a line is added.

    The trees of all documents are planted and stored first; the counts go on from them, so only the edits are encoded then."""
    docs = token_counts.plant(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    docs = store(docs, "token-trees")
    n = F.length("text")
    first = F.length(F.regexp_extract("text", r"^\S*", 0))
    edit = lambda at, remove, insert: F.struct(at.cast("int").alias("at"), remove.cast("int").alias("remove"), F.lit(insert).alias("insert"))
    edits = F.array(edit(F.lit(0), first, ""), edit(F.floor(n / 2), F.lit(0), "[see note]"), edit(n, F.lit(0), "\nEnd of text."))
    return token_counts.count(docs.withColumn("edits", edits), tokenizer_path(), edits="edits", tree="tree")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_url_filter": op3_url_filter,
    "op4_packing": op4_packing,
    "op5_language_id": op5_language_id,
    "op6_sharding": op6_sharding,
    "op7_quality": op7_quality,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_top_k": op9_top_k,
    "op10_token_counts": op10_token_counts,
}
ORACLES: dict[str, str] = {"op3_url_filter": OP3_SQL, "op6_sharding": OP6_SQL, "op8_exact_dedup": OP8_SQL, "op9_top_k": OP9_SQL}

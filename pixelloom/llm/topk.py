"""Exact top-k search by inner product over a vector-approximation file.

Vectors are packed into blocks that hold, besides the exact integers, one quantised cell for each component. A scan of the cells bounds every
score from both sides; exact vectors are then read in the order of their upper bounds until no bound left can reach the kth score found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors to a block, queries to a block (about), cells for each component, and exact vectors read at a time.
BLOCK, QUERIES, CELLS, READ = 4096, 512, 64, 64
BLOCK_SCHEMA = "dim int, n int, ids binary, low binary, width binary, cells binary, exact binary"


def integers(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component as double; null for a vector that is null or has a null, infinite or NaN component."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(x, lambda v: F.floor(v * scale)))


def _exact(ints: np.ndarray) -> np.ndarray:
    top = int(np.abs(ints).max(initial=0))
    return ints.astype("<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8")


def approximate(ids: np.ndarray, ints: np.ndarray) -> dict:
    """A block: per component the lowest value and the width of a cell, for each vector the cell numbers, and the exact values."""
    low, high = ints.min(0), ints.max(0)
    width = (high - low) // CELLS + 1
    exact = _exact(ints)
    return {
        "dim": ints.shape[1], "n": len(ids), "ids": ids.astype("<i8").tobytes(), "low": low.astype("<i8").tobytes(), "width": width.astype("<i8").tobytes(),
        "cells": ((ints - low) // width).astype(np.uint8).tobytes(), "exact": exact.dtype.str.encode()[-1:] + exact.tobytes(),
    }


def _read(exact: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(exact, f"<i{exact[:1].decode()}", offset=1).reshape(-1, dim)


def _blocks(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    held: dict[int, list] = {}

    def block(rows: list) -> pd.DataFrame:
        return pd.DataFrame([approximate(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64))])

    for batch in batches:
        for i, v in zip(batch["id"].tolist(), batch["ints"]):
            if len(v):
                rows = held.setdefault(len(v), [])
                rows.append((i, v))
                if len(rows) == most:
                    yield block(held.pop(len(v)))
    for rows in held.values():
        yield block(rows)


def pack_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    return _blocks(batches, BLOCK)


def pack_queries(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """The query block of one group; a query id that repeats is asked once, by the least of its vectors."""
    group = group.assign(order=[tuple(v) for v in group["ints"]]).sort_values(["id", "order"]).drop_duplicates("id")
    out = pd.concat(list(_blocks(iter([group]), 1 << 30)))
    return out.assign(q_block=key[0])[["q_block", "dim", "ids", "exact"]]


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, low: np.ndarray, width: np.ndarray, cells: np.ndarray, exact: np.ndarray, k: int) -> Iterator[tuple]:
    """(query id, vector id, score) of each query's k best in one block, ties to smaller ids, itself left out."""
    q, dim = queries.astype(np.float64), queries.shape[1]
    most = float(np.abs(q).max(initial=0)) * float(max(np.abs(low).max(), np.abs(low + width * CELLS).max())) * dim
    wide = most >= 2.0**52  # beyond that, doubles don't hold the sums: bounds get a margin, scores are summed as integers
    base = (q * width) @ cells.T.astype(np.float64) + (q @ low.astype(np.float64))[:, None]
    over, under = np.maximum(q, 0) @ (width - 1.0), np.minimum(q, 0) @ (width - 1.0)
    margin = most * 1e-12 if wide else 0.0
    for row, (query_id, b) in enumerate(zip(query_ids, base)):
        others = np.flatnonzero(ids != query_id)
        if not len(others):
            continue
        b = b[others]
        kth = np.partition(b, len(b) - k)[len(b) - k] if len(b) > k else -np.inf
        near = np.flatnonzero(b + over[row] + margin >= kth + under[row] - margin)  # upper bound reaches the kth lower bound
        near = near[np.argsort(-b[near], kind="stable")]
        upper = b[near] + over[row] + margin
        scores = np.zeros(0, np.int64)
        for at in range(0, len(near), READ):
            if len(scores) >= k and upper[at] < np.partition(scores, len(scores) - k)[len(scores) - k]:
                break
            vectors = exact[others[near[at : at + READ]]]
            part = vectors.astype(np.int64) @ queries[row].astype(np.int64) if wide else (vectors.astype(np.float64) @ q[row]).astype(np.int64)
            scores = np.concatenate([scores, part])
        found = ids[others[near[: len(scores)]]]
        for j in np.lexsort((found, -scores))[:k]:
            yield query_id, found[j], scores[j]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Each query's k highest scores among all other rows: query_id, rank (from 1), vec_id, score.

    Components become floor(scale * x); the score is the integer inner product; ties go to the smaller id. Rows with null id, or a vector that
    is null, empty or has null or non-finite components, take no part; queries meet vectors of their own length only. Rows with a query's id
    count as its own; other repeated rows are results of their own. A query with fewer others gets them all; no queries: no rows. Other
    columns play no part. Blocks of vectors meet blocks of queries; each pair of blocks yields k rows a query, and partial results are cut
    to k before they are shuffled.
    """
    spark = vectors.sparkSession
    valid = vectors.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), integers(F.col(embedding), scale).alias("ints"), is_query.alias("asks")).where("ints is not null")
    n, asked = vectors.agg(F.count("*"), F.count_if(is_query)).first()
    q_blocks = max(1, -(-asked // QUERIES))
    salts = max(1, min(-(-n // BLOCK), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    blocks = valid.select("id", "ints").mapInPandas(pack_blocks, BLOCK_SCHEMA)
    blocks = blocks.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts))).withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    questions = (
        valid.where("asks").select("id", "ints", F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int").alias("q_block"))
        .groupBy("q_block").applyInPandas(pack_queries, "q_block int, dim int, ids binary, exact binary")
        .withColumnsRenamed({"ids": "q_ids", "exact": "q_exact"}).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                found = search(
                    np.frombuffer(r.q_ids, "<i8"), _read(r.q_exact, r.dim), np.frombuffer(r.ids, "<i8"), np.frombuffer(r.low, "<i8"), np.frombuffer(r.width, "<i8"),
                    np.frombuffer(r.cells, np.uint8).reshape(r.n, r.dim), _read(r.exact, r.dim), k,
                )
                yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    met = blocks.join(questions, ["q_block", "salt", "dim"]).drop("q_block", "salt")
    best = met.mapInPandas(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

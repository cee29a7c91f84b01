"""Best-fit packing of documents into sequences, with capacities of tokens, documents and attention cost.

Which lengths go together is decided on the histogram of lengths, which has no more entries than a sequence has tokens; equal bins are
handled at once. The plan says where the k-th piece of each length goes. Pieces are numbered within their length by a count over hash buckets,
so that no length, however common, is handled by one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.llm.bpe import OUT_BYTES, model
from pixelloom.llm.common import slices, store

#: Pieces to a bucket of the numbering, about.
BUCKET_PIECES = 20_000

PLAN_SCHEMA = "length int, rank_from long, rank_to long, bin_from long, per long, offset int"


def pieces(docs: DataFrame, path: str, tokens: int, end_id: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pieces of at most tokens ids: key, piece, start, length, ids_crc32. A document's ids are those of its text, then end_id; null text: end_id."""
    schema = docs.select(key).schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end, step = model(path), end_id.to_bytes(4, "little"), 4 * tokens
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(texts, OUT_BYTES):
                row, piece, start, length, crc = [], [], [], [], []
                for i, t in enumerate(texts.slice(a, b - a).to_pylist(), a):
                    ids = bpe.encode(t) + end
                    for k, at in enumerate(range(0, len(ids), step)):
                        part = ids[at : at + step]
                        row.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                columns = [batch.column(0).take(pa.array(row, pa.int64())), *map(pa.array, (piece, start, length, crc), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "piece", "start", "length", "ids_crc32"])

    return docs.select(key, text).mapInArrow(run, schema)


def plan(histogram: dict[int, int], tokens: int, documents: int | None = None, attention: int | None = None, rule: str = "norm", weights=(1.0, 1.0, 1.0)) -> tuple[list[tuple], int]:
    """Rows (length, rank_from, rank_to, bin_from, per, offset) and the number of bins.

    Vector best-fit decreasing: pieces, the longest first, go to the open bin that has room in every capacity (tokens, pieces, the sum of
    squared lengths) and, of those, the least norm of weighted residuals after (rule "norm") or the largest weighted dot product of the
    piece's needs and the residuals (rule "dot"), ties to the bin opened first; where no bin has room a new one is opened. A piece whose
    square is beyond the attention capacity gets a bin of its own. Bins with equal residuals are one row here, with intervals of bin numbers.
    """
    cap = np.array([tokens, documents or tokens, attention or tokens * tokens], float)
    scale = np.array(weights, float) / cap
    rest = np.zeros((1024, 3))
    live = np.zeros(1024, bool)
    where: dict[tuple, int] = {}
    held: list[list[tuple[int, int]]] = [[] for _ in range(1024)]
    free = list(range(1023, -1, -1))
    out, bins = [], 0

    def put(residual: np.ndarray, a: int, b: int) -> None:
        nonlocal rest, live, held
        if a == b or residual[0] < 1 or residual[1] < 1 or residual[2] < 1:
            return
        k = tuple(residual.tolist())
        i = where.get(k)
        if i is None:
            if not free:
                n = len(live)
                rest, live = np.vstack([rest, np.zeros((n, 3))]), np.concatenate([live, np.zeros(n, bool)])
                held += [[] for _ in range(n)]
                free.extend(range(2 * n - 1, n - 1, -1))
            i = where[k] = free.pop()
            rest[i], live[i] = residual, True
        held[i].append((a, b))

    for length in sorted(histogram, reverse=True):
        n, rank = histogram[length], 0
        need = np.array([length, 1, length * length], float)
        while n:
            fit = np.flatnonzero(live & (rest >= need).all(1))
            if len(fit):
                if rule == "dot":
                    value = -((rest[fit] * scale) @ (need * scale))
                else:
                    value = (((rest[fit] - need) * scale) ** 2).sum(1)
                best = np.flatnonzero(value == value.min())
                i = int(fit[min(best, key=lambda j: held[fit[j]][0][0])])
                residual = rest[i].copy()
                held[i].sort(reverse=True)
                a, b = held[i].pop()
                if not held[i]:
                    live[i] = False
                    del where[tuple(residual.tolist())]
                    free.append(i)
            else:
                residual = np.maximum(cap, need)
                per = int(min(residual // need)) if rule == "norm" else 1
                a, b = bins, bins + -(-n // per)
                bins = b
            per = int(min(residual // need)) if rule == "norm" else 1
            full = min(b - a, n // per)
            used = tokens - int(residual[0])
            if full:
                out.append((length, rank, rank + full * per, a, per, used))
                put(residual - per * need, a, a + full)
                rank, n, a = rank + full * per, n - full * per, a + full
            if n and a < b:  # fewer than per are left for the next bin
                out.append((length, rank, rank + n, a, per, used))
                put(residual - n * need, a, a + 1)
                a, n = a + 1, 0
            put(residual, a, b)
    return out, bins


def pack(docs: DataFrame, path: str, tokens: int = 4096, documents: int | None = None, attention: int | None = None, rule: str = "norm", end_id: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Where each piece of each document goes: key, piece, start, length, ids_crc32, sequence_id, offset.

    A sequence holds at most tokens ids, documents pieces and attention as its sum of squared lengths (None: not bounded). Null and empty
    texts are the end id alone. Rows are packed one by one, so rows with repeated or null keys are packed as often as they occur. Empty
    tables give no rows; other columns play no part. What comes to the driver is the histogram of lengths: tokens entries at most.
    """
    spark = docs.sparkSession
    cut = store(pieces(docs, path, tokens, end_id, text, key), "pieces")
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    rows, _ = plan(counts, tokens, documents, attention, rule)
    spread = max(64, -(-sum(counts.values()) // BUCKET_PIECES))
    numbered = cut.withColumn("bucket", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(spread)))
    groups = numbered.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    groups = store(groups.withColumn("g_from", F.coalesce(before, F.lit(0))), "piece-groups")
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in PLAN_SCHEMA.split(", ")])
    placements = spark.createDataFrame(frame, PLAN_SCHEMA) if rows else spark.createDataFrame([], PLAN_SCHEMA)
    placements = placements.withColumnRenamed("length", "p_length")
    met = groups.join(placements, (F.col("length") == F.col("p_length")) & (F.col("rank_from") < F.col("g_from") + F.col("n")) & (F.col("rank_to") > F.col("g_from")))
    met = met.groupBy("length", "bucket", "g_from").agg(F.collect_list(F.struct("rank_from", "rank_to", "bin_from", "per", "offset")).alias("places"))
    order = Window.partitionBy("length", "bucket").orderBy(key, "piece", "ids_crc32")
    ranked = numbered.withColumn("k", F.row_number().over(order) - 1).join(met, ["length", "bucket"]).withColumn("rank", F.col("g_from") + F.col("k"))
    placed = ranked.withColumn("at", F.filter("places", lambda p: (p["rank_from"] <= F.col("rank")) & (p["rank_to"] > F.col("rank")))[0])
    nth = F.col("rank") - F.col("at.rank_from")
    return placed.select(
        key, "piece", "start", "length", "ids_crc32",
        (F.col("at.bin_from") + F.floor(nth / F.col("at.per"))).cast("long").alias("sequence_id"),
        (F.col("at.offset") + F.pmod(nth, F.col("at.per")) * F.col("length")).cast("long").alias("offset"),
    )

"""N-gram Jaccard join with adaptive multi-match prefixes, and the groups of documents that its links connect.

Shingles have one order for all documents, rare ones first. Of two sets that are similar enough, the prefixes of length n - need + m share at
least m shingles, for any m. Each document takes the m for which its prefix is estimated to cost least: where a prefix holds frequent
shingles a longer one, with more of them to be shared, leaves fewer candidates. In either round a pair must share the smaller of its two m
before it is verified.

Many near copies of one text would make a number of pairs that is the square of theirs. So there are two rounds: in the first, each shingle's
documents meet only the one among them in whose order it comes first; what is linked then is one component. In the second only documents of
different components meet. Every pair that could link two components is verified on whole sets, so the components are exact.

Numbers of links need every pair. A link lies within a component, so there all pairs of different sets are met, block by block: those whose
prefixes share as many shingles as the smaller m are verified on whole sets. What is kept is the number of links of each set, not the pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.llm.common import components, free_name, holds, join_groups, slices, store, turn_to

#: Most entries in the table of frequent shingles, which every task gets (12 bytes each); shingles rarer than RARE are never in it.
FREQUENT, RARE = 1 << 19, 8
#: Largest m, and the cost of verifying a candidate in units of reading an entry of the index.
MOST_MATCHES, VERIFY = 4, 4.0
#: Shingles that a task counts before it hands on their sum, and ids of candidates up to which they are broadcast.
FLUSH, BROADCAST_IDS = 1 << 20, 1_000_000
STRETCH = 1 << 20
#: Documents with a prefix shingle beyond which they are dealt over blocks.
SHARED = 1024
#: Sets, and shingles, to a block of a component (about; sets are dealt by hash), and shingles that a product of two blocks takes at once.
BLOCK, BLOCK_SHINGLES, COLUMNS = 256, 1 << 20, 4096
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BASE = 0x5851F42D4C957F2F


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n of each."""
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.empty(n, np.uint64)
        p[0], have = 1, 1
        while have < n:
            k = min(have, n - have)
            p[have : have + k] = p[:k] * np.uint64(pow(b, have, 1 << 64))
            have += k
        out.append(p)
    return out[0], out[1]


holds("jaccard", _powers.cache_clear)


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """A random number for each byte, and which bytes are white space (20, 09-0D)."""
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    return np.random.default_rng(2024).integers(1, 1 << 64, 256, np.uint64, endpoint=False), space


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _K2
    h = (h ^ (h >> np.uint64(29))) * _K1
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The sorted set of 64-bit shingle hashes of each text, after lower-casing A-Z; with fewer words the whole sequence is the shingle."""
    data = [(t or "").encode("utf-8", "replace").lower() for t in texts]
    buf = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    ends = np.cumsum([len(d) + 1 for d in data])
    numbers, space = _letters()
    gap = space[buf]
    edge = np.flatnonzero(np.diff(gap, prepend=True))
    starts, stops = edge[0::2], edge[1::2]
    size = 1 << max(20, int(len(buf)).bit_length())
    power, inverse = _powers(size)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(numbers[buf] * power[: len(buf)], out=total[1:])
    word = _mix((total[stops] - total[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))
    first = np.searchsorted(starts, ends - np.array([len(d) + 1 for d in data]))
    after = np.searchsorted(starts, ends)
    m = max(0, len(word) - words + 1)
    run = np.full(m, words, np.uint64)
    for k in range(words):
        run = _mix(run * _K1 + word[k : k + m])
    out = []
    for a, b in zip(first.tolist(), after.tolist()):
        if b - a >= words:
            out.append(np.unique(run[a : b - words + 1]))
        elif b > a:
            h = np.array([b - a], np.uint64)
            for x in word[a:b]:
                h = _mix(h * _K1 + x)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def required(n: int, percent: int) -> int:
    """Least intersection of a set of n with any that is similar enough."""
    return -(-percent * n // 100)


def _pack_cells(cells: np.ndarray, width: int, bits: int) -> list[tuple[int, bytes]]:
    """How often each cell occurs, by the cells' first bits: differences of the sorted cells, in as few bytes as these need, and numbers up to
    255 (a cell that occurs more often comes again)."""
    cells, n = np.unique(cells, return_counts=True)
    again = -(-n // 255)
    cells, n = np.repeat(cells, again), np.minimum(np.repeat(n, again) - 255 * (np.arange(again.sum()) - np.repeat(np.cumsum(again) - again, again)), 255).astype(np.uint8)
    out, cut = [], np.searchsorted(cells, np.arange(1, 1 << bits, dtype=np.int64) << (width - bits)).tolist()
    for i, (a, b) in enumerate(zip([0, *cut], [*cut, len(cells)])):
        if a < b:
            d = np.diff(cells[a:b], prepend=i << (width - bits))
            size = 2 if d.max() < 1 << 16 else 4 if d.max() < 1 << 32 else 8
            out.append((i, b"%d" % size + d.astype(f"<u{size}").tobytes() + n[a:b].tobytes()))
    return out


def _unpack_cells(part: int, packed: bytes, width: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    size = int(packed[:1])
    k = (len(packed) - 1) // (size + 1)
    cells = (part << (width - bits)) + np.cumsum(np.frombuffer(packed, f"<u{size}", k, 1), dtype=np.int64)
    return cells, np.frombuffer(packed, np.uint8, k, 1 + size * k).astype(np.int64)


def frequent_shingles(docs: DataFrame, words: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The width of a cell in bits, and the sorted cells (first bits of shingles) and document frequencies of the most frequent shingles: all that
    are as frequent as a level, which is chosen so that there are no more than FREQUENT.

    All documents are counted, in cells of which there are 16 or more to a shingle. A task sums its cells and hands them on packed, by ranges; a
    range's sums are then merged as they come, in the order of ranges, so that a task holds the different cells of one range at most.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = min(18, max(6, (2 * parts).bit_length()))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = min(56, max(32, (size // 4).bit_length() + 4))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("jaccard")
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            packed = _pack_cells(np.concatenate(held), width, bits)
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in packed], pa.int32()), pa.array([p[1] for p in packed], pa.binary())], names=["part", "cells"])

        for batch in batches:
            texts = batch.column(0)
            for a, b in slices(texts, STRETCH):
                for s in shingle_sets(texts.slice(a, b - a).to_pylist(), words):
                    held.append((s >> np.uint64(64 - width)).astype(np.int64))
                    n += len(s)
                if n >= FLUSH:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("jaccard")
        at, held, n, most = None, [], 0, FLUSH

        def merged() -> tuple[np.ndarray, np.ndarray]:
            cells, counts = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(cells, kind="stable")
            cells, counts = cells[order], counts[order]
            first = np.flatnonzero(np.diff(cells, prepend=-1))
            return cells[first], np.add.reduceat(counts, first)

        def done() -> pa.RecordBatch:
            cells, counts = merged()
            some = counts >= RARE
            return pa.RecordBatch.from_arrays([pa.array(cells[some]), pa.array(counts[some])], names=["cell", "df"])

        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                if part != at and held:
                    yield done()
                    held, n, most = [], 0, FLUSH
                at = part
                held.append(_unpack_cells(part, packed.as_py(), width, bits))
                n += len(held[-1][0])
                if n > most:
                    held = [merged()]
                    n, most = 0, max(FLUSH, len(held[0][0]))
        if held:
            yield done()

    counted = docs.select("text").mapInArrow(tally, "part int, cells binary").repartition(parts, "part").sortWithinPartitions("part").mapInArrow(add, "cell long, df long")
    counted = store(counted.withColumn("level", F.floor(F.log2("df") * 8).cast("int")), "frequent")
    levels = sorted(counted.groupBy("level").count().collect(), reverse=True)  # some 8 for each doubling of the number of documents
    total, least = 0, 1 << 30
    for level, n in levels:
        total += n
        if total > FREQUENT:
            break
        least = level
    rows = counted.where(F.col("level") >= least).select("cell", F.least("df", F.lit((1 << 31) - 1)).cast("int").alias("df")).toArrow()
    cells = rows.column("cell").to_numpy()
    order = np.argsort(cells)
    return width, cells[order], rows.column("df").to_numpy()[order]


def prefix(s: np.ndarray, df: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The places of the shingles of a set's prefix, rare ones first, and the number m to share. df: 0 for what isn't frequent."""
    n = len(s)
    need = required(n, percent)
    most = min(MOST_MATCHES, need)
    order = np.lexsort((s, df))
    cost = np.cumsum(df[order])
    m = min(range(1, most + 1), key=lambda k: (float(cost[min(n, n - need + k) - 1]) * (1 + VERIFY / k), k))
    return order[: min(n, n - need + m)], m


def describe(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, version, n (size of the set), sig (16 bytes that stand for the set), m, tokens (the prefix in order)."""
    frequent = frequent_shingles(docs, words)
    table = docs.sparkSession.sparkContext.broadcast(frequent)  # FREQUENT entries at most
    del frequent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("jaccard")
        width, cells, dfs = table.value
        for batch in batches:
            texts = batch.column(2)
            for a, b in slices(texts, STRETCH):
                sets = shingle_sets(texts.slice(a, b - a).to_pylist(), words)
                sig, ms, tokens = [], [], []
                for s in sets:
                    sig.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    if len(s) == 0:
                        ms.append(0)
                        tokens.append(np.zeros(0, np.int64))
                        continue
                    df = np.zeros(len(s), np.int64)
                    if len(cells):
                        c = (s >> np.uint64(64 - width)).astype(np.int64)
                        at = np.minimum(np.searchsorted(cells, c), len(cells) - 1)
                        df = np.where(cells[at] == c, dfs[at].astype(np.int64), 0)
                    chosen, m = prefix(s, df, percent)
                    ms.append(m)
                    tokens.append(s[chosen].view(np.int64))
                lengths = np.cumsum([0, *map(len, tokens)])
                flat = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int64), pa.int64()))
                own = [batch.column(k).slice(a, b - a) for k in range(2)]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array([len(s) for s in sets], pa.int32()), pa.array(sig, pa.binary()), pa.array(ms, pa.int32()), flat],
                    names=["doc_id", "version", "n", "sig", "m", "tokens"],
                )

    return docs.select("doc_id", "version", "text").mapInArrow(run, "doc_id long, version long, n int, sig binary, m int, tokens array<long>")


def _need(a: Column, b: Column, percent: int) -> Column:
    """Least intersection of sets of a and b shingles that are similar enough."""
    return F.ceil((a + b) * percent / F.lit(100 + percent))


def few(df: DataFrame) -> DataFrame:
    """df, which is stored, to be broadcast if its rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def of_pairs(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in pairs (a, b); broadcast if the ids are few."""
    ids = store(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "candidate-ids")
    return docs.join(few(ids), "doc_id", "left_semi")


def matched(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b) whose prefixes share as many shingles as the smaller m of the two."""
    prefixes = store(of_pairs(pairs, known).select("doc_id", "m", "tokens"), "candidate-prefixes")
    x, y = (prefixes.select(F.col("doc_id").alias(i), F.col("m").alias(f"m_{i}"), F.col("tokens").alias(f"tokens_{i}")) for i in "ab")
    enough = F.size(F.array_intersect("tokens_a", "tokens_b")) >= F.least("m_a", "m_b")
    return pairs.join(x, "a").join(y, "b").where(enough).select("a", "b").distinct()


def verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough. Sets are made anew, for the documents in pairs only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(texts, STRETCH):
                sets = [s.tobytes() for s in shingle_sets(texts.slice(a, b - a).to_pylist(), words)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, xs, ys = [], batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                both = np.concatenate([np.frombuffer(xs[i].as_buffer(), np.uint64), np.frombuffer(ys[i].as_buffer(), np.uint64)])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = store(of_pairs(pairs, docs).select("doc_id", "text").mapInArrow(run, "doc_id long, shingles binary"), "candidate-sets")
    met = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    return store(met.select("a", "b", "x", "y").mapInArrow(similar, "a long, b long").distinct(), "links")


def shared_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of each set of x with each of y."""
    out = np.zeros((len(x), len(y)), np.int64)
    every = [np.concatenate(sets) for sets in (x, y)]
    both = np.intersect1d(*every)
    if not len(both):
        return out
    entries = []
    for sets, values in zip((x, y), every):
        column = np.minimum(np.searchsorted(both, values), len(both) - 1)
        some = both[column] == values
        row, column = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[some], column[some]
        order = np.argsort(column, kind="stable")
        entries.append((len(sets), row[order], column[order]))
    for c in range(0, len(both), COLUMNS):
        width, sides = min(COLUMNS, len(both) - c), []
        for n, row, column in entries:
            a, b = np.searchsorted(column, [c, c + width])
            side = np.zeros((n, width), np.float32)  # sums of a product are whole numbers up to COLUMNS, so exact
            side[row[a:b], column[a:b] - c] = 1
            sides.append(side)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def block_links(x: list[tuple], y: list[tuple], percent: int) -> np.ndarray:
    """Which of x link with which of y; entries (sig, size, m, prefix, set). A set doesn't link with itself."""
    m = np.minimum.outer([e[2] for e in x], [e[2] for e in y])
    met = shared_counts([e[3] for e in x], [e[3] for e in y]) >= m
    if x is y:
        np.fill_diagonal(met, False)
    if met.any():
        common = shared_counts([e[4] for e in x], [e[4] for e in y])
        total = np.add.outer([len(e[4]) for e in x], [len(e[4]) for e in y])
        met &= 100 * common >= percent * (total - common)
    return met


def link_counts(heads: DataFrame, part: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """n, sig, links: for the sets of part's nodes, how many documents have another set that links with theirs; no row for none.

    heads has the documents (doc_id, n, sig, m, tokens) that stand for their sets, classes the number (size) of documents of each (n, sig).
    A component's sets are dealt over blocks of bounded size and each two blocks meet in one group of rows, so that no task holds a component.
    The work is the square of a component's number of different sets, as that of its links can be.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(texts, STRETCH):
                sets = [s.tobytes() for s in shingle_sets(texts.slice(a, b - a).to_pylist(), words)]
                sig = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
                columns = [pa.array([len(s) // 8 for s in sets], pa.int32()), pa.array(sig, pa.binary()), pa.array(sets, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], names=["doc_id", "n", "sig", "shingles"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sides = None, ([], [])

        def flush() -> Iterator[pa.RecordBatch]:
            x, y = sides if at[1] != at[2] else (sides[0], sides[0])
            if not x or not y:
                return
            links = block_links(x, y, percent)
            some = [(x, links @ np.array([e[1] for e in y]))] + ([] if x is y else [(y, np.array([e[1] for e in x]) @ links)])
            for entries, n in some:
                columns = [pa.array([len(e[4]) for e in entries], pa.int32()), pa.array([e[0] for e in entries], pa.binary()), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["n", "sig", "links"])

        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in range(3)))
            rows = zip(*(batch.column(k).to_pylist() for k in range(3, 7)))
            tokens, shingles = batch.column(7), batch.column(8)
            for k, (key, (own, *rest)) in enumerate(zip(keys, rows)):
                if key != at:
                    if at is not None:
                        yield from flush()
                    at, sides = key, ([], [])
                prefix = np.frombuffer(tokens[k].values.to_numpy().tobytes(), np.uint64)
                sides[own != key[1]].append((*rest, prefix, np.frombuffer(shingles[k].as_py(), np.uint64)))
        if at is not None:
            yield from flush()

    key = ["doc_id", "n", "sig"]
    nodes = few(part.select(F.col("node").alias("doc_id"), "component"))
    known = heads.join(nodes, "doc_id").dropDuplicates(key).join(classes.select("n", "sig", "size"), ["n", "sig"])
    known = store(known, "link-prefixes")
    blocks = known.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    blocks = few(store(blocks, "link-blocks"))
    sets = docs.join(nodes, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(run, "doc_id long, n int, sig binary, shingles binary")
    sets = store(sets, "link-sets").dropDuplicates(key).join(known, key).join(blocks, "component")
    sets = sets.withColumn("own", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
    sets = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = sets.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "sig", "size", "m", "tokens", "shingles")
    met = met.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    counts = store(met.mapInArrow(count, "n int, sig binary, links long"), "link-counts")
    return store(counts.groupBy("n", "sig").agg(F.sum("links").alias("links")), "class-links")


def _apart(docs: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """docs and known with doc_id made a key of texts: where rows of one doc_id have different texts, each text gets a negative number of its own
    instead. real keeps the doc_id. Also whether there were any such."""
    known = known.withColumn("real", F.col("doc_id"))
    named = known.where("doc_id is not null").groupBy("doc_id").agg(F.min("version").alias("v1"), F.max("version").alias("v2"))
    named = store(named.where("v1 <> v2").select("doc_id", F.lit(True).alias("apart")), "namesakes")
    if named.isEmpty():
        return docs, known, False
    own = F.when(F.col("apart"), -1 - F.xxhash64("doc_id", "version").bitwiseAND((1 << 63) - 1)).otherwise(F.col("doc_id"))
    docs, known = (df.join(few(named), "doc_id", "left").withColumn("doc_id", own).drop("apart") for df in (docs, known))
    return docs, store(known, "apart"), True


def _groups(docs: DataFrame, words: int, percent: int, text: str, doc_id: str, links: bool) -> DataFrame:
    """groups() with version, a hash of the row's text, and component, a number for the component."""
    if docs.schema[doc_id].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{doc_id} must be a column of integers")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("version"), F.col(text).alias("text"))
    docs, known, apart = _apart(docs, store(describe(docs, words, percent), "prefixes"))
    some = known.where("n > 0 and doc_id is not null")
    size = [F.countDistinct("doc_id").alias("size")] if links else []
    classes = some.groupBy("n", "sig").agg(F.min("doc_id").alias("class_id"), F.min("real").alias("real_class"), F.count("*").alias("rows"), *size)
    classes = store(classes, "classes")
    total = known.count()
    members = join_groups(some.select("doc_id", "n", "sig"), classes.where("rows > 1").select("n", "sig", "class_id", "rows"), ["n", "sig"], "rows", total)
    members = members.where("doc_id <> class_id").select(F.col("doc_id").alias("__id"), F.col("n").alias("__n"), F.col("sig").alias("__sig"))
    members = few(store(members.distinct(), "class-members"))
    heads = some.join(members, F.expr("doc_id = __id and n = __n and sig = __sig"), "left_anti")
    index = heads.select("doc_id", "n", F.posexplode("tokens").alias("pos", "token"))
    index = index.repartition("token")  # one shuffle serves the aggregate and the join
    shared = index.groupBy("token").agg(F.count("*").alias("docs"), F.min(F.struct("pos", "doc_id", "n")).alias("top")).where("docs > 1")
    index = store(index.join(shared, "token"), "index")  # shingles of two documents or more

    near = F.least(F.col("n") - F.col("pos"), F.col("top.n") - F.col("top.pos")) >= _need(F.col("n"), F.col("top.n"), percent)
    first = index.where((F.col("doc_id") != F.col("top.doc_id")) & near)
    first = store(first.select(F.least("doc_id", "top.doc_id").alias("a"), F.greatest("doc_id", "top.doc_id").alias("b")).distinct(), "pairs-1")
    linked = verified(store(matched(first, some), "matched-1"), docs, words, percent)

    part = store(components(linked), "components-1")
    place = index.drop("top", "docs").join(part.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    place = store(place.withColumn("before", F.lag("token").over(Window.partitionBy("doc_id", "n").orderBy("pos"))), "placed")
    mixed = place.groupBy("token").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 < c2").select("token")
    place = store(place.join(mixed, "token", "left_semi"), "mixed")
    second = store(_met(place, percent).join(first, ["a", "b"], "left_anti"), "met")
    second = store(matched(second, some), "pairs-2")
    if not second.isEmpty():
        more = verified(second, docs, words, percent)
        if not more.isEmpty():
            part = store(components(linked.union(more), "components-2"), "components-2")
    ends = classes.join(part.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    if apart:  # the least doc_id of a component, not the least number
        ends = store(ends, "class-components")
        ends = ends.join(ends.groupBy("component").agg(F.min("real_class").alias("component_id")), "component")
    else:
        ends = ends.withColumn("component_id", F.col("component"))
    if links:
        ends = ends.join(link_counts(heads, part, classes, docs, words, percent), ["n", "sig"], "left")
    ends = store(ends.drop("class_id"), "class-ends")
    out = join_groups(known.select("real", "doc_id", "version", "n", "sig"), ends, ["n", "sig"], "rows", total, "left")
    own = lambda c, other="real": F.when(F.col("real").isNotNull(), F.coalesce(c, other))
    others = F.coalesce(F.col("size") - 1, F.lit(0)) + F.coalesce("links", F.lit(0)) if links else None
    n_links = [F.when(F.col("real").isNotNull(), others).alias("n_links")] if links else []
    return out.select(
        F.col("real").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), own("real_class").alias("class_id"), own("component_id").alias("component_id"),
        *n_links, "version", own("component", "doc_id").alias("component"),
    )


def _met(place: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of documents of different components that share a prefix shingle, met at their first one; where the ones before are the
    same, there was an earlier one. A frequent shingle's documents are dealt over blocks of SHARED, each two of which meet in a task of their own."""
    number = place.groupBy("token").agg(F.count("*").alias("docs")).where(F.col("docs") > SHARED)
    blocks = F.coalesce(F.ceil(F.col("docs") / SHARED), F.lit(1)).cast("int")
    dealt = place.join(few(store(number, "shared")), "token", "left").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    with_others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", with_others).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("docs", "blocks", "other")
    x, y = dealt.alias("x"), dealt.alias("y")
    near = F.least(F.expr("x.n - x.pos"), F.expr("y.n - y.pos")) >= _need(F.col("x.n"), F.col("y.n"), percent)
    begins = F.coalesce(F.col("x.before") != F.col("y.before"), F.lit(True))
    same = (F.col("x.token") == F.col("y.token")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    sides = (F.col("x.i") == F.col("x.j")) | (F.col("x.own") != F.col("y.own"))
    met = x.join(y, same & sides & (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.component") != F.col("y.component")) & begins & near)
    return met.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()


def groups(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id", links: bool = False) -> DataFrame:
    """A row for each of docs: doc_id, n_shingles, class_id (least doc_id with the same set), component_id (least doc_id reachable by links);
    if links, also n_links, the number of other documents that it links with, those with the same set counted in.

    Two documents link when 100 * intersection >= percent * union of their sets of shingles (see shingle_sets). A document without words (null
    text too) has an empty set, links with nothing and is its own class and component. Rows with null doc_id take no part: null class,
    component and n_links. Repeated rows are one document. Rows with equal doc_id and different texts are documents of their own, each with its
    own class and component, named by ids as ever. doc_id must be of an integer type, else TypeError. Other columns play no part; empty tables
    give no rows.
    """
    return _groups(docs, words, percent, text, doc_id, links).drop("version", "component")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs, all columns whatever their names, with one document of each group of groups(): the one with the least doc_id (of several texts with
    that doc_id, the one with the least hash). Rows that repeat it stay with it. Rows with null doc_id and documents without words stay."""
    found = store(_groups(docs, words, percent, text, doc_id, False).where("doc_id is not null").select("doc_id", "version", "component"), "grouped")
    one = F.struct("doc_id", "version")
    heads = found.groupBy("component").agg(F.min(one).alias("head"), F.max(one).alias("last"), F.count("*").alias("rows")).where("head <> last").drop("last")
    gone = join_groups(found, store(heads, "group-heads"), ["component"], "rows", found.count()).where(one != F.col("head"))
    names = free_name(docs.columns, "gone_id"), free_name(docs.columns, "gone_version")
    gone = few(store(gone.select(F.col("doc_id").alias(names[0]), F.col("version").alias(names[1])).distinct(), "near-copies"))
    return docs.join(gone, (docs[doc_id] == gone[names[0]]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == gone[names[1]]), "left_anti")

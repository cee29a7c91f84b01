"""What the operators of this subpackage share: the shared folder, stored intermediate tables, names, joins on hot keys, graph components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that a join may take as hot: as many rows are broadcast at most. A key is hot beyond HOT_ROWS rows, or its share where that is more.
HOT_KEYS, HOT_ROWS = 20_000, 256
#: Rounds after which components() gives up; it needs some log2 of the number of nodes.
MOST_ROUNDS = 100

#: What each operator holds in a worker process from task to task, as functions that let go of it.
_HELD: dict[str, list[Callable[[], None]]] = {}
#: The operator that this process works for.
_TURN = [""]
#: Folder, beneath the shared one, that stored tables go to now; see scratch().
_SCRATCH: list[str] = []


def holds(owner: str, release: Callable[[], None]) -> None:
    _HELD.setdefault(owner, []).append(release)


def turn_to(owner: str) -> None:
    """Called at a task's start: worker processes are used again, so what other operators hold there is let go, and given back to the system."""
    if _TURN[0] == owner:
        return
    _TURN[0] = owner
    for other, releases in _HELD.items():
        if other != owner:
            for release in releases:
                release()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset: in local mode a temporary one; on a cluster an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='pixelloom-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, with all that is in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Tables stored within go to one folder, which is removed at the end, so write results elsewhere before."""
    at = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    _SCRATCH.append(at)
    try:
        yield at
    finally:
        _SCRATCH.pop()
        remove(spark, at)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: what follows survives lost executors without the work before.

    Within scratch() the table goes when that ends; elsewhere it stays as long as a lazy result may need it, in the shared folder, which is the
    caller's to empty.
    """
    spark = df.sparkSession
    at = f"{_SCRATCH[-1] if _SCRATCH else shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of up to about most bytes of an array of strings or binaries. Spark bounds its batches by bytes, not to what a task can hold
    as Python objects."""
    start = total = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        total += n
        if total > most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def free_name(names: list[str], base: str) -> str:
    """base, with underscores before it until no name is the same in any case."""
    taken = {n.lower() for n in names}
    while base.lower() in taken:
        base = "_" + base
    return base


def others(df: DataFrame, names: list[str | None]) -> list[str]:
    """df's columns but for those with one of the names, in any case."""
    less = {n.lower() for n in names if n}
    return [c for c in df.columns if c.lower() not in less]


def carried(df: DataFrame, column: str, added: list[str], stays: bool) -> tuple[DataFrame, list[str], int]:
    """What a classifier's map reads of df: the columns that it returns, those but for added, and column once, among them if it stays, else after them.
    Also the names of those returned, and column's place. Spark's batches hold each column whole in the JVM and in Python, so texts go once."""
    keep = others(df, added if stays else [column, *added])
    at = [c.lower() for c in keep].index(column.lower()) if stays else len(keep)
    return df.select(*keep) if stays else df.select(*keep, column), keep, at


def lower_ascii(c):
    """c with A-Z lower-cased and nothing else: lower() where all is ASCII, which is quicker, else translate()."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with groups, a stored table with one row for each of keys' values and, as size, how many rows have it.

    The largest groups, HOT_KEYS at most as total rows have no more groups beyond the level, are broadcast, so that their rows stay where they
    are; the rest is joined by a shuffle, in which no key has more rows than the level. rows should be cheap to read twice.
    """
    level = max(HOT_ROWS, -(-total // HOT_KEYS))
    hot = F.broadcast(groups.where(F.col(size) > level))
    first = rows.join(hot, keys)
    rest = rows.join(F.broadcast(groups.where(F.col(size) > level).select(*keys)), keys, "left_anti").join(groups.where(F.col(size) <= level), keys, how)
    return first.unionByName(rest)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges (a, b): a row (node, component) for each node, component being the least node reachable.

    Alternates large-star and small-star steps until the edges are stars, in O(log n) rounds or so; each round is some shuffles on the edges
    and is stored, so that lineage stays short. The neighbours of a node with very many aren't brought together. No edges: no rows.
    Self-loops and repeated edges do no harm; null ends are ignored.
    """
    e = store(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-edges")
    for _ in range(MOST_ROUNDS):
        inner = e.select(F.col("u").alias("v"), F.lit(1).alias("inner")).distinct()
        n, nodes, chained = e.join(inner, "v", "left").agg(F.count("*"), F.countDistinct("u"), F.count("inner")).first()
        if n == nodes and chained == 0:  # each node has one neighbour, which has none smaller
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: each node's larger neighbours move to its least neighbour (or itself).
        least = store(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("degree")), f"{name}-least")
        large = join_groups(both.where("v > u"), least, ["u"], "degree", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = store(large.where("u <> v").distinct(), f"{name}-large")
        # Small star: each node and its smaller neighbours move to the least of these.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        e = store(large.join(least, "u").select(moved.alias("s")).select("s.*").where("u <> v").distinct(), f"{name}-small")
    else:
        raise RuntimeError(f"no components after {MOST_ROUNDS} rounds")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

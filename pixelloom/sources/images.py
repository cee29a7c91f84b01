"""Sources and sinks of images: files as rows, surfaces as scan lines or pixels, PNG out."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.codecs.png import encode
from pixelloom.functions.columns import bytes_of, bytes_per_pixel, div
from pixelloom.model import Surface

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def read(spark: SparkSession, path: str, pattern: str | None = None, longest: int | None = None) -> DataFrame:
    """Files as rows (path, modificationTime, length, content). Filters on length reach the source, which then doesn't open files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(path)
    return files.where(F.col("length") <= longest) if longest else files


def scanlines(surfaces: DataFrame) -> DataFrame:
    """(path, y, row) of each decoded surface."""
    pitch = F.col("width") * bytes_per_pixel("format")
    rows = surfaces.where("ok").select("path", "pixels", pitch.alias("pitch"), F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    return rows.select("path", "y", F.substring(F.col("pixels"), F.col("y") * F.col("pitch") + 1, F.col("pitch")).alias("row"))


def indices(surfaces: DataFrame) -> DataFrame:
    """(path, y, x, idx) of each indexed surface."""
    rows = scanlines(surfaces.where("format = 'indexed8'"))
    return rows.select("path", "y", F.posexplode(bytes_of("row")).alias("x", "idx"))


def colours(surfaces: DataFrame) -> DataFrame:
    """(path, y, x, r, g, b, a) of each surface that isn't indexed; a is 255 where there is none."""
    size = bytes_per_pixel("format")
    rows = surfaces.where("ok and format <> 'indexed8'").select("path", "width", size.alias("n"), bytes_of("pixels").alias("v"), F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("i"))
    at = lambda k: F.get("v", F.col("i") * F.col("n") + k)
    return rows.select("path", div("i", "width").alias("y"), (F.col("i") % F.col("width")).alias("x"), at(0).alias("r"), at(1).alias("g"), at(2).alias("b"), F.when(F.col("n") == 4, at(3)).otherwise(255).alias("a"))


def palettes(surfaces: DataFrame) -> DataFrame:
    """(path, idx, r, g, b) of each palette."""
    rows = surfaces.where("ok and octet_length(palette) > 0").select("path", bytes_of("palette").alias("v"), F.explode(F.expr("sequence(0, cast(octet_length(palette) div 3 as int) - 1)")).alias("idx"))
    return rows.select("path", "idx", *[F.get("v", F.col("idx") * 3 + k).alias(c) for k, c in enumerate("rgb")])


def subrects(surfaces: DataFrame) -> DataFrame:
    """(path, index, x, y, w, h, kind, user_tag) of each part of an atlas."""
    return surfaces.where("ok").select("path", F.explode("subrects").alias("s")).select("path", "s.*")


def _pngs(batch: pa.RecordBatch) -> list[bytes | None]:
    out = []
    for r in batch.select(["ok", "width", "height", "format", "pixels", "palette"]).to_pylist():
        out.append(encode(Surface(r["width"], r["height"], r["format"], r["pixels"], r["palette"] or b"")) if r["ok"] else None)
    return out


def with_png(surfaces: DataFrame) -> DataFrame:
    """surfaces without pixels, palette and subrects, plus png; null where there is no surface."""
    keep = [c for c in surfaces.columns if c not in ("pixels", "palette", "subrects", "png")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(_pngs(batch), pa.binary())], names=[*keep, "png"])

    return surfaces.mapInArrow(run, surfaces.select(*keep).schema.add("png", "binary"))


def save_pngs(surfaces: DataFrame, folder: str) -> DataFrame:
    """Write each surface to folder, which all executors must share, and return (path, saved, ok). A file appears whole or not at all, and
    under a name that depends on the path alone, so a task that runs twice does no harm. The work is done when the result is used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            names, done = [], []
            for path, png in zip(batch.column("path").to_pylist(), batch.column("png").to_pylist()):
                name = os.path.join(folder, path.rsplit("/", 1)[-1].rsplit(".", 1)[0] + f"-{abs(hash_of(path)):08x}.png")
                if png is not None:
                    part = f"{name}.{os.getpid()}.part"
                    with open(part, "wb") as f:
                        f.write(png)
                    os.replace(part, name)
                names.append(name)
                done.append(png is not None)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(names, pa.string()), pa.array(done, pa.bool_())], names=["path", "saved", "ok"])

    return with_png(surfaces).select("path", "png").mapInArrow(run, "path string, saved string, ok boolean")


def hash_of(path: str) -> int:
    import zlib

    return zlib.crc32(path.encode())

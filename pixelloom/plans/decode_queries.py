"""Queries that decode: the driver's tables as files of formats whose rasters SQL can state, and one file of every codec."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions.columns import fingerprint
from pixelloom.model import Options
from pixelloom.operators.decode import decode
from pixelloom.plans.queries import HEADERS, sql_tiles, tiles
from pixelloom.sources.images import with_png

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _hex(x: str):
    return F.unhex(F.lit(x))


def _le32(x: int) -> str:
    return x.to_bytes(4, "little").hex()


def _tiled(name: str, codec: str, size: int, head: str, tail: str, w: int, h: int, format: int, sql_pixels: str, palette: str = "", detect: bool = True) -> None:
    """Each tile of size bytes, between head and tail (hex), is a file of a codec; sql_pixels is its raster in hex, from the list a."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = tiles(spark, sf_dir, size).withColumn("content", F.concat(_hex(head), F.col("content"), _hex(tail)))
        made = decode(files, None if detect else codec)
        mark = fingerprint("width", "height", "format", "pixels", "palette")
        return made.select("doc_id", "tile", "codec", "width", "height", "format", mark.alias("fingerprint"))

    QUERIES[name] = run
    formats = ("indexed8", "rgb888", "rgba8888")
    ORACLES[name] = f"""WITH {sql_tiles(size)} SELECT doc_id, tile, '{codec}' AS codec, {w} AS width, {h} AS height, '{formats[format]}' AS format,
md5(unhex('{_le32(w)}{_le32(h)}{_le32(format)}' || {sql_pixels} || '{palette}')) AS fingerprint FROM b"""


def _sql_bytes(index: str, n: int) -> str:
    """n bytes in hex, the i-th being index (from 1) in the list a."""
    return f"array_to_string(list_transform(range(0, {n}), lambda i: lpad(to_hex(a[{index}]), 2, '0')), '')"


def _sql_values(value: str, n: int) -> str:
    return f"array_to_string(list_transform(range(0, {n}), lambda i: lpad(to_hex({value}), 2, '0')), '')"


_GREYS = "".join(f"{i:02x}" * 3 for i in range(256))
_BMP = "424d" + _le32(1078 + 256) + "00000000" + _le32(1078) + _le32(40) + _le32(16) + _le32(16) + "0100" + "0800" + "00000000" * 6 + "".join(f"{i:02x}{i:02x}{i:02x}00" for i in range(256))
_SGI = "01da" + "00" + "01" + "0002" + "0010" + "0010" + "0001" + "00" * 500
_tiled("decode_bmp", "bmp", 256, _BMP, "", 16, 16, 0, _sql_bytes("(15 - i // 16) * 16 + i % 16 + 1", 256), _GREYS)
_tiled("decode_sgi", "sgi", 256, _SGI, "", 16, 16, 1, _sql_bytes("(15 - i // 48) * 16 + i % 48 // 3 + 1", 768))
_tiled("decode_sunrast", "sunrast", 192, "59a66a95" + "00000008" * 2 + "00000018" + "000000c0" + "00000003" + "00000000" * 2, "", 8, 8, 2, _sql_values("CASE WHEN i % 4 = 3 THEN 255 ELSE a[i // 4 * 3 + i % 4 + 1] END", 256))
_tiled("decode_tga", "tga", 192, "00" * 2 + "02" + "00" * 9 + "08000800" + "1820", "", 8, 8, 2, _sql_values("CASE WHEN i % 4 = 3 THEN 255 ELSE a[i // 4 * 3 + 3 - i % 4] END", 256))
_tiled("decode_msp", "msp", 128, "44616e4d" + "20002000" + "00" * 24, "", 32, 32, 0, _sql_values("1 - (a[i // 8 + 1] >> (7 - i % 8) & 1)", 1024), "000000ffffff")


def decode_each_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header of every codec by itself: what is recognised, and with which error or size it ends."""
    rows = ", ".join(f"({i}, unhex('{x}'), {n})" for i, (_, x, n) in enumerate(HEADERS))
    made = spark.sql(f"SELECT i, concat(head, unhex(repeat('00', n - octet_length(head)))) AS content FROM VALUES {rows} AS t(i, head, n)")
    return decode(made, options=Options()).select("i", "codec", "ok", "error", "width", "height", "format")


QUERIES["decode_each_codec"] = decode_each_codec


def png_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles as RGB images (Sun raster), encoded as PNG and decoded again."""
    head = "59a66a95" + "00000008" * 2 + "00000018" + "000000c0" + "00000003" + "00000000" * 2
    files = tiles(spark, sf_dir, 192).withColumn("content", F.concat(_hex(head), F.col("content")))
    pngs = with_png(decode(files).select("doc_id", "tile", "ok", "width", "height", "format", "pixels", "palette", "subrects"))
    again = decode(pngs.select("doc_id", "tile", F.col("png").alias("content")))
    return again.select("doc_id", "tile", "codec", "width", "height", "format", fingerprint("width", "height", "format", "pixels", "palette").alias("fingerprint"))


QUERIES["png_round_trip"] = png_round_trip
ORACLES["png_round_trip"] = ORACLES["decode_sunrast"].replace("'sunrast' AS codec", "'png' AS codec")

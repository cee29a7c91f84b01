"""Raw layouts without headers: EGA and VGA Mode X. Native expressions over each row's bytes; a raster is never shuffled to be put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.columns import C, PLANE_ORDERS, bit, bytes_of, col, div, modex_offset, modex_plane, shl, shr

EGA_LAYOUTS, MODEX_LAYOUTS = ("graphic_planar", "row_planar", "byte_planar", "linear"), ("graphic_planar", "row_planar", "byte_planar", "linear")


def at(values: C, place: C | int) -> Column:
    """An element of an array, from 0."""
    return F.get(col(values), col(place).cast("int"))


def join_planes(bits: list[Column], order: tuple[int, ...] | None = None) -> Column:
    """An index of its bits, one from each plane; the first plane is the lowest bit unless order says otherwise."""
    out = F.lit(0)
    for p, b in enumerate(bits):
        out = out.bitwiseOR(shl(b, (order or range(8))[p]))
    return out


def ega_index(values: C, x: C, y: C, w: int, h: int, planes: int = 4, layout: str = "row_planar", order: str = "bgri", high_first: bool = True) -> Column:
    """The index of pixel (x, y) of an array of bytes in an EGA layout."""
    x, y, line = col(x), col(y), (w + 7) // 8
    if layout == "linear":
        byte = at(values, y * ((w + 1) // 2) + shr(x, 1))
        first = x.bitwiseAND(1) == (0 if high_first else 1)
        return F.when(first, shr(byte, 4)).otherwise(byte.bitwiseAND(15))
    place = {
        "graphic_planar": lambda p: F.lit(p * line * h) + y * line + shr(x, 3),
        "row_planar": lambda p: y * (line * planes) + p * line + shr(x, 3),
        "byte_planar": lambda p: (y * line + shr(x, 3)) * planes + p,
    }[layout]
    return join_planes([bit(at(values, place(p)), 7 - x.bitwiseAND(7)) for p in range(planes)], PLANE_ORDERS[order])


def modex_index(values: C, x: C, y: C, w: int, h: int, layout: str = "graphic_planar") -> Column:
    """The index of pixel (x, y) of an array of bytes in a Mode X layout."""
    x, y, line = col(x), col(y), (w + 3) // 4
    place = {
        "graphic_planar": modex_plane(x) * (line * h) + y * line + modex_offset(x),
        "row_planar": y * (line * 4) + modex_plane(x) * line + modex_offset(x),
        "byte_planar": y * (line * 4) + modex_offset(x) * 4 + modex_plane(x),
        "linear": y * w + x,
    }[layout]
    return at(values, place)


def st_index(values: C, x: C, y: C, w: int, planes: int) -> Column:
    """The index of pixel (x, y) of an Atari ST screen, whose planes alternate word by word."""
    x, y, words = col(x), col(y), (w + 15) // 16
    return join_planes([bit(at(values, y * (words * planes * 2) + shr(x, 4) * (planes * 2) + p * 2 + shr(x.bitwiseAND(15), 3)), 7 - x.bitwiseAND(7)) for p in range(planes)])


def spectrum_index(values: C, pixel: C) -> Column:
    """The index of the pixel with a number (line * 320 + column) in a Spectrum 512 screen: four planes, word by word."""
    byte = shr(pixel, 3)
    base = (byte - byte.bitwiseAND(1)) * 4 + byte.bitwiseAND(1)
    return join_planes([bit(at(values, base + 2 * p), 7 - col(pixel).bitwiseAND(7)) for p in range(4)])


def separate_index(values: C, x: C, y: C, line: int, plane_size: int, planes: int = 4) -> Column:
    """The index of pixel (x, y) where planes follow one another."""
    return join_planes([bit(at(values, col(y) * line + shr(x, 3) + p * plane_size), 7 - col(x).bitwiseAND(7)) for p in range(planes)])


def packed_index(values: C, x: C, bpp: int) -> Column:
    """The x-th index of packed bytes, 1, 2, 4 or 8 bits each, the first in the highest bits."""
    per = 8 // bpp
    return shr(at(values, div(x, per)), (per - 1 - col(x) % per) * bpp).bitwiseAND((1 << bpp) - 1)


def grid(df: DataFrame, w: int, h: int) -> DataFrame:
    """df with a row for each pixel (y, x) of a raster of w by h."""
    df = df.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(w * h - 1))))
    return df.withColumn("y", div("n", w)).withColumn("x", (F.col("n") % w).cast("int")).drop("n")


def pixels(df: DataFrame, index: Column, w: int, h: int, size: int, content: str = "content", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """(keep, y, x, idx) of each raster; inputs of fewer than size bytes have none. index refers to the columns a (bytes), x and y."""
    rows = df.where(F.octet_length(content) >= size).select(*keep, bytes_of(F.substring(F.col(content), 1, size)).alias("a"))
    return grid(rows, w, h).select(*keep, "y", "x", index.cast("int").alias("idx"))


def decode_ega_raw(df: DataFrame, w: int = 320, h: int = 200, planes: int = 4, layout: str = "row_planar", order: str = "bgri", high_first: bool = True, content: str = "content", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """Pixels of raw EGA screens."""
    if layout not in EGA_LAYOUTS or not 1 <= planes <= 4 or w < 1 or h < 1:
        raise ValueError("invalid_format")
    size = (w + 1) // 2 * h if layout == "linear" else (w + 7) // 8 * h * planes
    return pixels(df, ega_index("a", "x", "y", w, h, planes, layout, order, high_first), w, h, size, content, keep)


def decode_modex_raw(df: DataFrame, w: int = 320, h: int = 240, layout: str = "graphic_planar", content: str = "content", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """Pixels of raw Mode X screens."""
    if layout not in MODEX_LAYOUTS or w < 1 or h < 1:
        raise ValueError("invalid_format")
    size = w * h if layout == "linear" else (w + 3) // 4 * h * 4
    return pixels(df, modex_index("a", "x", "y", w, h, layout), w, h, size, content, keep)

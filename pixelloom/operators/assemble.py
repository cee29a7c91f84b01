"""Relational operators on pixels, palettes and images: joins, windows and aggregates that Catalyst plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions.columns import C, blend_rgb, byte_at, col, number_at, shl, shr


def merge_planes(bits: DataFrame, keys: list[str], plane: str = "plane", value: str = "bit") -> DataFrame:
    """Indices of bits that come a row for each plane: bit_or by pixel, summed before the shuffle."""
    return bits.groupBy(*keys).agg(F.bit_or(shl(F.col(value), F.col(plane))).alias("idx"))


def merge_plane_words(words: DataFrame, keys: list[str], width: int, height: int, line: str = "y", plane: str = "plane", word: str = "word") -> DataFrame:
    """The same (keys, y, x, idx) for lines of planes that come as words of width bits, a row for each plane and line; planes * width is 64 at most.

    An image's words, not its pixels, are shuffled: a row for each image, of a number for each line with all of its planes.
    """
    placed = shl(F.col(word).cast("long"), F.col(plane) * width)
    lines = words.groupBy(*keys).agg(F.array(*[F.bit_or(F.when(F.col(line) == y, placed)) for y in range(height)]).alias("lines"))
    rows = lines.select(*keys, F.posexplode("lines").alias("y", "v")).where("v IS NOT NULL")
    pixels = rows.select(*keys, "y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"), "v")
    bits = [shl(shr("v", F.lit(width * p + width - 1) - F.col("x")).bitwiseAND(1).cast("int"), p) for p in range(64 // width)]
    return pixels.select(*keys, "y", "x", reduce(Column.__add__, bits).alias("idx"))


def apply_palette(pixels: DataFrame, palette: DataFrame, on: list[str] | None = None) -> DataFrame:
    """pixels with r, g, b of palette (idx, r, g, b; with the columns on, if each image has its own); a missing colour is black.

    One palette has at most 256 rows and is broadcast; palettes by image are joined as Spark sees fit.
    """
    side = palette if on else F.broadcast(palette)
    joined = pixels.join(side, [*(on or []), "idx"], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("r", "g", "b")})


def histogram(pixels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return pixels.groupBy(*(keys or []), "idx").agg(F.count("*").alias("n"))


def hold_and_modify(pixels: DataFrame, palette: DataFrame, bits: int, keys: list[str]) -> DataFrame:
    """r, g, b of HAM codes (keys, x, idx): the two bits above the low ones choose palette colour, or new blue, red or green; other channels
    hold the last pixel's value in the row, or at its start the palette's first colour."""
    code, value = shr("idx", bits), F.col("idx").bitwiseAND((1 << bits) - 1)
    level = shl(value, 4).bitwiseOR(value) if bits == 4 else shl(value, 2)
    base = pixels.withColumn("value", value).withColumn("op", code)
    base = base.join(F.broadcast(palette.select(F.col("idx").alias("value"), F.col("r").alias("pr"), F.col("g").alias("pg"), F.col("b").alias("pb"))), "value", "left")
    first = palette.where("idx = 0").select(F.col("r").alias("fr"), F.col("g").alias("fg"), F.col("b").alias("fb"), F.lit(0).alias("one"))
    row = Window.partitionBy(*keys).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    held = {c: F.last(F.when(F.col("op") == 0, F.coalesce(F.col(f"p{c}"), F.lit(0))).when(F.col("op") == own, level), True).over(row) for c, own in (("r", 2), ("g", 3), ("b", 1))}
    out = base.select(*keys, "x", *[v.alias(c) for c, v in held.items()], F.lit(0).alias("one")).join(F.broadcast(first), "one")
    return out.select(*keys, "x", *[F.coalesce(F.col(c), F.col(f"f{c}")).alias(c) for c in "rgb"])


def half_brite(palette: DataFrame) -> DataFrame:
    """A palette and its half-bright copy, 32 colours on."""
    base = palette.where("idx < 32")
    return base.unionByName(base.select((F.col("idx") + 32).alias("idx"), *[shr(c, 1).alias(c) for c in "rgb"]))


def fill_greys(palette: DataFrame, n: int) -> DataFrame:
    """n colours: the palette's, and greys of the whole ramp for those it lacks."""
    ramp = palette.sparkSession.range(n).select(F.col("id").cast("int").alias("idx"), F.expr(f"cast(id * 255 div {max(1, n - 1)} as int)").alias("grey"))
    return ramp.join(F.broadcast(palette), "idx", "left").select("idx", *[F.coalesce(c, "grey").alias(c) for c in "rgb"])


def blend_frames(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """The mean of two frames of packed colours (keys, rgb)."""
    joined = first.join(second.withColumnRenamed("rgb", "rgb2"), keys)
    return joined.select(*keys, blend_rgb("rgb", "rgb2").alias("rgb"))


def multicolour_cell(bitmap: C, screen: C, colour: C, background: C, x: C) -> Column:
    """The C64 colour of pixel x of a byte of a cell: pairs of bits choose background, high or low half of screen, colour."""
    pair = shr(bitmap, 6 - col(x).bitwiseAND(6)).bitwiseAND(3)
    return F.when(pair == 0, col(background).bitwiseAND(15)).when(pair == 1, shr(screen, 4).bitwiseAND(15)).when(pair == 2, col(screen).bitwiseAND(15)).otherwise(col(colour).bitwiseAND(15))


def hires_cell(bitmap: C, screen: C, x: C) -> Column:
    """The C64 colour of pixel x of a byte of a cell: bit 1 the high half of screen, 0 the low."""
    return F.when(shr(bitmap, 7 - col(x).bitwiseAND(7)).bitwiseAND(1) == 1, shr(screen, 4).bitwiseAND(15)).otherwise(col(screen).bitwiseAND(15))


def cell_of(x: C, y: C) -> Column:
    return shr(y, 3) * 40 + shr(x, 3)


def fli_bank(y: C) -> Column:
    return shl(col(y).bitwiseAND(7), 10)


def flip(y: C, height: C) -> Column:
    return col(height) - 1 - col(y)


def interleave(samples: DataFrame, keys: list[str], channel: str = "channel", value: str = "v") -> DataFrame:
    """r, g, b of samples that come a row for each channel; a grey one alone is repeated."""
    by = {n: F.max(F.when(F.col(channel) == i, F.col(value))) for i, n in enumerate("rgb")}
    out = samples.groupBy(*keys).agg(*[v.alias(n) for n, v in by.items()])
    return out.withColumns({"g": F.coalesce("g", "r"), "b": F.coalesce("b", "r")})


def interleave_words(words: DataFrame, keys: list[str], parts: int, channel: str = "channel", part: str = "part", word: str = "word") -> DataFrame:
    """The same (keys, x, r, g, b) for samples that come eight to a word of 64 bits, the first in its highest bits; parts words make a channel's line.
    Words, not samples, are shuffled, a row for each line."""
    own = lambda i, k: F.max(F.when((F.col(channel) == i) & (F.col(part) == k), F.col(word)))
    lines = words.groupBy(*keys).agg(F.array(*[F.struct(*[own(i, k).alias(n) for i, n in enumerate("rgb")]) for k in range(parts)]).alias("parts"))
    rows = lines.select(*keys, F.posexplode("parts").alias("part", "w")).where("w.r IS NOT NULL OR w.g IS NOT NULL OR w.b IS NOT NULL")
    rows = rows.select(*keys, "part", "w.r", F.coalesce("w.g", "w.r").alias("g"), F.coalesce("w.b", "w.r").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    return rows.select(*keys, (F.col("part") * 8 + F.col("i")).alias("x"), *[shr(n, F.lit(56) - F.col("i") * 8).bitwiseAND(255).cast("int").alias(n) for n in "rgb"])


def is_ste(words: DataFrame, keys: list[str], word: str = "word") -> DataFrame:
    """Whether any colour of a palette uses a fourth bit."""
    return words.groupBy(*keys).agg(F.bool_or(F.col(word).bitwiseAND(0x0888) != 0).alias("ste"))


def mask_alpha(hidden: C) -> Column:
    return F.when(col(hidden) == 1, 0).otherwise(255)


def stack_atlas(parts: DataFrame, atlas: list[str], order: str, width: str = "w", height: str = "h") -> DataFrame:
    """Sub-images one below the other: parts with y (where each begins) and the atlas's width and height."""
    above = Window.partitionBy(*atlas).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*atlas)
    return parts.withColumns({"y": F.coalesce(F.sum(height).over(above), F.lit(0)), "atlas_w": F.max(width).over(whole), "atlas_h": F.sum(height).over(whole)})


def page_slices(pages: DataFrame, file: list[str], order: str, offset: str, length: Column) -> DataFrame:
    """Each page's start and size: up to the next page's offset, or the file's end. Offsets of 0 or beyond the file are left out first."""
    real = pages.where((F.col(offset) > 0) & (F.col(offset) < length))
    following = F.lead(offset).over(Window.partitionBy(*file).orderBy(order))
    return real.withColumn("size", F.coalesce(following, length) - F.col(offset))


def clip(pixels: DataFrame, w: C, h: C) -> DataFrame:
    """Pixels inside of a raster."""
    return pixels.where((F.col("x") >= 0) & (F.col("x") < col(w)) & (F.col("y") >= 0) & (F.col("y") < col(h)))


def ico_entries(files: DataFrame, content: str = "content") -> DataFrame:
    """A row for each entry of an ICO directory: index, w, h, size, offset."""
    n = number_at(content, 4, 2)
    rows = files.withColumn("index", F.explode(F.sequence(F.lit(0), n.cast("int") - 1)))
    base = 6 + 16 * F.col("index")
    side = lambda k: F.when(byte_at(content, base + k) == 0, 256).otherwise(byte_at(content, base + k))
    return rows.select("path", "index", side(0).alias("w"), side(1).alias("h"), number_at(content, base + 8, 4).alias("size"), number_at(content, base + 12, 4).alias("offset"))


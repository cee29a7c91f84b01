"""Scalar operators as Column expressions: bytes, strides, colour conversions, raw-layout arithmetic. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelloom.model import BYTES_PER_PIXEL, FORMATS

C = Column | str


def col(x: C | int) -> Column:
    return F.lit(x) if isinstance(x, int) else F.col(x) if isinstance(x, str) else x


def div(a: C | int, b: C | int) -> Column:
    """Integer division that cuts towards zero, as int."""
    return F.call_function("div", col(a).cast("long"), col(b).cast("long")).cast("int")


def shl(a: C | int, n: C | int) -> Column:
    return F.call_function("shiftleft", col(a), col(n).cast("int"))


def shr(a: C | int, n: C | int) -> Column:
    return F.call_function("shiftright", col(a), col(n).cast("int"))


def bit(a: C | int, n: C | int) -> Column:
    return shr(a, n).bitwiseAND(1)


def bytes_of(content: C) -> Column:
    """A binary's bytes as an array of int: read as Latin-1, split into characters, each character's code."""
    chars = F.split(F.decode(col(content), "ISO-8859-1"), "")
    return F.when(F.octet_length(col(content)) == 0, F.array().cast("array<int>")).otherwise(F.transform(chars, lambda c: F.ascii(c)))


def byte_at(content: C, at: C | int) -> Column:
    """The byte at a place of a binary, from 0; null beyond its end."""
    part = F.substring(col(content), col(at) + 1, F.lit(1))
    return F.when(F.octet_length(part) == 1, F.conv(F.hex(part), 16, 10).cast("int"))


def number_at(content: C, at: C | int, size: int, big: bool = False, signed: bool = False) -> Column:
    """A number of 1 to 4 bytes at a place of a binary, as long; null where it isn't whole."""
    part = F.substring(col(content), col(at) + 1, F.lit(size))
    digits = F.hex(part)
    if not big:
        digits = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in range(size - 1, -1, -1)])
    v = F.conv(digits, 16, 10).cast("long")
    if signed:
        v = F.when(v >= 1 << 8 * size - 1, v - (1 << 8 * size)).otherwise(v)
    return F.when(F.octet_length(part) == size, v)


def le32_bytes(x: C) -> Column:
    """An int as 4 bytes, the least first."""
    h = F.lpad(F.hex(col(x).cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, p, 2) for p in (7, 5, 3, 1)]))


def stride4(width: C, bpp: C | int) -> Column:
    return div(col(width) * col(bpp) + 31, 32) * 4


def stride2(width: C, bpp: C | int) -> Column:
    return div(col(width) * col(bpp) + 15, 16) * 2


def plane_row(width: C) -> Column:
    return div(col(width) + 15, 16) * 2


def bytes_per_pixel(format: C) -> Column:
    out = F.lit(0)
    for name, n in BYTES_PER_PIXEL.items():
        out = F.when(col(format) == name, n).otherwise(out)
    return out


def format_ordinal(format: C) -> Column:
    return F.array_position(F.lit(list(FORMATS)), col(format)).cast("int") - 1


def fingerprint(width: C, height: C, format: C, pixels: C, palette: C) -> Column:
    """MD5 of width, height and format ordinal as 32-bit integers, the pixels, and the palette of an indexed surface."""
    tail = F.when(col(format) == "indexed8", col(palette)).otherwise(F.unhex(F.lit("")))
    return F.md5(F.concat(le32_bytes(width), le32_bytes(height), le32_bytes(format_ordinal(format)), col(pixels), tail))


def _level(two_bits: Column) -> Column:
    return two_bits * 0x55


def ega_rgb(c: C) -> list[Column]:
    """r, g, b of a 6-bit EGA colour as the engine reads it (see palettes.ega_six_bits)."""
    return [_level(shl(bit(c, hi), 1) + bit(c, lo)) for hi, lo in ((3, 5), (2, 4), (1, 3))]


def vga_level(v: C) -> Column:
    return shl(v, 2).bitwiseOR(shr(v, 4)).bitwiseAND(255)


def _nibbles(word: C, mask: int) -> list[Column]:
    return [shr(word, s).bitwiseAND(mask) for s in (8, 4, 0)]


def amiga_rgb(word: C) -> list[Column]:
    return [n * 17 for n in _nibbles(word, 15)]


def st_rgb(word: C) -> list[Column]:
    return [shl(n, 5).bitwiseOR(shl(n, 2)).bitwiseOR(shr(n, 1)) for n in _nibbles(word, 7)]


def ste_rgb(word: C) -> list[Column]:
    return [(shl(n.bitwiseAND(7), 1) + shr(n, 3)) * 17 for n in _nibbles(word, 15)]


def blend_rgb(a: C, b: C) -> Column:
    """The mean of two packed colours, rounded down in each byte."""
    return col(a).bitwiseAND(col(b)) + shr(col(a).bitwiseXOR(col(b)), 1).bitwiseAND(0x7F7F7F)


def qoi_hash(r: C, g: C, b: C, a: C) -> Column:
    return (col(r) * 3 + col(g) * 5 + col(b) * 7 + col(a) * 11) % 64


def scale_sample(v: C, most: C) -> Column:
    return div(col(v) * 255, most)


def channel(value: C, mask: int) -> Column:
    """The channel under a mask of up to 8 bits, moved to the top of a byte; wider masks lose their low bits."""
    if not mask:
        return F.lit(0)
    zeros, ones = (mask & -mask).bit_length() - 1, mask.bit_count()
    v = shr(col(value).bitwiseAND(mask), zeros)
    return shl(v, 8 - ones) if ones <= 8 else shr(v, ones - 8)


#: Bits of planes in each order of EGA planes.
PLANE_ORDERS = {"bgri": (0, 1, 2, 3), "bgr": (0, 1, 2, 3), "rgbi": (2, 1, 0, 3), "rgb": (2, 1, 0, 3), "irgb": (3, 2, 1, 0)}


def ega_plane_bit(order: C, plane: C) -> Column:
    out = col(plane)
    for name, bits in PLANE_ORDERS.items():
        out = F.when(col(order) == name, F.element_at(F.lit(list(bits)), col(plane).cast("int") + 1)).otherwise(out)
    return out


def ega_raw_size(w: C, h: C, planes: C, linear: bool = False) -> Column:
    size = div(col(w) + 1, 2) * col(h) if linear else div(col(w) + 7, 8) * col(h) * col(planes)
    return F.when((col(w) > 0) & (col(h) > 0) & (F.lit(linear) | (col(planes) > 0)), size).otherwise(0)


def modex_raw_size(w: C, h: C, linear: bool = False) -> Column:
    size = col(w) * col(h) if linear else div(col(w) + 3, 4) * col(h) * 4
    return F.when((col(w) > 0) & (col(h) > 0), size).otherwise(0)


def modex_plane(x: C) -> Column:
    return col(x).bitwiseAND(3)


def modex_offset(x: C) -> Column:
    return shr(x, 2)


def spectrum_slot(c: C, x: C) -> Column:
    """Which of a line's 48 colours colour c is at column x (Spectrum 512)."""
    first = col(c) * 10 + 1 - col(c).bitwiseAND(1) * 6
    return col(c) + F.when(col(x) >= first + 160, 32).when(col(x) >= first, 16).otherwise(0)


def photochrome_slot(c: C, x: C) -> Column:
    """The same for Photochrome."""
    c2, x = col(c) * 2, col(x)
    late = F.when(c2 < 28, F.when(x < c2 * 2 + 76, 16).when(x >= 176 + c2 * 5 - c2.bitwiseAND(2) * 3, 48).otherwise(32)).when(x >= c2 * 2 + 92, 32).otherwise(16)
    return col(c) + F.when(x >= c2 * 2, late).otherwise(0)

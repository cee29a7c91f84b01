"""Built-in palettes: lists of 0xRRGGBB, and the same as DataFrames (idx, r, g, b)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

# Fixed values.
CGA = [
    0x000000, 0x0000AA, 0x00AA00, 0x00AAAA, 0xAA0000, 0xAA00AA, 0xAA5500, 0xAAAAAA,
    0x555555, 0x5555FF, 0x55FF55, 0x55FFFF, 0xFF5555, 0xFF55FF, 0xFFFF55, 0xFFFFFF,
]
CGA0_LOW = [0x000000, 0x00AA00, 0xAA0000, 0xAA5500]
CGA0_HIGH = [0x000000, 0x55FF55, 0xFF5555, 0xFFFF55]
CGA1_LOW = [0x000000, 0x00AAAA, 0xAA00AA, 0xAAAAAA]
CGA1_HIGH = [0x000000, 0x55FFFF, 0xFF55FF, 0xFFFFFF]
C64 = [
    0x000000, 0xFFFFFF, 0x68372B, 0x70A4B2, 0x6F3D86, 0x588D43, 0x352879, 0xB8C76F,
    0x6F4F25, 0x433900, 0x9A6759, 0x444444, 0x6C6C6C, 0x9AD284, 0x6C5EB5, 0x959595,
]
C64_COLODORE = [
    0x000000, 0xFFFFFF, 0x813338, 0x75CEC8, 0x8E3C97, 0x56AC4D, 0x2E2C9B, 0xEDF171,
    0x8E5029, 0x553800, 0xC46C71, 0x4A4A4A, 0x7B7B7B, 0xA9FF9F, 0x706DEB, 0xB2B2B2,
]
AMIGA_WB1 = [0x0055AA, 0xFFFFFF, 0x000000, 0xFF8800]
AMIGA_WB2 = [0x959595, 0x000000, 0xFFFFFF, 0x3B67A2]
AMIGA_WB3 = [0x959595, 0x000000, 0xFFFFFF, 0x3B67A2, 0x7B7B7B, 0xAFAFAF, 0xAA907C, 0xFFA997]
AMIGA_DPAINT = [
    0x000000, 0xFFFFFF, 0xFF0000, 0x00FF00, 0x0000FF, 0xFFFF00, 0xFF00FF, 0x00FFFF,
    0xAA0000, 0x00AA00, 0x0000AA, 0xAAAA00, 0xAA00AA, 0x00AAAA, 0xAAAAAA, 0x555555,
    0xFFAAAA, 0xAAFFAA, 0xAAAAFF, 0xFFFFAA, 0xFFAAFF, 0xAAFFFF, 0xFF5500, 0x00FF55,
    0x5500FF, 0xFF55AA, 0x55FF00, 0x0055FF, 0x884400, 0x448844, 0x444488, 0x888888,
]
ATARI_ST = [
    0xFFFFFF, 0xFF0000, 0x00FF00, 0xFFFF00, 0x0000FF, 0xFF00FF, 0x00FFFF, 0xB6B6B6,
    0x494949, 0x920000, 0x009200, 0x929200, 0x000092, 0x920092, 0x009292, 0x000000,
]
#: Colours of CGA modes 4 and 5 as places in CGA: mode 4 palettes 1 and 2, mode 5, of low and then of high intensity.
CGA_MODES = [[0, 3, 5, 7], [0, 2, 4, 6], [0, 3, 4, 7], [0, 11, 13, 15], [0, 10, 12, 14], [0, 11, 12, 15]]
VGA_HUES = [(63, 0, 0), (63, 31, 0), (63, 63, 0), (0, 63, 0), (0, 63, 63), (0, 0, 63), (31, 0, 63), (63, 0, 63)]
EGA_LEVELS = (0x00, 0x55, 0xAA, 0xFF)


def pack(r: int, g: int, b: int) -> int:
    return r << 16 | g << 8 | b


def ega_six_bits(c: int) -> int:
    """The engine's reading of a 6-bit EGA colour: high bits from bits 3, 2, 1 and low bits from bits 5, 4, 3 of c."""
    return pack(*(EGA_LEVELS[(c >> hi & 1) << 1 | c >> lo & 1] for hi, lo in ((3, 5), (2, 4), (1, 3))))


def ega_hardware(c: int) -> int:
    """A 6-bit EGA colour as the hardware has it: bits 2, 1, 0 count two thirds, bits 5, 4, 3 one third."""
    return pack(*(0xAA * (c >> hi & 1) + 0x55 * (c >> lo & 1) for hi, lo in ((2, 5), (1, 4), (0, 3))))


def grey(n: int) -> list[int]:
    return [i * 255 // (n - 1) * 0x010101 for i in range(n)] if n > 1 else [0] * n


def _vga6(v: int) -> int:
    return v << 2 | v >> 4


def vga_default() -> list[int]:
    """16 CGA colours, 16 greys, then 8 hues of 3 saturations of 8 intensities, and greys in what is left."""
    out = CGA + [_vga6(i * 63 // 15) * 0x010101 for i in range(16)]
    for hue in VGA_HUES:
        for saturation in range(3):
            for intensity in range(1, 9):
                rgb = [c * intensity * 8 // 64 for c in hue]
                if saturation:
                    mean = sum(rgb) // 3
                    rgb = [c + int((mean - c) / (2 * saturation)) for c in rgb]
                out.append(pack(*map(_vga6, rgb)))
    return (out + [_vga6((i - 224) * 63 // 31) * 0x010101 for i in range(len(out), 256)])[:256]


PALETTES = {
    "cga": CGA, "cga0_low": CGA0_LOW, "cga0_high": CGA0_HIGH, "cga1_low": CGA1_LOW, "cga1_high": CGA1_HIGH, "ega_default": CGA,
    "ega_full": [ega_six_bits(c) for c in range(64)], "ega_hardware": [ega_hardware(c) for c in range(64)], "vga_default": vga_default(),
    "c64": C64, "c64_colodore": C64_COLODORE, "amiga_wb1": AMIGA_WB1, "amiga_wb2": AMIGA_WB2, "amiga_wb3": AMIGA_WB3, "amiga_dpaint": AMIGA_DPAINT,
    "atari_st": ATARI_ST, "grey2": grey(2), "grey4": grey(4), "grey16": grey(16), "grey256": grey(256),
}


def rgb(colours: list[int]) -> np.ndarray:
    """Colours as an array (n, 3) of bytes."""
    c = np.array(colours, np.int64)
    return np.stack([c >> 16, c >> 8 & 255, c & 255], -1).astype(np.uint8)


def frame(spark: SparkSession, name: str) -> DataFrame:
    """A palette as rows (idx, r, g, b); at most 256, so fit to be broadcast."""
    rows = ", ".join(f"({i}, {c >> 16}, {c >> 8 & 255}, {c & 255})" for i, c in enumerate(PALETTES[name]))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(idx, r, g, b)")

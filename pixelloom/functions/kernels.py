"""numpy twins of the pixel operators, for bulk decoding inside Arrow functions."""

from __future__ import annotations

import numpy as np


def u8(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8)


def le16(d: bytes, at: int) -> int:
    return int.from_bytes(d[at : at + 2], "little")


def le32(d: bytes, at: int) -> int:
    return int.from_bytes(d[at : at + 4], "little")


def be16(d: bytes, at: int) -> int:
    return int.from_bytes(d[at : at + 2], "big")


def be32(d: bytes, at: int) -> int:
    return int.from_bytes(d[at : at + 4], "big")


def stride4(width: int, bpp: int) -> int:
    return (width * bpp + 31) // 32 * 4


def stride2(width: int, bpp: int) -> int:
    return (width * bpp + 15) // 16 * 2


def packed(rows: np.ndarray, width: int, bpp: int) -> np.ndarray:
    """Indices of packed rows (height, bytes), 1, 2, 4 or 8 bits each, first pixel in the highest bits."""
    if bpp == 8:
        return rows[:, :width]
    per = 8 // bpp
    shifts = np.arange(8 - bpp, -1, -bpp, dtype=np.uint8)
    return ((rows[:, :, None] >> shifts) & ((1 << bpp) - 1)).reshape(len(rows), -1)[:, :width] if per else rows


def planes_to_indices(planes: np.ndarray, width: int) -> np.ndarray:
    """Indices of bit planes (height, planes, bytes), the first plane in the lowest bit."""
    bits = np.unpackbits(planes, axis=2)[:, :, :width]
    out = np.zeros((len(bits), bits.shape[2]), np.uint8 if planes.shape[1] <= 8 else np.int64)
    for i in range(planes.shape[1]):
        out |= bits[:, i].astype(out.dtype) << out.dtype.type(i)
    return out


def word_planes(bitmap: np.ndarray, width: int, height: int, planes: int) -> np.ndarray:
    """Indices of a raster whose planes alternate word by word."""
    words = (width + 15) // 16
    rows = bitmap[: height * words * planes * 2].reshape(height, words, planes, 2)
    return planes_to_indices(rows.transpose(0, 2, 1, 3).reshape(height, planes, words * 2), width).astype(np.uint8)


def vga(v: np.ndarray) -> np.ndarray:
    """6-bit levels to 8 bits."""
    v = v.astype(np.int64)
    return ((v << 2 | v >> 4) & 255).astype(np.uint8)


def st_rgb(words: np.ndarray) -> np.ndarray:
    """RGB of words with 3 bits for each channel."""
    v = np.stack([(words >> s) & 7 for s in (8, 4, 0)], -1).astype(np.int64)
    return (v << 5 | v << 2 | v >> 1).astype(np.uint8)


def ste_rgb(words: np.ndarray) -> np.ndarray:
    """RGB of words with 4 bits for each channel, of which the highest is the least."""
    v = np.stack([(words >> s) & 15 for s in (8, 4, 0)], -1).astype(np.int64)
    v = (v & 7) << 1 | v >> 3
    return (v << 4 | v).astype(np.uint8)


def blend(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The mean of two frames, rounded down in each byte."""
    return ((a.astype(np.uint16) + b) >> 1).astype(np.uint8)


def hold_and_modify(codes: np.ndarray, palette: np.ndarray, bits: int) -> np.ndarray:
    """RGB of rows of codes whose two highest bits say: palette colour, or the last pixel with another blue, red or green."""
    op, value = codes >> bits, codes & ((1 << bits) - 1)
    level = (value << 4 | value) if bits == 4 else value << 2
    h, w = codes.shape
    out = np.empty((h, w, 3), np.uint8)
    if h > w:  # column by column
        ops, values, levels = (np.ascontiguousarray(x.T) for x in (op, np.minimum(value, len(palette) - 1), level.astype(np.uint8)))
        for channel, own in ((0, 2), (1, 3), (2, 1)):
            colours, held = np.ascontiguousarray(palette[:, channel]), np.full(h, palette[0, channel], np.uint8)
            for x in range(w):
                held = np.where(ops[x] == 0, colours[values[x]], np.where(ops[x] == own, levels[x], held))
                out[:, x, channel] = held
        return out
    base = palette[np.minimum(value, len(palette) - 1)]
    for channel, own in ((0, 2), (1, 3), (2, 1)):
        set_here = (op == 0) | (op == own)
        new = np.where(op == 0, base[:, :, channel], level)
        at = np.maximum.accumulate(np.where(set_here, np.arange(w)[None, :], -1), axis=1)
        held = np.take_along_axis(new, np.maximum(at, 0), axis=1)
        out[:, :, channel] = np.where(at < 0, palette[0, channel], held)
    return out


def cells(bitmap: np.ndarray, height: int = 200) -> np.ndarray:
    """Rows (height, 40 bytes) of a raster stored by cells of 8 rows of a byte."""
    return bitmap[: height * 40].reshape(height // 8, 40, 8).transpose(0, 2, 1).reshape(height, 40)


def spread(per_cell: np.ndarray, height: int = 200) -> np.ndarray:
    """A value for each cell (40 to a row) as one for each line and column of cells."""
    return np.repeat(per_cell[: height // 8 * 40].reshape(height // 8, 40), 8, axis=0)


def multicolour(bitmap: np.ndarray, high: np.ndarray, low: np.ndarray, colour: np.ndarray, background: int, shift: int = 0) -> np.ndarray:
    """Indices (height, 2 pixels to a pair) of rows (height, columns): 00 background, 01 high, 10 low, 11 colour, moved right by shift pixels."""
    pairs = packed(bitmap, bitmap.shape[1] * 4, 2)
    wide = [np.repeat(x, 4, axis=1) for x in (high, low, colour)]
    out = np.repeat(np.choose(pairs, [np.full_like(pairs, background & 15), *wide]), 2, axis=1)
    if shift:
        out = np.concatenate([np.full((len(out), shift), background & 15, out.dtype), out[:, :-shift]], axis=1)
    return out


def two_colour(bitmap: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Indices of rows (height, columns): bit 1 high, 0 low."""
    bits = np.unpackbits(bitmap, axis=1)
    return np.where(bits == 1, np.repeat(high, 8, axis=1), np.repeat(low, 8, axis=1))

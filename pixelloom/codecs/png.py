"""PNG: a reader of all colour types, depths and interlacing, and a writer, on zlib alone."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from pixelloom.functions.kernels import packed, u8
from pixelloom.model import DecodeError, Options, Surface, need, surface

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels of each colour type, and the places (x, y) and steps of Adam7's passes.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _unfilter(data: bytes, at: int, height: int, line: int, bpp: int) -> tuple[np.ndarray, int]:
    out, above = np.zeros((height, line), np.uint8), np.zeros(line, np.uint8)
    for y in range(height):
        kind, row = data[at], u8(data[at + 1 : at + 1 + line])
        need(len(row) == line and kind <= 4, "invalid_format", "PNG data damaged")
        at += 1 + line
        if kind == 0:
            new = row
        elif kind == 2:
            new = row + above
        elif kind == 1:
            pad = -line % bpp
            new = np.cumsum(np.concatenate([row, np.zeros(pad, np.uint8)]).reshape(-1, bpp), axis=0, dtype=np.uint8).reshape(-1)[:line]
        else:
            cur, up, raw = bytearray(line), above.tobytes(), row.tobytes()
            for i in range(line):
                a, b = cur[i - bpp] if i >= bpp else 0, up[i]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    c = up[i - bpp] if i >= bpp else 0
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                cur[i] = (raw[i] + guess) & 255
            new = u8(bytes(cur))
        out[y] = above = new
    return out, at


def png(d: bytes, options: Options = Options()) -> Surface:
    """Always rgba8888. 16-bit samples keep their high byte; checksums aren't verified."""
    need(d[:8] == SIGNATURE, "invalid_format", "Not a valid PNG file")
    need(len(d) >= 33 and d[12:16] == b"IHDR", "invalid_format", "Invalid PNG header")
    w, h, depth, kind, _, _, interlaced = struct.unpack_from(">IIBBBBB", d, 16)
    need(0 < w < 1 << 31 and 0 < h < 1 << 31 and kind in CHANNELS and depth in (1, 2, 4, 8, 16), "invalid_format", "Invalid PNG header")
    options.check(w, h)
    at, idat, palette, trans = 8, [], b"", b""
    while at + 8 <= len(d):
        size, name = struct.unpack_from(">I4s", d, at)
        body = d[at + 8 : at + 8 + size]
        if name == b"IDAT":
            idat.append(body)
        elif name == b"PLTE":
            palette = body
        elif name == b"tRNS":
            trans = body
        elif name == b"IEND":
            break
        at += 12 + size
    n = CHANNELS[kind]
    line = lambda width: (width * n * depth + 7) // 8
    passes = [(x, y, sx, sy, -(-(w - x) // sx), -(-(h - y) // sy)) for x, y, sx, sy in (ADAM7 if interlaced else ((0, 0, 1, 1),)) if w > x and h > y]
    size = sum(ph * (1 + line(pw)) for *_, pw, ph in passes)
    try:
        data = zlib.decompressobj().decompress(b"".join(idat), size)
    except zlib.error:
        raise DecodeError("invalid_format", "PNG data damaged") from None
    need(len(data) == size, "truncated_data", "PNG data truncated")
    samples, at = np.zeros((h, w, n), np.int64), 0
    for x, y, sx, sy, pw, ph in passes:
        rows, at = _unfilter(data, at, ph, line(pw), max(1, n * depth // 8))
        part = rows.view(">u2") if depth == 16 else packed(rows, pw * n, depth)
        samples[y::sy, x::sx] = part[:, : pw * n].reshape(ph, pw, n)
    out = np.full((h, w, 4), 255, np.uint8)
    if kind == 3:
        table = np.zeros((256, 4), np.uint8)
        table[:, 3] = 255
        own = u8(palette[: len(palette) // 3 * 3]).reshape(-1, 3)[:256]
        need(samples.max() < len(own), "invalid_format", "PNG palette index out of range")
        table[: len(own), :3] = own
        table[: min(len(trans), 256), 3] = u8(trans)[:256]
        return surface(table[samples[:, :, 0]], "rgba8888")
    v = samples >> 8 if depth == 16 else samples * 255 // ((1 << depth) - 1)
    colours = 1 if kind in (0, 4) else 3
    out[:, :, :3] = v[:, :, :colours]
    if kind in (4, 6):
        out[:, :, 3] = v[:, :, -1]
    elif len(trans) >= 2 * colours:
        out[(samples == np.frombuffer(trans, ">u2", colours)).all(2), 3] = 0
    return surface(out, "rgba8888")


def encode(s: Surface) -> bytes:
    """A PNG of 8-bit RGBA; indices beyond the palette are black."""
    px = s.array()
    out = np.full((s.height, s.width, 4), 255, np.uint8)
    if s.format == "indexed8":
        table = np.zeros((256, 3), np.uint8)
        own = u8(s.palette[: len(s.palette) // 3 * 3]).reshape(-1, 3)[:256]
        table[: len(own)] = own
        out[:, :, :3] = table[px[:, :, 0]]
    else:
        out[:, :, : px.shape[2]] = px
    rows = np.concatenate([np.zeros((s.height, 1), np.uint8), out.reshape(s.height, -1)], 1)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = struct.pack(">IIBBBBB", s.width, s.height, 8, 6, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")

"""PC and workstation formats: PCX, DCX, BMP, Sun Raster, Pictor, SGI, PNM, MSP, QOI."""

from __future__ import annotations

import re
import struct

import numpy as np

from pixelloom.functions import kernels as k
from pixelloom.model import BYTES_PER_PIXEL, MAX_PAGES, MAX_QOI_PIXELS, DecodeError, Options, Surface, narrow, need, surface
from pixelloom.operators import rle
from pixelloom.plans import palettes as p

PCX_MODES = {(1, 1), (2, 1), (3, 1), (4, 1), (1, 2), (1, 4), (1, 8), (3, 8)}  # planes, bits


def pcx_header(d: bytes, options: Options) -> dict:
    need(len(d) >= 128 and d[0] == 10 and d[1] in (0, 2, 3, 4, 5) and d[2] <= 1, "invalid_format", "Not a valid PCX file")
    x0, y0, x1, y1 = struct.unpack_from("<4H", d, 4)
    h = {"version": d[1], "bits": d[3], "planes": d[65], "line": k.le16(d, 66), "width": x1 - x0 + 1, "height": y1 - y0 + 1}
    need(h["width"] > 0 and h["height"] > 0, "invalid_format", "Invalid image dimensions")
    options.check(h["width"], h["height"])
    need(h["bits"] in (1, 2, 4, 8), "unsupported_bit_depth", "Unsupported bits per pixel")
    need(1 <= h["planes"] <= 4, "unsupported_encoding", "Unsupported number of planes")
    return h


def pcx(d: bytes, options: Options = Options()) -> Surface:
    """Always run-length decoded, whatever the encoding byte says."""
    h = pcx_header(d, options)
    planes, bits, line = h["planes"], h["bits"], h["line"]
    need((planes, bits) in PCX_MODES, "unsupported_encoding", "Unsupported PCX plane/bit combination")
    end = len(d) - 769 if h["version"] == 5 and (planes, bits) == (1, 8) and len(d) >= 769 else len(d)
    need(line * planes > 0, "truncated_data", "Truncated PCX scanline")
    lines, at = [], 128
    for _ in range(h["height"]):
        row, at = rle.or_fail("truncated_data", "Truncated PCX scanline", rle.pcx_line, d, at, end, line * planes)
        lines.append(row)
    raw = k.u8(b"".join(lines)).reshape(h["height"], planes, line)
    return pcx_surface(h, raw, pcx_palette(h, d))


def pcx_palette(h: dict, d: bytes) -> bytes | np.ndarray:
    planes, bits = h["planes"], h["bits"]
    if (planes, bits) == (3, 8):
        return b""
    if (planes, bits) == (1, 8):
        tail = d[-769:] if len(d) >= 769 else b""
        need(bool(tail), "truncated_data", "PCX file too small: missing VGA palette")
        return tail[1:] if tail[0] == 12 else p.rgb(p.grey(256))
    if (planes, bits) == (1, 2):
        low, high = ((p.CGA1_LOW, p.CGA1_HIGH), (p.CGA0_LOW, p.CGA0_HIGH))[d[19] >> 5 & 1]
        return p.rgb([p.CGA[d[16] >> 4], *(low if d[19] >> 4 & 1 else high)[1:]])
    return d[16:64]


def pcx_surface(h: dict, raw: np.ndarray, palette: bytes | np.ndarray) -> Surface:
    """Of lines (height, planes, bytes), however many."""
    planes, bits, width = h["planes"], h["bits"], h["width"]
    if (planes, bits) == (3, 8):
        return surface(_fit(raw, width).transpose(0, 2, 1), "rgb888")
    if planes > 1 or bits == 1:
        indices = k.planes_to_indices(_fit(raw, (width + 7) // 8), width)
    else:
        indices = k.packed(_fit(raw[:, 0], (width * bits + 7) // 8), width, bits)
    return surface(indices, "indexed8", palette)


def _fit(a: np.ndarray, n: int) -> np.ndarray:
    """The first n of the last axis, zeros where there are fewer."""
    return a[..., :n] if a.shape[-1] >= n else np.concatenate([a, np.zeros((*a.shape[:-1], n - a.shape[-1]), a.dtype)], -1)


def dcx(d: bytes, options: Options = Options()) -> Surface:
    """Pages one below the other, with a frame for each; the first page's palette. Pages with bad headers are left out, others that can't be
    decoded leave zeros in their place; indexed pages among RGB ones are copied as index bytes."""
    need(len(d) >= 4 and k.le32(d, 0) == 0x3ADE68B1, "invalid_format", "Not a valid DCX file")
    offsets = []
    for at in range(4, min(len(d) - 3, 4 + 4 * (MAX_PAGES + 1)), 4):
        if (o := k.le32(d, at)) == 0:
            break
        if o < len(d) and len(offsets) < MAX_PAGES:
            offsets.append(o)
    need(bool(offsets), "invalid_format", "No pages in DCX file")
    pages = []
    for a, b in zip(offsets, [*offsets[1:], len(d)]):
        try:
            part = d[a : b if b > a else len(d)]
            pages.append((part, pcx_header(part, options)))
        except DecodeError as e:
            if e.kind == "dimensions_exceeded":
                raise
    need(bool(pages), "invalid_format", "No valid pages in DCX file")
    width, height = max(h["width"] for _, h in pages), sum(h["height"] for _, h in pages)
    options.check(width, height)
    format = "rgb888" if any(h["bits"] * h["planes"] > 8 for _, h in pages) else "indexed8"
    size = BYTES_PER_PIXEL[format]
    atlas, palette, frames, y = np.zeros((height, width * size), np.uint8), b"", [], 0
    for i, (part, h) in enumerate(pages):
        try:
            s = pcx(part, options)
        except DecodeError:
            s = None
        if s:
            rows = s.array().reshape(s.height, -1)[:, : width * size]
            atlas[y : y + s.height, : rows.shape[1]] = rows
            if i == 0 and format == "indexed8":
                palette = s.palette
            frames.append({"index": i, "x": 0, "y": y, "w": s.width, "h": s.height, "kind": "frame", "user_tag": i})
        else:
            frames.append({"index": i, "x": 0, "y": 0, "w": 0, "h": 0, "kind": "sprite", "user_tag": 0})
        y += h["height"]
    while frames and frames[-1]["w"] == 0:
        frames.pop()
    return surface(atlas.reshape(height, width, size), format, palette, frames)


def _mask_channel(v: np.ndarray, mask: int) -> np.ndarray:
    if not mask:
        return np.zeros(v.shape, np.uint8)
    zeros, ones = (mask & -mask).bit_length() - 1, mask.bit_count()
    c = (v.astype(np.int64) & mask) >> zeros
    return ((c << 8 - ones if ones <= 8 else c >> ones - 8) & 255).astype(np.uint8)


def bmp_header(d: bytes) -> dict:
    need(len(d) >= 26 and d[:2] == b"BM", "invalid_format", "Not a valid BMP file")
    size = k.le32(d, 14)
    need(size == 12 or size >= 40, "invalid_format", "Failed to parse BMP header")
    need(len(d) >= 14 + min(size, 108), "invalid_format", "Failed to parse BMP header")
    h = {"data": k.le32(d, 10), "size": size, "compression": 0, "entry": 4, "masks": [0, 0, 0], "alpha": 0}
    if size == 12:
        h["width"], h["height"], h["bits"] = *struct.unpack_from("<hh", d, 18), k.le16(d, 24)
        h["entry"] = 3
        h["colours"] = min(max(0, h["data"] - 26) // 3, 1 << h["bits"]) if h["bits"] <= 8 else 0
    else:
        h["width"], h["height"], h["bits"], h["compression"], h["colours"] = *struct.unpack_from("<ii", d, 18), k.le16(d, 28), k.le32(d, 30), k.le32(d, 46)
        if size == 64:
            h["width"], h["height"] = struct.unpack_from("<II", d, 18)
        if not h["colours"] and h["bits"] <= 8:
            h["colours"] = 1 << h["bits"]
        if size == 64 and h["bits"] <= 8:
            h["entry"] = 4 if max(0, h["data"] - 78) // max(1, h["colours"]) >= 4 else 3
        elif size >= 52 and size != 64:
            h["masks"] = list(struct.unpack_from("<3I", d, 54))
            h["alpha"] = k.le32(d, 66) if size >= 56 else 0
        if h["compression"] == 3 and not any(h["masks"]) and len(d) >= 14 + size + 12:
            h["masks"] = list(struct.unpack_from("<3I", d, 14 + size))
    h["top_down"], h["height"] = h["height"] < 0, abs(h["height"])
    if h["compression"] != 3 and h["bits"] == 16:
        h["masks"] = [0x7C00, 0x03E0, 0x001F]
    return h


def bmp(d: bytes, options: Options = Options()) -> Surface:
    h = bmp_header(d)
    w, height, bits = h["width"], h["height"], h["bits"]
    need(w > 0 and height > 0, "invalid_format", "Invalid image dimensions")
    options.check(w, height)
    need(h["data"] < len(d), "truncated_data", "Invalid data offset")
    palette, data = bmp_palette(h, d), d[h["data"] :]
    if h["compression"] in (1, 2):
        rows = k.u8(rle.bmp_rle(data, w, height, 8 if h["compression"] == 1 else 4)).reshape(height, w)[::-1]
        return surface(rows, "indexed8", palette) if bits <= 8 and palette is not None else narrow(rows)
    stride = k.stride4(w, bits)
    need(stride * height <= len(data), "truncated_data", "Unexpected end of data")
    rows = k.u8(data[: stride * height]).reshape(height, stride)
    return bmp_surface(h, rows if h["top_down"] else rows[::-1], palette)


def bmp_palette(h: dict, d: bytes) -> bytes | None:
    palette, n = None, h["colours"]
    if h["bits"] <= 8 and n:
        at, size = 14 + h["size"], n * h["entry"]
        if at + size <= min(h["data"], len(d)):
            palette = k.u8(d[at : at + size]).reshape(n, -1)[:, 2::-1]
            palette = palette.tobytes() if n <= 256 else b""
    return palette


def bmp_surface(h: dict, rows: np.ndarray, palette: bytes | None) -> Surface:
    """Of rows from the top, however many, that aren't packed."""
    w, height, bits = h["width"], len(rows), h["bits"]
    if bits <= 8:
        rows = k.packed(rows, w, bits) if bits in (1, 2, 4, 8) else np.zeros((height, w), np.uint8)
        return surface(rows, "indexed8", palette) if palette is not None else narrow(rows)
    out = np.full((height, w, 4), 255, np.uint8)
    if bits == 16:
        v = np.ascontiguousarray(rows[:, : w * 2]).view("<u2")
        for c, mask in enumerate(h["masks"]):
            out[:, :, c] = _mask_channel(v, mask & 0xFFFF)
    elif bits in (24, 32):
        px = rows[:, : w * bits // 8].reshape(height, w, bits // 8)
        out[:, :, :3] = px[:, :, 2::-1]
        if bits == 32 and h["alpha"]:
            out[:, :, 3] = px[:, :, 3]
    else:
        out[:] = 0
    return surface(out, "rgba8888")


def sunrast_header(d: bytes, options: Options) -> dict:
    need(d[:4] == b"\x59\xa6\x6a\x95" and len(d) >= 32, "invalid_format", "Not a valid Sun Raster file")
    w, height, depth, _, kind, map_kind, map_size = struct.unpack_from(">7I", d, 4)
    need(0 < w < 1 << 31 and 0 < height < 1 << 31, "invalid_format", "Invalid image dimensions")
    options.check(w, height)
    need(depth in (1, 4, 8, 24, 32), "invalid_format", f"Unsupported bit depth: {depth}")
    need(kind in (0, 1, 2, 3), "invalid_format", f"Unsupported raster type: {kind}")
    at = 32 + map_size
    need(at <= len(d), "truncated_data", "Sun Raster data truncated: incomplete file header")
    n = map_size // 3 if map_kind == 1 else 0
    palette = k.u8(d[32 : 32 + 3 * n]).reshape(3, n).T.tobytes() if n else b""
    return {"width": w, "height": height, "depth": depth, "kind": kind, "data": at, "palette": palette, "stride": k.stride2(w, depth)}


def sunrast(d: bytes, options: Options = Options()) -> Surface:
    h = sunrast_header(d, options)
    stride, height, data = h["stride"], h["height"], d[h["data"] :]
    if h["kind"] == 2:
        data = rle.or_fail("truncated_data", "RLE decompression failed - truncated data", rle.sun, data, stride * height)
    need(len(data) >= stride * height, "truncated_data", "Unexpected end of data")
    return sunrast_surface(h, k.u8(data[: stride * height]).reshape(height, stride))


def sunrast_surface(h: dict, rows: np.ndarray) -> Surface:
    """Of rows, however many."""
    w, height, depth, palette = h["width"], len(rows), h["depth"], h["palette"]
    if depth <= 8:
        rows = k.packed(rows, w, depth)
        if depth == 1 and not palette:
            palette = b"\0\0\0\xff\xff\xff"
        return surface(rows, "indexed8", palette if len(palette) <= 768 else b"") if palette else narrow(rows)
    px = rows[:, : w * depth // 8].reshape(height, w, depth // 8)[:, :, depth // 8 - 3 :]
    rgb = px if h["kind"] == 3 else px[:, :, ::-1]
    return surface(np.concatenate([rgb, np.full((height, w, 1), 255, np.uint8)], 2), "rgba8888")


def pictor_header(d: bytes, options: Options) -> dict:
    need(d[:2] == b"\x34\x12", "invalid_format", "Not a valid PICTOR file")
    need(len(d) >= 17, "invalid_format", "Failed to parse PICTOR header")
    w, height, bits, planes = k.le16(d, 2), k.le16(d, 4), d[10] & 15, (d[10] >> 4) + 1
    kind, size = k.le16(d, 13), k.le16(d, 15)
    need(w > 0 and height > 0, "invalid_format", "Invalid image dimensions")
    options.check(w, height)
    need(planes == 1 and bits in (1, 2, 4, 8) or planes == 4 and bits == 1, "invalid_format", "Unsupported PICTOR planes or bits")
    at = 17 + size
    need(at + 2 <= len(d), "truncated_data", "PICTOR data truncated: incomplete file header")
    n, given = 1 << bits * planes, k.u8(d[17:at])
    hardware, cga = p.PALETTES["ega_hardware"], lambda mode: [p.CGA[i] for i in p.CGA_MODES[mode]]
    palette = np.zeros((n, 3), np.uint8)
    if kind == 4 and size >= 768:
        palette[:256] = k.vga(given[: 3 * min(256, n)]).reshape(-1, 3)
    elif kind == 3 and size >= 16:
        chosen = p.rgb([hardware[c & 63] for c in given[: min(16, n)].tolist()])
        palette[: len(chosen)] = chosen
    elif kind == 1 and size >= 1:
        chosen = p.rgb(cga(int(given[0]) if given[0] < 6 else 0))[:n]
        palette[: len(chosen)] = chosen
    elif size >= 3 * n:
        palette = k.vga(given[: 3 * n]).reshape(n, 3)
    else:
        palette = p.rgb({2: p.grey(2), 4: cga(0), 16: hardware[:16]}.get(n) or p.grey(n))
    return {"width": w, "height": height, "bits": bits, "planes": planes, "data": at, "palette": palette, "stride": (w * bits + 7) // 8}


def pictor(d: bytes, options: Options = Options()) -> Surface:
    h = pictor_header(d, options)
    at, planes, height, stride = h["data"], h["planes"], h["height"], h["stride"]
    total, blocks = stride * height * planes, k.le16(d, at)
    data = rle.pictor_blocks(d, at + 2, blocks, total) if blocks else (d[at + 2 : at + 2 + total]).ljust(total, b"\0")
    return pictor_surface(h, k.u8(data).reshape(planes, height, stride)[:, ::-1])


def pictor_surface(h: dict, raw: np.ndarray) -> Surface:
    """Of planes (planes, height, bytes) from the top, however high."""
    rows = k.packed(raw[0], h["width"], h["bits"]) if h["planes"] == 1 else k.planes_to_indices(raw.transpose(1, 0, 2), h["width"])
    return surface(rows, "indexed8", h["palette"])


def sgi(d: bytes, options: Options = Options()) -> Surface:
    need(d[:2] == b"\x01\xda", "invalid_format", "Not a valid SGI file")
    need(len(d) >= 512, "invalid_format", "Failed to parse SGI header")
    stored, unit, w, height, channels = d[2], d[3], k.be16(d, 6), k.be16(d, 8), k.be16(d, 10)
    need(w > 0 and height > 0, "invalid_format", "Invalid image dimensions")
    need(unit in (1, 2), "unsupported_bit_depth", f"Unsupported bytes per channel: {unit}")
    need(1 <= channels <= 4, "invalid_format", f"Unsupported number of channels: {channels}")
    need(k.be32(d, 104) == 0, "unsupported_encoding", "Unsupported colormap type")
    options.check(w, height)
    rows = height * channels
    if stored == 1:
        need(len(d) >= 512 + 8 * rows, "truncated_data", "SGI data truncated: incomplete RLE offset tables")
        table = np.frombuffer(d, ">u4", 2 * rows, 512).astype(np.int64)
        parts = []
        for start, length in zip(table[:rows].tolist(), table[rows:].tolist()):
            need(start + length <= len(d), "truncated_data", "SGI RLE data truncated")
            parts.append(rle.or_fail("truncated_data", "SGI RLE decode failed", rle.sgi, d[start : start + length], w, unit))
        raw = k.u8(b"".join(parts))
    else:
        need(len(d) >= 512 + rows * w * unit, "truncated_data", "SGI data truncated")
        raw = k.u8(d[512 : 512 + rows * w * unit])
    px = raw.reshape(channels, height, w, unit)[:, ::-1, :, 0].transpose(1, 2, 0)
    if channels <= 2:
        px = np.concatenate([px[:, :, :1]] * 3 + [px[:, :, 1:]], 2)
    return surface(px, "rgb888" if channels in (1, 3) else "rgba8888")


_PNM_TOKEN = re.compile(rb"(?:[ \t\n\v\f\r]|#[^\n]*(?:\n|$))*(\d+)")


def pnm_header(d: bytes, options: Options) -> dict:
    need(len(d) >= 3 and d[0] == 80 and 49 <= d[1] <= 54 and chr(d[2]) in " \t\n\v\f\r", "invalid_format", "Not a valid PNM file")
    kind, at, head = d[1] - 48, 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _PNM_TOKEN.match(d, at)
        need(m is not None, "invalid_format", "Failed to parse PNM header")
        head.append(int(m[1]))
        at = m.end()
    w, height, most = head[0], head[1], head[2] if len(head) > 2 else 1
    need(0 < w < 1 << 31 and 0 < height < 1 << 31 and 0 < most < 65536, "invalid_format", "Invalid PNM dimensions")
    options.check(w, height)
    channels, unit = 3 if kind in (3, 6) else 1, 2 if most > 255 else 1
    size = (w + 7) // 8 * height if kind == 4 else w * height * channels * unit
    data = len(d) - len(d[at:].lstrip(b" \t\n\v\f\r"))
    return {"kind": kind, "width": w, "height": height, "most": most, "channels": channels, "unit": unit, "size": size, "data": data}


def pnm(d: bytes, options: Options = Options()) -> Surface:
    """All six kinds to RGB. After a binary kind's header all white space is passed over, pixel bytes that look like it too."""
    h = pnm_header(d, options)
    kind, n, body = h["kind"], h["width"] * h["height"] * h["channels"], d[h["data"] :]
    if kind in (2, 3):
        found = re.findall(rb"\d+", body)[:n]
        need(len(found) == n, "truncated_data", "Unexpected end of data")
        return _pnm_levels(h, np.array(found).astype(np.int64) * 255 // h["most"])
    body = body.translate(None, b" \t\n\v\f\r")[:n] if kind == 1 else body[: h["size"]]
    need(len(body) == (n if kind == 1 else h["size"]), "truncated_data", "Unexpected end of data")
    return pnm_surface(h, k.u8(body).reshape(h["height"], -1))


def pnm_surface(h: dict, rows: np.ndarray) -> Surface:
    """Of rows of digits (kind 1) or of a binary kind, however many."""
    if h["kind"] == 1:
        return _pnm_levels(h, (rows == 48) * np.int64(255))
    if h["kind"] == 4:
        return _pnm_levels(h, (1 - np.unpackbits(rows, axis=1)[:, : h["width"]].astype(np.int64)) * 255)
    return _pnm_levels(h, np.ascontiguousarray(rows).view(">u2" if h["unit"] == 2 else np.uint8).astype(np.int64) * 255 // h["most"])


def _pnm_levels(h: dict, v: np.ndarray) -> Surface:
    v = (v & 255).astype(np.uint8).reshape(-1, h["width"], h["channels"])
    return surface(v if h["channels"] == 3 else np.repeat(v, 3, 2), "rgb888")


def msp(d: bytes, options: Options = Options()) -> Surface:
    need(len(d) >= 32 and d[:4] in (b"DanM", b"LinS"), "invalid_format", "Not a valid MSP file")
    w, height = k.le16(d, 4), k.le16(d, 6)
    need(w > 0 and height > 0, "invalid_format", "Invalid image dimensions")
    options.check(w, height)
    stride = (w + 7) // 8
    if d[:4] == b"DanM":
        need(len(d) >= 32 + stride * height, "truncated_data", "Unexpected end of data")
        raw = d[32 : 32 + stride * height]
    else:
        at = 32 + 2 * height
        need(len(d) >= at, "truncated_data", "MSP row table truncated")
        rows = []
        for y in range(height):
            size = k.le16(d, 32 + 2 * y)
            need(at + size <= len(d), "truncated_data", "Unexpected end of data")
            rows.append(rle.or_fail("unsupported_encoding", "MSP RLE decode failed", rle.msp_row, d[at : at + size], stride))
            at += size
        raw = b"".join(rows)
    bits = np.unpackbits(k.u8(raw).reshape(height, stride), axis=1)[:, :w]
    return surface(1 - bits, "indexed8", b"\0\0\0\xff\xff\xff")


def qoi_header(d: bytes, options: Options) -> tuple[int, int, int]:
    """Width, height and channels."""
    need(len(d) >= 14 and d[:4] == b"qoif", "invalid_format", "Not a valid QOI file")
    w, height, channels = k.be32(d, 4), k.be32(d, 8), d[12]
    need(w > 0 and height > 0 and channels in (3, 4) and d[13] <= 1, "invalid_format", "Failed to parse QOI header")
    options.check(w, height)
    need(w * height <= MAX_QOI_PIXELS, "dimensions_exceeded", "QOI image too large")
    need(len(d) >= 22, "truncated_data", "QOI data truncated")
    return w, height, channels


def qoi(d: bytes, options: Options = Options()) -> Surface:
    """Where the input ends early the last pixel repeats."""
    w, height, channels = qoi_header(d, options)
    seen: list[tuple[int, int, int, int]] = [(0, 0, 0, 0)] * 64
    r, g, b, a = 0, 0, 0, 255
    pixels, lengths, left, at, end = [], [], w * height, 14, len(d) - 8
    while left > 0:
        n = 1
        if at < end:
            op = d[at]
            at += 1
            if op == 0xFE:
                r, g, b = d[at : at + 3]
                at += 3
            elif op == 0xFF:
                r, g, b, a = d[at : at + 4]
                at += 4
            elif op < 0x40:
                r, g, b, a = seen[op]
            elif op < 0x80:
                r, g, b = (r + (op >> 4 & 3) - 2) & 255, (g + (op >> 2 & 3) - 2) & 255, (b + (op & 3) - 2) & 255
            elif op < 0xC0:
                dg, low = (op & 63) - 32, d[at]
                at += 1
                r, g, b = (r + dg - 8 + (low >> 4)) & 255, (g + dg) & 255, (b + dg - 8 + (low & 15)) & 255
            else:
                n = (op & 63) + 1
            seen[(r * 3 + g * 5 + b * 7 + a * 11) % 64] = (r, g, b, a)
        else:
            n = left
        n = min(n, left)
        pixels.append((r, g, b, a))
        lengths.append(n)
        left -= n
    px = np.repeat(np.array(pixels, np.uint8), lengths, axis=0).reshape(height, w, 4)
    return surface(px[:, :, :channels], "rgb888" if channels == 3 else "rgba8888")

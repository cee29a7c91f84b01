"""Icons: ICO and CUR files, and the icon resources of executables (NE, PE). All images one below the other, with a sprite for each."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

from pixelloom.codecs.png import png
from pixelloom.functions import kernels as k
from pixelloom.model import MAX_ICON_SIDE, DecodeError, Options, Surface, need, surface


def image(d: bytes, options: Options) -> np.ndarray:
    """RGBA of one icon, PNG or bitmap with its two masks; DecodeError if it is neither."""
    if d[:4] == b"\x89PNG":
        return png(d, options).array()
    need(len(d) >= 40, "truncated_data", "Icon truncated")
    size, w, h, _, bits, packing, _, _, _, used = struct.unpack_from("<IiiHHIIiiI", d)
    h = abs(h)
    need(packing == 0 and bits in (1, 4, 8, 16, 24, 32) and h >= 2 and h % 2 == 0, "invalid_format", "Unsupported icon bitmap")
    h //= 2
    need(0 < w <= MAX_ICON_SIDE and h <= MAX_ICON_SIDE and size <= len(d), "invalid_format", "Invalid icon bitmap")
    colours = min(used, 1 << bits) if used and bits <= 8 else used or (1 << bits if bits <= 8 else 0)
    stride, mask_stride, at = k.stride4(w, bits), k.stride4(w, 1), size + 4 * colours
    need(at + stride * h <= len(d), "truncated_data", "Icon truncated")
    rows = k.u8(d[at : at + stride * h]).reshape(h, stride)[::-1]
    out = np.full((h, w, 4), 255, np.uint8)
    if bits <= 8:
        table = np.zeros((256, 3), np.uint8)
        table[:colours] = k.u8(d[size:at]).reshape(-1, 4)[:, 2::-1]
        out[:, :, :3] = table[k.packed(rows, w, bits)]
    elif bits == 16:
        v = np.ascontiguousarray(rows[:, : 2 * w]).view("<u2").astype(np.int64)
        out[:, :, :3] = np.stack([(v >> s & 31) << 3 for s in (10, 5, 0)], 2)
    else:
        px = rows[:, : w * bits // 8].reshape(h, w, bits // 8)
        out[:, :, :3] = px[:, :, 2::-1]
        if bits == 32:
            out[:, :, 3] = px[:, :, 3]
    at += stride * h
    if bits < 32 and at + mask_stride * h <= len(d):
        hidden = np.unpackbits(k.u8(d[at : at + mask_stride * h]).reshape(h, mask_stride)[::-1], axis=1)[:, :w]
        out[hidden == 1, 3] = 0
    return out


def stack(images: list[np.ndarray], options: Options) -> Surface:
    need(bool(images), "invalid_format", "No valid icons found")
    w, h = max(i.shape[1] for i in images), sum(i.shape[0] for i in images)
    atlas, rects, y = np.zeros((h, w, 4), np.uint8), [], 0
    for n, i in enumerate(images):
        atlas[y : y + i.shape[0], : i.shape[1]] = i
        rects.append({"index": n, "x": 0, "y": y, "w": i.shape[1], "h": i.shape[0], "kind": "sprite", "user_tag": n})
        y += i.shape[0]
    return surface(atlas, "rgba8888", b"", rects)


def _images(parts: Iterator[bytes], options: Options) -> list[np.ndarray]:
    limits, out = Options(options.max_width or MAX_ICON_SIDE, options.max_height or MAX_ICON_SIDE), []
    for part in parts:
        try:
            found = image(part, limits)
            limits.check(found.shape[1], found.shape[0])
            out.append(found)
        except DecodeError:  # it is left out
            continue
    return out


def ico(d: bytes, options: Options = Options()) -> Surface:
    """Entries beyond the limits, outside of the file or not to be decoded are left out."""
    need(len(d) >= 6 and k.le16(d, 0) == 0 and k.le16(d, 2) in (1, 2) and k.le16(d, 4) > 0, "invalid_format", "Not a valid ICO/CUR file")
    n = k.le16(d, 4)
    need(len(d) >= 6 + 16 * n, "truncated_data", "ICO directory truncated")

    def parts() -> Iterator[bytes]:
        for i in range(n):
            at = 6 + 16 * i
            size, offset = struct.unpack_from("<II", d, at + 8)
            if (d[at] or 256) <= (options.max_width or 256) and (d[at + 1] or 256) <= (options.max_height or 256) and size and offset + size <= len(d):
                yield d[offset : offset + size]

    return stack(_images(parts(), options), options)


def _ne(d: bytes, at: int) -> Iterator[bytes]:
    """Icon resources (type 3) of a 16-bit executable."""
    table = at + k.le16(d, at + 36)
    shift, table = k.le16(d, table), table + 2
    while table + 8 <= len(d) and (kind := k.le16(d, table)):
        n = k.le16(d, table + 2)
        for i in range(n):
            entry = table + 8 + 12 * i
            if kind == 0x8003 and entry + 12 <= len(d):
                offset, size = k.le16(d, entry) << shift, k.le16(d, entry + 2) << shift
                yield d[offset : offset + size]
        table += 8 + 12 * n


def _pe(d: bytes, at: int) -> Iterator[bytes]:
    """Icon resources (type 3) of a 32- or 64-bit executable, in the order of the resource tree."""
    sections, optional = k.le16(d, at + 6), k.le16(d, at + 20)
    directory = at + 24 + (112 if k.le16(d, at + 24) == 0x20B else 96) + 16
    rva = k.le32(d, directory)
    spans = [struct.unpack_from("<4I", d, at + 24 + optional + 40 * i + 8) for i in range(sections) if at + 24 + optional + 40 * i + 40 <= len(d)]

    def place(address: int) -> int:
        for size, start, raw, offset in spans:
            if start <= address < start + max(size, raw):
                return address - start + offset
        return len(d)

    root = place(rva)

    def entries(node: int) -> Iterator[tuple[int, int]]:
        if node + 16 <= len(d):
            for i in range(k.le16(d, node + 12) + k.le16(d, node + 14)):
                if node + 24 + 8 * i <= len(d):
                    yield struct.unpack_from("<II", d, node + 16 + 8 * i)

    def leaves(node: int, depth: int) -> Iterator[int]:
        for _, to in entries(node):
            if to & 0x80000000 and depth < 3:
                yield from leaves(root + (to & 0x7FFFFFFF), depth + 1)
            elif not to & 0x80000000:
                yield root + to

    for kind, to in entries(root):
        if kind == 3 and to & 0x80000000:
            for leaf in leaves(root + (to & 0x7FFFFFFF), 1):
                if leaf + 8 <= len(d):
                    a = place(k.le32(d, leaf))
                    yield d[a : a + k.le32(d, leaf + 4)]


def executable_kind(d: bytes) -> bytes:
    """NE, PE or LX; empty for anything else."""
    if len(d) < 64 or d[:2] != b"MZ":
        return b""
    mark = d[k.le32(d, 60) :][:4]
    return b"PE" if mark == b"PE\0\0" else mark[:2] if mark[:2] in (b"NE", b"LX") else b""


def exe_icon(d: bytes, options: Options = Options()) -> Surface:
    """LX executables are recognised, but their resources aren't read."""
    kind = executable_kind(d)
    need(bool(kind), "invalid_format", "Not a valid executable with icons")
    try:
        parts = list((_ne if kind == b"NE" else _pe)(d, k.le32(d, 60))) if kind != b"LX" else []
    except struct.error:
        raise DecodeError("truncated_data", "Executable truncated") from None
    return stack(_images(iter(parts), options), options)

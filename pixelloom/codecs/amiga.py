"""Amiga IFF images: ILBM (planar, HAM, extra half-brite, true colour) and PBM (chunky)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from pixelloom.functions import kernels as k
from pixelloom.model import Options, Surface, narrow, need, surface
from pixelloom.operators import rle
from pixelloom.plans import palettes as p


def chunks(d: bytes) -> Iterator[tuple[str, bytes, int, int]]:
    """(form, chunk id, offset, length) of a FORM's chunks, each padded to even length; a chunk beyond the input is cut off."""
    form, at, end = d[8:12].decode("latin-1"), 12, min(len(d), 8 + k.be32(d, 4))
    while at + 8 <= end:
        size = k.be32(d, at + 4)
        yield form, d[at : at + 4], at + 8, min(size, len(d) - at - 8)
        at += 8 + size + (size & 1)


def palette_of(cmap: bytes, n: int) -> np.ndarray:
    """n colours: those of the chunk, greys of the whole ramp for the rest."""
    out = p.rgb(p.grey(n))
    have = k.u8(cmap[: len(cmap) // 3 * 3]).reshape(-1, 3)[:n]
    out[: len(have)] = have
    return out


def half_brite(cmap: bytes) -> np.ndarray:
    base = palette_of(cmap, 32)
    return np.concatenate([base, base >> 1])


def lbm(d: bytes, options: Options = Options()) -> Surface:
    need(len(d) >= 12 and d[:4] == b"FORM" and d[8:12] in (b"ILBM", b"PBM "), "invalid_format", "Not a valid IFF ILBM/PBM file")
    found: dict[bytes, bytes] = {}
    for _, name, at, size in chunks(d):
        if name in (b"BMHD", b"CMAP", b"CAMG", b"BODY"):
            found[name] = d[at : at + size]
    h, body = lbm_header(found, d[8:12], options), found[b"BODY"]
    line, n, packing = h["line"], h["rows"], h["packing"]
    if packing and not h["chunky"] and not rle.byterun1_fits(body, line, n):  # commands run on from plane to plane
        line, n = line * h["stored"], h["height"]
    rows = _rows(body, packing, line, n)
    need(rows is not None, "truncated_data", "Invalid ByteRun1 data" if packing and not h["chunky"] else "Unexpected end of data")
    return lbm_surface(h, rows)


def lbm_header(found: dict[bytes, bytes], form: bytes, options: Options) -> dict:
    """What the chunks BMHD, CMAP and CAMG say; rows of line bytes make the body."""
    head, camg = found.get(b"BMHD", b""), found.get(b"CAMG", b"")
    need(len(head) >= 20, "invalid_format", "Missing BMHD chunk")
    need(bool(found.get(b"BODY", b"")), "invalid_format", "Missing BODY chunk")
    w, height, planes, masking, packing = k.be16(head, 0), k.be16(head, 2), head[8], head[9], head[10]
    need(planes > 0, "invalid_format", "Invalid number of planes")
    need(packing <= 1, "unsupported_encoding", "Unsupported compression")
    options.check(w, height)
    need(w > 0 and height > 0, "internal_error", "Failed to allocate surface")
    h = {"width": w, "height": height, "planes": planes, "masking": masking, "packing": packing, "cmap": found.get(b"CMAP", b""), "mode": k.be32(camg, 0) if len(camg) >= 4 else 0}
    if form == b"PBM ":
        need(masking == 0, "unsupported_encoding", "PBM with masking not supported")
        return h | {"chunky": True, "stored": 1, "line": w, "rows": height}
    need(planes <= 8 or planes in (24, 32), "unsupported_bit_depth", "Unsupported bit depth")
    stored = planes + (masking == 1)
    return h | {"chunky": False, "stored": stored, "line": (w + 15) // 16 * 2, "rows": height * stored}


def lbm_surface(h: dict, rows: np.ndarray) -> Surface:
    """Of rows of bytes, however many lines they make."""
    w, planes, masking, cmap = h["width"], h["planes"], h["masking"], h["cmap"]
    if h["chunky"]:
        return surface(rows, "indexed8", palette_of(cmap, 1 << planes) if planes <= 8 else b"")
    raw = rows.reshape(-1, h["stored"], h["line"])
    height = len(raw)
    if planes in (24, 32):
        out = np.full((height, w, 4), 255, np.uint8)
        for c in range(planes // 8):
            out[:, :, c] = k.planes_to_indices(raw[:, 8 * c : 8 * c + 8], w)
        if masking == 1:
            mask = k.planes_to_indices(raw[:, planes : planes + 1], w)
            out[:, :, 3] = np.where(mask, out[:, :, 3] if planes == 32 else 255, 0)
        return surface(out, "rgba8888")
    indices = k.planes_to_indices(raw[:, :planes], w)
    if h["mode"] & 0x800:
        if planes not in (6, 8):
            return narrow(indices.astype(np.uint8))
        rgb = k.hold_and_modify(indices, palette_of(cmap, 16 if planes == 6 else 64), planes - 2)
        return surface(np.concatenate([rgb, np.full((height, w, 1), 255, np.uint8)], 2), "rgba8888")
    return surface(indices, "indexed8", half_brite(cmap) if h["mode"] & 0x80 and planes == 6 else palette_of(cmap, 1 << planes))


def _rows(body: bytes, packing: int, size: int, n: int) -> np.ndarray | None:
    """n rows of size bytes; None if the body has fewer or a command passes a row's end."""
    if not packing:
        return k.u8(body[: size * n]).reshape(n, size) if len(body) >= size * n else None
    at, out = 0, []
    try:
        for _ in range(n):
            row, at = rle.byterun1(body, at, size)
            out.append(row)
    except rle.Short:
        return None
    return k.u8(b"".join(out)).reshape(n, size)

"""Commodore 64 formats. All give RGB."""

from __future__ import annotations

import numpy as np

from pixelloom.functions import kernels as k
from pixelloom.model import Options, Surface, need, surface
from pixelloom.operators import rle
from pixelloom.plans import palettes as p

PALETTE = p.rgb(p.C64)
SIDE = (320, 200)
FUNPAINT, DRAZLACE = b"FUNPAINT (MT) ", b"DRAZLACE! 1.0"
FUNPAINT_SIZE, DRAZLACE_SIZE, KOALA_SIZE = 33694, 18242, 10001


def _rgb(indices: np.ndarray) -> Surface:
    return surface(PALETTE[indices & 15], "rgb888")


def _cells(d: bytes, at: int, n: int = 1000) -> np.ndarray:
    return k.spread(k.u8(d)[at : at + n])


def _bits(d: bytes, at: int) -> np.ndarray:
    return k.cells(k.u8(d)[at : at + 8000])


def _multicolour(d: bytes, bitmap: int, screen: int, colour: int, background: int, shift: int = 0) -> np.ndarray:
    s = _cells(d, screen)
    return k.multicolour(_bits(d, bitmap), s >> 4, s & 15, _cells(d, colour) & 15, background, shift)


def _hires(d: bytes, bitmap: int, screen: int | None) -> np.ndarray:
    s = np.full((200, 40), 0x10, np.uint8) if screen is None else _cells(d, screen)
    return k.two_colour(_bits(d, bitmap), s >> 4, s & 15)


def koala(d: bytes, options: Options = Options()) -> Surface:
    """Raw by size, else packed with escape FE."""
    need(bool(d), "truncated_data", "Koala file is empty")
    at = {10001: 0, 10003: 2, 10006: 2, 10018: 2}.get(len(d))
    if at is None:
        need(packed_koala(d), "invalid_format", "Unrecognized Koala file size")
        d, at = rle.or_fail("truncated_data", "Failed to decompress GG Koala data", rle.escaped, d, 2, 0xFE, KOALA_SIZE, False), 0
    options.check(*SIDE)
    colour, background = (9010, 9009) if len(d) == 10018 else (at + 9000, at + 10000)
    return _rgb(_multicolour(d, at, at + 8000, colour, d[background]))


def packed_koala(d: bytes) -> bool:
    return 100 <= len(d) < 10001 and k.le16(d, 0) in (0x6000, 0x4000, 0x2000, 0x5C00) and b"\xfe" in d[2:]


def runpaint(d: bytes, options: Options = Options()) -> Surface:
    need(len(d) in (10003, 10006), "invalid_format", "Invalid Run Paint size")
    options.check(*SIDE)
    return _rgb(_multicolour(d, 2, 8002, 9002, d[10002]))


def interpaint(d: bytes, options: Options = Options()) -> Surface:
    need(len(d) in (9002, 9003, 9009, 10003), "invalid_format", "Invalid InterPaint size")
    options.check(*SIDE)
    return runpaint(d, options) if len(d) == 10003 else _rgb(_hires(d, 2, 8002))


def ami(d: bytes, options: Options = Options()) -> Surface:
    need(bool(d), "truncated_data", "Amica Paint file is empty")
    need(len(d) >= 100 and k.le16(d, 0) == 0x4000, "invalid_format", "Not a valid Amica Paint file")
    options.check(*SIDE)
    d = rle.or_fail("truncated_data", "Failed to decompress Amica Paint data", rle.escaped, d, 2, 0xC2, KOALA_SIZE, True)
    return _rgb(_multicolour(d, 0, 8000, 9000, d[10000]))


def c64_doodle(d: bytes, options: Options = Options()) -> Surface:
    need(bool(d), "truncated_data", "Doodle file is empty")
    options.check(*SIDE)
    if len(d) in (9026, 9217, 9218, 9346):
        need(len(d) >= 0x402 + 8000, "truncated_data", "Doodle data truncated")
        return _rgb(_hires(d, 0x402, 2))
    need(100 <= len(d) < 9026, "invalid_format", "Unrecognized Doodle file size")
    d = rle.or_fail("truncated_data", "Failed to decompress Doodle data", rle.escaped, d, 2, 0xFE, 9024, False)
    return _rgb(_hires(d, 0x400, 0))


def c64_hires(d: bytes, options: Options = Options()) -> Surface:
    need(len(d) in (8002, 8194, 9002, 9003, 9009), "invalid_format", "Invalid C64 hires size")
    options.check(*SIDE)
    return _rgb(_hires(d, 2, 8002 if len(d) >= 9002 else None))


def funpaint(d: bytes, options: Options = Options()) -> Surface:
    """Two FLI frames, the second a pixel to the right, blended. Each line of a cell has its own screen bank; the first 3 columns aren't shown."""
    need(bool(d), "truncated_data", "FunPaint file is empty")
    need(d[2:16] == FUNPAINT, "invalid_format", "Missing FunPaint signature")
    options.check(296, 200)
    need(len(d) >= 18, "truncated_data", "FunPaint file too small: expected at least 18 bytes")
    if d[16]:
        d = rle.or_fail("truncated_data", "Failed to decompress FunPaint data", rle.escaped, d, 18, d[17], FUNPAINT_SIZE, True, d[:18])
    need(len(d) == FUNPAINT_SIZE, "invalid_format", "Invalid uncompressed FunPaint size")
    a = k.u8(d)

    def frame(bitmap: int, matrix: int, shift: int) -> np.ndarray:
        banks = np.stack([a[matrix + 1024 * i : matrix + 1024 * i + 1000].reshape(25, 40) for i in range(8)], 1).reshape(200, 40)[:, 3:]
        return PALETTE[k.multicolour(_bits(d, bitmap)[:, 3:], banks >> 4, banks & 15, _cells(d, 0x4012)[:, 3:] & 15, 0, shift)]

    return surface(k.blend(frame(0x2012, 0x12, 0), frame(0x63FA, 0x43FA, 1)), "rgb888")


def drazlace(d: bytes, options: Options = Options()) -> Surface:
    """Two multicolour frames with one screen, the second moved by 0 or 1 pixels, blended."""
    need(bool(d), "truncated_data", "DrazLace file is empty")
    if d[2:15] == DRAZLACE and len(d) >= 16:
        d = rle.or_fail("truncated_data", "Failed to decompress DrazLace data", rle.escaped, d, 16, d[15], DRAZLACE_SIZE, True, d[:2])
    need(len(d) == DRAZLACE_SIZE, "invalid_format", "Unrecognized DrazLace file format")
    need(d[0x2744] <= 1, "invalid_format", "Invalid DrazLace shift value")
    options.check(*SIDE)
    a, b = (PALETTE[_multicolour(d, at, 0x402, 2, d[0x2742], shift)] for at, shift in ((0x802, 0), (0x2802, d[0x2744])))
    return surface(k.blend(a, b), "rgb888")

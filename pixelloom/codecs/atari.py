"""Atari ST formats: NEOchrome, DEGAS, Crack Art, Tiny Stuff, Spectrum 512, Photochrome, Doodle."""

from __future__ import annotations

import numpy as np

from pixelloom.functions import kernels as k
from pixelloom.model import Options, Surface, need, surface
from pixelloom.operators import rle

SCREEN, LINES, PHOTOCHROME_PALETTES = 32000, 199, (199 * 3 + 1) * 32
#: Width, height, planes and colours of low, medium and high resolution.
RESOLUTIONS = ((320, 200, 4, 16), (640, 200, 2, 4), (640, 400, 1, 2))


def _resolution(n: int, options: Options, name: str) -> tuple[int, int, int, int]:
    need(n < 3, "unsupported_version", f"Unsupported {name} resolution")
    options.check(*RESOLUTIONS[n][:2])
    return RESOLUTIONS[n]


def _words(d: bytes, at: int, n: int) -> np.ndarray:
    return np.frombuffer(d, ">u2", n, at).astype(np.int64)


def _screen(bitmap: bytes, d: bytes, palette_at: int, mode: tuple[int, int, int, int]) -> Surface:
    w, h, planes, colours = mode
    return surface(k.word_planes(k.u8(bitmap), w, h, planes), "indexed8", k.st_rgb(_words(d, palette_at, colours)))


def neo(d: bytes, options: Options = Options()) -> Surface:
    need(len(d) == 32128 and d[:2] == b"\0\0", "invalid_format", "Invalid NEO file")
    return _screen(d[128:], d, 4, _resolution(k.be16(d, 2), options, "NEO"))


def degas(d: bytes, options: Options = Options()) -> Surface:
    need(len(d) >= 34, "truncated_data", "DEGAS file too small")
    need(d[0] in (0, 0x80), "invalid_format", "Invalid DEGAS header")
    mode = _resolution(d[1], options, "DEGAS")
    w, h, planes, _ = mode
    if d[0] == 0:
        need(len(d) >= 34 + SCREEN, "truncated_data", "DEGAS data truncated")
        return _screen(d[34 : 34 + SCREEN], d, 2, mode)
    flat = rle.or_fail("unsupported_encoding", "DEGAS decompression failed", rle.packbits, d, 34, SCREEN)
    lines = k.u8(flat).reshape(h, planes, w // 8)
    return surface(k.planes_to_indices(lines, w), "indexed8", k.st_rgb(_words(d, 2, mode[3])))


def crack_art(d: bytes, options: Options = Options()) -> Surface:
    """In high resolution the two palette words are read where the bitmap begins, for there is no palette."""
    need(len(d) >= 8 and d[:2] == b"CA", "invalid_format", "Invalid Crack Art signature")
    need(d[2] <= 1 and d[3] <= 2, "unsupported_version", "Unsupported Crack Art compression/resolution")
    mode = _resolution(d[3], options, "Crack Art")
    at = 4 + (32, 8, 0)[d[3]]
    need(len(d) >= 4 + 2 * mode[3], "truncated_data", "Crack Art data truncated")
    if d[2]:
        bitmap = rle.or_fail("unsupported_encoding", "CA decompression failed", rle.crack_art, d, at)
    else:
        need(len(d) == at + SCREEN, "invalid_format", "Invalid uncompressed CA size")
        bitmap = d[at:]
    return _screen(bitmap, d, 4, mode)


def tiny_stuff(d: bytes, options: Options = Options()) -> Surface:
    """In high resolution a line is 80 bytes of the unpacked screen."""
    need(len(d) >= 42, "truncated_data", "TNY file too small")
    need(d[0] <= 5, "unsupported_version", "Invalid TNY mode")
    at = 4 if d[0] > 2 else 0
    control, values = k.be16(d, at + 33), 2 * k.be16(d, at + 35)
    need(at + 37 + control + values <= len(d), "truncated_data", "TNY file truncated")
    mode = _resolution(d[0] % 3, options, "TNY")
    middle = at + 37 + control
    bitmap = rle.or_fail("unsupported_encoding", "TNY decompression failed", rle.tiny, d[at + 37 : middle], d[middle : middle + values])
    return _screen(bitmap, d, at + 1, mode)


def doodle(d: bytes, options: Options = Options()) -> Surface:
    need(len(d) == SCREEN, "invalid_format", "Invalid Doodle size")
    options.check(640, 400)
    bits = np.unpackbits(k.u8(d).reshape(400, 80), axis=1)
    return surface(np.repeat(((1 - bits) * 255)[:, :, None], 3, 2), "rgb888")


def spectrum_slot(c: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of a line's 48 colours colour c is at column x: three sets of 16 follow each other, at places that depend on c."""
    first = c * 10 + 1 - (c & 1) * 6
    return c + 16 * (x >= first) + 16 * (x >= first + 160)


def photochrome_slot(c: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The same for Photochrome, whose sets change at other places, up to three times a line."""
    c2 = c * 2
    early = c2 < 28
    n = (x >= c2 * 2).astype(np.int64)
    second = n.astype(bool) & np.where(early, x >= c2 * 2 + 76, x >= c2 * 2 + 92)
    third = second & early & (x >= 176 + c2 * 5 - (c2 & 2) * 3)
    return c + 16 * (n + second + third)


def spectrum512(d: bytes, options: Options = Options()) -> Surface:
    options.check(320, LINES)
    if len(d) >= 12 and d[:2] == b"SP":
        data = bytearray(SCREEN)
        need(len(d) > 12 + k.be32(d, 4), "invalid_format", "Invalid SPC palette offset")
        flat = k.u8(rle.or_fail("unsupported_encoding", "SPC bitmap decompression failed", rle.spc, d, 12, 4 * 7960))
        planes = flat.reshape(4, 3980, 2).transpose(1, 0, 2)
        data[160:] = planes.tobytes()
        at, colours = 12 + k.be32(d, 4), bytearray()
        for _ in range(LINES * 3):
            need(at + 1 < len(d), "truncated_data", "SPC palette truncated")
            mask, at = k.be16(d, at) & 0x7FFF, at + 2
            for i in range(16):
                if mask >> i & 1:
                    need(at + 1 < len(d), "truncated_data", "SPC palette truncated")
                    colours += d[at : at + 2]
                    at += 2
                else:
                    colours += b"\0\0"
        whole = bytes(data) + bytes(colours)
    else:
        need(len(d) == 51104, "invalid_format", "Invalid Spectrum 512 format")
        whole = d
    c = k.word_planes(k.u8(whole[160:SCREEN]), 320, LINES, 4).astype(np.int64)
    slot = spectrum_slot(c, np.arange(320)[None, :])
    table = _words(whole, SCREEN, LINES * 48).reshape(LINES, 48)
    return surface(k.st_rgb(np.take_along_axis(table, np.minimum(slot, 47), 1)), "rgb888")


def is_ste(words: np.ndarray) -> bool:
    """Whether any colour uses a fourth bit."""
    return bool((words & 0x0888).any())


def photochrome(d: bytes, options: Options = Options()) -> Surface:
    need(len(d) >= 18, "truncated_data", "PCS file too small")
    need(d[:4] == b"\x01\x40\x00\xc8", "invalid_format", "Invalid PCS header")
    options.check(320, LINES)
    whole = rle.or_fail("unsupported_encoding", "PCS decompression failed", rle.photochrome, d, 6, ((SCREEN, 1), (PHOTOCHROME_PALETTES, 2)))
    planes = k.u8(whole[:SCREEN]).reshape(4, 200, 40)[:, 1:].transpose(1, 0, 2)
    c = k.planes_to_indices(planes, 320).astype(np.int64)
    words = _words(whole, SCREEN, PHOTOCHROME_PALETTES // 2)
    slot = np.arange(LINES)[:, None] * 48 + photochrome_slot(c, np.arange(320)[None, :])
    return surface((k.ste_rgb if is_ste(words) else k.st_rgb)(words[slot]), "rgb888")

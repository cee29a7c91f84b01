"""Decompressors: byte-at-a-time automata that emit literals and runs. Loops go over commands; runs are expanded in bulk."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pixelloom.functions.kernels import be16, le16
from pixelloom.model import MAX_EXPANSION, DecodeError


class Short(Exception):
    """The input ended within a command or before the output was whole."""


Run = tuple[bytes, int]  # a unit of output and how often it comes


def expand(runs: Iterator[Run], size: int, clip: bool = True) -> bytes:
    """Output of exactly size bytes; a run beyond it is cut, or Short if it mustn't be; Short if runs end before. No bytes need no input."""
    if size <= 0:  # as nothing is asked for, nothing is read
        return b""
    out = bytearray()
    for unit, n in runs:
        out += unit * n
        if len(out) >= size:
            break
    if len(out) < size or len(out) > size and not clip:
        raise Short
    return bytes(out[:size])


def _at(d: bytes, i: int) -> int:
    if i >= len(d):
        raise Short
    return d[i]


def pcx_line(d: bytes, at: int, end: int, size: int) -> tuple[bytes, int]:
    """One scan line: two high bits set mean a run of the low six bits; runs are cut at the line's end. Returns the next place too."""
    out = bytearray()
    while len(out) < size:
        if at >= end:
            raise Short
        b = d[at]
        at += 1
        if b >= 0xC0:
            if at >= end:
                raise Short
            out += d[at : at + 1] * (b & 0x3F)
            at += 1
        else:
            out.append(b)
    return bytes(out[:size]), at


def byterun1(d: bytes, at: int, size: int) -> tuple[bytes, int]:
    """ByteRun1: n below 128 brings n + 1 literals, above 128 a byte 257 - n times, 128 nothing. A command may not pass size."""
    out = bytearray()
    while len(out) < size:
        n = _at(d, at)
        if n < 128:
            part = d[at + 1 : at + 2 + n]
            if len(part) <= n:
                raise Short
            out += part
            at += 2 + n
        elif n > 128:
            _at(d, at + 1)
            out += d[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
        if len(out) > size:
            raise Short
    return bytes(out), at


def byterun1_fits(d: bytes, size: int, n: int, whole: bool = False) -> bool:
    """Whether ByteRun1 commands make n rows of size bytes, none of them passing a row's end; if whole, with nothing left. Nothing is expanded."""
    at = 0
    for _ in range(n):
        left = size
        while left > 0:
            if at >= len(d):
                return False
            c = d[at]
            left -= c + 1 if c < 128 else 257 - c if c > 128 else 0
            at += c + 2 if c < 128 else 2 if c > 128 else 1
            if left < 0 or at > len(d):
                return False
    return not whole or at == len(d)


def bmp_rle(d: bytes, width: int, height: int, bits: int) -> bytes:
    """Indices, rows as stored, of BMP's RLE8 or RLE4; what isn't written is 0, and what is beyond a row is lost."""
    rows = bytearray(width * height)
    x = y = at = 0

    def put(part: bytes) -> None:
        nonlocal x
        part = part[: max(0, width - x)]
        rows[y * width + x : y * width + x + len(part)] = part
        x += len(part)

    def nibbles(part: bytes, n: int) -> bytes:
        return bytes(v for b in part for v in (b >> 4, b & 15))[:n]

    while at + 1 < len(d) and y < height:
        n, v = d[at], d[at + 1]
        at += 2
        if n:
            put(bytes([v]) * n if bits == 8 else (nibbles(bytes([v]), 2) * ((n + 1) // 2))[:n])
        elif v == 0:
            x, y = 0, y + 1
        elif v == 1:
            break
        elif v == 2:
            if at + 1 < len(d):
                x, y, at = x + d[at], y + d[at + 1], at + 2
        else:
            size = v if bits == 8 else (v + 1) // 2
            part = d[at : at + size]
            put(part if bits == 8 else nibbles(part, v))
            at += size + (size & 1)
    return bytes(rows)


def sun(d: bytes, size: int) -> bytes:
    """Sun's byte encoding: 80 00 is one 80; 80 n v is v, n + 1 times; runs pass over rows."""

    def runs() -> Iterator[Run]:
        at = 0
        while at < len(d):
            if d[at] != 0x80:
                nxt = d.find(b"\x80", at)
                nxt = len(d) if nxt < 0 else nxt
                yield d[at:nxt], 1
                at = nxt
            elif _at(d, at + 1) == 0:
                yield b"\x80", 1
                at += 2
            else:
                _at(d, at + 2)
                yield d[at + 2 : at + 3], d[at + 1] + 1
                at += 3

    return expand(runs(), size)


def pictor_blocks(d: bytes, at: int, blocks: int, size: int) -> bytes:
    """Blocks of a size, a length and a marker each; marker n v is a run, marker 0 nn v one with a 16-bit count. Stops early on bad blocks;
    what is missing is 0."""
    out = bytearray()
    for _ in range(blocks):
        if at + 5 > len(d):
            break
        whole, length, marker = le16(d, at), le16(d, at + 2), d[at + 4]
        if whole < 5 or at + whole > len(d):
            break
        i, end, made, mark = at + 5, at + whole, 0, d[at + 4 : at + 5]
        while i < end and made < length and len(out) < size:
            b = d[i]
            if b != marker:
                nxt = d.find(mark, i, end)
                n = min((end if nxt < 0 else nxt) - i, length - made, size - len(out))
                out += d[i : i + n]
                i, made = i + n, made + n
                continue
            i += 1
            if i >= end:
                break
            n = d[i]
            i += 1
            if n == 0:
                if i + 2 >= end:
                    break
                n = le16(d, i)
                i += 2
            if i >= end:
                break
            b = d[i]
            i += 1
            n = min(n, size - len(out))
            out += bytes([b]) * n
            made += n
        at += whole
    return bytes(out) + bytes(size - len(out))


def sgi(d: bytes, width: int, unit: int) -> bytes:
    """A row of width units of 1 or 2 bytes: the low 7 bits count, bit 7 set means literals, a count of 0 ends. Missing units are 0."""
    out, at = bytearray(), 0
    while at + unit <= len(d):
        c = d[at + unit - 1]
        at += unit
        n = c & 0x7F
        if n == 0:
            break
        if len(out) + n * unit > width * unit:
            raise Short
        size = unit * (n if c & 0x80 else 1)
        if at + size > len(d):
            raise Short
        out += d[at : at + size] if c & 0x80 else d[at : at + unit] * n
        at += size
    return bytes(out) + bytes(width * unit - len(out))


def msp_row(d: bytes, size: int) -> bytes:
    """A row of MSP version 2: 0 n v is a run, any other n brings n literals."""

    def runs() -> Iterator[Run]:
        at = 0
        while at < len(d):
            n = d[at]
            if n:
                if at + 1 + n > len(d):
                    raise Short
                yield d[at + 1 : at + 1 + n], 1
                at += 1 + n
            else:
                _at(d, at + 2)
                yield d[at + 2 : at + 3], d[at + 1]
                at += 3

    return expand(runs(), size)


def packbits(d: bytes, at: int, size: int) -> bytes:
    """PackBits over lines: as ByteRun1, but a command may go on after a line's end; Short only if the input ends."""

    def runs(at: int) -> Iterator[Run]:
        while True:
            n = _at(d, at)
            if n < 128:
                if at + 2 + n > len(d):
                    raise Short
                yield d[at + 1 : at + 2 + n], 1
                at += 2 + n
            elif n > 128:
                _at(d, at + 1)
                yield d[at + 1 : at + 2], 257 - n
                at += 2
            else:
                at += 1

    return expand(runs(at), size)


def crack_art(d: bytes, at: int, size: int = 32000) -> bytes:
    """An escape byte, a default value and a step; the output fills every step-th byte, then those after them."""
    if at + 4 > len(d):
        raise Short
    escape, mark, default, step = d[at], d[at : at + 1], d[at + 1 : at + 2], be16(d, at + 2)
    if step >= size:
        raise Short
    if step == 0:
        return default * size

    def runs(at: int) -> Iterator[Run]:
        while True:
            b = _at(d, at)
            if b != escape:
                nxt = d.find(mark, at)
                nxt = len(d) if nxt < 0 else nxt
                yield d[at:nxt], 1
                at = nxt
                continue
            c = _at(d, at + 1)
            if c == escape:
                yield d[at + 1 : at + 2], 1
                at += 2
                continue
            b = _at(d, at + 2)
            if c == 0:
                _at(d, at + 3)
                yield d[at + 3 : at + 4], b + 1
                at += 4
            elif c == 1 or c == 2 and b:
                n = (b << 8 | _at(d, at + 3)) + 1
                if c == 1:
                    _at(d, at + 4)
                yield (d[at + 4 : at + 5] if c == 1 else default), n
                at += 4 + (c == 1)
            elif c == 2:
                yield default, size
                at += 3
            else:
                yield d[at + 2 : at + 3], c + 1
                at += 3

    flat, out, start = expand(runs(at + 4), size), bytearray(size), 0
    for column in range(step):
        n = len(range(column, size, step))
        out[column::step] = flat[start : start + n]
        start += n
    return bytes(out)


def two_streams(control: bytes, values: bytes, unit: int, take: Callable[[int], int] | None = None) -> Iterator[Run]:
    """Runs of a control stream over a stream of values of unit bytes: 0 nn repeats the next value, 1 nn copies values, 2-127 repeats so often,
    128-255 copies 256 - n values. Zero counts bring nothing, though 0 and 2-127 take their value."""
    c = v = 0
    while True:
        n = _at(control, c)
        c += 1
        copy = n == 1 or n >= 128
        if n < 2:
            if c + 1 >= len(control):
                raise Short
            n = be16(control, c)
            c += 2
        elif n >= 128:
            n = 256 - n
        size = unit * (n if copy else 1)
        part = values[v : v + size]
        if len(part) < size:
            yield part[: len(part) // unit * unit], 1  # what there is may do
            raise Short
        v += size
        yield part, 1 if copy else n


def tiny(control: bytes, values: bytes) -> bytes:
    """A 32000-byte screen of 16-bit words, columns of each plane in turn, put back to rows."""
    words = expand(two_streams(control, values, 2), 32000)
    out = bytearray(32000)
    at = 0
    for plane in range(0, 8, 2):
        for x in range(plane, 160, 8):
            for half in (0, 1):
                out[x + half :: 160] = words[at + half : at + 400 : 2]
            at += 400
    return bytes(out)


def spc(d: bytes, at: int, size: int) -> bytes:
    """n below 128 brings n + 1 literals, else a byte 258 - n times."""

    def runs(at: int) -> Iterator[Run]:
        while True:
            n = _at(d, at)
            if n < 128:
                part = d[at + 1 : at + 2 + n]
                yield part, 1
                if len(part) <= n:
                    raise Short
                at += 2 + n
            else:
                _at(d, at + 1)
                yield d[at + 1 : at + 2], 258 - n
                at += 2

    return expand(runs(at), size)


def photochrome(d: bytes, at: int, sizes: tuple[tuple[int, int], ...]) -> bytes:
    """Blocks, each of (size, unit): a 16-bit number of commands, then these with their values between them. A block ends when its commands do."""
    out = b""
    for size, unit in sizes:
        if at + 1 >= len(d):
            raise Short
        commands, at, block = be16(d, at), at + 2, bytearray()
        for _ in range(commands):
            n = _at(d, at)
            at += 1
            copy = n == 1 or n >= 128
            if n < 2:
                if at + 1 >= len(d):
                    raise Short
                n, at = be16(d, at), at + 2
            elif n >= 128:
                n = 256 - n
            width = unit * (n if copy else 1)
            part = d[at : at + width]
            block += part if copy else part * n
            at += width
            if len(part) < width:
                break
        if len(block) < size:
            raise Short
        out += bytes(block[:size])
    return out


def escaped(d: bytes, at: int, escape: int, size: int, count_first: bool, head: bytes = b"") -> bytes:
    """Escape codes of 8-bit machines: escape, value, count, or with the count first; head comes before; runs are cut at size."""
    if size > len(d) * MAX_EXPANSION:
        raise Short
    mark = bytes([escape])

    def runs(at: int) -> Iterator[Run]:
        yield head, 1
        while at < len(d):
            if d[at] != escape:
                nxt = d.find(mark, at)
                nxt = len(d) if nxt < 0 else nxt
                yield d[at:nxt], 1
                at = nxt
            else:
                a, b = _at(d, at + 1), _at(d, at + 2)
                yield (bytes([b]), a) if count_first else (bytes([a]), b)
                at += 3

    return expand(runs(at), size)


def escaped_size(d: bytes, at: int, escape: int) -> int:
    """Bytes that escape, value, count codes expand to; -1 if the input ends within one."""
    n = 0
    while at < len(d):
        if d[at] != escape:
            n, at = n + 1, at + 1
        elif at + 2 >= len(d):
            return -1
        else:
            n, at = n + d[at + 2], at + 3
    return n


def or_fail(kind: str, message: str, f: Callable, *args):
    """f's result; Short becomes the error."""
    try:
        return f(*args)
    except Short:
        raise DecodeError(kind, message) from None

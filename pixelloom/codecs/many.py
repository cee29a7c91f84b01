"""Decoding of many small files at once, in numpy: those of a batch that have one header. What isn't plain here (odd headers, damaged data) is left to the
decoders of one file, which give the same surfaces."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

from pixelloom.codecs import amiga, pc
from pixelloom.functions import kernels as k
from pixelloom.model import FORMATS, DecodeError, Options, Surface
from pixelloom.operators.bulk import bounds, spread

#: Fewest files with one header, most headers in a batch, largest surface, and bytes of surfaces at once.
FEWEST, HEADERS, LARGEST, AT_ONCE = 16, 16, 1 << 14, 1 << 19


@dataclass
class Files:
    """Files by where they begin and end in one array; head is the first one."""

    flat: np.ndarray
    start: np.ndarray
    end: np.ndarray
    head: bytes

    def raw(self, at: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """size bytes from a place of each file on, and which files have them."""
        ok = self.end - self.start >= at + size
        where = np.where(ok, self.start + at, 0)
        return self.flat[np.minimum(where[:, None] + np.arange(size), len(self.flat) - 1)], ok


@dataclass
class Surfaces:
    """Surfaces of one size: pixels a row for each, palette in common or a row for each."""

    width: int
    height: int
    format: str
    pixels: np.ndarray
    palette: bytes | np.ndarray = b""

    @property
    def format_ord(self) -> int:
        return FORMATS.index(self.format)

    def some(self, which: np.ndarray) -> Surfaces:
        return Surfaces(self.width, self.height, self.format, self.pixels[which], self.palette[which] if isinstance(self.palette, np.ndarray) else self.palette)


def stacked(s: Surface, n: int) -> Surfaces:
    """n surfaces of one that has them one below the other."""
    return Surfaces(s.width, s.height // n, s.format, k.u8(s.pixels).reshape(n, -1), s.palette)


Decoded = tuple[Surfaces, np.ndarray] | None  # and which files have one


class _Emitted:
    """Stretches of output, n units to a place: copied from a source on, or its one unit repeated."""

    def __init__(self) -> None:
        self.to, self.n, self.source, self.step = [], [], [], []

    def add(self, to: np.ndarray, n: np.ndarray, source: np.ndarray, step: np.ndarray) -> None:
        self.to.append(to)
        self.n.append(n)
        self.source.append(source)
        self.step.append(step)

    def out(self, flat: np.ndarray, size: int) -> np.ndarray:
        made = np.zeros(size, np.uint8)
        if self.to:
            to, n, source, step = (np.concatenate(x) for x in (self.to, self.n, self.source, self.step))
            within = np.arange(int(n.sum())) - np.repeat(bounds(n)[:-1], n)
            made[spread(to, n)] = flat[np.repeat(source, n) + within * np.repeat(step, n)]
        return made


def _lockstep(start: np.ndarray, end: np.ndarray, total: int, step: Callable) -> np.ndarray:
    """Whether each stream gives its output; step takes numbers, places, ends and output places of those at work and returns the places after a command
    and which are at fault."""
    ok = np.zeros(len(start), bool)
    who, at, done = np.arange(len(start)), start.copy(), np.zeros(len(start), np.int64)
    while len(who):
        at, done, fault = step(who, at, end[who], done)
        full = (done >= total) & ~fault
        if fault.any() or full.any():
            ok[who[full]] = True
            go = ~(full | fault)
            who, at, done = who[go], at[go], done[go]
    return ok


def pcx_rows(flat: np.ndarray, start: np.ndarray, end: np.ndarray, size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As rle.pcx_line, n lines of each stream."""
    emitted, last = _Emitted(), len(flat) - 1

    def step(who, at, end, done):
        b = flat[np.minimum(at, last)].astype(np.int64)
        run = b >= 0xC0
        fault = at + run >= end
        count = np.minimum(np.where(run, b & 63, 1), size - done % size)
        count[fault] = 0
        emitted.add(who * (size * n) + done, count, np.minimum(at + run, last), np.zeros(len(who), np.int64))
        return at + 1 + run, done + count, fault

    ok = _lockstep(start, end, size * n, step)
    return emitted.out(flat, len(start) * size * n).reshape(len(start), n, size), ok


def byterun1_rows(flat: np.ndarray, start: np.ndarray, end: np.ndarray, size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As rle.byterun1, n rows of each stream."""
    emitted, last = _Emitted(), len(flat) - 1

    def step(who, at, end, done):
        c = flat[np.minimum(at, last)].astype(np.int64)
        literal = c < 128
        count = np.where(literal, c + 1, np.where(c > 128, 257 - c, 0))
        after = at + np.where(literal, c + 2, np.where(c > 128, 2, 1))
        fault = (after > end) | (count > size - done % size)
        count[fault] = 0
        emitted.add(who * (size * n) + done, count, np.minimum(at + 1, last), literal.astype(np.int64))
        return after, done + count, fault

    ok = _lockstep(start, end, size * n, step)
    return emitted.out(flat, len(start) * size * n).reshape(len(start), n, size), ok


def pictor_rows(flat: np.ndarray, start: np.ndarray, end: np.ndarray, blocks: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """As rle.pictor_blocks where every block is whole and together they give all of the output."""
    emitted, last = _Emitted(), len(flat) - 1
    left, stop, length, marker = blocks.astype(np.int64), start.copy(), np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    byte = lambda at: flat[np.minimum(at, last)].astype(np.int64)

    def step(who, at, end, done):
        opens = (at >= stop[who]) | (length[who] <= 0)
        fault = np.zeros(len(who), bool)
        if opens.any():
            w = who[opens]
            a = stop[w]
            whole = byte(a) | byte(a + 1) << 8
            fault[opens] = (left[w] <= 0) | (a + 5 > end[opens]) | (whole < 6) | (a + whole > end[opens])
            left[w] -= 1
            length[w], marker[w], stop[w] = byte(a + 2) | byte(a + 3) << 8, byte(a + 4), a + whole
            at = np.where(opens, stop_before(at, opens, a), at)
            fault |= length[who] <= 0
        b = byte(at)
        coded = b == marker[who]
        n = np.where(coded, byte(at + 1), 1)
        wide = coded & (n == 0)
        n = np.where(wide, byte(at + 2) | byte(at + 3) << 8, n)
        source = at + np.where(wide, 4, np.where(coded, 2, 0))
        fault |= (source >= stop[who]) | (n == 0)
        n = np.where(fault, 0, np.minimum(n, size - done))
        emitted.add(who * size + done, n, np.minimum(source, last), np.zeros(len(who), np.int64))
        length[who] -= n
        return source + 1, done + n, fault

    def stop_before(at: np.ndarray, opens: np.ndarray, a: np.ndarray) -> np.ndarray:
        out = at.copy()
        out[opens] = a + 5
        return out

    ok = _lockstep(start, end, size, step)
    return emitted.out(flat, len(start) * size).reshape(len(start), size), ok


def _pcx(f: Files, options: Options) -> Decoded:
    h = pc.pcx_header(f.head, options)
    planes, bits, line = h["planes"], h["bits"], h["line"]
    if (planes, bits) not in pc.PCX_MODES or line < 1:
        return None
    vga = (planes, bits) == (1, 8)
    size = f.end - f.start
    ok = size >= 769 if vga else size >= 128
    raw, good = pcx_rows(f.flat, f.start + 128, f.end - 769 * (h["version"] == 5 and vga), line * planes, h["height"])
    n = len(raw)
    s = stacked(pc.pcx_surface(h, raw.reshape(-1, planes, line), pc.pcx_palette(h, f.head)), n)
    if vga:
        tail = f.flat[np.maximum(f.end[:, None] - 769 + np.arange(769), 0)]
        s.palette = tail[:, 1:]
        good &= tail[:, 0] == 12
    return s, ok & good


def _bmp(f: Files, options: Options) -> Decoded:
    h = pc.bmp_header(f.head)
    if h["compression"] in (1, 2) or h["width"] < 1 or h["height"] < 1:
        return None
    stride = k.stride4(h["width"], h["bits"])
    raw, ok = f.raw(h["data"], stride * h["height"])
    rows = raw.reshape(len(raw), h["height"], stride)
    rows = rows if h["top_down"] else rows[:, ::-1]
    return stacked(pc.bmp_surface(h, rows.reshape(-1, stride), pc.bmp_palette(h, f.head)), len(raw)), ok


def _sunrast(f: Files, options: Options) -> Decoded:
    h = pc.sunrast_header(f.head, options)
    if h["kind"] == 2:
        return None
    raw, ok = f.raw(h["data"], h["stride"] * h["height"])
    return stacked(pc.sunrast_surface(h, raw.reshape(-1, h["stride"])), len(raw)), ok


def _pictor(f: Files, options: Options) -> Decoded:
    h = pc.pictor_header(f.head, options)
    raw, ok = f.raw(h["data"], 2)
    blocks = raw[:, 0].astype(np.int64) | raw[:, 1].astype(np.int64) << 8
    data, good = pictor_rows(f.flat, f.start + h["data"] + 2, f.end, blocks, h["stride"] * h["height"] * h["planes"])
    n = len(data)
    planes = data.reshape(n, h["planes"], h["height"], h["stride"])[:, :, ::-1].transpose(1, 0, 2, 3).reshape(h["planes"], -1, h["stride"])
    return stacked(pc.pictor_surface(h, planes), n), ok & good & (blocks > 0)


def _pnm(f: Files, options: Options) -> Decoded:
    h = pc.pnm_header(f.head, options)
    space = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
    at, w, height = h["data"], h["width"], h["height"]
    size = f.end - f.start
    if h["kind"] == 1:
        ok = size == len(f.head)
        raw = f.flat[np.minimum(f.start[:, None] + np.arange(at, len(f.head)), len(f.flat) - 1)]
        gap = space[k.u8(f.head[at:])]
        ok &= (space[raw] == gap).all(1)
        raw = np.ascontiguousarray(raw[:, ~gap][:, : w * height])
        if raw.shape[1] < w * height:
            return None
    elif h["kind"] >= 4:
        raw, ok = f.raw(at, h["size"])
        ok &= ~space[raw[:, 0]]
    else:
        return None
    return stacked(pc.pnm_surface(h, raw.reshape(-1, raw.shape[1] // height)), len(raw)), ok


def _qoi(f: Files, options: Options) -> Decoded:
    """Where the input ends early, left to the other decoder."""
    w, height, channels = pc.qoi_header(f.head, options)
    flat, n, total = f.flat, len(f.start), w * height
    last = len(flat) - 1
    seen, now = np.zeros((n, 64, 4), np.uint8), np.zeros((n, 4), np.uint8)
    now[:, 3] = 255
    to, counts, colours = [], [], []
    byte = lambda at: flat[np.minimum(at, last)]

    def step(who, at, end, done):
        op = byte(at)
        c, used, count = now[who], np.ones(len(who), np.int64), np.ones(len(who), np.int64)
        fault = at >= end - 8
        for op_is, channels_set in ((op == 0xFE, 3), (op == 0xFF, 4)):
            if op_is.any():
                a = at[op_is]
                for i in range(channels_set):
                    c[op_is, i] = byte(a + 1 + i)
                used[op_is] = 1 + channels_set
        if (m := op < 0x40).any():
            c[m] = seen[who[m], op[m]]
        if (m := (op >= 0x40) & (op < 0x80)).any():
            for i, shift in enumerate((4, 2, 0)):
                c[m, i] += (op[m] >> shift & 3) - np.uint8(2)
        if (m := (op >= 0x80) & (op < 0xC0)).any():
            low, green = byte(at[m] + 1), (op[m] & 63) - np.uint8(32)
            c[m, 0] += green - np.uint8(8) + (low >> 4)
            c[m, 1] += green
            c[m, 2] += green - np.uint8(8) + (low & 15)
            used[m] = 2
        if (m := (op >= 0xC0) & (op < 0xFE)).any():
            count[m] = (op[m] & 63).astype(np.int64) + 1
        fault |= at + used > end
        count = np.where(fault, 0, np.minimum(count, total - done))
        now[who] = c
        seen[who, c.astype(np.int64) @ np.array([3, 5, 7, 11]) % 64] = c
        to.append(who * total + done)
        counts.append(count)
        colours.append(c)
        return at + used, done + count, fault

    ok = _lockstep(f.start + 14, f.end, total, step)
    to, counts = np.concatenate(to), np.concatenate(counts)
    px = np.zeros((n * total, 4), np.uint8)
    px[spread(to, counts)] = np.repeat(np.concatenate(colours), counts, axis=0)
    return Surfaces(w, height, FORMATS[channels - 2], np.ascontiguousarray(px[:, :channels]).reshape(n, -1)), ok


def _lbm_body(d: bytes) -> int:
    """Where the body begins if it is the last chunk, else 0."""
    found = list(amiga.chunks(d))
    return found[-1][2] if found and found[-1][1] == b"BODY" and sum(x[1] == b"BODY" for x in found) == 1 else 0


def _lbm(f: Files, options: Options) -> Decoded:
    at = _lbm_body(f.head)
    h = amiga.lbm_header({name: f.head[o : o + size] for _, name, o, size in amiga.chunks(f.head)}, f.head[8:12], options)
    number = lambda where: f.flat[np.minimum((f.start + where)[:, None] + np.arange(4), len(f.flat) - 1)].astype(np.int64) @ (1 << np.array([24, 16, 8, 0]))
    size, body = f.end - f.start, number(at - 4)
    ok = (number(4) + 8 >= at) & ((at + body == size) | (at + body + (body & 1) == size))  # nothing comes after it but a byte that fills up
    start, line, n_rows = f.start + at, h["line"], h["rows"]
    if h["packing"]:
        rows, good = byterun1_rows(f.flat, start, start + body, line, n_rows)
    else:
        rows, good = f.raw(at, line * n_rows)
    return stacked(amiga.lbm_surface(h, rows.reshape(-1, line)), len(rows)), ok & good


def _upto(end: Callable[[bytes, Options], int], but: Callable[[bytes, int], list[int]] = lambda d, n: []) -> Callable[[bytes, Options], np.ndarray]:
    def places(d: bytes, options: Options) -> np.ndarray:
        n = end(d, options)
        return np.setdiff1d(np.arange(n), but(d, n))

    return places


#: For each codec the places of a header's bytes that must be equal, by its first file, and the decoder.
MANY: dict[str, tuple[Callable[[bytes, Options], np.ndarray], Callable[[Files, Options], Decoded]]] = {
    "pcx": (_upto(lambda d, o: 128), _pcx),
    "bmp": (_upto(lambda d, o: pc.bmp_header(d)["data"]), _bmp),
    "sunrast": (_upto(lambda d, o: pc.sunrast_header(d, o)["data"]), _sunrast),
    "pictor": (_upto(lambda d, o: pc.pictor_header(d, o)["data"]), _pictor),
    "pnm": (_upto(lambda d, o: pc.pnm_header(d, o)["data"]), _pnm),
    "qoi": (_upto(lambda d, o: 14), _qoi),
    "lbm": (_upto(lambda d, o: _lbm_body(d), lambda d, n: [4, 5, 6, 7, n - 4, n - 3, n - 2, n - 1]), _lbm),
}


def decode_many(codec: str, flat: np.ndarray, start: np.ndarray, end: np.ndarray, one: Callable[[bytes], Surface], options: Options) -> Iterator[tuple[np.ndarray, Surfaces]]:
    """Numbers of files and their surfaces, as far as they can be decoded at once. one decodes one file: the first of each header goes through it, which
    tells errors and sizes."""
    places_of, decoder = MANY[codec]
    left = np.arange(len(start))
    for _ in range(HEADERS):
        if len(left) < FEWEST:
            return
        head = flat[start[left[0]] : end[left[0]]].tobytes()
        try:
            size = len(one(head).pixels)
            places = places_of(head, options)
        except (DecodeError, IndexError, ValueError):
            left = left[1:]
            continue
        if not 0 < size <= LARGEST or not len(places) or places[-1] >= len(head):
            return
        same = end[left] - start[left] > places[-1]
        same[same] = (flat[start[left[same]][:, None] + places] == k.u8(head)[places]).all(1)
        alike, left = left[same], left[~same]
        for i in range(0, len(alike), max(1, AT_ONCE // size)):
            part = alike[i : i + max(1, AT_ONCE // size)]
            made = decoder(Files(flat, start[part], end[part], head), options)
            if made is None:
                break
            surfaces, ok = made
            yield (part, surfaces) if ok.all() else (part[ok], surfaces.some(ok))

"""TGA, GIF (first frame) and JPEG (baseline and progressive). All give rgba8888."""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

from pixelloom.functions import kernels as k
from pixelloom.model import DecodeError, Options, Surface, need, surface


def _rgba(rgb: np.ndarray) -> Surface:
    return surface(np.concatenate([rgb, np.full((*rgb.shape[:2], 1), 255, np.uint8)], 2), "rgba8888")


def _tga_colours(raw: np.ndarray, bits: int) -> np.ndarray:
    """RGBA of rows of bytes: 8 bits grey, 15 and 16 bits 5-5-5, else BGR(A)."""
    out = np.full((len(raw), 4), 255, np.uint8)
    if bits == 8:
        out[:, :3] = raw[:, :1]
    elif bits in (15, 16):
        v = raw[:, 0].astype(np.int64) | raw[:, 1].astype(np.int64) << 8
        out[:, :3] = np.stack([(v >> s & 31) * 255 // 31 for s in (10, 5, 0)], 1)
    else:
        out[:, :3] = raw[:, 2::-1]
        if bits == 32:
            out[:, 3] = raw[:, 3]
    return out


def tga(d: bytes, options: Options = Options()) -> Surface:
    need(len(d) >= 18, "invalid_format", "Not a valid TGA file")
    skip, mapped, kind, first, n, entry, _, _, w, h, bits, flags = struct.unpack_from("<BBBHHBHHHHBB", d)
    need(w > 0 and h > 0 and mapped <= 1 and kind & 7 in (1, 2, 3) and kind in (1, 2, 3, 9, 10, 11), "invalid_format", "Invalid TGA header")
    need(bits in (8, 15, 16, 24, 32) and (kind & 7 != 1 or mapped and bits in (8, 16)), "invalid_format", "Invalid TGA header")
    options.check(w, h)
    at, size = 18 + skip, (bits + 7) // 8
    table = None
    if mapped:
        e = (entry + 7) // 8
        need(entry in (8, 15, 16, 24, 32) and at + n * e <= len(d), "truncated_data", "TGA palette truncated")
        table = _tga_colours(k.u8(d[at : at + n * e]).reshape(n, e), entry)
        at += n * e
    count = w * h
    if kind >= 9:
        parts, made = [], 0
        while made < count:
            need(at < len(d), "truncated_data", "TGA data truncated")
            c = d[at]
            m = min((c & 127) + 1, count - made)
            part = d[at + 1 : at + 1 + size * (1 if c & 128 else m)]
            need(len(part) == size * (1 if c & 128 else m), "truncated_data", "TGA data truncated")
            parts.append(part * m if c & 128 else part)
            at, made = at + 1 + len(part), made + m
        raw = b"".join(parts)
    else:
        raw = d[at : at + count * size]
        need(len(raw) == count * size, "truncated_data", "TGA data truncated")
    px = k.u8(raw).reshape(count, size)
    if kind & 7 == 1:
        i = px[:, 0].astype(np.int64) if size == 1 else px[:, 0].astype(np.int64) | px[:, 1].astype(np.int64) << 8
        need(table is not None and len(table) > 0, "invalid_format", "TGA palette missing")
        out = table[np.where(i < len(table), i, 0)]
    elif kind & 7 == 3 and size == 2:
        out = np.stack([px[:, 0]] * 3 + [px[:, 1]], 1)
    else:
        out = _tga_colours(px, bits)
    out = out.reshape(h, w, 4)
    return surface(out if flags & 0x20 else out[::-1], "rgba8888")


def lzw(data: bytes, bits: int, size: int) -> bytes:
    """GIF's LZW: codes grow from bits + 1 to 12 bits; up to size bytes."""
    clear, out, n, held, at = 1 << bits, bytearray(), 0, 0, 0
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, width, last = list(base), bits + 1, None
    while len(out) < size:
        while n < width:
            if at >= len(data):
                return bytes(out)
            held |= data[at] << n
            n, at = n + 8, at + 1
        code = held & (1 << width) - 1
        held, n = held >> width, n - width
        if code == clear:
            table, width, last = list(base), bits + 1, None
            continue
        if code == clear + 1:
            break
        if code < len(table):
            part = table[code]
        elif last is not None and code == len(table):
            part = last + last[:1]
        else:
            raise DecodeError("invalid_format", "GIF data damaged")
        out += part
        if last is not None and len(table) < 4096:
            table.append(last + part[:1])
            if len(table) == 1 << width and width < 12:
                width += 1
        last = part
    return bytes(out[:size])


def gif(d: bytes, options: Options = Options()) -> Surface:
    need(d[:6] in (b"GIF87a", b"GIF89a") and len(d) >= 13, "invalid_format", "Not a valid GIF file")
    w, h, flags, back = struct.unpack_from("<HHBB", d, 6)
    need(w > 0 and h > 0, "invalid_format", "Invalid GIF size")
    options.check(w, h)

    def colours(at: int, f: int) -> tuple[np.ndarray | None, int]:
        if not f & 0x80:
            return None, at
        n = 2 << (f & 7)
        table = np.zeros((256, 3), np.uint8)
        own = k.u8(d[at : at + 3 * n])
        table.reshape(-1)[: len(own)] = own
        return table, at + 3 * n

    shared, at = colours(13, flags)
    hidden = -1
    while at < len(d):
        mark = d[at]
        if mark == 0x21:
            if d[at + 1 : at + 3] == b"\xf9\x04" and len(d) >= at + 8:
                hidden = d[at + 6] if d[at + 3] & 1 else -1
            at += 2
            while at < len(d) and d[at]:
                at += 1 + d[at]
            at += 1
        elif mark == 0x2C and at + 10 < len(d):
            x, y, fw, fh, f = struct.unpack_from("<HHHHB", d, at + 1)
            need(x + fw <= w and y + fh <= h, "invalid_format", "Bad GIF frame")
            table, at = colours(at + 10, f)
            table = shared if table is None else table
            need(table is not None and at < len(d) and d[at] <= 11, "invalid_format", "GIF colour table missing")
            bits, at, data = d[at], at + 1, bytearray()
            while at < len(d) and d[at]:
                data += d[at + 1 : at + 1 + d[at]]
                at += 1 + d[at]
            got = k.u8(lzw(bytes(data), bits, fw * fh))
            drawn = np.zeros(fw * fh, bool)
            drawn[: len(got)] = got != hidden
            index = np.zeros(fw * fh, np.uint8)
            index[: len(got)] = got
            if f & 0x40:
                order = np.concatenate([np.arange(a, fh, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
                turned, shown = np.empty((fh, fw), np.uint8), np.empty((fh, fw), bool)
                turned[order], shown[order] = index.reshape(fh, fw), drawn.reshape(fh, fw)
            else:
                turned, shown = index.reshape(fh, fw), drawn.reshape(fh, fw)
            out = np.zeros((h, w, 4), np.uint8)
            if back > 0 and shared is not None:
                out[:] = [*shared[back], 255]
            view = out[y : y + fh, x : x + fw]
            view[shown] = np.concatenate([table[turned[shown]], np.full((int(shown.sum()), 1), 255, np.uint8)], 1)
            return surface(out, "rgba8888")
        else:
            break
    raise DecodeError("truncated_data", "GIF has no image")


#: Order of a block's coefficients: along the diagonals of an 8 x 8 square, turning at its sides.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


class _Bits:
    """The bits of one entropy-coded stretch, without stuffed bytes."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data.replace(b"\xff\0", b"\xff"), 0, 0, 0

    def take(self, n: int) -> int:
        while self.n < n:
            self.held = self.held << 8 | (self.data[self.at] if self.at < len(self.data) else 0)
            self.at += 1
            self.n += 8
        self.n -= n
        v = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return v

    def code(self, table: list[tuple[int, int]] | None) -> int:
        while self.n < 16:
            self.held = self.held << 8 | (self.data[self.at] if self.at < len(self.data) else 0)
            self.at += 1
            self.n += 8
        size, symbol = table[self.held >> self.n - 16] if table else (0, 0)
        if not size:
            raise DecodeError("invalid_format", "JPEG data damaged")
        self.n -= size
        self.held &= (1 << self.n) - 1
        return symbol

    def value(self, n: int) -> int:
        v = self.take(n) if n else 0
        return v if not n or v >> n - 1 else v - (1 << n) + 1


@lru_cache(64)
def _huffman(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """Size and symbol of the code that 16 bits begin with; size 0 if there is none."""
    out: list[tuple[int, int]] = []
    i = 0
    for n, c in enumerate(counts, 1):
        for _ in range(c):
            out += [(n, symbols[i])] * (1 << 16 - n)
            i += 1
    return out[: 1 << 16] + [(0, 0)] * ((1 << 16) - len(out))


class _Jpeg:
    def __init__(self) -> None:
        self.quant: dict[int, np.ndarray] = {}
        self.dc: dict[int, list] = {}
        self.ac: dict[int, list] = {}
        self.restart, self.adobe, self.parts = 0, -1, []

    def frame(self, body: bytes, options: Options, progressive: bool) -> None:
        bits, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        need(bits == 8 and self.height > 0 and self.width > 0 and n in (1, 3, 4), "invalid_format", "Unsupported JPEG frame")
        options.check(self.width, self.height)
        self.progressive = progressive
        self.parts = [{"id": body[6 + 3 * i], "h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "q": body[8 + 3 * i]} for i in range(n)]
        need(all(1 <= p["h"] <= 4 and 1 <= p["v"] <= 4 for p in self.parts), "invalid_format", "Bad JPEG sampling")
        self.hmax, self.vmax = max(p["h"] for p in self.parts), max(p["v"] for p in self.parts)
        self.mx, self.my = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        for p in self.parts:
            p["bw"], p["bh"] = -(-(-(-self.width * p["h"] // self.hmax)) // 8), -(-(-(-self.height * p["v"] // self.vmax)) // 8)
            p["co"] = np.zeros((self.my * p["v"], self.mx * p["h"], 64), np.int32)

    def scan(self, body: bytes, data: bytes) -> None:
        n = body[0]
        chosen = []
        for i in range(n):
            part = next((p for p in self.parts if p["id"] == body[1 + 2 * i]), None)
            need(part is not None, "invalid_format", "Bad JPEG scan")
            chosen.append((part, body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15))
        start, end, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
        if n == 1:
            p, t, a = chosen[0]
            units = [[(p, t, a, y, x)] for y in range(p["bh"]) for x in range(p["bw"])]
        else:
            units = [
                [(p, t, a, my * p["v"] + v, mx * p["h"] + h) for p, t, a in chosen for v in range(p["v"]) for h in range(p["h"])]
                for my in range(self.my) for mx in range(self.mx)
            ]
        stretches = _stretches(data)
        per = self.restart or len(units)
        for i in range(0, len(units), per):
            bits, last, self.run = _Bits(stretches[i // per] if i // per < len(stretches) else b""), {}, 0
            for unit in units[i : i + per]:
                for p, t, a, y, x in unit:
                    self.block(bits, p["co"][y, x], p["id"], t, a, last, start, end, high, low)

    def block(self, bits: _Bits, co: np.ndarray, own: int, t: int, a: int, last: dict, start: int, end: int, high: int, low: int) -> None:
        at = start
        if start == 0:
            if high:
                co[0] |= bits.take(1) << low
            else:
                last[own] = last.get(own, 0) + bits.value(bits.code(self.dc.get(t)))
                co[0] = last[own] << low
            at = 1
            if self.progressive:
                return
            end = 63
        ac = self.ac.get(a)
        if high:
            self.refine(bits, co, ac, start, end, low)
            return
        if self.run:
            self.run -= 1
            return
        while at <= end:
            s = bits.code(ac)
            zeros, size = s >> 4, s & 15
            if size == 0:
                if zeros < 15:
                    if self.progressive:
                        self.run = (1 << zeros) - 1 + (bits.take(zeros) if zeros else 0)
                    break
                at += 16
                continue
            at += zeros
            if at > 63:
                break
            co[at] = bits.value(size) << low
            at += 1

    def refine(self, bits: _Bits, co: np.ndarray, ac: list | None, at: int, end: int, low: int) -> None:
        bit = 1 << low

        def better(i: int) -> None:
            if bits.take(1) and not abs(int(co[i])) & bit:
                co[i] += bit if co[i] > 0 else -bit

        if not self.run:
            while at <= end:
                s = bits.code(ac)
                zeros, size, new = s >> 4, s & 15, 0
                if size:
                    new = bit if bits.take(1) else -bit
                elif zeros < 15:
                    self.run = (1 << zeros) + (bits.take(zeros) if zeros else 0)
                    break
                while at <= end:
                    if co[at]:
                        better(at)
                    elif zeros == 0:
                        if new:
                            co[at] = new
                        at += 1
                        break
                    else:
                        zeros -= 1
                    at += 1
        if self.run:
            for i in range(at, end + 1):
                if co[i]:
                    better(i)
            self.run -= 1

    def pixels(self) -> np.ndarray:
        u = np.arange(8)
        basis = np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16) * np.where(u == 0, np.sqrt(0.125), 0.5)[:, None]
        planes = []
        for p in self.parts:
            flat = np.zeros(p["co"].shape, np.float64)
            flat[:, :, ZIGZAG] = p["co"] * self.quant.get(p["q"], np.ones(64))
            bh, bw = flat.shape[:2]
            block = basis.T @ flat.reshape(bh, bw, 8, 8) @ basis
            plane = np.clip(np.round(block.transpose(0, 2, 1, 3).reshape(bh * 8, bw * 8) + 128), 0, 255)
            planes.append(np.repeat(np.repeat(plane, self.vmax // p["v"], 0), self.hmax // p["h"], 1)[: self.height, : self.width])
        if len(planes) == 1:
            return np.stack([planes[0]] * 3, 2).astype(np.uint8)
        c = np.stack(planes, 2)
        turned = self.adobe != 0 if len(planes) == 3 else self.adobe == 2
        if turned:
            y, cb, cr = c[:, :, 0], c[:, :, 1] - 128, c[:, :, 2] - 128
            c[:, :, :3] = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2)
        c = np.clip(np.round(c), 0, 255)
        if len(planes) == 4:
            c = np.round(c[:, :, :3] * c[:, :, 3:] / 255)
        return c[:, :, :3].astype(np.uint8)


def _stretches(data: bytes) -> list[bytes]:
    """The parts between restart marks."""
    out, start, at = [], 0, 0
    while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data):
        if 0xD0 <= data[at + 1] <= 0xD7:
            out.append(data[start:at])
            start = at + 2
        at += 2
    return [*out, data[start:]]


def jpeg(d: bytes, options: Options = Options()) -> Surface:
    """Arithmetic, lossless and 12-bit frames aren't supported; chroma is repeated, not smoothed; the inverse transform is in double precision."""
    need(d[:3] == b"\xff\xd8\xff", "invalid_format", "Not a valid JPEG file")
    j, at, scans = _Jpeg(), 2, 0
    try:
        while at + 4 <= len(d):
            if d[at] != 0xFF:
                at += 1
                continue
            mark = d[at + 1]
            if mark == 0xFF or mark == 0 or 0xD0 <= mark <= 0xD8:
                at += 1 if mark == 0xFF else 2
                continue
            if mark == 0xD9:
                break
            size = k.be16(d, at + 2)
            body = d[at + 4 : at + 2 + size]
            at += 2 + size
            if mark == 0xDB:
                while body:
                    wide = body[0] >> 4
                    j.quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.float64)
                    body = body[1 + 64 * (1 + (wide > 0)) :]
            elif mark == 0xC4:
                while body:
                    n = sum(body[1:17])
                    (j.ac if body[0] >> 4 else j.dc)[body[0] & 15] = _huffman(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif mark in (0xC0, 0xC1, 0xC2):
                j.frame(body, options, mark == 0xC2)
            elif 0xC3 <= mark <= 0xCF and mark != 0xC8 and mark != 0xCC:
                raise DecodeError("unsupported_encoding", "Unsupported JPEG process")
            elif mark == 0xDD:
                j.restart = k.be16(body, 0)
            elif mark == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
                j.adobe = body[11]
            elif mark == 0xDA:
                need(bool(j.parts), "invalid_format", "JPEG scan before frame")
                end = at
                while (end := d.find(b"\xff", end)) >= 0 and end + 1 < len(d) and (d[end + 1] == 0 or 0xD0 <= d[end + 1] <= 0xD7):
                    end += 2
                end = len(d) if end < 0 else end
                j.scan(body, d[at:end])
                at, scans = end, scans + 1
    except (struct.error, IndexError, ValueError):
        raise DecodeError("truncated_data", "JPEG data truncated") from None
    need(scans > 0, "truncated_data", "JPEG has no image data")
    return _rgba(j.pixels())

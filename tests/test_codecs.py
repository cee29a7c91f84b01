"""Codecs on files made here: known rasters, and pairs of files that must give the same surface."""

import struct
import zlib

import numpy as np
import pytest

from pixelloom.codecs.png import encode
from pixelloom.model import DecodeError, Options, surface
from pixelloom.operators.decode import DECODERS, REGISTRY, Codec, Registry, decode_bytes
from pixelloom.plans import palettes as p

RNG = np.random.default_rng(5)


def noise(n: int, top: int = 256) -> bytes:
    """Bytes with runs in them."""
    return np.repeat(RNG.integers(0, top, n, np.uint8), RNG.integers(1, 9, n))[:n].tobytes()


def be16(*v):
    return struct.pack(f">{len(v)}H", *v)


def packbits(d: bytes) -> bytes:
    out, i = b"", 0
    while i < len(d):
        n = 1
        while i + n < len(d) and n < 128 and d[i + n] == d[i]:
            n += 1
        out += bytes([257 - n]) + d[i : i + 1] if n > 1 else bytes([0]) + d[i : i + 1]
        i += n
    return out


def escaped(d: bytes, escape: int, count_first: bool) -> bytes:
    out, i = b"", 0
    while i < len(d):
        n = 1
        while i + n < len(d) and n < 255 and d[i + n] == d[i]:
            n += 1
        if n > 3 or d[i] == escape:
            out += bytes([escape, n, d[i]] if count_first else [escape, d[i], n])
        else:
            out += d[i : i + n]
        i += n
    return out


def same(a, b):
    assert (a.width, a.height, a.format, a.pixels, a.palette) == (b.width, b.height, b.format, b.pixels, b.palette)


def test_c64_multicolour_family():
    body = noise(8000) + noise(1000) + noise(1000) + b"\x06"
    koa = decode_bytes(b"\0\x60" + body, "koala")
    for name, d in (
        ("koala", body), ("koala", b"\0\x60" + body + b"\0\0\0"), ("runpaint", b"\0\x60" + body), ("interpaint", b"\0\x20" + body),
        ("koala", b"\0\x60" + escaped(body, 0xFE, False)), ("ami", b"\0\x40" + escaped(body, 0xC2, True)),
        ("koala", b"\0\x20" + body[:9000] + b"\0" * 7 + body[10000:] + body[9000:10000]),
    ):
        d = d.ljust(10018, b"\0") if len(d) == 10010 else d
        same(decode_bytes(d, name), koa)
    y, x = 77, 123
    cell = y // 8 * 40 + x // 8
    pair = body[cell * 8 + y % 8] >> (6 - x % 8 // 2 * 2) & 3
    want = [6, body[8000 + cell] >> 4, body[8000 + cell] & 15, body[9000 + cell] & 15][pair]
    assert koa.array()[y, x].tolist() == p.rgb([p.C64[want]])[0].tolist()


def test_c64_interlaced():
    bitmap, screen, colour = noise(8000), noise(1000), noise(1000)
    koa = decode_bytes(bitmap + screen + colour + b"\x03", "koala")
    d = bytearray(18242)
    d[2:1002], d[0x402 : 0x402 + 1000], d[0x802 : 0x802 + 8000], d[0x2802 : 0x2802 + 8000], d[0x2742] = colour, screen, bitmap, bitmap, 3
    same(decode_bytes(bytes(d), "drazlace"), koa)
    head = b"\0\x58DRAZLACE! 1.0"
    same(decode_bytes(head + b"\x9d" + escaped(bytes(d[2:]), 0x9D, True), "drazlace"), koa)
    d[0x2744] = 1
    moved = decode_bytes(bytes(d), "drazlace").array()
    assert (moved[:, 1:] == ((koa.array()[:, 1:].astype(int) + koa.array()[:, :-1]) // 2)).all()
    f = b"\xf0\x3fFUNPAINT (MT) "
    whole = noise(33694 - 18)
    a = decode_bytes(f + b"\0\0" + whole, "funpaint")
    same(decode_bytes(f + b"\x01\x9d" + escaped(whole, 0x9D, True), "funpaint"), a)
    assert (a.width, a.height) == (296, 200)


def test_c64_hires_family():
    bitmap, screen = noise(8000), noise(1000)
    iph = decode_bytes(b"\0\x20" + bitmap + screen, "interpaint")
    same(decode_bytes(b"\0\x20" + bitmap + screen, "c64_hires"), iph)
    dd = screen.ljust(1024, b"\0") + bitmap
    same(decode_bytes(b"\0\x1c" + dd.ljust(9216, b"\0"), "c64_doodle"), iph)
    jj = escaped((b"\x22" * 1024) + b"\x0f" * 8000, 0xFE, False)
    same(decode_bytes(b"\0\x1c" + jj, "c64_doodle"), decode_bytes(b"\0\x20" + b"\x0f" * 8000 + b"\x22" * 1000, "interpaint"))
    plain = decode_bytes(b"\0\x20" + bitmap, "c64_hires").array()
    assert {tuple(c) for c in plain.reshape(-1, 3).tolist()} <= {(0, 0, 0), (255, 255, 255)}


@pytest.mark.parametrize("mode", [0, 1, 2])
def test_atari_screens(mode):
    w, h, planes, n = ((320, 200, 4, 16), (640, 200, 2, 4), (640, 400, 1, 2))[mode]
    screen, words = noise(32000), be16(*range(0, 0x777, 0x77)[:16])
    pi = decode_bytes(be16(mode) + words.ljust(32, b"\0") + screen, "degas")
    assert (pi.width, pi.height, len(pi.palette)) == (w, h, 3 * n)
    neo = decode_bytes(b"\0\0" + be16(mode) + words.ljust(32, b"\0") + bytes(92) + screen, "neo")
    same(neo, pi)
    lines = np.frombuffer(screen, np.uint8).reshape(h, w // 16, planes, 2).transpose(0, 2, 1, 3).tobytes()
    same(decode_bytes(bytes([0x80, mode]) + words.ljust(32, b"\0") + packbits(lines), "degas"), pi)
    y, x = 7, 33
    word = [screen[(y * (w // 16) + x // 16) * planes * 2 + q * 2 + x % 16 // 8] for q in range(planes)]
    assert pi.array()[y, x, 0] == sum((b >> (7 - x % 8) & 1) << q for q, b in enumerate(word))
    if mode < 2:
        head = b"CA" + bytes([0, mode]) + words[: 2 * n].ljust(2 * n, b"\0")
        ca = decode_bytes(head + screen, "crack_art")
        same(ca, pi)
        step = 160
        columns = b"".join(screen[i::step] for i in range(step))
        coded, i = b"", 0
        while i < len(columns):
            m = 1
            while i + m < len(columns) and m < 255 and columns[i + m] == columns[i]:
                m += 1
            coded += bytes([0x1B, 0, m - 1, columns[i]]) if m > 2 or columns[i] == 0x1B else columns[i : i + m]
            i += m
        same(decode_bytes(b"CA" + bytes([1, mode]) + head[4:] + bytes([0x1B, 0]) + be16(step) + coded, "crack_art"), pi)
    columns = b"".join(screen[y * 160 + x : y * 160 + x + 2] for q in range(0, 8, 2) for x in range(q, 160, 8) for y in range(200))
    control, values = b"", b""
    for i in range(0, 16000, 2000):
        control += b"\x01" + be16(2000)
        values += columns[2 * i : 2 * i + 4000]
    same(decode_bytes(bytes([mode]) + words.ljust(32, b"\0") + be16(len(control), len(values) // 2) + control + values, "tiny_stuff"), pi)


def test_spectrum_and_photochrome():
    screen, words = bytes(160) + noise(31840), (np.arange(199 * 48) * 7 % 0x778 & 0x777).astype(">u2")
    spu = decode_bytes(screen + words.tobytes(), "spectrum512")
    assert (spu.width, spu.height, spu.format) == (320, 199, "rgb888")
    planes = b"".join(screen[i : i + 2] for q in range(0, 8, 2) for i in range(160 + q, 32000, 8))
    literal = b"".join(bytes([len(planes[i : i + 128]) - 1]) + planes[i : i + 128] for i in range(0, len(planes), 128))
    colours = b""
    for block in words.reshape(-1, 16):
        block = block.copy()
        block[15] = 0
        colours += be16(0x7FFF) + block[:15].tobytes()
    zeroed = words.reshape(-1, 16).copy()
    zeroed[:, 15] = 0
    spc = decode_bytes(b"SP\0\0" + struct.pack(">II", len(literal), len(colours)) + literal + colours, "spectrum512")
    same(spc, decode_bytes(screen + zeroed.tobytes(), "spectrum512"))
    plain = noise(32000)
    table = np.zeros(199 * 48 + 16, ">u2")
    table[:] = 0x123
    pcs = b"\x01\x40\x00\xc8\x00\x00" + be16(1) + b"\x01" + be16(32000) + plain + be16(1) + b"\x00" + be16(len(table)) + be16(0x123)
    got = decode_bytes(pcs, "photochrome")
    assert (got.array() == got.array()[0, 0]).all() and got.array()[0, 0].tolist() == [36, 73, 109]
    ste = decode_bytes(pcs[:-2] + be16(0x823), "photochrome")
    assert ste.array()[0, 0].tolist() == [17, 68, 102]


def test_doodle():
    d = noise(32000)
    s = decode_bytes(d, "doodle")
    assert s.array()[3, 9].tolist() == [0 if d[3 * 80 + 1] >> 6 & 1 else 255] * 3


def pcx(w, h, bits, planes, lines, palette=bytes(48), version=5, tail=b"", encoding=1):
    line = len(lines[0]) // planes
    head = bytes([10, version, encoding, bits]) + struct.pack("<4H", 0, 0, w - 1, h - 1) + bytes(4) + palette + b"\0" + bytes([planes]) + struct.pack("<HH", line, 1)
    data = b"".join(b"".join(bytes([0xC1, b]) for b in row) for row in lines)
    return head.ljust(128, b"\0") + data + tail


def test_pcx():
    px = np.arange(12, dtype=np.uint8).reshape(2, 6)
    grey = decode_bytes(pcx(6, 2, 8, 1, [r.tobytes() for r in px], tail=bytes(769)), "pcx")
    assert grey.array()[:, :, 0].tolist() == px.tolist() and grey.palette[3:6] == b"\1\1\1"
    own = decode_bytes(pcx(6, 2, 8, 1, [r.tobytes() for r in px], tail=b"\x0c" + noise(768), encoding=0), "pcx")
    assert own.pixels == grey.pixels and own.palette != grey.palette
    rgb = decode_bytes(pcx(2, 1, 8, 3, [b"\x01\x02\x03\x04\x05\x06"]), "pcx")
    assert rgb.format == "rgb888" and rgb.array().tolist() == [[[1, 3, 5], [2, 4, 6]]]
    packed = decode_bytes(pcx(4, 1, 4, 1, [b"\x12\x34"], palette=noise(48)), "pcx")
    assert packed.array()[0, :, 0].tolist() == [1, 2, 3, 4]
    planar = decode_bytes(pcx(4, 1, 1, 4, [bytes([0b10100000, 0b01100000, 0b00010000, 0])]), "pcx")
    assert planar.array()[0, :, 0].tolist() == [1, 2, 3, 4]
    cga = decode_bytes(pcx(4, 1, 2, 1, [b"\x1b"], palette=b"\x10\0\0\x30".ljust(48, b"\0")), "pcx")
    assert cga.array()[0, :, 0].tolist() == [0, 1, 2, 3] and cga.palette == p.rgb([p.CGA[1], *p.CGA0_LOW[1:]]).tobytes()
    with pytest.raises(DecodeError) as e:
        decode_bytes(pcx(6, 2, 8, 1, [bytes(6)], tail=bytes(769)), "pcx")
    assert e.value.kind == "truncated_data"


def test_dcx_pages():
    page = pcx(4, 1, 4, 1, [b"\x12\x34"])
    colour = pcx(2, 1, 8, 3, [b"\x01\x02\x03\x04\x05\x06"])
    d = struct.pack("<5I", 0x3ADE68B1, 20, 20 + len(page), 20 + len(page) + len(colour), 0) + page + colour + page
    s = decode_bytes(d, "dcx")
    assert (s.width, s.height, s.format) == (4, 3, "rgb888") and [r["y"] for r in s.subrects] == [0, 1, 2] and s.subrects[1]["kind"] == "frame"
    assert s.array()[1, 0].tolist() == [1, 3, 5] and s.array()[0].reshape(-1)[:4].tolist() == [1, 2, 3, 4]


def bmp(w, h, bits, data, compression=0, palette=b"", colours=0, size=40, extra=b""):
    off = 14 + size + len(extra) + len(palette)
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", off + len(data), 0, off, size, w, h, 1, bits, compression, len(data), 0, 0, colours, 0).ljust(12 + size, b"\0") + extra + palette + data


def test_bmp():
    grey = b"".join(bytes([i, i, i, 0]) for i in range(256))
    px = np.arange(8, dtype=np.uint8).reshape(2, 4)
    raw = decode_bytes(bmp(4, 2, 8, px[::-1].tobytes(), palette=grey), "bmp")
    assert raw.array()[:, :, 0].tolist() == px.tolist()
    same(decode_bytes(bmp(4, -2, 8, px.tobytes(), palette=grey), "bmp"), raw)
    rle = b"\0\x04" + px[1].tobytes() + b"\0\0" + b"".join(bytes([1, v]) for v in px[0].tolist()) + b"\0\1"
    same(decode_bytes(bmp(4, 2, 8, rle, 1, grey), "bmp"), raw)
    four = grey[: 16 * 4]
    raw4 = decode_bytes(bmp(4, 2, 4, b"\x45\x67\0\0\x01\x23\0\0", palette=four), "bmp")
    assert raw4.array()[:, :, 0].tolist() == px.tolist()
    same(decode_bytes(bmp(4, 2, 4, b"\x02\x45\x02\x67\0\0\0\x04\x01\x23\0\1", 2, four), "bmp"), raw4)
    c = decode_bytes(bmp(1, 1, 24, b"\x01\x02\x03\0"), "bmp")
    assert c.array()[0, 0].tolist() == [3, 2, 1, 255]
    same(decode_bytes(bmp(1, 1, 32, b"\x01\x02\x03\x09"), "bmp"), c)
    assert decode_bytes(bmp(1, 1, 16, b"\xff\x7f\0\0"), "bmp").array()[0, 0].tolist() == [248, 248, 248, 255]
    masks = struct.pack("<3I", 0xF800, 0x7E0, 0x1F)
    assert decode_bytes(bmp(1, 1, 16, b"\xe0\x07\0\0", 3, extra=masks), "bmp").array()[0, 0].tolist() == [0, 252, 0, 255]
    core = b"BM" + struct.pack("<IIIIhhHH", 0, 0, 26 + 6, 12, 8, 1, 1, 1) + bytes([0, 0, 0, 9, 8, 7]) + b"\xa0\0\0\0"
    s = decode_bytes(core, "bmp")
    assert s.array()[0, :, 0].tolist() == [1, 0, 1, 0, 0, 0, 0, 0] and s.palette == bytes([0, 0, 0, 7, 8, 9])
    narrow = decode_bytes(bmp(4, 1, 8, b"\1\2\3\4"), "bmp")
    assert narrow.format == "rgba8888" and narrow.pixels == b"\1\2\3\4" + bytes(12)


def sun(w, h, depth, kind, data, cmap=b""):
    return struct.pack(">8I", 0x59A66A95, w, h, depth, len(data), kind, 1 if cmap else 0, len(cmap)) + cmap + data


def test_sun_sgi_msp_pictor():
    d = noise(64)
    raw = decode_bytes(sun(8, 8, 8, 1, d, noise(768)), "sunrast")
    assert raw.array()[:, :, 0].tobytes() == d
    coded = b"".join(bytes([0x80, 0]) if b == 0x80 else bytes([b]) for b in d)
    assert decode_bytes(sun(8, 8, 8, 2, coded, bytes(768)), "sunrast").pixels == raw.pixels
    assert decode_bytes(sun(1, 1, 24, 1, b"\1\2\3\0"), "sunrast").array()[0, 0].tolist() == [3, 2, 1, 255]
    assert decode_bytes(sun(1, 1, 32, 3, b"\0\1\2\3"), "sunrast").array()[0, 0].tolist() == [1, 2, 3, 255]
    head = lambda store, unit, n: b"\x01\xda" + bytes([store, unit]) + be16(3, 4, 2, n) + bytes(92) + bytes(4) + bytes(404)
    body = noise(24)
    plain = decode_bytes(head(0, 1, 3) + body, "sgi")
    assert plain.array()[0, 1].tolist() == [body[5], body[13], body[21]]
    rows = [bytes([0x84]) + body[4 * i : 4 * i + 4] + b"\0" for i in range(6)]
    table = struct.pack(">6I", *[512 + 48 + 6 * i for i in range(6)]) + struct.pack(">6I", *[6] * 6)
    same(decode_bytes(head(1, 1, 3) + table + b"".join(rows), "sgi"), plain)
    wide = b"".join(bytes([b, 7]) for b in body)
    same(decode_bytes(head(0, 2, 3) + wide, "sgi"), plain)
    bits = noise(6)
    one = decode_bytes(b"DanM" + struct.pack("<HH", 16, 3) + bytes(24) + bits, "msp")
    rows = [b"\x02" + bits[2 * i : 2 * i + 2] for i in range(3)]
    same(decode_bytes(b"LinS" + struct.pack("<HH", 16, 3) + bytes(24) + struct.pack("<3H", 3, 3, 3) + b"".join(rows), "msp"), one)
    assert one.array()[0, 0, 0] == 1 - (bits[0] >> 7)
    pic = lambda data: b"\x34\x12" + struct.pack("<HH", 4, 2) + bytes(4) + b"\x08\xff\0" + struct.pack("<HH", 0, 0) + data
    px = bytes(range(8))
    flat = decode_bytes(pic(b"\0\0" + px), "pictor")
    assert flat.array()[:, :, 0].tolist() == [[4, 5, 6, 7], [0, 1, 2, 3]]
    block = b"".join(b"\xee\x01" + bytes([b]) for b in px)
    same(decode_bytes(pic(b"\1\0" + struct.pack("<HH", 5 + len(block), 8) + b"\xee" + block), "pictor"), flat)


def test_pnm():
    text = b"P3 # a comment\n2 1\n15\n15 0 7 1 2 3\n"
    binary = b"P6 2 1 15\n" + bytes([15, 0, 7, 1, 2, 3])
    same(decode_bytes(text, "pnm"), decode_bytes(binary, "pnm"))
    assert decode_bytes(text, "pnm").array()[0, 0].tolist() == [255, 0, 119]
    same(decode_bytes(b"P1 4 1 1 0 0 1", "pnm"), decode_bytes(b"P4 4 1 \x90", "pnm"))
    same(decode_bytes(b"P2 1 1 255 200", "pnm"), decode_bytes(b"P5 1 1 65535 \xc8\xff", "pnm"))
    swallowed = decode_bytes(b"P5 2 1 255 \x09\x40\x41", "pnm")
    assert swallowed.array()[0, :, 0].tolist() == [0x40, 0x41]


def iff(form, **chunks):
    body = form + b"".join(k.encode() + struct.pack(">I", len(v)) + v + b"\0" * (len(v) & 1) for k, v in chunks.items())
    return b"FORM" + struct.pack(">I", len(body)) + body


def bmhd(w, h, planes, masking=0, packing=0):
    return struct.pack(">HHhhBBBBHBBhh", w, h, 0, 0, planes, masking, packing, 0, 0, 1, 1, w, h)


def test_lbm():
    rows = noise(2 * 4 * 3)
    raw = decode_bytes(iff(b"ILBM", BMHD=bmhd(16, 3, 4), CMAP=noise(48), BODY=rows), "lbm")
    bits = np.unpackbits(np.frombuffer(rows, np.uint8).reshape(3, 4, 2), axis=2)
    assert (raw.array()[:, :, 0] == sum(bits[:, q].astype(int) << q for q in range(4))).all()
    per_plane = b"".join(packbits(rows[i : i + 2]) for i in range(0, 24, 2))
    assert decode_bytes(iff(b"ILBM", BMHD=bmhd(16, 3, 4, 0, 1), CMAP=b"", BODY=per_plane), "lbm").pixels == raw.pixels
    per_line = b"".join(bytes([7]) + rows[i : i + 8] for i in range(0, 24, 8))
    assert decode_bytes(iff(b"ILBM", BMHD=bmhd(16, 3, 4, 0, 1), BODY=per_line), "lbm").pixels == raw.pixels
    chunky = decode_bytes(iff(b"PBM ", BMHD=bmhd(3, 2, 8), BODY=bytes(range(6))), "lbm")
    assert chunky.array()[:, :, 0].tolist() == [[0, 1, 2], [3, 4, 5]] and chunky.palette[3:6] == b"\1\1\1"
    ehb = decode_bytes(iff(b"ILBM", BMHD=bmhd(16, 1, 6), CMAP=bytes(range(96)), CAMG=struct.pack(">I", 0x80), BODY=bytes(12)), "lbm")
    assert len(ehb.palette) == 192 and ehb.palette[96 + 4] == 2
    codes = [0b000011, 0b011111, 0b100001, 0b110010]
    planes = b"".join(bytes([sum((c >> q & 1) << (7 - i) for i, c in enumerate(codes)), 0]) for q in range(6))
    ham = decode_bytes(iff(b"ILBM", BMHD=bmhd(4, 1, 6), CMAP=bytes(range(48)), CAMG=struct.pack(">I", 0x800), BODY=planes), "lbm")
    assert ham.array()[0].tolist() == [[9, 10, 11, 255], [9, 10, 255, 255], [17, 10, 255, 255], [17, 34, 255, 255]]
    deep = decode_bytes(iff(b"ILBM", BMHD=bmhd(16, 1, 24, 1), BODY=b"\x80\0" * 24 + b"\0\0"), "lbm")
    assert deep.array()[0, 0].tolist() == [255, 255, 255, 0]


def test_qoi_repeats_when_cut():
    head = b"qoif" + struct.pack(">II", 5, 1) + b"\4\0"
    d = head + b"\xff\x0a\x14\x1e\x28" + b"\x7f" + b"\xa5\x88" + b"\xc0" + bytes(7) + b"\1"
    s = decode_bytes(d, "qoi").array()[0].tolist()
    assert s[0] == [10, 20, 30, 40] and s[1] == [11, 21, 31, 40] and s[2] == [16, 26, 36, 40] and s[3] == s[4] == s[2]


def lzw_plain(px: bytes, bits: int) -> bytes:
    codes, out, n = [], 0, 0
    for i, v in enumerate(px):
        if i % 2 == 0:
            codes.append(1 << bits)
        codes.append(v)
    codes.append((1 << bits) + 1)
    for v in codes:
        out |= v << n
        n += bits + 1
    data = out.to_bytes((n + 7) // 8, "little")
    return bytes([bits, len(data)]) + data + b"\0"


def test_gif_and_tga():
    table = bytes(range(12))
    g = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x81, 0, 0) + table + b"\x21\xf9\x04\x01\0\0\x03\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 2, 2, 0) + lzw_plain(b"\0\1\2\3", 2) + b";"
    px = decode_bytes(g, "gif").array()
    assert px[0, 1].tolist() == [3, 4, 5, 255] and px[1, 1].tolist() == [0, 0, 0, 0]
    head = lambda kind, bits, flags=0x20: bytes([0, 0, kind]) + bytes(9) + struct.pack("<HHBB", 2, 2, bits, flags)
    body = bytes(range(12))
    raw = decode_bytes(head(2, 24) + body, "tga")
    assert raw.array()[0, 0].tolist() == [2, 1, 0, 255]
    same(decode_bytes(head(10, 24) + b"\x03" + body, "tga"), raw)
    assert (decode_bytes(head(2, 24, 0) + body, "tga").array()[::-1] == raw.array()).all()
    assert decode_bytes(head(3, 8) + b"\x85" * 4, "tga").array()[1, 1].tolist() == [133, 133, 133, 255]


def png_of(w, h, depth, kind, rows, extra=b""):
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_png():
    a = RNG.integers(0, 256, (9, 7, 4), np.uint8)
    s = surface(a, "rgba8888")
    same(decode_bytes(encode(s), "png"), s)
    rows, above = b"", np.zeros(28, int)
    for y, kind in enumerate([0, 1, 2, 3, 4, 4, 3, 2, 1]):
        row = a[y].reshape(-1).astype(int)
        left, corner = np.concatenate([[0] * 4, row[:-4]]), np.concatenate([[0] * 4, above[:-4]])
        guess = left + above - corner
        d = np.abs([guess - left, guess - above, guess - corner])
        paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], above, corner))
        rows += bytes([kind]) + ((row - [0 * row, left, above, (left + above) // 2, paeth][kind]) % 256).astype(np.uint8).tobytes()
        above = row
    same(decode_bytes(png_of(7, 9, 8, 6, rows), "png"), s)
    indexed = decode_bytes(png_of(3, 1, 2, 3, b"\0\x18", struct.pack(">I", 9) + b"PLTE" + bytes(range(9)) + bytes(4)), "png")
    assert indexed.array()[0].tolist() == [[0, 1, 2, 255], [3, 4, 5, 255], [6, 7, 8, 255]]
    assert decode_bytes(png_of(1, 1, 16, 0, b"\0\x12\x34"), "png").array()[0, 0].tolist() == [18, 18, 18, 255]


def icon(side, v):
    px = np.full((side, side, 4), v, np.uint8)
    return struct.pack("<IiiHHIIiiII", 40, side, 2 * side, 1, 32, 0, 0, 0, 0, 0, 0) + px.tobytes() + bytes((side + 31) // 32 * 4 * side)


def test_icons():
    parts = [icon(16, 1), icon(32, 2), encode(surface(np.full((48, 48, 4), 3, np.uint8), "rgba8888"))]
    at, head, body = 6 + 16 * 3, struct.pack("<HHH", 0, 1, 3), b""
    for side, part in zip((16, 32, 48), parts):
        head += struct.pack("<BBBBHHII", side, side, 0, 0, 1, 32, len(part), at + len(body))
        body += part
    s = decode_bytes(head + body, "ico")
    assert (s.width, s.height) == (48, 96) and [(r["y"], r["w"], r["kind"], r["user_tag"]) for r in s.subrects] == [(0, 16, "sprite", 0), (16, 32, "sprite", 1), (48, 48, "sprite", 2)]
    one = struct.pack("<IiiHHIIiiII", 40, 8, 16, 1, 1, 0, 0, 0, 0, 0, 0) + bytes([0, 0, 0, 0, 7, 8, 9, 0]) + b"\xf0\0\0\0" * 8 + b"\x81\0\0\0" * 8
    s = decode_bytes(struct.pack("<HHHBBBBHHII", 0, 1, 1, 8, 8, 0, 0, 1, 1, len(one), 22) + one, "ico")
    assert s.array()[0, 0].tolist() == [9, 8, 7, 0] and s.array()[0, 1].tolist() == [9, 8, 7, 255] and s.array()[0, 5].tolist() == [0, 0, 0, 255]
    ne = b"MZ" + bytes(58) + struct.pack("<I", 64) + b"NE" + bytes(34) + struct.pack("<H", 64) + bytes(26)
    ne += struct.pack("<H", 4) + struct.pack("<HHI", 0x8003, 1, 0) + struct.pack("<HHHHI", 16, len(parts[0]) // 16 + 1, 0, 0, 0) + struct.pack("<H", 0)
    s = decode_bytes(ne.ljust(256, b"\0") + parts[0].ljust(len(parts[0]) + 16, b"\0"), "exe_icon")
    assert (s.width, s.height) == (16, 16) and s.array()[0, 0].tolist() == [1, 1, 1, 1]


def test_errors_and_limits():
    for name in DECODERS:
        for d in (b"", b"\0", noise(300)):
            try:
                decode_bytes(d, name)
            except DecodeError:
                pass
    with pytest.raises(DecodeError) as e:
        decode_bytes(noise(32000), "doodle", Options(100, 100))
    assert e.value.kind == "dimensions_exceeded"
    with pytest.raises(DecodeError) as e:
        decode_bytes(b"", "nothing")
    assert e.value.message == "Unknown codec: nothing"


def test_registry():
    r = Registry()
    r.register(None)
    r.register(Codec("mine", ".m", lambda d: d[:1] == b"m", lambda d, o: surface(np.zeros((1, 1), np.uint8), "indexed8")))
    assert r.count() == REGISTRY.count() + 1 == 32 and r.at(31) == "mine" and r.at(32) is None and r.at(0) == "pcx"
    assert decode_bytes(b"m", "mine", registry=r).width == 1

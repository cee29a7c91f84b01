"""Which codec an input belongs to: the first whose predicate holds, in the order of registration. One native CASE over length and content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions.columns import C, byte_at, bytes_of, col, number_at

#: Fixed: codecs in the order in which they are tried, with the usual file extensions (which play no part in detection).
CODECS: list[tuple[str, str]] = [
    ("pcx", ".pcx .pcc"), ("png", ".png"), ("lbm", ".lbm .ilbm .iff .bbm"), ("jpeg", ".jpg .jpeg .jpe .jfif"), ("tga", ".tga .targa"), ("gif", ".gif"),
    ("bmp", ".bmp .dib"), ("sunrast", ".ras .sun"), ("pictor", ".pic .clp"), ("sgi", ".sgi .rgb .rgba .bw"), ("pnm", ".ppm .pgm .pbm .pnm"), ("dcx", ".dcx"),
    ("msp", ".msp"), ("neo", ".neo"), ("degas", ".pi1 .pi2 .pi3 .pc1 .pc2 .pc3"), ("crack_art", ".ca1 .ca2 .ca3"), ("spectrum512", ".spu .spc"),
    ("photochrome", ".pcs"), ("tiny_stuff", ".tn1 .tn2 .tn3"), ("doodle", ".doo"), ("qoi", ".qoi"), ("ico", ".ico .cur"), ("exe_icon", ".exe .dll .scr"),
    ("c64_doodle", ".dd .ddp .jj"), ("runpaint", ".rpm"), ("interpaint", ".iph .ipt"), ("ami", ".ami"), ("funpaint", ".fp2 .fun .vic"),
    ("c64_hires", ".hbm .fgs .gih .rpo .dd .mon .gcd .hpi"), ("koala", ".koa .kla .koala .gg .gig"), ("drazlace", ".drl"),
]


def _is(content: Column, at: int, mark: bytes) -> Column:
    return F.substring(content, at + 1, len(mark)) == F.unhex(F.lit(mark.hex()))


def escaped_size(content: Column, escape: int = 0xFE) -> Column:
    """Bytes that escape, value, count codes from place 2 on expand to; -1 if the input ends within one. A fold: only for short inputs."""
    start = F.struct(F.lit(0).alias("state"), F.lit(0).alias("n"))

    def step(s: Column, b: Column) -> Column:
        state = F.when((s["state"] == 0) & (b == escape), 1).when(s["state"] == 1, 2).otherwise(0)
        n = s["n"] + F.when((s["state"] == 0) & (b != escape), 1).when(s["state"] == 2, b).otherwise(0)
        return F.struct(state.alias("state"), n.alias("n"))

    return F.aggregate(F.slice(bytes_of(content), 3, 1 << 20), start, step, lambda s: F.when(s["state"] == 0, s["n"]).otherwise(-1))


def predicates(content: C = "content", length: C | None = None) -> dict[str, Column]:
    """Each codec's predicate by itself."""
    c = col(content)
    n = col(length) if length is not None else F.octet_length(c)
    b = lambda i: byte_at(c, i)
    le = lambda i, size=2: number_at(c, i, size)
    be = lambda i, size=2: number_at(c, i, size, big=True)
    load = le(0)
    space = [9, 10, 11, 12, 13, 32]
    top = F.when(b(0) > 2, 4).otherwise(0)
    tiny = F.lit(37) + top + be(top + 33) + 2 * be(top + 35)
    program = number_at(c, 60, 4).cast("int")
    mark = F.substring(c, program + 1, F.lit(4))
    return {
        "pcx": (n >= 128) & (b(0) == 10) & b(1).isin(0, 2, 3, 4, 5) & (b(2) <= 1) & b(3).isin(1, 2, 4, 8),
        "png": _is(c, 0, b"\x89PNG\r\n\x1a\n"),
        "lbm": (n >= 12) & _is(c, 0, b"FORM") & (_is(c, 8, b"ILBM") | _is(c, 8, b"PBM ")),
        "jpeg": _is(c, 0, b"\xff\xd8\xff"),
        "tga": (n >= 18) & b(2).isin(0, 1, 2, 3, 9, 10, 11) & (b(1) <= 1) & b(16).isin(8, 15, 16, 24, 32) & le(12).between(1, 32768) & le(14).between(1, 32768),
        "gif": _is(c, 0, b"GIF87a") | _is(c, 0, b"GIF89a"),
        "bmp": _is(c, 0, b"BM"),
        "sunrast": _is(c, 0, b"\x59\xa6\x6a\x95"),
        "pictor": _is(c, 0, b"\x34\x12"),
        "sgi": _is(c, 0, b"\x01\xda"),
        "pnm": (n >= 3) & (b(0) == 80) & b(1).between(49, 54) & b(2).isin(*space),
        "dcx": _is(c, 0, b"\xb1\x68\xde\x3a"),
        "msp": _is(c, 0, b"DanM") | _is(c, 0, b"LinS"),
        "neo": (n == 32128) & _is(c, 0, b"\0\0") & (be(2) <= 2),
        "degas": (n >= 34) & (b(1) <= 2) & ((b(0) == 0) & n.isin(32034, 32066, 32128) | (b(0) == 0x80)),
        "crack_art": (n >= 8) & _is(c, 0, b"CA") & (b(2) <= 1) & (b(3) <= 2),
        "spectrum512": (n == 51104) | (n >= 12) & _is(c, 0, b"SP"),
        "photochrome": (n >= 18) & _is(c, 0, b"\x01\x40\x00\xc8"),
        "tiny_stuff": (n >= 42) & (b(0) <= 5) & (tiny <= n) & (n <= tiny + 16),
        "doodle": (n == 32000) & ~_is(c, 0, b"CA"),
        "qoi": (n >= 14) & _is(c, 0, b"qoif") & (be(4, 4) > 0) & (be(8, 4) > 0) & b(12).isin(3, 4) & (b(13) <= 1),
        "ico": (n >= 6) & (le(0) == 0) & le(2).isin(1, 2) & (le(4) > 0),
        "exe_icon": (n >= 64) & _is(c, 0, b"MZ") & (program >= 0) & ((mark == F.unhex(F.lit("50450000"))) | F.hex(F.substring(mark, 1, 2)).isin("4E45", "4C58")),
        "c64_doodle": n.isin(9026, 9217, 9218, 9346) | F.when((n >= 100) & (n < 9026), escaped_size(c).isin(9024, 9216)).otherwise(False),
        "runpaint": n.isin(10003, 10006) & load.isin(0x6000, 0x4000, 0x5C00, 0x2000),
        "interpaint": n.isin(9002, 9003, 9009, 10003),
        "ami": (n >= 100) & (n < 10001) & (load == 0x4000) & ((n < 9000) | F.contains(F.substring(c, 3, 498), F.unhex(F.lit("C2")))),
        "funpaint": _is(c, 2, b"FUNPAINT (MT) "),
        "c64_hires": n.isin(8002, 8194, 9002, 9003, 9009) & load.isin(0x2000, 0x4000, 0x6000, 0xA000, 0x5C00, 0x4100, 0x3F40, 0x1C00, 0x6C00),
        "koala": n.isin(10001, 10003, 10006, 10018)
        | (n >= 100) & (n < 10001) & load.isin(0x6000, 0x4000, 0x2000, 0x5C00) & F.contains(F.substring(c, F.lit(3), n - 2), F.unhex(F.lit("FE"))),
        "drazlace": (n == 18242) | _is(c, 2, b"DRAZLACE! 1.0"),
    }


def detect(content: C = "content", length: C | None = None, first: str | None = None) -> Column:
    """The codec's name; null if none fits. first: a codec that is tried before the others, as where an extension says it: files of formats
    without a mark can begin with another format's by chance."""
    out, tests = None, predicates(content, length)
    for name in sorted((n for n, _ in CODECS), key=lambda n: n != first):
        test = F.coalesce(tests[name], F.lit(False))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def codecs(spark: SparkSession, more: list[tuple[str, str]] = ()) -> DataFrame:
    """ord, name, extensions of the built-in codecs, then of more."""
    rows = ", ".join(f"({i}, '{name}', split('{ext}', ' '))" for i, (name, ext) in enumerate([*CODECS, *more]))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(ord, name, extensions)")

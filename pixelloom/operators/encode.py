"""Run-length encoders as Column expressions, binary to binary, in the codes that operators/rle.py reads. Those of bulk.py work on a batch at once; the
others are native, and find runs by one regular expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelloom.functions.columns import C, col
from pixelloom.operators import bulk


def hexed(n: Column, digits: int = 2) -> Column:
    """A number in hex, with zeros before."""
    return F.lpad(F.hex(n.cast("long")), digits, "0")


def joined(parts: Column) -> Column:
    """Binary of an array of hex strings."""
    return F.unhex(F.array_join(parts, ""))


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), x being worked out once however often f uses it."""
    return F.transform(F.array(x), f)[0]


def latin(content: C) -> Column:
    """Bytes as a string with a character for each."""
    return F.decode(col(content), "ISO-8859-1")


def body(t: Column) -> Column:
    """latin() undone, in hex."""
    return F.hex(F.encode(t, "ISO-8859-1"))


def tokens(text: Column, most_run: int, most_literal: int = 128, least_run: int = 2, unit: int = 1) -> Column:
    """A string cut into runs (least_run to most_run equal units) and stretches of up to most_literal units of which none begins a run."""
    u, again = "." * unit, least_run - 1
    return F.regexp_extract_all(text, F.lit(rf"(?s)(({u})\2{{{again},{most_run - 1}}}|(?:({u})(?!\3{{{again}}})){{1,{most_literal}}})"), F.lit(1))


def coded(found: Column, run: Callable[[Column, Column], Column], literal: Callable[[Column, Column], Column], least_run: int = 2, unit: int = 1, whole: Callable[[Column], Column] = body) -> Column:
    """Hex of each token: run(number of units, unit in hex) or literal(number of units, all in hex)."""

    def one(t: Column) -> Column:
        n = (F.length(t) / unit).cast("int")
        first = F.substring(t, 1, unit)
        return F.when((n >= least_run) & (t == F.repeat(first, n)), run(n, whole(first))).otherwise(literal(n, whole(t)))

    return F.transform(found, one)


def pcx(content: C) -> Column:
    return bulk.column(col(content), bulk.pcx)


def packbits(content: C) -> Column:
    """ByteRun1 too."""
    return bulk.column(col(content), bulk.packbits)


def spc(content: C) -> Column:
    return bulk.column(col(content), bulk.spc)


def bmp8(content: C) -> Column:
    """One row of indices, with the end of bitmap."""

    def literal(n: Column, v: Column) -> Column:
        few = F.concat(F.lit("01"), F.substring(v, 1, 2), F.when(n == 2, F.concat(F.lit("01"), F.substring(v, 3, 2))).otherwise(""))
        return F.when(n < 3, few).otherwise(F.concat(F.lit("00"), hexed(n), v, F.when(n % 2 == 1, "00").otherwise("")))

    return F.concat(joined(coded(tokens(latin(content), 255, 255), lambda n, v: F.concat(hexed(n), v), literal)), F.unhex(F.lit("0001")))


def bmp4(content: C) -> Column:
    """One row of indices, a hex digit each: two to a byte of content."""

    def literal(n: Column, v: Column) -> Column:
        few = F.concat(F.lit("01"), F.repeat(F.substring(v, 1, 1), F.lit(2)), F.when(n == 2, F.concat(F.lit("01"), F.repeat(F.substring(v, 2, 1), F.lit(2)))).otherwise(""))
        return F.when(n < 3, few).otherwise(F.concat(F.lit("00"), hexed(n), F.rpad(v, (F.ceil(n / 4) * 4).cast("int"), F.lit("0"))))

    found = tokens(F.hex(col(content)), 255, 255)
    return F.concat(joined(coded(found, lambda n, v: F.concat(hexed(n), v, v), literal, whole=lambda t: t)), F.unhex(F.lit("0001")))


def sun(content: C) -> Column:
    return joined(coded(tokens(latin(content), 256, 1), lambda n, v: F.concat(F.lit("80"), hexed(n - 1), v), lambda n, v: F.when(v == "80", "8000").otherwise(v)))


def pictor(content: C, block: int = 8192, marker: str = "65") -> Column:
    """The number of blocks, then the blocks, each with its size, length and marker."""
    return bulk.column(col(content), lambda units, at: bulk.pictor(units, at, block, int(marker, 16)))


def little(n: Column, size: int) -> Column:
    """A number as size bytes, the lowest first, in hex."""
    n = n.cast("long")
    return F.concat(*[hexed(F.shiftright(n, 8 * k).bitwiseAND(255)) for k in range(size)])


def sgi8(content: C) -> Column:
    return F.concat(joined(coded(tokens(latin(content), 127, 127), lambda n, v: F.concat(hexed(n), v), lambda n, v: F.concat(hexed(n + 128), v))), F.unhex(F.lit("00")))


def sgi16(content: C) -> Column:
    """content has two bytes for each sample."""
    found = tokens(latin(content), 127, 127, unit=2)
    return F.concat(joined(coded(found, lambda n, v: F.concat(hexed(n, 4), v), lambda n, v: F.concat(hexed(n + 128, 4), v), unit=2)), F.unhex(F.lit("0000")))


def msp(content: C) -> Column:
    return joined(coded(tokens(latin(content), 255, 255), lambda n, v: F.concat(F.lit("00"), hexed(n), v), lambda n, v: F.concat(hexed(n), v)))


def escaped(content: C, escape: str, count_first: bool) -> Column:
    """Codes of 8-bit machines; runs of four or more, and the escape itself."""
    return bulk.column(col(content), lambda units, at: bulk.escaped(units, at, int(escape, 16), count_first))


def crack_art(content: C, size: int = 32000, step: int = 160, escape: str = "65", default: str = "00") -> Column:
    """The escape, the default, the step and the codes of the bytes, taken step by step. All five codes of runs are used."""
    return bulk.column(col(content), lambda units, at: bulk.crack_art(units, at, size, step, int(escape, 16), int(default, 16)))


def tiny(content: C) -> Column:
    """Number of control bytes and of value words, then both streams, of a 32000-byte screen."""
    return bulk.column(col(content), bulk.tiny)


def photochrome(parts: list[tuple[Column, int]]) -> Column:
    """Blocks of (bytes, unit): the number of commands, then these with their values between them."""
    return F.concat(*[bulk.column(content, lambda units, at, unit=unit: bulk.photochrome(units, at, unit)) for content, unit in parts])


def rows(content: C, size: int, n: int | None, f: Callable[[Column], Column]) -> Column:
    """The first n rows of size bytes, each encoded by f: a batch at once where bulk.py has the encoder, which takes None for all rows too."""
    if f in (pcx, packbits, spc):
        return bulk.column(col(content), bulk.in_rows(getattr(bulk, f.__name__), size, n))
    return joined(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda y: F.hex(f(F.substring(col(content), y * size + 1, F.lit(size))))))

"""Run-length encoders for many binaries at once, in numpy: a batch's bytes in one array, cut into segments that no code passes. The tokens are those of
operators/encode.py but for what is left of a run longer than a code takes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

#: Bytes of input that are worked on at once; the arrays of places take some 60 times as much.
CHUNK = 1 << 20

Bulk = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]  # bytes and bounds of the binaries in, the same out


def bounds(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each stretch, one stretch after the other."""
    return np.repeat(starts - bounds(sizes)[:-1], sizes) + np.arange(int(sizes.sum()))


def parts_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of binaries, and where each begins and the last ends; null is empty."""
    array = array.cast(pa.large_binary())
    at = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8)
    return np.frombuffer(array.buffers()[2] or b"", np.uint8), at


def binaries(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    made = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(np.ascontiguousarray(flat, np.uint8))])
    return made.cast(pa.binary())


def column(content: Column, f: Bulk) -> Column:
    """f as a Column expression, a batch at a time; null stays."""

    @arrow_udf("binary")
    def run(array: pa.Array) -> pa.Array:
        flat, at = parts_of(array)
        out, i = [], 0
        while i < len(array):
            j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, "right")) - 1)
            out.append(binaries(*f(flat[at[i] : at[j]], at[i : j + 1] - at[i])))
            i = j
        made = pa.concat_arrays(out) if out else pa.array([], pa.binary())
        return pa.compute.if_else(array.is_valid(), made, pa.scalar(None, pa.binary())) if array.null_count else made

    return run(content)


def tokens(units: np.ndarray, at: np.ndarray, least: int, most: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of units, and whether it is a run, of the tokens of segments: runs of least to most equal units, literals of up to longest."""
    if not len(units):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    first = np.empty(len(units), bool)
    first[1:] = units[1:] != units[:-1]
    first[0] = True
    edges = at[:-1][at[:-1] < len(units)]
    first[edges] = True
    edge = np.zeros(len(units), bool)
    edge[edges] = True
    start = np.flatnonzero(first)
    n = np.diff(np.append(start, len(units)))
    pieces = np.where(n >= least, -(-n // most), 1)
    if (pieces > 1).any():
        order = spread(np.zeros(len(n), np.int64), pieces)
        start, n = np.repeat(start, pieces) + order * most, np.minimum(np.repeat(n, pieces) - order * most, np.where(np.repeat(pieces, pieces) > 1, most, np.repeat(n, pieces)))
    run = n >= least
    begins = np.ones(len(start), bool)  # neighbouring literals of a segment become one
    begins[1:] = run[1:] | run[:-1] | edge[start[1:]]
    head = np.flatnonzero(begins)
    start, run, n = start[head], run[head], np.add.reduceat(n, head)
    pieces = np.where(run, 1, -(-n // longest))
    order = spread(np.zeros(len(n), np.int64), pieces)
    whole, run = np.repeat(n, pieces), np.repeat(run, pieces)
    return np.repeat(start, pieces) + order * longest, np.where(run, whole, np.minimum(whole - order * longest, longest)), run


def assembled(units: np.ndarray, at: np.ndarray, start: np.ndarray, heads: np.ndarray, heading: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of tokens, each the first heading of its heads and then body units from start; and the bounds of the segments in them."""
    raw = units.view(np.uint8)
    width = units.itemsize
    size = heading + body * width
    to = bounds(size)
    out = np.empty(to[-1], np.uint8)
    for k in range(heads.shape[1]):
        has = heading > k
        out[to[:-1][has] + k] = heads[has, k]
    out[spread(to[:-1] + heading, body * width)] = raw[spread(start * width, body * width)]
    return out, to[np.searchsorted(start, at)]


def _heads(n: int, columns: int) -> np.ndarray:
    return np.zeros((n, columns), np.uint8)


def pcx(units: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, n, run = tokens(units, at, 2, 63, 1)
    coded = run | (units[start] >= 0xC0)
    heads = _heads(len(n), 1)
    heads[:, 0] = 192 + n
    return assembled(units, at, start, heads, coded.astype(np.int64), np.ones(len(n), np.int64))


def packbits(units: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, n, run = tokens(units, at, 2, 128, 128)
    heads = _heads(len(n), 1)
    heads[:, 0] = np.where(run, 257 - n, n - 1)
    return assembled(units, at, start, heads, np.ones(len(n), np.int64), np.where(run, 1, n))


def spc(units: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, n, run = tokens(units, at, 3, 130, 128)
    heads = _heads(len(n), 1)
    heads[:, 0] = np.where(run, 258 - n, n - 1)
    return assembled(units, at, start, heads, np.ones(len(n), np.int64), np.where(run, 1, n))


def escaped(units: np.ndarray, at: np.ndarray, escape: int, count_first: bool) -> tuple[np.ndarray, np.ndarray]:
    start, n, run = tokens(units, at, 4, 255, 1)
    heads, coded = _heads(len(n), 3), run | (units[start] == escape)
    heads[:, 0] = escape
    heads[:, 1 if count_first else 2] = n
    heads[:, 2 if count_first else 1] = units[start]
    return assembled(units, at, start, heads, coded * 3, (~coded).astype(np.int64))


def pictor(units: np.ndarray, at: np.ndarray, block: int, marker: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of blocks, then the blocks, each with its size, length and marker."""
    size = np.diff(at)
    blocks = -(-size // block)
    order = spread(np.zeros(len(size), np.int64), blocks)
    edges = np.append(np.repeat(at[:-1], blocks) + order * block, at[-1])
    start, n, run = tokens(units, edges, 3, 1000, 1)
    coded, wide = run | (units[start] == marker), n > 255
    heads = _heads(len(n), 5)
    heads[:, 0] = marker
    heads[:, 1] = np.where(wide, 0, n)
    heads[:, 2] = np.where(wide, n & 255, units[start])
    heads[:, 3], heads[:, 4] = n >> 8, units[start]
    data, to = assembled(units, edges, start, heads, np.where(coded, np.where(wide, 5, 3), 0), (~coded).astype(np.int64))
    made = np.diff(to)
    # A piece is the number of a binary's blocks, or a block: 2 or 5 bytes and the block's data.
    first = bounds(blocks + 1)[:-1]
    pieces = len(made) + len(size)
    is_block = np.ones(pieces, bool)
    is_block[first] = False
    inner = np.zeros(pieces, np.int64)
    inner[is_block] = made
    front = np.where(is_block, 5, 2)
    out_at = bounds(front + inner)
    out = np.empty(out_at[-1], np.uint8)
    p = out_at[first]
    out[p], out[p + 1] = blocks & 255, blocks >> 8
    p, length = out_at[:-1][is_block], np.diff(edges)
    out[p], out[p + 1], out[p + 2], out[p + 3], out[p + 4] = made + 5 & 255, made + 5 >> 8, length & 255, length >> 8, marker
    out[spread(p + 5, made)] = data
    return out, np.append(out_at[first], out_at[-1])


def crack_art(units: np.ndarray, at: np.ndarray, size: int, step: int, escape: int, default: int) -> tuple[np.ndarray, np.ndarray]:
    """The escape, the default, the step and the codes of the bytes, taken step by step. All five codes of runs are used."""
    turned = np.ascontiguousarray(units.reshape(-1, size // step, step).transpose(0, 2, 1)).reshape(-1)
    start, n, run = tokens(turned, at, 4, 2000, 1)
    v, m = turned[start], n - 1
    same, short, plain = ~run & (v == escape), run & (n <= 20), run & (n > 20) & (n <= 256)
    filled = run & (n > 256) & (v == default)
    heads = _heads(len(n), 5)
    heads[:, 0] = escape
    heads[:, 1] = np.select([same, short, plain, filled], [escape, m, 0, 2], 1)
    heads[:, 2] = np.select([short, plain], [v, m & 255], m >> 8)
    heads[:, 3] = np.where(plain, v, m & 255)
    heads[:, 4] = v
    heading = np.select([same, short, plain | filled, run], [2, 3, 4, 5], 0)
    data, to = assembled(turned, at, start, heads, heading, (heading == 0).astype(np.int64))
    return fronted(np.tile(np.array([escape, default, step >> 8, step & 255], np.uint8), (len(at) - 1, 1)), data, to)


def fronted(front: np.ndarray, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of front before each segment."""
    width = front.shape[1]
    to = at + width * np.arange(len(at))
    out = np.empty(to[-1], np.uint8)
    out[to[:-1, None] + np.arange(width)] = front
    out[spread(to[:-1] + width, np.diff(at))] = data
    return out, to


def two_streams(n: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The control codes of tokens, and their sizes."""
    heads = _heads(len(n), 3)
    wide = np.where(run, n >= 128, n > 128)
    heads[:, 0] = np.where(run, np.where(wide, 0, n), np.where(wide, 1, 256 - n))
    heads[:, 1], heads[:, 2] = n >> 8, n & 255
    return heads, np.where(wide, 3, 1)


def tiny(units: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of control bytes and of value words, then both streams, of 32000-byte screens."""
    words = units.reshape(-1, 200, 20, 4, 2).transpose(0, 3, 2, 1, 4)
    words = np.ascontiguousarray(words).reshape(-1).view(np.uint16)
    edges = at // 2
    start, n, run = tokens(words, edges, 2, 1000, 200)
    heads, heading = two_streams(n, run)
    control, c = assembled(words, edges, start, heads, heading, np.zeros(len(n), np.int64))
    values, v = assembled(words, edges, start, heads, np.zeros(len(n), np.int64), np.where(run, 1, n))
    sizes = np.stack([np.diff(c), np.diff(v) // 2], 1)
    front = np.ascontiguousarray(sizes.astype(">u2")).view(np.uint8).reshape(-1, 4)
    both = np.empty(len(control) + len(values), np.uint8)
    to = bounds(np.diff(c) + np.diff(v))
    both[spread(to[:-1], np.diff(c))] = control
    both[spread(to[:-1] + np.diff(c), np.diff(v))] = values
    return fronted(front, both, to)


def photochrome(units: np.ndarray, at: np.ndarray, unit: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks: the number of commands, then these with their values between them."""
    words = units if unit == 1 else np.ascontiguousarray(units).view(np.uint16)
    edges = at // unit
    start, n, run = tokens(words, edges, 2, 1000, 200)
    heads, heading = two_streams(n, run)
    data, to = assembled(words, edges, start, heads, heading, np.where(run, 1, n))
    counts = np.diff(np.searchsorted(start, edges))
    return fronted(np.ascontiguousarray(counts.astype(">u2")).view(np.uint8).reshape(-1, 2), data, to)


def in_rows(f: Bulk, size: int, n: int | None) -> Bulk:
    """f over the first n rows of size bytes of each binary; rows beyond its end are shorter or empty. None: over all rows."""

    def every(units: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = -(-np.diff(at) // size)
        starts = spread(np.zeros(len(count), np.int64), count) * size + np.repeat(at[:-1], count)
        out, to = f(units, np.append(starts, at[-1]))
        return out, to[bounds(count)]

    def run(units: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.minimum(at[:-1, None] + size * np.arange(1, n + 1), at[1:, None])
        sizes = np.diff(np.concatenate([at[:-1, None], ends], 1), axis=1).reshape(-1)
        if sizes.sum() < len(units):
            units = units[spread(at[:-1], sizes.reshape(-1, n).sum(1))]
        out, to = f(units, bounds(sizes))
        return out, to[::n]

    return every if n is None else run

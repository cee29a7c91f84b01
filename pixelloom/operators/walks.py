"""Operators over binaries whose structure must be walked in order: IFF chunks, and the codes of run-length streams."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from pixelloom.codecs.amiga import chunks
from pixelloom.functions.kernels import be16, le16
from pixelloom.operators import rle

#: Bytes of output after which a batch ends.
OUT_BYTES = 16 << 20


@udtf(returnType="form: string, chunk_id: string, offset: int, length: int")
class IffChunks:
    """A row for each chunk of a FORM, in order."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        if content is not None and bytes(content[:4]) == b"FORM" and len(content) >= 12:
            for form, name, at, size in chunks(bytes(content)):
                yield form, name.decode("latin-1"), at, size


@udtf(returnType="run_no: int, value: int, run_len: int")
class ByteRuns:
    """The runs of a ByteRun1 stream, literals as runs of 1; it ends where the input does."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        d, at, n = bytes(content or b""), 0, 0
        while at < len(d):
            c = d[at]
            part = d[at + 1 : at + 2 + c] if c < 128 else d[at + 1 : at + 2]
            if c != 128:
                for v in part:
                    yield n, v, 1 if c < 128 else 257 - c
                    n += 1
            at += 1 if c == 128 else 2 + c if c < 128 else 2


def _tiny(d: bytes, n: int) -> bytes:
    middle = 4 + be16(d, 0)
    return rle.tiny(d[4:middle], d[middle : middle + 2 * be16(d, 2)])[:n]


#: Whole-stream decompressors by name: bytes and the size of the output in, bytes out. Streams that need more begin with it, as their files do:
#: pictor with the number of blocks, tiny with the sizes of its two streams, escape with the escape byte. pcs is two halves, of bytes and of words.
STREAMS = {
    "packbits": lambda d, n: rle.packbits(d, 0, n), "byterun1": lambda d, n: rle.byterun1(d, 0, n)[0], "sun": rle.sun, "spc": lambda d, n: rle.spc(d, 0, n),
    "crack_art": lambda d, n: rle.crack_art(d, 0, n), "koala_fe": lambda d, n: rle.escaped(d, 0, 0xFE, n, False), "amica_c2": lambda d, n: rle.escaped(d, 0, 0xC2, n, True),
    "escape": lambda d, n: rle.escaped(d, 1, d[0], n, True) if d else rle.escaped(d, 0, 0, n, True), "pcx": lambda d, n: rle.pcx_line(d, 0, len(d), n)[0],
    "bmp8": lambda d, n: rle.bmp_rle(d, n, 1, 8), "bmp4": lambda d, n: rle.bmp_rle(d, n, 1, 4), "pictor": lambda d, n: rle.pictor_blocks(d, 2, le16(d, 0), n),
    "sgi8": lambda d, n: rle.sgi(d, n, 1), "sgi16": lambda d, n: rle.sgi(d, n // 2, 2), "msp": rle.msp_row, "tiny": _tiny,
    "pcs": lambda d, n: rle.photochrome(d, 0, ((n // 2, 1), (n - n // 2, 2))),
}


def unpacked(scheme: str, content: bytes | None, size: int | None) -> tuple[bytes | None, str | None]:
    """The decompressed bytes, or None and why there are none. Null content is empty, a null size 0."""
    if scheme not in STREAMS:
        return None, "unsupported_encoding"
    try:
        return STREAMS[scheme](bytes(content or b""), max(0, size or 0)), None
    except rle.Short:
        return None, "truncated_data"


@udtf(returnType="content: binary, error: string")
class Decompress:
    """One row: the decompressed bytes, or why there are none."""

    def eval(self, scheme: str, content: bytes, size: int) -> Iterator[tuple]:
        yield unpacked(scheme, content, size)


@udtf(returnType="fits: boolean")
class ByteRunFits:
    """One row: whether a ByteRun1 stream has n rows of size bytes, each ending with a command, and no more."""

    def eval(self, content: bytes, size: int, n: int) -> Iterator[tuple]:
        yield (rle.byterun1_fits(bytes(content or b""), size, n, whole=True),)


def decompress(streams: DataFrame, scheme: str, content: str = "content", size: str = "size") -> DataFrame:
    """streams with content decompressed (to size bytes) in the place of content, and error: null, or why content is null. Nothing is shuffled."""
    keep = [c for c in streams.columns if c not in (content, size, "error")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = batch.column(len(keep)), batch.column(len(keep) + 1).to_pylist()
            start, made, held = 0, [], 0
            for i in range(batch.num_rows):
                made.append(unpacked(scheme, found[i].as_py(), sizes[i]))
                held += len(made[-1][0] or b"")
                if held > OUT_BYTES or i + 1 == batch.num_rows:  # what comes out can be far larger than what goes in
                    columns = [pa.array(c, t) for c, t in zip(zip(*made), (pa.binary(), pa.string()))]
                    yield pa.RecordBatch.from_arrays([batch.column(k).slice(start, len(made)) for k in range(len(keep))] + columns, names=[*keep, content, "error"])
                    start, made, held = i + 1, [], 0

    return streams.select(*keep, content, size).mapInArrow(run, streams.select(*keep).schema.add(content, "binary").add("error", "string"))


def use(spark: SparkSession) -> None:
    """Make iff_chunks, byte_runs, byterun1_fits and decompress known to SQL, for use in lateral joins."""
    for name, f in (("iff_chunks", IffChunks), ("byte_runs", ByteRuns), ("byterun1_fits", ByteRunFits), ("decompress", Decompress)):
        spark.udtf.register(name, f)

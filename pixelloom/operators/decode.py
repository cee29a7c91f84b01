"""Decoding: binary contents to surfaces, a row each, by codec. Errors are values of the result, not exceptions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from pixelloom.codecs import amiga, atari, commodore, icons, pc, png, web
from pixelloom.codecs.many import FEWEST, MANY, Surfaces, decode_many
from pixelloom.model import SURFACE, DecodeError, Options, Surface
from pixelloom.operators.bulk import binaries, parts_of
from pixelloom.plans.detect import CODECS, codecs, detect

#: Bytes of pixels after which a batch of output ends. Spark bounds batches of input by bytes.
OUT_BYTES = 16 << 20
_ARROW = to_arrow_schema(SURFACE)

Decoder = Callable[[bytes, Options], Surface]
DECODERS: dict[str, Decoder] = {
    "pcx": pc.pcx, "png": png.png, "lbm": amiga.lbm, "jpeg": web.jpeg, "tga": web.tga, "gif": web.gif, "bmp": pc.bmp, "sunrast": pc.sunrast,
    "pictor": pc.pictor, "sgi": pc.sgi, "pnm": pc.pnm, "dcx": pc.dcx, "msp": pc.msp, "neo": atari.neo, "degas": atari.degas,
    "crack_art": atari.crack_art, "spectrum512": atari.spectrum512, "photochrome": atari.photochrome, "tiny_stuff": atari.tiny_stuff,
    "doodle": atari.doodle, "qoi": pc.qoi, "ico": icons.ico, "exe_icon": icons.exe_icon, "c64_doodle": commodore.c64_doodle,
    "runpaint": commodore.runpaint, "interpaint": commodore.interpaint, "ami": commodore.ami, "funpaint": commodore.funpaint,
    "c64_hires": commodore.c64_hires, "koala": commodore.koala, "drazlace": commodore.drazlace,
}


@dataclass(frozen=True)
class Codec:
    name: str
    extensions: str
    sniff: Callable[[bytes], bool]
    decode: Decoder


class Registry:
    """The built-in codecs and those that a user adds, which are tried after them."""

    def __init__(self) -> None:
        self.added: list[Codec] = []

    def register(self, codec: Codec | None) -> None:
        if codec is not None:
            self.added.append(codec)

    def names(self) -> list[str]:
        return [n for n, _ in CODECS] + [c.name for c in self.added]

    def count(self) -> int:
        return len(self.names())

    def at(self, i: int) -> str | None:
        return self.names()[i] if 0 <= i < self.count() else None

    def find(self, name: str) -> Decoder | None:
        """A decoder by its exact name, the first registered."""
        return DECODERS.get(name) or next((c.decode for c in self.added if c.name == name), None)

    def frame(self, spark) -> DataFrame:
        return codecs(spark, [(c.name, c.extensions) for c in self.added])


REGISTRY = Registry()


def decode_bytes(content: bytes, name: str, options: Options = Options(), registry: Registry = REGISTRY) -> Surface:
    """A surface of one content by a codec's name; DecodeError if there is none."""
    f = registry.find(name)
    if f is None:
        raise DecodeError("invalid_format", f"Unknown codec: {name}")
    try:
        return f(bytes(content), options)
    except (IndexError, ValueError) as e:  # an input that ends where its header says that it doesn't
        raise DecodeError("truncated_data", f"Unexpected end of data ({type(e).__name__})") from None


def _made(codec: str, s: Surface | Surfaces, pixels: bytes | None, palette: bytes | None, subrects: list[dict]) -> dict:
    return {
        "codec": codec, "ok": True, "error": "none", "message": "", "width": s.width, "height": s.height, "format": s.format, "format_ord": s.format_ord,
        "pixels": pixels, "palette": palette, "subrects": subrects,
    }


def _row(codec: str | None, content: bytes | None, options: Options, registry: Registry) -> dict:
    row = {"codec": codec, "ok": False, "error": "none", "message": "", "subrects": None}
    try:
        if content is None:
            raise DecodeError("invalid_format", "No content")
        if codec is None:
            codec = row["codec"] = next((c.name for c in registry.added if c.sniff(content)), None)
            if codec is None:
                raise DecodeError("invalid_format", "Unknown image format")
        s = decode_bytes(content, codec, options, registry)
        row = _made(codec, s, s.pixels, s.palette, s.subrects)
    except DecodeError as e:
        row |= {"error": e.kind, "message": e.message}
    return row


def _batch(names: pa.Array, contents: pa.Array, options: Options, registry: Registry) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Surfaces of a batch in order, each part with the number of its first row. Small files with one header are decoded together; where parts of these
    would be short, and for all other files, a row at a time."""
    names, n = names.to_pylist(), len(contents)
    part, place = np.full(n, -1), np.zeros(n, np.int64)  # which part of the files decoded together a row is in, and where
    parts = []
    for codec in set(names) & MANY.keys() if n >= FEWEST else ():
        flat, at = parts_of(contents)
        rows = np.array([i for i, name in enumerate(names) if name == codec])
        if contents.null_count:
            rows = rows[np.asarray(contents.is_valid())[rows]]
        for which, found in decode_many(codec, flat, at[rows], at[rows + 1], lambda d, codec=codec: decode_bytes(d, codec, options, registry), options):
            part[rows[which]], place[rows[which]] = len(parts), np.arange(len(which))
            parts.append((codec, found))
    edges = np.append(np.flatnonzero(np.diff(part, prepend=-2)), n)
    if len(edges) > 2 + n // 64:  # too many short stretches
        edges = np.array([0, n])
    for start, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
        same = part[start:end]
        if same[0] >= 0 and (same == same[0]).all():
            codec, found = parts[same[0]]
            yield start, _together(codec, found.some(place[start:end]))
            continue
        rows, size, first = [], 0, start
        for i in range(start, end):
            if part[i] >= 0:
                codec, found = parts[part[i]]
                rows.append(_made(codec, found, found.pixels[place[i]].tobytes(), found.palette if isinstance(found.palette, bytes) else found.palette[place[i]].tobytes(), []))
            else:
                rows.append(_row(names[i], contents[i].as_py(), options, registry))
            size += len(rows[-1].get("pixels") or b"")
            if size > OUT_BYTES or i + 1 == end:
                yield first, pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                first, rows, size = i + 1, [], 0


def _together(codec: str, found: Surfaces) -> pa.RecordBatch:
    """The columns of surfaces that were decoded together."""
    n, every = len(found.pixels), lambda v, t: pa.repeat(pa.scalar(v, t), len(found.pixels))
    binary = lambda rows: binaries(rows.reshape(-1), np.arange(n + 1) * rows.shape[1])
    palette = every(found.palette, pa.binary()) if isinstance(found.palette, bytes) else binary(found.palette)
    row = _made(codec, found, None, None, [])
    made = {"pixels": binary(found.pixels), "palette": palette}
    return pa.RecordBatch.from_arrays([made[f.name] if f.name in made else every(row[f.name], f.type) for f in _ARROW], schema=_ARROW)


def decode(files: DataFrame, codec: str | None = None, options: Options = Options(), content: str = "content", registry: Registry | None = None, first: str | None = None) -> DataFrame:
    """files without their content, plus the columns of a surface (model.SURFACE).

    codec: a codec's name for all rows, or None to detect it for each; first: the codec that detection tries before the others. Detection is native and cheap; only decoding runs in Python, in
    Arrow batches: small files with one header together (codecs/many.py), others one at a time. Nothing is shuffled.
    """
    registry = registry or REGISTRY
    keep = [c for c in files.columns if c != content and c not in SURFACE.names]
    typed = files.withColumn("__codec", F.lit(codec) if codec is not None else detect(content, first=first))
    schema = files.select(*keep).schema
    for f in SURFACE.fields:
        schema = schema.add(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, made in _batch(batch.column(len(keep)), batch.column(len(keep) + 1), options, registry):
                yield pa.RecordBatch.from_arrays([batch.column(j).slice(start, made.num_rows) for j in range(len(keep))] + made.columns, names=[*keep, *SURFACE.names])

    return typed.select(*keep, "__codec", content).mapInArrow(run, schema)

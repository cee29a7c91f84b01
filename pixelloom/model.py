"""Schemas, formats, errors and limits shared by all of the engine."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import types as T

#: Pixel formats by ordinal (the ordinal is part of fingerprints), and bytes to a pixel.
FORMATS = ("indexed8", "rgb888", "rgba8888")
BYTES_PER_PIXEL = {"indexed8": 1, "rgb888": 3, "rgba8888": 4}
ERRORS = (
    "none", "invalid_format", "unsupported_version", "unsupported_encoding", "unsupported_bit_depth", "dimensions_exceeded", "truncated_data",
    "io_error", "internal_error",
)
SUBRECT_KINDS = ("sprite", "tile", "frame")
MAX_SIDE, MAX_SURFACE_BYTES, MAX_QOI_PIXELS, MAX_PALETTE, MAX_EXPANSION, MAX_PAGES, MAX_ICON_SIDE = 16384, 1 << 30, 400_000_000, 256, 1000, 1023, 256

SUBRECT = T.StructType([T.StructField(n, T.StringType() if n == "kind" else T.LongType() if n == "user_tag" else T.IntegerType()) for n in ("index", "x", "y", "w", "h", "kind", "user_tag")])
SURFACE = T.StructType([
    T.StructField("codec", T.StringType()), T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType()), T.StructField("message", T.StringType()),
    T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("format", T.StringType()), T.StructField("format_ord", T.IntegerType()),
    T.StructField("pixels", T.BinaryType()), T.StructField("palette", T.BinaryType()), T.StructField("subrects", T.ArrayType(SUBRECT)),
])


class DecodeError(Exception):
    """Why an input has no surface; ends as values in the result's columns error and message."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind, self.message = kind, message


@dataclass
class Surface:
    """A dense raster, rows from the top, with a palette of RGB triplets where it is indexed."""

    width: int
    height: int
    format: str
    pixels: bytes
    palette: bytes = b""
    subrects: list[dict] = field(default_factory=list)

    @property
    def format_ord(self) -> int:
        return FORMATS.index(self.format)

    def array(self) -> np.ndarray:
        return np.frombuffer(self.pixels, np.uint8).reshape(self.height, self.width, BYTES_PER_PIXEL[self.format])


@dataclass(frozen=True)
class Options:
    """Limits of a decode; 0 stands for the default."""

    max_width: int = MAX_SIDE
    max_height: int = MAX_SIDE

    def check(self, width: int, height: int, default: int = MAX_SIDE) -> None:
        if width > (self.max_width or default) or height > (self.max_height or default):
            raise DecodeError("dimensions_exceeded", "Image dimensions exceed limits")


def surface(rows: np.ndarray, format: str, palette: bytes | np.ndarray = b"", subrects: list[dict] | None = None) -> Surface:
    """A surface of an array (height, width) or (height, width, channels) of bytes."""
    h, w = rows.shape[:2]
    if h < 1 or w < 1:
        raise DecodeError("internal_error", "Failed to allocate surface")
    if h * w * BYTES_PER_PIXEL[format] > MAX_SURFACE_BYTES:
        raise DecodeError("internal_error", "Failed to allocate surface")
    return Surface(w, h, format, np.ascontiguousarray(rows, np.uint8).tobytes(), bytes(np.asarray(palette, np.uint8).tobytes() if isinstance(palette, np.ndarray) else palette), subrects or [])


def narrow(indices: np.ndarray, format: str = "rgba8888") -> Surface:
    """Index bytes at the start of rows of a wider format, zeros after: what a decoder gives that has indices but no palette."""
    h, w = indices.shape
    out = np.zeros((h, w * BYTES_PER_PIXEL[format]), np.uint8)
    out[:, :w] = indices
    return surface(out.reshape(h, w, -1), format)


def need(ok: bool, kind: str, message: str) -> None:
    if not ok:
        raise DecodeError(kind, message)

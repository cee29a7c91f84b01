"""Round trips through the decompressors: documents' bytes are encoded and decoded again; SQL states the bytes themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.operators import encode as e
from pixelloom.operators.walks import decompress, use
from pixelloom.plans.queries import table, tiles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts; null counts as empty."""
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))


def _round_trip(name: str, scheme: str, pack: Callable[[Column], Column], make: Callable[[Column], Column] | None = None, sql: str = "hex(encode(coalesce(text, '')))") -> None:
    """Whole documents, after make; sql is what must come back, in hex."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        content = F.col("content") if make is None else make(F.col("content"))
        plain = _whole(spark, sf_dir).select("doc_id", content.alias("content"))
        size = F.octet_length("content") * (2 if scheme == "bmp4" else 1)
        coded = plain.select("doc_id", size.alias("size"), F.octet_length("content").alias("n_bytes"), pack(F.col("content")).alias("content"))
        return decompress(coded, scheme).select("doc_id", "n_bytes", F.md5("content").alias("md5"), "error")

    QUERIES[name] = run
    ORACLES[name] = f"SELECT doc_id, (length(h) // {4 if scheme == 'bmp4' else 2})::INT AS n_bytes, md5(unhex(h)) AS md5, NULL::VARCHAR AS error FROM (SELECT doc_id, {sql} AS h FROM documents)"


def _screens(name: str, scheme: str, pack: Callable[[Column], Column]) -> None:
    """Documents in tiles of 32000 bytes, the size of the screens of these formats."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        screens = tiles(spark, sf_dir, 32000)
        coded = screens.select("doc_id", "tile", F.lit(32000).alias("size"), pack(F.col("content")).alias("content"))
        return decompress(coded, scheme).select("doc_id", "tile", F.md5("content").alias("md5"), "error")

    QUERIES[name] = run
    ORACLES[name] = """SELECT doc_id, tile::INT AS tile, md5(unhex(rpad(array_slice(h, tile * 64000 + 1, tile * 64000 + 64000), 64000, '0'))) AS md5, NULL::VARCHAR AS error
FROM (SELECT doc_id, h, unnest(range(0, (length(h) // 2 + 31999) // 32000)) AS tile FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE strlen(text) > 0))"""


def _wide(content: Column) -> Column:
    """Each byte after the byte A5: samples of 16 bits."""
    return F.unhex(F.regexp_replace(F.hex(content), F.lit("(..)"), F.lit("A5$1")))


_WIDE = "regexp_replace(hex(encode(coalesce(text, ''))), '(..)', 'A5\\1', 'g')"

_round_trip("rle_pcx_roundtrip", "pcx", e.pcx)
_round_trip("rle_byterun1_roundtrip", "byterun1", e.packbits)
_round_trip("rle_bmp8_roundtrip", "bmp8", e.bmp8)
_round_trip("rle_bmp4_roundtrip", "bmp4", e.bmp4, sql="regexp_replace(hex(encode(coalesce(text, ''))), '(.)', '0\\1', 'g')")
_round_trip("rle_sun_roundtrip", "sun", e.sun)
_round_trip("rle_pictor_roundtrip", "pictor", e.pictor)
_round_trip("rle_sgi8_roundtrip", "sgi8", e.sgi8)
_round_trip("rle_sgi16_roundtrip", "sgi16", e.sgi16, _wide, _WIDE)
_round_trip("rle_msp_roundtrip", "msp", e.msp)
_round_trip("rle_packbits_roundtrip", "packbits", e.packbits)
_screens("rle_crack_art_roundtrip", "crack_art", e.crack_art)
_screens("rle_tiny_roundtrip", "tiny", e.tiny)
_round_trip("rle_spc_roundtrip", "spc", e.spc)
_screens("rle_pcs_roundtrip", "pcs", lambda c: e.photochrome([(F.substring(c, 1, 16000), 1), (F.substring(c, 16001, 16000), 2)]))
_round_trip("rle_koala_fe_roundtrip", "koala_fe", lambda c: e.escaped(c, "FE", False))
_round_trip("rle_amica_c2_roundtrip", "amica_c2", lambda c: e.escaped(c, "C2", True))
_round_trip("rle_escape_roundtrip", "escape", lambda c: F.concat(F.unhex(F.lit("65")), e.escaped(c, "65", True)))


def byterun1_framing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of 64 bytes, encoded each by itself, fit as such; they don't with a byte cut off, nor with rows one byte shorter or longer."""
    use(spark)
    n = 64
    count = F.expr(f"cast((octet_length(content) + {n - 1}) div {n} as int)")
    padded = _whole(spark, sf_dir).where("octet_length(content) > 0").withColumn("rows", count).withColumn("content", F.rpad("content", F.col("rows") * n, F.unhex(F.lit("00"))))
    padded.select("doc_id", "rows", e.rows("content", n, None, e.packbits).alias("d")).createOrReplaceTempView("framed_streams")
    return spark.sql(f"""SELECT doc_id, `rows`, a.fits, b.fits AS fits_cut, c.fits AS fits_shorter, e.fits AS fits_longer FROM framed_streams,
        LATERAL byterun1_fits(d, {n}, `rows`) a, LATERAL byterun1_fits(substring(d, 1, octet_length(d) - 1), {n}, `rows`) b,
        LATERAL byterun1_fits(d, {n - 1}, `rows`) c, LATERAL byterun1_fits(d, {n + 1}, `rows`) e""")


QUERIES["byterun1_framing"] = byterun1_framing
ORACLES["byterun1_framing"] = "SELECT doc_id, ((strlen(text) + 63) // 64)::INT AS rows, true AS fits, false AS fits_cut, false AS fits_shorter, false AS fits_longer FROM documents WHERE strlen(text) > 0"

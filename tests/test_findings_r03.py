"""What the findings of round 3 found, on tables made for it."""

import hashlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry


def same_as_sql(spark, name, folder, **tables):
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    rows = sorted(repr(tuple(r)) for r in want.fetchall())
    assert rows == sorted(repr(tuple(r)) for r in entry.queries()[name](spark, str(folder)).select(*columns).collect())
    return len(rows)


def documents(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def suppliers(spark, keys):
    return spark.createDataFrame([(k, f"Supplier#{k:09d}") for k in keys], "s_suppkey int, s_name string")


def test_rows_one_byte_shorter_never_fit(spark, tmp_path):
    """the 63 bytes before the last command made a row of their own."""
    text = "".join(chr(97 + i % 20) for i in range(61)) + "zzy"
    assert same_as_sql(spark, "byterun1_framing", tmp_path, documents=documents(spark, text, "a", "ab" * 40, text * 3)) == 4


def test_koala_that_begins_as_another_format(spark, tmp_path):
    """bodies whose first bytes are BMP's mark, Pictor's, SGI's or Degas's."""
    marks = (b"BM", b"\x34\x12", b"\x01\xda", b"\x80\0", b"\x80\1", b"\x80\2", b"SP")
    keys = [k for k in range(40_000) if hashlib.sha256(f"{k}-Supplier#{k:09d}-1".encode()).digest()[:2] in marks]
    assert len(keys) > 2
    assert same_as_sql(spark, "decode_koala", tmp_path, supplier=suppliers(spark, keys[:3] + [1])) == 4


@pytest.mark.parametrize("scheme", ["pcx", "byterun1", "bmp8", "bmp4", "sun", "pictor", "sgi8", "sgi16", "msp", "packbits", "spc", "koala_fe", "amica_c2", "escape"])
def test_empty_documents_make_the_round_trip(spark, tmp_path, scheme):
    """an empty document was an error of packbits and spc."""
    assert same_as_sql(spark, f"rle_{scheme}_roundtrip", tmp_path, documents=documents(spark, "", None, "a", "aaaab")) == 4


def test_small_files_are_decoded_together(spark):
    """Nearly every file went through the decoder by itself. Together they give the same, damaged and odd ones
    among them too."""
    from pixelloom.codecs.many import MANY
    from pixelloom.model import Options
    from pixelloom.operators.decode import REGISTRY, _batch, _row
    from pixelloom.plans import file_queries

    rng = np.random.default_rng(3)
    text = "".join(chr(c) for c in rng.choice(np.array([32, 32, 97, 101, 101, 101, 10, 80, 233]), 170_000))
    docs = documents(spark, text, "e" * 3000)
    real = file_queries.tiles, file_queries.decode
    for name, codec, few in (
        ("decode_pcx", "pcx", 0), ("decode_pcx_rgb", "pcx", 0), ("decode_pcx_1_planes", "pcx", 0), ("decode_pcx_4_planes", "pcx", 0), ("decode_pcx_cga_high", "pcx", 0), ("decode_bmp_os2", "bmp", 0),
        ("decode_bmp_24", "bmp", 0), ("decode_bmp_4_top_down", "bmp", 0), ("decode_sunrast_1", "sunrast", 0), ("decode_sunrast_bgr", "sunrast", 0), ("decode_pictor_vga", "pictor", 0),
        ("decode_pictor_ega", "pictor", 0), ("decode_pictor_cga", "pictor", 40), ("decode_pnm_p1", "pnm", 0), ("decode_pnm_p4", "pnm", 0), ("decode_pnm_p6", "pnm", 0), ("decode_qoi_rgb", "qoi", 0),
        ("decode_qoi_rgba", "qoi", 0), ("decode_lbm", "lbm", 0), ("decode_lbm_pbm", "lbm", 0), ("decode_lbm_ham6", "lbm", 0), ("decode_lbm_ham8", "lbm", 0), ("decode_lbm_half_brite", "lbm", 0),
        ("decode_lbm_24_mask", "lbm", 0), ("decode_lbm_32", "lbm", 0), ("decode_lbm_by_line", "lbm", None),
    ):
        made = []
        try:
            file_queries.tiles = lambda s, folder, n: _tiled(docs, n)
            file_queries.decode = lambda files, *a, **k: made.append(files) or real[1](files, *a, **k)
            file_queries.QUERIES[name](spark, "")
        finally:
            file_queries.tiles, file_queries.decode = real
        files = [bytes(r["content"]) for r in made[0].limit(300).collect()]
        for i in range(0, 40, 2):  # cut, and with bytes changed
            files[7 * i] = files[7 * i][: int(rng.integers(0, len(files[7 * i])))]
            d = bytearray(files[7 * i + 1])
            d[int(rng.integers(0, len(d)))] = int(rng.integers(0, 256))
            files[7 * i + 1] = bytes(d)
        contents, names = pa.array([*files, None], pa.binary()), pa.array([codec] * len(files) + [None])
        got = [row for _, b in _batch(names, contents, Options(), REGISTRY) for row in b.to_pylist()]
        want = [_row(n, c, Options(), REGISTRY) for n, c in zip(names.to_pylist(), contents.to_pylist())]
        assert got == [{f: w.get(f) for f in got[0]} for w in want], name
        assert codec in MANY
        if few is not None:
            clean = [f for i, f in enumerate(files) if i % 7 > 1]
            parts = [b.num_rows for _, b in _batch(pa.array([codec] * len(clean)), pa.array(clean, pa.binary()), Options(), REGISTRY)]
            assert len(parts) <= max(4, few), (name, parts)


def _tiled(docs, n):
    rows = []
    for r in docs.collect():
        b = r["text"].encode()
        rows += [(r["doc_id"], i // n, bytearray(b[i : i + n].ljust(n, b"\0"))) for i in range(0, len(b), n)]
    return docs.sparkSession.createDataFrame(rows[:400], "doc_id long, tile int, content binary")


def test_encoders_of_many_binaries():
    """Streams of every encoder of bulk.py are read back, runs longer than a code takes and empty binaries too."""
    from pixelloom.operators import bulk, rle
    from pixelloom.operators.walks import STREAMS

    rng = np.random.default_rng(4)

    def binary(n):
        kind = rng.integers(0, 4)
        if kind < 2:
            return rng.choice(np.array([0x65, 0xFE, 0xC2, 0, 0xC0, 255] if kind else np.arange(256), np.uint8), n)
        return np.repeat(rng.integers(0, 256, n).astype(np.uint8), rng.integers(1, 600, n))[:n] if kind == 2 else np.zeros(n, np.uint8)

    screen = (lambda d, n: rle.photochrome(d, 0, ((n, 1),)), lambda d, n: rle.photochrome(d, 0, ((n, 2),)))
    for f, back, size in (
        (bulk.pcx, STREAMS["pcx"], 0), (bulk.packbits, STREAMS["packbits"], 0), (bulk.packbits, STREAMS["byterun1"], 0), (bulk.spc, STREAMS["spc"], 0),
        (lambda u, a: bulk.pictor(u, a, 8192, 0x65), STREAMS["pictor"], 0), (lambda u, a: bulk.pictor(u, a, 100, 0x65), STREAMS["pictor"], 0),
        (lambda u, a: bulk.escaped(u, a, 0xFE, False), STREAMS["koala_fe"], 0), (lambda u, a: bulk.escaped(u, a, 0xC2, True), STREAMS["amica_c2"], 0),
        (lambda u, a: bulk.crack_art(u, a, 32000, 160, 0x65, 0), STREAMS["crack_art"], 32000), (bulk.tiny, STREAMS["tiny"], 32000),
        (lambda u, a: bulk.photochrome(u, a, 1), screen[0], 32000), (lambda u, a: bulk.photochrome(u, a, 2), screen[1], 19136),
    ):
        parts = [binary(size or int(n)) for n in (0, 1, 2, *rng.integers(3, 9000, 17))]
        out, to = f(np.concatenate(parts), bulk.bounds(np.array([len(p) for p in parts])))
        assert [back(out[a:b].tobytes(), len(p)) for a, b, p in zip(to[:-1], to[1:], parts)] == [p.tobytes() for p in parts]


def test_suppliers_are_dealt_over_tasks(spark, tmp_path):
    """A small table was read, and its screens made, by one task."""
    from pixelloom.plans.file_queries import digests

    suppliers(spark, range(200)).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    assert digests(spark, str(tmp_path), 64).rdd.getNumPartitions() >= 64


@pytest.mark.parametrize("name, rows", [("planes_merge_by_group", 128), ("channel_pivot", 16)])
def test_images_not_pixels_are_shuffled(spark, tmp_path, name, rows):
    """Every pixel was a row of the shuffle."""
    assert same_as_sql(spark, name, tmp_path, documents=documents(spark, "abc" * 50, "é", "", None, "zz" * 700)) == 3
    plan = entry.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and not any("hashpartitioning" in line and (" y#" in line or " x#" in line) for line in plan.splitlines())


def test_words_make_what_bits_and_samples_make(spark):
    from pixelloom.operators import assemble

    bits = spark.createDataFrame([(1, 0, 0, 0b10), (1, 0, 1, 0b11), (1, 1, 2, 0b01), (2, 1, 31, 0b10)], "k int, y int, plane int, word int")
    want = {(1, 0, 0): 3, (1, 0, 1): 2, (1, 1, 0): 0, (1, 1, 1): 4, (2, 1, 0): -(1 << 31), (2, 1, 1): 0}
    assert {(r["k"], r["y"], r["x"]): r["idx"] for r in assemble.merge_plane_words(bits, ["k"], 2, 3).collect()} == want
    words = spark.createDataFrame([(1, 0, 0, 0x0102030405060708), (1, 1, 0, -1), (2, 0, 1, 0xFF)], "k int, channel int, part int, word long")
    got = {(r["k"], r["x"]): (r["r"], r["g"], r["b"]) for r in assemble.interleave_words(words, ["k"], 2).collect()}
    assert got == {**{(1, i): (i + 1, 255, i + 1) for i in range(8)}, **{(2, 8 + i): (v, v, v) for i, v in enumerate([0] * 7 + [255])}}

"""Files to surfaces and back through Spark; detection's order; streams; JPEG against the JVM's decoder."""

import hashlib
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.functions import columns as c
from pixelloom.functions import kernels as k
from pixelloom.model import Options, surface
from pixelloom.operators import assemble, decode
from pixelloom.plans import palettes as p
from pixelloom.plans.detect import detect
from pixelloom.sources import images
from pixelloom.streaming import images as streams

PPM = b"P6 2 2 255\n" + bytes(range(65, 77))


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.ppm").write_bytes(PPM)
    (tmp_path / "b.pgm").write_bytes(b"P5 2 1 255\nAB")
    (tmp_path / "c.txt").write_bytes(b"nothing of the kind")
    (tmp_path / "d.qoi").write_bytes(b"qoif" + struct.pack(">II", 20000, 1) + b"\3\0" + bytes(20))
    return str(tmp_path)


def test_files_to_surfaces(spark, folder):
    rows = {os.path.basename(r["path"]): r for r in decode.decode(images.read(spark, folder)).collect()}
    assert rows["a.ppm"]["ok"] and rows["a.ppm"]["pixels"] == PPM[-12:] and rows["b.pgm"]["codec"] == "pnm"
    assert rows["c.txt"]["error"] == "invalid_format" and rows["c.txt"]["message"] == "Unknown image format" and rows["c.txt"]["pixels"] is None
    assert rows["d.qoi"]["error"] == "dimensions_exceeded"
    named = decode.decode(images.read(spark, folder, "a.*"), "bmp", Options()).first()
    assert named["error"] == "invalid_format"


def test_length_reaches_the_source(spark, folder):
    plan = images.read(spark, folder, longest=15).select("path", "length")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,15)" in plan.split("PushedFilters")[1] and "content" not in plan.split("ReadSchema")[1]


def test_tables_of_surfaces(spark, folder, tmp_path):
    made = decode.decode(images.read(spark, folder)).cache()
    assert [bytes(r["row"]) for r in images.scanlines(made).where("path like '%a.ppm'").orderBy("y").collect()] == [PPM[-12:-6], PPM[-6:]]
    assert images.colours(made).where("path like '%a.ppm' and y = 1 and x = 1").first()[3:] == (74, 75, 76, 255)
    mark = made.where("path like '%a.ppm'").select(c.fingerprint("width", "height", "format", "pixels", "palette")).first()[0]
    assert mark == hashlib.md5(struct.pack("<iii", 2, 2, 1) + PPM[-12:]).hexdigest()
    saved = images.save_pngs(made, str(tmp_path / "out")).where("ok").collect()
    assert len(saved) == 2
    again = decode.decode(images.read(spark, str(tmp_path / "out"))).where("width = 2 and height = 2").first()
    assert np.frombuffer(again["pixels"], np.uint8).reshape(4, 4)[:, :3].tobytes() == PPM[-12:]


def test_user_codec(spark):
    registry = decode.Registry()
    registry.register(decode.Codec("dots", ".dot", lambda d: d == b"DOT", lambda d, options: surface(np.zeros((1, 1), np.uint8), "indexed8", b"\1\2\3")))
    files = spark.sql("SELECT * FROM VALUES ('x', unhex('444F54')), ('y', unhex('50352031203120323535200A41')) AS t(path, content)")
    rows = {r["path"]: r for r in decode.decode(files, registry=registry).collect()}
    assert rows["x"]["codec"] == "dots" and rows["x"]["ok"] and rows["y"]["codec"] == "pnm"
    assert registry.frame(spark).count() == 32


def test_detection_order(spark):
    """Inputs that fit several predicates go to the codec that is tried first."""
    z = lambda n, head=b"": head.ljust(n, b"\0")
    cases = [
        (z(10003, b"\0\x60"), "runpaint"), (z(10003, b"\0\x30"), "interpaint"), (z(9009, b"\0\x20"), "interpaint"), (z(8002, b"\0\x20"), "c64_hires"),
        (z(8194, b"\0\x20"), "c64_hires"), (z(10006, b"\0\x30"), "koala"), (b"\0\x40" + b"\xfe\x01\x05" * 40, "ami"), (b"\0\x60" + b"\xfe\x01\x05" * 40, "koala"),
        (z(32000, b"CA\0\0"), "crack_art"), (z(32000, b"CX"), "doodle"), (z(51104), "spectrum512"), (z(18, b"\0\0\2" + bytes(9) + b"\1\0\1\0\x18"), "tga"),
        (z(32128, b"\0\0\0\1"), "neo"), (z(32034), "degas"), (b"\0\x1c" + b"\xfe\x00\xff" * 35 + b"\xfe\x00\x63", "c64_doodle"), (b"", None), (b"\xff", None),
    ]
    df = spark.createDataFrame([(i, bytearray(d)) for i, (d, _) in enumerate(cases)], "i int, content binary")
    got = dict(df.select("i", detect("content")).collect())
    assert [got[i] for i in range(len(cases))] == [x for _, x in cases]


def test_stream(spark, folder, tmp_path):
    made = streams.decode_stream(streams.read_stream(spark, folder))
    q = made.writeStream.format("memory").queryName("surfaces").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["codec"]: r["n"] for r in spark.sql("SELECT codec, count(*) n FROM surfaces GROUP BY codec").collect()} == {"pnm": 2, "qoi": 1, None: 1}


def test_kernels_agree_with_columns(spark):
    words = np.arange(4096)
    df = spark.range(4096).select(F.col("id").cast("int").alias("w"))
    for f, g in ((c.st_rgb, k.st_rgb), (c.ste_rgb, k.ste_rgb)):
        rows = df.orderBy("w").select(*f("w")).toPandas().to_numpy()
        assert (rows == g(words)).all()
    assert [r[0] for r in p.frame(spark, "vga_default").orderBy("idx").select("r").collect()] == [x >> 16 for x in p.PALETTES["vga_default"]]


def test_ico_entries_and_pages(spark):
    head = struct.pack("<HHH", 0, 1, 2) + struct.pack("<BBBBHHII", 16, 0, 0, 0, 1, 32, 9, 38) + struct.pack("<BBBBHHII", 48, 48, 0, 0, 1, 32, 7, 47)
    df = spark.createDataFrame([("x", bytearray(head))], "path string, content binary")
    rows = assemble.ico_entries(df).orderBy("index").collect()
    assert [tuple(r)[1:] for r in rows] == [(0, 16, 256, 9, 38), (1, 48, 48, 7, 47)]
    pages = spark.sql("SELECT * FROM VALUES ('f', 0, 20L), ('f', 1, 50L), ('f', 2, 0L), ('f', 3, 500L) AS t(file, i, at)")
    got = assemble.page_slices(pages, ["file"], "i", "at", F.lit(100)).orderBy("i").collect()
    assert [(r["at"], r["size"]) for r in got] == [(20, 30), (50, 50)]


@pytest.mark.parametrize("size", [(8, 8), (37, 21)])
def test_jpeg(spark, size):
    jvm = spark._jvm
    w, h = size
    image = jvm.java.awt.image.BufferedImage(w, h, 1)
    for y in range(h):
        for x in range(w):
            image.setRGB(x, y, (x * 5 % 256) << 16 | (y * 9 % 256) << 8 | (x + y) * 3 % 256)
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    data = bytes(out.toByteArray())
    got = decode.decode_bytes(data, "jpeg").array().astype(int)
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
    want = np.array([[back.getRGB(x, y) & 0xFFFFFF for x in range(w)] for y in range(h)])
    want = np.stack([want >> 16, want >> 8 & 255, want & 255], 2)
    assert np.abs(got[:, :, :3] - want).mean() < 6


def test_walks(spark):
    from pixelloom.operators import walks

    walks.use(spark)
    form = b"ILBM" + b"BMHD" + struct.pack(">I", 3) + b"abc\0" + b"BODY" + struct.pack(">I", 2) + b"xy"
    files = spark.createDataFrame([(1, bytearray(b"FORM" + struct.pack(">I", len(form)) + form)), (2, None)], "id int, content binary")
    files.createOrReplaceTempView("forms")
    rows = spark.sql("SELECT id, c.* FROM forms, LATERAL iff_chunks(content) c ORDER BY offset").collect()
    assert [tuple(r) for r in rows] == [(1, "ILBM", "BMHD", 20, 3), (1, "ILBM", "BODY", 32, 2)]
    rows = spark.sql("SELECT * FROM byte_runs(unhex('FE410142438044'))").collect()
    assert [tuple(r) for r in rows][:3] == [(0, 65, 3), (1, 66, 1), (2, 67, 1)]
    assert bytes(spark.sql("SELECT content FROM decompress('packbits', unhex('FE41014243'), 5)").first()[0]) == b"AAABC"
    assert spark.sql("SELECT error FROM decompress('packbits', unhex('FE'), 5)").first()[0] == "truncated_data"

"""Sources, sinks, model boundaries, rasters and the stateful stream."""

import re
import sys
import zlib

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pagewright.operators import models, raster
from pagewright.sinks import pdf
from pagewright.sources import files
from pagewright.streaming import capture

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_pictures(spark, tmp_path):
    (tmp_path / "a.pgm").write_bytes(b"P5\n# note\n3 2\n255\n" + bytes(range(6)))
    (tmp_path / "b.ppm").write_bytes(b"P6 1 1 255\n" + bytes([9, 8, 7]))
    (tmp_path / "c.txt").write_bytes(b"nothing")
    turn = spark.createDataFrame([(f"file:{tmp_path}/a.pgm", 90)], "path string, degrees int")
    rows = {r.path.rsplit("/", 1)[1]: r.picture for r in files.pictures(spark, str(tmp_path), turn).collect()}
    assert rows["c.txt"] is None and rows["b.ppm"].data == [9, 8, 7]
    assert (rows["a.pgm"].h, rows["a.pgm"].w, rows["a.pgm"].data) == (3, 2, [3, 0, 4, 1, 5, 2])


def test_listing_and_dictionary(spark, tmp_path):
    for n in ("x.pdf", "y.PDF", "z.txt"):
        (tmp_path / n).write_bytes(b"1")
    assert sorted(r.name for r in files.exported(spark, str(tmp_path)).collect()) == ["x.pdf", "y.PDF"]
    (tmp_path / "d.txt").write_text("a\r\n\nb")
    assert files.dictionary_lines(spark, str(tmp_path / "d.txt")) == ["a\r", "", "b"]
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "1.hocr").write_text("<p>\n</p>")
    assert [r.hocr for r in files.hocr_pages(spark, str(tmp_path / "h")).collect()] == ["<p>\n</p>"]


def test_pdf(spark, tmp_path):
    pages = spark.createDataFrame([(1, 0, 2, 1, bytearray([0, 255]), [(1.0, 1.0, 5.0, "a(b")]), (1, 1, 3, 3, None, [])], "doc int, page_no int, w int, h int, picture binary, ops array<struct<x:double,y:double,size:double,text:string>>")
    made = pdf.documents(pages, ["doc"]).withColumn("file_name", F.lit("one.pdf"))
    out = pdf.write_files(made, str(tmp_path)).first()
    data = (tmp_path / "one.pdf").read_bytes()
    assert out.size == len(data) and data.startswith(b"%PDF") and b"/Count 2" in data and b"[0 0 3 3]" in data
    streams = [zlib.decompress(m) for m in re.findall(rb"stream\n(.*?)\nendstream", data, re.S)]
    assert any(b"(a\\(b) Tj" in s and b"3 Tr" in s for s in streams)
    offsets = [int(x) for x in re.findall(rb"(\d{10}) 00000 n", data)]
    assert all(data[o:].startswith(b"%d 0 obj" % i) for i, o in enumerate(offsets, 1))
    with pytest.raises(ValueError):
        pdf.pdf_bytes([])
    assert len(set(pdf.compressed(bytes(range(256)), 16, 16))) == 32


def test_rasters():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (20, 24, 3)).astype(float)
    for f in (*raster.MODES.values(), raster.even_light, raster.contrast, raster.sharpened, raster.flattened):
        assert f(a).shape[:2] == (20, 24)
    assert raster.upscaled(a).shape == (40, 48, 3)
    flat = np.full((9, 9), 77.0)
    for f in (raster.sharpened, raster.denoised, lambda x: raster.blur(x, 5)):
        assert np.allclose(f(flat), 77)
    assert np.abs(raster.from_lab(raster.to_lab(a)) - a).max() <= 1
    page = np.full((60, 80), 20.0)
    page[10:50, 15:65] = 230
    found = np.array(raster.page_corners(page))
    assert np.abs(found - [[15, 10], [64, 10], [64, 49], [15, 49]]).max() <= 3
    assert raster.page_corners(np.full((30, 30), 9.0)) is None
    assert np.allclose(raster.warped(page, [[15, 10], [64, 10], [64, 49], [15, 49]])[2:-2, 2:-2], 230)
    ruled = np.full((80, 100), 240.0)
    ruled[[10, 11, 40, 70]] = ruled[:, [5, 50, 90]] = 20
    assert raster.ruled_boundaries(ruled) == ([10, 40, 70], [5, 50, 90])
    ring = np.zeros((12, 12))
    ring[2:10, 2:10], ring[4:8, 4:8] = 1, 0
    assert sorted(b[:4] for b in raster.box_regions(ring)) == [(2, 2, 8, 8), (4, 4, 4, 4)]
    assert raster.tensor(a, 10, 12, (0.5,) * 3, (0.5,) * 3, 16).shape == (3, 16, 16)


class Detector:
    def detect(self, picture):
        if picture.shape[0] == 1:
            raise RuntimeError("too small")
        return [[2.0, 0.9, 0.0, 0.0, float(picture.shape[1]), 1.0]]


def broken():
    raise OSError("no weights")


def test_orientations(spark):
    rows = spark.createDataFrame([(o,) for o in (1, 2, 3, 6, 8, None)], "o int").select(files.orientation_degrees(F.col("o")).alias("d"))
    assert [r.d for r in rows.collect()] == [0, 0, 180, 90, 270, 0]


def test_models(spark):
    rows = spark.createDataFrame([(2, 3, 1, [0.0] * 6), (1, 1, 1, [0.0])], "h int, w int, channels int, data array<double>").select(F.struct("*").alias("p"))
    got = rows.select(models.detect_layout(Detector)(F.col("p")).alias("d")).collect()
    assert [r.d for r in got] == [[[2.0, 0.9, 0.0, 0.0, 3.0, 1.0]], None]
    assert all(r.d is None for r in rows.select(models.recognise_lines(broken)(F.col("p")).alias("d")).collect())


FRAMES = "session_id long, ts timestamp, frame_no long, corners array<struct<x:double,y:double>>, frame_area double, blur_variance double"


def frame_rows(spark):
    quad = lambda d: [(0.0 + d, 0.0), (100.0 + d, 0.0), (100.0 + d, 80.0), (0.0 + d, 80.0)]
    shift = [0, 14, 0, 5, 5, 5, 5, 5, 5, 40, 40, None, 40]
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(1, t + dt.timedelta(seconds=i), i, None if d is None else quad(d), 10_000.0, 45.0) for i, d in enumerate(shift)], FRAMES)


def test_stable_frames(spark):
    got = [(r.stable_count, r.stable) for r in capture.stable_frames(frame_rows(spark)).orderBy("frame_no").collect()]
    assert [c for c, _ in got] == [1, 2, 3, 4, 5, 6, 7, 8, 9, 1, 2, 0, 1]
    assert [i for i, (_, s) in enumerate(got) if s] == [7, 8]


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set(*capture.ROCKSDB)
    frame_rows(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(FRAMES).parquet(str(tmp_path / "in"))
    q = capture.steady_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.frame_no: (r.stable_count, r.stable, r.captured) for r in spark.read.schema(capture.OUTPUT).parquet(str(tmp_path / "out")).collect()}
    want = {r.frame_no: (r.stable_count, r.stable) for r in capture.stable_frames(frame_rows(spark)).collect()}
    assert {k: v[:2] for k, v in got.items()} == want
    assert [k for k, v in got.items() if v[2]] == [7]

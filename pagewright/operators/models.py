"""Boundaries to recognition models: small protocols, executed in Arrow batches with one model per task, and the chains
from them to texts, tables and pages.

A model that can't be made, and an input on which it fails, give null (callers then take the plain way), never a failed
task. A model that has close() is closed at the end of its task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import suppress
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ocr, tables


class LayoutDetector(Protocol):
    def detect(self, picture: np.ndarray) -> list[list[float]]:
        """Rows of class, score, x1, y1, x2, y2."""


class TableModel(Protocol):
    def structure(self, picture: np.ndarray) -> tuple[list[list[float]], list[list[float]]]:
        """Logits by step, and quads by step."""


class TextDetector(Protocol):
    def probabilities(self, picture: np.ndarray) -> np.ndarray:
        """A map of the picture's size."""


class TextRecogniser(Protocol):
    def logits(self, line: np.ndarray) -> list[list[float]]:
        """Logits by step."""


class PageRecogniser(Protocol):
    def recognise(self, picture: np.ndarray) -> dict:
        """full_text, words, paragraphs, lines, line_words of a page."""


def picture_of(x: dict | None) -> np.ndarray | None:
    if x is None:
        return None
    return np.array(x["data"], np.float64).reshape((x["h"], x["w"]) if x["channels"] == 1 else (x["h"], x["w"], x["channels"]))


def run_model(make: Callable[[], object], call: Callable[[object, np.ndarray], object], returns: str, arrow: pa.DataType) -> Callable[[Column], Column]:
    """A column function that makes the model once for a task's batches and calls it on each picture (h, w, channels, data)."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            model = make()
        except Exception:  # noqa: BLE001  a model may fail in any way
            model = None
        try:
            for batch in batches:
                out = []
                for x in batch.to_pylist():
                    try:
                        out.append(None if model is None or x is None else call(model, picture_of(x)))
                    except Exception:  # noqa: BLE001
                        out.append(None)
                yield pa.array(out, arrow)
        finally:
            if hasattr(model, "close"):
                with suppress(Exception):  # what the task has given stays
                    model.close()

    return lambda picture: F.arrow_udf(run, returns)(picture)


def detect_layout(make: Callable[[], LayoutDetector]) -> Callable[[Column], Column]:
    return run_model(make, lambda m, a: m.detect(a), "array<array<double>>", pa.list_(pa.list_(pa.float64())))


def recognise_lines(make: Callable[[], TextRecogniser]) -> Callable[[Column], Column]:
    return run_model(make, lambda m, a: m.logits(a), "array<array<double>>", pa.list_(pa.list_(pa.float64())))


def detect_text(make: Callable[[], TextDetector], threshold: float = 0.3) -> Callable[[Column], Column]:
    """Raw boxes (x, y, w, h, score) of the probability map, holes included."""
    from .raster import box_regions

    kind = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32()), ("w", pa.int32()), ("h", pa.int32()), ("score", pa.float64())]))
    boxes = lambda m, a: [dict(zip(("x", "y", "w", "h", "score"), b)) for b in box_regions(np.squeeze(np.asarray(m.probabilities(a))), threshold)]
    return run_model(make, boxes, "array<struct<x:int,y:int,w:int,h:int,score:double>>", kind)


def table_structure(make: Callable[[], TableModel]) -> Callable[[Column], Column]:
    """Logits and quads by step."""
    rows = pa.list_(pa.list_(pa.float64()))
    call = lambda m, a: dict(zip(("logits", "quads"), m.structure(a)))
    return run_model(make, call, "struct<logits:array<array<double>>,quads:array<array<double>>>", pa.struct([("logits", rows), ("quads", rows)]))


WORD = [("text", pa.string()), ("left", pa.int32()), ("top", pa.int32()), ("right", pa.int32()), ("bottom", pa.int32()), ("confidence", pa.float32())]
PAGE = "struct<full_text:string,words:array<struct<text:string,left:int,top:int,right:int,bottom:int,confidence:float>>,paragraphs:array<string>,lines:array<string>>"
PAGE_TYPE = pa.struct([("full_text", pa.string()), ("words", pa.list_(pa.struct(WORD))), ("paragraphs", pa.list_(pa.string())), ("lines", pa.list_(pa.string()))])


def recognise_page(make: Callable[[], PageRecogniser]) -> Callable[[Column], Column]:
    return run_model(make, lambda m, a: m.recognise(a), PAGE, PAGE_TYPE)


def read_pages(pages: DataFrame, make: Callable[[], PageRecogniser], picture: str = "picture") -> DataFrame:
    """Adds full_text, words, paragraphs, lines and failed to pages with a picture. A page on which the recogniser fails
    keeps the paragraphs it has already (or none), so that documents.assembled() takes its plain text."""
    read = pages.withColumn("_page", recognise_page(make)(F.col(picture)))
    plain = F.col("paragraphs") if "paragraphs" in pages.columns else F.array().cast("array<string>")
    return read.withColumns({
        "failed": F.col("_page").isNull(), "paragraphs": F.coalesce("_page.paragraphs", plain), "full_text": F.coalesce("_page.full_text", F.array_join(plain, "\n")), "words": F.col("_page.words"), "lines": F.col("_page.lines"),
    }).drop("_page")


def cut_out(picture: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """The part of a picture within a box; null where the box has no pixel of it."""
    kind = pa.struct([("h", pa.int32()), ("w", pa.int32()), ("channels", pa.int32()), ("data", pa.list_(pa.float64()))])

    def run(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for parts in columns:
            out = []
            for x, *box in zip(*(c.to_pylist() for c in parts)):
                a = picture_of(x)
                y = None if a is None or None in box else a[max(0, box[1]) : max(0, box[3]), max(0, box[0]) : max(0, box[2])]
                out.append({"h": y.shape[0], "w": y.shape[1], "channels": x["channels"], "data": y.ravel().tolist()} if y is not None and y.size else None)
            yield pa.array(out, kind)

    return F.arrow_udf(run, "h int, w int, channels int, data array<double>")(picture, left, top, right, bottom)


def read_lines(pages: DataFrame, keys: Sequence[str], detector: Callable[[], TextDetector], recogniser: Callable[[], TextRecogniser], vocabulary: Sequence[str], threshold: float = 0.3) -> DataFrame:
    """keys, det_no, text, left, top, right, bottom of pages (keys, picture): boxes of text, each cut out and decoded. Input
    for ocr.line_page(). Boxes on which the recogniser fails have no line."""
    size = F.struct(F.col("picture.w").alias("w"), F.col("picture.h").alias("h"))
    found = pages.select(*keys, "picture", F.posexplode(detect_text(detector, threshold)(F.col("picture"))).alias("det_no", "_b"), size.alias("_s"))
    raw = found.select(*keys, "picture", "det_no", "_b.*", *[F.col(f"_s.{side}").alias(f"{kind}_{side}") for kind in ("resized", "orig") for side in "wh"])
    boxes = ocr.text_boxes(raw)
    crop = cut_out(F.col("picture"), *[F.col(c) for c in ("left", "top", "right", "bottom")])
    read = boxes.select(*keys, "det_no", "left", "top", "right", "bottom", recognise_lines(recogniser)(crop).alias("_l"))
    steps = read.select(*keys, "det_no", F.struct("left", "top", "right", "bottom").alias("_box"), F.posexplode("_l").alias("step", "logits"))
    boxed = steps.groupBy(*keys, "det_no").agg(F.first("_box").alias("_box"))
    texts = ocr.greedy_text(steps, [*keys, "det_no"], vocabulary)
    return texts.join(boxed, [*keys, "det_no"]).select(*keys, "det_no", "text", "_box.*")


def read_tables(crops: DataFrame, keys: Sequence[str], make: Callable[[], TableModel], vocabulary: Sequence[str]) -> DataFrame:
    """keys, cell_no, row_start, col_start, row_span, col_span, box of tables' pictures (keys, picture): the model's steps,
    decoded and put into cells. Tables on which the model fails have no cell, so tables.recognised() goes on to the next way."""
    made = crops.select(*keys, table_structure(make)(F.col("picture")).alias("_t")).where("_t is not null")
    steps = made.select(*keys, F.posexplode(F.arrays_zip("_t.logits", "_t.quads")).alias("step", "_s")).select(*keys, "step", F.col("_s.logits").alias("logits"), F.col("_s.quads").alias("box"))
    tokens = tables.decoded_tokens(steps, keys, vocabulary)
    listed = tokens.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("step", "token", "box"))).alias("_l"))
    return tables.cells_of_tokens(listed.select(*keys, F.col("_l.token").alias("tokens"), F.col("_l.box").alias("boxes")), keys)


def extracted(spark: SparkSession, source: str, folder: str) -> str:
    """The path of a model's or dictionary's file in a folder that all executors share. It is copied once: a marker beside
    it, written after the whole file is there, tells later calls so; a copy that broke off is made again."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    at, target = hadoop.Path(source), hadoop.Path(folder, source.rstrip("/").rpartition("/")[2])
    store, marker = target.getFileSystem(conf), target.suffix(".done")
    if not (store.exists(marker) and store.exists(target)):
        part = target.suffix(".part")
        store.delete(marker, False)
        store.delete(target, False)
        hadoop.FileUtil.copy(at.getFileSystem(conf), at, store, part, False, True, conf)
        store.rename(part, target)
        store.create(marker, True).close()
    return target.toString()


class OnnxModel:
    """An ONNX file as a model: one input of planes, all outputs in order. Needs onnxruntime, which is not a dependency."""

    def __init__(self, path: str) -> None:
        import onnxruntime

        self.session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
        self.input = self.session.get_inputs()[0].name

    def __call__(self, planes: np.ndarray) -> list[np.ndarray]:
        return self.session.run(None, {self.input: planes[None].astype(np.float32)})

"""File sources: pictures (PGM, PPM, raw arrays), hOCR pages, dictionaries, and listings of exported documents."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.raster import PICTURE, PICTURE_TYPE


def decode_netpbm(content: bytes) -> np.ndarray:
    """A picture of a binary PGM (P5) or PPM (P6) file of at most 8 bits."""
    kind = content[:2]
    if kind not in (b"P5", b"P6"):
        raise ValueError("not a binary PGM or PPM file")
    at, numbers = 2, []
    while len(numbers) < 3:
        while content[at : at + 1].isspace():
            at += 1
        if content[at : at + 1] == b"#":
            at = content.index(b"\n", at)
            continue
        end = at
        while content[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("broken header")
        numbers.append(int(content[at:end]))
        at = end
    w, h, most = numbers
    channels = 1 if kind == b"P5" else 3
    data = np.frombuffer(content, np.uint8, w * h * channels, at + 1).astype(np.float64)
    return data.reshape((h, w) if channels == 1 else (h, w, 3)) * (255.0 / most)


#: EXIF orientations that are rotations; all others, mirrored ones too, are left as they are.
ORIENTATIONS = {6: 90, 3: 180, 8: 270}


def orientation_degrees(orientation: Column) -> Column:
    """The turn of an EXIF orientation."""
    turns = F.create_map(*[F.lit(x) for pair in ORIENTATIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(turns, orientation), F.lit(0))


def pictures(spark: SparkSession, path: str, rotation: DataFrame | None = None) -> DataFrame:
    """path, modificationTime, picture of image files; null for files that can't be read. rotation (path, degrees) turns
    pictures by its right angles."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime", "content")
    rows = files.withColumn("degrees", F.lit(0)) if rotation is None else files.join(rotation, "path", "left").withColumn("degrees", F.coalesce("degrees", F.lit(0)))

    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for contents, turns in columns:
            out = []
            for content, degrees in zip(contents.to_pylist(), turns.to_pylist()):
                try:
                    a = np.rot90(decode_netpbm(content), -(degrees // 90) % 4)
                    out.append({"h": a.shape[0], "w": a.shape[1], "channels": 1 if a.ndim == 2 else 3, "data": a.ravel().tolist()})
                except (ValueError, IndexError):
                    out.append(None)
            yield pa.array(out, PICTURE_TYPE)

    return rows.select("path", "modificationTime", F.arrow_udf(run, PICTURE)(F.col("content"), F.col("degrees")).alias("picture"))


def hocr_pages(spark: SparkSession, path: str) -> DataFrame:
    """path, hocr: a page per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("hocr"))


def dictionary_lines(spark: SparkSession, path: str) -> list[str]:
    """Lines of a dictionary file in order; dictionaries have thousands of lines at most and serve as parameters."""
    whole = spark.read.text(path, wholetext=True).first()
    return whole.value.split("\n") if whole else []


def exported(spark: SparkSession, path: str) -> DataFrame:
    """path, name, modificationTime, length of exported documents, the newest first. File contents are not read."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length")
    return newest_first(files.where(F.lower("path").endswith(".pdf")).withColumn("name", F.element_at(F.split("path", "/"), -1)), "modificationTime", "name")


def newest_first(files: DataFrame, modified: str, name: str) -> DataFrame:
    return files.orderBy(F.desc(modified), name)


def places(files: DataFrame, folder: Sequence[str], modified: str, name: str) -> DataFrame:
    """Adds place: the newest of each folder is 1. Needs no order of all files."""
    return files.withColumn("place", F.row_number().over(Window.partitionBy(*folder).orderBy(F.desc(modified), name)))


def packed_rows(data: Column, h: Column, w: Column, stride: Column) -> Column:
    """Luminance rows without the padding behind each row."""
    return F.flatten(F.transform(F.sequence(F.lit(0), h - 1), lambda r: F.slice(data, r * stride + 1, w)))


def thumbnail(data: Column, h: Column, w: Column, step: int = 4) -> Column:
    """Every step-th pixel of every step-th row."""
    return F.filter(data, lambda v, i: (F.floor(i / w) % step == 0) & (i % w % step == 0))


def turned(data: Column, h: Column, w: Column, degrees: Column) -> Column:
    """A picture's pixels after a clockwise turn by a multiple of 90 degrees: an index map, row by row."""
    n = h * w

    def source(i: Column) -> Column:
        oh = F.when(degrees % 180 == 0, h).otherwise(w)
        ow = F.when(degrees % 180 == 0, w).otherwise(h)
        y, x = F.floor(i / ow), i % ow
        return F.when(degrees == 90, (h - 1 - x) * w + y).when(degrees == 180, (h - 1 - y) * w + (w - 1 - x)).when(degrees == 270, x * w + (w - 1 - y)).otherwise(i) + 0 * oh

    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(data, source(i).cast("int")))

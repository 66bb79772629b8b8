"""PDF and text output: text operations by projection, and one PDF per document written by the executors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import PAGE_BREAK, clean_name, in_order


def text_operations(words: DataFrame, keys: Sequence[str], order: Sequence[str], scale: Column) -> DataFrame:
    """keys, op_no, x, y, size, text: invisible words at the lower left of their boxes, as large as those are high; words
    without height go."""
    size = (F.col("bottom") - F.col("top")) * scale
    place = Window.partitionBy(*keys).orderBy(*order)
    kept = words.where(size > 0)
    return kept.select(*keys, (F.row_number().over(place) - 1).cast("int").alias("op_no"), (F.col("left") * scale).alias("x"), (F.col("bottom") * scale).alias("y"), size.alias("size"), "text")


def with_results(pages: DataFrame, results: DataFrame, doc: Sequence[str], page: str) -> DataFrame:
    """Pages and recognition results of equal document and number."""
    return pages.join(results, [*doc, page])


def full_texts(pages: DataFrame, keys: Sequence[str], page: str, text: str) -> DataFrame:
    """keys, full_text: pages joined by the page break."""
    return pages.groupBy(*keys).agg(in_order((page,), text, PAGE_BREAK).alias("full_text"))


def file_names(documents: DataFrame, name: str, at: str, order: Sequence[str]) -> DataFrame:
    """Adds file_name: the cleaned name, else Scan_ and the time; later documents of one name get _1, _2 and so on. A number
    is passed over if some document has that name of its own, so no two names are equal. The order must be total."""
    base = F.coalesce(clean_name(F.col(name)), F.concat(F.lit("Scan_"), F.date_format(at, "yyyyMMdd_HHmmss")))
    n = (F.row_number().over(Window.partitionBy("_base").orderBy(*order)) - 1).cast("long")
    named = documents.withColumn("_base", base).withColumn("_n", n)
    numbered = r"^(.*)_([1-9][0-9]{0,17})$"
    own = named.where("_n = 0").select(F.regexp_extract("_base", numbered, 1).alias("_base"), F.regexp_extract("_base", numbered, 2).try_cast("long").alias("_k")).where("_k is not null")
    taken = own.groupBy("_base").agg(F.array_sort(F.collect_set("_k")).alias("_taken"))
    free = F.aggregate(F.coalesce("_taken", F.array().cast("array<long>")), F.col("_n"), lambda k, t: F.when(t <= k, k + 1).otherwise(k))
    whole = named.join(taken, "_base", "left").withColumn("file_name", F.concat("_base", F.when(F.col("_n") > 0, F.concat(F.lit("_"), free.cast("string"))).otherwise(F.lit("")), F.lit(".pdf")))
    return whole.select(*documents.columns, "file_name")


def shown(text: str) -> bytes:
    """A text as the font and the string that show it: Windows-1252 where it can be said so, else UTF-16 units."""
    try:
        return b"/F1 %%.2f Tf %%.2f %%.2f Td (%s) Tj" % text.encode("cp1252").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r").replace(b"%", b"%%")
    except UnicodeEncodeError:
        return b"/F2 %%.2f Tf %%.2f %%.2f Td <%s> Tj" % text.encode("utf-16-be", "replace").hex().encode()


def _stream(head: bytes, content: bytes) -> bytes:
    packed = zlib.compress(content)
    return b"<< %s/Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (head, len(packed), packed)


def _unicode_font(at: int) -> list[bytes]:
    """Objects, the first of number at, of a font whose two-byte codes are UTF-16 units and say so to who searches. Nothing
    of it is drawn, so it has no outlines."""
    ranges = [b"<%02X00> <%02XFF> <%02X00>\n" % (i, i, i) for i in range(256)]
    blocks = b"".join(b"%d beginbfrange\n%sendbfrange\n" % (len(ranges[i : i + 100]), b"".join(ranges[i : i + 100])) for i in range(0, 256, 100))
    head = b"/CIDInit /ProcSet findresource begin\n12 dict begin\nbegincmap\n/CIDSystemInfo << /Registry (Adobe) /Ordering (UCS) /Supplement 0 >> def\n/CMapName /Adobe-Identity-UCS def\n/CMapType 2 def\n1 begincodespacerange\n<0000> <FFFF>\nendcodespacerange\n"
    return [
        b"<< /Type /Font /Subtype /Type0 /BaseFont /Invisible /Encoding /Identity-H /DescendantFonts [%d 0 R] /ToUnicode %d 0 R >>" % (at + 1, at + 3),
        b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Invisible /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /FontDescriptor %d 0 R /DW 500 >>" % (at + 2),
        b"<< /Type /FontDescriptor /FontName /Invisible /Flags 4 /FontBBox [0 -200 500 800] /ItalicAngle 0 /Ascent 800 /Descent -200 /CapHeight 800 /StemV 80 >>",
        _stream(b"", head + blocks + b"endcmap\nCMapName currentdict /CMap defineresource pop\nend\nend\n"),
    ]


def pdf_bytes(pages: list[dict]) -> bytes:
    """A PDF of pages (w, h, picture as grey or RGB bytes or None, ops: x, y, size, text from the top left). Each page has its
    own size; texts, of any script, are invisible but can be searched. At least one page is needed."""
    if not pages:
        raise ValueError("a document needs at least one page")
    objects: list[bytes] = [b"", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    texts = [[(op, shown(op["text"] or "")) for op in p.get("ops") or []] for p in pages]
    fonts = b"/Font << /F1 3 0 R >>"
    if any(t.startswith(b"/F2") for own in texts for _, t in own):
        fonts = b"/Font << /F1 3 0 R /F2 %d 0 R >>" % (len(objects) + 1)
        objects += _unicode_font(len(objects) + 1)
    kids = []
    for p, own in zip(pages, texts):
        w, h = p["w"], p["h"]
        content, resources = b"", fonts
        if p.get("picture"):
            space = b"/DeviceGray" if len(p["picture"]) == w * h else b"/DeviceRGB"
            objects.append(_stream(b"/Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace %s /BitsPerComponent 8 " % (w, h, space), p["picture"]))
            resources += b" /XObject << /I %d 0 R >>" % len(objects)
            content += b"q %d 0 0 %d 0 0 cm /I Do Q\n" % (w, h)
        for op, text in own:
            content += b"BT 3 Tr %s ET\n" % (text % (op["size"], op["x"], h - op["y"]))
        objects.append(_stream(b"", content))
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Contents %d 0 R /Resources << %s >> >>" % (w, h, len(objects), resources))
        kids.append(len(objects))
    objects[0] = b"<< /Type /Catalog /Pages 2 0 R >>"
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    out, at = b"%PDF-1.4\n", []
    for i, o in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, o)
    table = b"".join(b"%010d 00000 n \n" % a for a in at)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table, len(objects) + 1, len(out))


def compressed(picture: bytes, w: int, h: int, levels: int = 32) -> bytes:
    """The compressed mode: grey values or colours on fewer levels, which the stream's compression then packs better."""
    step = 256 // levels
    return bytes(min(255, b // step * step + step // 2) for b in picture)


PAGE = "struct<page_no:int,w:int,h:int,picture:binary,ops:array<struct<x:double,y:double,size:double,text:string>>>"


def documents(pages: DataFrame, keys: Sequence[str], compress: bool = False) -> DataFrame:
    """keys, pdf (binary) of pages (keys, page_no, w, h, picture, ops). A document's pages meet in one row, as one file needs."""
    listed = pages.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("page_no", "w", "h", "picture", "ops"))).alias("_p"))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for p in batch.to_pylist():
                if compress:
                    p = [x | {"picture": x["picture"] and compressed(x["picture"], x["w"], x["h"])} for x in p]
                out.append(pdf_bytes(p))
            yield pa.array(out, pa.binary())

    return listed.select(*keys, F.arrow_udf(run, "binary")(F.col("_p")).alias("pdf"))


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes rows (file_name, pdf) as files of a folder that all executors share; gives path and size of each. A task that
    runs again writes the same bytes to the same path."""
    import os

    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        os.makedirs(folder, exist_ok=True)
        for names, contents in columns:
            out = []
            for name, content in zip(names.to_pylist(), contents.to_pylist()):
                path = os.path.join(folder, name)
                with open(f"{path}.tmp", "wb") as f:
                    f.write(content)
                os.replace(f"{path}.tmp", path)
                out.append({"path": path, "size": len(content)})
            yield pa.array(out, pa.struct([("path", pa.string()), ("size", pa.int64())]))

    return files.select(F.arrow_udf(run, "path string, size long")(F.col("file_name"), F.col("pdf")).alias("f")).select("f.*")

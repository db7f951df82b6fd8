"""Queries of PDF geometry and joined PDFs: documents are written as PDF files of four builds and read back, with SQL.

A page holds twelve lines. By doc_id mod 4: a classic table; references and objects in streams; boxes and turns that are
inherited over two levels, with a crop box; a file whose startxref leads nowhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from folio.sinks import placed
from folio.sinks.shared import shared_folder
from folio.sources.batches import tasks
from folio.sources.blocks import PER_PAGE
from folio.sources.pdfs import Name, Ref, Stream, assembled, concatenated, joined, page_boxes, written

#: Documents whose files are joined to one.
JOINED = 4


def streamed(objects: list[object]) -> bytes:
    """A file of objects 1, 2 and so on (1 the catalog) whose references are in a stream, and all but streams in another;
    the references have rows with the filter "up"."""
    plain = [(k + 1, written(v)) for k, v in enumerate(objects) if not isinstance(v, Stream)]
    pack, last = len(objects) + 1, len(objects) + 2
    head, body = b"", b""
    for number, data in plain:
        head += b"%d %d " % (number, len(body))
        body += data + b" "
    packed = Stream({"Type": Name("ObjStm"), "N": len(plain), "First": len(head), "Filter": Name("FlateDecode")}, zlib.compress(head + body))
    out, rows = bytearray(b"%PDF-1.7\n"), {0: (0, 0, 255)} | {n: (2, pack, k) for k, (n, _) in enumerate(plain)}
    for number, value in [(k + 1, v) for k, v in enumerate(objects) if isinstance(v, Stream)] + [(pack, packed)]:
        rows[number] = (1, len(out), 0)
        out += b"%d 0 obj\n" % number + written(value) + b"\nendobj\n"
    rows[last] = (1, len(out), 0)
    before, table = bytes(6), b""
    for number in range(last + 1):
        a, b, c = rows[number]
        row = bytes([a]) + b.to_bytes(4, "big") + bytes([c & 255])
        table += b"\2" + bytes((x - y) & 255 for x, y in zip(row, before))
        before = row
    entries = {"Type": Name("XRef"), "Size": last + 1, "W": [1, 4, 1], "Root": Ref(1, 0), "Filter": Name("FlateDecode"), "DecodeParms": {"Predictor": 12, "Columns": 6}}
    return bytes(out + b"%d 0 obj\n" % last + written(Stream(entries, zlib.compress(table))) + b"\nendobj\nstartxref\n%d\n%%%%EOF" % rows[last][1])


def pdf_of(doc_id: int, text: str) -> bytes:
    """A document's lines as a PDF of its build."""
    lines = text.split("\n")
    pages = [lines[k : k + PER_PAGE] for k in range(0, len(lines), PER_PAGE)]
    build = doc_id % 4
    wide = [0, 0, 400 + doc_id % 7 * 10]
    objects: list[object] = [{"Type": Name("Catalog"), "Pages": Ref(2, 0)}, None]
    kids = []
    for p, own in enumerate(pages):
        objects.append(Stream({}, zlib.compress("\n".join(own).encode(), 1)))
        objects[-1].entries["Filter"] = Name("FlateDecode")
        page = {"Type": Name("Page"), "Parent": Ref(2, 0), "Contents": Ref(len(objects), 0)}
        if build == 2:
            if p % 2:
                page["CropBox"] = [10, 20, 1000.0, 1000]
        else:
            page |= {"MediaBox": [*wide, 600 + p % 3 * 50], "Rotate": (doc_id + p) % 4 * 90}
        objects.append(page)
        kids.append(Ref(len(objects), 0))
    if build == 2:  # the tree's root has the box, a node between has the turn
        objects.append({"Type": Name("Pages"), "Parent": Ref(2, 0), "Kids": kids, "Count": len(kids), "Rotate": -90})
        objects[1] = {"Type": Name("Pages"), "Kids": [Ref(len(objects), 0)], "Count": len(kids), "MediaBox": [*wide, 600], "Rotate": 180}
    else:
        objects[1] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)}
    if build == 1:
        return streamed(objects)
    raw = assembled([written(x) for x in objects])
    return raw.replace(b"startxref\n", b"startxref\n9") if build == 3 else raw


def _files(spark, sf_dir):
    """doc_id, path of the documents' files, after they are written."""
    at = shared_folder(spark, "pdfs")
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("doc_id is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 100):
                part = batch.slice(a, 100)
                ids = part.column(0).to_pylist()
                content = [pdf_of(i, t) for i, t in zip(ids, part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array([f"doc-{i}.pdf" for i in ids], pa.string()), pa.array(content, pa.binary())], names=["name", "content"])

    placed.place(documents.mapInArrow(run, "name string, content binary"), at)
    return documents.select("doc_id", F.concat(F.lit(f"{at}/doc-"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path")).distinct()


def pdf_pages(spark, sf_dir):
    """The geometry of every document's pages, and their numbers in a file of JOINED documents each."""
    files = _files(spark, sf_dir)
    parts = files.select(F.floor(F.col("doc_id") / JOINED).alias("output"), F.col("doc_id").alias("nth"), "path")
    rows = joined(page_boxes(files.repartition(tasks(spark), "path")), parts).join(files, "path")
    return rows.select("doc_id", "page", "output", "n", "x1", "y1", "x2", "y2", "rotate", "width", "height")


def pdf_joined(spark, sf_dir):
    """The geometry of the pages of the joined files, as they are written and read back."""
    parts = _files(spark, sf_dir).select(F.concat(F.floor(F.col("doc_id") / JOINED).cast("string"), F.lit(".pdf")).alias("output"), F.col("doc_id").alias("nth"), "path")
    at = shared_folder(spark, "joined")
    placed.place(concatenated(parts), at)
    outputs = parts.select(F.regexp_extract("output", r"\d+", 0).cast("long").alias("output"), F.concat(F.lit(f"{at}/"), "output").alias("path")).distinct()
    return page_boxes(outputs.repartition(tasks(spark), "path")).join(outputs, "path").select("output", F.col("page").alias("n"), "rotate", "width", "height", "error")


QUERIES = {f.__name__: f for f in (pdf_pages, pdf_joined)}

_PAGES = f"""WITH d AS (SELECT DISTINCT doc_id, (len(string_split(text, chr(10))) - 1) // {PER_PAGE} + 1 AS pages FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT doc_id, CAST(unnest(range(pages)) AS INTEGER) AS page FROM d),
b AS (SELECT *, doc_id % 4 = 2 AS inherits, 400 + doc_id % 7 * 10 AS w, CASE WHEN doc_id % 4 = 2 THEN 600 ELSE 600 + page % 3 * 50 END AS h, CASE WHEN doc_id % 4 = 2 THEN 270 ELSE (doc_id + page) % 4 * 90 END AS turn FROM p),
g AS (SELECT *, CASE WHEN inherits AND page % 2 = 1 THEN 10.0::DOUBLE ELSE 0 END AS x1, CASE WHEN inherits AND page % 2 = 1 THEN 20.0::DOUBLE ELSE 0 END AS y1 FROM b),
pages AS (SELECT doc_id, page, doc_id // {JOINED} AS output, row_number() OVER (PARTITION BY doc_id // {JOINED} ORDER BY doc_id, page) - 1 AS n, x1, y1, CAST(w AS DOUBLE) AS x2, CAST(h AS DOUBLE) AS y2, CAST(turn AS INTEGER) AS rotate,
  CASE WHEN turn % 180 = 0 THEN w - x1 ELSE h - y1 END AS width, CASE WHEN turn % 180 = 0 THEN h - y1 ELSE w - x1 END AS height FROM g)"""
SQL = {
    "pdf_pages": f"{_PAGES} SELECT * FROM pages",
    "pdf_joined": f"{_PAGES} SELECT output, n, rotate, width, height, NULL AS error FROM pages",
}

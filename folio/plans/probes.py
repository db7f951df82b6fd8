"""Queries of image probes and of nested pages, with their SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import nesting
from folio.sources import images
from folio.sources.blocks import BLOCKS_SQL, blocks

PAGE = ["token", "page"]


def _be(n, digits=8):
    return F.lpad(F.hex(n), digits, "0")


def _le(n, size=2):
    """A number's bytes in hex, the lowest first."""
    return F.concat(*[F.lpad(F.hex(F.shiftright(n, 8 * k) % 256), 2, "0") for k in range(size)])


def _content():
    """Headers of images of a block's width and height, in a format by its number, and what is none."""
    w, h, k = (F.round((F.col("x2") - F.col("x1")) * 1024).cast("int"), F.round((F.col("y2") - F.col("y1")) * 1024).cast("int"), F.col("block") % 9)
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), _be(w), _be(h), F.lit("0806000000"))
    gif = F.concat(F.lit("474946383961"), _le(w), _le(h), F.lit("F70000"))
    bmp = F.concat(F.lit("424D" + "00" * 12 + "28000000"), _le(w, 4), _le(h, 4))
    jpg = F.concat(F.lit("FFD8FFE000044A46FFC00011" + "08"), _be(h, 4), _be(w, 4), F.lit("03"))
    webp = F.concat(F.lit("52494646" + "00" * 4 + "57454250" + "56503858" + "0A000000" + "00" * 4), _le(w - 1, 3), _le(h - 1, 3))
    tiff = F.concat(F.lit("4D4D002A00000008" + "0002" + "0100" + "0004" + "00000001"), _be(w), F.lit("0101" + "0003" + "00000001"), _be(h, 4), F.lit("0000"))
    ico = F.concat(F.lit("0000010001002000"), F.lit("00" * 8))
    out = F.when(k == 0, png).when(k == 1, gif).when(k == 2, bmp).when(k == 3, jpg).when(k == 4, webp).when(k == 5, tiff).when(k == 6, ico).when(k == 7, F.lit("89504E470D0A1A0A00"))
    return F.unhex(out)


def image_sizes(spark, sf_dir):
    """Format and size by header, by base64, and whether the bytes are an image."""
    b = blocks(spark, sf_dir).select(*PAGE, "block", _content().alias("raw")).withColumn("b64", F.base64("raw"))
    found = b.select("*", images.image_size(F.col("raw")).alias("s"), images.image_size_of_base64(F.col("b64")).alias("t"))
    kind = images.file_kind(F.when(F.col("block") % 4 == 3, F.lit("a.PDF")).otherwise(F.lit("a")), F.col("raw"))
    return found.select(*PAGE, "block", F.coalesce("s.format", F.lit("none")).alias("format"), F.coalesce("s.width", F.lit(0)).alias("width"), F.coalesce("s.height", F.lit(0)).alias("height"), F.col("t").eqNullSafe(F.col("s")).alias("same"), images.is_image(F.col("raw")).alias("is_image"), F.coalesce(kind, F.lit("none")).alias("kind"))


def nested_pages(spark, sf_dir):
    """Pages as trees, a node that holds others being its own first child."""
    out = nesting.nested(blocks(spark, sf_dir), 0.6, own_first=True)
    return out.select(*PAGE, "block", F.array_join(F.transform("path", lambda p: p.cast("string")), "/").alias("path"), "type", "subtree")


QUERIES = {f.__name__: f for f in (image_sizes, nested_pages)}
SQL = {
    "image_sizes": f"""WITH {BLOCKS_SQL}, s AS (SELECT token, page, block, block % 9 AS k, CAST(round((x2 - x1) * 1024) AS INTEGER) AS w, CAST(round((y2 - y1) * 1024) AS INTEGER) AS h FROM blocks)
SELECT token, page, block, CASE k WHEN 0 THEN 'png' WHEN 1 THEN 'gif' WHEN 2 THEN 'bmp' WHEN 3 THEN 'jpg' WHEN 4 THEN 'webp' WHEN 5 THEN 'tiff' WHEN 6 THEN 'ico' ELSE 'none' END AS format, CASE WHEN k < 6 THEN w WHEN k = 6 THEN 32 ELSE 0 END AS width, CASE WHEN k < 6 THEN h WHEN k = 6 THEN 256 ELSE 0 END AS height,
true AS same, k < 8 AS is_image, CASE WHEN block % 4 = 3 THEN 'pdf' WHEN k < 8 THEN 'snip' ELSE 'none' END AS kind FROM s""",
}

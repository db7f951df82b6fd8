"""Layout blocks derived from the lines of `documents`: a typed page layout to run the layout operators on.

All coordinates are multiples of 1/1024, so boxes and areas are exact doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Types by (doc_id * 7 + pos * 3) mod 16 for the first 11; the rest are paragraphs (fixed values).
TYPES = ("title", "equation", "figure", "imagecaption", "table", "chart", "legend", "reference", "group", "image", "figuregroup")
CONTAINERS = ("group", "image", "figuregroup")
PER_PAGE = 12


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token, page, block, type, x1, y1, x2, y2, text: a row for each line of each document."""
    lines = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    d, p = F.col("doc_id"), F.col("pos")
    kind = F.coalesce(F.get(F.array(*map(F.lit, TYPES)), ((d * 7 + p * 3) % 16).cast("int")), F.lit("paragraph"))
    placed = lines.select(
        F.concat(F.lit("doc-"), d.cast("string")).alias("token"),
        F.floor(p / PER_PAGE).cast("int").alias("page"),
        (p % PER_PAGE).cast("int").alias("block"),
        F.when(p % PER_PAGE == 0, "pageheader").when(p % PER_PAGE == PER_PAGE - 1, "pagenumber").otherwise(kind).alias("type"),
        ((p % 2) * 512 + 16 + (d * 13 + p * 7) % 32).alias("ix"),
        (F.floor((p % PER_PAGE) / 2) * 152 + 16 + (d * 3 + p * 5) % 48).alias("iy"),
        (360 + (d * 5 + p * 11) % 96).alias("iw"),
        (96 + (d * 17 + p) % 80).alias("ih"),
        "text",
    )
    holds = F.col("type").isin(*CONTAINERS)
    box = {
        "x1": F.when(holds, F.col("ix") - 8).otherwise(F.col("ix")),
        "y1": F.when(holds, F.col("iy") - 8).otherwise(F.col("iy")),
        "x2": F.when(holds, F.least(F.lit(1024), F.col("ix") + F.col("iw") + 8)).otherwise(F.col("ix") + F.col("iw")),
        "y2": F.when(holds, F.least(F.lit(1024), F.col("iy") + F.col("ih") + 300)).otherwise(F.col("iy") + F.col("ih")),
    }
    return placed.select("token", "page", "block", "type", *[(v / F.lit(1024.0)).alias(k) for k, v in box.items()], "text")


_kinds = " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(TYPES))
_holds = "type IN ('group', 'image', 'figuregroup')"
BLOCKS_SQL = f"""
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents
), placed AS (
  SELECT 'doc-' || doc_id AS token, CAST(pos // 12 AS INTEGER) AS page, CAST(pos % 12 AS INTEGER) AS block,
    CASE WHEN pos % 12 = 0 THEN 'pageheader' WHEN pos % 12 = 11 THEN 'pagenumber'
      ELSE CASE (doc_id * 7 + pos * 3) % 16 {_kinds} ELSE 'paragraph' END END AS type,
    (pos % 2) * 512 + 16 + (doc_id * 13 + pos * 7) % 32 AS ix, ((pos % 12) // 2) * 152 + 16 + (doc_id * 3 + pos * 5) % 48 AS iy,
    360 + (doc_id * 5 + pos * 11) % 96 AS iw, 96 + (doc_id * 17 + pos) % 80 AS ih, text FROM lines
), blocks AS (
  SELECT token, page, block, type, text,
    CASE WHEN {_holds} THEN ix - 8 ELSE ix END / 1024.0::DOUBLE AS x1, CASE WHEN {_holds} THEN iy - 8 ELSE iy END / 1024.0::DOUBLE AS y1,
    CASE WHEN {_holds} THEN least(1024, ix + iw + 8) ELSE ix + iw END / 1024.0::DOUBLE AS x2,
    CASE WHEN {_holds} THEN least(1024, iy + ih + 300) ELSE iy + ih END / 1024.0::DOUBLE AS y2 FROM placed
)"""

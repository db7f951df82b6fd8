"""Queries over derived layout blocks, conversations and events, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.geometry import area, intersection, iou
from folio.functions.render import render
from folio.operators.layout import page_pairs
from folio.plans import figures, files, groups, layout, orders, pdfs, pixels, probes, qa, records, rich, shapes, texts, trees
from folio.sources.blocks import BLOCKS_SQL, blocks

#: Page furniture that rendering leaves out (fixed values).
MARGINALIA = ("pageheader", "pagefooter", "pagenumber")


def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as Markdown: blocks in order, joined by blank lines, without page furniture."""
    body = blocks(spark, sf_dir).where(~F.col("type").isin(*MARGINALIA)).select("token", "page", F.struct("block", render("markdown").alias("md")).alias("b"))
    return body.groupBy("token", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["md"]), "\n\n").alias("markdown"), F.count(F.lit(1)).alias("n_blocks"))


def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def bbox_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    return b.select("token", "page", "block", (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"), area().alias("area"), ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_pairs(blocks(spark, sf_dir))


def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _pairs(spark, sf_dir).where((F.col("a_block") < F.col("b_block")) & (intersection("a_", "b_") > 0))
    return near.select("token", "page", "a_block", "b_block", iou("a_", "b_").alias("iou"))


def iof_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part of block a that lies in block b, 0.9 or more."""
    inside = _pairs(spark, sf_dir).where(F.col("a_block") != F.col("b_block")).withColumn("iof", intersection("a_", "b_") / area("a_"))
    return inside.where("iof >= 0.9").select("token", "page", "a_block", "b_block", "iof")


def page_bbox_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).groupBy("token", "page").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def image_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct contents by SHA-256, with the first document that has each."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("hash")).agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"))


def job_state_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each job's last state; a job is a user, its states the events in order."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    names = F.create_map(*[F.lit(x) for x in ("signup", "undefined", "view", "waiting", "click", "processing", "purchase", "success", "error", "error")])
    last = e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("e"), F.count(F.lit(1)).alias("n_events"))
    return last.select("user_id", names[F.col("e.event_type")].alias("state"), "n_events")


QUERIES = {f.__name__: f for f in (page_markdown, type_counts, bbox_metrics, iou_pairs, iof_pairs, page_bbox_union, image_dedupe, job_state_final)}

_common = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0.0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0.0)"
_area = "(({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1))".format
_joined = "FROM blocks a JOIN blocks b ON a.token = b.token AND a.page = b.page"
SQL = {
    "page_markdown": f"WITH {BLOCKS_SQL}, r AS (SELECT *, {texts._render_sql('markdown')} FROM blocks) SELECT token, page, string_agg(markdown, chr(10) || chr(10) ORDER BY block) AS markdown, count(*) AS n_blocks FROM r WHERE type NOT IN ('pageheader', 'pagefooter', 'pagenumber') GROUP BY token, page",
    "type_counts": f"WITH {BLOCKS_SQL} SELECT type, count(*) AS n FROM blocks GROUP BY type",
    "bbox_metrics": f"WITH {BLOCKS_SQL} SELECT token, page, block, x2 - x1 AS w, y2 - y1 AS h, (x2 - x1) * (y2 - y1) AS area, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM blocks",
    "iou_pairs": f"WITH {BLOCKS_SQL}, p AS (SELECT a.token, a.page, a.block AS a_block, b.block AS b_block, {_common} AS i, {_area('a')} + {_area('b')} AS s {_joined} AND a.block < b.block) SELECT token, page, a_block, b_block, i / (s - i) AS iou FROM p WHERE i > 0",
    "iof_pairs": f"WITH {BLOCKS_SQL}, p AS (SELECT a.token, a.page, a.block AS a_block, b.block AS b_block, ({_common}) / {_area('a')} AS iof {_joined} AND a.block <> b.block) SELECT * FROM p WHERE iof >= 0.9",
    "page_bbox_union": f"WITH {BLOCKS_SQL} SELECT token, page, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM blocks GROUP BY token, page",
    "image_dedupe": "SELECT sha256(text) AS hash, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1",
    "job_state_final": "SELECT user_id, CASE last(event_type ORDER BY ts, event_id) WHEN 'signup' THEN 'undefined' WHEN 'view' THEN 'waiting' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'success' ELSE 'error' END AS state, count(*) AS n_events FROM events GROUP BY user_id",
}

for _more in (layout, qa, texts, trees, rich, groups, shapes, figures, orders, probes, records, files, pdfs, pixels):
    QUERIES |= _more.QUERIES
    SQL |= _more.SQL

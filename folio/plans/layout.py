"""Queries of the layout operators and of box functions, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import geometry as G
from folio.functions import text as T
from folio.operators import layout as L
from folio.operators import order as O
from folio.sources.blocks import BLOCKS_SQL, CONTAINERS, blocks


def _px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks in pixels of a page of 1024 by 1024."""
    return blocks(spark, sf_dir).select("token", "page", "block", *[(F.col(c) * 1024).alias(c) for c in ("x1", "y1", "x2", "y2")])


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b, holds = blocks(spark, sf_dir), F.col("type").isin(*CONTAINERS)
    return b.where(~holds), b.where(holds)


def bbox_anchors(spark, sf_dir):
    return blocks(spark, sf_dir).select("token", "page", "block", *[c.alias(k) for k, c in G.anchors().items()])


def bbox_expand(spark, sf_dir):
    return _px(spark, sf_dir).select("token", "page", "block", *[c.alias(k) for k, c in G.expand(20, 1024, 1024).items()])


def bbox_shrink(spark, sf_dir):
    return _px(spark, sf_dir).select("token", "page", "block", *[c.alias(k) for k, c in G.shrink(60).items()])


def bbox_rotate(spark, sf_dir):
    return _px(spark, sf_dir).select("token", "page", "block", *[c.alias(k) for k, c in G.rotate(F.col("block") % 4, 1200, 1024).items()])


def box_arrays(spark, sf_dir):
    """All boxes of a page as an array, turned as often as the page's number says."""
    page = _px(spark, sf_dir).groupBy("token", "page").agg(F.array_sort(F.collect_list(F.struct("block", F.struct("x1", "y1", "x2", "y2").alias("b")))).alias("l"))
    turned = page.select("token", "page", F.transform("l", lambda e: e["block"]).alias("k"), G.rotate_all(F.transform("l", lambda e: e["b"]), F.col("page") % 4, 1200, 1024).alias("b"))
    return turned.select("token", "page", F.explode(F.arrays_zip("k", "b")).alias("e")).select("token", "page", F.col("e.k").alias("block"), "e.b.x1", "e.b.y1", "e.b.x2", "e.b.y2")


def axis_iou_pairs(spark, sf_dir):
    near = L.page_pairs(blocks(spark, sf_dir)).where("a_block < b_block")
    return near.select("token", "page", "a_block", "b_block", G.axis_iou("a_", "b_", "x").alias("iou_x"), G.axis_iou("a_", "b_", "y").alias("iou_y"))


def parent_assignment(spark, sf_dir):
    return L.parents(blocks(spark, sf_dir), 0.9)


def best_container(spark, sf_dir):
    return L.best_match(*_parts(spark, sf_dir), 0.1)


def all_containers(spark, sf_dir):
    return L.all_matches(*_parts(spark, sf_dir), 0.1).select("token", "page", "block", F.array_join("matches", ",").alias("matches"))


def overlap_suppression(spark, sf_dir):
    """Every fifth line has a watermark, a pixel to the right, laid over it."""
    b = blocks(spark, sf_dir)
    marks = b.where((F.col("page") * 12 + F.col("block")) % 5 == 3).withColumns({"x1": F.col("x1") + 1 / 1024, "x2": F.col("x2") + 1 / 1024})
    return L.uncovered(b, marks).select("token", "page", "block", "type")


def clean_types(spark, sf_dir):
    return L.clean_types(blocks(spark, sf_dir)).select("token", "page", "block", "type")


def column_types(spark, sf_dir):
    return L.column_types(blocks(spark, sf_dir))


def page_extent(spark, sf_dir):
    return L.page_extent(blocks(spark, sf_dir))


def x_profile(spark, sf_dir):
    return L.x_profile(blocks(spark, sf_dir))


def usual_left(spark, sf_dir):
    return L.usual_left(blocks(spark, sf_dir))


def block_numbers(spark, sf_dir):
    return L.numbered(blocks(spark, sf_dir))


def page_neighbours(spark, sf_dir):
    return L.page_neighbours(blocks(spark, sf_dir))


def paragraph_runs(spark, sf_dir):
    return L.paragraphs(blocks(spark, sf_dir))


def reading_order(spark, sf_dir):
    return O.xy_order(blocks(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (bbox_anchors, bbox_expand, bbox_shrink, bbox_rotate, box_arrays, axis_iou_pairs, parent_assignment, best_container, all_containers, overlap_suppression, clean_types, column_types)
    + (page_extent, x_profile, usual_left, block_numbers, page_neighbours, paragraph_runs, reading_order)
}

_W = f"WITH {BLOCKS_SQL}"
_px_sql = ", px AS (SELECT token, page, block, x1 * 1024 AS x1, y1 * 1024 AS y1, x2 * 1024 AS x2, y2 * 1024 AS y2 FROM blocks)"
_both = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0.0::DOUBLE) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0.0::DOUBLE)"
_area = "(({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1))".format
_iou = f"({_both}) / ({_area('a')} + {_area('b')} - {_both})"
_level = "(CASE {0}.type WHEN 'group' THEN 5 WHEN 'image' THEN 4 WHEN 'figuregroup' THEN 3 WHEN 'figure' THEN 2 WHEN 'expression' THEN 2 WHEN 'chart' THEN 2 WHEN 'moleculegroup' THEN 1 ELSE 0 END * 0.01::DOUBLE)".format
_page = "a.token = b.token AND a.page = b.page"
_held = "('group', 'image', 'figuregroup')"
_split = f", l AS (SELECT * FROM blocks WHERE type NOT IN {_held}), r AS (SELECT * FROM blocks WHERE type IN {_held})"
_axis = "CASE WHEN least(a.{0}2, b.{0}2) > greatest(a.{0}1, b.{0}1) THEN (least(a.{0}2, b.{0}2) - greatest(a.{0}1, b.{0}1)) / (greatest(a.{0}2, b.{0}2) - least(a.{0}1, b.{0}1)) ELSE 0.0::DOUBLE END".format
_anchor_sql = ", ".join(f"{e} AS {v}_{h}_{axis}" for v, ye in (("top", "y1"), ("middle", "(y1 + y2) / 2"), ("bottom", "y2")) for h, xe in (("left", "x1"), ("center", "(x1 + x2) / 2"), ("right", "x2")) for axis, e in (("x", xe), ("y", ye)))
_turn = lambda name, same, one, two, three: f"CASE block % 4 WHEN 1 THEN {one} WHEN 2 THEN {two} WHEN 3 THEN {three} ELSE {same} END AS {name}"
_head = f"""regexp_matches(ltrim(regexp_replace(regexp_replace(regexp_replace(text, '{T.OPENED}', ''), '{T.CLOSING}', ''), '{T.NUMBERED}', ''), ' ' || chr(10) || chr(13) || chr(9)), '{T.HEAD}')"""
_tail = f"""regexp_matches(trim(regexp_replace(text, '{T.CLOSED}', ''), ' ' || chr(10) || chr(13) || chr(9)), '{T.TAIL}')"""
_flows = "type IN ('paragraph', 'caption', 'imagecaption', 'figurecaption', 'tablecaption', 'expressioncaption')"
SQL = {
    "bbox_anchors": f"{_W} SELECT token, page, block, {_anchor_sql} FROM blocks",
    "bbox_expand": f"{_W}{_px_sql} SELECT token, page, block, greatest(x1 - 20, 0) AS x1, greatest(y1 - 20, 0) AS y1, least(x2 + 20, 1024) AS x2, least(y2 + 20, 1024) AS y2 FROM px",
    "bbox_shrink": f"{_W}{_px_sql}, s AS (SELECT *, greatest(0, least(60, floor((x2 - x1 - 1) / 2))) AS p FROM px), t AS (SELECT *, greatest(0, least(p, floor((y2 - y1 - 1) / 2))) AS q FROM s) SELECT token, page, block, x1 + p AS x1, y1 + q AS y1, x2 - p AS x2, y2 - q AS y2 FROM t",
    "bbox_rotate": f"{_W}{_px_sql} SELECT token, page, block, {_turn('x1', 'x1', 'y1', '1200 - x2', '1200 - y2')}, {_turn('y1', 'y1', '1024 - x2', '1024 - y2', 'x1')}, {_turn('x2', 'x2', 'y2', '1200 - x1', '1200 - y1')}, {_turn('y2', 'y2', '1024 - x1', '1024 - y1', 'x2')} FROM px",
    "axis_iou_pairs": f"{_W} SELECT a.token, a.page, a.block AS a_block, b.block AS b_block, {_axis('x')} AS iou_x, {_axis('y')} AS iou_y FROM blocks a JOIN blocks b ON {_page} AND a.block < b.block",
    "parent_assignment": f"{_W}, c AS (SELECT a.token, a.page, a.block, b.block AS p, {_area('b')} + {_level('b')} + (abs(b.x1 - a.x1) + abs(b.y1 - a.y1)) + {_level('b')} AS w FROM blocks a JOIN blocks b ON {_page} AND a.block <> b.block AND {_level('b')} > 0 AND {_area('b')} + {_level('b')} > {_area('a')} + {_level('a')} AND ({_both}) / {_area('a')} >= 0.9::DOUBLE), d AS (SELECT token, page, block, p FROM c QUALIFY row_number() OVER (PARTITION BY token, page, block ORDER BY w, p) = 1) SELECT token, page, block, coalesce(p, -1) AS parent FROM blocks LEFT JOIN d USING (token, page, block)",
    "best_container": f"{_W}{_split}, c AS (SELECT a.token, a.page, a.block, b.block AS m, {_iou} AS s FROM l a JOIN r b ON {_page}), d AS (SELECT token, page, block, m FROM c WHERE s > 0.1::DOUBLE QUALIFY row_number() OVER (PARTITION BY token, page, block ORDER BY s DESC, m) = 1) SELECT token, page, block, coalesce(m, -1) AS match FROM l LEFT JOIN d USING (token, page, block)",
    "all_containers": f"{_W}{_split}, c AS (SELECT a.token, a.page, a.block, string_agg(b.block, ',' ORDER BY b.block) AS m FROM l a JOIN r b ON {_page} AND {_iou} > 0.1::DOUBLE GROUP BY ALL) SELECT token, page, block, coalesce(m, '') AS matches FROM l LEFT JOIN c USING (token, page, block)",
    "overlap_suppression": f"{_W}, marks AS (SELECT token, page, x1 + 1 / 1024.0::DOUBLE AS x1, y1, x2 + 1 / 1024.0::DOUBLE AS x2, y2 FROM blocks WHERE (page * 12 + block) % 5 = 3) SELECT token, page, block, type FROM blocks a WHERE NOT EXISTS (SELECT 1 FROM marks b WHERE {_page} AND {_iou} > 0.9::DOUBLE)",
    "clean_types": f"{_W} SELECT token, page, block, CASE type WHEN 'table' THEN 'image' WHEN 'tablecaption' THEN 'imagecaption' WHEN 'tablefootnote' THEN 'imagefootnote' ELSE type END AS type FROM blocks WHERE type NOT IN ('hline', 'pageheader', 'pagefooter', 'pagenumber', 'pagebar', 'watermark')",
    "column_types": f"{_W}, s AS (SELECT a.token, a.page, a.block, any_value(a.x1) AS x1, any_value(a.x2) AS x2, max(CASE WHEN a.block <> b.block THEN greatest(least(a.y2, b.y2) * 1024 - 3 - greatest(a.y1, b.y1) * 1024 - 3, 0) / ((a.y2 - a.y1) * 1024 - 6 + (b.y2 - b.y1) * 1024 - 6 - greatest(least(a.y2, b.y2) * 1024 - 3 - greatest(a.y1, b.y1) * 1024 - 3, 0)) END) AS share FROM blocks a JOIN blocks b ON {_page} GROUP BY a.token, a.page, a.block), p AS (SELECT token, page, count(*) AS n_items, coalesce(avg(share), 0) AS y, median(x2 - x1) / (max(x2) - min(x1)) AS x, 2 * count(*) / 1024.0::DOUBLE AS u FROM s GROUP BY token, page) SELECT token, page, n_items, CASE WHEN n_items <= 1 THEN 'single' WHEN y < 1e-6 THEN 'single_1' WHEN y < u AND x > 0.5 THEN 'single_2' WHEN y < 2 * u AND x > 0.5 THEN 'single_3' ELSE 'multi' END AS columns FROM p",
    "page_extent": f"{_W} SELECT token, page, min(x1) AS x1, max(x2) AS x2, greatest(0.6::DOUBLE, max(x2) - min(x1)) AS width, greatest(1.0::DOUBLE, least(12.8::DOUBLE, min((y2 - y1) * 1024))) AS line_height FROM blocks GROUP BY token, page",
    "x_profile": f"{_W}, e AS (SELECT token, page, CAST(x1 * 1024 AS BIGINT) AS x, CAST((y2 - y1) * 1024 AS BIGINT) AS d FROM blocks UNION ALL SELECT token, page, CAST(x2 * 1024 AS BIGINT), -CAST((y2 - y1) * 1024 AS BIGINT) FROM blocks), s AS (SELECT token, page, x, sum(d) AS d FROM e GROUP BY token, page, x) SELECT token, page, x, CAST(sum(d) OVER (PARTITION BY token, page ORDER BY x) AS BIGINT) AS value FROM s",
    "usual_left": f"{_W}, t AS (SELECT token, page, CAST(x1 * 1024 AS BIGINT) AS x, count(*) AS n FROM blocks GROUP BY ALL), m AS (SELECT * FROM t QUALIFY n = max(n) OVER (PARTITION BY token, page)) SELECT token, page, CAST(floor(avg(x)) AS BIGINT) AS \"left\" FROM m GROUP BY token, page",
    "block_numbers": f"{_W} SELECT token, page, block, CAST(row_number() OVER (PARTITION BY token, page ORDER BY block) - 1 AS INTEGER) AS n, CAST(row_number() OVER (PARTITION BY token, page ORDER BY (x2 - x1) * (y2 - y1) DESC, block) - 1 AS INTEGER) AS by_area FROM blocks",
    "page_neighbours": f"{_W}, z AS (SELECT * FROM blocks QUALIFY row_number() OVER (PARTITION BY token, page ORDER BY block DESC) = 1), f AS (SELECT * FROM blocks QUALIFY row_number() OVER (PARTITION BY token, page ORDER BY block) = 1) SELECT z.token, z.page, z.block AS last_block, f.block AS first_block, CASE WHEN least(z.x2, f.x2) > greatest(z.x1, f.x1) THEN 'cross_page' ELSE 'cross_column' END AS join_type FROM z JOIN f ON z.token = f.token AND f.page = z.page + 1",
    "paragraph_runs": f"{_W}, m AS (SELECT token, page, block, text, {_flows} AND NOT {_head} AS goes_on, {_flows} AND NOT {_tail} AS opens FROM blocks), s AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY token ORDER BY page, block) AS stretch FROM m), j AS (SELECT *, goes_on AND coalesce(bool_or(opens) OVER (PARTITION BY token, stretch ORDER BY page, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS joins FROM s), r AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY token ORDER BY page, block) AS run FROM j) SELECT token, CAST(min(page * 12 + block) // 12 AS INTEGER) AS first_page, CAST(min(page * 12 + block) % 12 AS INTEGER) AS first_block, CAST(count(*) AS INTEGER) AS n_blocks, string_agg(text, ' ' ORDER BY page, block) AS text FROM r GROUP BY token, run",
}
#: The same turns, told by the page.
SQL["box_arrays"] = SQL["bbox_rotate"].replace("block % 4", "page % 4")

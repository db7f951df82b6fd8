"""Queries of image crops: pages are drawn as PNG images, blocks are cut out and turned, with SQL for every pixel's part."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators import tree
from folio.plans.groups import _NODES, _nodes
from folio.sources import png
from folio.sources.batches import tasks

WIDTH, HEIGHT, KINDS = 96, 64, ("figure", "chart", "image", "table")


def _images(pages: DataFrame) -> DataFrame:
    """token, page, content: an image of one to four channels, some interlaced, lines with all filters in turn, whose
    samples follow from their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, x = np.mgrid[:HEIGHT, :WIDTH]
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                content = []
                for token, p in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    d = int(token[4:])
                    sample = (x * 3 + y * 5 + d * 7 + p * 11)[:, :, None] + np.arange((d + p) % 4 + 1) * 13
                    content.append(png.encoded((sample % 256).astype(np.uint8), (0, 1, 2, 3, 4), d % 3 == 0))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(content, pa.binary())], names=["token", "page", "content"])

    # an image costs much more than its row, so the rows' bytes mustn't decide on the tasks
    return pages.select("token", "page").distinct().repartition(tasks(pages.sparkSession), "token", "page").mapInArrow(run, "token string, page int, content binary")


def cropped_images(spark, sf_dir):
    """Size, channels and weighted sum of the samples of each crop, read back from its file."""
    nodes = _nodes(spark, sf_dir).where("token is not null")
    pixel = lambda c, n: F.least(F.lit(n), F.floor(F.col(c) * n).cast("int"))
    crops = tree.crops(nodes, KINDS, {"x1": pixel("x1", WIDTH), "y1": pixel("y1", HEIGHT), "x2": pixel("x2", WIDTH), "y2": pixel("y2", HEIGHT)})
    found = png.crop_images(_images(nodes), crops.withColumn("turn", F.col("page") % 4 * 90))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, channels = [], []
            for content in batch.column(5):
                own = png.whole(content.as_py()).astype(np.int64)
                h, w, n = own.shape
                weight = 1 + np.arange(w)[None, :, None] + 5 * np.arange(h)[:, None, None] + np.arange(n)
                sums.append(int((own * weight).sum()))
                channels.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(channels, pa.int32()), pa.array(sums, pa.int64())], names=["token", "page", "name", "width", "height", "channels", "weighted"])

    return found.where("error is null").select("token", "page", "name", "width", "height", "content").mapInArrow(run, "token string, page int, name string, width int, height int, channels int, weighted long")


QUERIES = {"cropped_images": cropped_images}
_px = lambda c, n: f"least({n}, CAST(floor({c} * {n}) AS INTEGER)) AS {c}"
SQL = {
    "cropped_images": f"""{_NODES}, r AS (SELECT token, page, path, type, {_px('x1', WIDTH)}, {_px('y1', HEIGHT)}, {_px('x2', WIDTH)}, {_px('y2', HEIGHT)} FROM nodes WHERE type IN {KINDS} AND token IS NOT NULL),
c AS (SELECT token, page, format('page{{:03d}}_{{}}_{{:03d}}', page, type, row_number() OVER (PARTITION BY token, page ORDER BY path) - 1) AS name, x1, y1, x2 - x1 AS w, y2 - y1 AS h, CAST(token[5:] AS BIGINT) AS d, page % 4 AS turn FROM r WHERE x2 > x1 AND y2 > y1),
x AS (SELECT *, unnest(range(w)) AS x FROM c), y AS (SELECT *, unnest(range(h)) AS y FROM x), s AS (SELECT *, unnest(range((d + page) % 4 + 1)) AS n FROM y),
v AS (SELECT *, ((x1 + x) * 3 + (y1 + y) * 5 + d * 7 + page * 11 + n * 13) % 256 AS v, CASE turn WHEN 0 THEN x WHEN 1 THEN h - 1 - y WHEN 2 THEN w - 1 - x ELSE y END AS tx, CASE turn WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN h - 1 - y ELSE w - 1 - x END AS ty FROM s)
SELECT token, page, name, any_value(CASE WHEN turn % 2 = 0 THEN w ELSE h END) AS width, any_value(CASE WHEN turn % 2 = 0 THEN h ELSE w END) AS height, CAST(any_value((d + page) % 4 + 1) AS INTEGER) AS channels, CAST(sum(v * (1 + tx + 5 * ty + n)) AS BIGINT) AS weighted FROM v GROUP BY token, page, name""",
}

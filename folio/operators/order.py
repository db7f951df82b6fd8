"""Reading orders of the blocks of a page by recursive cuts.

A page's blocks are gathered into one array (a page holds a bounded number of them), whole batches of pages go to Python
by Arrow, and the places come back as an array.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType

Box = tuple[int, int, int, int]


def _runs(ids: list[int], boxes: list[Box], axis: int, gap: int) -> list[list[int]]:
    """ids in runs along an axis: a run ends where no box reaches within `gap` pixels of the next one's start. Within a
    run, ids are by start, equal ones as given."""
    out: list[list[int]] = []
    reach = 0
    for i in sorted(ids, key=lambda i: boxes[i][axis]):
        if out and boxes[i][axis] - reach < gap:
            out[-1].append(i)
            reach = max(reach, boxes[i][axis + 2])
        else:
            out.append([i])
            reach = boxes[i][axis + 2]
    return out


def xy_cut(boxes: list[Box], line: int = 1, reverse: bool = False) -> list[int]:
    """Indices of integer boxes in reading order: bands from top to bottom, parted by `line` pixels at least, of which
    each that has columns is cut on within each column; a band of one column goes by left edges. Boxes without a width
    or height get a pixel. With `reverse` the page is read upside down and from the end. No box is lost."""
    if reverse:
        return xy_cut([(-x2, -y2, -x1, -y1) for x1, y1, x2, y2 in boxes], line)[::-1]
    boxes = [(a, b, max(c, a + 1), max(d, b + 1)) for a, b, c, d in boxes]
    out: list[int] = []
    todo = [(list(range(len(boxes))), False)]
    while todo:
        part, final = todo.pop()
        if final:
            out.extend(part)
            continue
        later = []
        for band in _runs(part, boxes, 1, line):
            columns = _runs(band, boxes, 0, 1)
            later.extend((c, len(columns) == 1) for c in columns)
        todo.extend(reversed(later))
    return out


def xy_order(blocks: DataFrame, width: int = 1024, height: int = 1024, reverse: bool = False) -> DataFrame:
    """token, page, block, place (from 0): reading order by cuts in whole pixels, with boxes two pixels less high at
    both ends, and bands parted by the page's least line height. Equal places go by block number."""

    @pandas_udf(ArrayType(IntegerType()))
    def places(pages: pd.Series, line: pd.Series) -> pd.Series:
        def one(page, least: float) -> list[int]:
            boxes = []
            for b in page:
                x1, y1, x2, y2 = b["x1"] * width, b["y1"] * height, b["x2"] * width, b["y2"] * height
                less = max(0, min(2, (y2 - y1 - 1) // 2))
                boxes.append((round(x1), round(y1 + less), round(x2), round(y2 - less)))
            rank = [0] * len(boxes)
            for place, i in enumerate(xy_cut(boxes, max(1, int(least)), reverse)):
                rank[i] = place
            return rank

        return pd.Series([one(p, least) for p, least in zip(pages, line)])

    cell = F.struct("block", "x1", "y1", "x2", "y2")
    least = F.least(F.lit(max(height / 80, 10.0)), F.min((F.col("y2") - F.col("y1")) * height))
    page = blocks.groupBy("token", "page").agg(F.array_sort(F.collect_list(cell)).alias("b"), least.alias("line"))
    zipped = F.arrays_zip(F.transform("b", lambda e: e["block"]).alias("block"), F.col("place"))
    return page.withColumn("place", places("b", "line")).select("token", "page", F.explode(zipped).alias("z")).select("token", "page", F.col("z.block").alias("block"), F.col("z.place").alias("place"))

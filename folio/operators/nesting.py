"""Trees from flat pages: blocks are nested by the parents that `folio.operators.layout` finds, and siblings are put in
reading order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators.layout import parents
from folio.operators.reading import ordered

#: What a node that holds others is shown as, where it is its own first child (fixed values).
HOLDERS = {"figure": "figuregroup", "expression": "figuregroup", "chart": "figuregroup", "image": "group"}


def nested(blocks: DataFrame, least: float = 0.9, own_first: bool = False, width: int = 1024, height: int = 1024) -> DataFrame:
    """token, page, block, path, type, subtree of the tree of a page's blocks.

    A block's parent is that of `parents` with `least`. Children are in reading order by cuts; those of anything but a
    group are read upside down and from the end. Roots stay in block order. With `own_first` a node that holds others
    is its own first child too, a row of its own, and the holder gets the type of HOLDERS.
    """
    schema = "array<struct<block:int,path:array<int>,type:string,subtree:int>>"

    def one(page: list, up: dict) -> list[tuple]:
        box = {b["block"]: (b["x1"], b["y1"], b["x2"], b["y2"]) for b in page}
        kind = {b["block"]: b["type"] for b in page}
        below: dict[int, list[int]] = {}
        for b in box:
            below.setdefault(up.get(b, -1), []).append(b)
        rows: list[tuple] = []

        def visit(block: int, path: list[int]) -> int:
            kids = below.get(block, [])
            at, size = len(rows), 1
            rows.append(())
            if kids and own_first:
                rows.append((block, [*path, 0], kind[block], 1))
                size += 1
            if kids:
                order = ordered([box[k] for k in kids], [kind[k] for k in kids], "xy_cut", width, height, reverse=kind[block] != "group", line=1) or range(len(kids))
                for n, k in enumerate(order, int(own_first)):
                    size += visit(kids[k], [*path, n])
            shown = HOLDERS.get(kind[block], kind[block]) if kids and own_first else kind[block]
            rows[at] = (block, path, shown, size)
            return size

        for n, block in enumerate(below.get(-1, [])):
            visit(block, [n])
        return rows

    @F.pandas_udf(schema)
    def run(pages: pd.Series, ups: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("block", "path", "type", "subtree"), r)) for r in one(list(p), {u["block"]: u["parent"] for u in q})] for p, q in zip(pages, ups)])

    found = parents(blocks, least)
    both = blocks.join(found, ["token", "page", "block"])
    page = both.groupBy("token", "page").agg(F.array_sort(F.collect_list(F.struct("block", "x1", "y1", "x2", "y2", "type"))).alias("b"), F.collect_list(F.struct("block", "parent")).alias("u"))
    return page.select("token", "page", F.explode(run("b", "u")).alias("r")).select("token", "page", "r.block", "r.path", "r.type", "r.subtree")

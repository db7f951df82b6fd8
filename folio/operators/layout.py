"""Layout operators on blocks (token, page, block, type, x1, y1, x2, y2, text).

Blocks meet only within their page, by an equal-join on (token, page), and what follows groups by keys that begin with
these, so each operator shuffles its blocks once by page. A page holds a bounded number of blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.geometry import area, intersection, iou
from folio.functions.text import ends_paragraph, starts_paragraph

PAGE = ["token", "page"]
# Nesting levels, page furniture, types whose lines may go on, and renamed types.
LEVELS = {"group": 5, "image": 4, "figuregroup": 3, "figure": 2, "expression": 2, "chart": 2, "moleculegroup": 1}
NOISE = ("hline", "pageheader", "pagefooter", "pagenumber", "pagebar", "watermark")
FLOWING = ("paragraph", "caption", "imagecaption", "figurecaption", "tablecaption", "expressioncaption")
RENAMED = {"table": "image", "tablecaption": "imagecaption", "tablefootnote": "imagefootnote"}
BASE = 0.01


def level(kind: Column) -> Column:
    """Nesting level of a type; 0 can't hold others."""
    out = None
    for name, n in LEVELS.items():
        out = F.when(kind == name, n) if out is None else out.when(kind == name, n)
    return out.otherwise(0)


def side(blocks: DataFrame, p: str, *more: str) -> DataFrame:
    return blocks.select(*PAGE, *[F.col(c).alias(f"{p}{c}") for c in ("block", "x1", "y1", "x2", "y2", *more)])


def page_pairs(blocks: DataFrame, *more: str) -> DataFrame:
    """token, page and all ordered pairs of a page's blocks, as a_ and b_ columns: a page's blocks meet in one array, which
    costs one scan and one shuffle where a join of blocks with themselves costs two."""
    cols = ("block", "x1", "y1", "x2", "y2", *more)
    page = blocks.groupBy(*PAGE).agg(F.collect_list(F.struct(*cols)).alias("all"))
    pairs = page.select(*PAGE, "all", F.explode("all").alias("a")).select(*PAGE, "a", F.explode("all").alias("b"))
    return pairs.select(*PAGE, *[F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in "ab" for c in cols])


def parents(blocks: DataFrame, least: float = 0.95) -> DataFrame:
    """token, page, block, parent: the nearest larger block of a holding type that has `least` of the block's area
    inside; -1 if none does. Ties go to the smaller block number."""
    left, right = side(blocks, "a_", "type"), side(blocks.where(level(F.col("type")) > 0), "b_", "type")
    la, lb = level(F.col("a_type")) * F.lit(BASE), level(F.col("b_type")) * F.lit(BASE)
    holds = (F.col("a_block") != F.col("b_block")) & (area("b_") + lb > area("a_") + la) & (intersection("a_", "b_") / area("a_") >= least)
    apart = F.abs(F.col("b_x1") - F.col("a_x1")) + F.abs(F.col("b_y1") - F.col("a_y1"))
    weight = F.when(holds, F.struct((area("b_") + lb + apart + lb).alias("w"), F.col("b_block").alias("block")))
    best = left.join(right, PAGE, "left").groupBy(*PAGE, F.col("a_block").alias("block")).agg(F.min(weight).alias("best"))
    return best.select(*PAGE, "block", F.coalesce("best.block", F.lit(-1)).alias("parent"))


def best_match(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """token, page, block, match: the right block of the highest IoU above `least`, the first of equals, else -1."""
    score = iou("a_", "b_")
    scored = F.when(score > least, F.struct(score.alias("s"), (-F.col("b_block")).alias("b")))
    best = side(left, "a_").join(side(right, "b_"), PAGE, "left").groupBy(*PAGE, F.col("a_block").alias("block")).agg(F.max(scored).alias("best"))
    return best.select(*PAGE, "block", F.coalesce(-F.col("best.b"), F.lit(-1)).alias("match"))


def all_matches(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """token, page, block, matches: array of all right blocks of an IoU above `least`, ascending."""
    hit = F.when(iou("a_", "b_") > least, F.col("b_block"))
    return side(left, "a_").join(side(right, "b_"), PAGE, "left").groupBy(*PAGE, F.col("a_block").alias("block")).agg(F.array_sort(F.collect_list(hit)).alias("matches"))


def uncovered(blocks: DataFrame, ignored: DataFrame, most: float = 0.9) -> DataFrame:
    """Blocks without an ignored box of an IoU above `most` on their page."""
    a, b = blocks.alias("a"), side(ignored, "b_").alias("b")
    both = F.greatest(F.least("x2", "b_x2") - F.greatest("x1", "b_x1"), F.lit(0.0)) * F.greatest(F.least("y2", "b_y2") - F.greatest("y1", "b_y1"), F.lit(0.0))
    near = both / (area() + area("b_") - both) > most
    return a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.page") == F.col("b.page")) & near, "left_anti")


def clean_types(blocks: DataFrame) -> DataFrame:
    """Without page furniture; tables and what belongs to them count as images."""
    kind = F.col("type")
    for old, new in RENAMED.items():
        kind = F.when(F.col("type") == old, new).otherwise(kind)
    return blocks.where(~F.col("type").isin(*NOISE)).withColumn("type", kind)


def column_types(blocks: DataFrame, height: float = 1024.0) -> DataFrame:
    """token, page, n_items, columns: single, single_1, single_2, single_3 or multi.

    Of each block's height less 3 pixels at both ends, the highest share that another block of its page has in common,
    on average; of its width, the share of the page's extent, at the median.
    """
    top, bottom = (lambda p: F.col(f"{p}y1") * height + 3), (lambda p: F.col(f"{p}y2") * height - 3)
    both = F.greatest(F.least(bottom("a_"), bottom("b_")) - F.greatest(top("a_"), top("b_")), F.lit(0.0))
    share = F.when(F.col("a_block") != F.col("b_block"), both / ((bottom("a_") - top("a_")) + (bottom("b_") - top("b_")) - both))
    rows = page_pairs(blocks).groupBy(*PAGE, "a_block").agg(F.max(share).alias("share"), F.first("a_x1").alias("x1"), F.first("a_x2").alias("x2"))
    page = rows.groupBy(*PAGE).agg(
        F.count(F.lit(1)).alias("n_items"), F.coalesce(F.avg("share"), F.lit(0.0)).alias("y"), F.median(F.col("x2") - F.col("x1")).alias("w"), (F.max("x2") - F.min("x1")).alias("extent")
    )
    n, y, x = F.col("n_items"), F.col("y"), F.col("w") / F.col("extent")
    unit = 2 * n / F.lit(height)
    kind = F.when(n <= 1, "single").when(y < 1e-6, "single_1").when((y < unit) & (x > 0.5), "single_2").when((y < 2 * unit) & (x > 0.5), "single_3").otherwise("multi")
    return page.select(*PAGE, "n_items", kind.alias("columns"))


def page_extent(blocks: DataFrame, height: float = 1024.0) -> DataFrame:
    """token, page, x1, x2, width (0.6 at least), line_height (in pixels; at most an eightieth of the page, at least 1)."""
    line = F.least(F.lit(max(height / 80, 10.0)), F.min((F.col("y2") - F.col("y1")) * height))
    return blocks.groupBy(*PAGE).agg(
        F.min("x1").alias("x1"), F.max("x2").alias("x2"), F.greatest(F.lit(0.6), F.max("x2") - F.min("x1")).alias("width"), F.greatest(F.lit(1.0), line).alias("line_height")
    )


def x_profile(blocks: DataFrame, width: int = 1024, height: int = 1024) -> DataFrame:
    """token, page, x, value: where the sum of the heights of the blocks over a pixel column changes, and its new value."""
    high = ((F.col("y2") - F.col("y1")) * height).cast("long")
    ends = F.explode(F.array(F.struct((F.col("x1") * width).cast("long").alias("x"), high.alias("d")), F.struct((F.col("x2") * width).cast("long").alias("x"), (-high).alias("d")))).alias("e")
    steps = blocks.select(*PAGE, ends).groupBy(*PAGE, F.col("e.x").alias("x")).agg(F.sum("e.d").alias("d"))
    return steps.select(*PAGE, "x", F.sum("d").over(Window.partitionBy(*PAGE).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)).alias("value"))


def usual_left(blocks: DataFrame, width: int = 1024) -> DataFrame:
    """token, page, left: the most frequent left edge in pixels; of several, the whole part of their mean."""
    times = blocks.groupBy(*PAGE, (F.col("x1") * width).cast("long").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    best = times.groupBy(*PAGE).agg(F.collect_list(F.struct("n", "x")).alias("all"), F.max("n").alias("most"))
    xs = F.transform(F.filter("all", lambda e: e["n"] == F.col("most")), lambda e: e["x"])
    return best.select(*PAGE, F.floor(F.aggregate(xs, F.lit(0).cast("long"), lambda a, b: a + b) / F.size(xs)).alias("left"))


def numbered(blocks: DataFrame) -> DataFrame:
    """token, page, block, n: gapless numbers in a page in block order; `by_area`: place in drawing order, largest first."""
    page = Window.partitionBy(*PAGE)
    return blocks.select(*PAGE, "block", (F.row_number().over(page.orderBy("block")) - 1).alias("n"), (F.row_number().over(page.orderBy(area().desc(), "block")) - 1).alias("by_area"))


def page_neighbours(blocks: DataFrame) -> DataFrame:
    """token, page, last_block, first_block, join_type: each page's last block and the next page's first; cross_page if
    their columns overlap, else cross_column."""
    page = blocks.groupBy(*PAGE).agg(F.max(F.struct("block", "x1", "x2")).alias("z"), F.min(F.struct("block", "x1", "x2")).alias("a"))
    by = Window.partitionBy("token").orderBy("page")
    pairs = page.select(*PAGE, "z", F.lead("page").over(by).alias("following"), F.lead("a").over(by).alias("b")).where(F.col("following") == F.col("page") + 1)
    over = F.least("z.x2", "b.x2") - F.greatest("z.x1", "b.x1")
    return pairs.select(*PAGE, F.col("z.block").alias("last_block"), F.col("b.block").alias("first_block"), F.when(over > 0, "cross_page").otherwise("cross_column").alias("join_type"))


def paragraphs(blocks: DataFrame) -> DataFrame:
    """token, first_page, first_block, n_blocks, text: runs of blocks that go on.

    A flowing block that doesn't end a paragraph opens a run; each flowing block after it that begins none joins, until
    one that doesn't. Other blocks stay alone.
    """
    by = Window.partitionBy("token").orderBy("page", "block")
    flows = F.col("type").isin(*FLOWING)
    marked = blocks.select("token", "page", "block", "text", (flows & ~starts_paragraph(F.col("text"))).alias("goes_on"), (flows & ~ends_paragraph(F.col("text"))).alias("opens"))
    # a stretch: a block that doesn't go on, and those after it that do
    stretch = marked.withColumn("stretch", F.sum((~F.col("goes_on")).cast("int")).over(by))
    inside = Window.partitionBy("token", "stretch").orderBy("page", "block").rowsBetween(Window.unboundedPreceding, -1)
    joined = stretch.withColumn("joins", F.col("goes_on") & F.coalesce(F.max("opens").over(inside), F.lit(False)))
    runs = joined.withColumn("run", F.sum((~F.col("joins")).cast("int")).over(by))
    grouped = runs.groupBy("token", "run").agg(F.array_sort(F.collect_list(F.struct("page", "block", "text"))).alias("all"))
    return grouped.select("token", F.col("all")[0]["page"].alias("first_page"), F.col("all")[0]["block"].alias("first_block"), F.size("all").alias("n_blocks"), F.array_join(F.transform("all", lambda e: e["text"]), " ").alias("text"))

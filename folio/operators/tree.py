"""Operators on the nodes of page trees: (token, page, path, type, ...), `path` the array of places among siblings.

Arrays of places sort in pre-order, and a node's ancestors are the beginnings of its path, so trees need neither
recursion nor a join by prefixes: descendants meet an ancestor by an equal-join on (token, page, path).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.geometry import area, iou
from folio.functions.kinds import TEXTUAL

PAGE = ["token", "page"]
#: Kinds of nodes that can be shown as an image (fixed values).
PICTURES = ("chart", "figure", "expression", "figuregroup")


def path_of(path: Column) -> Column:
    """A path written with slashes as an array of places."""
    return F.transform(F.split(path, "/"), lambda p: p.cast("int"))


def parent_of(path: Column) -> Column:
    return F.slice(path, 1, F.size(path) - 1)


def ancestors(nodes: DataFrame, own: bool = False) -> DataFrame:
    """nodes with `above`, the path of an ancestor, a row for each; with `own` the node itself too."""
    most = F.size("path") if own else F.size("path") - 1
    beginnings = F.when(most >= 1, F.transform(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda n: F.slice("path", 1, n))).otherwise(F.array().cast("array<array<int>>"))
    return nodes.withColumn("above", F.explode(beginnings))


def numbered(nodes: DataFrame) -> DataFrame:
    """nodes with `n`: gapless numbers in a page, in pre-order; a group takes one as well."""
    return nodes.withColumn("n", F.row_number().over(Window.partitionBy(*PAGE).orderBy("path")) - 1)


def by_order(nodes: DataFrame, order: str = "ord") -> DataFrame:
    """nodes with `n`: gapless numbers in a page by the stored order among siblings, those without one last, equal ones
    as given; below a node come its children, in the same way."""
    step = F.struct(F.coalesce(F.col(order), F.lit(10**9)).alias("o"), F.element_at("path", -1).alias("p"))
    own = nodes.select(*PAGE, F.col("path").alias("above"), step.alias("step"))
    keys = ancestors(nodes.select(*PAGE, "path"), own=True).join(own, [*PAGE, "above"])
    key = keys.groupBy(*PAGE, "path").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.size("above").alias("d"), "step"))), lambda s: s["step"]).alias("key"))
    return nodes.join(key, [*PAGE, "path"]).withColumn("n", F.row_number().over(Window.partitionBy(*PAGE).orderBy("key")) - 1).drop("key")


def subtree_sizes(nodes: DataFrame) -> DataFrame:
    """token, page, path, size: the node and all below it."""
    return ancestors(nodes.select(*PAGE, "path"), own=True).groupBy(*PAGE, F.col("above").alias("path")).agg(F.count(F.lit(1)).alias("size"))


def collapsed(nodes: DataFrame, groups: Column) -> DataFrame:
    """Without the groups (where `groups` holds) of no node or one: an empty group goes, an only child takes its
    group's path."""
    own = nodes.withColumn("_group", groups)
    small = subtree_sizes(nodes).where("size <= 2").join(own.where("_group").select(*PAGE, "path"), [*PAGE, "path"])
    up = small.select(*PAGE, F.col("path").alias("_up"))
    kept = own.join(small.select(*PAGE, "path"), [*PAGE, "path"], "left_anti").withColumn("_up", parent_of(F.col("path")))
    return kept.join(up.withColumn("_only", F.lit(True)), [*PAGE, "_up"], "left").withColumn("path", F.when(F.col("_only"), F.col("_up")).otherwise(F.col("path"))).select(*nodes.columns)


def contents(nodes: DataFrame, kinds: tuple[str, ...] = TEXTUAL, between: str = " ") -> DataFrame:
    """token, page, path, text, items of each node that has nodes of `kinds` below it or is one: their texts in pre-order."""
    below = ancestors(nodes.where(F.col("type").isin(*kinds)).select(*PAGE, "path", "text"), own=True)
    lists = below.groupBy(*PAGE, "above").agg(F.array_sort(F.collect_list(F.struct("path", "text"))).alias("t"))
    return lists.select(*PAGE, F.col("above").alias("path"), F.array_join(F.transform("t", lambda e: e["text"]), between).alias("text"), F.size("t").alias("items"))


def first_hits(nodes: DataFrame, kinds: tuple[str, ...], skip_roots: bool = False) -> DataFrame:
    """Nodes of `kinds` that have none of them above; with `skip_roots` top nodes don't count."""
    hits = nodes.where(F.col("type").isin(*kinds) & (F.size("path") > int(skip_roots)))
    above = hits.select(*PAGE, F.col("path").alias("above"))
    under = ancestors(hits.select(*PAGE, "path")).join(above, [*PAGE, "above"], "left_semi").select(*PAGE, "path").distinct()
    return hits.join(under, [*PAGE, "path"], "left_anti")


def rendered(nodes: DataFrame, shown: Column, groups: Column) -> DataFrame:
    """token, page, path, text of each group (where `groups` holds) and, with an empty path, of each page: what stands
    below it, joined by blank lines. A group inside shows as its nodes do; one without any as an empty text."""
    own = nodes.select(*PAGE, "path", groups.alias("_group"), shown.alias("_shown"))
    # a group's own text is that of its nodes; only one without a child stands for itself
    held = own.select(*PAGE, parent_of(F.col("path")).alias("path")).distinct()
    leaves = own.where(~F.col("_group")).unionByName(own.where("_group").join(held, [*PAGE, "path"], "left_anti").withColumn("_shown", F.lit("")))
    tops = leaves.withColumn("above", F.array().cast("array<int>"))
    inside = ancestors(leaves).join(own.where("_group").select(*PAGE, F.col("path").alias("above")), [*PAGE, "above"], "left_semi")
    lists = tops.unionByName(inside).groupBy(*PAGE, "above").agg(F.array_sort(F.collect_list(F.struct("path", "_shown"))).alias("t"))
    return lists.select(*PAGE, F.col("above").alias("path"), F.array_join(F.transform("t", lambda e: e["_shown"]), "\n\n").alias("text"))


def assembled(blocks: DataFrame, pos: str = "pos") -> DataFrame:
    """Of blocks with the same (token, page, block) the last one, at the first one's place."""
    same = Window.partitionBy(*PAGE, "block")
    marked = blocks.select("*", F.row_number().over(same.orderBy(F.desc(pos))).alias("_back"), F.min(pos).over(same).alias("_at"))
    return marked.where("_back = 1").withColumn(pos, F.col("_at")).drop("_back", "_at")


def joined_bounds(nodes: DataFrame, width: int = 1024, height: int = 1024, pixels: int = 10) -> DataFrame:
    """token, page, path, x1, y1, x2, y2 of each node with children: their common bounds where these cover the node less
    `pixels` at each side, else its own."""
    kids = nodes.where(F.size("path") > 1).groupBy(*PAGE, parent_of(F.col("path")).alias("path")).agg(*[f(c).alias(f"c_{c}") for f, c in ((F.min, "x1"), (F.min, "y1"), (F.max, "x2"), (F.max, "y2"))])
    both = nodes.join(kids, [*PAGE, "path"])
    dx, dy = F.lit(pixels / width), F.lit(pixels / height)
    covers = (F.col("c_x1") <= F.col("x1") + dx) & (F.col("c_y1") <= F.col("y1") + dy) & (F.col("c_x2") >= F.col("x2") - dx) & (F.col("c_y2") >= F.col("y2") - dy)
    return both.select(*PAGE, "path", *[F.when(covers, F.col(f"c_{c}")).otherwise(F.col(c)).alias(c) for c in ("x1", "y1", "x2", "y2")])


def _children(nodes: DataFrame) -> DataFrame:
    """Groups g_ with their children c_."""
    cols = [c for c in nodes.columns if c not in PAGE]
    kids = nodes.where(F.size("path") > 1).select(*PAGE, *[F.col(c).alias(f"c_{c}") for c in cols]).withColumn("g_path", parent_of(F.col("c_path")))
    return kids.join(nodes.select(*PAGE, *[F.col(c).alias(f"g_{c}") for c in cols]), [*PAGE, "g_path"])


def promoted(nodes: DataFrame, least: float = 0.85) -> DataFrame:
    """token, page, path, picture of groups without an image among their children: the child that is shown as one, which
    is the best of PICTURES if its IoU with the group is above `least`, or the only one that overlaps it."""
    kids = _children(nodes.where(F.col("type").isin("group", "image", *PICTURES)))
    score = F.when(F.col("c_type").isin(*PICTURES), iou("g_", "c_"))
    best = kids.where("g_type = 'group'").groupBy(*PAGE, "g_path").agg(
        F.max((F.col("c_type") == "image").cast("int")).alias("has"), F.max(F.when(score > 0, F.struct(score.alias("s"), (-F.element_at("c_path", -1)).alias("k"), "c_path"))).alias("b"), F.count_if(score > 0).alias("n")
    )
    return best.where("has = 0 and b is not null").where((F.col("b.s") > least) | (F.col("n") == 1)).select(*PAGE, F.col("g_path").alias("path"), F.col("b.c_path").alias("picture"))


def with_legends(nodes: DataFrame) -> DataFrame:
    """token, page, path, legends, x1, y1, x2, y2: the one image of a group (without any, its one figure group), the texts
    of the group's legends, and the bounds of all. Groups without a legend, or with several images, give none."""
    kids = _children(nodes).where(F.col("g_type") == "group")
    of = lambda kind: F.max(F.when(F.col("c_type") == kind, F.struct("c_path", "c_x1", "c_y1", "c_x2", "c_y2")))
    legend = F.col("c_type") == "legend"
    bounds = [F.min(F.when(legend, F.col(f"c_{c}"))).alias(f"l_{c}") for c in ("x1", "y1")] + [F.max(F.when(legend, F.col(f"c_{c}"))).alias(f"l_{c}") for c in ("x2", "y2")]
    per = kids.groupBy(*PAGE, "g_path").agg(
        F.count_if(F.col("c_type") == "image").alias("images"), F.count_if(F.col("c_type") == "figuregroup").alias("groups"), of("image").alias("image"), of("figuregroup").alias("figure"),
        F.array_sort(F.collect_list(F.when(legend, F.struct("c_path", "c_text")))).alias("legends"), *bounds,
    )
    to = F.when(F.col("images") == 1, F.col("image")).when((F.col("images") == 0) & (F.col("groups") == 1), F.col("figure"))
    found = per.withColumn("to", to).where((F.size("legends") > 0) & F.col("to").isNotNull())
    edge = lambda f, c: f(F.col(f"to.c_{c}"), F.col(f"l_{c}")).alias(c)
    return found.select(*PAGE, F.col("to.c_path").alias("path"), F.array_join(F.transform("legends", lambda e: e["c_text"]), "\n").alias("legends"), edge(F.least, "x1"), edge(F.least, "y1"), edge(F.greatest, "x2"), edge(F.greatest, "y2"))


def wrapped(nodes: DataFrame, kinds: tuple[str, ...] = ("chart", "figure", "expression")) -> DataFrame:
    """token, page, image, path: the only node of `kinds` that a top node has below its only image, to be shown as a
    figure group there; top nodes with several images give none."""
    below = ancestors(nodes.select(*PAGE, "path", "type"), own=True).where((F.size("above") == 1) & (F.size("path") > 1))
    images = below.where("type = 'image'").groupBy(*PAGE, "above").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("image")).where("n = 1").select(*PAGE, "image")
    lone = nodes.where(F.size("path") > 1).select(*PAGE, "path", "type", parent_of(F.col("path")).alias("image")).join(images, [*PAGE, "image"])
    one = lone.groupBy(*PAGE, "image").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("type").isin(*kinds), F.col("path"))).alias("path"))
    return one.where("n = 1 and path is not null").select(*PAGE, "image", "path")


def tree_lines(nodes: DataFrame) -> DataFrame:
    """token, page, text: each page's types as an indented tree with lines, a node a line, in pre-order."""
    places = nodes.select(*PAGE, parent_of(F.col("path")).alias("_up"), F.element_at("path", -1).alias("_k")).groupBy(*PAGE, "_up").agg(F.max("_k").alias("_last"))
    ends = ancestors(nodes.select(*PAGE, "path", "type"), own=True).withColumn("_up", parent_of(F.col("above"))).join(places, [*PAGE, "_up"])
    ends = ends.select(*PAGE, "path", "type", F.struct(F.size("above").alias("d"), (F.element_at("above", -1) == F.col("_last")).alias("last")).alias("e"))
    rows = ends.groupBy(*PAGE, "path", "type").agg(F.array_sort(F.collect_list("e")).alias("e"))
    bars = F.array_join(F.transform(F.slice("e", 1, F.size("e") - 1), lambda x: F.when(x["last"], F.lit("    ")).otherwise(F.lit("│   "))), "")
    line = F.concat(bars, F.when(F.element_at("e", -1)["last"], F.lit("└── ")).otherwise(F.lit("├── ")), "type")
    pages = rows.select(*PAGE, F.struct("path", line.alias("t")).alias("t")).groupBy(*PAGE).agg(F.array_sort(F.collect_list("t")).alias("t"))
    return pages.select(*PAGE, F.array_join(F.transform("t", lambda e: e["t"]), "\n").alias("text"))


def crops(nodes: DataFrame, kinds: tuple[str, ...], boxes: dict[str, Column]) -> DataFrame:
    """token, page, name and the pixel box of each node of `kinds` with a box that holds a pixel, named by page, type and
    its number among the page's crops."""
    shown = nodes.where(F.col("type").isin(*kinds)).select(*PAGE, "path", "type", *[c.alias(k) for k, c in boxes.items()]).where("x2 > x1 and y2 > y1")
    nth = F.row_number().over(Window.partitionBy(*PAGE).orderBy("path")) - 1
    return shown.select(*PAGE, F.format_string("page%03d_%s_%03d", F.col("page"), F.col("type"), nth).alias("name"), "x1", "y1", "x2", "y2")


def largest_first(nodes: DataFrame) -> DataFrame:
    """nodes with `layer`: the order in which an overlay draws them, largest first, equal ones in pre-order."""
    return nodes.withColumn("layer", F.row_number().over(Window.partitionBy(*PAGE).orderBy(area().desc(), "path")) - 1)

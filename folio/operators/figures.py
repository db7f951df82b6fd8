"""Figures with captions from ordered pages: groups that qualify and why others don't, captions that go on in the next
column or page, contexts by keyword, and the run's summary.

Nodes are (token, page, path, block, type, text, x1, y1, x2, y2), `path` the array of places among siblings; a group is a
top node, its items its children.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.geometry import soft_iou
from folio.functions.text import ends_paragraph, starts_paragraph
from folio.operators.tree import PAGE, ancestors, contents

# Types whose text describes a figure, types whose text a group is read by, and what a caption goes on with.
CAPTIONS = ("imagecaption", "imagefootnote", "tablecaption", "tablefootnote", "title", "paragraph")
READ = ("documenttitle", "title", "paragraph", "imagecaption", "imagefootnote", "tablecaption", "tablefootnote")
GOES_ON = ("imagecaption", "imagefootnote", "paragraph")
SCHEME = "scheme"
_BOX = ("x1", "y1", "x2", "y2")


def _union(a: Column, b: Column) -> list[Column]:
    return [f(a[c], b[c]).alias(c) for f, c in zip((F.least, F.least, F.greatest, F.greatest), _BOX)]


def _disjoint_union(boxes: Column) -> Column:
    """struct<x1, y1, x2, y2, overlaps>: boxes in order, added up until one overlaps the bounds of those before it."""
    first = F.element_at(boxes, 1)
    start = F.struct(*[first[c].alias(c) for c in _BOX], F.lit(False).alias("overlaps"))

    def add(a: Column, b: Column) -> Column:
        meets = (F.least(a["x2"], b["x2"]) > F.greatest(a["x1"], b["x1"])) & (F.least(a["y2"], b["y2"]) > F.greatest(a["y1"], b["y1"]))
        return F.when(a["overlaps"] | meets, F.struct(*[a[c].alias(c) for c in _BOX], F.lit(True).alias("overlaps"))).otherwise(F.struct(*_union(a, b), F.lit(False).alias("overlaps")))

    return F.aggregate(F.slice(boxes, 2, F.greatest(F.size(boxes) - 1, F.lit(0))), start, add)


def _x_iou(a: Column, b: Column) -> Column:
    """Common width of two boxes over their whole extent, 0 if apart."""
    both = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    return F.when(both > 0, both / (F.greatest(a["x2"], b["x2"]) - F.least(a["x1"], b["x1"]))).otherwise(F.lit(0.0))


def figure_groups(nodes: DataFrame, keyword: Column, is_group: Column, item_page: Column | None = None) -> DataFrame:
    """A row for each top group: token, page, g (its number among the page's groups), keyword, skipped (why it isn't taken,
    null if it is), concat_type, name, key, n_captions, caption.

    keyword: over `captions`, the array of the group's caption texts, null without one. item_page: the page an item comes
    from, where a caption was taken from the next one. The reasons, first one first: no keyword, no image, more than two
    pages or two with several items each, no main image, no caption, images that overlap.
    """
    own = nodes.withColumn("_page", item_page if item_page is not None else F.col("page")).withColumn("_group", is_group)
    top = own.where("_group and size(path) = 1").select(*PAGE, F.col("path").alias("above"))
    below = ancestors(own, own=True).where("size(above) = 1").join(top, [*PAGE, "above"], "left_semi")
    child = F.size("path") == 2
    box = F.struct("path", *_BOX)
    per = below.groupBy(*PAGE, "above").agg(
        F.array_sort(F.collect_list(F.when(child & F.col("type").isin(*CAPTIONS), F.struct("path", "text", *_BOX)))).alias("descs"),
        F.array_sort(F.collect_list(F.when(child & (F.col("type") == "image"), box))).alias("images"),
        F.array_sort(F.collect_list(F.when(child & (F.col("type") == "figuregroup"), box))).alias("figures"),
        F.max(F.col("type").isin("image", "figuregroup")).alias("shows"),
        F.collect_set("_page").alias("pages"),
        F.collect_list(F.when(child, F.col("_page"))).alias("item_pages"),
    )
    fewest = F.array_min(F.transform("pages", lambda p: F.size(F.filter("item_pages", lambda q: q == p))))
    per = per.select(
        "*", F.transform("descs", lambda d: d["text"]).alias("captions"), F.size("pages").alias("n_pages"), fewest.alias("fewest"),
        F.when(F.size("images") > 0, F.col("images")).otherwise(F.col("figures")).alias("mains"), (F.row_number().over(Window.partitionBy(*PAGE).orderBy("above")) - 1).alias("g"),
    )
    per = per.withColumn("keyword", keyword).withColumn("main", F.when(F.size("mains") > 0, _disjoint_union(F.col("mains"))))
    reasons = (
        F.when(F.col("keyword").isNull(), "no keyword").when(~F.col("shows"), "no image").when((F.col("n_pages") > 2) | ((F.col("n_pages") == 2) & (F.col("fewest") > 1)), "pages")
        .when(F.size("mains") == 0, "no main image").when(F.size("descs") == 0, "no caption").when(F.col("main.overlaps"), "overlap")
    )
    described = F.when(F.size("descs") > 0, F.aggregate("descs", F.struct(*[F.element_at("descs", 1)[c].alias(c) for c in _BOX]), lambda a, b: F.struct(*_union(a, b))))
    per = per.withColumn("skipped", reasons).withColumn("_iou", _x_iou(described, F.col("main")))
    kind = F.when(F.col("skipped").isNotNull(), F.lit(None)).when((F.col("n_pages") == 1) & (F.col("_iou") > 0), "single_full").when(F.col("_iou") > 0, "cross_page").otherwise("cross_column")
    name = F.concat(F.format_string("Page.%03d-Group.%02d", F.col("page"), F.col("g")), F.coalesce(F.concat(F.lit("-Cap."), "keyword"), F.lit("")))
    return per.select(*PAGE, "g", "keyword", "skipped", kind.alias("concat_type"), name.alias("name"), F.format_string("%s#%03d#%02d", F.col("token"), F.col("page"), F.col("g")).alias("key"), F.size("captions").alias("n_captions"), F.array_join("captions", " ").alias("caption"))


def contexts(groups: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """token, page, g, n, text of each taken group: the paragraphs of its document that name its keyword, in order.
    paragraphs: token, pos, text, keywords (array)."""
    named = paragraphs.select("token", "pos", F.col("text").alias("p"), F.explode(F.array_distinct("keywords")).alias("keyword"))
    met = groups.where("skipped is null").join(named, ["token", "keyword"], "left")
    lists = met.groupBy("token", "page", "g").agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "p")))).alias("t"))
    return lists.select("token", "page", "g", F.size("t").alias("n"), F.array_join(F.transform("t", lambda e: e["p"]), "\n").alias("text"))


def global_info(groups: DataFrame, keywords: DataFrame) -> DataFrame:
    """token, all_names, kept, ignored, extracted, ratio: the keywords of a document, those of the groups taken and of
    the others, and the part of the figures taken, supplementary ones (with a $) left out; `-` if there are none. The part
    can exceed 1, since all keywords are distinct and taken ones aren't. keywords: token, pos, keyword (distinct)."""
    ordered = lambda when: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("page", "g", "keyword")))), lambda e: e["keyword"]), ", ")
    taken, main = F.col("skipped").isNull(), ~F.col("keyword").contains("$")
    per = groups.where("keyword is not null").groupBy("token").agg(ordered(taken).alias("kept"), ordered(~taken).alias("ignored"), F.count_if(taken).alias("extracted"), F.count_if(taken & main).alias("_kept"))
    every = keywords.groupBy("token").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "keyword"))), lambda e: e["keyword"]), ", ").alias("all_names"), F.count_if(main).alias("_all"))
    part = F.format_string("%.2f%%", F.lit(100.0) * F.coalesce("_kept", F.lit(0)) / F.col("_all"))
    both = every.join(per, "token", "left")
    return both.select("token", "all_names", F.coalesce("kept", F.lit("")).alias("kept"), F.coalesce("ignored", F.lit("")).alias("ignored"), F.coalesce("extracted", F.lit(0)).alias("extracted"), F.when(F.col("_all") > 0, part).otherwise("-").alias("ratio"))


def _tops(nodes: DataFrame, is_group: Column) -> DataFrame:
    """Top nodes with `said`, the text in them, null without any, and `group`."""
    said = contents(nodes, READ).where("size(path) = 1").select(*PAGE, "path", F.nullif(F.col("text"), F.lit("")).alias("said"))
    return nodes.withColumn("group", is_group).where("size(path) = 1").join(said, [*PAGE, "path"], "left").select(*PAGE, "path", "block", "type", "group", "said", *_BOX)


def _goes_on(nearness: Column) -> Column:
    """Whether a group p takes the node q after it as the rest of its caption."""
    unfinished = F.col("p.said").isNull() | ~ends_paragraph(F.col("p.said"))
    begins_none = F.col("q.said").isNull() | ~starts_paragraph(F.col("q.said")) | F.col("p.said").isNull()
    return F.col("p.group") & unfinished & begins_none & nearness & F.col("q.type").isin(*GOES_ON)


def _sided(pairs: DataFrame) -> DataFrame:
    return pairs.select("*", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "pq" for c in ("x1", "x2")])


def next_column(nodes: DataFrame, is_group: Column) -> DataFrame:
    """token, page, block, next_block: groups whose caption goes on in the next node of the page, in another column."""
    row = F.struct("path", "block", "type", "group", "said", *_BOX)
    pairs = _tops(nodes, is_group).select(*PAGE, row.alias("p"), F.lead(row).over(Window.partitionBy(*PAGE).orderBy("path")).alias("q")).where("q is not null")
    return _sided(pairs).where(_goes_on(soft_iou("p_", "q_", "x") <= 0)).select(*PAGE, F.col("p.block").alias("block"), F.col("q.block").alias("next_block"))


def next_page(nodes: DataFrame, is_group: Column) -> DataFrame:
    """token, page, block, next_block, x1, x2: last nodes of pages that are groups whose caption goes on in the next
    page's first node, below each other, and the group's new sides."""
    row = F.struct("path", "block", "type", "group", "said", *_BOX)
    ends = _tops(nodes, is_group).groupBy(*PAGE).agg(F.max(row).alias("p"), F.min(row).alias("q"))
    pairs = ends.select(*PAGE, "p").join(ends.select("token", (F.col("page") - 1).alias("page"), "q"), PAGE)
    found = _sided(pairs).where(_goes_on(soft_iou("p_", "q_", "x") >= 0.5))
    return found.select(*PAGE, F.col("p.block").alias("block"), F.col("q.block").alias("next_block"), F.least("p_x1", "q_x1").alias("x1"), F.greatest("p_x2", "q_x2").alias("x2"))


def stitched(nodes: DataFrame, is_group: Column) -> DataFrame:
    """token, page, path, block, taken, x1, x2: groups whose caption goes on, the nodes that they take one after the other
    (an array of page, path and block), and their sides then.

    A group takes the top node after it as `next_column` and `next_page` tell, and then the one after that: what it has
    taken is part of its text, a node from the next page widens it, and a node on the page of the last one must stand in
    another column, one on the page after that one below it. It ends at a group, at a type that captions don't go on
    with, and where a text ends or begins a paragraph. These ends are told by windows over a document's nodes in order;
    only what follows a group without one is collected, and folded with the group's sides as the state.
    """
    order = ["page", "path"]
    tops = _tops(nodes, is_group).withColumn("_head", F.col("group") | ~F.col("type").isin(*GOES_ON))
    runs = tops.withColumn("_run", F.sum(F.col("_head").cast("int")).over(Window.partitionBy("token").orderBy(*order)))
    of_run = Window.partitionBy("token", "_run").orderBy(*order)
    told = F.last("said", True).over(of_run.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("*", told.alias("_told"), (F.col("page") - F.lag("page").over(of_run)).alias("_step"), F.max("group").over(Window.partitionBy("token", "_run")).alias("_has"))
    unfinished = F.col("_told").isNull() | ~ends_paragraph(F.col("_told"))
    goes_on = F.col("_step").between(0, 1) & unfinished & (F.col("said").isNull() | F.col("_told").isNull() | ~starts_paragraph(F.col("said")))
    cut = F.max((~F.col("_head") & ~goes_on).cast("int")).over(of_run)
    row = F.struct("page", "path", "block", "x1", "x2")
    # a run that no head begins has no group
    lists = runs.where("_has").withColumn("_cut", cut).where("_cut = 0").groupBy("token", "_run").agg(F.array_sort(F.collect_list(row)).alias("r")).where("size(r) > 1")
    first = F.element_at("r", 1)
    state = lambda x1, x2, page, n, open_: F.struct(x1.alias("x1"), x2.alias("x2"), page.alias("page"), n.alias("n"), open_.alias("open"))

    def take(a: Column, q: Column) -> Column:
        near = (F.least(a["x2"], q["x2"]) - F.greatest(a["x1"], q["x1"])) / (F.greatest(a["x2"], q["x2"]) - F.least(a["x1"], q["x1"]) + F.lit(1e-5))
        by_page = q["page"] > a["page"]
        wide = lambda f, c: F.when(by_page, f(a[c], q[c])).otherwise(a[c])
        fits = a["open"] & F.when(by_page, near >= 0.5).otherwise(near <= 0)
        return F.when(fits, state(wide(F.least, "x1"), wide(F.greatest, "x2"), q["page"], a["n"] + 1, F.lit(True))).otherwise(state(a["x1"], a["x2"], a["page"], a["n"], F.lit(False)))

    begin = state(first["x1"], first["x2"], first["page"], F.lit(0), F.lit(True))
    folded = lists.withColumn("s", F.aggregate(F.slice("r", 2, F.size("r") - 1), begin, take)).where("s.n > 0")
    taken = F.transform(F.slice("r", F.lit(2), F.col("s.n")), lambda q: F.struct(q["page"].alias("page"), q["path"].alias("path"), q["block"].alias("block")))
    return folded.select("token", first["page"].alias("page"), first["path"].alias("path"), first["block"].alias("block"), taken.alias("taken"), "s.x1", "s.x2")


def with_stitched(nodes: DataFrame, chains: DataFrame) -> DataFrame:
    """nodes with `item_page`, the page that each comes from, after the `chains` of `stitched`: what a group takes moves,
    with all below it, behind the group's children, and the group has its new sides."""
    top = F.slice("path", 1, 1)
    children = nodes.where(F.size("path") == 2).groupBy(*PAGE, top.alias("path")).agg((F.max(F.element_at("path", 2)) + 1).alias("_n"))
    of = chains.join(children, [*PAGE, "path"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    moves = of.select("token", F.col("page").alias("_to"), F.col("path").alias("_group"), "_n", F.posexplode("taken").alias("_k", "_q"))
    moves = moves.select("token", F.col("_q.page").alias("page"), F.col("_q.path").alias("_top"), "_to", F.concat("_group", F.array(F.col("_n") + F.col("_k"))).alias("_at"))
    sides = chains.select(*PAGE, F.col("path").alias("_top"), F.col("x1").alias("_x1"), F.col("x2").alias("_x2"))
    rows = nodes.withColumn("_top", top).join(moves, [*PAGE, "_top"], "left").join(sides, [*PAGE, "_top"], "left")
    rest = F.when(F.size("path") > 1, F.slice("path", F.lit(2), F.greatest(F.size("path") - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    new = {"path": F.when(F.col("_at").isNotNull(), F.concat("_at", rest)).otherwise(F.col("path")), "page": F.coalesce("_to", "page")}
    new |= {c: F.when(F.size("path") == 1, F.coalesce(f"_{c}", c)).otherwise(F.col(c)) for c in ("x1", "x2")}
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in nodes.columns], F.col("page").alias("item_page"))


def scheme_titles(nodes: DataFrame) -> DataFrame:
    """token, page, block, title_block, x1, y1, x2, y2: images and groups right after a title that begins with `scheme`,
    and the bounds of both."""
    by = Window.partitionBy(*PAGE).orderBy("path")
    before = F.lag(F.struct("block", "type", "text", *_BOX)).over(by)
    pairs = nodes.where("size(path) = 1").select("*", before.alias("t")).where((F.col("t.type") == "title") & F.ltrim(F.lower("t.text")).startswith(SCHEME) & F.col("type").isin("image", "group", "figuregroup"))
    return pairs.select(*PAGE, "block", F.col("t.block").alias("title_block"), *[f(F.col(f"t.{c}"), F.col(c)).alias(c) for f, c in zip((F.least, F.least, F.greatest, F.greatest), _BOX)])


def legend_info(nodes: DataFrame, width: float, height: float) -> DataFrame:
    """token, page, path, legend, box of each figure group: with one legend below it its text and box, in pixels from the
    group's corner, rounded up; with several their texts joined and no box; without any an empty text."""
    parts = nodes.where("type = 'figuregroup'").select(*PAGE, F.col("path").alias("above"), F.col("x1").alias("gx"), F.col("y1").alias("gy"))
    below = ancestors(nodes.where("type = 'legend'")).join(parts, [*PAGE, "above"], "right")
    per = below.groupBy(*PAGE, "above").agg(F.first("gx").alias("gx"), F.first("gy").alias("gy"), F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("path", F.trim("text").alias("text"), *_BOX)))).alias("l"))
    one = F.element_at("l", 1)
    corner = {"x": (F.col("gx"), width), "y": (F.col("gy"), height)}
    box = F.array(*[F.ceil((one[c] - corner[c[0]][0]) * corner[c[0]][1]) for c in _BOX])
    return per.select(*PAGE, F.col("above").alias("path"), F.array_join(F.transform("l", lambda e: e["text"]), " ").alias("legend"), F.when(F.size("l") == 1, box).alias("box"))

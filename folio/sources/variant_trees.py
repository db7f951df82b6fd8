"""Page trees by VARIANT: JSON is parsed once by Spark, and nodes are taken apart level by level by a recursive query.

No row leaves the JVM. A node's fields are read by the kind that it is, and only as what they are in the JSON: a number
where a text is expected is no text. Sizes of subtrees come from one running count over a page's nodes in pre-order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.sources.pages_tree import KINDS, TEXTS

PAGE = ["token", "page"]
#: Levels that a tree has at most: Spark's JSON parser takes 1000 brackets inside each other, a level has two. A document
#: that is deeper isn't parsed, and has an error.
LEVELS = 500
#: Levels that are taken apart at once.
STEP = 8
#: Further fields of a kind that are read as they are (fixed values): name and type.
FIELDS = {
    "textual": {"lang": "string", "font_size": "double"},
    "table": {"html": "string", "structure": "string"},
    "molecule": {"smi": "string", "markush": "boolean", "caption": "string"},
    "chart": {"chart_type": "string"},
    "figure": {"fig_type": "string"},
    "equation": {"inline": "boolean"},
}
_MAP, _LIST = "map<string,variant>", "array<variant>"


def _as(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _is(v: Column, kind: str) -> Column:
    """Whether a leaf is of a JSON type; null or missing ones aren't."""
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def kind_of(node: Column) -> Column:
    """The kind of a node (map of variants) by the first deciding key that is there, null or not; `layout` without one."""
    out = F.when(F.lit(False), "")
    for key, kind in KINDS.items():
        out = out.when(F.map_contains_key(node, key), kind)
    return out.otherwise("layout")


def documents(raw: DataFrame) -> DataFrame:
    """token, pages (array of variants), error of documents (token, raw): the list of pages, alone or in an envelope, or
    why there is none; what Spark can't parse, for its depth too, is no JSON."""
    # behind an explode, so that no filter takes the parsing into itself and does it again
    v = raw.select("token", F.explode(F.array(F.try_parse_json(F.col("raw")))).alias("v"))
    envelope = v.select("token", "v", _as(F.col("v"), _MAP).alias("m"))
    tree = F.when(F.col("m").isNotNull(), F.try_element_at("m", F.lit("pages_tree"))).otherwise(F.col("v"))
    parts = envelope.select("token", "v", "m", tree.alias("t")).withColumn("pages", _as(F.col("t"), _LIST))
    flat = F.forall("pages", lambda p: F.coalesce(_as(p, _LIST).isNotNull() & F.forall(_as(p, _LIST), lambda n: F.coalesce(_as(n, _MAP).isNotNull(), F.lit(False))), F.lit(False)))
    why = F.when(F.col("v").isNull(), "not JSON").when(F.col("m").isNotNull() & ~F.map_contains_key("m", "pages_tree"), "no pages_tree").when(F.col("pages").isNull() | ~flat, "not a list of pages")
    return parts.select("token", F.when(why.isNull(), F.col("pages")).alias("pages"), why.alias("error"))


def _opened() -> str:
    """Of a row (path, node, done): itself, done and without its items, and its children, which aren't. Only a node whose
    first deciding key is `items` has any; other rows are done."""
    others = ", ".join(f"'{k}'" for k in KINDS if k != "items")
    items = f"try_variant_get(try_element_at(node, 'items'), '$', '{_LIST}')"
    children = f"filter(transform({items}, (x, k) -> named_struct('path', concat(path, array(k)), 'node', try_variant_get(x, '$', '{_MAP}'), 'done', false)), c -> c.node IS NOT NULL)"
    bare = "map_concat(map_filter(node, (k, v) -> k != 'items'), map('items', parse_json('null')))"
    return f"""CASE WHEN done OR {items} IS NULL OR arrays_overlap(map_keys(node), array({others})) THEN array(named_struct('path', path, 'node', node, 'done', true))
  ELSE concat(array(named_struct('path', path, 'node', {bare}, 'done', true)), {children}) END"""


def levels(pages: DataFrame) -> DataFrame:
    """token, page, path (array of places), depth, node (map of variants; a group's items are null) of all nodes of the
    `pages` (token, pages).

    STEP levels are taken apart within a task. Only groups below them go on to the recursive query, which shuffles what
    each of its rounds gives, a group with all below it: a round takes STEP levels too.
    """
    spark = pages.sparkSession
    maps = lambda v: F.transform(_as(v, _LIST), lambda n: _as(n, _MAP))
    tops = pages.select("token", F.posexplode("pages").alias("page", "p")).select("token", "page", F.posexplode(maps(F.col("p"))).alias("k", "node"))
    tops = tops.where("node is not null").select("token", "page", F.array("k").alias("path"), "node", F.lit(False).alias("done"))
    for _ in range(STEP):
        tops = tops.selectExpr("token", "page", f"inline({_opened()})")
    step = "t WHERE NOT done"
    for _ in range(STEP):
        step = f"(SELECT token, page, inline({_opened()}) FROM {step})"
    return spark.sql(
        f"""WITH RECURSIVE t(token, page, path, node, done) MAX RECURSION LEVEL {LEVELS} AS (
  SELECT token, page, path, node, done FROM {{tops}} UNION ALL SELECT token, page, path, node, done FROM {step}
) SELECT token, page, path, size(path) - 1 AS depth, node FROM t WHERE done LIMIT ALL""",
        tops=tops,
    )


def box(node: Column) -> list[Column]:
    """x1, y1, x2, y2 of a list of four or an object."""
    b = F.try_element_at(node, F.lit("bbox"))
    of_list, of_map = _as(b, _LIST), _as(b, _MAP)
    number = lambda v: F.when(_is(v, "DOUBLE") | _is(v, "DECIMAL") | _is(v, "BIGINT") | _is(v, "FLOAT"), _as(v, "double"))
    at = lambda k, name: F.when(of_map.isNotNull(), number(F.try_element_at(of_map, F.lit(name)))).when(F.size(of_list) == 4, number(F.get(of_list, k)))
    return [at(k, c).alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))]


def typed(rows: DataFrame) -> DataFrame:
    """Of `levels`' rows: token, page, path, depth, block, type, kind, ord, box, text and `fields`, a struct of those of
    each kind, null where the node is of another."""
    field = lambda k: F.try_element_at("node", F.lit(k))
    whole = lambda k: F.when(_is(field(k), "BIGINT"), _as(field(k), "int"))
    string = lambda k: F.when(_is(field(k), "STRING"), _as(field(k), "string"))
    own = rows.withColumn("kind", kind_of(F.col("node")))
    text = F.when(F.lit(False), "")
    for kind, key in TEXTS.items():
        text = text.when(F.col("kind") == kind, string(key))
    read = {"string": string, "double": lambda k: _as(field(k), "double"), "boolean": lambda k: F.when(_is(field(k), "BOOLEAN"), _as(field(k), "boolean"))}
    of_kind = [F.when(F.col("kind") == kind, F.struct(*[read[t](k).alias(k) for k, t in fields.items()])).alias(kind) for kind, fields in FIELDS.items()]
    return own.select(*PAGE, "path", "depth", whole("block").alias("block"), string("type").alias("type"), "kind", whole("order").alias("ord"), *box(F.col("node")), text.alias("text"), F.struct(*of_kind).alias("fields"))


def sized(nodes: DataFrame) -> DataFrame:
    """nodes with `subtree`, the node and all below it: in pre-order, the nodes that are counted between a node and the
    place where its next sibling would be. Linear in the nodes, however deep."""
    last = F.size("path")
    end = F.concat(F.slice("path", 1, last - 1), F.array(F.element_at("path", -1) + 1))
    row = F.struct(*[c for c in nodes.columns if c not in (*PAGE, "path")])
    both = F.array(F.struct(F.col("path").alias("key"), F.lit(1).alias("node"), row.alias("row")), F.struct(end.alias("key"), F.lit(0).alias("node"), F.lit(None).alias("row")))
    order = Window.partitionBy(*PAGE).orderBy("m.key", "m.node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # an end counts what stands before it, a node itself and what stands before it
    counted = nodes.select(*PAGE, "path", F.explode(both).alias("m")).select(*PAGE, "path", "m.node", "m.row", F.sum("m.node").over(order).alias("c"))
    of_node = counted.groupBy(*PAGE, "path").agg(F.first("row", True).alias("row"), F.sum(F.when(F.col("node") == 1, 1 - F.col("c")).otherwise(F.col("c"))).cast("int").alias("subtree"))
    return of_node.select(*[f"row.{c}" if c not in (*PAGE, "path") else c for c in nodes.columns], "subtree")


def tree_rows(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of documents (token, raw) as `typed` and `sized` have them, and token, error of wrong documents."""
    found = documents(raw)
    return sized(typed(levels(found.where("error is null").select("token", "pages")))), found.where("error is not null").select("token", "error")

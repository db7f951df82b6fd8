"""The page-tree queries: blocks as JSON trees, decoded to nodes, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.sources import variant_trees
from folio.sources.blocks import BLOCKS_SQL, blocks
from folio.sources.pages_tree import nodes


def _leaves(spark, sf_dir) -> DataFrame:
    """token, page, all: each page's blocks as structs of the keys that they have."""
    # a document's pages, and then the document, are put together where its blocks are
    b = blocks(spark, sf_dir).repartition("token")
    only = lambda key, *kinds: F.when(F.col("type").isin(*kinds), F.col("text")).alias(key)
    other = ("equation", "figure", "chart")
    leaf = F.struct("block", "type", only("latex_repr", "equation"), only("desc", "figure"), only("data", "chart"), F.when(~F.col("type").isin(*other), F.col("text")).alias("text"))
    return b.groupBy("token", "page").agg(F.array_sort(F.collect_list(leaf)).alias("all"))


def _documents(pages: DataFrame) -> DataFrame:
    """token, raw of pages (token, page, t: JSON)."""
    lists = pages.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("page", "t"))).alias("p"))
    return lists.select("token", F.concat(F.lit('{"status":"success","pages_tree":['), F.array_join(F.transform("p", lambda e: e["t"]), ","), F.lit("]}")).alias("raw"))


def _trees(spark, sf_dir) -> DataFrame:
    """Each page's first block stands alone; a group holds the others."""
    page = _leaves(spark, sf_dir)
    first, rest = F.to_json(F.col("all")[0]), F.to_json(F.slice("all", 2, F.size("all")))
    return _documents(page.select("token", "page", F.concat(F.lit("["), first, F.lit(',{"block":100,"type":"group","items":'), rest, F.lit("}]")).alias("t")))


def tree_nodes(spark, sf_dir):
    return nodes(_trees(spark, sf_dir)).select("token", "page", "path", F.coalesce("parent", F.lit("")).alias("parent"), "depth", "block", "type", "kind", "subtree", F.coalesce("text", F.lit("")).alias("text"))


def _written(rows: DataFrame) -> DataFrame:
    place = lambda p: F.array_join(F.transform(p, lambda k: k.cast("string")), "/")
    return rows.select("token", "page", place(F.col("path")).alias("path"), place(F.slice("path", 1, F.size("path") - 1)).alias("parent"), "depth", F.coalesce("block", F.lit(-1)).alias("block"), "type", "kind", "subtree", F.coalesce("text", F.lit("")).alias("text"))


def variant_nodes(spark, sf_dir):
    """The same as `tree_nodes`, by VARIANT."""
    return _written(variant_trees.tree_rows(_trees(spark, sf_dir))[0])


def variant_chains(spark, sf_dir):
    """Each block of a page is in a group with the group of the blocks after it."""
    leaf = F.transform("all", lambda e: F.to_json(e))
    chain = F.aggregate(F.reverse(leaf), F.lit(""), lambda inner, e: F.concat(F.lit('{"type":"group","items":['), e, F.when(inner == "", "").otherwise(F.concat(F.lit(","), inner)), F.lit("]}")))
    pages = _leaves(spark, sf_dir).select("token", "page", F.concat(F.lit("["), chain, F.lit("]")).alias("t"))
    return _written(variant_trees.tree_rows(_documents(pages))[0])


QUERIES = {f.__name__: f for f in (tree_nodes, variant_nodes, variant_chains)}
SQL = {
    "tree_nodes": f"""WITH {BLOCKS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY token, page ORDER BY block) - 2 AS k,
  CASE type WHEN 'equation' THEN 'equation' WHEN 'figure' THEN 'figure' WHEN 'chart' THEN 'chart' ELSE 'textual' END AS kind FROM blocks)
SELECT token, page, CASE WHEN k < 0 THEN '0' ELSE '1/' || k END AS path, CASE WHEN k < 0 THEN '' ELSE '1' END AS parent, CASE WHEN k < 0 THEN 0 ELSE 1 END AS depth, block, type, kind, 1 AS subtree, text FROM n
UNION ALL SELECT token, page, '1', '', 0, 100, 'group', 'group', CAST(count(*) AS INTEGER), '' FROM n GROUP BY token, page""",
    "variant_chains": f"""WITH {BLOCKS_SQL}, n AS (SELECT *, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY token, page) AS n, CASE type WHEN 'equation' THEN 'equation' WHEN 'figure' THEN 'figure' WHEN 'chart' THEN 'chart' ELSE 'textual' END AS kind
  FROM blocks WINDOW w AS (PARTITION BY token, page ORDER BY block))
SELECT token, page, '0' || repeat('/1', CAST(k AS INTEGER)) || '/0' AS path, '0' || repeat('/1', CAST(k AS INTEGER)) AS parent, CAST(k + 1 AS INTEGER) AS depth, block, type, kind, 1 AS subtree, text FROM n
UNION ALL SELECT token, page, '0' || repeat('/1', CAST(k AS INTEGER)), CASE WHEN k = 0 THEN '' ELSE '0' || repeat('/1', CAST(k - 1 AS INTEGER)) END, CAST(k AS INTEGER), -1, 'group', 'group', CAST(2 * (n - k) AS INTEGER), '' FROM n""",
}
SQL["variant_nodes"] = SQL["tree_nodes"]

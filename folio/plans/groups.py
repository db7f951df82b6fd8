"""Queries of tree operators, page assembly, rendering of groups and the content list, each with its SQL for DuckDB.

The trees: of a page's blocks the fourth is a group that holds the next three and an image, which holds two more.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import geometry as G
from folio.functions import kinds as K
from folio.functions.render import render
from folio.operators import content, tree
from folio.plans.texts import _render_sql
from folio.sources.blocks import BLOCKS_SQL, blocks

PAGE = tree.PAGE


def _nodes(spark, sf_dir):
    b, k = blocks(spark, sf_dir), F.col("block")
    path = F.when(k <= 2, F.array(k)).when(k == 3, F.array(F.lit(3))).when(k <= 6, F.array(F.lit(3), k - 4)).when(k == 7, F.array(F.lit(3), F.lit(3))).when(k <= 9, F.array(F.lit(3), F.lit(3), k - 8)).otherwise(F.array(k - 6))
    kind = F.when(k == 3, "group").when(k == 7, "image").otherwise(F.col("type"))
    return b.select("token", "page", "block", path.alias("path"), kind.alias("type"), F.when(k % 5 != 1, (k * 5) % 7).alias("ord"), "x1", "y1", "x2", "y2", "text")




def _is_group():
    return F.col("block").isin(3, 7)


def _written(df, *cols):
    """Paths as text."""
    return df.select(*[F.array_join(F.transform(c, lambda p: p.cast("string")), "/").alias(c) if c in ("path", "picture", "image") else F.col(c) for c in cols])


def tree_order(spark, sf_dir):
    n = tree.by_order(tree.numbered(_nodes(spark, sf_dir)).withColumnRenamed("n", "pre"))
    return n.select(*PAGE, "block", "pre", "n")


def subtrees(spark, sf_dir):
    """Of each node the size of its tree, and the text of what says something in it."""
    n = _nodes(spark, sf_dir)
    both = tree.subtree_sizes(n).join(tree.contents(n, ("paragraph", "title", "legend", "imagecaption")), [*PAGE, "path"], "left")
    return _written(both.select(*PAGE, "path", "size", F.coalesce("items", F.lit(0)).alias("items"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash")), *PAGE, "path", "size", "items", "hash")


def first_figures(spark, sf_dir):
    """Nodes that show something and aren't inside another one, and those below the top."""
    n = _nodes(spark, sf_dir)
    kinds = ("image", "figure", "chart", "figuregroup")
    return _written(tree.first_hits(n, kinds).withColumn("top", F.lit(True)).unionByName(tree.first_hits(n, kinds, True).withColumn("top", F.lit(False))), *PAGE, "path", "type", "top")


def collapsed_groups(spark, sf_dir):
    return _written(tree.collapsed(_nodes(spark, sf_dir), _is_group()), *PAGE, "path", "block")


def group_render(spark, sf_dir):
    """Each group and page in Markdown, its length and digest."""
    shown = tree.rendered(_nodes(spark, sf_dir), render("markdown"), _is_group())
    return _written(shown.select(*PAGE, "path", F.length("text").alias("chars"), F.sha2("text", 256).alias("hash")), *PAGE, "path", "chars", "hash")


def page_assembly(spark, sf_dir):
    """Every third block comes again, as a later version."""
    b = blocks(spark, sf_dir).select(*PAGE, "block", F.col("block").alias("pos"), "text")
    more = b.where("block % 3 = 1").select(*PAGE, "block", (F.col("pos") + 100).alias("pos"), F.concat(F.lit("new "), "text").alias("text"))
    return tree.assembled(b.unionByName(more))


def picture_groups(spark, sf_dir):
    return _written(tree.promoted(_nodes(spark, sf_dir), 0.2), *PAGE, "path", "picture")


def legend_groups(spark, sf_dir):
    return _written(tree.with_legends(_nodes(spark, sf_dir)), *PAGE, "path", "legends", "x1", "y1", "x2", "y2")


def wrapped_figures(spark, sf_dir):
    """Every second page's image holds one node, and is the only one."""
    one = _nodes(spark, sf_dir).where("block != 9 or page % 2 = 1")
    return _written(tree.wrapped(one.withColumn("type", F.when((F.col("type") == "image") & (F.col("block") != 7), "paragraph").otherwise(F.col("type")))), *PAGE, "image", "path")


def group_bounds(spark, sf_dir):
    return _written(tree.joined_bounds(_nodes(spark, sf_dir), pixels=300), *PAGE, "path", "x1", "y1", "x2", "y2")


def tree_text(spark, sf_dir):
    return tree.tree_lines(_nodes(spark, sf_dir))


def figure_crops(spark, sf_dir):
    return tree.crops(_nodes(spark, sf_dir), ("figure", "chart", "image", "table"), G.crop_box(600, 800, 1.5))


def overlay_order(spark, sf_dir):
    return tree.largest_first(_nodes(spark, sf_dir)).select(*PAGE, "block", "layer")


def sources(spark, sf_dir):
    """Nodes with image sources: data URLs, bare base64, and what is neither; some share their content."""
    n, k = _nodes(spark, sf_dir), F.col("block")
    body = F.base64(F.encode(F.concat(F.lit("picture number "), (k % 4).cast("string"), F.lit(" of this document, all of it")), "utf-8"))
    png = F.base64(F.concat(F.unhex(F.lit("89504E470D0A1A0A")), F.encode(F.concat("token", F.lit(" "), (F.col("page") % 2).cast("string")), "utf-8")))
    source = F.when(k % 6 == 0, F.concat(F.lit("data:image/png;base64,"), body)).when(k % 6 == 1, body).when(k % 6 == 2, F.lit("c2hvcnQ=")).when(k % 6 == 4, F.concat(F.lit("data:image/x;base64,"), png)).when(k % 6 == 5, F.lit(" "))
    return n.withColumn("source", source).withColumn("descr", F.when(k % 2 == 1, F.concat(F.lit("about "), k.cast("string"))))


def image_files(spark, sf_dir):
    return content.image_files(sources(spark, sf_dir)).select(*PAGE, "block", "name", "n")


def content_list(spark, sf_dir):
    out = content.content_list(sources(spark, sf_dir))
    return out.select("token", "id", "type", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), "img_path", "caption")


def type_lists(spark, sf_dir):
    """What follows from each block's type."""
    t = F.col("type")
    return blocks(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("n")).select("type", "n", K.semantic(t).alias("semantic"), K.partition(t).alias("part"), K.lane(t).alias("lane"), K.sub_figure(F.array(t, F.lit("figure"))).alias("shows"), K.ocr_code(F.lit("French")).alias("ocr"))


QUERIES = {
    f.__name__: f
    for f in (tree_order, subtrees, first_figures, collapsed_groups, group_render, page_assembly, picture_groups, legend_groups, wrapped_figures, group_bounds, tree_text, figure_crops, overlay_order, image_files, content_list, type_lists)
}

_NODES = f"""WITH {BLOCKS_SQL}, nodes AS (SELECT token, page, block, CASE WHEN block <= 2 THEN [block] WHEN block = 3 THEN [3] WHEN block <= 6 THEN [3, block - 4] WHEN block = 7 THEN [3, 3] WHEN block <= 9 THEN [3, 3, block - 8] ELSE [block - 6] END AS path,
  CASE block WHEN 3 THEN 'group' WHEN 7 THEN 'image' ELSE type END AS type, CASE WHEN block % 5 <> 1 THEN (block * 5) % 7 END AS ord, x1, y1, x2, y2, text FROM blocks)"""
_p = "array_to_string({}path, '/') AS path"
_up = "{0}.path[1:len({0}.path) - 1]".format
_same = "{0}.token = {1}.token AND {0}.page = {1}.page".format
_under = "a.path = n.path[1:len(a.path)]"
_hit = "type IN ('image', 'figure', 'chart', 'figuregroup')"
_kids = f", kids AS (SELECT c.*, g.path AS g_path, g.type AS g_type, g.x1 AS g_x1, g.y1 AS g_y1, g.x2 AS g_x2, g.y2 AS g_y2 FROM nodes c JOIN nodes g ON {_same('c', 'g')} AND len(c.path) > 1 AND g.path = {_up('c')})"
_inter = "greatest(least(g_x2, x2) - greatest(g_x1, x1), 0) * greatest(least(g_y2, y2) - greatest(g_y1, y1), 0)"
_iou = f"(({_inter}) / ((g_x2 - g_x1) * (g_y2 - g_y1) + (x2 - x1) * (y2 - y1) - {_inter}))"
_body = "encode('picture number ' || block % 4 || ' of this document, all of it')"
_files = f""", src AS (SELECT *, CASE block % 6 WHEN 0 THEN {_body} WHEN 1 THEN {_body} WHEN 4 THEN unhex('89504E470D0A1A0A') || encode(token || ' ' || page % 2) END AS raw,
  CASE block % 6 WHEN 1 THEN 'jpg' ELSE 'png' END AS ext, block % 6 IN (0, 1, 2, 4) AS has, CASE WHEN block % 2 = 1 THEN 'about ' || block END AS descr FROM nodes),
files AS (SELECT token, page, block, path, sha256(raw) || '.' || first(ext) OVER s AS name, row_number() OVER s AS n FROM src
  WHERE raw IS NOT NULL AND type NOT IN {content.NOT_WRITTEN} WINDOW s AS (PARTITION BY token, sha256(raw) ORDER BY page, path))"""
_list = lambda names: "(" + ", ".join(f"'{x}'" for x in names) + ")"
SQL = {
    "tree_order": f"""{_NODES}, k AS (SELECT n.token, n.page, n.block, n.path, flatten(list([coalesce(a.ord, 1000000000), a.path[-1]] ORDER BY len(a.path))) AS key FROM nodes n JOIN nodes a ON {_same('n', 'a')} AND {_under} GROUP BY n.token, n.page, n.block, n.path)
SELECT token, page, block, row_number() OVER (PARTITION BY token, page ORDER BY path) - 1 AS pre, row_number() OVER (PARTITION BY token, page ORDER BY key) - 1 AS n FROM k""",
    "subtrees": f"""{_NODES}, s AS (SELECT a.token, a.page, a.path, count(*) AS size, count(*) FILTER (n.type IN ('paragraph', 'title', 'legend', 'imagecaption')) AS items,
string_agg(n.text, ' ' ORDER BY n.path) FILTER (n.type IN ('paragraph', 'title', 'legend', 'imagecaption')) AS text FROM nodes n JOIN nodes a ON {_same('n', 'a')} AND {_under} GROUP BY a.token, a.page, a.path)
SELECT token, page, {_p.format('')}, size, items, sha256(coalesce(text, '')) AS hash FROM s""",
    "first_figures": f"""{_NODES}, h AS (SELECT * FROM nodes WHERE {_hit}), t AS (SELECT *, true AS top FROM h UNION ALL SELECT *, false FROM h WHERE len(path) > 1)
SELECT token, page, {_p.format('n.')}, type, top FROM t n WHERE NOT EXISTS (SELECT 1 FROM t a WHERE {_same('a', 'n')} AND a.top = n.top AND len(a.path) < len(n.path) AND {_under})""",
    "collapsed_groups": f"""{_NODES}, s AS (SELECT a.token, a.page, a.path FROM nodes n JOIN nodes a ON {_same('n', 'a')} AND {_under} WHERE a.block IN (3, 7) GROUP BY a.token, a.page, a.path HAVING count(*) <= 2)
SELECT n.token, n.page, array_to_string(CASE WHEN u.path IS NULL THEN n.path ELSE u.path END, '/') AS path, n.block FROM nodes n LEFT JOIN s ON {_same('s', 'n')} AND s.path = n.path LEFT JOIN s u ON {_same('u', 'n')} AND u.path = {_up('n')} WHERE s.path IS NULL""",
    "group_render": f"""{_NODES}, r AS (SELECT *, {_render_sql('markdown')} FROM nodes), l AS (SELECT token, page, path, CASE WHEN block IN (3, 7) THEN '' ELSE markdown END AS t FROM r n
  WHERE block NOT IN (3, 7) OR NOT EXISTS (SELECT 1 FROM nodes c WHERE {_same('c', 'n')} AND len(c.path) > 1 AND {_up('c')} = n.path)),
g AS (SELECT token, page, path FROM nodes WHERE block IN (3, 7) UNION ALL SELECT DISTINCT token, page, CAST([] AS INTEGER[]) FROM nodes),
o AS (SELECT a.token, a.page, a.path, string_agg(n.t, chr(10) || chr(10) ORDER BY n.path) AS text FROM l n JOIN g a ON {_same('n', 'a')} AND len(a.path) < len(n.path) AND (len(a.path) = 0 OR {_under}) GROUP BY a.token, a.page, a.path)
SELECT token, page, {_p.format('')}, length(text) AS chars, sha256(text) AS hash FROM o""",
    "page_assembly": f"WITH {BLOCKS_SQL} SELECT token, page, block, block AS pos, CASE WHEN block % 3 = 1 THEN 'new ' ELSE '' END || text AS text FROM blocks",
    "picture_groups": f"""{_NODES}{_kids}, s AS (SELECT *, {_iou} AS s FROM kids WHERE g_type = 'group'), p AS (SELECT token, page, g_path, bool_or(type = 'image') AS has, count(*) FILTER (s > 0 AND type IN {tree.PICTURES}) AS n,
  max([s, -path[-1]]) FILTER (s > 0 AND type IN {tree.PICTURES}) AS b, arg_max(path, [s, -path[-1]]) FILTER (s > 0 AND type IN {tree.PICTURES}) AS best FROM s GROUP BY token, page, g_path)
SELECT token, page, array_to_string(g_path, '/') AS path, array_to_string(best, '/') AS picture FROM p WHERE NOT has AND n > 0 AND (b[1] > 0.2 OR n = 1)""",
    "legend_groups": f"""{_NODES}{_kids}, g AS (SELECT token, page, g_path, count(*) FILTER (type = 'image') AS images, count(*) FILTER (type = 'figuregroup') AS figures, count(*) FILTER (type = 'legend') AS n,
  string_agg(text, chr(10) ORDER BY path) FILTER (type = 'legend') AS legends, min(x1) FILTER (type = 'legend') AS lx1, min(y1) FILTER (type = 'legend') AS ly1, max(x2) FILTER (type = 'legend') AS lx2, max(y2) FILTER (type = 'legend') AS ly2
  FROM kids WHERE g_type = 'group' GROUP BY token, page, g_path)
SELECT g.token, g.page, {_p.format('k.')}, legends, least(x1, lx1) AS x1, least(y1, ly1) AS y1, greatest(x2, lx2) AS x2, greatest(y2, ly2) AS y2 FROM g JOIN kids k ON {_same('k', 'g')} AND k.g_path = g.g_path
  AND k.type = CASE WHEN images = 1 THEN 'image' WHEN images = 0 AND figures = 1 THEN 'figuregroup' END WHERE n > 0""",
    "wrapped_figures": f"""{_NODES}, own AS (SELECT * REPLACE (CASE WHEN type = 'image' AND block <> 7 THEN 'paragraph' ELSE type END AS type) FROM nodes WHERE block <> 9 OR page % 2 = 1), i AS (SELECT token, page, path[1] AS top, min(path) AS image FROM own WHERE type = 'image' AND len(path) > 1 GROUP BY token, page, path[1] HAVING count(*) = 1),
k AS (SELECT n.token, n.page, i.image, count(*) AS n, min(n.path) FILTER (n.type IN ('chart', 'figure', 'expression')) AS path FROM own n JOIN i ON {_same('i', 'n')} AND i.image = {_up('n')} AND len(n.path) > 1 GROUP BY n.token, n.page, i.image)
SELECT token, page, array_to_string(image, '/') AS image, {_p.format('')} FROM k WHERE n = 1 AND path IS NOT NULL""",
    "group_bounds": f"""{_NODES}{_kids}, c AS (SELECT token, page, g_path AS path, any_value(g_x1) AS gx1, any_value(g_y1) AS gy1, any_value(g_x2) AS gx2, any_value(g_y2) AS gy2, min(x1) AS a, min(y1) AS b, max(x2) AS c, max(y2) AS d FROM kids GROUP BY token, page, g_path),
o AS (SELECT *, a <= gx1 + 300 / 1024.0::DOUBLE AND b <= gy1 + 300 / 1024.0::DOUBLE AND c >= gx2 - 300 / 1024.0::DOUBLE AND d >= gy2 - 300 / 1024.0::DOUBLE AS ok FROM c)
SELECT token, page, {_p.format('')}, CASE WHEN ok THEN a ELSE gx1 END AS x1, CASE WHEN ok THEN b ELSE gy1 END AS y1, CASE WHEN ok THEN c ELSE gx2 END AS x2, CASE WHEN ok THEN d ELSE gy2 END AS y2 FROM o""",
    "tree_text": f"""{_NODES}, e AS (SELECT n.token, n.page, n.path, n.type, a.path AS above, NOT EXISTS (SELECT 1 FROM nodes s WHERE {_same('s', 'a')} AND len(s.path) = len(a.path) AND {_up('s')} = {_up('a')} AND s.path[-1] > a.path[-1]) AS last
  FROM nodes n JOIN nodes a ON {_same('n', 'a')} AND {_under}),
l AS (SELECT token, page, path, coalesce(string_agg(CASE WHEN len(above) < len(path) THEN CASE WHEN last THEN '    ' ELSE '│   ' END ELSE CASE WHEN last THEN '└── ' ELSE '├── ' END END, '' ORDER BY len(above)), '') || any_value(type) AS t FROM e GROUP BY token, page, path)
SELECT token, page, string_agg(t, chr(10) ORDER BY path) AS text FROM l GROUP BY token, page""",
    "figure_crops": f"""{_NODES}, c AS (SELECT token, page, path, type, CAST(trunc(x1 * 600.0 * 1.5) AS INTEGER) AS x1, CAST(trunc(y1 * 800.0 * 1.5) AS INTEGER) AS y1, CAST(trunc(x2 * 600.0 * 1.5) AS INTEGER) AS x2, CAST(trunc(y2 * 800.0 * 1.5) AS INTEGER) AS y2 FROM nodes WHERE type IN ('figure', 'chart', 'image', 'table'))
SELECT token, page, format('page{{:03d}}_{{}}_{{:03d}}', page, type, row_number() OVER (PARTITION BY token, page ORDER BY path) - 1) AS name, x1, y1, x2, y2 FROM c WHERE x2 > x1 AND y2 > y1""",
    "overlay_order": f"{_NODES} SELECT token, page, block, row_number() OVER (PARTITION BY token, page ORDER BY (x2 - x1) * (y2 - y1) DESC, path) - 1 AS layer FROM nodes",
    "image_files": f"{_NODES}{_files} SELECT token, page, block, name, n FROM files",
    "content_list": f"""{_NODES}{_files}, kids AS (SELECT p.token, p.page, p.path, min([c.path[-1], c.block]) FILTER (c.has) AS child, string_agg(trim(c.text), chr(10) ORDER BY c.path) FILTER (c.type IN {K.QA_CAPTIONS} AND trim(c.text) <> '') AS captions
  FROM src p JOIN src c ON {_same('c', 'p')} AND len(c.path) > 1 AND p.path = {_up('c')} GROUP BY p.token, p.page, p.path),
o AS (SELECT s.*, k.captions, CASE WHEN s.type IN {K.QA_IMAGES} THEN CASE WHEN s.has THEN s.block ELSE k.child[2] END END AS f, CASE WHEN k.child[2] % 2 = 1 THEN 'about ' || k.child[2] END AS cd, trim(s.text) AS t FROM src s LEFT JOIN kids k ON {_same('k', 's')} AND k.path = s.path
  WHERE s.type NOT IN {_list(K.QA_SKIPPED + K.QA_CAPTIONS)}),
j AS (SELECT o.*, i.name, CASE WHEN i.name IS NOT NULL THEN row_number() OVER (PARTITION BY o.token, i.name ORDER BY o.page, o.path) END AS nth FROM o LEFT JOIN files i ON {_same('i', 'o')} AND i.block = o.f),
q AS (SELECT *, CASE WHEN type = 'equation' THEN CASE WHEN t <> '' OR has THEN 'equation' END WHEN name IS NOT NULL THEN 'image' WHEN type IN ('figuregroup', 'imagegroup') THEN NULL WHEN type = 'table' AND t <> '' THEN 'table' WHEN t <> '' THEN 'text' END AS out FROM j WHERE nth IS NULL OR nth = 1)
SELECT token, row_number() OVER (PARTITION BY token ORDER BY page, path) - 1 AS id, out AS type, sha256(CASE WHEN out = 'image' THEN '' ELSE t END) AS hash, CASE WHEN out = 'image' THEN 'vqa_images/' || name END AS img_path,
  CASE WHEN out = 'image' THEN coalesce(captions, descr, cd, '') END AS caption FROM q WHERE out IS NOT NULL""",
    "type_lists": f"""WITH {BLOCKS_SQL} SELECT type, count(*) AS n, CASE WHEN type IN {K.TEXTUAL} THEN 'textual' WHEN type IN ('image', 'figure') THEN 'figure' WHEN type IN {_list(K.IGNORED + K.FUNCTIONAL)} THEN 'ignore' WHEN type IN ('equation', 'equationinline') THEN 'equation' ELSE type END AS semantic,
CASE {' '.join(f"WHEN type IN {kinds} THEN '{name}'" for name, kinds in K.PARTITIONS.items())} END AS part, CASE WHEN type IN {K.MARGIN} THEN 'margin' WHEN type IN {K.TOP} THEN 'top' ELSE 'bottom' END AS lane,
CASE WHEN type = 'expression' THEN 'chemical reaction' WHEN type IN ('chart', 'table', 'molecule') THEN type ELSE 'figure' END AS shows, 'fr' AS ocr FROM blocks GROUP BY type""",
}

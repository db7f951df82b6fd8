"""Queries of figure groups and captions, each with its SQL for DuckDB. Trees are those of `folio.plans.groups`."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import figures
from folio.operators.tree import PAGE
from folio.plans.groups import _NODES, _is_group, _nodes, _same, _under
from folio.plans.groups import _kids as _kids_sql
from folio.sources.blocks import CONTAINERS

UPPER, MARKS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ".!?:;"


def _keyword():
    """A keyword for groups with a caption, a supplementary one for every fifth page."""
    return F.when(F.size("captions") > 0, F.concat(F.when(F.col("page") % 5 == 4, F.lit("Fig$")).otherwise(F.lit("Fig")), (F.length(F.element_at("captions", 1)) % 4).cast("string")))


def _groups(spark, sf_dir):
    """Every second page takes its last group item from the next page."""
    moved = F.when((F.col("page") % 2 == 1) & F.col("block").isin(6, 9), F.col("page") + 1).otherwise(F.col("page"))
    return figures.figure_groups(_nodes(spark, sf_dir), _keyword(), _is_group(), moved)


def figure_groups(spark, sf_dir):
    return _groups(spark, sf_dir)


def _paragraphs(spark, sf_dir):
    p = _nodes(spark, sf_dir).where("type = 'paragraph'")
    return p.select("token", (F.col("page") * 12 + F.col("block")).alias("pos"), "text", F.array(F.concat(F.lit("Fig"), (F.col("block") % 4).cast("string")), F.lit("Fig$1")).alias("keywords"))


def figure_contexts(spark, sf_dir):
    out = figures.contexts(_groups(spark, sf_dir), _paragraphs(spark, sf_dir))
    return out.select(*PAGE, "g", "n", F.sha2("text", 256).alias("hash"))


def figure_info(spark, sf_dir):
    """The summary of each document."""
    names = _paragraphs(spark, sf_dir).select("token", "pos", F.explode("keywords").alias("keyword")).groupBy("token", "keyword").agg(F.min("pos").alias("pos"))
    return figures.global_info(_groups(spark, sf_dir), names)


def _any_group():
    return F.col("type").isin(*CONTAINERS)


def caption_columns(spark, sf_dir):
    return figures.next_column(_nodes(spark, sf_dir), _any_group())


def _flowing(spark, sf_dir):
    """Pages that end with their group, in the column in which the next one begins; two of three pages are in small
    letters without closing marks, so that captions go on over them."""
    small = F.rtrim(F.translate("text", UPPER, UPPER.lower()), F.lit(MARKS))
    return _nodes(spark, sf_dir).where(~F.col("block").isin(0, 10, 11)).withColumn("text", F.when(F.col("page") % 3 < 2, small).otherwise(F.col("text")))


def caption_pages(spark, sf_dir):
    return figures.next_page(_flowing(spark, sf_dir), _any_group())


def stitched_captions(spark, sf_dir):
    """Groups with what they take over columns and pages, page/block each."""
    taken = F.array_join(F.transform("taken", lambda q: F.concat_ws("/", q["page"].cast("string"), q["block"].cast("string"))), ",")
    return figures.stitched(_flowing(spark, sf_dir), _any_group()).select(*PAGE, "block", F.size("taken").alias("n"), taken.alias("taken"), "x1", "x2")


def stitched_nodes(spark, sf_dir):
    """All nodes after groups have taken theirs."""
    nodes = _flowing(spark, sf_dir)
    moved = figures.with_stitched(nodes, figures.stitched(nodes, _any_group()))
    return moved.select(*PAGE, F.array_join(F.transform("path", lambda p: p.cast("string")), "/").alias("path"), "block", "item_page", "x1", "x2")


def scheme_titles(spark, sf_dir):
    """Every title is a scheme's."""
    n = _nodes(spark, sf_dir)
    return figures.scheme_titles(n.withColumn("text", F.when(F.col("type") == "title", F.concat(F.lit(" Scheme "), "text")).otherwise(F.col("text"))))


def legend_boxes(spark, sf_dir):
    """Groups and images count as figure groups here, so that some hold legends."""
    n = _nodes(spark, sf_dir)
    out = figures.legend_info(n.withColumn("type", F.when(_is_group(), "figuregroup").otherwise(F.col("type"))), 512, 256)
    return out.select(*PAGE, F.array_join(F.transform("path", lambda p: p.cast("string")), "/").alias("path"), "legend", F.array_join(F.transform("box", lambda c: c.cast("string")), ",").alias("box"))


QUERIES = {f.__name__: f for f in (figure_groups, figure_contexts, figure_info, caption_columns, caption_pages, stitched_captions, stitched_nodes, scheme_titles, legend_boxes)}

_list = lambda names: "(" + ", ".join(f"'{x}'" for x in names) + ")"
_tail = f"""regexp_matches(trim(regexp_replace({{0}}, '{T.CLOSED}', ''), ' ' || chr(10) || chr(13) || chr(9)), '{T.TAIL}')"""
_head = f"""regexp_matches(ltrim(regexp_replace(regexp_replace(regexp_replace({{0}}, '{T.OPENED}', ''), '{T.CLOSING}', ''), '{T.NUMBERED}', ''), ' ' || chr(10) || chr(13) || chr(9)), '{T.HEAD}')"""
_starts, _ends = (lambda c: _head.replace("{0}", c)), (lambda c: _tail.replace("{0}", c))
_main = "(CASE WHEN len(images) > 0 THEN images ELSE figures END)"
_box = "{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'o': false}"
_add = "{'x1': least(a.x1, b.x1), 'y1': least(a.y1, b.y1), 'x2': greatest(a.x2, b.x2), 'y2': greatest(a.y2, b.y2), 'o': a.o OR (least(a.x2, b.x2) > greatest(a.x1, b.x1) AND least(a.y2, b.y2) > greatest(a.y1, b.y1))}"
_GROUPS = f"""{_NODES}, moved AS (SELECT *, CASE WHEN page % 2 = 1 AND block IN (6, 9) THEN page + 1 ELSE page END AS own FROM nodes),
b AS (SELECT n.*, g.block AS gb FROM moved n JOIN nodes g ON {_same('n', 'g')} AND g.block = 3 AND n.path[1] = 3),
pg AS (SELECT token, page, own, count(*) FILTER (len(path) = 2) AS n FROM b GROUP BY token, page, own), pf AS (SELECT token, page, count(*) AS n_pages, min(n) AS fewest FROM pg GROUP BY token, page),
f AS (SELECT token, page, list(text ORDER BY path) FILTER (len(path) = 2 AND type IN {figures.CAPTIONS}) AS captions, list({_box} ORDER BY path) FILTER (len(path) = 2 AND type IN {figures.CAPTIONS}) AS descs,
  coalesce(list({_box} ORDER BY path) FILTER (len(path) = 2 AND type = 'image'), []) AS images, list({_box} ORDER BY path) FILTER (len(path) = 2 AND type = 'figuregroup') AS figures, bool_or(type IN ('image', 'figuregroup')) AS shows FROM b GROUP BY token, page),
k AS (SELECT f.*, n_pages, fewest, CASE WHEN len(captions) > 0 THEN CASE WHEN f.page % 5 = 4 THEN 'Fig$' ELSE 'Fig' END || length(captions[1]) % 4 END AS keyword,
  CASE WHEN len({_main}) > 0 THEN list_reduce({_main}, lambda a, b: {_add}) END AS main, CASE WHEN len(descs) > 0 THEN list_reduce(descs, lambda a, b: {_add}) END AS d FROM f JOIN pf USING (token, page)),
q AS (SELECT *, CASE WHEN keyword IS NULL THEN 'no keyword' WHEN NOT shows THEN 'no image' WHEN n_pages > 2 OR (n_pages = 2 AND fewest > 1) THEN 'pages' WHEN main IS NULL THEN 'no main image' WHEN d IS NULL THEN 'no caption' WHEN main.o THEN 'overlap' END AS skipped,
  least(d.x2, main.x2) - greatest(d.x1, main.x1) > 0 AS over FROM k),
groups AS (SELECT token, page, 0 AS g, keyword, skipped, CASE WHEN skipped IS NULL THEN CASE WHEN n_pages = 1 AND over THEN 'single_full' WHEN over THEN 'cross_page' ELSE 'cross_column' END END AS concat_type,
  format('Page.{{:03d}}-Group.{{:02d}}', page, 0) || coalesce('-Cap.' || keyword, '') AS name, format('{{}}#{{:03d}}#{{:02d}}', token, page, 0) AS key, CAST(coalesce(len(captions), 0) AS INTEGER) AS n_captions, coalesce(array_to_string(captions, ' '), '') AS caption FROM q)"""
_PARAS = ", paras AS (SELECT token, page * 12 + block AS pos, text, unnest(['Fig' || block % 4, 'Fig$1']) AS keyword FROM nodes WHERE type = 'paragraph')"
_FLOWING = f"""{_NODES.replace("nodes AS", "raw_nodes AS")}, nodes AS (SELECT * REPLACE (CASE WHEN page % 3 < 2 THEN rtrim(translate(text, '{UPPER}', '{UPPER.lower()}'), '{MARKS}') ELSE text END AS text) FROM raw_nodes WHERE block NOT IN (0, 10, 11))"""
_TOPS = f""", says AS (SELECT a.token, a.page, a.path, nullif(string_agg(n.text, ' ' ORDER BY n.path), '') AS said FROM nodes n JOIN nodes a ON {_same('n', 'a')} AND len(a.path) = 1 AND {_under} WHERE n.type IN {figures.READ} GROUP BY a.token, a.page, a.path),
tops AS (SELECT n.*, n.type IN {_list(CONTAINERS)} AS grp, s.said FROM nodes n LEFT JOIN says s ON {_same('n', 's')} AND s.path = n.path WHERE len(n.path) = 1)"""
_goes = f"p.grp AND (p.said IS NULL OR NOT {_ends('p.said')}) AND (q.said IS NULL OR p.said IS NULL OR NOT {_starts('q.said')}) AND q.type IN {figures.GOES_ON}"
_near = "(least(p.x2, q.x2) - greatest(p.x1, q.x1)) / (greatest(p.x2, q.x2) - least(p.x1, q.x1) + 0.00001::DOUBLE)"
#: From each group on, one node a step, by recursion.
_CHAINS = f"""{_FLOWING.replace("WITH", "WITH RECURSIVE", 1)}{_TOPS}, o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY token ORDER BY page, path) AS r FROM tops),
p AS (SELECT token, page, path, block, r, said, x1, x2, page AS at, 0 AS n, '' AS taken, true AS grp FROM o WHERE grp
  UNION ALL SELECT p.token, p.page, p.path, p.block, q.r, coalesce(q.said, p.said), CASE WHEN q.page > p.at THEN least(p.x1, q.x1) ELSE p.x1 END, CASE WHEN q.page > p.at THEN greatest(p.x2, q.x2) ELSE p.x2 END, q.page, p.n + 1, p.taken || ',' || q.page || '/' || q.block, true
  FROM p JOIN o q ON q.token = p.token AND q.r = p.r + 1 WHERE NOT q.grp AND q.page - p.at IN (0, 1) AND {_goes} AND CASE WHEN q.page = p.at THEN {_near} <= 0 ELSE {_near} >= 0.5 END),
chains AS (SELECT token, page, path, block, max(n) AS n, max_by(taken, n) AS taken, max_by(x1, n) AS x1, max_by(x2, n) AS x2 FROM p GROUP BY token, page, path, block HAVING max(n) > 0)"""
SQL = {
    "figure_groups": f"{_GROUPS} SELECT * FROM groups",
    "figure_contexts": f"""{_GROUPS}{_PARAS} SELECT g.token, g.page, g.g, CAST(count(p.pos) AS INTEGER) AS n, sha256(coalesce(string_agg(p.text, chr(10) ORDER BY p.pos), '')) AS hash FROM groups g LEFT JOIN paras p ON p.token = g.token AND p.keyword = g.keyword WHERE g.skipped IS NULL GROUP BY g.token, g.page, g.g""",
    "figure_info": f"""{_GROUPS}{_PARAS}, names AS (SELECT token, keyword, min(pos) AS pos FROM paras GROUP BY token, keyword),
e AS (SELECT token, string_agg(keyword, ', ' ORDER BY pos, keyword) AS all_names, count(*) FILTER (NOT contains(keyword, '$')) AS n FROM names GROUP BY token),
r AS (SELECT token, string_agg(keyword, ', ' ORDER BY page, g) FILTER (skipped IS NULL) AS kept, string_agg(keyword, ', ' ORDER BY page, g) FILTER (skipped IS NOT NULL) AS ignored, count(*) FILTER (skipped IS NULL) AS extracted,
  count(*) FILTER (skipped IS NULL AND NOT contains(keyword, '$')) AS k FROM groups WHERE keyword IS NOT NULL GROUP BY token)
SELECT e.token, all_names, coalesce(kept, '') AS kept, coalesce(ignored, '') AS ignored, coalesce(extracted, 0) AS extracted, CASE WHEN n > 0 THEN printf('%.2f%%', 100.0::DOUBLE * coalesce(k, 0) / n) ELSE '-' END AS ratio FROM e LEFT JOIN r USING (token)""",
    "caption_columns": f"""{_NODES}{_TOPS}, o AS (SELECT *, row_number() OVER (PARTITION BY token, page ORDER BY path) AS r FROM tops)
SELECT p.token, p.page, p.block, q.block AS next_block FROM o p JOIN o q ON {_same('p', 'q')} AND q.r = p.r + 1 WHERE {_goes} AND {_near} <= 0""",
    "stitched_captions": f"""{_CHAINS} SELECT token, page, block, n, taken[2:] AS taken, x1, x2 FROM chains""",
    "stitched_nodes": f"""{_CHAINS}, k AS (SELECT token, page, path[1] AS top, max(path[2]) + 1 AS n FROM nodes WHERE len(path) = 2 GROUP BY token, page, path[1]),
m AS (SELECT c.token, c.page AS to_page, c.path || [coalesce(k.n, 0) + i] AS at, CAST(split_part(split_part(c.taken[2:], ',', i + 1), '/', 1) AS INTEGER) AS page, CAST(split_part(split_part(c.taken[2:], ',', i + 1), '/', 2) AS INTEGER) AS block
  FROM (SELECT *, unnest(range(n)) AS i FROM chains) c LEFT JOIN k ON k.token = c.token AND k.page = c.page AND k.top = c.path[1])
SELECT n.token, coalesce(m.to_page, n.page) AS page, array_to_string(CASE WHEN m.at IS NULL THEN n.path ELSE m.at || n.path[2:] END, '/') AS path, n.block, n.page AS item_page, CASE WHEN len(n.path) = 1 THEN coalesce(c.x1, n.x1) ELSE n.x1 END AS x1, CASE WHEN len(n.path) = 1 THEN coalesce(c.x2, n.x2) ELSE n.x2 END AS x2
FROM nodes n JOIN nodes t ON n.token = t.token AND n.page = t.page AND len(t.path) = 1 AND t.path[1] = n.path[1] LEFT JOIN m ON m.token = n.token AND m.page = n.page AND m.block = t.block LEFT JOIN chains c ON c.token = n.token AND c.page = n.page AND c.block = t.block""",
    "caption_pages": f"""{_FLOWING}{_TOPS}, o AS (SELECT *, row_number() OVER (PARTITION BY token, page ORDER BY path) AS r, row_number() OVER (PARTITION BY token, page ORDER BY path DESC) AS z FROM tops)
SELECT p.token, p.page, p.block, q.block AS next_block, least(p.x1, q.x1) AS x1, greatest(p.x2, q.x2) AS x2 FROM o p JOIN o q ON p.token = q.token AND q.page = p.page + 1 AND p.z = 1 AND q.r = 1 WHERE {_goes} AND {_near} >= 0.5""",
    "scheme_titles": f"""{_NODES}, o AS (SELECT *, lag(block) OVER w AS tb, lag(type) OVER w AS tt, lag(x1) OVER w AS a, lag(y1) OVER w AS b, lag(x2) OVER w AS c, lag(y2) OVER w AS d FROM nodes WHERE len(path) = 1 WINDOW w AS (PARTITION BY token, page ORDER BY path))
SELECT token, page, block, tb AS title_block, least(a, x1) AS x1, least(b, y1) AS y1, greatest(c, x2) AS x2, greatest(d, y2) AS y2 FROM o WHERE tt = 'title' AND type IN ('image', 'group', 'figuregroup')""",
    "legend_boxes": f"""{_NODES}, g AS (SELECT * FROM nodes WHERE type = 'figuregroup' OR block IN (3, 7)), l AS (SELECT a.token, a.page, a.path, a.x1 AS gx, a.y1 AS gy, n.* EXCLUDE (token, page, path), n.path AS lp FROM g a LEFT JOIN nodes n ON {_same('a', 'n')} AND n.type = 'legend' AND n.block NOT IN (3, 7) AND len(a.path) < len(n.path) AND {_under})
SELECT token, page, array_to_string(path, '/') AS path, coalesce(string_agg(trim(text), ' ' ORDER BY lp), '') AS legend,
CASE WHEN count(block) = 1 THEN any_value(concat_ws(',', CAST(ceil((x1 - gx) * 512) AS BIGINT), CAST(ceil((y1 - gy) * 256) AS BIGINT), CAST(ceil((x2 - gx) * 512) AS BIGINT), CAST(ceil((y2 - gy) * 256) AS BIGINT))) END AS box FROM l GROUP BY token, page, path""",
}

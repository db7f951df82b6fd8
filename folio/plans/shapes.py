"""Queries of box arithmetic, units, crops, small string functions and whole documents, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.functions import geometry as G
from folio.functions import kinds as K
from folio.functions import render as R
from folio.functions import text as T
from folio.functions.render import MARKS, render
from folio.plans.texts import _render_sql
from folio.sources.blocks import BLOCKS_SQL, blocks

PAGE = ["token", "page"]
SECRET = "folio-secret"


def _named(columns, prefix):
    return [c.alias(f"{prefix}_{k}") for k, c in columns.items()]


def bbox_moves(spark, sf_dir):
    """Each box scaled, shifted, and in whole pixels."""
    b = blocks(spark, sf_dir).select(*PAGE, "block", *[(F.col(c) * 100).alias(c) for c in G.CORNERS])
    return b.select(*PAGE, "block", *_named(G.scaled(2.0, 0.5), "scaled"), *_named(G.shifted(-16.0, 8.0), "shifted"), *[c for how in ("round", "int", "ceil", "floor") for c in _named(G.whole(how), how)])


def _next(spark, sf_dir):
    """Each block a_ with the next one b_ of its page."""
    by = Window.partitionBy(*PAGE).orderBy("block")
    b = blocks(spark, sf_dir)
    return b.select(*PAGE, "block", *[F.col(c).alias(f"a_{c}") for c in G.CORNERS], *[F.lead(c).over(by).alias(f"b_{c}") for c in G.CORNERS]).where("b_x1 is not null")


def box_pairs(spark, sf_dir):
    """Neighbouring boxes: guarded overlaps, distances of corners, lengths in common, and the second as seen from the first."""
    a = F.col("a_x1"), F.col("a_y1"), F.col("b_x1"), F.col("b_y1")
    return _next(spark, sf_dir).select(
        *PAGE, "block", G.guarded_iou("a_", "b_").alias("iou"), G.guarded_iof("a_", "b_").alias("iof"), G.overlap_length("a_", "b_", "x").alias("over_x"), G.overlap_length("a_", "b_", "y").alias("over_y"),
        G.soft_iou("a_", "b_", "x").alias("soft_x"), G.distance(*a).alias("euclid"), G.distance(*a, "manhattan").alias("manhattan"), *_named(G.sub_box("a_", "b_", F.lit(512), F.lit(256)), "sub"),
    )


def page_units(spark, sf_dir):
    """Every second box is in pixels; all in parts of the page and in pixels."""
    times = F.when(F.col("block") % 2 == 0, F.lit(1024.0)).otherwise(F.lit(1.0))
    b = blocks(spark, sf_dir).select(*PAGE, "block", *[(F.col(c) * times).alias(c) for c in G.CORNERS])
    size = F.lit(1024.0), F.lit(1024.0)
    return b.select(*PAGE, "block", *_named(G.relative(*size), "rel"), *_named(G.absolute(*size), "abs"))


def clamped_boxes(spark, sf_dir):
    """Boxes moved half out of an image."""
    b = blocks(spark, sf_dir).select(*PAGE, "block", *[(F.col(c) * 1024 - 300).alias(c) for c in G.CORNERS])
    return b.select(*PAGE, "block", *_named(G.clamped(400, 300), "in"))


def lanes_and_bars(spark, sf_dir):
    """Page bars that count as content (P12), rules above or below all content (P11), and resolution limits."""
    b = blocks(spark, sf_dir)
    content = ~F.col("type").isin("pageheader", "pagenumber", "title")
    page = Window.partitionBy(*PAGE)
    top, bottom = F.min(F.when(content, F.col("y1"))).over(page), F.max(F.when(content, F.col("y2"))).over(page)
    outside = (F.col("type") == "title") & ((F.col("y2") < top) | (F.col("y1") > bottom))
    return b.select(*PAGE, "block", F.coalesce(outside, F.lit(False)).alias("outside"), (~((F.col("x2") < 0.25) | (F.col("x1") > 0.75))).alias("bar_in_main"), T.dpi_for(300, F.col("x2") * 2000, F.col("y2") * 3000).alias("dpi"))


def quoted_texts(spark, sf_dir):
    """URLs quoted for LaTeX, redacted in JSON, and signed."""
    u = F.col("url")
    odd = F.concat(u, F.lit("/a b/~x*+é?k=1&v=[2]"))
    raw = F.concat(F.lit('{"a":["'), u, F.lit('?key=1&b=2"],"b":{"c":"see '), u, F.lit('/x?y=z now"}}'))
    body = F.encode(raw, "utf-8")
    sign = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("sha256="), T.hmac_sha256(SECRET, body))).otherwise(F.lit("sha256=0"))
    given = lambda k: F.when((F.col("page_id") % 5).isin(k, 4), u)
    asked = T.resolved_input(given(0), F.concat(given(1), F.lit(".PNG")), given(2))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.quote_path(odd).alias("quoted"), T.redact_json(raw).alias("redacted"), T.hmac_sha256(SECRET, body).alias("mac"), T.signed(sign, SECRET, body).alias("ok"), asked["kind"].alias("kind"), asked["error"].alias("error"))


def image_references(spark, sf_dir):
    k, u = F.col("page_id") % 4, F.col("url")
    s = F.when(k == 0, u).when(k == 1, T.base64(F.encode(u, "utf-8"))).when(k == 2, F.concat(F.lit("img/"), F.md5(u), F.lit(" 1.png"))).otherwise(F.lit(" "))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", *[T.image_reference(F.lit("figure"), s, f).alias(f) for f in ("markdown", "latex", "html")])


def wrapped_documents(spark, sf_dir):
    """Each document's blocks in each format, wrapped: length and digest, and the options' modes."""
    out = blocks(spark, sf_dir).select("token", F.struct("page", "block", *[render(f).alias(f) for f in ("plain", "markdown", "latex", "html")]).alias("b")).groupBy("token").agg(F.array_sort(F.collect_list("b")).alias("b"))
    whole = lambda f: T.wrap_document(F.array_join(F.transform("b", lambda e: e[f]), "\n\n"), f)
    n = F.size("b") % 3
    alias = F.when(n == 0, "digital").when(n == 1, "ocr-fast")
    return out.select("token", *[F.sha2(whole(f), 256).alias(f) for f in ("plain", "markdown", "latex", "html")], T.parse_mode("textual", alias).alias("textual"), T.parse_mode("chart", alias).alias("chart"), T.mode_alias(T.parse_mode("textual", alias)).alias("alias"))


def _shown_blocks(spark, sf_dir):
    """Every fifth block an algorithm, every seventh without a text but with a source."""
    b, k = blocks(spark, sf_dir), F.col("page") * 12 + F.col("block")
    return b.select(*PAGE, "block", F.when(k % 5 == 3, "algorithm").otherwise(F.col("type")).alias("type"), F.when(k % 7 == 2, F.lit("")).otherwise(F.concat("text", F.lit("\n"))).alias("text"), F.when(k % 2 == 0, F.lit("img/a 1.png")).otherwise(F.lit("")).alias("source"))


def formatted_blocks(spark, sf_dir):
    """Each block as part of a document in all formats, and in markup."""
    b = _shown_blocks(spark, sf_dir)
    return b.select(*PAGE, "block", R.render_all("markup").alias("markup"), *[R.format_as(f, F.col("source")).alias(f) for f in ("plain", "markdown", "latex", "html")])


def configured_blocks(spark, sf_dir):
    """Texts in Markdown, figures in HTML as links, charts in Markdown with their data; no page furniture."""
    b = _shown_blocks(spark, sf_dir)
    return b.select(*PAGE, "block", R.format_by({"textual": "markdown", "figure": "html", "chart": "markdown"}, {"figure": "link", "chart": "base64"}, F.col("source"), marginalia=False).alias("shown"))


QUERIES = {f.__name__: f for f in (formatted_blocks, configured_blocks, bbox_moves, box_pairs, page_units, clamped_boxes, lanes_and_bars, quoted_texts, image_references, wrapped_documents)}

_W = f"WITH {BLOCKS_SQL}"
_each = lambda f: ", ".join(f(c) for c in G.CORNERS)
_inter = "greatest(least(a_x2, b_x2) - greatest(a_x1, b_x1), 0) * greatest(least(a_y2, b_y2) - greatest(a_y1, b_y1), 0)"
_areas = "(a_x2 - a_x1) * (a_y2 - a_y1)", "(b_x2 - b_x1) * (b_y2 - b_y1)"
_quote = lambda c: f"replace(replace({c}, '*', '%2A'), '!', '%21')"
_pad = lambda n: bytes(b ^ n for b in SECRET.encode().ljust(64, b"\0")).hex()
_mac = f"sha256(unhex('{_pad(0x5C)}') || unhex(sha256(unhex('{_pad(0x36)}') || encode(raw))))"
_quoted = "url_encode(s)"
for _c in T.KEPT:
    _quoted = f"replace({_quoted}, '%{ord(_c):02X}', '{_c}')"
_given = lambda c: f"({c} IS NOT NULL)"
_b64, _path = f"regexp_matches(s, '{T.BASE64}')", f"regexp_matches(s, '{T.PATH}')"


def _wrap_sql(form: str) -> str:
    head, tail, _ = T.WRAPPED[form]
    text = lambda s: "'" + s.replace("\n", "' || chr(10) || '") + "'" if s else "''"
    return f"sha256({text(head + chr(10) if head else '')} || string_agg({form}, chr(10) || chr(10) ORDER BY page, block) || {text(tail + chr(10) if tail else '')}) AS {form}"


def _modes_sql(field: str) -> str:
    known = " ".join(f"WHEN '{a}' THEN '{m}'" for a, m in T.MODES.items() if field == "textual" or a != "digital")
    return f"CASE coalesce(alias, '{T.PAPER[field]}') {known} END"


_SHOWN = f"""{_W}, s AS (SELECT token, page, block, CASE WHEN (page * 12 + block) % 5 = 3 THEN 'algorithm' ELSE type END AS type, CASE WHEN (page * 12 + block) % 7 = 2 THEN '' ELSE text || chr(10) END AS text, CASE WHEN (page * 12 + block) % 2 = 0 THEN 'img/a 1.png' ELSE '' END AS source FROM blocks),
r AS (SELECT *, {', '.join(map(_render_sql, ('plain', 'markdown', 'latex', 'html')))}, text = '' AND source <> '' AS e FROM s)"""
_bare = "rtrim(text, chr(10))"
_code = {
    "markdown": f"'```' || chr(10) || {_bare} || chr(10) || '```'",
    "latex": f"'\\begin{{verbatim}}' || chr(10) || {_bare} || chr(10) || '\\end{{verbatim}}'",
    "html": "'<pre class=\"algorithm\"><code>' || replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') || '</code></pre>'",
    "plain": "plain",
}
_image = {"markdown": "'![' || type || '](<' || source || '>)'", "latex": "'\\includegraphics[width=0.5\\textwidth]{img/a%201.png}'", "html": "'<img src=''' || source || ''' alt=''' || type || '''/>'", "plain": "''"}
_whole = lambda f: f"CASE WHEN type = 'algorithm' THEN {_code[f]} ELSE {f} END"


def _format_sql(f: str) -> str:
    end = {"markdown": "chr(10)", "latex": "chr(10)", "html": "'<br>'", "plain": "''"}[f]
    return f"CASE WHEN type IN {('section', *MARKS)} THEN '' ELSE {_whole(f)} || CASE WHEN e THEN {_image[f]} ELSE '' END || {end} END AS {f}"


SQL = {
    "formatted_blocks": f"""{_SHOWN} SELECT token, page, block, CASE WHEN type IN {MARKS} THEN '<' || type || '>' WHEN type IN ('text', 'paragraph') THEN text ELSE '\\begin{{' || type || '}}' || chr(10) || text || chr(10) || '\\end{{' || type || '}}' END AS markup, {', '.join(map(_format_sql, ('plain', 'markdown', 'latex', 'html')))} FROM r""",
    "configured_blocks": f"""{_SHOWN} SELECT token, page, block, CASE WHEN type IN {K.MARGINALIA} OR type IN {('section', *MARKS)} THEN '' WHEN type = 'figure' THEN html || CASE WHEN e THEN '<img src=''' || source || ''' alt=''figure''/>' ELSE '' END || '<br>'
  WHEN type = 'chart' THEN markdown || CASE WHEN e THEN '![chart](data:image/png;base64,' || source || ')' ELSE '' END WHEN type IN {K.TEXTUAL} THEN {_whole('markdown')} ELSE '' END AS shown FROM r""",
    "bbox_moves": f"""{_W}, p AS (SELECT token, page, block, {_each(lambda c: f"{c} * 100 AS {c}")} FROM blocks) SELECT token, page, block, {_each(lambda c: f"{c} * {2.0 if c[0] == 'x' else 0.5}::DOUBLE AS scaled_{c}")}, {_each(lambda c: f"{c} + {-16.0 if c[0] == 'x' else 8.0}::DOUBLE AS shifted_{c}")},
{_each(lambda c: f"CAST(round_even({c}, 0) AS BIGINT) AS round_{c}")}, {_each(lambda c: f"CAST(trunc({c}) AS BIGINT) AS int_{c}")}, {_each(lambda c: f"CAST(ceil({c}) AS BIGINT) AS ceil_{c}")}, {_each(lambda c: f"CAST(floor({c}) AS BIGINT) AS floor_{c}")} FROM p""",
    "box_pairs": f"""{_W}, n AS (SELECT token, page, block, {_each(lambda c: f"{c} AS a_{c}")}, {_each(lambda c: f"lead({c}) OVER (PARTITION BY token, page ORDER BY block) AS b_{c}")} FROM blocks)
SELECT token, page, block, {_inter} / greatest({_areas[0]} + {_areas[1]} - {_inter}, 1e-6) AS iou, {_inter} / greatest({_areas[1]}, 1e-6) AS iof, least(a_x2, b_x2) - greatest(a_x1, b_x1) AS over_x, least(a_y2, b_y2) - greatest(a_y1, b_y1) AS over_y,
(least(a_x2, b_x2) - greatest(a_x1, b_x1)) / (greatest(a_x2, b_x2) - least(a_x1, b_x1) + 1e-5) AS soft_x, sqrt((a_x1 - b_x1) * (a_x1 - b_x1) + (a_y1 - b_y1) * (a_y1 - b_y1)) AS euclid, abs(a_x1 - b_x1) + abs(a_y1 - b_y1) AS manhattan,
{_each(lambda c: f"CAST(ceil((b_{c} - a_{c[0]}1) * {512 if c[0] == 'x' else 256}) AS BIGINT) AS sub_{c}")} FROM n WHERE b_x1 IS NOT NULL""",
    "page_units": f"""{_W} SELECT token, page, block, {_each(lambda c: f"{c} AS rel_{c}")}, {_each(lambda c: f"{c} * 1024 AS abs_{c}")} FROM blocks""",
    "clamped_boxes": f"""{_W}, p AS (SELECT token, page, block, {_each(lambda c: f"{c} * 1024 - 300 AS {c}")} FROM blocks), l AS (SELECT *, greatest(0, least(x1, 399)) AS l, greatest(0, least(y1, 299)) AS t FROM p)
SELECT token, page, block, CAST(trunc(l) AS INTEGER) AS in_x1, CAST(trunc(greatest(l + 1, least(x2, 400))) AS INTEGER) AS in_x2, CAST(trunc(t) AS INTEGER) AS in_y1, CAST(trunc(greatest(t + 1, least(y2, 300))) AS INTEGER) AS in_y2 FROM l""",
    "lanes_and_bars": f"""{_W}, w AS (SELECT *, min(y1) FILTER (type NOT IN ('pageheader', 'pagenumber', 'title')) OVER p AS top, max(y2) FILTER (type NOT IN ('pageheader', 'pagenumber', 'title')) OVER p AS bottom FROM blocks WINDOW p AS (PARTITION BY token, page))
SELECT token, page, block, coalesce(type = 'title' AND (y2 < top OR y1 > bottom), false) AS outside, NOT (x2 < 0.25 OR x1 > 0.75) AS bar_in_main, CAST(least(300, greatest(1, floor(294912 / greatest(x2 * 2000, y2 * 3000)))) AS INTEGER) AS dpi FROM w""",
    "quoted_texts": f"""WITH r AS (SELECT page_id, url, '{{"a":["' || url || '?key=1&b=2"],"b":{{"c":"see ' || url || '/x?y=z now"}}}}' AS raw, CASE WHEN page_id % 5 IN (0, 4) THEN url END AS f, CASE WHEN page_id % 5 IN (1, 4) THEN url || '.PNG' END AS i, CASE WHEN page_id % 5 IN (2, 4) THEN url END AS u FROM pages),
e AS (SELECT *, CASE WHEN {_given('f')}::INT + {_given('i')}::INT + {_given('u')}::INT <> 1 THEN 'exactly one of file, image and url' WHEN u IS NOT NULL AND NOT regexp_matches(u, '^https?://') THEN 'url must start with http:// or https://' END AS error FROM r)
SELECT page_id, replace(url, '#', '%23') || '/a%20b/~x%2A%2B%C3%A9?k=1&v=%5B2%5D' AS quoted, regexp_replace(raw, '{T.JSON_QUERY}', '\\1?<redacted>', 'g') AS redacted, {_mac} AS mac, page_id % 2 = 0 AS ok, CASE WHEN error IS NOT NULL THEN NULL WHEN u IS NOT NULL THEN 'url' WHEN i IS NOT NULL THEN 'image' ELSE 'file' END AS kind, error FROM e""",
    "image_references": f"""WITH s AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN base64(encode(url)) WHEN 2 THEN 'img/' || md5(url) || ' 1.png' ELSE ' ' END AS s FROM pages), k AS (SELECT *, CASE WHEN trim(s) = '' THEN '' WHEN {_b64} THEN 'b' WHEN {_path} THEN 'p' ELSE '' END AS k FROM s)
SELECT page_id, CASE k WHEN 'b' THEN '![figure](data:image/png;base64,' || s || ')' WHEN 'p' THEN '![figure](<' || s || '>)' ELSE '' END AS markdown, CASE k WHEN 'b' THEN '\\includegraphics[width=0.5\\textwidth]{{}}' WHEN 'p' THEN '\\includegraphics[width=0.5\\textwidth]{{' || {_quoted} || '}}' ELSE '' END AS latex,
CASE k WHEN 'b' THEN '<img src=''data:image/png;base64,' || s || ''' alt=''figure''/>' WHEN 'p' THEN '<img src=''' || s || ''' alt=''figure''/>' ELSE '' END AS html FROM k""",
    "wrapped_documents": f"""{_W}, r AS (SELECT token, page, block, {', '.join(map(_render_sql, ('plain', 'markdown', 'latex', 'html')))} FROM blocks), d AS (SELECT token, CASE count(*) % 3 WHEN 0 THEN 'digital' WHEN 1 THEN 'ocr-fast' END AS alias, {', '.join(map(_wrap_sql, ('plain', 'markdown', 'latex', 'html')))} FROM r GROUP BY token)
SELECT token, plain, markdown, latex, html, {_modes_sql('textual')} AS textual, {_modes_sql('chart')} AS chart, coalesce(alias, 'ocr-hq') AS alias FROM d""",
}

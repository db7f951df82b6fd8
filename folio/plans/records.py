"""Queries of small operators on documents, molecules, jobs and images, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions.render import block_text, molecule_text
from folio.operators import records as O
from folio.plans import texts
from folio.sources import tables
from folio.sources.blocks import BLOCKS_SQL, blocks
from folio.streaming import jobs

PAGE = ["token", "page"]


def doi_blocks(spark, sf_dir):
    """Every fourth block is a DOI line, every fourth has one among its lines, every fourth one inside."""
    b, k, t = blocks(spark, sf_dir), F.col("block") % 4, F.col("text")
    text = F.when(k == 0, F.concat(F.lit("DOI:10.1/a "), t)).when(k == 1, F.concat(F.lit("F IGU R E https://doi.org/10.5/x doi:10.2/b, "), t)).when(k == 2, F.concat(t, F.lit(" doi:10.3/c"))).otherwise(t)
    lines = F.when(k == 2, F.array(t, F.lit("doi:10.3/c"))).otherwise(F.array().cast("array<string>"))
    return O.without_dois(b.select(*PAGE, "block", text.alias("text"), lines.alias("lines")), "lines").select(*PAGE, "block", "text", F.size("lines").alias("n_lines"))


def molecule_names(spark, sf_dir):
    """Blocks in groups of four: a molecule, its id, another molecule, text."""
    b, k = blocks(spark, sf_dir), F.col("block") % 4
    kids = b.select(*PAGE, F.array(F.floor(F.col("block") / 4).cast("int"), k.cast("int")).alias("path"), F.when(k == 1, "moleculeid").when(k == 3, "text").otherwise("molecule").alias("type"), F.concat("text", F.when(F.col("page") % 3 == 2, F.lit("<sep>x")).otherwise(F.lit(" "))).alias("text"), F.when(k == 0, F.concat(F.lit("C<sep>"), "text")).when(F.col("block") < 8, F.concat(F.lit(" N"), F.length("text").cast("string"))).alias("smi"), F.col("text").alias("caption"))
    tops = b.select(*PAGE, F.array(F.floor(F.col("block") / 4).cast("int")).alias("path")).distinct().withColumns({"type": F.lit("moleculegroup"), "text": F.lit(None).cast("string"), "smi": F.lit(None).cast("string"), "caption": F.lit(None).cast("string")})
    out = O.molecules(kids.unionByName(tops))
    return out.select(*PAGE, F.array_join(F.transform("path", lambda p: p.cast("string")), "/").alias("path"), "smiles", "caption", "name")


def image_paths(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    asked = p.select("page_id", F.concat(F.lit("img/"), (F.col("page_id") % 20).cast("string"), F.lit(".png")).alias("rel"))
    index = p.where("page_id < 10").select(F.concat(F.col("page_id").cast("string"), F.lit(".png")).alias("name"), F.concat(F.lit("/store/"), F.col("page_id").cast("string")).alias("path"))
    return O.image_paths(asked, index, "/base/")


def progress_counters(spark, sf_dir):
    """Pages begun and done: those of later documents less those of the first ones."""
    b = blocks(spark, sf_dir).groupBy("token").agg(F.countDistinct("page").alias("total_page"), F.countDistinct(F.when(F.col("block") > 3, F.col("page"))).alias("proc_page"), F.count(F.lit(1)).alias("total_block"), F.count_if(F.col("type") == "paragraph").alias("proc_block"))
    return O.progress(b, ("page", "block"), F.when(F.length("token") < 6, -1).otherwise(1))


def keyword_bookkeeping(spark, sf_dir):
    """Of each document's types those that weren't taken once for each page."""
    b = blocks(spark, sf_dir)
    tried = b.select("token", F.col("type").alias("keyword"))
    return O.bookkeeping(b.select("token", "page", F.col("type").alias("keyword")).distinct(), tried).groupBy("token", "keyword").agg(F.count(F.lit(1)).alias("n"))


def unknown_types(spark, sf_dir):
    page = blocks(spark, sf_dir).groupBy(*PAGE).agg(F.collect_list("type").alias("t"))
    return page.select(*PAGE, F.array_join(O.unexplained(F.col("t"), ("group", "equation", "table", "paragraph", "pageheader")), ",").alias("types"))


def success_records(spark, sf_dir):
    """Each document's record; every third has a stem."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name = F.col("doc_id").cast("string")
    out = O.success_records(d.select(name.alias("token"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("s"), name)).alias("stem"), F.concat(F.lit("/out/"), name).alias("output_dir"), F.col("text").alias("content")), 100)
    return out


def retained_events(spark, sf_dir):
    """Events of the last day and of the last 14 before each user's last one."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts")
    last = e.groupBy("user_id").agg(F.max("ts").alias("now"))
    both = e.join(last, "user_id")
    day, longer = jobs.retained(both, "ts", "now"), jobs.retained(both, "ts", "now", 14 * 24)
    count = lambda df, name: df.groupBy("user_id").agg(F.count(F.lit(1)).alias(name))
    return count(day, "day").join(count(longer, "fortnight"), "user_id")


def patient_outcomes(spark, sf_dir):
    """Outcomes where `undefined` never ends a job, as the agent polls."""
    names = F.create_map(*[F.lit(x) for x in ("signup", "undefined", "view", "waiting", "click", "undefined", "purchase", "success", "error", "error")])
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", names[F.col("event_type")].alias("state"))
    return jobs.outcomes(e, "user_id", ["ts", "event_id"], None)


def resolved_files(spark, sf_dir):
    """Inputs of URLs, of paths that are there or not, and empty ones."""
    p, k = spark.read.parquet(f"{sf_dir}/pages.parquet"), F.col("page_id")
    name = F.concat(F.lit("in/"), (k % 40).cast("string"), F.when(k % 2 == 0, ".PDF").otherwise(".png"))
    asked = p.select("page_id", F.when(k % 7 == 0, F.col("url")).when(k % 7 == 1, "  ").otherwise(F.concat(F.lit(" "), name)).alias("input"))
    files = p.where("page_id < 30").select(name.alias("path")).distinct()
    return O.resolved_files(asked, files)


def job_errors(spark, sf_dir):
    """The error of each user's job that didn't succeed."""
    found = texts.job_outcomes(spark, sf_dir)
    return O.error_records(found.select(F.col("user_id").cast("string").alias("token"), "outcome", "checks"))


def block_texts(spark, sf_dir):
    """Blocks as equations, tables, molecules and texts, some with inline spans or blank ones."""
    b, t, k = blocks(spark, sf_dir), F.col("text"), F.col("block")
    part = lambda m, yes: F.when(k % m == 0, yes)
    kind = F.when(k % 4 == 0, " Equation").when(k % 4 == 1, "table").when(k % 4 == 2, "molecule").otherwise("paragraph")
    text = block_text(kind, F.when(k % 8 == 0, F.concat(F.lit(" $"), t, F.lit("$ "))).when(k % 4 == 0, t), part(3, F.concat(F.lit("|"), t, F.lit("|"))), part(5, F.concat(F.lit(" in "), t)), [part(2, F.lit("")), part(7, F.lit(" ")), molecule_text(k > 6, part(2, F.lit("CCO")), t)], F.concat(F.lit(" "), t))
    return b.select(*PAGE, "block", text.alias("says"))


def upgraded_tables(spark, sf_dir):
    """Tables as HTML, as structures without placeholders, and with placeholders but without types."""
    word = F.regexp_replace("text", "[^a-z ]", "")
    html = F.concat(F.lit("<table><tr><td>"), word, F.lit(" $x_1$</td><td><b>R&amp;D "), word, F.lit("</b>***C***</td></tr></table>"))
    k, none = F.col("block") % 3, F.array().cast("array<string>")
    raw = blocks(spark, sf_dir).select(*PAGE, "block", F.when(k == 0, html).alias("html"), F.lit("old").alias("text"), F.when(k == 1, html).when(k == 2, "<table>[[A]]</table>").alias("structure"), F.when(k == 2, F.array(F.lit("[[A]]"))).alias("placeholders"), F.when(k == 2, F.array("text")).alias("contents"), none.alias("types"))
    listed = lambda c: F.array_join(c, "|").alias(c)
    return tables.upgraded(raw).select(*PAGE, "block", "structure", listed("placeholders"), listed("contents"), listed("types"))


QUERIES = {f.__name__: f for f in (resolved_files, job_errors, block_texts, upgraded_tables, doi_blocks, molecule_names, image_paths, progress_counters, keyword_bookkeeping, unknown_types, success_records, retained_events, patient_outcomes)}

_doi_start, _doi = O.DOI_START.replace("(?i)", ""), O.DOI.replace("(?i)", "")
_word = "regexp_replace(text, '[^a-z ]', '', 'g')"
SQL = {
    "resolved_files": """WITH n AS (SELECT page_id, 'in/' || page_id % 40 || CASE WHEN page_id % 2 = 0 THEN '.PDF' ELSE '.png' END AS name, url FROM pages), f AS (SELECT DISTINCT name FROM n WHERE page_id < 30),
i AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN url WHEN 1 THEN '  ' ELSE ' ' || name END AS input, name FROM n)
SELECT page_id, input, CASE WHEN page_id % 7 = 0 THEN 'url' WHEN page_id % 7 > 1 AND name IN (SELECT name FROM f) THEN CASE WHEN page_id % 2 = 0 THEN 'file' ELSE 'image' END END AS kind,
CASE WHEN page_id % 7 = 1 THEN 'input is empty' WHEN page_id % 7 > 1 AND name NOT IN (SELECT name FROM f) THEN 'file not found: ' || name END AS error FROM i""",
    "job_errors": f"""WITH o AS (SELECT CAST(user_id AS VARCHAR) AS token, outcome, checks FROM ({texts.SQL["job_outcomes"]}) WHERE outcome <> 'success'),
c AS (SELECT *, CASE outcome WHEN 'not_found' THEN 'TOKEN_NOT_FOUND' ELSE 'PARSE_ERROR' END AS code FROM o)
SELECT token, code, '{{"ok":false,"token":"' || token || '","error":{{"code":"' || code || '","message":"' || CASE outcome WHEN 'not_found' THEN 'The service did not recognize this token after ' || checks || ' checks.' ELSE 'status: ' || outcome END || '","stage":"get_result_poll"}}}}' AS record FROM c""",
    "block_texts": f"""WITH {BLOCKS_SQL}, t AS (SELECT token, page, block AS k, text, trim(text) AS t FROM blocks)
SELECT token, page, k AS block, CASE WHEN k % 8 = 0 THEN '$' || text || '$' WHEN k % 4 = 0 AND t <> '' THEN '$$' || chr(10) || t || chr(10) || '$$' WHEN k % 4 = 1 AND k % 3 = 0 THEN '|' || text || '|' WHEN k % 5 = 0 THEN trim('in ' || text)
  WHEN k % 4 = 2 AND k % 7 <> 0 AND CASE WHEN k > 6 THEN t ELSE 'CCO' END <> '' THEN '`' || CASE WHEN k > 6 THEN t ELSE 'CCO' END || '`' ELSE t END AS says FROM t""",
    "upgraded_tables": f"""WITH {BLOCKS_SQL}, t AS (SELECT token, page, block, text, {_word} AS w FROM blocks)
SELECT token, page, block, CASE WHEN block % 3 = 2 THEN '<table>[[A]]</table>' ELSE '<table><tr><td>[[VL_TABLE_0_0]][[VL_TABLE_0_1]]</td><td>[[VL_TABLE_1_0]][[VL_TABLE_1_1]]</td></tr></table>' END AS structure,
CASE WHEN block % 3 = 2 THEN '[[A]]' ELSE '[[VL_TABLE_0_0]]|[[VL_TABLE_0_1]]|[[VL_TABLE_1_0]]|[[VL_TABLE_1_1]]' END AS placeholders, CASE WHEN block % 3 = 2 THEN text ELSE w || ' |x_1|R&D ' || w || '|C' END AS contents, CASE WHEN block % 3 = 2 THEN 'text' ELSE 'text|equationinline|text|molecule' END AS types FROM t""",
    "doi_blocks": f"""WITH {BLOCKS_SQL}, d AS (SELECT token, page, block, text AS t, CASE block % 4 WHEN 0 THEN 'DOI:10.1/a ' || text WHEN 1 THEN 'F IGU R E https://doi.org/10.5/x doi:10.2/b, ' || text WHEN 2 THEN text || ' doi:10.3/c' ELSE text END AS text FROM blocks)
SELECT token, page, block, replace(CASE WHEN block % 4 = 2 THEN CASE WHEN regexp_matches(t, '{_doi_start}', 'i') THEN '' ELSE t END WHEN contains(lower(text), 'doi:10.') OR contains(lower(text), 'https://doi.org/') THEN regexp_replace(text, '{_doi}', '', 'gi') ELSE text END, 'F IGU R E', 'FIGURE') AS text,
CAST(CASE WHEN block % 4 = 2 THEN 1 ELSE 0 END AS INTEGER) AS n_lines FROM d WHERE NOT regexp_matches(text, '{_doi_start}', 'i')""",
    "molecule_names": f"""WITH {BLOCKS_SQL}, m AS (SELECT token, page, block, block // 4 AS g, block % 4 AS k, text FROM blocks), i AS (SELECT token, page, g, CASE WHEN page % 3 = 2 THEN '' ELSE trim(text) END AS name FROM m WHERE k = 1)
SELECT m.token, m.page, g || '/' || k AS path, CASE k WHEN 0 THEN 'C' ELSE 'N' || length(text) END AS smiles, trim(text) AS caption, coalesce(name, '') AS name FROM m LEFT JOIN i USING (token, page, g) WHERE k = 0 OR (k = 2 AND block < 8)""",
    "image_paths": "SELECT page_id, 'img/' || page_id % 20 || '.png' AS rel, CASE WHEN page_id % 20 < 10 THEN '/store/' || page_id % 20 ELSE '/base/img/' || page_id % 20 || '.png' END AS path FROM pages",
    "progress_counters": f"""WITH {BLOCKS_SQL}, t AS (SELECT token, CASE WHEN length(token) < 6 THEN -1 ELSE 1 END AS s, count(DISTINCT page) AS a, count(DISTINCT page) FILTER (block > 3) AS b, count(*) AS c, count(*) FILTER (type = 'paragraph') AS d FROM blocks GROUP BY token)
SELECT CAST(sum(a * s) AS BIGINT) AS total_page, CAST(sum(b * s) AS BIGINT) AS proc_page, CAST(sum(c * s) AS BIGINT) AS total_block, CAST(sum(d * s) AS BIGINT) AS proc_block FROM t""",
    "keyword_bookkeeping": f"WITH {BLOCKS_SQL} SELECT token, type AS keyword, count(*) - count(DISTINCT page) AS n FROM blocks GROUP BY token, type HAVING count(*) > count(DISTINCT page)",
    "unknown_types": f"WITH {BLOCKS_SQL} SELECT token, page, coalesce(string_agg(DISTINCT type, ',' ORDER BY type) FILTER (type NOT IN ('group', 'equation', 'table', 'paragraph', 'pageheader')), '') AS types FROM blocks GROUP BY token, page",
    "success_records": """SELECT CAST(doc_id AS VARCHAR) AS token, '/out/' || doc_id AS output_dir, '/out/' || doc_id || '/' || CASE WHEN doc_id % 3 = 0 THEN 's' || doc_id ELSE 'document' END || '.md' AS markdown_path, '/out/' || doc_id || '/pages_tree.json' AS pages_tree_path,
length(coalesce(text, '')) AS content_chars, left(coalesce(text, ''), 100) AS content_preview FROM documents""",
    "retained_events": """WITH e AS (SELECT user_id, ts, max(ts) OVER (PARTITION BY user_id) AS now FROM events) SELECT user_id, count(*) FILTER (ts >= now - INTERVAL 24 HOURS) AS day, count(*) FILTER (ts >= now - INTERVAL 336 HOURS) AS fortnight FROM e GROUP BY user_id""",
    "patient_outcomes": """WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth, event_type, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'error' WHEN 'signup' THEN NULL WHEN 'view' THEN NULL WHEN 'click' THEN NULL ELSE 'unknown_state' END AS ended FROM events)
SELECT user_id, coalesce(arg_min(ended, nth) FILTER (ended IS NOT NULL), 'pending') AS outcome, coalesce(min(nth) FILTER (ended IS NOT NULL), max(nth)) AS checks FROM e GROUP BY user_id""",
}

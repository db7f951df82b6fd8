"""Queries of files that are written and read back, and of jobs that are polled, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import viewer
from folio.plans import figures as figure_plans
from folio.plans import groups, texts
from folio.plans.rich import _esc
from folio.sinks import placed
from folio.sinks.shared import bytes_of, remove, shared_folder, shuffles_dropped
from folio.streaming import callbacks, service

#: Bytes of the documents whose viewers are there at a time, and parts of the documents at most, as each part reads them all.
PART_BYTES, MOST_PARTS = 1 << 26, 16


def placed_images(spark, sf_dir):
    """Every image of the content list once for each document and content, as written and read back."""
    at = shared_folder(spark, "images")
    placed.place(placed.image_contents(groups.sources(spark, sf_dir)), at)
    return placed.read_placed(spark, at).select("name", F.sha2("content", 256).alias("hash"), F.length("content").alias("bytes"))


def placed_groups(spark, sf_dir):
    """Every taken figure group's JSON and every document's summary, as written and read back."""
    at, info = shared_folder(spark, "groups"), figure_plans.figure_info(spark, sf_dir)
    placed.place(placed.group_records(figure_plans.figure_groups(spark, sf_dir), info), at)
    text = F.decode("content", "utf-8")
    part = lambda path: F.get_json_object(text, path)
    return placed.read_placed(spark, at).select("name", part("$.keyword").alias("keyword"), part("$.concat_type").alias("concat_type"), part("$.caption").alias("caption"), part("$.kept").alias("kept"), part("$.ratio").alias("ratio"))


def placed_viewers(spark, sf_dir):
    """Every page of the viewers, as written and read back: a hash of what is shown, and the nodes of its JSON. The files
    are several times the documents, so they are written, read and removed by parts of the documents."""
    at, nodes = shared_folder(spark, "viewers"), groups._nodes(spark, sf_dir).where("token is not null")
    parts = min(MOST_PARTS, 1 + bytes_of(spark, f"{sf_dir}/documents.parquet") // PART_BYTES)
    with shuffles_dropped(spark):
        for k in range(parts):
            placed.place(viewer.viewers(nodes.where(F.pmod(F.xxhash64("token"), F.lit(parts)) == k)), f"{at}/{k}", distinct=True)
            shown = _shown_pages(placed.read_placed(spark, f"{at}/{k}"))
            shown.write.parquet(f"{at}/pages/{k}")
            remove(f"{at}/{k}")
    return spark.read.schema(shown.schema).parquet(*[f"{at}/pages/{k}" for k in range(parts)])


def _shown_pages(files):
    text = F.split(F.decode("content", "utf-8"), '<section id="')
    pages = files.select("name", F.size(text).alias("n"), F.explode(F.slice(text, 2, F.size(text))).alias("s"))
    shown = F.split("s", '<script type="application/json">')
    rows = F.from_json(F.substring_index(F.element_at(shown, 2), "</script>", 1), "array<struct<path:array<int>,text:string>>")
    return pages.select("name", (F.col("n") - 1).alias("n_pages"), F.regexp_extract("s", r"^p(\d+)", 1).cast("int").alias("page"), F.sha2(F.element_at(shown, 1), 256).alias("hash"), F.size(rows).alias("n_nodes"), F.sha2(F.array_join(F.transform(rows, lambda r: r["text"]), "\n"), 256).alias("texts"))


def polled_jobs(spark, sf_dir):
    """A job for each user of the events, whose states are its answers; outcomes as the stream of polls has them."""
    at = shared_folder(spark, "jobs")
    states = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("token"), "ts", "event_id", texts.job_state(F.col("event_type")).alias("state"))
    service.answers(states, ["ts", "event_id"], f"{at}/answers")
    service.requests(states.select("token").distinct(), f"{at}/requests")
    stream = service.jobs(spark, requests=f"{at}/requests", service="files", answers=f"{at}/answers", interval="0", wait="60", batch="20000")
    query = stream.select("token", "outcome", "checks").writeStream.format("parquet").option("path", f"{at}/ended").option("checkpointLocation", f"{at}/checkpoint").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    ended = spark.read.schema("token string, outcome string, checks long").parquet(f"{at}/ended")
    return ended.select(F.col("token").cast("long").alias("user_id"), "outcome", "checks")


def accepted_callbacks(spark, sf_dir):
    """Events as callbacks, a key for each user and type: those that count, by their ids."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    calls = e.select(F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 3).cast("int").alias("attempt"), F.encode(F.col("event_id").cast("string"), "utf-8").alias("body"))
    return callbacks.accepted(calls).select("key", F.decode("body", "utf-8").cast("long").alias("event_id"), "attempt")


QUERIES = {f.__name__: f for f in (placed_images, placed_groups, placed_viewers, polled_jobs, accepted_callbacks)}
_groups = figure_plans.SQL["figure_groups"].removesuffix("SELECT * FROM groups")
SQL = {
    "placed_images": f"""{groups._NODES}{groups._files} SELECT f.token || '/' || f.name AS name, any_value(sha256(s.raw)) AS hash, CAST(any_value(octet_length(s.raw)) AS INTEGER) AS bytes FROM files f JOIN src s ON s.token = f.token AND s.page = f.page AND s.block = f.block GROUP BY f.token, f.name""",
    "placed_groups": f"""{_groups} SELECT token || '/' || name || '.json' AS name, keyword, concat_type, caption, NULL AS kept, NULL AS ratio FROM groups WHERE skipped IS NULL
UNION ALL SELECT token || '/global_info.json', NULL, NULL, NULL, kept, ratio FROM ({figure_plans.SQL["figure_info"]})""",
    "placed_viewers": f"""{groups.SQL["tree_text"].replace("SELECT token, page, string_agg(t, chr(10) ORDER BY path) AS text FROM l GROUP BY token, page", "")},
t AS (SELECT token, page, string_agg(t, chr(10) ORDER BY path) AS lines FROM l GROUP BY token, page),
v AS (SELECT *, array_to_string(path, '-') AS k, row_number() OVER (PARTITION BY token, page ORDER BY (x2 - x1) * (y2 - y1) DESC, path) AS layer, CAST(round(x1 * 1024) AS BIGINT) AS a, CAST(round(y1 * 1024) AS BIGINT) AS b, CAST(round(x2 * 1024) AS BIGINT) AS c, CAST(round(y2 * 1024) AS BIGINT) AS d FROM nodes),
p AS (SELECT token, page, string_agg('<a href="#n' || page || '-' || k || '"><rect x="' || a || '" y="' || b || '" width="' || (c - a) || '" height="' || (d - b) || '"><title>' || type || '</title></rect></a>', '' ORDER BY layer) AS boxes,
  string_agg('<article id="n' || page || '-' || k || '"><b>' || type || '</b> ' || {_esc("text")} || '</article>', '' ORDER BY path) AS cards, count(*) AS n, string_agg(text, chr(10) ORDER BY path) AS texts FROM v GROUP BY token, page)
SELECT token || '/index.html' AS name, CAST(count(*) OVER (PARTITION BY token) AS INTEGER) AS n_pages, page, sha256('p' || page || '"><h2>' || page || '</h2><pre>' || {_esc("lines")} || '</pre><svg viewBox="0 0 1024 1024">' || boxes || '</svg>' || cards) AS hash, CAST(n AS INTEGER) AS n_nodes, sha256(texts) AS texts FROM p JOIN t USING (token, page)""",
    "accepted_callbacks": """WITH RECURSIVE e AS (SELECT concat_ws('-', user_id, event_type) AS key, ts, event_id, CAST(event_id % 3 AS INTEGER) AS attempt FROM events WHERE ts IS NOT NULL),
o AS MATERIALIZED (SELECT *, min(ts) OVER (PARTITION BY key ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM e QUALIFY row_number() OVER (PARTITION BY key, ts ORDER BY attempt, CAST(event_id AS VARCHAR)) = 1),
t AS (SELECT key, min(ts) AS ts FROM o GROUP BY key UNION ALL SELECT t.key, o.next FROM t JOIN o ON o.key = t.key AND o.ts = t.ts WHERE o.next IS NOT NULL)
SELECT key, event_id, attempt FROM o SEMI JOIN t USING (key, ts)""",
    "polled_jobs": f"""SELECT user_id, CASE outcome WHEN 'pending' THEN 'failed' ELSE outcome END AS outcome, checks FROM ({texts.SQL["job_outcomes"]})""",
}

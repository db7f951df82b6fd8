"""Queries of question/answer assembly over `conversations`, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.operators import qa

ORDER = ["turn", "role", "text"]


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select("conv_id", F.col("turn").cast("int").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users ask and assistants answer; every fifth turn's question brings a solution along."""
    t, k = _turns(spark, sf_dir), F.floor(F.col("turn") / 2)
    user = F.col("role") == "user"
    return t.select(
        "conv_id", *ORDER,
        F.concat(F.lit("No. "), (1 + k % 3).cast("string")).alias("label"),
        F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("Chapter "), (1 + F.floor(k / 3)).cast("string"))).otherwise("").alias("chapter_title"),
        F.when(user, F.col("text")).otherwise("").alias("question"),
        F.when(user, "").otherwise(F.col("text")).alias("answer"),
        F.when(user & (F.col("turn") % 5 == 4), "![shown](a/b.png) see above").otherwise("").alias("solution"),
    )


def _merged(spark, sf_dir):
    return qa.merge_pairs(_rows(spark, sf_dir), "conv_id", ORDER).withColumn("pos", F.col("pos.turn"))


def qa_chapters(spark, sf_dir):
    return qa.chapters(_rows(spark, sf_dir), "conv_id", ORDER).select("conv_id", "turn", "role", "number", "chapter")


def qa_merge(spark, sf_dir):
    return _merged(spark, sf_dir)


def qa_chats(spark, sf_dir):
    return qa.chats(_merged(spark, sf_dir)).select("conv_id", "chapter", "number", "pos", "user", "assistant", F.array_join("images", ",").alias("images"))


def qa_replies(spark, sf_dir):
    return qa.parse_replies(_replies(spark, sf_dir), "conv_id")


def _replies(spark, sf_dir):
    """A reply a conversation: a pair for each user's turn, that names this turn's content, nonsense and the next one's."""
    t = _turns(spark, sf_dir).where("role = 'user'")
    n = F.col("turn").cast("string")
    pair = F.concat(F.lit("<vqa_pair><label>"), n, F.lit("</label><question>"), n, F.lit(", x, "), (F.col("turn") + 1).cast("string"), F.lit("</question>\n<answer> "), F.col("text"), F.lit(" </answer></vqa_pair>"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*ORDER, pair.alias("p")))), lambda e: e["p"]), "\n")
    return t.groupBy("conv_id").agg(F.concat(F.lit("<chapter><title>0</title>"), joined, F.lit("</chapter>")).alias("reply"))


def qa_resolved(spark, sf_dir):
    content = _turns(spark, sf_dir).select("conv_id", (F.row_number().over(Window.partitionBy("conv_id").orderBy(*ORDER)) - 1).alias("id"), "text")
    return qa.resolve_ids(qa_replies(spark, sf_dir), content, "conv_id", ["chapter", "pair"], "question_ids").withColumnRenamed("text", "question")


def qa_report(spark, sf_dir):
    done = _merged(spark, sf_dir).where("joined")
    return qa.report(done, "conv_id", "pos")


QUERIES = {f.__name__: f for f in (qa_chapters, qa_merge, qa_chats, qa_replies, qa_resolved, qa_report)}

_title = r"CASE WHEN regexp_matches(t, '\d') THEN regexp_extract(t, '\d+\.\d+|\d+') ELSE t END"
_turns_sql = "WITH turns AS (SELECT conv_id, CAST(turn AS INTEGER) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)"
_rows_sql = f"""{_turns_sql}, rows_ AS (
  SELECT conv_id, turn, role, text, CAST(1 + (turn // 2) % 3 AS INTEGER) AS number,
    CASE WHEN conv_id % 2 = 0 THEN 'Chapter ' || (1 + turn // 6) ELSE '' END AS title,
    CASE WHEN role = 'user' THEN text ELSE '' END AS question, CASE WHEN role = 'user' THEN '' ELSE text END AS answer,
    CASE WHEN role = 'user' AND turn % 5 = 4 THEN '![shown](a/b.png) see above' ELSE '' END AS solution FROM turns)"""
_chap = lambda src: f"""(SELECT *, {_title} AS chapter FROM (SELECT * EXCLUDE (b), replace(coalesce(last_value(b IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING), ''), ' ', '') AS t FROM (
  SELECT *, CASE WHEN title <> '' AND number < coalesce(lag(number) OVER (PARTITION BY conv_id ORDER BY turn, role, text), 1000) THEN title END AS b FROM {src})))"""  # noqa: E731
_merge_sql = f"""{_rows_sql}, asked AS {_chap("rows_ WHERE question <> ''")}, told AS {_chap("rows_ WHERE question = ''")},
q AS (SELECT conv_id, chapter, number, last(question ORDER BY turn, role, text) AS question, min(turn) AS pos FROM asked WHERE answer = '' AND solution = '' GROUP BY conv_id, chapter, number),
a AS (SELECT conv_id, chapter, number, coalesce(first(answer ORDER BY turn, role, text) FILTER (answer <> ''), '') AS answer, coalesce(first(solution ORDER BY turn, role, text) FILTER (solution <> ''), '') AS solution FROM told GROUP BY conv_id, chapter, number),
merged AS (SELECT conv_id, chapter, number, question, answer, solution, false AS joined, turn AS pos FROM asked WHERE answer <> '' OR solution <> ''
  UNION ALL SELECT conv_id, chapter, number, question, answer, solution, true, pos FROM q JOIN a USING (conv_id, chapter, number))"""
_replies_sql = f"""{_turns_sql}, parsed AS (SELECT conv_id, 0 AS chapter, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INTEGER) AS pair, '0' AS title_ids, CAST(turn AS VARCHAR) AS label,
  turn || ', x, ' || (turn + 1) AS question_ids, trim(text) AS answer, CAST(NULL AS VARCHAR) AS solution_ids, turn FROM turns WHERE role = 'user')"""
SQL = {
    "qa_chapters": f"{_rows_sql} SELECT conv_id, turn, role, number, chapter FROM {_chap('rows_')}",
    "qa_merge": f"{_merge_sql} SELECT * FROM merged",
    "qa_chats": f"""{_merge_sql}, s AS (SELECT *, CASE WHEN solution <> '' THEN 'see above' ELSE '' END AS sol, CASE WHEN solution <> '' THEN '<image>' ELSE '' END AS im, trim(answer) AS ans FROM merged)
SELECT conv_id, chapter, number, pos, im || trim(question) AS user, CASE WHEN ans <> '' AND sol <> '' THEN ans || chr(10) || chr(10) || sol WHEN ans <> '' THEN ans ELSE sol END AS assistant, CASE WHEN im <> '' THEN 'a/b.png' ELSE '' END AS images
FROM s WHERE trim(question) <> '' AND (ans <> '' OR sol <> '')""",
    "qa_replies": f"{_replies_sql} SELECT * EXCLUDE (turn) FROM parsed",
    "qa_resolved": f"""{_replies_sql}, content AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS id, text FROM turns)
SELECT p.conv_id, p.chapter, p.pair, coalesce(string_agg(c.text, chr(10) ORDER BY c.id), '') AS question FROM parsed p LEFT JOIN content c ON c.conv_id = p.conv_id AND c.id IN (p.turn, p.turn + 1) GROUP BY p.conv_id, p.chapter, p.pair""",
    "qa_report": f"{_merge_sql} SELECT conv_id, string_agg('### Question ' || number || chr(10) || chr(10) || question || chr(10) || chr(10) || answer || chr(10) || chr(10) || '---' || chr(10), chr(10) ORDER BY pos) AS markdown FROM merged WHERE joined GROUP BY conv_id",
}

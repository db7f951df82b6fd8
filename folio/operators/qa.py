"""Question/answer assembly: replies of a language model to pairs, pairs merged over chapters, chats from pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import MD_IMAGE, label_number, refine_title, strip_images


def chapters(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Rows that have a number in their label, with `number` and `chapter` (refined).

    Within each `by`, a row's title counts only if its number is below that of the row before it (as for the first
    row); other rows are in the chapter that was last begun.
    """
    w = Window.partitionBy(by).orderBy(*order)
    rows = rows.withColumn("number", label_number(F.col("label"))).where("number is not null")
    begins = (F.coalesce("chapter_title", F.lit("")) != "") & (F.coalesce(F.lag("number").over(w), F.lit(2**31 - 1)) > F.col("number"))
    title = F.last(F.when(begins, F.col("chapter_title")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("chapter", refine_title(F.coalesce(title, F.lit(""))))


def merge_pairs(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """by, chapter, number, question, answer, solution, joined, pos: complete questions, and open ones with the answers
    of their chapter and number.

    rows: by, label, chapter_title, question, answer, solution and the columns of `order`, which make the order total.
    Of equal open questions the last one's text is taken, at the place (`pos`) of the first; of equal answers the first
    non-empty text of each kind. Numbers of 0 and below are left out. Null texts count as empty. Questions and answers
    are aggregated by key before they are joined on it.
    """
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("question", "answer", "solution")})
    key, at = [by, "chapter", "number"], F.struct(*order)
    asked = chapters(rows.where("question != ''"), by, order).where("number > 0")
    told = chapters(rows.where("question = ''"), by, order).where("number > 0")
    full = (F.col("answer") != "") | (F.col("solution") != "")
    complete = asked.where(full).select(*key, "question", "answer", "solution", F.lit(False).alias("joined"), at.alias("pos"))
    opened = asked.where(~full).groupBy(*key).agg(F.max_by("question", at).alias("question"), F.min(at).alias("pos"))
    first = lambda c: F.coalesce(F.min_by(c, F.when(F.col(c) != "", at)), F.lit("")).alias(c)
    answers = told.groupBy(*key).agg(first("answer"), first("solution"))
    return complete.unionByName(opened.join(answers, key).select(*key, "question", "answer", "solution", F.lit(True).alias("joined"), "pos"))


def _inside(text: Column, tag: str) -> Column:
    """Trimmed content of the first such tag, null without one."""
    return F.when(text.rlike(f"(?s)<{tag}>.*?</{tag}>"), F.trim(F.regexp_extract(text, f"(?s)<{tag}>(.*?)</{tag}>", 1)))


def parse_replies(replies: DataFrame, key: str) -> DataFrame:
    """key, chapter, pair (both from 0), title_ids, label, question_ids, answer, solution_ids of each pair that has a
    label and at least one of the rest; absent parts are null. replies: key, reply."""
    parts = replies.select(key, F.posexplode(F.regexp_extract_all("reply", F.lit("(?s)<chapter>(.*?)</chapter>"), 1)).alias("chapter", "c"))
    pairs = parts.select(key, "chapter", _inside(F.col("c"), "title").alias("title_ids"), F.posexplode(F.regexp_extract_all("c", F.lit("(?s)<vqa_pair>(.*?)</vqa_pair>"), 1)).alias("pair", "p"))
    tags = {"label": "label", "question_ids": "question", "answer": "answer", "solution_ids": "solution"}
    out = pairs.select(key, "chapter", "pair", "title_ids", *[_inside(F.col("p"), t).alias(c) for c, t in tags.items()])
    return out.where("label is not null and coalesce(question_ids, answer, solution_ids) is not null")


def resolve_ids(refs: DataFrame, content: DataFrame, doc: str, ref: list[str], ids: str) -> DataFrame:
    """`ref` columns and text: the contents that comma-separated `ids` name, in their order, joined by line feeds; what
    is no number or names no content is left out. content: doc, id, text."""
    each = refs.select(doc, *ref, F.posexplode(F.split(F.replace(F.coalesce(ids, F.lit("")), F.lit(" "), F.lit("")), ",")).alias("nth", "raw"))
    found = each.withColumn("id", F.col("raw").try_cast("int")).join(content, [doc, "id"], "left")
    texts = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("nth", "text"))))
    return found.groupBy(doc, *ref).agg(F.array_join(F.transform(texts, lambda e: e["text"]), "\n").alias("text"))


def chats(pairs: DataFrame) -> DataFrame:
    """All columns and user, assistant, images (array of paths): a chat per pair with a question and an answer or
    solution; an `<image>` for each image that question and solution show comes before the question."""
    q, a, s = (F.trim(F.coalesce(c, F.lit(""))) for c in ("question", "answer", "solution"))
    images = F.concat(F.regexp_extract_all(q, F.lit(MD_IMAGE), 1), F.regexp_extract_all(s, F.lit(MD_IMAGE), 1))
    solution = strip_images(s)
    reply = F.when((a != "") & (solution != ""), F.concat(a, F.lit("\n\n"), solution)).when(a != "", a).otherwise(solution)
    out = pairs.withColumns({"user": F.concat(F.repeat(F.lit("<image>"), F.size(images)), strip_images(q)), "assistant": reply, "images": images})
    return out.where((q != "") & (F.col("assistant") != ""))


def report(pairs: DataFrame, by: str, order: str) -> DataFrame:
    """by, markdown: numbered questions with their answers, in order, between rules."""
    body = F.concat(F.lit("### Question "), F.col("number").cast("string"), F.lit("\n\n"), F.col("question"), F.lit("\n\n"), F.col("answer"), F.lit("\n\n---\n"))
    all_ = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), body.alias("b"))))
    return pairs.groupBy(by).agg(F.array_join(F.transform(all_, lambda e: e["b"]), "\n").alias("markdown"))

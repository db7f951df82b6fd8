import re
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folio.functions import captions as C
from folio.functions import text as T
from folio.operators import layout as L
from folio.operators import qa
from folio.streaming import jobs


def _boxes(spark, rows):
    return spark.createDataFrame(rows, "token string, page int, block int, type string, x1 double, y1 double, x2 double, y2 double, text string")


def test_paragraphs_go_on(spark):
    line = lambda k, kind, text: ("d", 0, k, kind, 0.0, k / 10, 1.0, k / 10 + 0.05, text)
    df = _boxes(spark, [line(0, "paragraph", "One and"), line(1, "paragraph", "then two."), line(2, "paragraph", "(a) then three"), line(3, "title", "Title"), line(4, "paragraph", "New (see b)"), line(5, "paragraph", "[1] Next one")])
    got = {r.first_block: (r.n_blocks, r.text) for r in L.paragraphs(df).collect()}
    assert got == {0: (3, "One and then two. (a) then three"), 3: (1, "Title"), 4: (1, "New (see b)"), 5: (1, "[1] Next one")}


@pytest.mark.parametrize("line, head, tail", [("Abc.", True, True), ("abc", False, False), ("(1) Abc (x)", True, False), ("中文。", False, True), ("12-Abc: [3]", True, True), ("# x", True, False), ("", False, False), ("a) Word", True, False)])
def test_paragraph_ends(spark, line, head, tail):
    r = spark.createDataFrame([(line,)], "s string").select(T.starts_paragraph(F.col("s")), T.ends_paragraph(F.col("s"))).first()
    assert tuple(r) == (head, tail)


def test_parents_nest_and_stay_apart(spark):
    df = _boxes(spark, [("d", 0, 0, "group", 0.0, 0.0, 1.0, 1.0, ""), ("d", 0, 1, "image", 0.1, 0.1, 0.6, 0.6, ""), ("d", 0, 2, "paragraph", 0.2, 0.2, 0.3, 0.3, ""), ("d", 0, 3, "paragraph", 0.7, 0.7, 0.8, 0.8, ""), ("d", 1, 0, "paragraph", 0.2, 0.2, 0.3, 0.3, "")])
    got = {(r.page, r.block): r.parent for r in L.parents(df).collect()}
    assert got == {(0, 0): -1, (0, 1): 0, (0, 2): 1, (0, 3): 0, (1, 0): -1}


def test_keywords():
    assert C.keywords("Figure 1: see Figs. 2-4 and Table S2") == ["Fig1", "Fig2", "Fig3", "Fig4", "Table$2"]
    assert C.keywords("Supplementary Figure 4. Scheme 2") == ["Fig$4", "Scheme2"]
    assert C.keywords(None) == C.keywords("") == C.keywords("no name") == []


def test_clean_text_equals_brute_force(spark):
    texts = ["a\nb", "ﬁne – x​“q”", " tab\there ", "", None, "全角 ＡＢ…", "é　ü"]

    def plain(s):
        s = "".join(c for c in unicodedata.normalize("NFKC", s or "") if unicodedata.category(c)[0] != "C")
        s = re.sub("[ -‏‪-  　]", " ", s)
        for a, b in C.SYMBOLS.items():
            s = s.replace(a, b)
        return re.sub(r"\s+", " ", s).strip()

    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    assert [r[0] for r in df.orderBy("k").select(C.clean_text(F.col("t"))).collect()] == [plain(t) for t in texts]


def test_pairs_of_one_key(spark):
    cols = "doc int, pos int, label string, chapter_title string, question string, answer string, solution string"
    rows = [
        (1, 0, "1", "第一章", "old?", "", ""), (1, 1, "Q1.", "第一章", "new?", "", ""), (1, 2, "2", "", "full?", "yes", ""), (1, 3, "none", "", "gone?", "", ""),
        (1, 4, "0", "", "zero?", "", ""), (1, 5, "1", "第一章", "", "", "why"), (1, 6, "1", "", "", "42", "other"), (1, 7, "9", "", None, "lonely", None),
    ]
    got = qa.merge_pairs(spark.createDataFrame(rows, cols), "doc", ["pos"]).orderBy("joined", "pos").collect()
    assert [(r.chapter, r.number, r.question, r.answer, r.solution, r.joined, r.pos.pos) for r in got] == [("一", 2, "full?", "yes", "", False, 2), ("一", 1, "new?", "42", "why", True, 0)]
    none = spark.createDataFrame([], cols)
    assert qa.merge_pairs(none, "doc", ["pos"]).count() == 0


def test_reply_without_label(spark):
    reply = "<chapter><title>0</title><vqa_pair><question>1</question></vqa_pair><vqa_pair><label>1</label>\n<question>1, 2</question></vqa_pair></chapter>"
    got = qa.parse_replies(spark.createDataFrame([(7, reply), (8, "<empty></empty>"), (9, None)], "k int, reply string"), "k").collect()
    assert [(r.k, r.pair, r.label, r.question_ids, r.answer) for r in got] == [(7, 1, "1", "1, 2", None)]


STATES = [("a", 0, "undefined"), ("a", 1, "undefined"), ("a", 2, "waiting"), ("a", 3, "undefined"), ("a", 4, "success"), ("a", 5, "error"), ("b", 0, "undefined"), ("b", 1, "undefined"), ("b", 2, "undefined"), ("b", 3, "success"), ("c", 0, "waiting"), ("d", 0, "odd")]
ENDS = {("a", "success", 5), ("b", "not_found", 3), ("c", "pending", 1), ("d", "unknown_state", 1)}


def test_job_outcomes(spark):
    df = spark.createDataFrame(STATES, "job string, ts int, state string")
    assert {tuple(r) for r in jobs.outcomes(df, "job", ["ts"]).collect()} == ENDS
    patient = {r.job: r.outcome for r in jobs.outcomes(df, "job", ["ts"], None).collect()}
    assert patient == {"a": "success", "b": "success", "c": "pending", "d": "unknown_state"}


def test_watch_equals_batch(spark, tmp_path):
    """The stream ends as the batch does; a job that never ends times out once the watermark has passed its deadline."""
    at = pd.Timestamp("2024-01-01")
    parts = [STATES[:4] + STATES[6:8], STATES[4:6] + STATES[8:]]
    last = [("z", 100_000, "waiting")]
    for k, part in enumerate([*parts, last, [("z", 100_001, "waiting")]]):
        rows = [(j, (at + pd.Timedelta(seconds=s)).to_pydatetime(), x) for j, s, x in part]
        spark.createDataFrame(rows, "job string, ts timestamp, state string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job string, ts timestamp, state string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "1 minute")
    q = jobs.watch(stream, "job").writeStream.format("memory").queryName("watched").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.table("watched").collect()}
    assert got == (ENDS - {("c", "pending", 1)}) | {("c", "timeout", 1)}


def test_first_callbacks(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("m", 1, "c")], "idempotency_key string, ts int, body string")
    assert {tuple(r) for r in jobs.first_callbacks(df).collect()} == {("k", 1, "a"), ("m", 1, "c")}

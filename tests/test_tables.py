import pytest
from pyspark.sql import functions as F

from folio.functions import spans as S
from folio.plans.queries import QUERIES
from folio.sources import tables
from folio.sources.batches import BATCH_BYTES, bounded


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_tables_rows_leave_the_task_of_its_html(spark):
    html = "<table><thead><tr><th>A</th><th>B</th></tr><tr><th>a</th><th>b</th></tr></thead><tr><td>1</td><td>x &amp; <b>y</b></td></tr><tr><td> </td><td></td></tr><tr><td>2</td></tr></table><table><tr><td>other</td></tr></table>"
    docs = [(1, html), (2, None), (3, "no table"), (4, "<table></table>"), *[(k, "<table><tr><td>" + "w" * 200_000 + f"</td></tr><tr><td>{k}</td></tr></table>") for k in range(5, 25)]]
    rows = tables.table_rows(spark.createDataFrame(docs, "k long, html string").coalesce(1), "html", ("k",))
    assert "Exchange" not in _plan(rows)
    got = {r.k: r.rows for r in rows.collect()}
    assert got == {1: [["A a", "B b"], ["1", "x & y"], ["2", ""]], **{k: [["w" * 200_000], [str(k)]] for k in range(5, 25)}}


def test_rows_go_to_python_by_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        for given, want in (("256MB", BATCH_BYTES), ("4096", 4096)):
            spark.conf.set(key, given)
            bounded(spark)
            assert int(spark.conf.get(key)) == want
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("html", ["<table><tr><td>a &amp; b</td><td>c</td></tr></table>", "<table><tr><td>a<br>b<td>c", "<table><tr><td>a &# b</td><td>c</td></tr>", "<table><tr><td><script><td></script>x</td></tr></table>", "<table><tr><td>a < b</td></tr></table>"])
def test_plain_tags_are_read_as_the_parser_reads_them(html, monkeypatch):
    fast = tables.split_table(html), list(tables.cells(html))
    monkeypatch.setattr(tables, "_TAG", tables.re.compile("(?!)"))
    assert (tables.split_table(html), list(tables.cells(html))) == fast


def _columns(spark, sources):
    """What the Column functions make of tables."""
    t = spark.createDataFrame([(k, *tables.split_table(s or "")) for k, s in enumerate(sources)], f"k long, {tables.SPLIT}")
    filled = [S.fill_placeholders(F.col("structure"), F.col("placeholders"), S.spans_of(F.col("contents"), F.col("types")), f).alias(f) for f in ("plain", "markdown", "html")]
    qa = S.qa_table_text(F.col("structure"), F.col("placeholders"), S.qa_spans(F.col("contents"), F.col("types")))
    return t.select("*", *filled, qa.alias("qa"))


def test_tables_are_filled_in_the_pass_that_reads_them(spark):
    cells = ["", " ", "a &amp; b", "<b>R&amp;D</b> $x_1$ ***C***", "***`C`***", "\\($x$\\) $ 5 $", "[[VL_TABLE_0_0]] `x&lt;\"y'`", "\\[a<b\\]", "<table><tr><td>in</td></tr></table>", "[[VL_TABLE_1_0]]", "<code> C </code> é", "a<br/>b &# <i title='x'>c</i>"]
    sources = [*(f" <table><tr><td>{a}</td><td colspan='2'>{b}</td></tr></table>\n" for a in cells for b in cells), None, "", "no table", "[[VL_TABLE_0_0]]<table><tr><td>x", "<table><tr><td>" + "w $a_1$ " * 500]
    got = tables.filled_tables(spark.createDataFrame(list(enumerate(sources)), "k long, html string"), "html", ("k",))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, _columns(spark, sources).collect()))
    assert tables.filled_tables(spark.createDataFrame([], "k long, html string"), "html", ("k",)).count() == 0


def test_table_spans_fills_tables_in_one_pass(spark):
    plan = _plan(QUERIES["table_spans"](spark, "/root/testdata/sf0.001"))
    assert "MapInArrow" in plan and "aggregate(" not in plan and "zip_with(" not in plan


@pytest.mark.parametrize("html", ["<b>R&amp;D</b> x", "a<i>b</i>&lt;p&gt;", "a<br>b", "<b>x &amp", "a <b c='d'>e</b>", "<script><b></script>", "&am<b>p;</b>"])
def test_plain_text_is_read_as_the_parser_reads_it(html, monkeypatch):
    fast = tables.inner_text(html)
    monkeypatch.setattr(tables, "_TAG", tables.re.compile("(?!)"))
    assert tables.inner_text(html) == fast

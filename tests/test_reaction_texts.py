from pyspark.sql import functions as F

from folio.functions import reactions as R
from folio.functions import spans as S
from folio.functions.frames import pipe_table
from folio.plans.queries import QUERIES

TEXTS = ["", "  ", None, "CCO", " a & b<c>\"'", "50% é_α", "and $k_1$", "$5 or $6 x", "$a b$$c d$", "***C*** `N`", "``", "a * b", "\\(x\\)\\[y\\]", "<code>", " w　"]


def test_component_texts_are_those_of_spans(spark):
    rows = [(k, m, t) for k, t in enumerate(TEXTS) for m in (1, 2)]
    t = F.trim(F.coalesce("text", F.lit("")), F.lit(S.SPACES))
    one = F.array(F.struct(t.alias("content"), F.lit(S.MOLECULE).alias("type")))
    spans = F.when(t == "", F.slice(one, 1, 0)).when(F.col("m") == 1, one).otherwise(S.inline_spans(t))
    df = spark.createDataFrame(rows, "k int, m int, text string")
    c = F.struct(F.col("m").alias("category_id"), F.lit(None).cast("string").alias("category"), "text")
    got = df.select("k", "m", F.get(F.transform(F.array(c), R.component_texts), F.lit(0)).alias("f"), F.struct(*[S.inline_text(spans, f).alias(f) for f in R.FORMS]).alias("want")).collect()
    assert len(got) == len(rows) and all(r.f == r.want for r in got)


def test_pipe_tables_of_uneven_rows(spark):
    rows = F.array(F.array(F.lit("a"), F.lit("long cell"), F.lit("beyond")), F.array(F.lit(None).cast("string")), F.array().cast("array<string>"))
    got = spark.range(1).select(pipe_table(F.array(F.lit("x"), F.lit(None).cast("string")), rows).alias("t"), pipe_table(F.array().cast("array<string>"), rows).alias("n")).first()
    assert got.t == "| x   | None      |\n|:----|:----------|\n| a   | long cell |\n|     |           |\n|     |           |"
    assert got.n == "||\n||\n||\n||\n||"


def test_words_are_cut_once(spark):
    plan = QUERIES["expression_tables"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(text") == 1

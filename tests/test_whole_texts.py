import duckdb

from folio.plans.queries import QUERIES, SQL


def _pages(spark, tmp_path):
    urls = [f"https://www.example.org/{'a' * n}/page?x={n}" for n in range(120)]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    return con


def _equal(spark, tmp_path, con, name):
    df = QUERIES[name](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({SQL[name]})").fetchall())


def test_long_base64_has_no_breaks_in_source_kinds(spark, tmp_path):
    _equal(spark, tmp_path, _pages(spark, tmp_path), "source_kinds")


def test_long_base64_has_no_breaks_in_image_references(spark, tmp_path):
    _equal(spark, tmp_path, _pages(spark, tmp_path), "image_references")


def test_text_functions_strip_whole_texts(spark, tmp_path):
    texts = ["abcdef ![p](q.png) g", "a\n\n\n\n![x](y)\n\nz", "", None, "![a](b)![c](d) end \xa0", "![a\nb](c) stays", "w " * 5000 + "![a](b)"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    _equal(spark, tmp_path, con, "text_functions")
    got = {r.doc_id: r.stripped for r in QUERIES["text_functions"](spark, str(tmp_path)).collect()}
    assert got[0] == "xabcdef  gy" and got[1] == "xa\n\nzy" and got[2] == got[3] == "xy" and got[6] == "x" + "w " * 5000 + "y"

import hashlib
import re

import duckdb
import pytest

import __spark_entry__ as entry
from folio.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "events", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).df()
    key = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).values.tolist()))
    assert sorted(ours.columns) == sorted(theirs.columns) and key(ours) == key(theirs)


def test_whole_texts_are_stripped_of_images(spark, tmp_path):
    texts = ["abcdef ![a](b.png) g", "abcdef\n\n\n\n![x](y)\n\nz", "\t\n long enough ![a\u2028b](c)\u3000\n", "![a\nb](c) stays", "", None, "plain", "![a](b)![c](d) end \xa0"]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    want = [re.sub(r"\n{3,}", "\n\n", re.sub(r"!\[.*?\]\((.*?)\)", "", t or "")).strip() for t in texts]
    want = {(k, hashlib.sha256(t.encode()).hexdigest(), len(t)) for k, t in enumerate(want)}
    assert {tuple(r) for r in QUERIES["stripped_texts"](spark, str(tmp_path)).collect()} == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    assert set(con.execute(SQL["stripped_texts"]).fetchall()) == want


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1

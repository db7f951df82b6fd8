from folio.sources.pages_tree import nodes


def test_trees_go_to_python_by_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "256MB")
        raw = "[[" + ",".join('{"text":"' + "w" * 400_000 + '"}' for _ in range(6)) + "]]"
        rows = nodes(spark.createDataFrame([(str(k), raw) for k in range(4)], "token string, raw string").coalesce(1))
        assert int(spark.conf.get(key)) <= 1 << 20
        assert rows.selectExpr("token", "page", "path", "length(text) AS n").distinct().count() == 24
    finally:
        spark.conf.set(key, before)

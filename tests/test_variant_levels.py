import json

from pyspark.sql import functions as F

from folio.sources import variant_trees as V


def _chain(n):
    """n groups inside each other, a text beside each."""
    node = {"text": "last"}
    for k in range(n):
        node = {"items": [{"text": str(k)}, node], "block": k}
    return json.dumps([[node]])


def test_levels_are_taken_apart_several_at_once(spark):
    n = 5 * V.STEP + 3
    raw = spark.createDataFrame([("a", _chain(n)), ("b", _chain(0)), ("c", _chain(V.STEP - 1)), ("d", _chain(V.STEP))], "token string, raw string")
    spark.sparkContext.setJobGroup("levels", "levels")
    rows = V.levels(V.documents(raw).select("token", "pages")).select("token", "path", "depth", F.to_json("node").alias("node")).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("levels"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < n / 2
    assert {t: sum(r.token == t for r in rows) for t in "abcd"} == {"a": 2 * n + 1, "b": 1, "c": 2 * V.STEP - 1, "d": 2 * V.STEP + 1}
    assert all(r.depth == len(r.path) - 1 and len(r.node) < 60 for r in rows)


def test_odd_items(spark):
    tree = [[{"items": None}, {"items": 3}, {"items": []}, {"items": [1, None, {"text": "x"}, [2]]}, {"text": "t", "items": [{"text": "hidden"}]}, {"items": [{"items": [{"text": "y"}]}], "more": 1}]]
    rows, errors = V.tree_rows(spark.createDataFrame([("a", json.dumps(tree))], "token string, raw string"))
    got = sorted((tuple(r.path), r.kind, r.subtree) for r in rows.collect())
    assert errors.count() == 0
    assert got == [((0,), "group", 1), ((1,), "group", 1), ((2,), "group", 1), ((3,), "group", 2), ((3, 2), "textual", 1), ((4,), "textual", 1), ((5,), "group", 3), ((5, 0), "group", 2), ((5, 0, 0), "textual", 1)]

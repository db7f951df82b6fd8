import json
from collections import Counter

from folio.plans.trees import tree_nodes
from folio.sources.pages_tree import kind_of, nodes, read_documents, walk


def test_kinds_by_the_first_key_that_is_there():
    assert kind_of({"type": "hline"}) == "layout" and kind_of({"items": [], "text": None}) == "textual"
    assert kind_of({"reactions": None, "text": "x"}) == "expression" and kind_of({"contents": ["x"]}) == "layout"


def test_order_and_subtrees():
    leaf = lambda t, **k: {"text": t, **k}
    tree = [[{"items": [leaf("a", order=2), {"items": [leaf("b")], "order": 1}], "order": 5}, leaf("c", order=0)], []]
    rows = [(r[2], r[9], r[14]) for r in walk("d", json.dumps(tree))]
    assert rows == [("0", 4, None), ("0/0", 1, "a"), ("0/1", 2, None), ("0/1/0", 1, "b"), ("1", 1, "c")]
    assert [r[2] for r in walk("d", json.dumps({"pages_tree": tree}), by_order=True)] == ["1", "0", "0/1", "0/1/0", "0/0"]


def test_files_and_wrong_documents(spark, tmp_path):
    good = [[{"type": "title", "text": "T", "bbox": [0, 0, 1, 0.5], "block": 0, "more": 1}]]
    texts = {"a": json.dumps(good), "b": "{", "c": "{}", "d": "[1]", "e": json.dumps({"pages_tree": [[{"text": "x", "bbox": {"x1": 1, "y1": 2, "x2": 3, "y2": 4}}]]})}
    for k, v in texts.items():
        (tmp_path / f"{k}.json").write_text(v)
    got = {r.token: r for r in nodes(read_documents(spark, str(tmp_path))).collect()}
    assert {k: got[k].error for k in texts} == {"a": None, "b": "not JSON", "c": "no pages_tree", "d": "not a list of pages", "e": None}
    assert (got["a"].text, got["a"].y2, got["a"].block, got["e"].x2) == ("T", 0.5, 0, 3.0)
    assert nodes(spark.createDataFrame([], "token string, raw string")).count() == 0


def test_long_pages_are_whole(spark, tmp_path):
    spark.createDataFrame([(1, "\n".join("abcdefghijkl"))] * 90 + [(2, "alone")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter((r.token, r.kind == "group") for r in tree_nodes(spark, str(tmp_path)).collect())
    assert got == {("doc-1", False): 90 * 12, ("doc-1", True): 1, ("doc-2", False): 1, ("doc-2", True): 1}

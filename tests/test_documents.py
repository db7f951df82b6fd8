"""Spans, tables, images, sinks, reading orders and trees on small cases."""

import base64
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from folio.functions import captions as C
from folio.functions import spans as S
from folio.functions import text as T
from folio.operators import content, nesting, tree
from folio.operators import reading as R
from folio.sinks import files
from folio.sources import images, tables


@pytest.mark.parametrize(
    "caption, names",
    [
        ("Figs. 3 and 4", ["Fig3", "Fig4"]),
        ("Figs. 20-22", ["Fig20", "Fig21", "Fig22"]),
        ("Figs 1,2 & 4", ["Fig1", "Fig2", "Fig4"]),
        ("Figures 7 and 8-10", ["Fig7", "Fig8", "Fig9", "Fig10"]),
        ("Fig- ure 4", ["Fig4"]),
        ("Figure 12, see Figs. S11 to S13", ["Fig12", "Fig$11", "Fig$12", "Fig$13"]),
        ("Figures S2A and 2B", ["Fig$2", "Fig2"]),
        ("Supplementary Figures 4,5,6", ["Fig$4", "Fig$5", "Fig$6"]),
        ("Fig. (6) and Fig. (6a)", ["Fig6"]),
        ("Table S2, Scheme 1, chart-3, fig 9", ["Fig9", "Scheme1", "Table$2", "Chart3"]),
        ("Figs 4", []),
        ("figs 4, FigS3, figs3", ["Fig4", "Figs3", "Fig3"]),
    ],
)
def test_keywords_of_captions(caption, names):
    assert C.keywords(caption) == names


def test_inline_spans_and_formats(spark):
    text = "see $a_1$ for $5 or $6, ***CCO*** and `N` <b>&\\(x\\)$$y^2$$"
    got = [tuple(s) for s in spark.range(1).select(S.inline_spans(F.lit(text)).alias("s")).first()["s"]]
    assert got == [("see ", "text"), ("a_1", "equationinline"), (" for $5 or $6, ", "text"), ("CCO", "molecule"), (" and ", "text"), ("N", "molecule"), (" <b>&", "text"), ("x", "equationinline"), ("y^2", "equationinline")]
    assert tables.spans(text) == got
    row = spark.range(1).select(S.inline_spans(F.lit(None).cast("string")).alias("n"), S.inline_text(S.inline_spans(F.lit("50% ***C***")), "latex").alias("l")).first()
    assert row["n"] == [] and row["l"] == "50\\% \\texttt{C}"


def test_spans_in_python_equal_those_of_columns(spark):
    r = random.Random(1)
    parts = ["$", "$$", "`", "***", "\\(", "\\)", "\\[", "\\]", "a", " ", "x_1", "=", "\n", "<code>", "</code>"]
    texts = ["".join(r.choices(parts, k=r.randrange(20))) for _ in range(400)]
    got = spark.createDataFrame(list(enumerate(texts)), "k long, t string").select("k", S.inline_spans(F.col("t")).alias("s")).collect()
    assert all([tuple(s) for s in x["s"]] == tables.spans(texts[x["k"]]) for x in got)


def test_table_cells_with_spans_and_headers():
    html = '<p>x</p><table><thead><tr><th colspan=2>A</th><th rowspan="2">B</th></tr><tr><th>a1</th><th>a2</th></tr></thead><tr><td>1<td>2 &amp; 3<td> <b>4</b> 5</tr><tr><td>6</tr></table><table><tr><td>one</td></tr></table>'
    rows = {}
    for table, row, col, head, text in tables.cells(html):
        rows.setdefault((table, row, head), []).append(text)
    assert rows == {(0, 0, True): ["A", "A", "B"], (0, 1, True): ["a1", "a2", "B"], (0, 2, False): ["1", "2 & 3", "4 5"], (0, 3, False): ["6", "", ""], (1, 0, True): ["one"]}
    assert list(tables.cells("no table")) == list(tables.cells("")) == []


def test_table_placeholders_keep_the_structure():
    html = "<table><tr><td>a $x_1$</td><td></td><td><table><tr><td>in</td></tr></table></td></tr></table>"
    structure, placeholders, contents, types = tables.split_table(html)
    assert structure == "<table><tr><td>[[VL_TABLE_0_0]][[VL_TABLE_0_1]]</td><td></td><td>[[VL_TABLE_2_0]]</td></tr></table>"
    assert placeholders == ["[[VL_TABLE_0_0]]", "[[VL_TABLE_0_1]]", "[[VL_TABLE_2_0]]"] and contents == ["a ", "x_1", "in"] and types == ["text", "equationinline", "text"]


def test_image_sizes():
    jpg = b"\xff\xd8\xff\xe1" + struct.pack(">H", 300) + bytes(298) + b"\xff\xc2" + struct.pack(">HBHH", 17, 8, 20, 30)
    lossy = b"RIFF\0\0\0\0WEBPVP8 " + bytes(10) + struct.pack("<HH", 16383 & 640, 480)
    bits = (99) | (49 << 14)
    lossless = b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + bits.to_bytes(4, "little")
    tiff = b"II*\0\x08\0\0\0\x02\0" + struct.pack("<HHIHH", 256, 3, 1, 70, 0) + struct.pack("<HHII", 257, 4, 1, 90)
    assert [images.size_of(x) for x in (jpg, lossy, lossless, tiff)] == [("jpg", 30, 20), ("webp", 640, 480), ("webp", 100, 50), ("tiff", 70, 90)]
    assert images.size_of_base64(base64.b64encode(jpg).decode()) == ("jpg", 30, 20)  # its size is beyond the first characters
    assert all(images.size_of(x[:n]) is None for x in (jpg, tiff) for n in range(len(x) - 8))
    assert images.size_of(b"") is None and images.size_of_base64("!!") is None


def boxes(rows):
    return [tuple(c / 1000 for c in b) for b in rows]


ONE = boxes([(100, 100 + i * 100, 900, 160 + i * 100) for i in range(5)])
TWO = boxes([(50 + c * 480, 100 + r * 150, 500 + c * 480, 200 + r * 150) for c in range(2) for r in range(3)])
TITLE = boxes([(50, 50, 960, 90), (50, 95, 960, 97)]) + TWO


@pytest.mark.parametrize("method", ["naive", "gap_tree", "xy_cut", "xy_cut_exp"])
def test_orders_of_plain_pages(method):
    kinds = ["title", "hline"] + ["paragraph"] * 6
    assert R.ordered(ONE, kinds[2:7], method, 1000, 1000) == [0, 1, 2, 3, 4]
    across = [0, 3, 1, 4, 2, 5]
    assert R.ordered(TWO, kinds[2:], method, 1000, 1000) == (across if method.startswith("xy") else [0, 1, 2, 3, 4, 5])
    assert R.ordered(TITLE, kinds, method, 1000, 1000)[:2] == [0, 1]
    same = [TWO[0]] * 4
    assert sorted(R.ordered(same, kinds, method, 1000, 1000) or range(4)) == [0, 1, 2, 3]
    assert R.ordered([], [], method, 1000, 1000) == [] and R.ordered(ONE[:1], kinds, method, 1000, 1000) == [0]
    with pytest.raises(ValueError):
        R.ordered(ONE, kinds, "other", 1000, 1000)


def test_orders_are_permutations():
    r = random.Random(3)
    for _ in range(300):
        n = r.randrange(2, 14)
        own = []
        for _ in range(n):
            x, y = r.randrange(20) * 40, r.randrange(20) * 40
            own.append((x, y, min(1000, x + r.randrange(1, 12) * 30), min(1000, y + r.randrange(1, 8) * 20)))
        own, kinds = boxes(own), r.choices(["paragraph", "hline", "group", "title", "pagebar", "pagenumber"], k=n)
        for method in ("naive", "gap_tree", "xy_cut", "xy_cut_exp"):
            for reverse in (False, True):
                out = R.ordered(own, kinds, method, 1000, 1000, reverse)
                assert out is None or sorted(out) == list(range(n))
        order, used = R.page_order(own, kinds, "xy_cut_exp", 1000, 1000, True)
        assert sorted(order) == list(range(n)) and used != "none"
        margin = [k in R.MARGIN for k in (kinds[i] for i in order)]
        assert not any(a and not b and kinds[order[k + 1]] != "hline" for k, (a, b) in enumerate(zip(margin, margin[1:])))


def test_snapped_edges_regions_and_corners():
    assert R.snapped([1, 3, 3, 9, 20, 24.5, 30]) == [3, 3, 3, 9, 22, 22, 30]
    assert [sorted(x.blocks) for x in R.regions(TITLE)] == [[0, 1], [2, 3, 4], [5, 6, 7]]
    assert R.corner_order([(0, 0), (2, 0), (2, 1), (0, 1), (1, 0.5)]) == [(0, 0), (2, 0), (2, 1), (0, 1)]
    turned = R.corner_order([(1, 0), (2, 1), (1, 2), (0, 1)])
    assert sorted((round(x, 6), round(y, 6)) for x, y in turned) == [(0, 1), (1, 0), (1, 2), (2, 1)]


def test_a_page_is_split_at_a_wide_group():
    page = boxes([(50, 50, 450, 100), (550, 50, 950, 100), (40, 300, 960, 400), (50, 500, 450, 550), (550, 500, 950, 550)])
    kinds = ["paragraph", "paragraph", "group", "paragraph", "paragraph"]
    assert R.page_splits(page, kinds, 1000, False) == (300, 400)
    assert R.ordered(page, kinds, "xy_cut_exp", 1000, 1000) == [0, 1, 2, 3, 4]


def test_nested_pages(spark):
    rows = [("t", 0, 0, "paragraph", 0.0, 0.0, 0.9, 0.1), ("t", 0, 1, "group", 0.1, 0.2, 0.9, 0.9), ("t", 0, 2, "image", 0.15, 0.25, 0.85, 0.6), ("t", 0, 3, "figure", 0.2, 0.3, 0.4, 0.5), ("t", 0, 4, "imagecaption", 0.2, 0.7, 0.8, 0.8)]
    df = spark.createDataFrame(rows, "token string, page int, block int, type string, x1 double, y1 double, x2 double, y2 double")
    got = {r.block: (r.path, r.type, r.subtree) for r in nesting.nested(df).collect()}
    assert got == {0: ([0], "paragraph", 1), 1: ([1], "group", 4), 2: ([1, 0], "image", 2), 3: ([1, 0, 0], "figure", 1), 4: ([1, 1], "imagecaption", 1)}
    twice = sorted((r.path, r.type, r.subtree) for r in nesting.nested(df, own_first=True).collect())
    assert ([1, 1], "group", 3) in twice and ([1, 1, 0], "image", 1) in twice and ([1], "group", 6) in twice
    assert nesting.nested(df.limit(0)).count() == 0


def test_images_of_sources(spark):
    raw = b"\x89PNG\r\n\x1a\n" + bytes(40)
    sources = ["data:image/jpeg;base64," + base64.b64encode(b"short").decode(), base64.b64encode(raw).decode(), base64.b64encode(raw[:20]).decode(), "no base64 at all!", "", None, "data:image/svg;base64," + base64.b64encode(raw).decode()]
    got = [r["d"] for r in spark.createDataFrame(list(enumerate(sources)), "k long, s string").orderBy("k").select(content.decoded(F.col("s")).alias("d")).collect()]
    assert [d and (bytes(d["raw"]), d["ext"]) for d in got] == [(b"short", "jpg"), (raw, "png"), None, None, None, None, (raw, "png")]


def test_signatures_and_entities(spark):
    import hashlib
    import hmac

    body = "a body é".encode()
    want = hmac.new(b"key", body, hashlib.sha256).hexdigest()
    df = spark.createDataFrame([(bytearray(body), "sha256=" + want), (bytearray(body), "sha256="), (bytearray(b""), None)], "b binary, s string")
    assert [r[0] for r in df.select(T.signed(F.col("s"), "key", F.col("b"))).collect()] == [True, False, False]


def test_sinks_write_what_they_say(spark, tmp_path):
    df = spark.createDataFrame([("t1", "doc", "[]", "line 1\nline 2", 5), ("t2", "", "[[]]", None, None)], "token string, stem string, pages_tree string, content string, n int")
    at = files.free_path(spark, str(tmp_path / "run"))
    assert {r.token: r.content_chars for r in files.parse_results(df, at).collect()} == {"t1": 13, "t2": 0}
    assert files.free_path(spark, at) == at + "_1"
    got = {(r.token, r.stem): r.value for r in spark.read.text(f"{at}/markdown", wholetext=True).collect()}
    assert got[("t1", "doc")].rstrip("\n") == "line 1\nline 2" and ("t2", "document") in got
    assert {r.token for r in spark.read.json(f"{at}/formatted_meta").collect()} == {"t1", "t2"}
    good = files.failures(df, F.when(F.col("content").isNull(), "no content"), f"{at}_errors")
    assert [r.token for r in good.collect()] == ["t1"] and [r.error for r in spark.read.json(f"{at}_errors").collect()] == ["no content"]
    files.json_arrays(spark.createDataFrame([("t", 1, "b"), ("t", 0, "a")], "token string, pos int, v string"), f"{at}_arrays")
    assert [json.loads(r.value) for r in spark.read.text(f"{at}_arrays").collect()] == [[{"v": "a"}, {"v": "b"}]]
    files.jsonl(df.select("token", "n"), f"{at}_lines")
    assert {r.value for r in spark.read.text(f"{at}_lines").collect()} == {'{"token":"t1","n":5}', '{"token":"t2","n":null}'}
    files.trigger_meta(spark.createDataFrame([("t", "url", "http://x")], "token string, input_type string, input string"), f"{at}_meta")
    files.documents(df, f"{at}_docs", "html")
    assert [r[0] for r in spark.createDataFrame([("a",), ("..",), ("a/b",), (None,)], "s string").select(files.is_plain_name(F.col("s"))).collect()] == [True, False, False, False]


def test_trees_of_deep_paths(spark):
    rows = [("t", 0, [0], "group", None, 1), ("t", 0, [0, 0], "group", None, 0), ("t", 0, [0, 0, 0], "paragraph", "deep", None), ("t", 0, [0, 1], "title", "last", 5), ("t", 0, [1], "paragraph", "after", 0)]
    df = spark.createDataFrame(rows, "token string, page int, path array<int>, type string, text string, ord int")
    assert {tuple(r.path): r.size for r in tree.subtree_sizes(df).collect()} == {(0,): 4, (0, 0): 2, (0, 0, 0): 1, (0, 1): 1, (1,): 1}
    assert [tuple(r.path) for r in tree.by_order(df).orderBy("n").collect()] == [(1,), (0,), (0, 0), (0, 0, 0), (0, 1)]
    assert {tuple(r.path): r.text for r in tree.contents(df).collect()}[(0,)] == "deep last"
    out = {tuple(r.path): r.text for r in tree.rendered(df, F.col("text"), F.col("type") == "group").collect()}
    assert out == {(): "deep\n\nlast\n\nafter", (0,): "deep\n\nlast", (0, 0): "deep"}
    assert sorted(tuple(r.path) for r in tree.collapsed(df, F.col("type") == "group").collect()) == [(0,), (0, 0), (0, 1), (1,)]
    one = spark.createDataFrame([("t", 0, [0], "image"), ("t", 0, [0, 0], "image"), ("t", 0, [0, 0, 0], "chart"), ("t", 0, [1], "image"), ("t", 0, [1, 0], "chart")], "token string, page int, path array<int>, type string")
    assert [(tuple(r.image), tuple(r.path)) for r in tree.wrapped(one).collect()] == [((0, 0), (0, 0, 0))]

"""Fill-in-middle ropes against plain slicing, the whole query against its SQL."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from folio.llm import fim

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def plain_version(doc_id, text):
    """By slicing lists of units."""
    text = text or ""
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[k : k + 8], 16) for k in (0, 8, 16, 24))
    units = UNIT.findall(text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def texts():
    r = random.Random(3)
    piece = ["word", "Ab", " ", "\n", "é", "ß", "漢", "𝒳", "<", ">", "P", "\r\n", "1", "́", "[", "`", "{", "@", "\x00"]
    out = [(k, "".join(r.choice(piece) for _ in range(r.choice([1, 2, 3, 40, 700, 3000])))) for k in range(120)]
    out += [(200, None), (201, ""), (None, "a null id"), (None, None), (202, "has <P> in it"), (203, "has <M>"), (204, "<S"), (205, "x" * 100_000), (206, "ab " * 60_000), (207, "<" * 50), (208, ">P<" * 40)]
    return out + [out[3], out[3], (3, "another text of one id")] + [(k, "tail <") for k in range(300, 340)]


def test_rope_splits_and_joins():
    r = random.Random(1)
    text = "".join(r.choice(["ab", " ", "é", "x1", "\n"]) for _ in range(20_000))
    units = UNIT.findall(text)

    def balanced(a):
        if isinstance(a, fim.Node):
            assert abs(a.left.height - a.right.height) <= 1 and a.units == a.left.units + a.right.units and a.chars == a.left.chars + a.right.chars
            balanced(a.left), balanced(a.right)
        elif a is not None:
            assert a.units == len(UNIT.findall(a.text))

    whole = fim.rope(text)
    assert whole.units == len(units) and whole.chars == len(text) and fim.text_of(whole) == text
    for _ in range(60):
        k, c = r.randrange(len(units) + 1), r.randrange(len(text) + 1)
        x, y = fim.split(whole, k)
        assert (fim.text_of(x), fim.text_of(y)) == ("".join(units[:k]), "".join(units[k:]))
        balanced(x), balanced(y), balanced(fim.join(y, fim.join(fim.sentinel("<P>"), x)))
        x, y = fim.split(whole, c, "chars")
        assert (fim.text_of(x), fim.text_of(y)) == (text[:c], text[c:])
        balanced(x), balanced(y)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("fim")
    df = spark.createDataFrame(texts(), "doc_id long, text string").select("*", *[F.lit(7).alias(c) for c in ("n", "form", "output", "h1", "restored")])
    df.repartition(3).write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_outputs_equal_slicing(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    made = fim.fill_in_middle(docs)
    want = sorted((d, *plain_version(d, t)) for d, t in texts() if d is not None)
    assert sorted(tuple(r) for r in made.where("doc_id is not null").collect()) == want
    assert made.where("doc_id is null").count() == 2
    told = fim.fill_back(made).collect()
    assert sorted((r.doc_id or -1, r.restored) for r in told) == sorted((d or -1, t or "") for d, t in texts())


def test_query_equals_sql(spark, table):
    con = duckdb.connect()
    for path, pattern in ((table, "/*.parquet"), ("/root/testdata/sf0.01", "")):
        con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{path}/documents.parquet{pattern}'")
        got = fim.op13_fim(spark, path)
        want = con.execute(fim.OP13_SQL)
        assert got.columns == [c[0] for c in want.description]
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fim.fill_back(fim.fill_in_middle(none)).collect() == []


def test_other_shares(spark):
    docs = spark.createDataFrame([(k, "one two three") for k in range(200)], "doc_id long, text string")
    assert {r.form for r in fim.fill_in_middle(docs, "9", 100, 100).collect()} == {"spm"}
    assert {r.form for r in fim.fill_in_middle(docs, "9", 0).collect()} == {"plain"}

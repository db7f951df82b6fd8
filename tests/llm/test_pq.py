"""Vector codes against a plain version that compares all entries, and against SQL."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import pq

NAN, INF = float("nan"), float("inf")


def plain_search(x, book):
    d = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c)) for c in book] for v in x]
    return [min(range(len(book)), key=lambda k: (r[k], k)) for r in d], [min(r) for r in d]


def plain_version(rows):
    """Codes, errors and the codebooks' hash by Python's integers. rows: vec_id, embedding, label."""
    kept = [(i, [int(np.floor(1024 * np.float64(np.float32(e)))) for e in v], label) for i, v, label in rows if v is not None and all(e is not None and np.isfinite(e) for e in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // 4
    parts = [[v[p * w : (p + 1) * w] for _, v, _ in kept] for p in range(4)]
    books = [[list(v) for v in x[:256]] for x in parts]
    for _ in range(4):
        for x, book in zip(parts, books):
            at, _ = plain_search(x, book)
            for e in set(at):
                own = [v for v, k in zip(x, at) if k == e]
                book[e] = [sum(c) // len(own) for c in zip(*own)]
    found = [plain_search(x, book) for x, book in zip(parts, books)]
    errors = [sum(f[1][k] for f in found) for k in range(len(kept))]
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    fits = lambda e: e if e < 1 << 63 else None
    errors, by_label = list(map(fits, errors)), {k: fits(e) for k, e in by_label.items()}
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(i, "".join(f"{f[0][k]:02x}" for f in found), errors[k], by_label[label], sha) for k, (i, _, label) in enumerate(kept)]


def test_partial_distances_find_the_nearest():
    r = np.random.default_rng(2)
    for k, w, high in ((1, 3, 5), (2, 1, 2), (256, 16, 300), (300, 7, 2), (100, 2, 3)):
        x, book = r.integers(-high, high, (700, w)), r.integers(-high, high, (k, w))
        at, best = pq.search(x, book)
        assert (at.tolist(), best.tolist()) == tuple(plain_search(x, book))
    x, book = r.integers(-(1 << 62), 1 << 62, (50, 4)), r.integers(-(1 << 62), 1 << 62, (9, 4))
    codes, errors = pq.encode(x, [book])
    assert (codes[:, 0].tolist(), errors[:, 0].tolist()) == tuple(plain_search(x, book))


def written(spark, path, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").select("*", *[F.lit(1).alias(c) for c in ("_label", "error", "n", "vector")])
    df.repartition(3).write.parquet(str(path / "embeddings.parquet"))
    return str(path)


def odd_rows(n, dims):
    r = random.Random(n)
    vector = lambda: [round(r.uniform(-1, 1), 2) for _ in range(dims)]
    rows = [(i, vector(), r.choice([0, 1, None])) for i in range(n)]
    rows += [(n, None, 0), (n + 1, [None] * dims, 0), (n + 2, [NAN, *[0.0] * (dims - 1)], 1), (n + 3, [INF, *[0.5] * (dims - 1)], 1)]
    # copies of one vector, a repeated row, a repeated and a null id
    return rows + [(n + 10 + k, rows[5][1], 1) for k in range(40)] + [rows[7], rows[7], (8, vector(), 0), (None, vector(), 0)]


@pytest.mark.parametrize("n", [1, 20, 400])
def test_query_equals_plain_version(spark, tmp_path, n):
    rows = odd_rows(max(n, 10), 8) if n > 1 else [(5, [0.25, -0.5, 1.0, 0.0], None)]
    got = pq.op11_codes(spark, written(spark, tmp_path, rows))
    assert got.columns[:5] == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain_version(rows)))


def test_other_lengths_and_large_components(spark, tmp_path):
    """The commonest length that four parts divide is coded; large components stay exact."""
    rows = [(i, [float(i), 3e12 * i, -2.5, 1.0], i % 2) for i in range(300)] + [(1000 + i, [1.0] * 6, 0) for i in range(400)] + [(2000, [], 0), (2001, [1.0] * 8, 0)]
    got = pq.op11_codes(spark, written(spark, tmp_path, rows)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_version(rows[:300])))


def test_empty_tables(spark, tmp_path):
    got = pq.op11_codes(spark, written(spark, tmp_path, [(1, None, 0), (2, [], 0), (3, [1.0], 0)]))
    assert got.collect() == [] and [t for _, t in got.dtypes] == ["bigint", "string", "bigint", "bigint", "string"]


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    got, want = pq.op11_codes(spark, "/root/testdata/sf0.01"), con.execute(pq.OP11_SQL)
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())

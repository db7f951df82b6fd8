"""Vector code compression: each part of a vector becomes the number of its nearest codebook entry, in integers throughout.

Codebooks start as parts of the smallest ids' vectors and are moved by rounds of assigning and averaging. The table is
read once a round; what leaves a task is a sum and a count for each entry, and what the driver holds is the codebooks
(ENTRIES entries of each part, whatever the table's size), which every task gets with its code.

The nearest entry is found by partial distances: a part's positions are taken in descending order of the codebook's
variance, the squared differences are summed position by position for many vectors and entries at once, and masks drop
an entry for a vector as soon as its sum is strictly above the vector's best whole distance so far. Entries that reach
the best distance stay, so ties go to the lower index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import lookup, stored, table

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Vectors that are searched at a time; entries of a block, after which best distances are renewed.
STEP, BLOCK = 1024, 64
#: One of so many positions is summed for all entries before the first mask; from there on sums are of pairs that are left.
DENSE = 2
#: Below this no sum of squares of a part's positions can leave 64 bits; larger components are worked on as Python's integers.
SAFE = 1 << 24
_FULL = (1 << 63) - 1

Codebooks = list[np.ndarray]


def whole_vectors(vectors: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    return vectors.isNotNull() & ~F.exists(vectors, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))


def scaled(vectors: Column, by: int) -> Column:
    """floor(by * x) of each component; beyond 64 bits the largest or smallest integer of 64 bits."""
    return F.transform(vectors, lambda e: F.floor(e.cast("double") * by).cast("long"))


def search(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x (n, w) the index of the nearest row of `book` (k, w), ties to the lower one, and the squared
    distance to it."""
    n, (k, w) = len(x), book.shape
    if not w:
        return np.zeros(n, np.int64), np.zeros(n, x.dtype)
    place = np.argsort(-(book - book.mean(0)).astype(np.float64).var(0), kind="stable") if k else np.arange(w)
    x, book = x[:, place], book[:, place]
    # a whole distance to begin with: that of the entry which is nearest in the first position
    order = np.argsort(book[:, 0], kind="stable")
    at = order[np.minimum(np.searchsorted(book[order, 0], x[:, 0]), k - 1)]
    best = ((x - book[at]) ** 2).sum(1, dtype=x.dtype if x.dtype != object else None)
    rows, dense = np.arange(n), max(1, w // DENSE)
    for a in range(0, k, BLOCK):
        block = book[a : a + BLOCK]
        total = np.zeros((n, len(block)), x.dtype)
        for p in range(dense):
            part = x[:, p, None] - block[None, :, p]
            part *= part
            total += part
        # the whole distance of the entry that is nearest so far bounds the others
        near = total.argmin(1)
        whole = total[rows, near] + ((x[:, dense:] - block[near, dense:]) ** 2).sum(1, dtype=x.dtype if x.dtype != object else None)
        better = (whole < best) | ((whole == best) & (near + a < at))
        best[better], at[better] = whole[better], near[better] + a
        i, j = np.nonzero(total <= best[:, None])
        total = total[i, j]
        for p in range(dense, w):
            total = total + (x[i, p] - block[j, p]) ** 2
            stay = total <= best[i]
            if not stay.all():
                i, j, total = i[stay], j[stay], total[stay]
        # of each row's survivors the smallest sum, then the smallest entry; they stand by row and entry
        least = np.lexsort((j, total, i)) if x.dtype != object else np.array(sorted(range(len(i)), key=lambda c: (i[c], total[c], j[c])), np.int64)
        first = least[np.append(True, i[least][1:] != i[least][:-1])[: len(least)]]
        r, e, d = i[first], j[first] + a, total[first]
        better = (d < best[r]) | ((d == best[r]) & (e < at[r]))
        best[r[better]], at[r[better]] = d[better], e[better]
    return at, best


def largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min())))


def encode(x: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, parts) and squared distances (n, parts) of rows of components."""
    codes, errors, a = [], [], 0
    for book in books:
        own = x[:, a : a + book.shape[1]]
        a += book.shape[1]
        most = max(largest(own), largest(book)) if own.size else 0
        if most >= SAFE:
            own, book = own.astype(object), book.astype(object)
        elif 4 * most * most * book.shape[1] < 1 << 31:
            own, book = own.astype(np.int32), book.astype(np.int32)
        found = [search(own[k : k + STEP], book) for k in range(0, len(own), STEP)]
        codes.append(np.concatenate([f[0] for f in found] or [np.zeros(0, np.int64)]))
        error = np.concatenate([f[1] for f in found] or [np.zeros(0, own.dtype)])
        errors.append(error if error.dtype == object else error.astype(np.int64))
    return np.stack(codes, 1), np.stack(errors, 1)


def _rows(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def first_books(vectors: DataFrame, parts: int, entries: int) -> Codebooks:
    """The parts of the vectors with the smallest ids (null last, then by their components): `entries` rows at most."""
    rows = vectors.orderBy(F.col("vec_id").isNull(), "vec_id", "vector").select("vector").limit(entries).collect()
    return [np.ascontiguousarray(b) for b in np.split(np.array([r.vector for r in rows], np.int64), parts, axis=1)]


def moved(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry replaced by the componentwise floor of the mean of the parts that it is nearest to; unused ones stay.

    A task adds up its own rows; of each entry and task one row is shuffled, with sums of up to 38 digits."""
    width, dims = max(b.shape[1] for b in books), sum(b.shape[1] for b in books)
    names = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros(b.shape, object) for b in books]
        for batch in batches:
            x = _rows(batch.column(0), dims)
            codes, a = encode(x, books)[0], 0
            for p, book in enumerate(books):
                own = x[:, a : a + book.shape[1]]
                a += book.shape[1]
                sums = np.zeros(book.shape, np.int64 if not own.size or largest(own) < SAFE else object)
                np.add.at(sums, codes[:, p], own)
                total[p] += sums.astype(object)
                count[p] += np.bincount(codes[:, p], minlength=len(book))
        rows = [{"part": p, "entry": int(e), "n": int(count[p][e]), "sums": [Decimal(int(v)) for v in total[p][e]]} for p in range(len(books)) for e in np.flatnonzero(count[p])]
        yield pa.RecordBatch.from_pylist(rows, names)

    summed = vectors.select("vector").mapInArrow(run, "part int, entry int, n long, sums array<decimal(38,0)>").groupBy("part", "entry")
    out = [b.copy() for b in books]
    for r in summed.agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(width)]).collect():
        out[r.part][r.entry] = [int(r[f"s{k}"]) // r.n for k in range(out[r.part].shape[1])]
    return out


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """The codebooks of `vectors` (vec_id, vector: array<long>, all of one length that `parts` divides); every row counts."""
    books = first_books(vectors, parts, entries)
    for _ in range(rounds):
        books = moved(vectors, books)
    return books


def codes(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """`vectors` with `code` (two hex digits for each part) and `error` (squared distances summed over parts; null where
    it leaves 64 bits) in place of vector."""
    kept = [c for c in vectors.columns if c != "vector"]
    types = dict(vectors.dtypes)
    dims = sum(b.shape[1] for b in books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = encode(_rows(batch.column(0), dims), books)
            whole = [e if e <= _FULL else None for e in map(sum, error.astype(object).tolist())]
            hexed = [bytes(r).hex() for r in code.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(hexed, pa.string()), pa.array(whole, pa.int64())], names=[*kept, "code", "error"])

    return vectors.select("vector", *kept).mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in kept) + ", code string, error long")


def books_text(books: Codebooks) -> str:
    """All entries' components by part, entry and position."""
    return ",".join(str(int(x)) for b in books for x in b.ravel())


def kept_vectors(rows: DataFrame, parts: int = PARTS, by: int = 1024) -> DataFrame:
    """vec_id, label, vector of those `rows` (vec_id, embedding, label) that can be coded, written to the shared folder.

    Left out are vectors that are null or hold a null or non-finite component. Codebooks need one length that `parts`
    divides: the commonest such length (of equally common ones the largest) is taken, rows of other lengths are left
    out. Repeated rows and null ids stay, each a row of its own."""
    whole = stored(rows.where(whole_vectors(F.col("embedding"))).select("vec_id", "label", scaled(F.col("embedding"), by).alias("vector")), "vectors")
    size = whole.groupBy(F.size("vector").alias("d")).count().where((F.col("d") % parts == 0) & (F.col("d") > 0)).orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return whole.where(F.size("vector") == (size[0].d if size else -1))


def compressed(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, code, error, label_error (error summed over equal labels, nulls together; null where it leaves 64 bits or an
    error does). A label may hold any share of the rows: its sum is taken by tasks first and its rows are dealt when it
    is joined."""
    coded = stored(codes(vectors, books).withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null"))), "codes")
    total = F.when(F.count("error") == F.count(F.lit(1)), F.sum(F.col("error").cast("decimal(19,0)")).try_cast("long"))
    sums = coded.groupBy("_label").agg(total.alias("label_error"), F.count(F.lit(1)).alias("_n"))
    return lookup(coded, sums.select("_label", "label_error"), "_label", sums).select("vec_id", "code", "error", "label_error")


def op11_codes(spark, sf_dir):
    """Every kept vector's code and error by codebooks of four rounds over all of them. An empty table has no row."""
    vectors = kept_vectors(table(spark, sf_dir, "embeddings"))
    if not vectors.limit(1).count():
        return vectors.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    books = fit(vectors)
    return compressed(vectors, books).withColumn("codebooks_sha256", F.lit(hashlib.sha256(books_text(books).encode()).hexdigest()))


def _sql() -> str:
    """The rounds as a chain of materialised tables."""
    assign = """a{r} AS MATERIALIZED (
  SELECT x.vec_id, x.p, any_value(x.x) AS x, min(list_sum(list_transform(list_zip(x.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 256 + c.e) AS best
  FROM parts x JOIN c{r} c USING (p) GROUP BY x.vec_id, x.p
)"""
    move = """s{r} AS MATERIALIZED (
  SELECT p, e, list(m ORDER BY i) AS c FROM (
    SELECT p, e, i, CAST(floor(sum(v) / count(*)) AS BIGINT) AS m
    FROM (SELECT p, CAST(best % 256 AS INTEGER) AS e, unnest(x) AS v, unnest(range(len(x))) AS i FROM a{r}) GROUP BY p, e, i
  ) GROUP BY p, e
), c{n} AS MATERIALIZED (
  SELECT c.p, c.e, coalesce(s.c, c.c) AS c FROM c{r} c LEFT JOIN s{r} s ON s.p = c.p AND s.e = c.e
)"""
    head = """k AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, p, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] AS x FROM k, (SELECT unnest(range(4)) AS p)
), c0 AS MATERIALIZED (
  SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS INTEGER) AS e, x AS c FROM parts QUALIFY e < 256
)"""
    steps = [head, *[step for r in range(ROUNDS) for step in (assign.format(r=r), move.format(r=r, n=r + 1))], assign.format(r=ROUNDS)]
    return "WITH " + ", ".join(steps) + f""", coded AS (
  SELECT vec_id, string_agg(lower(printf('%02x', CAST(best % 256 AS INTEGER))), '' ORDER BY p) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id
), sha AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN k USING (vec_id), sha
"""


#: One row for each vec_id, all of one length, as in the given tables.
OP11_SQL = _sql()

"""Fill-in-middle: a text is cut at two units, its parts are put in another order with sentinels, and it is restored.

A unit is a run of ASCII letters or any other single code point. A text is a rope, a balanced tree whose leaves hold
pieces of it and whose nodes cache units and code points. The cuts split the tree by rank in units; the parts are joined
again with sentinels as leaves of their own. The inverse finds the sentinels, splits the output's tree by rank in code
points, and joins the parts in their first order. A split or join touches a path of the tree and one leaf.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: the sentinels of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents, from this on plain; of the others below this suffix first.
PLAIN_FROM, SPM_BELOW = 90, 20
#: Units of a leaf at most; code points given to the JVM at a time, about.
LEAF, STEP = 512, 1 << 21


def unit_starts(text: str) -> np.ndarray:
    """The code points at which units start."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    letter = ((points | np.uint32(32)) - np.uint32(97)) < 26
    start = ~letter
    start[:1] = True
    start[1:] |= letter[1:] & ~letter[:-1]
    return np.flatnonzero(start)


class Leaf:
    __slots__ = ("chars", "text", "units")
    height = 0

    def __init__(self, text: str, units: int):
        self.text, self.units, self.chars = text, units, len(text)


class Node:
    __slots__ = ("chars", "height", "left", "right", "units")

    def __init__(self, left: Rope, right: Rope):
        self.left, self.right = left, right
        self.units, self.chars = left.units + right.units, left.chars + right.chars
        self.height = 1 + max(left.height, right.height)


#: None is the empty rope.
Rope = Leaf | Node | None


def rope(text: str) -> Rope:
    """A balanced tree of leaves of LEAF units."""
    start = unit_starts(text)
    edges = [*start[::LEAF].tolist(), len(text)]
    level: list = [Leaf(text[a:b], min(LEAF, len(start) - k * LEAF)) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    while len(level) > 1:
        level = [Node(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0] if level else None


def join(a: Rope, b: Rope) -> Rope:
    """One after the other; the heights of two siblings differ by one at most. No unit may go on from a to b."""
    if a is None or b is None:
        return a or b
    if a.height > b.height + 1:
        inner = join(a.right, b)
        if inner.height <= a.left.height + 1:
            return Node(a.left, inner)
        if inner.right.height >= inner.left.height:
            return Node(Node(a.left, inner.left), inner.right)
        return Node(Node(a.left, inner.left.left), Node(inner.left.right, inner.right))
    if b.height > a.height + 1:
        inner = join(a, b.left)
        if inner.height <= b.right.height + 1:
            return Node(inner, b.right)
        if inner.left.height >= inner.right.height:
            return Node(inner.left, Node(inner.right, b.right))
        return Node(Node(inner.left, inner.right.left), Node(inner.right.right, b.right))
    return Node(a, b)


def split(a: Rope, rank: int, by: str = "units") -> tuple[Rope, Rope]:
    """The first `rank` units, or code points with by="chars", and the rest."""
    if a is None or rank <= 0:
        return None, a
    if rank >= getattr(a, by):
        return a, None
    if isinstance(a, Leaf):
        start = unit_starts(a.text)
        at = int(start[rank]) if by == "units" else rank
        before = int(np.searchsorted(start, at))
        # a unit that code points cut in two counts on both sides
        inside = before == len(start) or start[before] != at
        return Leaf(a.text[:at], before), Leaf(a.text[at:], a.units - before + inside)
    here = getattr(a.left, by)
    if rank < here:
        x, y = split(a.left, rank, by)
        return x, join(y, a.right)
    x, y = split(a.right, rank - here, by)
    return join(a.left, x), y


def text_of(a: Rope) -> str:
    out, todo = [], [a] if a else []
    while todo:
        x = todo.pop()
        if isinstance(x, Leaf):
            out.append(x.text)
        else:
            todo += [x.right, x.left]
    return "".join(out)


def sentinel(mark: str) -> Leaf:
    return Leaf(mark, len(unit_starts(mark)))


def arrange(text: str, one: int, two: int, plain: bool, suffix_first: bool) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle (None if plain), output. one, two: cut after so many units, of the
    number of places that there are."""
    whole = rope(text)
    n = whole.units if whole else 0
    if not text or plain or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, last = sorted((one % (n + 1), two % (n + 1)))
    head, rest = split(whole, first)
    middle, tail = split(rest, last - first)
    parts = ((SUFFIX, tail), (PREFIX, head), (MIDDLE, middle)) if suffix_first else ((PREFIX, head), (SUFFIX, tail), (MIDDLE, middle))
    out = None
    for mark, part in parts:
        out = join(join(out, sentinel(mark)), part)
    return n, "spm" if suffix_first else "psm", head.chars if head else 0, middle.chars if middle else 0, text_of(out)


def restore(output: str, form: str) -> str:
    """The text that `arrange` was given."""
    if form == "plain":
        return output
    rest, done, parts = rope(output), 0, {}
    marks = (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE)
    for mark, following in zip(marks, (*marks[1:], None)):
        _, rest = split(rest, len(mark), "chars")
        done += len(mark)
        end = output.index(following, done) if following else len(output)
        parts[mark], rest = split(rest, end - done, "chars")
        done = end
    return text_of(join(join(parts[PREFIX], parts[MIDDLE]), parts[SUFFIX]))


def draws(doc_id: Column, seed: str) -> list[Column]:
    """Four unsigned 32-bit integers of a document: those that its id's hash begins with; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: str = "1", plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (null if plain), output, for every row of `docs` (doc_id, text;
    further columns are not read).

    Null text is empty and stays plain, as do texts that hold a sentinel. Rows that share a doc_id share its draws, and
    each is reported; null doc_ids count as an empty id. Texts are worked on one by one, whatever their length, so a
    task holds a batch of them and one rope. An empty table gives an empty result.
    """
    names = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cuts = batch.column(0).to_pylist(), [batch.column(k).to_numpy() for k in range(2, 6)]
            out, held = [], 0
            for k in range(batch.num_rows):
                h1, h2, h3, h4 = (int(c[k]) for c in cuts)
                text = batch.column(1)[k].as_py()
                out.append((ids[k], *arrange(text, h1, h2, h3 % 100 >= plain_from, h4 % 100 < spm_below)))
                held += len(text)
                if held >= STEP:
                    yield columns(out, names)
                    out, held = [], 0
            if out:
                yield columns(out, names)

    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *[h.alias(f"h{k}") for k, h in enumerate(draws(F.col("doc_id").cast("long"), seed))])
    return numbered.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def columns(rows: list[tuple], names: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), names)], schema=names)


def fill_back(arranged: DataFrame) -> DataFrame:
    """`arranged`, the rows of `fill_in_middle`, with `restored` in place of output, read from output and form alone."""
    kept = [c for c in arranged.columns if c not in ("output", "form")]
    kind = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    types = dict(arranged.dtypes)
    names = pa.schema([(c, kind[types[c]]) for c in ["form", *kept]] + [("restored", pa.string())])
    schema = ", ".join(f"`{c}` {types[c]}" for c in ["form", *kept]) + ", restored string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, out, held = 0, [], 0
            for k in range(batch.num_rows):
                out.append(restore(batch.column(0)[k].as_py(), batch.column(1)[k].as_py()))
                held += len(out[-1])
                if held >= STEP or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([c.slice(a, len(out)) for c in batch.columns[1:]] + [pa.array(out, pa.string())], schema=names)
                    a, out, held = k + 1, [], 0

    return arranged.select("output", "form", *kept).mapInArrow(run, schema)


def op13_fim(spark, sf_dir):
    """Every document's form, cuts, and the hashes of its output and of what is restored from it."""
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    told = fill_back(made.withColumn("output_sha256", F.sha2("output", 256)))
    return told.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2("restored", 256).alias("restored_sha256"))


OP13_SQL = """
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents
), u AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, CAST('0x' || x[1:8] AS UBIGINT) AS h1,
    CAST('0x' || x[9:16] AS UBIGINT) AS h2, CAST('0x' || x[17:24] AS UBIGINT) AS h3, CAST('0x' || x[25:32] AS UBIGINT) AS h4 FROM h
), c AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, CAST(least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS BIGINT) AS a,
    CAST(greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS BIGINT) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
         WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT doc_id, n, form, text, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""

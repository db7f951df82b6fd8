"""Parsed documents in JSON (a page tree, alone or in an envelope) as rows: one for each node.

Trees are walked on Arrow batches, a document at a time, and rows leave as they fill a batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.sources.batches import bounded

# The key that decides a node's kind, in this order; where its text is.
KINDS = {"reactions": "expression", "placeholders": "table", "markush": "molecule", "data": "chart", "desc": "figure", "latex_repr": "equation", "text": "textual", "items": "group"}
TEXTS = {"chart": "data", "figure": "desc", "equation": "latex_repr", "textual": "text", "molecule": "smi"}
NODE = "token string, page int, path string, parent string, depth int, block int, type string, kind string, ord int, subtree int, x1 double, y1 double, x2 double, y2 double, text string, error string"
FIELDS = [f.split()[0] for f in NODE.split(", ")]
TEXT = FIELDS.index("text")
#: Rows, and characters of text, of a batch that leaves a task.
BATCH, CHARS = 10_000, 1 << 20


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """token (file name without .json) and raw, a row for each file."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.json)?$", 1).alias("token"), F.col("value").alias("raw"))


def kind_of(node: dict) -> str:
    """By the first deciding key that is there, null or not; `layout` without one."""
    return next((kind for key, kind in KINDS.items() if key in node), "layout")


def _box(node: dict) -> list:
    b = node.get("bbox")
    if isinstance(b, dict):
        b = [b.get(k) for k in ("x1", "y1", "x2", "y2")]
    return b if isinstance(b, list) and len(b) == 4 else [None] * 4


def walk(token: str, raw: str | None, by_order: bool = False) -> Iterator[list]:
    """Rows of NODE in depth-first order; with `by_order` siblings go by their `order` (those without last).

    What is no JSON, has no page tree, or isn't a list of lists of objects gives one row with an `error` only.
    """
    fail = lambda why: [token, *[None] * (len(FIELDS) - 2), why]
    try:
        tree = json.loads(raw or "")
    except ValueError:
        yield fail("not JSON")
        return
    if isinstance(tree, dict):
        if "pages_tree" not in tree:
            yield fail("no pages_tree")
            return
        tree = tree["pages_tree"]
    if not isinstance(tree, list) or not all(isinstance(p, list) and all(isinstance(n, dict) for n in p) for p in tree):
        yield fail("not a list of pages")
        return
    for page, top in enumerate(tree):
        rows: list[list] = []
        todo: list[tuple] = []

        def push(nodes: list, parent: str | None, depth: int, up: int | None) -> None:
            named = [(f"{parent}/{k}" if parent is not None else str(k), n) for k, n in enumerate(nodes) if isinstance(n, dict)]
            if by_order:
                named.sort(key=lambda pn: pn[1]["order"] if isinstance(pn[1].get("order"), int) else 10**9)
            todo.extend((p, n, parent, depth, up) for p, n in reversed(named))

        push(top, None, 0, None)
        ups: list[int | None] = []
        while todo:
            path, node, parent, depth, up = todo.pop()
            kind = kind_of(node)
            text = node.get(TEXTS.get(kind, ""))
            rows.append([token, page, path, parent, depth, node.get("block"), node.get("type"), kind, node.get("order"), 1, *_box(node), text if isinstance(text, str) else None, None])
            ups.append(up)
            if kind == "group" and isinstance(node["items"], list):
                push(node["items"], path, depth + 1, len(rows) - 1)
        for k in range(len(rows) - 1, -1, -1):  # parents come before their children
            if ups[k] is not None:
                rows[ups[k]][9] += rows[k][9]
        yield from rows


def nodes(documents: DataFrame, by_order: bool = False) -> DataFrame:
    """Columns of NODE for documents (token, raw); `path` and `parent` are places among siblings, `subtree` counts the
    node and all below it. Wrong documents are kept as rows with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[list] = []
        size = 0
        for batch in batches:
            for token, raw in zip(batch["token"], batch["raw"]):
                for row in walk(token, raw, by_order):
                    held.append(row)
                    size += len(row[TEXT] or "")
                    if len(held) >= BATCH or size >= CHARS:
                        yield pd.DataFrame(held, columns=FIELDS).astype(object)
                        held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=FIELDS).astype(object)

    bounded(documents.sparkSession)
    return documents.select("token", "raw").mapInPandas(run, NODE)

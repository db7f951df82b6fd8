"""HTML tables: cells to rows, and cells to placeholders with inline spans. Parsing runs on Arrow batches."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator, Sequence
from html.parser import HTMLParser
from itertools import groupby, islice, takewhile

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.spans import EQUATION, LATEX_MARK, MOLECULE, SPAN, TEXT
from folio.sources.batches import BATCH_BYTES, bounded

#: Cells of a batch that leaves a task.
ROWS = 10_000
CELLS = "table_nr int, row_nr int, col_nr int, is_header boolean, text string"
SPLIT = "structure string, placeholders array<string>, contents array<string>, types array<string>"
#: A table filled in these formats, and for the question/answer list.
FORMS = ("plain", "markdown", "html", "qa")
_SPAN, _MARK = re.compile(f"({SPAN[4:]})", re.DOTALL), re.compile(LATEX_MARK)
_FRAMES = {"***": (3, 3, MOLECULE), "<code>": (6, 7, MOLECULE), "`": (1, 1, MOLECULE), "\\": (2, 2, EQUATION), "$$": (2, 2, EQUATION), "$": (1, 1, EQUATION)}


def spans(text: str) -> list[tuple[str, str]]:
    """`inline_spans` of one text in Python, for text inside a parsed document."""
    out: list[tuple[str, str]] = []
    for k, part in enumerate(_SPAN.split(text)):
        kind, content = TEXT, part
        if k % 2:
            front, back, found = next(f for start, f in _FRAMES.items() if part.startswith(start))
            inner = part[front : len(part) - back]
            if not part.startswith("$") or _MARK.search(inner):
                kind, content = found, inner.strip()
        if kind == TEXT and out and out[-1][1] == TEXT:
            out[-1] = (out[-1][0] + content, TEXT)
        elif content or kind != TEXT:
            out.append((content, kind))
    return out


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


#: Tags without attributes; elements whose content isn't read as tags; references that any reader reads alike.
_TAG, _RAW = re.compile(r"<(/?)([a-z][a-z0-9]*)>"), re.compile(r"<(?:script|style|textarea|title|xmp|iframe|noembed|noframes|noscript|plaintext)\b", re.IGNORECASE)
_ODD = re.compile(r"&(?!(?:[a-zA-Z][a-zA-Z0-9]*|#[0-9]+|#[xX][0-9a-fA-F]+);)")


def _plain(source: str, tags: int) -> bool:
    """Whether a document's marks are its so many plain tags, and references that end."""
    return tags == source.count("<") and not _RAW.search(source) and not _ODD.search(source)


def inner_text(source: str) -> str:
    """Text of HTML without its tags."""
    if "<" not in source:
        return html.unescape(source)
    if _plain(source, len(_TAG.findall(source))):
        return html.unescape(_TAG.sub("", source))
    p = _Text()
    p.feed(source)
    p.close()
    return "".join(p.parts)


class _Tags(HTMLParser):
    """Calls `started` (tag, attributes, start, end) and `ended` (tag, start) for the tags of a document."""

    def __init__(self, source: str, started: Callable, ended: Callable) -> None:
        super().__init__(convert_charrefs=False)
        self.started, self.ended, self.lines = started, ended, [0]
        for line in source.split("\n"):
            self.lines.append(self.lines[-1] + len(line) + 1)
        self.feed(source)
        self.close()

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag: str, attrs: list) -> None:
        at = self._at()
        self.started(tag, attrs, at, at + len(self.get_starttag_text() or ""))

    def handle_endtag(self, tag: str) -> None:
        self.ended(tag, self._at())


class _Cells:
    """Where the outermost cells of a document begin and end, with their tables, rows, spans and header marks. Where every
    mark is a plain tag, tags are found by one expression; else HTML's parser finds them."""

    def __init__(self, source: str) -> None:
        self.cells: list[dict] = []
        self.table, self.row, self.head = -1, -1, False
        self.open: dict | None = None
        self.inside: list[str] = []
        found = list(_TAG.finditer(source))
        if _plain(source, len(found)):
            for m in found:
                if m[1]:
                    self._ended(m[2], m.start())
                else:
                    self._started(m[2], (), m.start(), m.end())
        else:
            _Tags(source, self._started, self._ended)
        self._end(len(source))

    def _end(self, at: int) -> None:
        if self.open:
            self.open["end"] = at
            self.cells.append(self.open)
            self.open = None
            self.inside = []

    def _started(self, tag: str, attrs: Sequence, at: int, end: int) -> None:
        if self.open and tag == "table":
            self.inside.append(tag)
        if self.inside:
            return
        if tag == "table":
            self.table, self.row, self.head = self.table + 1, -1, False
        elif tag == "thead":
            self.head = True
        elif tag in ("tbody", "tfoot"):
            self._end(at)
            self.head = False
        elif tag == "tr":
            self._end(at)
            self.row += 1
        elif tag in ("td", "th"):
            self._end(at)
            self.open = {"table": self.table, "row": self.row, "tag": tag, "head": self.head, "rows": 1, "cols": 1, "start": end}
            if attrs:
                given = dict(attrs)
                many = lambda key: max(1, int(given[key])) if (given.get(key) or "").isdigit() else 1
                self.open |= {"rows": many("rowspan"), "cols": many("colspan")}

    def _ended(self, tag: str, at: int) -> None:
        if self.inside:
            if tag == self.inside[-1]:
                self.inside.pop()
            return
        if tag in ("td", "th", "tr", "table", "thead", "tbody", "tfoot"):
            self._end(at)
        if tag == "thead":
            self.head = False


def cells(source: str) -> Iterator[tuple[int, int, int, bool, str]]:
    """(table, row, column, header, text) of all cells, spans over rows and columns repeated, short rows filled up with
    empty cells. Header rows are those of a thead, and rows of th alone at a table's top; without any, the first row."""
    found = _Cells(source)
    tables: dict[int, dict[int, list[dict]]] = {}
    for c in found.cells:
        if c["table"] >= 0 and c["row"] >= 0:
            tables.setdefault(c["table"], {}).setdefault(c["row"], []).append(c)
    for number, rows in tables.items():
        grid: dict[tuple[int, int], str] = {}
        heads: list[bool] = []
        for r, row in enumerate(rows.values()):
            at = 0
            heads.append(all(c["head"] for c in row) or all(c["tag"] == "th" for c in row) and all(heads))
            for c in row:
                while (r, at) in grid:
                    at += 1
                text = " ".join(inner_text(source[c["start"] : c["end"]]).split())
                if c["rows"] == c["cols"] == 1:
                    grid[r, at] = text
                else:
                    grid |= {(r + y, at + x): text for y in range(c["rows"]) for x in range(c["cols"])}
                at += c["cols"]
        if not any(heads):
            heads[0] = True
        wide = max(x for _, x in grid) + 1
        for r in range(max(y for y, _ in grid) + 1):
            for x in range(wide):
                yield number, r, x, r < len(heads) and heads[r], grid.get((r, x), "")


def _cut(source: str) -> tuple[list[str], list[list[tuple[str, str]]]]:
    """The HTML around cells (one piece more than cells), and each cell's spans: content and type."""
    around, cut, at = [], [], 0
    for c in _Cells(source).cells:
        around.append(source[at : c["start"]])
        cut.append([(inner_text(content) if kind == TEXT else html.unescape(content), kind) for content, kind in spans(source[c["start"] : c["end"]])])
        at = c["end"]
    return [*around, source[at:]], cut


def _joined(around: list[str], inside: list[list[str]]) -> str:
    return "".join([part for piece, texts in zip(around, inside) for part in (piece, *texts)] + around[-1:])


def _split(around: list[str], cut: list[list[tuple[str, str]]]) -> tuple[str, list[str], list[str], list[str]]:
    inside = [[f"[[VL_TABLE_{nth}_{k}]]" for k in range(len(own))] for nth, own in enumerate(cut)]
    placeholders = [p for own in inside for p in own]
    return _joined(around, inside), placeholders, [content for own in cut for content, _ in own], [kind for own in cut for _, kind in own]


def split_table(source: str) -> tuple[str, list[str], list[str], list[str]]:
    """A table's HTML with placeholders for its cells' spans, and placeholders, contents and types. A table inside a cell
    counts as that cell's text."""
    return _split(*_cut(source))


def shown(content: str, kind: str) -> tuple[str, ...]:
    """One span in each of FORMS, as text of HTML: `format_span`, escaped outside html, and `qa_span`, in Python."""
    safe = html.escape(content)
    if kind == TEXT:
        return safe, safe, safe, content
    if kind == MOLECULE:
        return safe, f"`{safe}`", f"<code>{safe}</code>", content if content.startswith("`") else f"`{content}`"
    return f"\\({safe}\\)", f"${safe}$", f"\\({content}\\)", content if content.startswith(("$", "\\(", "\\[")) else f"${content}$"


def filled_table(source: str) -> tuple:
    """`split_table`, and the structure filled in each of FORMS: `fill_placeholders` and `qa_table_text` in Python. The
    texts go to their places at once; only where there are placeholders outside, one is replaced after the other."""
    around, cut = _cut(source)
    split = _split(around, cut)
    forms = [[shown(content, kind) for content, kind in own] for own in cut]
    out = []
    for n in range(len(FORMS)):
        texts = [[t[n] for t in own] for own in forms]
        whole = _joined(around, texts)
        if "[[VL_TABLE_" in whole:
            whole = split[0]
            for placeholder, text in zip(reversed(split[1]), reversed([t for own in texts for t in own])):
                whole = whole.replace(placeholder, text)
        out.append(whole)
    return *split, *out[:-1], out[-1].strip()


def table_cells(documents: DataFrame, source: str = "html", keys: tuple[str, ...] = ("token",)) -> DataFrame:
    """The keys and CELLS, a row for each cell of each table. Null and tableless documents give none."""
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in documents.select(*keys).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [*keys, *(f.split()[0] for f in CELLS.split(", "))]
        for batch in batches:
            own = zip(*(batch[k] for k in keys))
            rows = ((*key, *cell) for key, text in zip(own, batch[source]) for cell in cells(text or ""))
            while part := list(islice(rows, ROWS)):
                yield pd.DataFrame(part, columns=names)

    bounded(documents.sparkSession)
    return documents.select(*keys, source).mapInPandas(run, f"{types}, {CELLS}")


def split_tables(source: Column) -> Column:
    """`split_table` as a Column function: a struct of SPLIT."""

    @F.pandas_udf(SPLIT)
    def split(sources: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([split_table(s or "") for s in sources], columns=[f.split()[0] for f in SPLIT.split(", ")])

    return split(source)


def first_table(source: str) -> list[list[str]] | None:
    """The first table of a document: the header (several header rows joined by a blank) and the rows that have a cell
    with text; None without one."""
    heads: list[list[str]] = []
    body: list[list[str]] = []
    for _, group in groupby(takewhile(lambda c: c[0] == 0, cells(source)), lambda c: c[1]):
        row = list(group)
        (heads if row[0][3] else body).append([c[4] for c in row])
    if not heads:
        return None
    return [heads[0] if len(heads) == 1 else [" ".join(names) for names in zip(*heads)], *(r for r in body if any(r))]


def table_rows(documents: DataFrame, source: str = "html", keys: tuple[str, ...] = ("token",)) -> DataFrame:
    """The keys and, for the first table of each document, `rows` as `first_table` has them. A table's rows leave the task
    that its HTML came to, and a batch of them is bound by characters."""
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in documents.select(*keys).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, held, size = [], [], 0
            for k, text in enumerate(batch.column(len(keys))):
                text = text.as_py() or ""
                rows = first_table(text)
                if rows is not None:
                    own.append(k)
                    held.append(rows)
                    size += len(text)
                if held and (size >= BATCH_BYTES or k == batch.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(own)) for c in batch.columns[: len(keys)]), pa.array(held, pa.list_(pa.list_(pa.string())))], names=[*keys, "rows"])
                    own, held, size = [], [], 0

    bounded(documents.sparkSession)
    return documents.select(*keys, source).mapInArrow(run, f"{types}, rows array<array<string>>")


def filled_tables(documents: DataFrame, source: str = "html", keys: tuple[str, ...] = ("token",)) -> DataFrame:
    """The keys, SPLIT and FORMS of each document's tables: parsed and filled in one pass over a batch."""
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in documents.select(*keys).schema)
    names = [f.split()[0] for f in SPLIT.split(", ")] + list(FORMS)
    made = [pa.list_(pa.string()) if n in ("placeholders", "contents", "types") else pa.string() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = zip(*(filled_table(text or "") for text in batch.column(len(keys)).to_pylist()))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *map(pa.array, columns, made)], names=[*keys, *names])

    bounded(documents.sparkSession)
    return documents.select(*keys, source).mapInArrow(run, f"{types}, {SPLIT}, " + ", ".join(f"{form} string" for form in FORMS))


def upgraded(tables: DataFrame) -> DataFrame:
    """Tables of an older form in the present one. tables: html, text, structure, placeholders, contents, types (the last
    three arrays of strings) and further columns. html is the structure where it is there (null counts as not there), and
    the text goes. With placeholders, missing types are those of text; without, the structure is cut into them."""
    kept = [c for c in tables.columns if c not in ("html", "text", "structure", "placeholders", "contents", "types")]
    own = tables.withColumn("structure", F.coalesce("html", "structure")).withColumn("_has", F.coalesce(F.size("placeholders") > 0, F.lit(False)))
    cut = own.withColumn("_cut", split_tables(F.when(~F.col("_has") & (F.coalesce("structure", F.lit("")) != ""), F.col("structure"))))
    untyped = (F.coalesce(F.size("types"), F.lit(0)) <= 0) & (F.coalesce(F.size("contents"), F.lit(0)) > 0)
    parsed = ~F.col("_has") & (F.coalesce("structure", F.lit("")) != "")
    types = F.when(F.col("_has") & untyped, F.array_repeat(F.lit(TEXT), F.size("contents"))).otherwise(F.col("types"))
    new = {c: F.when(parsed, F.col(f"_cut.{c}")).otherwise(F.col(c)) for c in ("structure", "placeholders", "contents")} | {"types": F.when(parsed, F.col("_cut.types")).otherwise(types)}
    return cut.select(*kept, *[v.alias(c) for c, v in new.items()])

"""Small frames (a header and rows of cells, both arrays) in text formats, as Columns of built-ins; and chart strings as frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.spans import latex_escape
from folio.functions.text import SPACES, bound

ROWS = "array<array<string>>"


def chart_cells(data: Column) -> Column:
    """array<array<string>>: a chart's lines, cut at bars after those at the ends; blank cells are null, rows without any
    cell go. Rows are filled up with nulls to the longest."""
    lines = F.split(F.coalesce(data, F.lit("")), "\n")
    cells = F.transform(lines, lambda x: F.transform(F.split(F.trim(x, F.lit("|")), r"\|"), lambda c: F.nullif(F.trim(c, F.lit(SPACES)), F.lit(""))))
    return bound(cells, lambda rows: bound(longest(rows), lambda n: F.filter(F.transform(rows, lambda r: fill(r, n)), lambda r: F.exists(r, lambda c: c.isNotNull()))))


def longest(rows: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))


def fill(row: Column, width: Column, with_: str | None = None) -> Column:
    """A row with more cells at its end, up to `width`."""
    return F.concat(row, F.array_repeat(F.lit(with_).cast("string"), F.greatest(width - F.size(row), F.lit(0))))


def has_frame(rows: Column) -> Column:
    """A frame needs a header and a row."""
    return F.size(rows) > 1


def _bars(cells: Column) -> Column:
    return F.concat(F.lit("|"), F.array_join(cells, "|"), F.lit("|"))


def pipe_table(header: Column, rows: Column) -> Column:
    """A Markdown table of text cells. A column is as wide as its longest cell, and two more than its name at least."""

    def of(f: Column) -> Column:
        names, body = f["h"], f["r"]
        wide = F.transform(names, lambda n, j: F.greatest(F.length(n) + 2, F.coalesce(F.array_max(F.transform(body, lambda r: F.length(F.coalesce(F.get(r, j), F.lit(""))))), F.lit(0))))

        def table(w: Column) -> Column:
            # cells beyond the header have no width, so no text, and aren't joined
            cells = lambda r: F.array_join(F.zip_with(w, r, lambda n, c: F.rpad(F.coalesce(c, F.lit("")), n, " ")), " | ")
            line = lambda r: F.when(F.size(w) > 0, F.concat(F.lit("| "), cells(r), F.lit(" |"))).otherwise("||")
            rule = _bars(F.transform(w, lambda n: F.concat(F.lit(":"), F.repeat(F.lit("-"), n + 1))))
            return F.array_join(F.concat(F.array(line(names), rule), F.transform(body, line)), "\n")

        return bound(wide, table)

    return bound(F.struct(F.transform(header, lambda n: F.coalesce(n, F.lit("None"))).alias("h"), rows.alias("r")), of)


def _escaped(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def html_table(header: Column, rows: Column) -> Column:
    """The frame as an HTML table, cells escaped, missing ones as None."""
    line = lambda r, tag: F.concat(F.lit(f"      <{tag}>"), F.array_join(F.transform(r, lambda c: _escaped(F.coalesce(c, F.lit("None")))), f"</{tag}>\n      <{tag}>"), F.lit(f"</{tag}>\n    </tr>\n"))
    head = F.concat(F.lit('<table border="1" class="dataframe">\n  <thead>\n    <tr style="text-align: right;">\n'), line(header, "th"), F.lit("  </thead>\n  <tbody>\n"))
    body = F.array_join(F.transform(rows, lambda r: F.concat(F.lit("    <tr>\n"), line(r, "td"))), "")
    return F.concat(head, body, F.lit("  </tbody>\n</table>"))


def latex_table(header: Column, rows: Column, escape: bool = False) -> Column:
    """The frame as a LaTeX tabular of left columns; with `escape`, LaTeX's marks in cells (not names) are written out."""
    show = lambda c: latex_escape(F.coalesce(c, F.lit("None"))) if escape else F.coalesce(c, F.lit("None"))
    line = lambda r: F.concat(F.array_join(r, " & "), F.lit(" \\\\\n"))
    body = F.array_join(F.transform(rows, lambda r: line(F.transform(r, show))), "")
    head = line(F.transform(header, lambda c: F.coalesce(c, F.lit("None"))))
    return F.concat(F.lit("\\begin{tabular}{"), F.repeat(F.lit("l"), F.size(header)), F.lit("}\n"), head, body, F.lit("\\end{tabular}\n"))


def frame(rows: Column, form: str, escape: bool = False) -> Column:
    """The first row as header, the others as rows, in plain, markdown, latex or html; empty without a row."""
    show = {"plain": pipe_table, "markdown": pipe_table, "html": html_table, "latex": lambda h, b: latex_table(h, b, escape)}[form]
    return bound(rows, lambda r: F.when(has_frame(r), show(F.element_at(r, 1), F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))))).otherwise(F.lit("")))

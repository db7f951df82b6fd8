"""Inline spans of rich text: plain text, molecules and equations, as arrays of structs of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.latex import unicode_to_latex
from folio.functions.text import SPACES, bound, html_escape

# What a span looks like, and what makes the text between dollars an equation.
MOLECULES = (r"\*\*\*.+?\*\*\*", "<code>.+?</code>", "`.+?`")
EQUATIONS = (r"\\\[.+?\\\]", r"\\\(.+?\\\)", r"\$\$.+?\$\$", r"\$(?:\\.|[^$\\\n])+?\$")
SPAN = "(?s)" + "|".join(MOLECULES + EQUATIONS)
#: What a marked passage begins with; what is put around passages.
OPENS, CUT = r"[*<`\\$]", "\ufdd1\ufdd2"
LATEX_MARK = r"\\[A-Za-z]+|[\^_{}=]|[A-Za-z]\s*[+\-*/=<>]\s*[A-Za-z0-9\\]"
TEXT, MOLECULE, EQUATION = "text", "molecule", "equationinline"
#: Characters with a meaning in LaTeX, and how a table's cells have them.
LATEX = (("\\", r"\textbackslash "), ("%", r"\%"), ("#", r"\#"), ("&", r"\&"), ("_", r"\_"), ("$", r"\$"), ("{", r"\{"), ("}", r"\}"), ("~", r"\textasciitilde "), ("^", r"\textasciicircum "))
_STRUCT = "struct<content:string,type:string>"


def _span(content: Column, kind: str | Column) -> Column:
    return F.struct(content.alias("content"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"))


def _inner(mark: Column, n: int, m: int) -> Column:
    """A mark without n characters in front and m behind, and without white space at its ends."""
    return F.trim(F.substring(mark, F.lit(n + 1), F.length(mark) - (n + m)), F.lit(SPACES))


def _read_mark(m: Column) -> Column:
    """The span that a marked passage stands for. Dollars around what doesn't look like LaTeX stay text."""
    out = F.when(m.startswith("***"), _span(_inner(m, 3, 3), MOLECULE)).when(m.startswith("<code>"), _span(_inner(m, 6, 7), MOLECULE)).when(m.startswith("`"), _span(_inner(m, 1, 1), MOLECULE))
    out = out.when(m.startswith("\\"), _span(_inner(m, 2, 2), EQUATION))
    double = F.substring(m, F.lit(3), F.length(m) - 4)
    single = F.substring(m, F.lit(2), F.length(m) - 2)
    out = out.when(m.startswith("$$") & double.rlike(LATEX_MARK), _span(_inner(m, 2, 2), EQUATION))
    return out.when(~m.startswith("$$") & m.startswith("$") & single.rlike(LATEX_MARK), _span(_inner(m, 1, 1), EQUATION)).otherwise(_span(m, TEXT))


def inline_spans(text: Column) -> Column:
    """array<struct<content,type>>: a text cut into spans; neighbouring text is one span. Null or empty: none.

    One pass puts CUT (two code points that no text has) around each marked passage, so that passages are every second
    piece between cuts.
    """
    own = F.coalesce(text, F.lit(""))
    pieces = F.when(own.rlike(OPENS), F.split(F.regexp_replace(own, SPAN, f"{CUT}$0{CUT}"), CUT, -1)).otherwise(F.array(own))
    every = F.transform(pieces, lambda p, n: F.when(n % 2 == 1, _read_mark(p)).otherwise(_span(p, TEXT)))
    parts = lambda e: F.filter(e, lambda s: (s["type"] != TEXT) | (s["content"] != ""))

    def add(held: Column, s: Column) -> Column:
        last = F.try_element_at(held, F.lit(-1))
        joined = F.concat(F.slice(held, 1, F.size(held) - 1), F.array(_span(F.concat(last["content"], s["content"]), TEXT)))
        return F.when((F.size(held) > 0) & (last["type"] == TEXT) & (s["type"] == TEXT), joined).otherwise(F.concat(held, F.array(s)))

    # texts are neighbours only where a passage is none
    return bound(every, lambda e: F.when(F.size(F.filter(e, lambda s, n: (n % 2 == 1) & (s["type"] == TEXT))) > 0, F.aggregate(parts(e), F.array().cast(f"array<{_STRUCT}>"), add)).otherwise(parts(e)))


def spans_of(contents: Column, types: Column) -> Column:
    """Spans of parallel arrays, as long as the shorter; without types all are text."""
    n = F.when(types.isNull() | (F.size(types) == 0), F.size(contents)).otherwise(F.least(F.size(contents), F.size(types)))
    return F.transform(F.slice(contents, 1, n), lambda c, i: _span(F.coalesce(c, F.lit("")), F.coalesce(F.get(types, i), F.lit(TEXT))))


def latex_escape(s: Column) -> Column:
    """A table's cell for LaTeX: ASCII characters that it reads as commands are written out, others are kept."""
    marks = [chr(0xE000 + k) for k in range(len(LATEX))]  # private use: an escape isn't escaped again
    s = F.translate(s, "".join(a for a, _ in LATEX), "".join(marks))
    for mark, (_, written) in zip(marks, LATEX):
        s = F.replace(s, F.lit(mark), F.lit(written))
    return s


def format_span(content: Column, kind: Column, form: str) -> Column:
    """One span in plain, markdown, latex or html."""
    before, after = {"plain": ("\\(", "\\)"), "markdown": ("$", "$"), "latex": ("\\(", "\\)"), "html": ("\\(", "\\)")}[form]
    equation = F.concat(F.lit(before), content, F.lit(after))
    # a text without marks is only searched
    escaped = F.when(content.rlike("[&<>\"']"), html_escape(content)).otherwise(content)
    body = {"plain": content, "markdown": content, "latex": unicode_to_latex(content), "html": escaped}[form]
    marks = {"plain": ("", ""), "markdown": ("`", "`"), "latex": ("\\texttt{", "}"), "html": ("<code>", "</code>")}[form]
    around = [F.when(kind == MOLECULE, m).otherwise("") for m in marks]
    return F.when(kind.isin("equation", EQUATION), equation).otherwise(body if form == "plain" else F.concat(around[0], body, around[1]))


def inline_text(spans: Column, form: str) -> Column:
    """All spans in one format."""
    return F.array_join(F.transform(spans, lambda s: format_span(s["content"], s["type"], form)), "")


def qa_span(content: Column, kind: Column) -> Column:
    """One span for the question/answer content list: an equation in dollars and a molecule in backticks, unless it has
    such marks already."""
    marked = content.startswith("$") | content.startswith("\\(") | content.startswith("\\[")
    k = F.lower(F.trim(kind, F.lit(SPACES)))
    out = F.when(k.isin("equation", EQUATION) & ~marked, F.concat(F.lit("$"), content, F.lit("$")))
    return out.when((k == MOLECULE) & ~content.startswith("`"), F.concat(F.lit("`"), content, F.lit("`"))).otherwise(content)


def qa_spans(contents: Column, types: Column) -> Column:
    """Spans of parallel arrays; where their lengths differ all are text."""
    fits = F.coalesce(F.size(types) == F.size(contents), F.lit(False))
    return F.transform(contents, lambda c, i: _span(c, F.when(fits, F.get(types, i)).otherwise(F.lit(TEXT))))


def qa_inline_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: qa_span(s["content"], s["type"])), "")


def qa_table_text(structure: Column, placeholders: Column, spans: Column) -> Column:
    """A table's HTML with its placeholders replaced, last to first, without white space at its ends; the spans alone
    where the numbers of placeholders and spans differ."""
    pairs = F.zip_with(placeholders, F.transform(spans, lambda s: qa_span(s["content"], s["type"])), lambda p, t: F.struct(p.alias("p"), t.alias("t")))
    filled = F.aggregate(F.reverse(pairs), structure, lambda html, x: F.replace(html, x["p"], x["t"]))
    return F.when(F.size(placeholders) == F.size(spans), F.trim(filled, F.lit(SPACES))).otherwise(qa_inline_text(spans))


def fill_placeholders(structure: Column, placeholders: Column, spans: Column, form: str) -> Column:
    """A table's HTML with its placeholders replaced, last to first. Outside html the formatted text is escaped, so that
    it stays text when the table is read."""

    def written(s: Column) -> Column:
        out = format_span(s["content"], s["type"], form)
        return out if form == "html" else html_escape(out)

    pairs = F.zip_with(placeholders, F.transform(spans, written), lambda p, t: F.struct(p.alias("p"), t.alias("t")))
    return F.aggregate(F.reverse(pairs), structure, lambda html, x: F.replace(html, x["p"], F.coalesce(x["t"], F.lit(""))))

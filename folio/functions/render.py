"""Renderers of a block by type and format, as Columns of `type` and `text`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.kinds import MARGINALIA, semantic
from folio.functions.text import SPACES, html_escape, image_reference

# What stands before and after a text, by type; {t} is the type.
CAPTIONS = ("caption", "tablecaption", "figurecaption", "imagecaption", "algorithmcaption", "expressioncaption")
NOTES = ("algorithmfootnote", "imagefootnote", "tablefootnote", "pagenote")
IDS = ("token", "equationid", "moleculeid")
WRAPPERS: dict[str, dict[tuple[str, ...], tuple[str, str]]] = {
    "markdown": {("legend", *NOTES): ("*", "*"), CAPTIONS: ("**", "**"), ("title",): ("## ", ""), ("documenttitle",): ("# ", ""), ("equation",): ("$$\n", "\n$$"), ("molecule",): ("`", "`")},
    "latex": {("legend", *NOTES, *IDS): ("\\textit{", "}"), CAPTIONS: ("\\textbf{", "}"), ("title",): ("\\section{", "}"), ("documenttitle",): ("\\title{", "}"), ("equation",): ("\\[\n", "\n\\]"), ("molecule",): ("\\texttt{", "}")},
    "html": {("legend",): ("<legend>", "</legend>"), NOTES: ('<aside class="footnote footnote-{t}"><em>', "</em></aside>"), IDS: ("<em>", "</em>"), CAPTIONS: ('<caption class="caption-{t}">', "</caption>"), ("title",): ('<h2 class="title">', "</h2>"), ("documenttitle",): ('<h1 class="document-title">', "</h1>"), ("equation",): ("\\[\n", "\n\\]"), ("molecule",): ("<code>", "</code>")},
}
#: Types that no wrapper of paragraphs applies to, and layout marks without a text.
BARE = ("figure",)
MARKS = ("hline", "group", "image", "figuregroup")


def render(form: str) -> Column:
    """A block in markdown, latex, html or plain; a mark is its type in angle brackets. Unknown types are paragraphs."""
    kind, text = F.col("type"), F.coalesce("text", F.lit(""))
    shown = html_escape(text) if form == "html" else text
    out = F.when(kind.isin(*MARKS), F.concat(F.lit("<"), kind, F.lit(">")))
    for kinds, (before, after) in WRAPPERS.get(form, {}).items():
        raw = text if kinds == ("equation",) else shown
        head = F.replace(F.lit(before), F.lit("{t}"), kind)
        out = out.when(kind.isin(*kinds), F.concat(head, raw, F.lit(after)))
    if form == "html":
        out = out.when(kind.isin(*BARE), text)
        return out.otherwise(F.concat(F.lit("<p>"), shown, F.lit("</p>")))
    return out.otherwise(text)


def render_all(form: str) -> Column:
    """`render` with algorithms as code: fenced, verbatim or preformatted; and `markup`, where all but plain text stands
    between its type's begin and end. A mark shows nothing in markup."""
    kind, text = F.col("type"), F.coalesce("text", F.lit(""))
    if form == "markup":
        block = F.concat(F.lit("\\begin{"), kind, F.lit("}\n"), text, F.lit("\n\\end{"), kind, F.lit("}"))
        return F.when(kind.isin(*MARKS), F.concat(F.lit("<"), kind, F.lit(">"))).when(kind.isin("text", "paragraph"), text).otherwise(block)
    bare = F.rtrim(text, F.lit("\n"))
    code = {
        "markdown": F.concat(F.lit("```\n"), bare, F.lit("\n```")),
        "latex": F.concat(F.lit("\\begin{verbatim}\n"), bare, F.lit("\n\\end{verbatim}")),
        "html": F.concat(F.lit('<pre class="algorithm"><code>'), html_escape(text), F.lit("</code></pre>")),
    }
    return F.when(kind == "algorithm", code[form]).otherwise(render(form)) if form in code else render(form)


def format_as(form: str, source: Column) -> Column:
    """A block as part of a document: sections and marks show nothing; a block without a text but with a source shows the
    source; a line feed (markdown, latex) or break (html) ends it."""
    shown = F.concat(render_all(form), F.when(F.coalesce("text", F.lit("")) == "", image_reference(F.col("type"), source, form)).otherwise(F.lit("")))
    end = {"markdown": "\n", "latex": "\n", "html": "<br>"}.get(form, "")
    return F.when(F.col("type").isin("section", *MARKS), F.lit("")).otherwise(F.concat(shown, F.lit(end)))


def format_by(formats: dict[str, str], images: dict[str, str], source: Column, marginalia: bool = True) -> Column:
    """A block in the format that its semantic type has in `formats` (page headers and footers without one as textual;
    others without one show nothing). A block without a text shows its source as `images` says for its semantic type:
    base64 or link. Without `marginalia` page furniture shows nothing."""
    kind = semantic(F.col("type"))
    kind = F.when(F.col("type").isin("pageheader", "pagefooter"), F.lit("textual")).otherwise(kind)
    empty = (F.coalesce("text", F.lit("")) == "") & (F.trim(F.coalesce(source, F.lit(""))) != "")
    out = F.when(F.lit(not marginalia) & F.col("type").isin(*MARGINALIA), F.lit("")).when(F.col("type").isin("section", *MARKS), F.lit(""))
    for name, form in formats.items():
        start = F.lit("data:image/png;base64," if images.get(name) == "base64" else "")
        where = F.concat(start, source)
        image = {"markdown": F.concat(F.lit("!["), F.col("type"), F.lit("]("), where, F.lit(")")), "html": F.concat(F.lit("<img src='"), where, F.lit("' alt='"), F.col("type"), F.lit("'/>"))}
        shown = F.when(empty, image[form]).otherwise(F.lit("")) if name in images and form in image else F.lit("")
        out = out.when(kind == name, F.concat(render_all(form), shown, F.lit("<br>" if form == "html" else "")))
    return out.otherwise(F.lit(""))


def molecule_text(markush: Column, smi: Column, caption: Column) -> Column:
    """A molecule's text: its formula, or its caption where it stands for many or has no formula."""
    named = F.coalesce(smi, F.lit("")) != ""
    return F.when(F.coalesce(markush, F.lit(False)) | ~named, F.coalesce(caption, F.lit(""))).otherwise(smi)


def block_text(kind: Column, latex: Column, table: Column, inline: Column, formulas: list[Column], text: Column) -> Column:
    """What a block says in a list of questions and answers: an equation's LaTeX between double dollars (unless it has
    dollars already), a table's text, then inline spans, a molecule's first formula in backticks, then its text. Blank
    ones are passed over."""
    bare = lambda c: F.trim(F.coalesce(c, F.lit("")), F.lit(SPACES))
    k, own = F.lower(bare(kind)), bare(latex)
    equation = F.when(own.startswith("$"), own).otherwise(F.concat(F.lit("$$\n"), own, F.lit("\n$$")))
    formula = bare(F.coalesce(*[F.nullif(f, F.lit("")) for f in formulas]))
    out = F.when((k == "equation") & (own != ""), equation).when((k == "table") & (F.coalesce(table, F.lit("")) != ""), table)
    out = out.when(F.coalesce(inline, F.lit("")) != "", bare(inline)).when((k == "molecule") & (formula != ""), F.concat(F.lit("`"), formula, F.lit("`")))
    return out.otherwise(bare(text))

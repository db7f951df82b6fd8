"""Sets of layout types and what follows from a type, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layout types by what they are.
TEXTUAL = (
    "title", "documenttitle", "caption", "paragraph", "text", "legend", "token", "description", "tabular", "list", "identifier", "equationid", "moleculeid",
    "algorithm", "algorithmcaption", "algorithmfootnote", "toc", "pagenumber", "pagebar", "pagenote", "keyvalue", "reference", "imagecaption", "imagefootnote",
    "tablecaption", "tablefootnote", "figurecaption", "expressioncaption", "textline", "abstract", "pageheader", "pagefooter",
)
ENTITY = ("molecule", "chart", "figure", "equation", "equationinline")
GROUPED = ("table", "expression", "image")
IGNORED = ("abandon", "watermark")
FUNCTIONAL = ("section", "page", "hline", "group", "tablegroup", "figuregroup", "expressiongroup", "moleculegroup", "continued")
PARTITIONS = {"textual": TEXTUAL, "entity": ENTITY, "grouped": GROUPED, "ignored": IGNORED, "functional": FUNCTIONAL}
MARGINALIA = ("pageheader", "pagefooter", "pagebar", "pagenote", "pagenumber", "watermark")
#: For the question/answer content list.
QA_SKIPPED = ("hline", "pagebar", "pageheader", "pagefooter", "pagenote", "pagenumber", "watermark")
QA_CAPTIONS = ("algorithmcaption", "expressioncaption", "figurecaption", "imagecaption", "tablecaption")
QA_IMAGES = ("figure", "image", "chart", "table", "molecule", "figuregroup", "imagegroup")
#: Where an ordered page's blocks go: in the margin, at the top of the nesting, or at its bottom.
MARGIN = ("pageheader", "pagefooter", "pagenumber", "pagebar", "pagenote", "watermark")
TOP = ("group", "image", "figuregroup", "figure", "expression", "chart", "moleculegroup")
#: Languages and the recogniser's code for each.
OCR_CODES = {
    "chinese_simplified": "ch", "chinese_traditional": "chinese_cht", "japanese": "japan", "korean": "korean", "english": "en", "arabic": "ar", "greek": "el", "hindi": "hi",
    "russian": "ru", "french": "fr", "german": "german", "hungarian": "hu", "norwegian": "no", "danish": "da", "portuguese": "pt", "polish": "pl", "swedish": "sv",
    "spanish": "es", "serbian": "rs_latin", "serbian_latin": "rs_latin", "latin": "la", "tamil": "ta", "telugu": "te", "thai": "th",
}
#: Which kind of a part a combined figure shows, the most telling first.
SUB_FIGURES = {"chart": "chart", "table": "table", "expression": "chemical reaction", "molecule": "molecule"}


def semantic(kind: Column) -> Column:
    """textual, figure, ignore, equation, or the type itself."""
    out = F.when(kind.isin(*TEXTUAL), "textual").when(kind.isin("image", "figure"), "figure").when(kind.isin(*IGNORED, *FUNCTIONAL), "ignore")
    return out.when(kind.isin("equation", "equationinline"), "equation").otherwise(kind)


def partition(kind: Column) -> Column:
    """The list that a type is in, null for none."""
    out = None
    for name, kinds in PARTITIONS.items():
        out = F.when(kind.isin(*kinds), name) if out is None else out.when(kind.isin(*kinds), name)
    return out


def ocr_code(language: Column) -> Column:
    """The recogniser's code, null for a language that it doesn't know."""
    return F.create_map(*[F.lit(x) for pair in OCR_CODES.items() for x in pair])[F.lower(language)]


def lane(kind: Column) -> Column:
    """margin, top or bottom."""
    return F.when(kind.isin(*MARGIN), "margin").when(kind.isin(*TOP), "top").otherwise("bottom")


def sub_figure(kinds: Column) -> Column:
    """What a combined figure shows by the most telling of the types in it; a figure without any of them."""
    out = None
    for kind, name in SUB_FIGURES.items():
        here = F.array_contains(kinds, kind)
        out = F.when(here, name) if out is None else out.when(here, name)
    return out.otherwise("figure")

"""String functions as Columns of built-ins; those that need callbacks are in `folio.functions.captions`."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and limits that decide the results.
IMAGE_SUFFIX = r"(?i)\.(pdf|png|jpg|jpeg|webp)$"
BASE64 = r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"
PATH = r"^(?:[A-Za-z]:[/\\])?(?:[A-Za-z0-9_\-+.]+[/\\])*[A-Za-z0-9_\-+.]+"
TOKEN = r"^[-\._?=&a-zA-Z0-9]{1,128}$"
QUERY = r"((?:https?://|/)[^\s?]+)\?[^\s]+"
MD_IMAGE = r"!\[.*?\]\((.*?)\)"
#: Up to ten bracketed prefixes; then what closes a bracket within five characters, eleven times at most.
OPENED = r"^(?:\([^)]{0,64}\)|（[^）]{0,64}）|\[[^\]]{0,64}\]|【[^】]{0,64}】){0,10}"
CLOSING = r"^(?:(?:[^)]{0,4}\))?(?:[^）]{0,4}）)?(?:[^\]]{0,4}\])?(?:[^】]{0,4}】)?){0,11}"
NUMBERED = r"^\p{Nd}{1,4}-?"
HEAD = r"^(?:[a-z#*†‡§¶⁰¹²³⁴⁵⁶⁷⁸⁹\s]{0,2}[A-Z]|#)"
CLOSED = r"(?:\([^)]{0,64}\)|（[^）]{0,64}）|\[[^\]]{0,64}\]|【[^】]{0,64}】){1,10}$"
TAIL = r"""[.!?。！？"”:：;；]$"""
BLANKS = " \n\r\t"
#: White space as Python's strip() has it.
SPACES = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def url_stem(url: Column) -> Column:
    """Last path segment without a known suffix; `url_document` if nothing is left."""
    last = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-zA-Z]+://[^/]*(?:/.*)?/([^/]*)$", 1)
    stem = F.regexp_replace(last, IMAGE_SUFFIX, "")
    return F.when(stem == "", "url_document").otherwise(stem)


def input_kind(path: Column) -> Column:
    """error (empty), url, image or file."""
    p = F.trim(path)
    return F.when(p == "", "error").when(p.rlike("^https?://"), "url").when(p.rlike(r"(?i)\.(png|jpg|jpeg|webp)$"), "image").otherwise("file")


def source_kind(source: Column) -> Column:
    """base64 if all of it could be, else path by its start, else url, else none; an https URL starts like a path."""
    return F.when(source.rlike(BASE64), "base64").when(source.rlike(PATH), "path").when(source.rlike("(?i)^https?://"), "url").otherwise("none")


def base64(raw: Column) -> Column:
    """A binary in base64 without breaks; Spark's own function breaks lines behind 76 characters."""
    return F.replace(F.base64(raw), F.lit("\r\n"), F.lit(""))


def truncate(s: Column, front: int = 20, back: int = 10) -> Column:
    return F.when(F.length(s) <= front + back, s).otherwise(F.concat(F.left(s, F.lit(front)), F.lit("..."), F.right(s, F.lit(back))))


def redact(s: Column) -> Column:
    """URL queries become `<redacted>`."""
    return F.regexp_replace(s, QUERY, "$1?<redacted>")


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """`of(value)` with `value` evaluated once for a row, however often `of` names it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def html_escape(s: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


def job_token(key: str, name: Column) -> Column:
    """Hex of the name-based (SHA-1) UUID of `name` in the namespace that `key` has under DNS."""
    space = uuid.uuid5(uuid.NAMESPACE_DNS, key).hex
    h = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(name, "utf-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15))


def strip_images(s: Column) -> Column:
    """Without Markdown images, each within a line, and without white space at the ends; three or more line feeds become two."""
    return F.trim(F.regexp_replace(F.regexp_replace(s, "(?d)" + MD_IMAGE, ""), "\n{3,}", "\n\n"), F.lit(SPACES))


def refine_title(title: Column) -> Column:
    """Without white space; its first number, else its first Chinese numeral, else all of it."""
    t = F.regexp_replace(title, r"\s+", "")
    first = lambda p: F.nullif(F.regexp_extract(t, p, 0), F.lit(""))
    return F.coalesce(first(r"\d+\.\d+|\d+"), first("[一二三四五六七八九零十百]+"), t)


def label_number(label: Column) -> Column:
    """First run of digits as an int, null without one."""
    return F.regexp_extract(label, r"\d+", 0).try_cast("int")


def starts_paragraph(s: Column) -> Column:
    """Whether a line begins a paragraph: a capital or `#` behind brackets, numbers and marks. White space is ASCII."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, OPENED, ""), CLOSING, ""), NUMBERED, "")
    return F.ltrim(bare, F.lit(BLANKS)).rlike(HEAD)


def ends_paragraph(s: Column) -> Column:
    """Whether a line ends a paragraph: a closing mark before closed brackets."""
    return F.trim(F.regexp_replace(s, CLOSED, ""), F.lit(BLANKS)).rlike(TAIL)


JSON_QUERY = r"((?:https?://|/)[^\s?\"]+)\?[^\s\"]+"
#: What a quoted path keeps as it is, beside letters, digits and -_.~ (fixed values).
KEPT = "/:@&=?"


def redact_json(raw: Column) -> Column:
    """URL queries in any string of a JSON text become `<redacted>`; quotes end a URL, so the JSON stays whole."""
    return F.regexp_replace(raw, JSON_QUERY, "$1?<redacted>")


def quote_path(s: Column) -> Column:
    """Percent-encoded, but for letters, digits, -_.~ and KEPT."""
    out = F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))
    for code, char in (("%7E", "~"), *((f"%{ord(c):02X}", c) for c in KEPT)):
        out = F.replace(out, F.lit(code), F.lit(char))
    return F.replace(out, F.lit("*"), F.lit("%2A"))


def hmac_sha256(key: str, body: Column) -> Column:
    """Hex of the HMAC of a binary; the key is a parameter, so its pads are constants."""
    raw = key.encode()
    if len(raw) > 64:
        raise ValueError("the key must have 64 bytes at most")
    pad = lambda n: F.unhex(F.lit(bytes(b ^ n for b in raw.ljust(64, b"\0")).hex()))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), body), 256))), 256)


def signed(signature: Column, key: str, body: Column) -> Column:
    """Whether a callback's signature is `sha256=` and the body's HMAC."""
    return F.coalesce(signature == F.concat(F.lit("sha256="), hmac_sha256(key, body)), F.lit(False))


def image_reference(kind: Column, source: Column, form: str) -> Column:
    """How a source is shown in markdown, latex or html, empty for what is no source. An https URL counts as a path."""
    b64, path, url = (source_kind(source) == k for k in ("base64", "path", "url"))
    empty = F.trim(F.coalesce(source, F.lit(""))) == ""
    if form == "markdown":
        out = F.when(b64, F.concat(F.lit("!["), kind, F.lit("](data:image/png;base64,"), source, F.lit(")")))
        out = out.when(path, F.concat(F.lit("!["), kind, F.lit("](<"), source, F.lit(">)"))).when(url, F.concat(F.lit("!["), kind, F.lit("]("), source, F.lit(")")))
    elif form == "html":
        tag = lambda src: F.concat(F.lit("<img src='"), src, F.lit("' alt='"), kind, F.lit("'/>"))
        out = F.when(b64, tag(F.concat(F.lit("data:image/png;base64,"), source))).when(path | url, tag(source))
    elif form == "latex":
        tag = lambda src: F.concat(F.lit("\\includegraphics[width=0.5\\textwidth]{"), src, F.lit("}"))
        out = F.when(b64, tag(F.lit(""))).when(path | url, tag(quote_path(source)))
    else:
        return F.lit("")
    return F.when(empty, F.lit("")).otherwise(F.coalesce(out, F.lit("")))


#: Head, tail and suffix of a document in each format (fixed values).
WRAPPED = {
    "latex": ("\\documentclass{article}\\n\\n\\usepackage{booktabs}\\n\\n\\begin{document}\\n", "\\end{document}", "tex"),
    "html": ("<html>\n\n<body>\n", "</body>\n\n</html>", "html"),
    "markdown": ("", "", "md"),
    "plain": ("", "", "plain"),
    "markup": ("", "", "txt"),
}


def wrap_document(content: Column, form: str) -> Column:
    """A whole document: the content between its format's head and tail, each with a line feed after it."""
    head, tail, _ = WRAPPED[form]
    return F.concat(F.lit(head + "\n" if head else ""), F.coalesce(content, F.lit("")), F.lit(tail + "\n" if tail else ""))


def dpi_for(dpi: int, width: Column, height: Column, most: int = 4096) -> Column:
    """Dots per inch so that a page of width by height points has `most` pixels a side at most; 1 at least."""
    return F.least(F.lit(dpi), F.greatest(F.lit(1), F.floor(F.lit(most * 72) / F.greatest(width, height)).cast("int")))


#: Names of parse options and the modes they stand for, and the modes of a scientific paper (fixed values).
MODES = {"disable": "Disable", "ocr-fast": "OCRFast", "ocr-hq": "OCRHighQuality", "digital": "DigitalExported", "base64": "DumpBase64"}
PAPER = {"textual": "ocr-hq", "equation": "ocr-hq", "table": "ocr-hq", "chart": "base64", "figure": "base64", "expression": "base64", "molecule": "ocr-fast"}


def parse_mode(field: str, alias: Column) -> Column:
    """The mode that an option's name stands for, its default where null; null for a name that the field doesn't know."""
    known = {a: m for a, m in MODES.items() if field == "textual" or a != "digital"}
    pairs = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return pairs[F.coalesce(alias, F.lit(PAPER[field]))]


def mode_alias(mode: Column) -> Column:
    """The name of a mode."""
    return F.create_map(*[F.lit(x) for a, m in MODES.items() for x in (m, a)])[mode]


def resolved_input(file: Column, image: Column, url: Column) -> Column:
    """struct<kind, value, error> of a request that names one of a file, an image and a URL."""
    given = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    n = given(file).cast("int") + given(image).cast("int") + given(url).cast("int")
    error = (
        F.when(n != 1, "exactly one of file, image and url")
        .when(given(url) & ~F.trim(url).rlike("^https?://"), "url must start with http:// or https://")
        .when(given(image) & ~F.trim(image).rlike(r"(?i)\.(png|jpg|jpeg|webp)$"), "not a supported image type")
    )
    kind = F.when(error.isNotNull(), F.lit(None)).when(given(url), "url").when(given(image), "image").otherwise("file")
    value = F.trim(F.coalesce(F.when(given(url), url), F.when(given(image), image), file))
    return F.struct(kind.alias("kind"), F.when(error.isNull(), value).alias("value"), error.alias("error"))

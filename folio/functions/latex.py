"""Text as LaTeX source: what LaTeX reads as commands is written out, letters with accents become accent commands around
their base, Greek and symbols become commands, and what has no command stays.

A text's characters outside ASCII are found by one pattern, longest first (a letter with the marks that follow it), and
each distinct one is replaced by what rules make of it: its canonical decomposition gives the base and the marks, and
each mark puts its command around what is there. So no table of outcomes is needed, and ASCII texts are scanned once.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters with a meaning in LaTeX and how they are written; commands of combining marks; letters and
# symbols with a command of their own, as text and in formulas.
ESCAPES = {"\\": r"{\textbackslash}", "%": r"\%", "#": r"\#", "&": r"\&", "_": r"\_", "$": r"\$", "{": r"\{", "}": r"\}", "~": r"{\textasciitilde}", "^": r"{\textasciicircum}"}
MARKS = {"̀": "`", "́": "'", "̂": "^", "̃": "~", "̈": '"', "̄": "=", "̇": ".", "̊": "r", "̋": "H", "̌": "v", "̆": "u", "̣": "d", "̧": "c", "̨": "k", "̱": "b"}
BELOW = "̧̨̣̱"
OWN = {
    "ß": r"{\ss}", "æ": r"{\ae}", "Æ": r"{\AE}", "œ": r"{\oe}", "Œ": r"{\OE}", "ø": r"{\o}", "Ø": r"{\O}", "ł": r"{\l}", "Ł": r"{\L}", "ı": r"{\i}", "ȷ": r"{\j}", "ð": r"{\dh}", "Ð": r"{\DH}", "þ": r"{\th}", "Þ": r"{\TH}",
    " ": "~", "–": "--", "—": "---", "‘": "`", "’": "'", "“": "``", "”": "''", "…": r"{\ldots}", "¡": "!`", "¿": "?`", "§": r"{\S}", "¶": r"{\P}", "©": r"{\textcopyright}", "®": r"{\textregistered}", "™": r"{\texttrademark}", "°": r"{\textdegree}", "€": r"{\texteuro}", "£": r"{\textsterling}",
}
FORMULAS = {
    "←": "leftarrow", "→": "rightarrow", "↑": "uparrow", "↓": "downarrow", "↔": "leftrightarrow", "⇐": "Leftarrow", "⇒": "Rightarrow", "⇔": "Leftrightarrow", "±": "pm", "×": "times", "÷": "div", "·": "cdot", "≤": "leq", "≥": "geq", "≠": "not=", "≈": "approx", "≡": "equiv", "∞": "infty",
    "∂": "partial", "∇": "nabla", "∑": "sum", "∏": "prod", "∫": "int", "√": "surd", "∈": "in", "∉": "not\\in", "⊂": "subset", "⊃": "supset", "⊆": "subseteq", "⊇": "supseteq", "∪": "cup", "∩": "cap", "∀": "forall", "∃": "exists", "∝": "propto", "⊥": "perp", "∥": "parallel", "µ": "mu", "ς": "varsigma",
}
#: Greek capitals that LaTeX has a command for; the others look like a Latin letter, and omicron does.
CAPITALS = ("Gamma", "Delta", "Theta", "Lambda", "Xi", "Pi", "Sigma", "Upsilon", "Phi", "Psi", "Omega")
LIKE = {"Alpha": "A", "Beta": "B", "Epsilon": "E", "Zeta": "Z", "Eta": "H", "Iota": "I", "Kappa": "K", "Mu": "M", "Nu": "N", "Omicron": "O", "Rho": "P", "Tau": "T", "Chi": "X", "omicron": "o"}
#: What is looked up: a base with the marks behind it.
SEQUENCE = r"[A-Za-z][̀-ͯ]+|[^\x00-\x7f][̀-ͯ]*"
_SPARE = 0xFDD0  # code points that no text has


def _greek() -> dict[str, str]:
    """By the letters' names: α is GREEK SMALL LETTER ALPHA."""
    out = {}
    for c in map(chr, range(0x391, 0x3CA)):
        kind, _, name = unicodedata.name(c, "").removeprefix("GREEK ").partition(" LETTER ")
        name = {"LAMDA": "LAMBDA", "FINAL SIGMA": ""}.get(name, name)
        name = name.capitalize() if kind == "CAPITAL" else name.lower()
        if name in LIKE:
            out[c] = rf"\ensuremath{{\mathrm{{{LIKE[name]}}}}}"
        elif name and (kind == "SMALL" or name in CAPITALS):
            out[c] = rf"\ensuremath{{\{name}}}"
    return out


SINGLE = OWN | {c: rf"\ensuremath{{\{name}}}" for c, name in FORMULAS.items()} | _greek()


def _made_of() -> dict[str, tuple[str, str]]:
    """Latin letters with marks: the letter without the last mark, and that mark, if all marks have commands."""
    out = {}
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        whole = unicodedata.normalize("NFD", c)
        if len(whole) > 1 and whole[0].isascii() and whole[0].isalpha() and all(m in MARKS for m in whole[1:]):
            out[c] = unicodedata.normalize("NFC", whole[:-1]), whole[-1]
    return out


MADE_OF = _made_of()
#: Marks that a letter with marks has at most.
_DEEP = max(len(unicodedata.normalize("NFD", c)) - 1 for c in MADE_OF)


def _mapped(c: Column, entries: dict[str, str]) -> Column:
    """A character by a table of characters; others stay."""
    return F.translate(c, "".join(entries), "".join(entries.values()))


def escaped(s: Column) -> Column:
    """ASCII characters that LaTeX reads as commands, written out; other characters are kept."""
    spare = [chr(_SPARE + k) for k in range(len(ESCAPES))]  # an escape isn't escaped again
    out = F.translate(s, "".join(ESCAPES), "".join(spare))
    for mark, written in zip(spare, ESCAPES.values()):
        out = F.replace(out, F.lit(mark), F.lit(written))
    return F.when(s.rlike("[" + "".join(f"\\{c}" for c in ESCAPES) + "]"), out).otherwise(s)


def _around(base: Column, mark: Column, inner: Column) -> Column:
    """A mark's command around a letter, or around what has one already (`inner`)."""
    command = _mapped(mark, MARKS)
    gap = F.when(command.rlike("[A-Za-z]"), " ").otherwise("")
    dotless = base.isin("i", "j") & ~mark.isin(*BELOW)
    first = F.when(dotless, F.concat(F.lit("{\\"), command, gap, F.lit("\\"), base, F.lit("}"))).otherwise(F.concat(F.lit("\\"), command, gap, base))
    return F.when(inner.isNull(), first).otherwise(F.concat(F.lit("\\"), command, F.lit("{"), inner, F.lit("}")))


def _written(sequence: Column) -> Column:
    """How a letter with its marks, or a symbol, is written; itself where a part has no command."""
    base, marks = F.left(sequence, F.lit(1)), F.substring(sequence, F.lit(2), F.length(sequence))
    for _ in range(_DEEP):  # a mark less each time
        less = _mapped(base, {c: b for c, (b, _) in MADE_OF.items()})
        marks = F.concat(F.when(less != base, _mapped(base, {c: m for c, (_, m) in MADE_OF.items()})).otherwise(""), marks)
        base = less

    def made(parts: Column) -> Column:
        each = F.filter(F.split(parts["m"], ""), lambda m: m != "")
        return F.aggregate(each, F.lit(None).cast("string"), lambda inner, m: _around(parts["b"], m, inner))

    known = base.rlike("[A-Za-z]") & marks.rlike(f"^[{''.join(MARKS)}]+$")
    number = F.ascii(_mapped(sequence, {c: chr(k + 1) for k, c in enumerate(SINGLE)}))
    symbol = F.when((F.length(sequence) == 1) & (number <= len(SINGLE)), F.get(F.array(*map(F.lit, SINGLE.values())), number - 1))
    # the parts are bound once, however often they are named
    return F.when(known, F.get(F.transform(F.array(F.struct(base.alias("b"), marks.alias("m"))), made), F.lit(0))).otherwise(F.coalesce(symbol, sequence))


def unicode_to_latex(s: Column) -> Column:
    """A text as LaTeX source; what has no command is kept."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(s, F.lit(SEQUENCE), F.lit(0))), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).otherwise(0))
    whole = F.aggregate(found, escaped(s), lambda held, q: F.replace(held, q, _written(q)))
    return F.when(s.rlike(r"[^\x00-\x7f]"), whole).otherwise(escaped(s))

"""Queries of inline spans, charts, tables and reactions, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import frames, reactions
from folio.functions import spans as S
from folio.functions import text as T
from folio.functions.latex import unicode_to_latex
from folio.sources import tables
from folio.sources.blocks import BLOCKS_SQL, blocks

PAGE = ["token", "page"]


def _rich():
    """A block's text with inline formulas and molecules around it."""
    t, k = F.col("text"), F.col("block") % 4
    one = F.concat(t, F.lit(" $a_1$ and $5 or $6 ***CCO***"))
    two = F.concat(F.lit("`N#N`\\(x^2 \\) "), t)
    three = F.concat(t, F.lit("$$ E = mc^2 $$<code> C1 </code> \\[ z \\]tail %"))
    return F.when(k == 0, one).when(k == 1, two).when(k == 2, three).otherwise(t)


def inline_spans(spark, sf_dir):
    """Each block's spans: their kinds, and their text in all formats and for the question/answer list."""
    b = blocks(spark, sf_dir).select(*PAGE, "block", S.inline_spans(_rich()).alias("s"))
    kinds = F.array_join(F.transform("s", lambda s: F.upper(F.left(s["type"], F.lit(1)))), "")
    return b.select(*PAGE, "block", kinds.alias("kinds"), *[S.inline_text(F.col("s"), f).alias(f) for f in ("plain", "markdown", "latex", "html")], S.qa_inline_text(F.col("s")).alias("qa"))


def chart_frames(spark, sf_dir):
    """Each page's lines as one chart, a blank between cells: its size, and digests of its table in all formats."""
    line = F.struct("block", F.translate("text", " ", "|").alias("t"))
    page = blocks(spark, sf_dir).groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda e: e["t"]), "\n").alias("data"))
    rows = page.select(*PAGE, frames.chart_cells(F.col("data")).alias("r"))
    shown = [F.sha2(frames.frame(F.col("r"), f, escape=True), 256).alias(f) for f in ("markdown", "latex", "html")]
    return rows.select(*PAGE, F.size("r").alias("n_rows"), frames.longest(F.col("r")).alias("n_cols"), *shown)


def table_frames(spark, sf_dir):
    """Each page as an HTML table of its lines, a word a cell, read back as cells: digests of its table in text formats."""
    cells = F.transform(F.split("text", " "), T.html_escape)
    row = lambda tag: F.concat(F.lit(f"<tr><{tag}>"), F.array_join(cells, f"</{tag}><{tag}>"), F.lit(f"</{tag}></tr>"))
    line = F.struct("block", F.when(F.col("block") == 0, F.concat(F.lit("<thead>"), row("th"), F.lit("</thead>"))).otherwise(row("td")).alias("t"))
    page = blocks(spark, sf_dir).groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda e: e["t"]), "\n").alias("r"))
    page = page.select(*PAGE, F.concat(F.lit("<table>\n"), F.col("r"), F.lit("</table>")).alias("html"))
    rows = tables.table_rows(page, "html", ("token", "page"))
    # a plain table is a Markdown table, so it is written once
    shown = rows.select(*PAGE, F.size("rows").alias("n_rows"), *[F.sha2(frames.frame(F.col("rows"), f), 256).alias(f) for f in ("plain", "latex")])
    return shown.select(*PAGE, "n_rows", "plain", F.col("plain").alias("markdown"), "latex")


def table_spans(spark, sf_dir):
    """Tables of two cells with formulas: placeholders in, and back in all formats."""
    word = F.regexp_replace("text", "[^a-z ]", "")
    html = F.concat(F.lit("<table><tr><td>"), word, F.lit(" $x_1$</td><td><b>R&amp;D "), word, F.lit("</b>***C***</td></tr></table>"))
    t = tables.filled_tables(blocks(spark, sf_dir).select(*PAGE, "block", html.alias("html")), "html", (*PAGE, "block"))
    return t.select(*PAGE, "block", "structure", F.array_join("contents", "|").alias("contents"), F.array_join("types", "|").alias("types"), *tables.FORMS)


def _reactions(w):
    """JSON of one or two reactions of a block's words w; an unknown field is to be left out."""
    part = lambda n, text: F.concat(F.lit(f'{{"category_id":{n},"more":1,"text":"'), text, F.lit('"}'))
    first, last = F.element_at(w, 1), F.element_at(w, -1)
    one = F.concat(F.lit('{"reactants":['), part(1, first), F.lit(","), part(2, F.lit(" and $k_1$ ")), F.lit('],"conditions":['), part(2, last), F.lit(","), part(1, F.lit("Pd&C")), F.lit('],"products":['), part(1, last), F.lit("]}"))
    two = F.concat(F.lit(',{"products":['), part(3, F.lit("")), F.lit("]}"))
    return F.concat(F.lit("["), one, F.when(F.col("block") % 2 == 0, two).otherwise(F.lit("")), F.lit("]"))


def expression_tables(spark, sf_dir):
    """Reactions as tables, with the number of components, the third of them, and the summary of the first."""
    # words are a column of their own, so that they aren't cut again wherever the JSON names them
    words = blocks(spark, sf_dir).select(*PAGE, "block", F.split(F.regexp_replace("text", "[^a-z ]", ""), " ").alias("w"))
    b = words.select(*PAGE, "block", reactions.read_reactions(_reactions(F.col("w"))).alias("r")).withColumn("t", reactions.reaction_texts(F.col("r")))
    first = F.col("r")[0]
    s = reactions.summary(first)
    return b.select(
        *PAGE, "block", F.size(reactions.all_components(first)).alias("n_components"), F.get(reactions.all_components(first), F.lit(2))["text"].alias("third"),
        F.concat_ws("|", F.array_join(s["prev_mols"], ","), F.array_join(s["post_mols"], ","), s["condition"]["text"], F.array_join(s["condition"]["catalyst"], ",")).alias("summary"),
        *[reactions.expression(F.col("t"), f).alias(f) for f in ("plain", "markdown", "latex", "html")],
    )


def latex_texts(spark, sf_dir):
    """Hash and length of each whole document as LaTeX."""
    t = unicode_to_latex(F.coalesce("text", F.lit("")))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", t.alias("t")).select("doc_id", F.sha2("t", 256).alias("latex_hash"), F.length("t").alias("latex_chars"))


QUERIES = {f.__name__: f for f in (inline_spans, latex_texts, chart_frames, table_frames, table_spans, expression_tables)}

_esc = lambda c: f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_esc3 = lambda c: f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _lat(c: str) -> str:
    marks = "".join(a for a, _ in S.LATEX)
    out = f"translate({c}, '{marks}', '{''.join(chr(0xE000 + k) for k in range(len(S.LATEX)))}')"
    for k, (_, written) in enumerate(S.LATEX):
        out = f"replace({out}, '{chr(0xE000 + k)}', '{written}')"
    return out


#: How the accented letters of the given texts are written in LaTeX.
ACCENTED = {
    "Ä": '\\"A', "Ç": "\\c C", "È": "\\`E", "É": "\\'E", "Ê": "\\^E", "Í": "\\'I", "Ñ": "\\~N", "Ó": "\\'O", "Ö": '\\"O', "Ü": '\\"U', "ß": "{\\ss}", "ä": '\\"a', "ç": "\\c c", "è": "\\`e", "é": "\\'e", "ê": "\\^e",
    "í": "{\\'\\i}", "ñ": "\\~n", "ó": "\\'o", "ö": '\\"o', "ü": '\\"u',
}


def _uni(c: str) -> str:
    """LaTeX of a text of ASCII and those letters."""
    marks = {"\\": "{\\textbackslash}", "%": "\\%", "#": "\\#", "&": "\\&", "_": "\\_", "$": "\\$", "{": "\\{", "}": "\\}", "~": "{\\textasciitilde}", "^": "{\\textasciicircum}"}
    out = f"translate({c}, '{''.join(marks)}', '{''.join(chr(0xFDD0 + k) for k in range(len(marks)))}')"
    for k, written in enumerate(marks.values()):
        out = f"replace({out}, '{chr(0xFDD0 + k)}', '{written}')"
    for letter, written in ACCENTED.items():
        out = "replace({}, '{}', '{}')".format(out, letter, written.replace("'", "''"))
    return out


def _mark_sql(form: str) -> str:
    """A mark m with its kind (M, E or T) and inner text c in one format."""
    eq = {"plain": ("\\(", "\\)"), "markdown": ("$", "$"), "latex": ("\\(", "\\)"), "html": ("\\(", "\\)")}[form]
    mol = {"plain": "c", "markdown": "'`' || c || '`'", "latex": f"'\\texttt{{' || {_uni('c')} || '}}'", "html": f"'<code>' || {_esc('c')} || '</code>'"}[form]
    text = {"plain": "c", "markdown": "c", "latex": _uni("c"), "html": _esc("c")}[form]
    return f"CASE k WHEN 'E' THEN '{eq[0]}' || c || '{eq[1]}' WHEN 'M' THEN {mol} ELSE {text} END AS {form}"


_blank = T.SPACES.replace("'", "''")
_kind = f"""CASE WHEN m LIKE '***%' OR m LIKE '<code>%' OR m LIKE '`%' THEN 'M' WHEN m LIKE '\\%' THEN 'E'
  WHEN m LIKE '$$%' THEN CASE WHEN regexp_matches(substr(m, 3, length(m) - 4), '{S.LATEX_MARK}') THEN 'E' ELSE 'T' END
  WHEN regexp_matches(substr(m, 2, length(m) - 2), '{S.LATEX_MARK}') THEN 'E' ELSE 'T' END"""
_inside = """CASE WHEN k = 'T' THEN m ELSE trim(CASE WHEN m LIKE '***%' THEN substr(m, 4, length(m) - 6) WHEN m LIKE '<code>%' THEN substr(m, 7, length(m) - 13)
  WHEN m LIKE '\\%' OR m LIKE '$$%' THEN substr(m, 3, length(m) - 4) ELSE substr(m, 2, length(m) - 2) END, '""" + _blank + "') END"
_cell = "' ' || rpad(coalesce({c}, ''), CAST(w[{j}] AS INTEGER), ' ') || ' '"
#: A Markdown table of h (names) and b (rows of texts) with widths w.
_PIPE = """'|' || array_to_string(list_transform(range(1, len(h) + 1), lambda j: ' ' || rpad(coalesce(h[j], 'None'), CAST(w[j] AS INTEGER), ' ') || ' '), '|') || '|' || chr(10)
  || '|' || array_to_string(list_transform(w, lambda n: ':' || repeat('-', CAST(n AS INTEGER) + 1)), '|') || '|'
  || array_to_string(list_transform(b, lambda r: chr(10) || '|' || array_to_string(list_transform(range(1, len(h) + 1), lambda j: ' ' || rpad(coalesce(r[j], ''), CAST(w[j] AS INTEGER), ' ') || ' '), '|') || '|'), '')"""
_WIDE = "list_transform(range(1, len(h) + 1), lambda j: greatest(length(coalesce(h[j], 'None')) + 2, coalesce(list_max(list_transform(b, lambda r: length(coalesce(r[j], '')))), 0)))"
_html_row = lambda r, tag: f"'      <{tag}>' || array_to_string(list_transform({r}, lambda c: {_esc3('coalesce(c, $$None$$)')}), '</{tag}>' || chr(10) || '      <{tag}>') || '</{tag}>' || chr(10) || '    </tr>' || chr(10)"
_word = "regexp_replace(text, '[^a-z ]', '', 'g')"
_structure = "<table><tr><td>[[VL_TABLE_0_0]][[VL_TABLE_0_1]]</td><td>[[VL_TABLE_1_0]][[VL_TABLE_1_1]]</td></tr></table>"
_first, _last = f"string_split({_word}, ' ')[1]", f"string_split({_word}, ' ')[-1]"


def _reaction_sql(form: str) -> str:
    mol = {"plain": "{}", "markdown": "'`' || {} || '`'", "latex": "'\\texttt{{' || {} || '}}'", "html": "'<code>' || {} || '</code>'"}[form]
    show = lambda c: f"CASE WHEN {c} = '' THEN NULL ELSE {mol.format(c)} END"
    eq = "and $k_1$" if form == "markdown" else "and \\(k_1\\)"
    pd = {"plain": "Pd&C", "markdown": "Pd&C", "latex": "Pd\\&C", "html": "Pd&amp;C"}[form]
    sep = "<br>" if form == "html" else ","
    parts = {"reactants": f"concat_ws('{sep}', {show('f')}, '{eq}')", "conditions": f"concat_ws('{sep}', nullif(l, ''), {mol.format(chr(39) + pd + chr(39))})", "products": f"coalesce({show('l')}, '')"}
    if form == "html":
        row = "'<tr><td>' || " + " || '</td><td>' || ".join(parts[k] for k in ("reactants", "conditions", "products")) + " || '</td></tr>'"
        return f"'<table><tr><th>reactants</th><th>conditions</th><th>products</th></tr>' || {row} || CASE WHEN block % 2 = 0 THEN '<tr><td></td><td></td><td></td></tr>' ELSE '' END || '</table>' AS html"
    cells = f"['0', {parts['reactants']}, {parts['products']}, {parts['conditions']}]"
    rows = f"CASE WHEN block % 2 = 0 THEN [{cells}, ['1', '', '', '']] ELSE [{cells}] END"
    names = "['No.', 'reactants', 'products', 'conditions']"
    if form == "latex":
        body = f"array_to_string(list_transform({rows}, lambda r: array_to_string(r, ' & ') || ' \\\\' || chr(10)), '')"
        return f"'\\begin{{tabular}}{{llll}}' || chr(10) || array_to_string({names}, ' & ') || ' \\\\' || chr(10) || {body} || '\\end{{tabular}}' || chr(10) AS latex"
    return f"(SELECT {_PIPE} FROM (SELECT *, {_WIDE} AS w FROM (SELECT {names} AS h, {rows} AS b))) AS {form}"


SQL = {
    "latex_texts": f"""WITH d AS (SELECT doc_id, {_uni("coalesce(text, '')")} AS t FROM documents) SELECT doc_id, sha256(t) AS latex_hash, length(t) AS latex_chars FROM d""",
    "inline_spans": f"""WITH {BLOCKS_SQL}, r AS (SELECT token, page, block, CASE block % 4 WHEN 0 THEN text || ' $a_1$ and $5 or $6 ***CCO***' WHEN 1 THEN '`N#N`\\(x^2 \\) ' || text
  WHEN 2 THEN text || '$$ E = mc^2 $$<code> C1 </code> \\[ z \\]tail %' ELSE text END AS t FROM blocks),
p AS (SELECT token, page, block, string_split_regex(t, '{S.SPAN}') AS pieces, regexp_extract_all(t, '{S.SPAN}', 0) AS marks FROM r),
u AS (SELECT token, page, block, i, part, 'T' AS k, part AS c FROM (SELECT token, page, block, unnest(range(len(pieces))) * 2 AS i, unnest(pieces) AS part FROM p)
  UNION ALL SELECT token, page, block, i, m, k, {_inside} FROM (SELECT *, {_kind} AS k FROM (SELECT token, page, block, unnest(range(len(marks))) * 2 + 1 AS i, unnest(marks) AS m FROM p))),
f AS (SELECT token, page, block, i, k, c, {', '.join(_mark_sql(f) for f in ('plain', 'markdown', 'latex', 'html'))},
  CASE WHEN k = 'E' AND NOT (c LIKE '$%' OR c LIKE '\\(%' OR c LIKE '\\[%') THEN '$' || c || '$' WHEN k = 'M' AND NOT c LIKE '`%' THEN '`' || c || '`' ELSE c END AS qa FROM u)
SELECT token, page, block, coalesce(regexp_replace(string_agg(CASE WHEN k = 'T' AND c = '' THEN '' ELSE k END, '' ORDER BY i), 'T+', 'T', 'g'), '') AS kinds,
  {', '.join(f"string_agg({f}, '' ORDER BY i) AS {f}" for f in ('plain', 'markdown', 'latex', 'html', 'qa'))} FROM f GROUP BY token, page, block""",
    "chart_frames": f"""WITH {BLOCKS_SQL}, l AS (SELECT token, page, block, list_transform(string_split(trim(translate(text, ' ', '|'), '|'), '|'), lambda c: nullif(trim(c, '{_blank}'), '')) AS r FROM blocks),
g AS (SELECT token, page, list(r ORDER BY block) AS raw, max(len(r)) AS wide FROM l GROUP BY token, page),
q AS (SELECT token, page, list_filter(list_transform(raw, lambda r: list_resize(r, wide)), lambda r: list_count(r) > 0) AS r FROM g),
n AS (SELECT token, page, r, r[1] AS h, r[2:] AS b, len(r) > 1 AS ok FROM q), w AS (SELECT *, {_WIDE} AS w FROM n)
SELECT token, page, CAST(len(r) AS INTEGER) AS n_rows, CAST(coalesce(len(r[1]), 0) AS INTEGER) AS n_cols, sha256(CASE WHEN ok THEN {_PIPE} ELSE '' END) AS markdown,
sha256(CASE WHEN ok THEN '\\begin{{tabular}}{{' || repeat('l', len(h)) || '}}' || chr(10) || array_to_string(list_transform(h, lambda c: coalesce(c, 'None')), ' & ') || ' \\\\' || chr(10)
  || array_to_string(list_transform(b, lambda r: array_to_string(list_transform(r, lambda c: {_lat("coalesce(c, 'None')")}), ' & ') || ' \\\\' || chr(10)), '') || '\\end{{tabular}}' || chr(10) ELSE '' END) AS latex,
sha256(CASE WHEN ok THEN '<table border="1" class="dataframe">' || chr(10) || '  <thead>' || chr(10) || '    <tr style="text-align: right;">' || chr(10) || {_html_row('h', 'th')} || '  </thead>' || chr(10) || '  <tbody>' || chr(10)
  || array_to_string(list_transform(b, lambda r: '    <tr>' || chr(10) || {_html_row('r', 'td')}), '') || '  </tbody>' || chr(10) || '</table>' ELSE '' END) AS html FROM w""",
    "table_frames": f"""WITH {BLOCKS_SQL}, l AS (SELECT token, page, block, string_split(text, ' ') AS r FROM blocks), g AS (SELECT token, page, list(r ORDER BY block) AS raw, max(len(r)) AS wide FROM l GROUP BY token, page),
q AS (SELECT token, page, list_transform(raw, lambda r: list_transform(list_resize(r, wide), lambda c: coalesce(c, ''))) AS r FROM g),
n AS (SELECT token, page, r[1] AS h, list_filter(r[2:], lambda x: array_to_string(x, '') <> '') AS b FROM q), w AS (SELECT *, {_WIDE} AS w FROM n)
SELECT token, page, CAST(len(b) + 1 AS INTEGER) AS n_rows, sha256(CASE WHEN len(b) > 0 THEN {_PIPE} ELSE '' END) AS plain, sha256(CASE WHEN len(b) > 0 THEN {_PIPE} ELSE '' END) AS markdown,
sha256(CASE WHEN len(b) > 0 THEN '\\begin{{tabular}}{{' || repeat('l', len(h)) || '}}' || chr(10) || array_to_string(h, ' & ') || ' \\\\' || chr(10) || array_to_string(list_transform(b, lambda r: array_to_string(r, ' & ') || ' \\\\' || chr(10)), '') || '\\end{{tabular}}' || chr(10) ELSE '' END) AS latex FROM w""",
    "table_spans": f"""WITH {BLOCKS_SQL}, t AS (SELECT token, page, block, {_word} AS w FROM blocks)
SELECT token, page, block, '{_structure}' AS structure, w || ' |x_1|R&D ' || w || '|C' AS contents, 'text|equationinline|text|molecule' AS types,
'<table><tr><td>' || w || ' \\(x_1\\)</td><td>R&amp;D ' || w || 'C</td></tr></table>' AS plain, '<table><tr><td>' || w || ' $x_1$</td><td>R&amp;D ' || w || '`C`</td></tr></table>' AS markdown,
'<table><tr><td>' || w || ' \\(x_1\\)</td><td>R&amp;D ' || w || '<code>C</code></td></tr></table>' AS html, '<table><tr><td>' || w || ' $x_1$</td><td>R&D ' || w || '`C`</td></tr></table>' AS qa FROM t""",
    "expression_tables": f"""WITH {BLOCKS_SQL}, t AS (SELECT token, page, block, {_first} AS f, {_last} AS l FROM blocks)
SELECT token, page, block, 5 AS n_components, l AS third, f || ', and $k_1$ |' || l || '|' || l || '|Pd&C' AS summary, {', '.join(map(_reaction_sql, ('plain', 'markdown', 'latex', 'html')))} FROM t""",
}

"""Chemical reactions: arrays of structs of reactants, conditions and products, each an array of components."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.frames import frame
from folio.functions.spans import MOLECULE, OPENS, TEXT, format_span, inline_spans, inline_text
from folio.functions.text import SPACES, bound

COMPONENT = "struct<bbox:struct<x1:double,y1:double,x2:double,y2:double>,category:string,category_id:int,text:string>"
REACTIONS = f"array<struct<reactants:array<{COMPONENT}>,conditions:array<{COMPONENT}>,products:array<{COMPONENT}>>>"

PARTS = ("reactants", "conditions", "products")
FORMS = ("plain", "markdown", "latex", "html")


def read_reactions(raw: Column) -> Column:
    """JSON to reactions; unknown fields go, missing lists are empty."""
    found = F.from_json(raw, REACTIONS)
    lists = lambda r: [F.coalesce(r[k], F.array().cast(f"array<{COMPONENT}>")).alias(k) for k in PARTS]
    return F.transform(found, lambda r: F.struct(*lists(r)))


def is_molecule(c: Column) -> Column:
    return F.coalesce(c["category_id"] == 1, F.lit(False)) | F.coalesce(c["category"] == "[Mol]", F.lit(False))


def component_texts(c: Column) -> Column:
    """struct of a component in each of FORMS: a molecule, or text with inline spans; empty without text. What is one span
    is written at once; only a text in which a mark could begin is cut into spans, once for all forms."""
    own = F.struct(F.trim(F.coalesce(c["text"], F.lit("")), F.lit(SPACES)).alias("text"), is_molecule(c).alias("mol"))
    all_forms = lambda of: F.struct(*[of(form).alias(form) for form in FORMS])

    def written(o: Column) -> Column:
        text = o["text"]
        alone = lambda kind: all_forms(lambda form: format_span(text, F.lit(kind), form))
        cut = bound(inline_spans(text), lambda s: all_forms(lambda form: inline_text(s, form)))
        return F.when(text == "", all_forms(lambda _: F.lit(""))).when(o["mol"], alone(MOLECULE)).when(~text.rlike(OPENS), alone(TEXT)).otherwise(cut)

    return bound(own, written)


def reaction_texts(reactions: Column) -> Column:
    """The reactions with `component_texts` in place of each component, from which `expression` makes its tables."""
    return F.transform(reactions, lambda r: F.struct(*[F.transform(r[k], component_texts).alias(k) for k in PARTS]))


def components_text(texts: Column, form: str, between: str = ",") -> Column:
    return F.array_join(F.filter(F.transform(texts, lambda c: c[form]), lambda t: t != ""), between)


def all_components(reaction: Column) -> Column:
    """Reactants, conditions and products in this order; the n-th by `F.get`."""
    return F.concat(reaction["reactants"], reaction["conditions"], reaction["products"])


def summary(reaction: Column) -> Column:
    """struct<prev_mols, post_mols, condition<text, catalyst>>: texts of reactants and products; of the conditions those
    that are no molecules joined, and the molecules."""
    texts = lambda cs: F.transform(cs, lambda c: F.coalesce(c["text"], F.lit("")))
    mol = lambda c: F.coalesce(c["category_id"] == 1, F.lit(False))
    rest = F.array_join(texts(F.filter(reaction["conditions"], lambda c: ~mol(c))), "")
    condition = F.struct(rest.alias("text"), texts(F.filter(reaction["conditions"], mol)).alias("catalyst"))
    return F.struct(texts(reaction["reactants"]).alias("prev_mols"), texts(reaction["products"]).alias("post_mols"), condition.alias("condition"))


def expression(reactions: Column, form: str) -> Column:
    """All reactions (as `reaction_texts` has them) as a table: number, reactants, products and conditions; in html
    reactants, conditions and products, with a line for each component. Empty without a reaction."""
    if form == "html":
        cell = lambda cs: F.concat(F.lit("<td>"), components_text(cs, "html", "<br>"), F.lit("</td>"))
        rows = F.transform(reactions, lambda r: F.concat(F.lit("<tr>"), cell(r["reactants"]), cell(r["conditions"]), cell(r["products"]), F.lit("</tr>")))
        out = F.concat(F.lit("<table><tr><th>reactants</th><th>conditions</th><th>products</th></tr>"), F.array_join(rows, ""), F.lit("</table>"))
        return F.when(F.size(reactions) > 0, out).otherwise(F.lit(""))
    rows = F.transform(reactions, lambda r, i: F.array(i.cast("string"), *[components_text(r[k], form) for k in ("reactants", "products", "conditions")]))
    return frame(F.concat(F.array(F.array(*map(F.lit, ("No.", "reactants", "products", "conditions")))), rows), form)

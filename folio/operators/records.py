"""Small relational operators on documents, molecules, jobs and images."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import SPACES, input_kind
from folio.operators.tree import PAGE, parent_of

# How a DOI line begins, a DOI inside a text, a caption spelled apart, and what parts a molecule's texts.
DOI_START = r"(?i)^(?:doi:10\.|https://doi\.org/)"
DOI = r"(?i)(?:doi:|https://doi\.org/)10\.\S+"
SPELLED = ("F IGU R E", "FIGURE")
SEP = "<sep>"


def without_dois(blocks: DataFrame, lines: str | None = None) -> DataFrame:
    """Blocks without those that begin with a DOI. Of the others' lines (an array column) those that do go, or, without
    lines, DOIs inside the text; `FIGURE` spelled apart is mended."""
    mended = lambda t: F.replace(t, F.lit(SPELLED[0]), F.lit(SPELLED[1]))
    kept = blocks.where(~F.coalesce(F.col("text").rlike(DOI_START), F.lit(False)))
    if lines is None:
        return kept.withColumn("text", mended(F.regexp_replace("text", DOI, "")))
    named = F.lower("text").contains("doi:10.") | F.lower("text").contains("https://doi.org/")
    own = F.filter(lines, lambda x: ~x.rlike(DOI_START))
    kept = kept.withColumn("_own", F.when(named & (F.size(lines) > 0), own))
    text = F.when(F.col("_own").isNotNull(), F.array_join("_own", " ")).when(named, F.regexp_replace("text", DOI, "")).otherwise(F.col("text"))
    return kept.withColumn("text", mended(text)).withColumn(lines, F.coalesce("_own", lines)).drop("_own")


def molecules(nodes: DataFrame) -> DataFrame:
    """token, page, path, smiles, caption, name of the molecules in molecule groups that have a structure: `smiles` up to a
    separator, `name` the text of the first molecule id beside it, none if that has a separator.

    nodes: token, page, path, type, text (of ids), smi and caption (of molecules).
    """
    trim = lambda c: F.trim(c, F.lit(SPACES))
    up = parent_of(F.col("path"))
    groups = nodes.where("type = 'moleculegroup'").select(*PAGE, F.col("path").alias("_up"))
    kids = nodes.where(F.size("path") > 1).withColumn("_up", up).join(groups, [*PAGE, "_up"], "left_semi")
    ids = kids.where("type = 'moleculeid'").groupBy(*PAGE, "_up").agg(F.min(F.struct("path", "text"))["text"].alias("_id"))
    own = kids.where("type = 'molecule'").join(ids, [*PAGE, "_up"], "left")
    smiles = trim(F.element_at(F.split(F.coalesce(F.nullif("smi", F.lit("")), F.lit("")), SEP), 1))
    name = F.when(F.col("_id").contains(SEP), F.lit("")).otherwise(trim(F.coalesce("_id", F.lit(""))))
    return own.select(*PAGE, "path", smiles.alias("smiles"), trim(F.coalesce("caption", F.lit(""))).alias("caption"), name.alias("name")).where("smiles != ''")


def image_paths(references: DataFrame, index: DataFrame, base: str) -> DataFrame:
    """references (with `rel`) and `path`: that of the image with the same file name, else rel under `base`. index: name,
    path, a row for each name."""
    name = F.element_at(F.split(F.col("rel"), "/"), -1)
    return references.withColumn("_name", name).join(index.select(F.col("name").alias("_name"), F.col("path").alias("_path")), "_name", "left").withColumn("path", F.coalesce("_path", F.concat(F.lit(base.rstrip("/") + "/"), "rel"))).drop("_name", "_path")


def progress(counters: DataFrame, names: tuple[str, ...], sign: Column | None = None) -> DataFrame:
    """One row with each counter's sum, rows with `sign` -1 taken away; total_ and proc_ of each name."""
    times = sign if sign is not None else F.lit(1)
    return counters.agg(*[F.coalesce(F.sum(F.col(f"{kind}_{n}") * times), F.lit(0)).alias(f"{kind}_{n}") for n in names for kind in ("total", "proc")])


def bookkeeping(taken: DataFrame, tried: DataFrame, key: str = "keyword") -> DataFrame:
    """token, key of what was tried and not taken; repeats count, so each taken one takes away one."""
    return tried.select("token", key).exceptAll(taken.select("token", key))


def unexplained(kinds: Column, known: tuple[str, ...]) -> Column:
    """The types, each once and in order, that don't belong to the known ones."""
    return F.array_sort(F.array_distinct(F.array_except(kinds, F.array(*map(F.lit, known)))))


def success_records(results: DataFrame, preview: int = 2000) -> DataFrame:
    """token, output_dir, markdown_path, pages_tree_path, content_chars, content_preview of results (token, stem,
    output_dir, content); the preview has `preview` characters at most, none below 1."""
    content = F.coalesce("content", F.lit(""))
    at = lambda name: F.concat("output_dir", F.lit("/"), name)
    return results.select(
        "token", "output_dir", at(F.concat(F.coalesce(F.nullif("stem", F.lit("")), F.lit("document")), F.lit(".md"))).alias("markdown_path"), at(F.lit("pages_tree.json")).alias("pages_tree_path"),
        F.length(content).alias("content_chars"), F.substring(content, 1, max(0, preview)).alias("content_preview"),
    )


def resolved_files(inputs: DataFrame, files: DataFrame) -> DataFrame:
    """inputs (with a column input) with `kind` (url, image or file) and `error`: an empty input is one, and a path that
    isn't among the `files` (path, distinct), as Spark lists them."""
    own = inputs.withColumn("_path", F.trim("input"))
    there = own.join(files.select(F.col("path").alias("_path"), F.lit(True).alias("_there")), "_path", "left")
    kind = input_kind(F.coalesce("_path", F.lit("")))
    error = F.when(kind == "error", "input is empty").when((kind != "url") & F.col("_there").isNull(), F.concat(F.lit("file not found: "), "_path"))
    return there.select(*inputs.columns, F.when(error.isNull(), kind).alias("kind"), error.alias("error"))


def error_records(outcomes: DataFrame, stage: str = "get_result_poll", deadline: int = 1800) -> DataFrame:
    """token, code, record (JSON) of jobs (token, outcome, checks, and description if there is one) that didn't succeed:
    TOKEN_NOT_FOUND, PARSE_ERROR, or UPLOAD_ERROR for what couldn't be sent. Without a token: MISSING_TOKEN."""
    said = F.nullif(F.col("description"), F.lit("")) if "description" in outcomes.columns else F.lit(None).cast("string")
    named = F.coalesce("token", F.lit("")) != ""
    code = F.when(~named, "MISSING_TOKEN").when(F.col("outcome") == "not_found", "TOKEN_NOT_FOUND").when(F.col("outcome") == "failed", "UPLOAD_ERROR").otherwise("PARSE_ERROR")
    message = F.when(~named, "--token is required. Use the token from a prior successful parse trigger response.").when(F.col("outcome") == "not_found", F.concat(F.lit("The service did not recognize this token after "), F.col("checks").cast("string"), F.lit(" checks.")))
    message = message.when(F.col("outcome") == "timeout", f"Timed out after {deadline}s waiting for parsing to finish.").otherwise(F.coalesce(said, F.concat(F.lit("status: "), F.coalesce("outcome", F.lit("none")))))
    failed = outcomes.where(~named | (F.coalesce("outcome", F.lit("none")) != "success")).withColumn("code", code)
    error = F.when(F.col("code") == "MISSING_TOKEN", F.struct("code", message.alias("message"), F.lit(None).cast("string").alias("stage"))).otherwise(F.struct("code", message.alias("message"), F.lit(stage).alias("stage")))
    return failed.select("token", "code", F.to_json(F.struct(F.lit(False).alias("ok"), F.when(named, F.col("token")).alias("token"), error.alias("error"))).alias("record"))


def one_after_the_other(*parts: DataFrame) -> DataFrame:
    """Rows of all parts with `part`, their place: the top of a page, its bottom and its margin, say."""
    return reduce(DataFrame.unionByName, [p.withColumn("part", F.lit(k)) for k, p in enumerate(parts)])

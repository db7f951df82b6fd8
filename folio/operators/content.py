"""The content list of a parsed document, from which questions and answers are asked for: texts, tables, equations and
images, numbered; and the images that are written for it, one file for each content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.kinds import QA_CAPTIONS, QA_IMAGES, QA_SKIPPED
from folio.functions.text import SPACES
from folio.operators.tree import PAGE, parent_of

# A data URL, extensions by magic numbers, types whose sources aren't written, least bytes of bare base64.
DATA_URL = r"(?s)^data:image/([a-zA-Z0-9.+-]+);base64,(.*)$"
MAGIC = (("89504E47", "png"), ("47494638", "gif"))
FORMATS = ("jpg", "png", "gif", "webp", "bmp")
NOT_WRITTEN = ("figurecaption", "imagecaption", "paragraph", "title", "documenttitle", "equation", "expression", "hline", "pageheader", "pagefooter", "pagenumber")
LEAST_BYTES = 32


def extension(raw: Column, form: Column | None = None) -> Column:
    """By the named format if it is a known one, else by the first bytes; jpg without either."""
    magic = F.hex(F.substring(raw, 1, 16))
    out = F.lit("jpg")
    found = F.when(F.lit(False), out)
    if form is not None:
        named = F.replace(F.lower(form), F.lit("jpeg"), F.lit("jpg"))
        found = found.when(named.isin(*FORMATS), named)
    for start, name in MAGIC:
        found = found.when(magic.startswith(start), name)
    return found.when(magic.startswith("52494646") & magic.contains("57454250"), "webp").otherwise(out)


def decoded(source: Column) -> Column:
    """struct<raw, ext> of a data URL or bare base64 of LEAST_BYTES at least; null for what is neither. Characters that
    base64 doesn't have are passed over."""
    s = F.trim(source, F.lit(SPACES))
    body = F.regexp_extract(s, DATA_URL, 2)
    bytes_of = lambda x: F.try_to_binary(F.regexp_replace(x, "[^A-Za-z0-9+/=]", ""), F.lit("base64"))
    url, bare = bytes_of(body), bytes_of(s)
    of_url = F.when(url.isNotNull(), F.struct(url.alias("raw"), extension(url, F.regexp_extract(s, DATA_URL, 1)).alias("ext")))
    of_bare = F.when(F.length(bare) >= LEAST_BYTES, F.struct(bare.alias("raw"), extension(bare).alias("ext")))
    return F.when(s == "", F.lit(None)).when(s.rlike(DATA_URL), of_url).otherwise(of_bare)


def image_files(nodes: DataFrame) -> DataFrame:
    """token, page, block, hash, name, n: for each node with a readable source the file that shows it; equal contents of a
    document share one, whose extension is that of the first. nodes: token, page, block, path, type, source."""
    own = nodes.where(~F.lower("type").isin(*NOT_WRITTEN)).withColumn("d", decoded(F.col("source"))).where("d is not null")
    hashed = own.select("token", "page", "block", "path", F.sha2("d.raw", 256).alias("hash"), F.col("d.ext").alias("ext"))
    same = Window.partitionBy("token", "hash").orderBy("page", "path")
    return hashed.select("token", "page", "block", "path", "hash", F.concat_ws(".", "hash", F.first("ext").over(same)).alias("name"), F.row_number().over(same).alias("n"))


def content_list(nodes: DataFrame, prefix: str = "vqa_images") -> DataFrame:
    """token, id, type, text, img_path, caption: the nodes of a document in order of page and path that say something.

    nodes: token, page, block, path, type, text, descr, source. Page furniture and captions go. A node of an image type
    whose source (its own, else that of its first child with one) has a file is an image, shown once, with the captions
    among its children or else its description; one shown before is passed over without an id. Then come tables and
    equations with their text, and what else has any.
    """
    kind, text = F.lower(F.trim("type")), F.trim(F.coalesce("text", F.lit("")), F.lit(SPACES))
    own = nodes.select("*", kind.alias("_kind"), text.alias("_text"), (F.trim(F.coalesce("source", F.lit(""))) != "").alias("_has"))
    kids = own.where(F.size("path") > 1).groupBy(*PAGE, parent_of(F.col("path")).alias("path")).agg(
        F.min(F.when(F.col("_has"), F.struct("path", "block", "descr"))).alias("_child"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_kind").isin(*QA_CAPTIONS) & (F.col("_text") != ""), F.struct("path", "_text")))), lambda c: c["_text"]).alias("_captions"),
    )
    own = own.join(kids, [*PAGE, "path"], "left").where(~F.col("_kind").isin(*QA_SKIPPED, *QA_CAPTIONS))
    shows = F.col("_kind").isin(*QA_IMAGES)
    asked = own.withColumn("_from", F.when(shows, F.when(F.col("_has"), F.col("block")).otherwise(F.col("_child.block"))))
    files = image_files(nodes).groupBy(*PAGE, F.col("block").alias("_from")).agg(F.max(F.struct("path", "name"))["name"].alias("_name"))
    found = asked.join(files, [*PAGE, "_from"], "left")
    first = F.row_number().over(Window.partitionBy("token", "_name").orderBy("page", "path"))
    found = found.withColumn("_nth", F.when(F.col("_name").isNotNull(), first)).where("_nth is null or _nth = 1")
    shown = F.col("_name").isNotNull()
    out = F.when(F.col("_kind") == "equation", F.when((F.col("_text") != "") | F.col("_has"), "equation")).when(shown, "image")
    out = out.when(F.col("_kind").isin("figuregroup", "imagegroup"), F.lit(None)).when((F.col("_kind") == "table") & (F.col("_text") != ""), "table").when(F.col("_text") != "", "text")
    rows = found.withColumn("_out", out).where("_out is not null")
    described = F.trim(F.coalesce(F.nullif(F.col("descr"), F.lit("")), F.col("_child.descr"), F.lit("")), F.lit(SPACES))
    caption = F.when(F.size("_captions") > 0, F.array_join("_captions", "\n")).otherwise(described)
    number = F.row_number().over(Window.partitionBy("token").orderBy("page", "path")) - 1
    image = F.col("_out") == "image"
    return rows.select("token", number.alias("id"), F.col("_out").alias("type"), F.when(~image, F.col("_text")).alias("text"), F.when(image, F.concat(F.lit(prefix + "/"), "_name")).alias("img_path"), F.when(image, caption).alias("caption"))

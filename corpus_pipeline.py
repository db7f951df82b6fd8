"""The corpus pipeline: five stages, each an operator of folio.llm, applied to all documents that the one before kept.

A stage is a function of (spark, docs, sf_dir); docs has the columns of documents, and so has the result of every stage
but the last; other columns are left out. Stages decide by row, told by a hash of all its columns, so null and repeated
doc_ids are treated like others; a null text is empty. Rows that repeat in all columns share what is decided for them.
An empty table passes all stages and gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import decontam, jaccard, mixing, sharding, toxicity
from folio.llm.common import MADE, drop_made, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at toxicity.THRESHOLD or above go."""
    docs = docs.select(*COLUMNS)
    return toxicity.below(docs, toxicity.fit(toxicity.labelled(docs, table(spark, sf_dir, "labels"))))


def keyed(docs: DataFrame) -> DataFrame:
    """`docs` with `_row`, a hash that tells its rows apart."""
    return docs.select(*COLUMNS).withColumn("_row", F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in COLUMNS]))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one row stays: that with the smallest doc_id (null last), then the smallest hash.
    Documents without a word are linked with nothing and all stay."""
    rows = keyed(docs)
    found = stored(jaccard.similar(rows.select(F.col("_row").alias("doc_id"), "text")), "groups")
    linked = found.where("n_shingles > 0").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("group"))
    chosen = linked.distinct().join(rows.select("_row", "doc_id").distinct(), "_row").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("_row"))
    kept = rows.join(chosen.select("_row"), "_row", "left_semi")
    if linked.groupBy("_row").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["_row"])
    wordless = found.where("n_shingles = 0").select(F.col("doc_id").alias("_row")).distinct()
    return kept.unionByName(rows.join(wordless, "_row", "left_semi")).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage like a benchmark item go."""
    rows = keyed(docs)
    bad = decontam.contaminated(rows.select(F.col("_row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return rows.join(bad.select(F.col("doc_id").alias("_row")).distinct(), "_row", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, to the nearest whole number; one without words stays once. Of
    rows that are alike in doc_id, source and text, that with the smallest lang stands for all, as often as all of them
    together."""
    docs = docs.select(*COLUMNS)
    documents, _, _ = mixing.mix(docs)
    often = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5))
    times = stored(documents.groupBy("row").agg(F.sum(often).cast("int").alias("times"), F.count(F.lit(1)).alias("rows")).where("times > 0"), "times")
    rows = docs.withColumn("row", mixing.row_hash())
    if times.where("rows > 1").limit(1).count():
        rows = rows.groupBy("row").agg(F.min(F.struct("lang", *[c for c in COLUMNS if c != "lang"])).alias("one")).select("row", "one.*")
    return rows.join(times, "row").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in eight shards of nearly equal bytes."""
    return sharding.kd_shards(docs.select(*COLUMNS))


STAGES = [("toxicity", drop_toxic), ("near copies", drop_near_copies), ("decontamination", drop_contaminated), ("mixing", mix_sources), ("sharding", shard)]
#: No SQL can express the classifier; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage. A stage's own tables, and its input, go when its result is written."""
    docs, since = table(spark, sf_dir, "documents"), len(MADE)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        drop_made(spark, since)
    return docs

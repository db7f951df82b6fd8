"""Mixing sources to target weights by a low-discrepancy source schedule.

Slot i of the mix has the golden-ratio point frac((i + 0.5) * phi); mapped through the sources' cumulative target
shares it names a source. A source's r-th slot takes the r-th of its shuffled equal-token blocks, pass after pass,
until the source's target is reached, where the last block is cut. So every prefix of the schedule is near the target
weights, and the whole takes each target exactly (rounded to a word). Slots of a source whose target is reached are
dropped, and a source that has fewer slots than blocks to take gets the missing ones at the end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import WORD, buckets_for, spread, stored, table

GOLDEN = (math.sqrt(5) - 1) / 2
#: Words in a block, nearly: a source's blocks are all of one size, give or take a word.
BLOCK = 16_384
WEIGHTS = (5.0, 2.0, 1.0)
MOST_PASSES = 3
#: Buckets of [0, 1) by which slots meet the sources' intervals.
CELLS = 1024


def targets(sizes: DataFrame, weights: DataFrame, most: int = MOST_PASSES) -> DataFrame:
    """Target words of each source: its weight's share of all words, `most` times its own size at most; what is above
    is shared out again by weight until none is above.

    sizes: key, source_size; weights: key, weight > 0. The limit binds the sources with the smallest size / weight
    first. In that order, source k is bound when its limit is below its share of what the sources before it leave; the
    first source that isn't bound sets the level for the rest. Returns key, source_size, target.
    """
    both = sizes.join(weights, "key").withColumn("_limit", most * F.col("source_size").cast("double")).withColumn("_fill", F.col("_limit") / F.col("weight"))
    # a row for each source: sums from the front and to the end, in order of fill level
    order = Window.orderBy("_fill", "key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    ranked = both.select(
        "*",
        F.coalesce(F.sum("_limit").over(before), F.lit(0.0)).alias("_before"),
        F.sum("weight").over(after).alias("_after"),
        F.sum("source_size").over(everything).cast("double").alias("_all"),
    )
    level = (F.col("_all") - F.col("_before")) / F.col("_after")
    first = F.min(F.when(F.col("_fill") > level, F.struct("_fill", "key", level.alias("level")))).over(everything)["level"]
    water = ranked.select("*", first.alias("_level"))
    free = F.col("_fill") > F.col("_level")
    return water.select("key", "source_size", F.when(free, F.col("weight") * F.col("_level")).otherwise(F.col("_limit")).alias("target"))


def default_weights(sizes: DataFrame, cycle: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Weights 5, 2, 1, repeating, to the sources in order of code points, null last."""
    nth = (F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1) % len(cycle)
    return sizes.select("key", F.element_at(F.array(*map(F.lit, cycle)), (nth + 1).cast("int")).alias("weight"))


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """key, rank (0-based among the source's slots), slot: the source of each of `slots` golden-ratio points.

    sources: key, lo, hi (its interval of [0, 1)). An interval is cut into CELLS cells, so that slots meet sources by
    an equal-join whose keys all have about the same number of slots.
    """
    spark = sources.sparkSession
    cut = sources.where("hi > lo").select(
        "key", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell")
    )
    at = (F.col("id") + F.lit(0.5)) * F.lit(GOLDEN)
    points = spark.range(slots).select(F.col("id").alias("slot"), (at - F.floor(at)).alias("x")).withColumn("cell", F.floor(F.col("x") * CELLS))
    named = points.join(cut, "cell").where("x >= lo and x < hi").select("key", "slot")
    # ranks by chunks of the schedule: no task counts all slots of a source
    chunk = 2 ** max(10, math.ceil(math.log2(max(2, slots)) / 2))
    named = named.withColumn("chunk", F.floor(F.col("slot") / chunk))
    before = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = named.groupBy("key", "chunk").count().select("key", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("key", "chunk").orderBy("slot")
    return named.join(base, ["key", "chunk"]).select("key", (F.col("base") + F.row_number().over(within) - 1).alias("rank"), "slot")


def row_hash(seed: int = 17) -> Column:
    """What tells a row of documents from others, and shuffles it."""
    return F.xxhash64(F.lit(seed), "doc_id", "source", F.coalesce("text", F.lit("")))


def mix(docs: DataFrame, weights: DataFrame | None = None, block: int = BLOCK, most: int = MOST_PASSES, seed: int = 17) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mix `docs` (doc_id, text, source; further columns are not read): documents, blocks and the schedule.

    weights: source, weight (> 0) for every source; without it, 5, 2, 1 in turn. Returns

    * documents: doc_id, source, size (words), source_size, target, taken (words the mix takes, repeats counted), and
      `row`, a hash of doc_id, source and text;
    * blocks: key, slot, pass, block, words (how many of the block's first words are taken);
    * places: row, key, block, and the words [first, last) of the block that the document fills.

    A null or empty text has size 0 and nothing of it is taken. Null is a source of its own. Repeated rows are rows of
    their own, each taken. The shuffle is by a hash with `seed`, so reruns agree. An empty table gives empty results.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    facts = stored(
        docs.select(
            F.col("doc_id"),
            F.col("source"),
            F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source"))).alias("key"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            row_hash(seed).alias("row"),
        ),
        "words",
    )
    sizes = facts.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    if weights is None:
        weights = default_weights(sizes)
    else:
        weights = weights.select(F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source"))).alias("key"), F.col("weight").cast("double").alias("weight"))
    plan = targets(sizes.select("key", "source_size"), weights, most)
    # blocks of a source: all of one length, but for a word; the last of them taken is cut where the target is reached
    up_to = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    plan = plan.select(
        "key", "source_size", "target",
        F.round("target").cast("long").alias("goal"),
        F.greatest(F.lit(1), F.ceil(F.col("source_size") / block)).cast("long").alias("blocks"),
        (F.coalesce(F.sum("target").over(up_to), F.lit(0.0))).alias("_before"),
        F.sum("target").over(Window.partitionBy()).alias("_all"),
    )
    plan = stored(
        plan.select(
            "key", "source_size", "target", "goal", "blocks",
            F.try_divide(F.col("_before"), F.col("_all")).alias("lo"),
            F.try_divide(F.col("_before") + F.col("target"), F.col("_all")).alias("hi"),
        ),
        "plan",
    )
    total = facts.agg(F.sum("size"), F.count(F.lit(1))).first()
    words, rows = total[0] or 0, total[1]
    slots = max(1, math.ceil(words / block))

    edge = lambda k: F.floor(k * F.col("source_size") / F.col("blocks"))  # noqa: E731  # first word of block k
    # how many slots a source needs: whole passes, then blocks until the goal; taken as an upper bound, cut below
    need = plan.where("goal > 0").withColumn("need", F.ceil(F.col("goal") * F.col("blocks") / F.col("source_size")).cast("long") + 1)
    got = schedule(plan, slots)
    have = got.groupBy("key").agg(F.count(F.lit(1)).alias("have"), F.max("slot").alias("_last"))
    missing = (
        need.join(have, "key", "left")
        .where("need > coalesce(have, 0)")
        .select("key", F.explode(F.sequence(F.coalesce("have", F.lit(0)), F.col("need") - 1)).alias("rank"))
        .select("key", "rank", (F.lit(slots) + F.col("rank")).alias("slot"))
    )
    passes = F.floor(F.col("rank") / F.col("blocks"))
    taken = (
        got.unionByName(missing)
        .join(need, "key")
        .where("rank < need")
        .select("*", passes.alias("pass"), (F.col("rank") % F.col("blocks")).alias("block"))
        .withColumn("_first", F.col("pass") * F.col("source_size") + edge(F.col("block")))
        .select("key", "slot", "pass", "block", F.least(edge(F.col("block") + 1) - edge(F.col("block")), F.col("goal") - F.col("_first")).alias("words"))
        .where("words > 0")
    )
    taken = stored(taken, "slots")

    # each source's documents in shuffled order are one stream of words, cut into its blocks
    stream = spread(facts, "key", "row", ["doc_id", "size"], buckets_for(rows), "size").join(plan.select("key", "source_size", "target", "blocks"), "key")
    stream = stream.withColumn("id", F.xxhash64("row", "pos"))
    stream = stored(stream.select("id", "row", "doc_id", "source", "key", "size", "source_size", "target", "blocks", "offset"), "stream")
    block_of = lambda word: F.least(F.floor(((word + 1) * F.col("blocks") - 1) / F.col("source_size")), F.col("blocks") - 1)
    end = F.col("offset") + F.col("size")
    places = (
        stream.where("size > 0")
        .select("*", F.explode(F.sequence(F.greatest(block_of(F.col("offset")) - 1, F.lit(0)), F.least(block_of(end - 1) + 1, F.col("blocks") - 1))).alias("block"))
        .select("id", "row", "key", "block", (F.greatest(F.col("offset"), edge(F.col("block"))) - edge(F.col("block"))).alias("first"), (F.least(end, edge(F.col("block") + 1)) - edge(F.col("block"))).alias("last"))
        .where("last > first")
    )
    # all passes of a block together: how often each number of words is taken (whole, and once cut)
    uses = taken.groupBy("key", "block", "words").agg(F.count(F.lit(1)).alias("times"))
    part = (
        places.join(uses, ["key", "block"])
        .select("id", (F.greatest(F.lit(0), F.least("last", "words") - F.col("first")) * F.col("times")).alias("part"))
        .groupBy("id")
        .agg(F.sum("part").alias("taken"))
    )
    documents = stream.join(part, "id", "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "row"
    )
    return documents, taken, places


def op2_mixing(spark, sf_dir):
    documents, _, _ = mix(table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")

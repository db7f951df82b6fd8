"""Benchmark decontamination with SimHash over item-sized windows, by DataFrame operations only.

* Every document's word shingles meet the benchmark's, which are few (see `SMALL`). Each shared shingle gives the windows
  of the item's size that may be the most similar one by it, whatever the order of the shingles (see `_starts`); those
  that cannot reach the similarity, by the distinct shingles that only one side has, go at once.
* Each window and each item get a 64-bit SimHash of their shingles, weighted by their number. Windows meet items of
  their size in a multi-index: a fingerprint is cut into radius + 1 blocks, and two fingerprints that differ in radius
  bits at most agree in one block at least, so no pair within the radius is lost.
* For pairs within the radius, the weighted Jaccard similarity of the two shingle multisets is computed exactly.

A radius of 20 bits is three standard deviations beyond the distance expected at a similarity of 0.75.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import ascii_lower, stored

SHINGLE, SIMILARITY, RADIUS, BITS = 5, 0.75, 20, 64
#: A benchmark with more shingles than this isn't broadcast; Spark then joins by shuffling.
SMALL = 1_000_000
_LANES = 2  # 32-bit counters in a 64-bit sum; a text has fewer shingles than a counter holds


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words, runs of other than space, tab, newline, vertical tab, form feed and return."""
    spaced = F.translate(ascii_lower(F.coalesce(text, F.lit(""))), "\t\n\v\f\r", "     ")
    return F.array_remove(F.split(spaced, " ", -1), "")


def shingles_of(words: Column, n: int) -> Column:
    """Hashes of the runs of n words; none if there are fewer words. `words` is bound to a lambda's variable, so it is
    evaluated once for a row, not once for each run."""

    def hashed(w: Column) -> Column:
        count = F.size(w) - (n - 1)
        runs = F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(*[F.get(w, i + (k - 1)) for k in range(n)]))
        return F.when(count >= 1, runs).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(words), hashed), F.lit(0))


def _fingerprint(shingle: Column) -> list[Column]:
    """Sums from which `_bits` makes a SimHash: each adds up two bits' counts in 32-bit lanes."""
    lane = 0x0000_0001_0000_0001
    return [F.sum(F.shiftrightunsigned(shingle, k).bitwiseAND(F.lit(lane))).alias(f"_s{k}") for k in range(BITS // _LANES)]


def _bits(count: Column) -> Column:
    """The SimHash: each bit that more than half of `count` shingles have."""
    parts = []
    for k in range(BITS // _LANES):
        for lane in range(_LANES):
            ones = F.shiftrightunsigned(F.col(f"_s{k}"), 32 * lane).bitwiseAND(F.lit(0xFFFFFFFF))
            value = (1 << (32 * lane + k)) - (1 << 64 if 32 * lane + k == 63 else 0)
            parts.append(F.when(ones * 2 > count, F.lit(value)).otherwise(F.lit(0)).cast("bigint"))
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def _blocks(bits: Column, radius: int) -> Column:
    """(block, its bits) of the radius + 1 blocks that a fingerprint is cut into."""
    n = radius + 1
    edges = [BITS * k // n for k in range(n + 1)]
    return F.explode(F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(bits, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value")) for k, (a, b) in enumerate(zip(edges, edges[1:]))]))


def _starts(pos: Column, full: Column, length: Column) -> Column:
    """(exploded) Starts of the windows of `full` shingles for which the shared shingle at `pos` of `length` speaks.

    Of all windows, the first most similar one to an item is among those of the shingles that it shares. A whole window
    that isn't the first at all loses by moving one to the left, so its last shingle is shared. One that the document's
    end cuts short loses by leaving its first shingle, so that is shared.
    """
    before = F.greatest(pos - full + 1, F.lit(0))
    return F.explode(F.array_compact(F.array(before, F.when(pos > length - full, pos)))).alias("start")


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """Which passages of `docs` (doc_id, text) are like an item of `benchmark` (item_id, text).

    Returns doc_id, item_id, start (first word of the window), n_words, similarity and distance (of the SimHashes): for
    each row of docs and item the most similar of all windows, the first of equal ones, if its distance is within the
    radius. Words are lower-cased; shingles are of five words, or of all words of an item that has fewer, which then is
    sought as such. A window at a document's end is shorter. Null or empty texts of either table match nothing.
    Null ids are ids like others. Repeated rows are reported once. Empty tables give an empty result; further columns are not read.
    """
    items = benchmark.select(F.col("item_id"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    items = items.select("item_id", F.size("w").alias("n_words"), F.least(F.size("w"), F.lit(SHINGLE)).alias("n"), "w")
    items = stored(items.dropDuplicates(["item_id", "w"]), "items")
    lengths = [r["n"] for r in items.select("n").distinct().collect()]  # 1 to 5
    hashes = reduce(lambda a, n: F.when(F.col("n") == n, shingles_of(F.col("w"), n)).otherwise(a), lengths, F.array().cast("array<bigint>"))
    # an item by a key of its own, of its id and its words
    items = stored(items.select(F.xxhash64("item_id", "w").alias("item"), "item_id", "n", "n_words", hashes.alias("has")), "items")
    item_counted = items.select("item", "n", "n_words", F.explode("has").alias("shingle")).groupBy("item", "n", "n_words", "shingle").agg(F.count(F.lit(1)).alias("b"))
    item_counted = stored(item_counted, "shingles")
    few = item_counted.count() <= SMALL
    hint = F.broadcast if few else (lambda x: x)

    def item_sums() -> DataFrame:
        own = items.select("item", "item_id", "n_words", "n", F.explode("has").alias("shingle")).groupBy("item", "item_id", "n_words", "n").agg(F.count(F.lit(1)).alias("size"), *_fingerprint(F.col("shingle")))
        return own.select("item", "item_id", "n_words", "n", "size", _bits(F.col("size")).alias("bits"))

    texts = docs.select(F.col("doc_id"), F.col("text")).where(F.col("text").isNotNull())
    row = F.xxhash64("doc_id", "text")
    full = F.col("n_words") - F.col("n") + 1  # shingles of a whole window
    window = F.slice("own", F.col("start") + 1, full)
    held = lambda a, b: F.size(a) - F.size(F.array_except(a, b))  # noqa: E731  at least as many as are in common
    most = F.least(held(F.col("shingles"), F.col("has")), held(F.col("has"), F.col("shingles")))
    enough = most * (1 + similarity) >= similarity * (F.size("shingles") + F.size("has")) - 1e-9
    key = ["doc_id", "row", "n", "n_words", "start"]  # the row stands for its doc_id too, which may be null, so joins leave that out
    # each window's own shingles are cut from the document's where the benchmark's meet them
    found = []
    for n in lengths:
        own = texts.select("doc_id", row.alias("row"), shingles_of(words_of(F.col("text")), n).alias("own"))
        shared, has = item_counted.where(F.col("n") == n).select("item", "n", "n_words", "shingle"), hint(items.select("item", "has"))
        if few:  # nothing but the windows leaves the task, so a document's shingles may go along
            met = own.select("doc_id", "row", "own", F.posexplode("own").alias("pos", "shingle")).join(F.broadcast(shared), "shingle")
            met = met.select("doc_id", "row", "own", "item", "n", "n_words", _starts(F.col("pos"), full, F.size("own")))
        else:
            at = own.select("doc_id", "row", F.size("own").alias("length"), F.posexplode("own").alias("pos", "shingle")).join(shared, "shingle")
            met = own.join(at.select("row", "item", "n", "n_words", _starts(F.col("pos"), full, F.col("length"))).distinct(), "row")
        found.append(met.select(*key, "item", window.alias("shingles")).join(has, "item").where(enough).select(*key, "shingles").distinct())
    schema = "doc_id long, row long, n int, n_words int, start int, shingles array<bigint>"
    spark = docs.sparkSession
    cut = stored(reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema), "cut")
    prints = (
        cut.select(*key, F.explode("shingles").alias("shingle")).groupBy(*key).agg(F.count(F.lit(1)).alias("size"), *_fingerprint(F.col("shingle"))).select(*key, "size", _bits(F.col("size")).alias("bits"))
    )
    index = item_sums().select("item", "item_id", "n", "n_words", F.col("size").alias("item_size"), F.col("bits").alias("item_bits"), _blocks(F.col("bits"), radius).alias("b"))
    index = index.select("item", "item_id", "n", "n_words", "item_size", "item_bits", "b.block", "b.value")
    asked = prints.select(*key, "size", "bits", _blocks(F.col("bits"), radius).alias("b")).select(*key, "size", "bits", "b.block", "b.value")
    distance = F.bit_count(F.col("bits").bitwiseXOR(F.col("item_bits")))
    near = asked.join(hint(index), ["n", "n_words", "block", "value"]).where(distance <= radius).select(*key, "size", "item", "item_id", "item_size", distance.alias("distance")).distinct()

    # exact check: common shingles with their numbers
    counted = cut.select(*key, F.explode("shingles").alias("shingle")).groupBy(*key, "shingle").agg(F.count(F.lit(1)).alias("a"))
    common = counted.join(hint(item_counted), ["n", "n_words", "shingle"]).groupBy(*key[1:], "item").agg(F.sum(F.least("a", "b")).alias("common"))
    alike = near.join(common, [*key[1:], "item"]).withColumn("similarity", F.col("common") / (F.col("size") + F.col("item_size") - F.col("common")).cast("double"))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words", (-F.col("distance")).alias("close"))).alias("m")
    return (
        alike.where(F.col("similarity") >= similarity)
        .groupBy("doc_id", "item_id")
        .agg(best)
        .select("doc_id", "item_id", (-F.col("m.back")).alias("start"), F.col("m.n_words").alias("n_words"), F.col("m.similarity").alias("similarity"), (-F.col("m.close")).alias("distance"))
    )


def op6_decontaminate(spark, sf_dir):
    """Every document's passages that are like a benchmark item, the most similar window for each item."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

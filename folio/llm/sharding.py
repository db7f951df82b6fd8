"""Sharding by k-d tree partitioning.

Groups of equal texts are the points; each has a weight in bytes and four metadata dimensions (text size, source,
language, smallest doc_id). A node is split along its widest dimension, relative to that dimension's width over all
points, at the weighted quantile that gives both halves their part of the bytes (the weighted median, unless large
groups have been placed on one side). The quantile is found exactly to 30 bits by three rounds of 1024-bin
histograms per node, which are all that reaches the driver.

Groups larger than `large` of a shard's target can't be balanced by a split point. There are fewer than
shards / large of them, so they are placed first, largest first, on the emptiest shard, and the splits share out the
room that is left. A group that is larger than a whole shard's target (a third of all rows being one text) is dealt
over the shards row by row; every other group of equal texts stays in one shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import buckets_for, lookup, spread, stored

DIMS = ("d_size", "d_source", "d_lang", "d_id")
BINS, ROUNDS = 1024, 3


def _split_points(points: DataFrame, room: list[float]) -> DataFrame:
    """`points` (gid, weight, DIMS as doubles in 0..1, tie) with `shard`, an index into `room`."""
    shards = len(room)
    # (node's first shard, number of shards) -> its points; all nodes of a level are handled in one job a round
    placed = points.withColumn("lo", F.lit(0)).withColumn("width", F.lit(shards))
    while True:
        open_nodes = {}
        stats = placed.where("width > 1").groupBy("lo", "width").agg(
            F.sum("weight").alias("w"), *[F.min(d).alias(f"min_{d}") for d in DIMS], *[F.max(d).alias(f"max_{d}") for d in DIMS]
        )
        for r in stats.collect():  # a row for each open node, fewer than the shards
            widest = max(DIMS, key=lambda d: r[f"max_{d}"] - r[f"min_{d}"])
            half = r["width"] // 2
            own = room[r["lo"] : r["lo"] + r["width"]]
            part = sum(own[:half]) / sum(own) if sum(own) > 0 else half / r["width"]
            open_nodes[r["lo"]] = {"dim": widest, "min": r[f"min_{widest}"], "max": r[f"max_{widest}"], "half": half, "want": part * r["w"], "left": 0.0, "prefix": 0}
        if not open_nodes:
            return placed.withColumnRenamed("lo", "shard").drop("width")
        key, rest = F.lit(None).cast("long"), F.lit(None).cast("int")
        for lo, n in open_nodes.items():
            span = max(n["max"] - n["min"], 1e-12)
            # 15 bits of the dimension, then 15 bits of a hash, so that equal values can be split too
            scaled = F.floor(F.least((F.col(n["dim"]) - n["min"]) / span, F.lit(1.0)) * 32767).cast("long") * 32768 + F.col("tie")
            mine = (F.col("lo") == lo) & (F.col("width") > 1)
            key, rest = F.when(mine, scaled).otherwise(key), F.when(mine, F.lit(n["half"])).otherwise(rest)
        keyed = placed.withColumn("_key", key).withColumn("_half", rest)
        for k in range(ROUNDS):
            shift = 10 * (ROUNDS - 1 - k)
            chosen = F.lit(False)
            for lo, n in open_nodes.items():
                chosen = chosen | ((F.col("lo") == lo) & (F.shiftright("_key", shift + 10) == n["prefix"]))
            bins = keyed.where(F.col("_key").isNotNull() & chosen).groupBy("lo", F.pmod(F.shiftright("_key", shift), F.lit(BINS)).alias("bin")).agg(F.sum("weight").alias("w"))
            found: dict[int, dict[int, float]] = {}
            for r in bins.collect():  # BINS rows for each open node at most
                found.setdefault(r["lo"], {})[r["bin"]] = r["w"]
            for lo, n in open_nodes.items():
                at = 0
                for at in range(BINS):
                    w = found.get(lo, {}).get(at, 0)
                    if n["left"] + w >= n["want"]:
                        break
                    n["left"] += w
                n["prefix"] = n["prefix"] * BINS + at
        right = F.lit(False)
        for lo, n in open_nodes.items():
            right = right | ((F.col("lo") == lo) & (F.col("_key") >= n["prefix"]))
        split = F.col("_half").isNotNull()
        placed = stored(
            keyed.select(
                *points.columns,
                F.when(split & right, F.col("lo") + F.col("_half")).otherwise(F.col("lo")).alias("lo"),
                F.when(split & right, F.col("width") - F.col("_half")).when(split, F.col("_half")).otherwise(F.col("width")).alias("width"),
            ),
            "kd",
        )


def _place_large(sizes: list[int], target: float, shards: int) -> tuple[list[int], list[float]]:
    """The shard of each large group, and the room that stays in each shard."""
    room, at = [target] * shards, []
    for w in sizes:
        k = max(range(shards), key=lambda i: room[i])
        at.append(k)
        room[k] -= w
    return at, [max(0.0, r) for r in room]


def kd_shards(docs: DataFrame, shards: int | None = 8, target_bytes: int | None = None, large: float = 1 / 64) -> DataFrame:
    """Assign every row of `docs` (doc_id, text, lang, source; further columns are not read) to a shard.

    Returns doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, shard and slot (0-based, without gaps in a
    shard). With `target_bytes`, the number of shards is that of the targets in all bytes. Null text has size 1 and the
    crc32 of no bytes; null doc_id, lang or source are values of their own. Repeated rows keep their number. An empty
    table gives an empty result.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    facts = docs.select(
        F.col("doc_id").alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(raw, F.length(raw)).alias("gid"),
        F.col("lang").alias("_lang"),
        F.col("source").alias("_source"),
        F.xxhash64("doc_id", raw).alias("_row"),
    )
    facts = stored(facts, "facts")
    totals = facts.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.max("doc_id").alias("top"), F.min("doc_id").alias("low")).first()
    total, rows = totals["bytes"] or 0, totals["rows"]
    if target_bytes:
        shards = max(1, -(-total // target_bytes))
    target = total / shards
    groups = facts.groupBy("gid").agg(
        F.sum("size").alias("weight"), F.max("size").alias("one"), F.min(F.struct("_source", "_lang")).alias("m"), F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("_n")
    )
    span = max(1, (totals["top"] or 0) - (totals["low"] or 0))
    unit = lambda c: (F.pmod(F.xxhash64(c), F.lit(65536)) / F.lit(65535.0))
    points = stored(
        groups.select(
            "gid",
            "weight",
            "_n",
            F.least(F.log2(F.col("one").cast("double")) / 40, F.lit(1.0)).alias("d_size"),
            unit("m._source").alias("d_source"),
            unit("m._lang").alias("d_lang"),
            (F.coalesce(F.col("id") - (totals["low"] or 0), F.lit(0)) / F.lit(float(span))).alias("d_id"),
            F.pmod(F.xxhash64(F.lit(7), "gid"), F.lit(32768)).alias("tie"),
        ),
        "points",
    )
    least = max(1, int(large * target))
    big = points.where(F.col("weight") > least).select("gid", "weight").orderBy(F.desc("weight"), "gid").collect()  # fewer than shards / large
    torn = [r for r in big if r["weight"] > target]
    whole = [r for r in big if r["weight"] <= target]
    torn_share = sum(r["weight"] for r in torn) / shards
    at, room = _place_large([r["weight"] for r in whole], target - torn_share, shards)
    small = points.where(F.col("weight") <= least)
    spark = docs.sparkSession
    fixed = spark.createDataFrame([(r["gid"], k) for r, k in zip(whole, at, strict=True)] + [(r["gid"], -1) for r in torn], "gid long, shard int")
    by_group = _split_points(small, room).select("gid", F.col("shard").cast("int")).unionByName(fixed)
    # rows that are alike get their shard through their group; the torn groups' rows are dealt by a hash of the row
    dealt = lookup(facts, by_group, "gid", points).withColumn("shard", F.when(F.col("shard") < 0, F.pmod(F.xxhash64("_row", F.lit(3)), F.lit(shards))).otherwise(F.col("shard")).cast("int"))
    if any(r["weight"] > target for r in torn):
        # equal rows of a torn group (same doc_id too) would all hash alike: number them first
        same = spread(dealt.join(F.broadcast(spark.createDataFrame([(r["gid"],) for r in torn], "gid long")), "gid", "left_semi"), "gid", "_row", ["doc_id"], buckets_for(rows)).withColumn("shard", F.pmod(F.col("pos"), F.lit(shards)).cast("int")).drop("pos")
        dealt = dealt.join(F.broadcast(spark.createDataFrame([(r["gid"],) for r in torn], "gid long")), "gid", "left_anti").unionByName(same.select(dealt.columns))
    slots = spread(dealt.withColumn("_order", F.xxhash64("gid", "_row")), "shard", "_order", ["gid", "doc_id"], buckets_for(rows)).withColumnRenamed("pos", "slot")
    return slots.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


def op7_sharding(docs: DataFrame, shards: int = 8) -> DataFrame:
    """The digest of `kd_shards` for the query: law `bytes`, so grown_shard is null."""
    return kd_shards(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )

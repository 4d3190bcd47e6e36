"""Operator 10: balanced label propagation over links between documents of equal text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lading.llm.common import n_bits, prefix_sums, scratch, spread, staged

#: Groups above a shard's share divided by this are placed one by one, as there are at most so many a shard.
PIECES = 64


def shard(docs: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``; law ``bytes``: the shards' sizes are near equal.

    Documents of equal text are linked. They start in shards by a hash of the row; a group asks for the shard that holds
    most of its bytes among those where all of it fits, and is granted it in a hashed order up to the room there (a shard
    holds one share of all bytes at most). Groups that were refused ask again for the best shard with room left, until
    none of them fits anywhere. Groups above a 64th of a share, at most 64 a shard, are placed first, from the largest on; one
    that is too large for any shard fills one and goes on in the next. Rows without links, and groups that fit nowhere as
    a whole, then fill what room is left, by their running sum, which evens out the sizes up to a document.

    Nulls: a null text has size 1 and is linked with other null texts only; repeated rows are rows of their own. An empty
    table gives an empty result. Only ``doc_id`` and ``text`` are read. Groups never come together in a task: their
    bytes by shard are grouped sums, moves and slots are running sums over hash slices.
    """
    with scratch(docs.sparkSession) as block:
        return block.result(_shard(docs, shards, seed), "shards")


def _shard(docs: DataFrame, shards: int, seed: int) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("null")).alias("gid"))
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("place", spread(F.lit(seed), "doc_id", "row")), "shard-rows")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    cap = total / shards
    bits = n_bits(count, 10_000)
    groups = rows.groupBy("gid").agg(F.count("*").alias("members"), F.sum("size").alias("all")).filter("members > 1")
    linked = rows.select("row", "gid", "size", "place").join(groups.select("gid", "all"), "gid").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "row"), F.lit(shards)).cast("int"))
    linked = staged(linked.select("row", "gid", "size", "all", "place", "shard"), "linked")
    large = [(r["gid"], r["all"]) for r in groups.filter(F.col("all") > cap / PIECES).select("gid", "all").collect()]  # at most PIECES a shard
    room = [cap] * shards
    pieces = _pieces(sorted(large, key=lambda g: (-g[1], g[0])), room)
    spans = linked.sparkSession.createDataFrame(pieces, "gid string, low double, high double, shard int")
    ordered = prefix_sums(linked.filter(F.col("all") > cap / PIECES).drop("shard"), ["gid"], "place", ["row"], {"before": "size"}, bits)
    middle = F.col("before") + F.col("size") / 2
    placed = [ordered.join(F.broadcast(spans), "gid").filter((middle >= F.col("low")) & (middle < F.col("high"))).select("row", "shard")]
    held = linked.filter(F.col("all") <= cap / PIECES).groupBy("gid", "all", "shard").agg(F.sum("size").alias("held"))
    open_groups = staged(held.groupBy("gid", "all").agg(F.sort_array(F.collect_list(F.struct("held", F.xxhash64("gid", "shard").alias("tie"), "shard")), asc=False).alias("held")), "open-groups")
    homes: list[DataFrame] = []
    while True:
        fits = F.filter(F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(x)).alias("room")) for i, x in enumerate(room)]), lambda x: x["room"] >= F.col("all"))
        asks = open_groups.withColumn("fits", F.transform(fits, lambda x: x["shard"])).filter("size(fits) > 0")
        # the shard with most of the group where it fits, else any where it does
        best = F.get(F.filter(F.transform("held", lambda x: x["shard"]), lambda x: F.array_contains("fits", x)), 0)
        other = F.get("fits", F.pmod(F.xxhash64(F.lit(seed + len(homes)), "gid"), F.size("fits")).cast("int"))
        asks = asks.select("gid", "all", F.coalesce(best, other).alias("to")).withColumn("turn", spread(F.lit(seed + 2), "gid"))
        asks = prefix_sums(asks, ["to"], "turn", ["gid"], {"asked": "all"}, bits)
        limit = F.get(F.array(*[F.lit(float(x)) for x in room]), F.col("to"))
        granted = staged(asks.filter(F.col("asked") + F.col("all") <= limit).select("gid", "all", F.col("to").alias("shard")), "granted")
        taken = granted.groupBy("shard").agg(F.sum("all").alias("taken")).collect()  # a number per shard
        if not taken:
            break
        for r in taken:
            room[r["shard"]] -= r["taken"]
        homes.append(granted)
        open_groups = staged(open_groups.join(granted.select("gid"), "gid", "left_anti"), "open-groups")
        if not open_groups.limit(1).count():
            break
    if homes:
        placed.append(linked.select("row", "gid").join(reduce(DataFrame.union, homes).select("gid", "shard"), "gid").select("row", "shard"))
    linked = staged(reduce(DataFrame.union, placed).join(rows.select("row", "size"), "row"), "settled")
    free = rows.join(linked.select("row", "shard"), "row", "left_anti").select("row", "size", "place")
    load = linked.groupBy("shard").agg(F.sum("size").alias("load"))
    room = spread_room(linked.sparkSession, shards, cap).join(load, "shard", "left").select("shard", F.greatest(F.lit(0.0), F.col("cap") - F.coalesce("load", F.lit(0))).alias("room"))
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bounds = [r["upto"] for r in room.withColumn("upto", F.sum("room").over(upto)).orderBy("shard").collect()]  # a number per shard
    filled = prefix_sums(free.withColumn("all", F.lit(0)), ["all"], "place", ["row"], {"before": "size"}, bits + 4)
    middle = F.col("before") + F.col("size") / 2
    picked = sum((F.when(middle >= F.lit(b), 1).otherwise(0) for b in bounds[:-1]), F.lit(0))
    placed = linked.select("row", "shard").union(filled.select("row", picked.cast("int").alias("shard")))
    out = rows.join(placed, "row").withColumn("one", F.lit(1).cast("long"))
    out = prefix_sums(out, ["shard"], "place", ["row"], {"slot": "one"}, bits)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _pieces(groups: list[tuple[str, int]], room: list[float]) -> list[tuple[str, float, float, int]]:
    """``(gid, low, high, shard)``: which bytes of each group go where. A group goes to the fullest shard that takes all of
    it; one that none takes fills the emptiest, then the next. What is taken leaves ``room``."""
    out = []
    for gid, size in groups:
        fits = [i for i, x in enumerate(room) if x >= size]
        if fits:
            best = min(fits, key=lambda i: (room[i], i))
            room[best] -= size
            out.append((gid, 0.0, float("inf"), best))
            continue
        low = 0.0
        while low < size:
            widest = max(range(len(room)), key=lambda i: (room[i], -i))
            take = min(room[widest], size - low)
            last = take >= size - low - 1e-6 or take <= 0  # what rounding leaves stays with the last
            out.append((gid, low, float("inf") if last else low + take, widest))
            room[widest] -= take
            if last:
                break
            low += take
    return out


def spread_room(spark, shards: int, cap: float) -> DataFrame:
    return spark.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit(float(cap)).alias("cap"))


def op10_shard(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))

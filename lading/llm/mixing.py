"""Operator 5: mixes sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lading.llm.common import fresh, n_bits, n_words, prefix_sums, scratch, spread, staged

#: Fractional part of the golden ratio times 2**32, for points in whole numbers.
GOLDEN = 2654435769
SPAN = 1 << 32


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most_epochs: float = 3.0) -> DataFrame:
    """``(source, source_size)`` -> with ``target``: shares by weight of 100% of all sizes, no source above
    ``most_epochs`` times its size; what is above goes to the others by weight until none is above.

    Weights repeat over the sources by code point, null last. If all sources are full, targets stay at the bound.
    One row per source; the water level is found from the sources ordered by bound over weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_k", (F.row_number().over(order) - 1) % len(weights))
    ranked = ranked.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("_k").cast("int") + 1))
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(float(most_epochs)))
    ranked = ranked.withColumn("_level", F.col("_cap") / F.col("_w"))
    by_level = Window.orderBy("_level", F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("_all", F.sum("source_size").over(all_rows).cast("double"))
    ranked = ranked.withColumn("_left", F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("_wleft", F.sum("_w").over(all_rows) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    # sources are filled in the order of their level; the first that stays below its bound sets the level of the rest
    ranked = ranked.withColumn("_free", F.col("_left") / F.col("_wleft") < F.col("_level"))
    level = F.min(F.when(F.col("_free"), F.struct("_level", (F.col("_left") / F.col("_wleft")).alias("l")))).over(all_rows)
    ranked = ranked.withColumn("_l", level["l"])
    target = F.when(F.col("_l").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_w") * F.col("_l")))
    return ranked.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, size: Column | None = None, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most_epochs: float = 3.0, block: int = 256, seed: int = 0) -> DataFrame:
    """``doc_id, size, source_size, target, taken``: how many words of each document the mix takes, repeats counted.

    Each source is shuffled by a hash and its words are cut into blocks of equal size (at most ``block`` words, and 64
    blocks at least for all but tiny sources). Slot ``i`` of the schedule maps the golden-ratio point ``frac(i * phi)``
    through the cumulative slot weights to a source; the ``j``-th slot of a source takes its block ``j`` modulo its number
    of blocks, so whole epochs come before repeats. A source's slots end at its rounded target, and the few that the
    points leave short of it (a logarithm of the length) follow at the end of the schedule.

    Nulls: a null text has size 0, a null source is a source of its own. Repeated rows are documents of their own; ties in
    the shuffle go by doc_id. Empty input gives an empty result. Only ``doc_id, text, source`` are read.
    """
    with scratch(docs.sparkSession) as made:
        return made.result(_mix(docs, n_words(F.col("text")) if size is None else size, weights, most_epochs, block, seed), "mix")


def _mix(docs: DataFrame, size: Column, weights: tuple[float, ...], most_epochs: float, block: int, seed: int) -> DataFrame:
    rows = staged(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.cast("long").alias("size")), "sizes")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(per_source, weights, most_epochs)
    plan = plan.withColumn("_most", F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("source_size") / 64))).cast("long"))
    plan = plan.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.col("_most"))).cast("long")).withColumn("per_block", F.col("source_size") / F.col("blocks"))
    plan = plan.withColumn("quota", F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") / F.col("per_block")), F.floor(F.col("blocks") * F.lit(most_epochs)))).otherwise(0).cast("long"))
    before = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    plan = staged(plan.withColumn("_from", F.coalesce(F.sum("quota").over(before), F.lit(0))).drop("_most"), "mix-plan")
    slots = plan.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    schedule = _schedule(plan, slots)
    uses = schedule.groupBy(F.col("source").alias("_s"), "block").agg(F.count("*").alias("uses"))
    bits = n_bits(rows.count(), 10_000)
    placed = rows.withColumn("_p", spread(F.lit(seed), "doc_id", "source"))
    placed = prefix_sums(placed.withColumn("_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))), ["_key"], "_p", ["doc_id", "size"], {"start": "size"}, bits)
    plan = plan.withColumn("_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))).drop("source")
    placed = staged(placed.join(plan.select("_key", "source_size", "target", "blocks"), "_key").withColumn("_row", F.monotonically_increasing_id()), "placed")
    # block b of a source holds its words from floor(b * size / blocks) on
    first = F.floor(((F.col("start") + 1) * F.col("blocks") - 1) / F.col("source_size"))
    last = F.floor(((F.col("start") + F.col("size")) * F.col("blocks") - 1) / F.col("source_size"))
    parts = placed.filter("size > 0").select("_row", "_key", "start", "size", "source_size", "blocks", F.explode(F.sequence(F.greatest(first - 1, F.lit(0)), F.least(last + 1, F.col("blocks") - 1))).alias("block"))
    low = F.expr("cast(block * source_size div blocks as long)")
    high = F.expr("cast((block + 1) * source_size div blocks as long)")
    parts = parts.withColumn("words", F.least(high, F.col("start") + F.col("size")) - F.greatest(low, F.col("start"))).filter("words > 0")
    taken = parts.join(uses, (F.col("_key") == F.coalesce(F.concat(F.lit("="), F.col("_s")), F.lit("null"))) & (parts["block"] == uses["block"])).groupBy("_row").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    return placed.join(taken, "_row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _schedule(plan: DataFrame, slots: int) -> DataFrame:
    """``slot, source, rank, block`` for all slots; ``plan`` has a row per source."""
    spark = plan.sparkSession
    low, high = F.col("id") % (1 << 16), F.shiftright("id", 16) % (1 << 16)  # in halves, so that no product overflows
    turn = (low * F.lit(GOLDEN) + (high * F.lit(GOLDEN)) % (1 << 16) * F.lit(1 << 16)) % F.lit(SPAN)
    point = turn / F.lit(float(SPAN)) * F.lit(float(slots))
    ids = spark.range(0, slots).withColumn("_x", point)
    # cumulative weights in cells, so that the source of a point is found by an equality join on the cell
    cells = 4096
    width = max(1.0, slots / cells)
    cell = F.floor(F.col("_x") / F.lit(width))
    ranges = plan.filter("quota > 0").withColumn("_to", F.col("_from") + F.col("quota")).withColumn("_c", F.explode(F.sequence(F.floor(F.col("_from") / F.lit(width)), F.floor(F.col("_to") / F.lit(width)))))
    drawn = ids.withColumn("_c", cell).join(ranges, "_c").filter("_x >= _from and _x < _to").select("id", "source", "quota", "blocks")
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))
    drawn = drawn.withColumn("_key", key).withColumn("one", F.lit(1))
    bits = n_bits(slots, 10_000)
    scale = max(1, (1 << 62) // max(1, slots))
    drawn = drawn.withColumn("_p", F.col("id") * F.lit(scale))
    ranked = prefix_sums(drawn, ["_key"], "_p", [], {"rank": "one"}, bits).filter("rank < quota")
    got = ranked.groupBy(F.col("_key")).agg(F.count("*").alias("got"))
    short = plan.filter("quota > 0").withColumn("_key", key).join(got, "_key", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < quota")
    late = short.select("source", F.lit(slots).alias("id"), F.explode(F.expr("sequence(got, quota - 1)")).alias("rank"), "blocks")
    both = ranked.select("source", "id", "rank", "blocks").union(late.select("source", "id", "rank", "blocks"))
    return both.select(F.col("id").alias("slot"), "source", "rank", (F.col("rank") % F.col("blocks")).alias("block"))


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def mixed_documents(docs: DataFrame, seed: int = 0, **kw) -> DataFrame:
    """The documents with each repeated as often as the mix takes it.

    A document taken ``taken / size`` times, say 1.3, is there once and, by a hash of its id and text, a second time with a
    chance of 0.3, so that each source keeps the share of words that the mix gave it. Documents without words stay once.
    Rows of equal doc_id and size share what the mix took of them together. Nulls: a null text has no words, a null doc_id
    is an id like others. An empty table stays empty; other columns pass through whatever they are called.
    What is taken grows with the documents, so it is never broadcast.
    """
    id_, size, share, turn = fresh(docs, "_id", "_words", "_share", "_turn")
    seen = docs.select("doc_id", "source", n_words(F.col("text")).alias(size))
    took = mix(seen, size=F.col(size), seed=seed, **kw).groupBy(F.col("doc_id").alias(id_), F.col("size").alias(size))
    took = took.agg(F.when(F.col(size) > 0, F.sum("taken") / F.sum("size")).otherwise(1.0).alias(share))
    many = docs.join(took.hint("merge"), docs["doc_id"].eqNullSafe(took[id_]) & (n_words(docs["text"]) == took[size]))
    chance = spread(F.lit(seed + 3), "doc_id", F.col("text").cast("string")) / F.lit(float(1 << 62))
    many = many.withColumn(turn, F.floor(F.col(share)) + F.when(chance < F.col(share) - F.floor(share), 1).otherwise(0)).filter(F.col(turn) > 0)
    return many.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(turn).cast("int")))).select(*docs.columns)

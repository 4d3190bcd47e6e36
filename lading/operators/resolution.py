"""Entity resolution against catalogs in tiers, by candidate keys instead of a product of all values and items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lading.functions.text import lookup_key, similarity, tokens

# Least score by group of catalog.
LEAST = {"currency": 0.94, "container": 0.88, "agent": 0.84, "carrier": 0.82, "port": 0.78}


def catalog_keys(catalog: DataFrame) -> DataFrame:
    """``key, item_id, name`` of an item's name, code and aliases; made once per catalog."""
    names = F.filter(F.concat(F.array("name", "code"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: x.isNotNull())
    keys = catalog.select("item_id", "name", F.explode(names).alias("raw")).withColumn("key", lookup_key(F.col("raw")))
    return keys.filter("key <> ''").select("key", "item_id", "name").distinct()


def strict(values: DataFrame, keys: DataFrame) -> DataFrame:
    """``value, item_id, hits``: an item if exactly one has the key of the value, null if several do."""
    hit = values.withColumn("key", lookup_key(F.col("value"))).join(keys, "key")
    return hit.groupBy("value").agg(F.when(F.count_distinct("item_id") == 1, F.min("item_id")).alias("item_id"), F.count_distinct("item_id").alias("hits"))


def contained(values: DataFrame, keys: DataFrame, least_length: int = 4) -> DataFrame:
    """The item with the shortest key that contains the value's, if no other is as short. Pairs meet on runs of
    ``least_length`` characters: a key that contains the value contains the value's first run."""
    run = values.withColumn("vkey", lookup_key(F.col("value"))).filter(F.length("vkey") >= least_length).filter(F.col("vkey").rlike("[A-Z]")).withColumn("run", F.substring("vkey", 1, least_length))
    runs = keys.filter(F.length("key") >= least_length).withColumn("run", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("key") - (least_length - 1)), lambda i: F.substr(F.col("key"), i, F.lit(least_length))))))
    pairs = run.join(runs, "run").filter(F.contains(F.col("key"), F.col("vkey"))).withColumn("far", F.length("key") - F.length("vkey"))
    best = pairs.groupBy("value", "item_id").agg(F.min("far").alias("far"))
    near = Window.partitionBy("value").orderBy("far")
    ranked = best.withColumn("place", F.rank().over(near)).withColumn("ties", F.count("*").over(Window.partitionBy("value", "far"))).filter("place = 1 and ties = 1")
    return ranked.select("value", "item_id", "far")


def score(value: Column, name: Column) -> Column:
    """Likeness of two keys and of their words, 0 to 1: containment, edit similarity or covered words, the greatest."""
    a, b = lookup_key(value), lookup_key(name)
    ratio = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))
    part = F.when((F.contains(a, b) | F.contains(b, a)) & ((F.least(F.length(a), F.length(b)) >= 4) | (ratio >= 0.75)), 0.86 + 0.1 * ratio).otherwise(F.lit(0.0))
    edit = F.when((F.length(a) >= 4) & (F.length(b) >= 4), similarity(a, b)).otherwise(F.lit(0.0))
    ta, tb = tokens(value), tokens(name)
    both = F.size(F.array_intersect(ta, tb))
    words = F.when((F.size(ta) > 0) & (F.size(tb) > 0), 0.65 * both / F.size(tb) + 0.35 * both / F.size(ta)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(part, edit, words))


def fuzzy(values: DataFrame, keys: DataFrame, least: float, margin: float = 0.04, grams: int = 3) -> DataFrame:
    """``value, item_id, score``: the best item, if it has the least score and leads the next by the margin.

    Candidates share a run of three characters of their keys with the value, so values and catalog meet by an equality
    join; only values that are distinct come here.
    """
    cut = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (grams - 1), F.lit(1))), lambda i: F.substr(c, i, F.lit(grams))))
    left = values.withColumn("gram", F.explode(cut(lookup_key(F.col("value")))))
    right = keys.withColumn("gram", F.explode(cut(F.col("key"))))
    pairs = left.join(right, "gram").select("value", "item_id", "name").distinct()
    scored = pairs.withColumn("score", F.round(score(F.col("value"), F.col("name")), 6)).groupBy("value", "item_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("value").orderBy(F.col("score").desc(), "item_id")
    ranked = scored.withColumn("place", F.row_number().over(order)).withColumn("next", F.lead("score").over(order))
    won = (F.col("place") == 1) & (F.col("score") >= least) & (F.col("next").isNull() | (F.round(F.col("score") - F.col("next"), 6) >= margin))
    return ranked.filter(won).select("value", "item_id", "score")


def resolve(values: DataFrame, catalog: DataFrame, group: str) -> DataFrame:
    """``value, item_id, tier`` of distinct values: the strict tier stops also when it is ambiguous, then containment,
    then likeness."""
    keys = catalog_keys(catalog)
    first = strict(values, keys)
    rest = values.join(first, "value", "left_anti")
    second = contained(rest, keys)
    third = fuzzy(rest.join(second, "value", "left_anti"), keys, LEAST.get(group, 0.84))
    tiers = first.filter("item_id is not null").select("value", "item_id", F.lit("strict").alias("tier"))
    return tiers.union(second.select("value", "item_id", F.lit("contained"))).union(third.select("value", "item_id", F.lit("fuzzy")))

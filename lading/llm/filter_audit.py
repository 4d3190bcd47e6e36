"""Operator 13: how filters act on each other, from one table of failures."""

from __future__ import annotations

import re
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lading.llm.common import scratch, staged

FILTERS = "ABCDE"
#: The 32 sets of filters that a document can fail: filter k of FILTERS is bit k.
MASKS = range(1 << len(FILTERS))
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Rows that share document and text are dealt to so many places at most, by the part of the input that holds them.
PLACES = 16


def word_totals(docs: DataFrame) -> DataFrame:
    """``doc, print, n_words, n_distinct`` by ``doc`` and ``print``, a hash of the text; ``docs``: ``doc, print, text``.

    Words are exploded and counted by document and word, then by document. Texts move before their words are exploded, so
    that both counts find a document's words in one place: words are many times the rows, with a long key each. Rows that
    share both keys hold one text; their words count as often as there are rows. Documents without words are not there.
    """
    spark = docs.sparkSession
    key = ["doc", "print", "place"]
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select("doc", "print", (F.spark_partition_id() % PLACES).alias("place"), "text").repartition(parts, *key)
    words = dealt.select(*key, F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")).filter("word <> ''")
    counts = words.groupBy(*key, "word").agg(F.count("*").alias("n"))
    totals = counts.groupBy(*key).agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))
    return totals.groupBy("doc", "print").agg(F.sum("n_words").alias("n_words"), F.max("n_distinct").alias("n_distinct"))


def failures(docs: DataFrame, least_words: int = 200, least_distinct_percent: int = 50, most_capital_percent: int = 3, symbols: str = "#$%&*|") -> DataFrame:
    """``doc_id, part, failed`` row by row: the filters that a document fails as bits.

    A: under ``least_words`` words. B: too few distinct words. C: too many capitals. D: holds one of ``symbols``. E: a row
    with a smaller ``doc_id`` has the same text.

    A null text is empty, a null ``lang`` the part ``''``; a null ``doc_id`` is no row's predecessor and has none. Repeated
    rows each count, and none of them precedes the others. Only ``doc_id, text, lang`` are read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").alias("doc"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    base = base.withColumn("print", F.xxhash64("text"))
    capitals = F.length("text") - F.length(F.translate("text", CAPITALS, ""))
    held = F.col("text").rlike("[" + re.escape(symbols) + "]")
    flags = base.select("doc", "part", "print", F.unhex(F.sha2("text", 256)).alias("whole"), (100 * capitals > most_capital_percent * F.length("text")).alias("c"), held.alias("d"))
    # one row for each document and text: what repeated rows share is joined once
    flags = staged(flags.groupBy("doc", "print", "whole", "part", "c", "d").agg(F.count("*").alias("rows")), "flags")
    words = word_totals(base).withColumnRenamed("doc", "w_doc").withColumnRenamed("print", "w_print")
    copies = flags.groupBy("doc", "print").agg(F.sum("rows").alias("copies")).withColumnRenamed("doc", "c_doc").withColumnRenamed("print", "c_print")
    words = copies.join(words, F.col("c_doc").eqNullSafe(F.col("w_doc")) & (F.col("c_print") == F.col("w_print")), "left")
    words = words.select("c_doc", "c_print", F.expr("coalesce(n_words, 0L) div copies").alias("n_words"), F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))
    first = flags.groupBy(F.col("whole").alias("f_whole")).agg(F.min("doc").alias("first"), F.sum("rows").alias("alike")).filter("alike > 1")
    out = flags.join(words, F.col("doc").eqNullSafe(F.col("c_doc")) & (F.col("print") == F.col("c_print"))).join(first, F.col("whole") == F.col("f_whole"), "left")
    fails = [F.col("n_words") < least_words, 100 * F.col("n_distinct") < least_distinct_percent * F.col("n_words"), F.col("c"), F.col("d"), F.coalesce(F.col("doc") > F.col("first"), F.lit(False))]
    failed = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    return out.select(F.col("doc").alias("doc_id"), "part", failed.alias("failed"), "rows")


def counts_by_part(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, n, good, toxic``: for each of the 32 sets of failed filters how many rows of the part fail just that set,
    and how many of those have the label. A document is good (toxic) if any of its label rows says so."""
    marks = labels.filter("quality = 1 or toxic = 1").groupBy(F.col("doc_id").alias("l_doc")).agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c) for c in ("quality", "toxic")])
    both = failed.join(marks, F.col("doc_id") == F.col("l_doc"), "left")
    has = {"n": F.lit(True), "good": F.coalesce("quality", F.lit(False)), "toxic": F.coalesce("toxic", F.lit(False))}
    each = [F.sum(F.when((F.col("failed") == m) & of, F.col("rows")).otherwise(0)).alias(f"{k}_{m}") for k, of in has.items() for m in MASKS]
    return both.groupBy("part").agg(*each).select("part", *[F.array(*[f"{k}_{m}" for m in MASKS]).alias(k) for k in has])


def _total(counts: str, condition: str, share: str = "1") -> Column:
    """Over the masks ``m`` that meet a condition on ``own`` and ``before``, the counts, times a share."""
    return F.expr(f"aggregate(sequence(0, {len(MASKS) - 1}), 0L, (s, m) -> s + if({condition}, {counts}[m] * {share}, 0L))")


def filter_audit(docs: DataFrame, labels: DataFrame, **limits: int) -> DataFrame:
    """One row per part, order of the five filters and step: ``part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley``.

    Documents are read once for their words and once for the other flags; what any order does follows from the 32 counts
    of each part. ``shapley`` is the filter's ``removed`` over all 120 orders: of a document that fails k filters each
    removes it in 120 / k of them. Limits and awkward rows: see ``failures``. An empty table has no parts and no rows.
    """
    with scratch(docs.sparkSession) as block:
        counts = block.result(counts_by_part(failures(docs, **limits), labels), "filter-counts")
    orders = ["".join(p) for p in permutations(FILTERS)]
    steps = counts.select("*", F.explode(F.array(*map(F.lit, orders))).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = "shiftleft(1, cast(instr('{0}', substr(filter_order, {1}, 1)) as int) - 1)"
    steps = steps.withColumn("own", F.expr(bit.format(FILTERS, "step")))
    before = "aggregate(sequence(1, 5), 0, (s, k) -> s + if(k < step, " + bit.format(FILTERS, "k") + ", 0))"
    steps = steps.withColumn("before", F.expr(before))
    fails, open_ = "(m & own) <> 0", "(m & before) = 0"
    return steps.select(
        "part",
        "filter_order",
        "step",
        _total("n", f"not ({fails}) and {open_}").alias("kept"),
        _total("n", f"{fails} and {open_}").alias("removed"),
        _total("n", f"{fails} and not ({open_})").alias("redundant"),
        _total("n", "m = own").alias("unique_fails"),
        _total("good", f"{fails} and {open_}").alias("good_lost"),
        _total("toxic", f"{fails} and {open_}").alias("toxic_lost"),
        _total("n", fails, "(120 div bit_count(m))").alias("shapley"),
    )


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs
), firsts AS (
  SELECT text, min(doc_id) AS first FROM docs GROUP BY text
), marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), flags AS (
  SELECT part, coalesce(good, false) AS good, coalesce(marks.toxic, false) AS toxic, [
    len(w) < 200,
    100 * len(list_distinct(w)) < 50 * len(w),
    100 * (length(words.text) - length(regexp_replace(words.text, '[A-Z]', '', 'g'))) > 3 * length(words.text),
    regexp_matches(words.text, '[#$%&*|]'),
    coalesce(words.doc_id > first, false)] AS fails
  FROM words JOIN firsts ON words.text = firsts.text LEFT JOIN marks ON marks.doc_id = words.doc_id
), letters AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)) AS t(letter, k)
), orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.k, b.k, c.k, d.k, e.k] AS ats
  FROM letters a JOIN letters b ON b.k <> a.k JOIN letters c ON c.k NOT IN (a.k, b.k)
  JOIN letters d ON d.k NOT IN (a.k, b.k, c.k) JOIN letters e ON e.k NOT IN (a.k, b.k, c.k, d.k)
), steps AS (
  SELECT filter_order, ats[s.step] AS own, ats[1:s.step - 1] AS before, CAST(s.step AS INTEGER) AS step
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s
), kinds AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic FROM flags GROUP BY part, fails
), acts AS (
  SELECT part, filter_order, step, own, n, n_good, n_toxic, fails[own] AS failed,
         len(list_filter(before, lambda b: fails[b])) > 0 AS gone, len(list_filter(fails, lambda f: f)) AS n_failed
  FROM kinds, steps
), audit AS (
  SELECT part, filter_order, step, own,
         sum(CASE WHEN NOT failed AND NOT gone THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN failed AND NOT gone THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN failed AND gone THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN failed AND n_failed = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN failed AND NOT gone THEN n_good ELSE 0 END) AS good_lost,
         sum(CASE WHEN failed AND NOT gone THEN n_toxic ELSE 0 END) AS toxic_lost
  FROM acts GROUP BY part, filter_order, step, own
), shapley AS (
  SELECT part, own, sum(removed) AS shapley FROM audit GROUP BY part, own
)
SELECT a.part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(s.shapley AS BIGINT) AS shapley
FROM audit a JOIN shapley s ON s.part = a.part AND s.own = a.own
"""

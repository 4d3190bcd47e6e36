"""Operator 4: benchmark passages in documents by a prefix-filtered join on rare words and exact comparison."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lading.llm.common import fresh, release, scratch, staged

#: Everything between words: ASCII other than letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of each window that must occur at their places before the window is compared as a whole.
PREFIX = 3
#: Vocabulary of the benchmark up to which words are counted by a broadcast join; beyond it, all words are counted first.
MOST_BROADCAST = 200_000


def normal_words(text: Column) -> Column:
    """Words in lower case (A-Z only), one space between them."""
    ascii_only = F.octet_length(text) == F.length(text)
    lower = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.trim(F.regexp_replace(F.coalesce(lower, F.lit("")), BETWEEN, " "))


def word_list(col: str) -> Column:
    return F.when(F.col(col) == "", F.array().cast("array<string>")).otherwise(F.split(col, " "))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` and the ``items`` themselves, per document.

    Every window of ``window`` item words (an item of fewer words is one window) must occur word by word. All of its
    words must occur then, so the join needs its ``PREFIX`` rarest words alone: words are ordered by how often all documents
    hold them, and the index has the item positions that are among the rarest of some window. An occurrence in a document
    fixes the shift between item and document; shifts under which no window lies inside the document go, and so do those
    under which fewer than ``PREFIX`` positions agree. Each remaining (document, item, shift) is compared once, position by
    position; only texts that have one are moved.

    Nulls: a null text has no words and a null item no windows; a null item_id counts as an empty string. Repeated rows
    of documents are judged alike, each with a row of its own; repeated items count once. An empty benchmark leaves all
    documents clean. Only ``doc_id, text`` and ``item_id, text`` are read.
    """
    with scratch(docs.sparkSession) as block:
        return block.result(_contamination(docs, benchmark, window), "contamination")


def _contamination(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    rows = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("mark"), normal_words(F.col("text").cast("string")).alias("norm"))
    rows = rows.withColumn("n_words", F.size(word_list("norm")).cast("long")).withColumn("row", F.monotonically_increasing_id())
    rows = staged(rows, "words")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), normal_words(F.col("text").cast("string")).alias("norm")).filter("norm <> ''").distinct()
    items = items.withColumn("words", word_list("norm")).withColumn("m", F.size("words")).withColumn("k", F.least(F.lit(window), F.col("m"))).drop("norm").withColumn("entry", F.monotonically_increasing_id())
    items = staged(items, "items")
    index = _index(rows, items)
    size = index.count()
    probe = F.broadcast(index) if size <= MOST_BROADCAST else index
    words = rows.filter("n_words > 0").select("row", "n_words", F.posexplode(F.split("norm", " ")).alias("pos", "word"))
    found = words.join(probe, "word").withColumn("shift", F.col("pos") - F.col("at"))
    inside = (F.greatest(F.lit(0), -F.col("shift")) <= F.least(F.col("m") - F.col("k"), F.col("n_words") - F.col("k") - F.col("shift"))) & (F.col("n_words") >= F.col("k"))
    found = found.filter(inside).groupBy("row", "entry", "shift").agg(F.count("*").alias("agreeing"), F.first("k").alias("k"))
    found = staged(found.filter(F.col("agreeing") >= F.least(F.lit(PREFIX), F.col("k"))).select("row", "entry", "shift"), "found")
    n_items = items.count()
    items_side = F.broadcast(items) if n_items <= MOST_BROADCAST // 20 else items
    tried = found.join(items_side, "entry").groupBy("row").agg(F.collect_list(F.struct("item", "words", "m", "k", F.col("shift").cast("int").alias("shift"))).alias("tries"))
    wanted = staged(found.select("row").distinct(), "tried-rows")
    texts = rows.select("row", "norm").join(F.broadcast(wanted) if wanted.count() <= MOST_BROADCAST else wanted, "row", "left_semi")
    tried = tried.join(texts, "row")
    # the words are split once per row: a lambda's variable is bound, where a column of another select would be pasted in
    starts = """transform(tries, t -> struct(t.item as item, t.k as k, transform(
        filter(if(greatest(0, -t.shift) <= least(t.m - t.k, size(ws) - t.k - t.shift), sequence(greatest(0, -t.shift), least(t.m - t.k, size(ws) - t.k - t.shift)), array()),
               i -> slice(ws, t.shift + i + 1, t.k) = slice(t.words, i + 1, t.k)),
        i -> i + t.shift) as at))"""
    hits = tried.select("row", F.expr(f"transform(array(split(norm, ' ')), ws -> filter({starts}, h -> size(h.at) > 0))[0]").alias("hits")).filter("size(hits) > 0")
    hits = staged(hits, "hits")
    release(docs.sparkSession)
    # spans in order of their start; each adds what lies beyond the furthest end so far
    spans = "array_sort(array_distinct(flatten(transform(hits, h -> transform(h.at, a -> struct(a as a, a + h.k as b))))))"
    covered = F.expr(f"aggregate({spans}, struct(0 as far, 0L as n), (acc, s) -> struct(greatest(acc.far, s.b) as far, acc.n + greatest(0, s.b - greatest(acc.far, s.a)) as n), acc -> acc.n)")
    hits = hits.select("row", covered.alias("n_hit"), F.expr("array_sort(array_distinct(transform(hits, h -> h.item)))").alias("items"))
    out = rows.select("row", "doc_id", "mark", "n_words").join(hits, "row", "left")
    out = out.withColumn("items", F.coalesce("items", F.array().cast("array<string>"))).withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items", "mark")


def clean_documents(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """``docs`` without rows that hold a benchmark window; equal rows are judged alike, so id and text name a verdict. A null
    text holds none, an empty table stays empty, and other columns pass through whatever they are called."""
    id_, mark = fresh(docs, "_id", "_mark")
    with scratch(docs.sparkSession) as block:
        bad = contamination(docs, benchmark, **kw).filter("contaminated").select(F.col("doc_id").alias(id_), F.col("mark").alias(mark)).distinct()
        bad = block.result(bad, "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[id_]) & (F.xxhash64(docs["text"].cast("string")) == bad[mark]), "left_anti")


def _index(rows: DataFrame, items: DataFrame) -> DataFrame:
    """``word, entry, at, m, k``: for each window of an item, the positions of its words that are rarest in all documents."""
    places = items.select("entry", "m", "k", F.posexplode("words").alias("at", "word"))
    vocabulary = staged(places.select("word").distinct(), "vocabulary")
    words = rows.filter("n_words > 0").select(F.explode(F.split("norm", " ")).alias("word"))
    if vocabulary.count() <= MOST_BROADCAST:
        counts = words.join(F.broadcast(vocabulary), "word").groupBy("word").agg(F.count("*").alias("n"))
    else:
        counts = words.groupBy("word").agg(F.count("*").alias("n")).join(vocabulary, "word")
    # a word that no document has rules out its windows
    places = places.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    windows = places.withColumn("first", F.explode(F.expr("sequence(greatest(0, at - k + 1), least(at, m - k))")))
    rare = windows.groupBy("entry", "first").agg(F.sort_array(F.collect_list(F.struct("n", "word", "at"))).alias("ws"), F.first("m").alias("m"), F.first("k").alias("k"))
    rare = rare.filter(F.col("ws")[0]["n"] > 0).select("entry", "m", "k", F.explode(F.slice("ws", 1, PREFIX)).alias("w"))
    rare = rare.select(F.col("w.word").alias("word"), "entry", F.col("w.at").alias("at"), "m", "k").distinct()
    return staged(rare, "rare")


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return contamination(read("documents"), read("benchmark")).drop("items", "mark")


OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bk AS (SELECT item, ws, least(10, len(ws)) AS k FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item, k, array_to_string(ws[i + 1 : i + k], ' ') AS w FROM (SELECT item, ws, k, unnest(range(0, len(ws) - k + 1)) AS i FROM bk)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, k, i, array_to_string(ws[i + 1 : i + k], ' ') AS w FROM (SELECT r, ws, k, unnest(range(0, len(ws) - k + 1)) AS i FROM d, ks WHERE len(ws) >= k)),
h AS (SELECT r, item, i, dw.k AS k FROM dw JOIN bw ON dw.k = bw.k AND dw.w = bw.w),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM h)) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""

"""Operator 11: hard negatives of anchors, by radix selection over blocks of scores."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lading.llm.common import scratch, ship, staged

#: Ways of a digit: a pass cuts each open range of scores into so many.
BINS = 64
#: What a task needs to know of a window.
WINDOW = ("anchor", "w", "lo", "hi", "step", "top", "tie_block", "tie_left")
#: Rows and bytes of vectors in a block, and anchors in a block of anchors. They bound a task's memory, not the result.
BLOCK_ROWS, BLOCK_BYTES, BLOCK_ANCHORS = 16384, 4 << 20, 256
#: Scores beyond this saturate, so that their hundredfold is a long.
MOST_SCORE = 1 << 55

CELLS = "anchor long, w int, bin int, block long, n long"
FOUND = "anchor long, w int, other long, score long"


def _rows(df: DataFrame, id_column: str, vector_column: str, label: Column) -> DataFrame:
    """``id, label, q, dim`` of the rows that take part, one for each id."""
    whole = F.forall("x", lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")) & ~F.isnan(v.cast("double")))
    kept = df.select(F.col(id_column).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_column).alias("x"))
    kept = kept.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull())
    q = F.transform("x", lambda v: F.floor(256.0 * v.cast("double")))
    kept = kept.filter(whole).select("id", F.struct("label", q.alias("q")).alias("row"))
    return kept.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.q", F.size("row.q").alias("dim"))


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in the order of their ids to blocks of one dimension each; a later block has larger ids."""
    part, turn = 0, 0
    for batch in batches:
        for dim, rows in batch.groupby("dim", sort=True):
            size = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, int(dim)))))
            for at in range(0, len(rows), size):
                some = rows.iloc[at : at + size]
                part = int(some["part"].iloc[0])
                q = np.array(some["q"].tolist(), np.int64).reshape(len(some), int(dim))
                yield pd.DataFrame({"block": [(part << 24) + turn], "dim": [int(dim)], "ids": [some["id"].to_numpy(np.int64).tobytes()], "labels": [some["label"].to_numpy(np.int64).tobytes()], "q": [q.tobytes()]})
                turn += 1


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``a`` with all of ``b``: exact, saturating at ``MOST_SCORE``."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    bound = a.shape[1] * float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0))
    if bound < 2**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    exact = a @ b.T if bound < 2**62 else a.astype(object) @ b.T.astype(object)
    return np.clip(exact, -MOST_SCORE, MOST_SCORE).astype(np.int64)


def _numbers(values: bytes) -> np.ndarray:
    return np.frombuffer(values, np.int64)


def _windows(pair: Any, same: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[dict[str, int]]]]:
    """For each anchor of a pair of blocks: the scores and ids of rows with a label as asked, and its windows."""
    ids, labels = _numbers(pair.ids), _numbers(pair.labels)
    anchors, own_labels = _numbers(pair.anchors), _numbers(pair.alabels)
    windows = pd.DataFrame({c: np.asarray(getattr(pair, c)) for c in WINDOW}).groupby("anchor", sort=False)
    wanted = np.isin(anchors, list(windows.groups))
    scores = _scores(_numbers(pair.aq).reshape(len(anchors), pair.dim)[wanted], _numbers(pair.q).reshape(len(ids), pair.dim))
    for anchor, label, row in zip(anchors[wanted].tolist(), own_labels[wanted].tolist(), scores):
        fits = (labels == label) & (ids != anchor) if same else labels != label
        yield anchor, row[fits], ids[fits], windows.get_group(anchor).to_dict("records")


def _histograms(pair: Any, same: bool) -> pd.DataFrame:
    """Rows for each bin of each open window; bin 0 has the highest scores. The last digit is counted by block as well."""
    out: list[np.ndarray] = []
    for anchor, scores, _, windows in _windows(pair, same):
        scores = np.sort(scores)
        for x in windows:
            edges = x["hi"] - x["step"] * np.arange(BINS + 1)  # bin k holds the scores in (edges[k + 1], edges[k]]
            edges[-1] = x["lo"] - 1
            edges = np.maximum(edges, x["lo"] - 1)
            n = -np.diff(np.searchsorted(scores, edges, "right"))
            bins = np.flatnonzero(n)
            block = pair.block if x["step"] == 1 else -1
            out.append(np.stack([np.full_like(bins, anchor), np.full_like(bins, x["w"]), bins, np.full_like(bins, block), n[bins]], 1))
    cells = np.concatenate(out) if out else np.zeros((0, 5), np.int64)
    return pd.DataFrame(cells, columns=["anchor", "w", "bin", "block", "n"])


def _gathered(pair: Any, same: bool) -> pd.DataFrame:
    """Rows above the least score of each window, and those at it that come first by block and id."""
    out = [np.zeros((0, 4), np.int64)]
    for anchor, scores, others, windows in _windows(pair, same):
        for x in windows:
            at = np.flatnonzero((scores > x["lo"]) & (scores <= x["top"]))
            if pair.block <= x["tie_block"]:
                ties = np.flatnonzero(scores == x["lo"])  # ids ascend inside a block
                at = np.concatenate([at, ties if pair.block < x["tie_block"] else ties[: x["tie_left"]]])
            out.append(np.stack([np.full_like(at, anchor), np.full_like(at, x["w"]), others[at], scores[at]], 1))
    return pd.DataFrame(np.concatenate(out), columns=["anchor", "w", "other", "score"])


def _packed_anchors(pack: pd.DataFrame) -> pd.DataFrame:
    q = np.array([*map(list, pack["q"])], np.int64)
    return pd.DataFrame({"dim": [int(pack["dim"].iloc[0])], "pack": [int(pack["pack"].iloc[0])], "anchors": [pack["id"].to_numpy(np.int64).tobytes()], "alabels": [pack["label"].to_numpy(np.int64).tobytes()], "aq": [q.tobytes()]})


def _over_blocks(blocks: DataFrame, packs: DataFrame, state: DataFrame, work: Callable[..., pd.DataFrame], schema: str) -> DataFrame:
    """``work`` for each pair of a block of rows and a pack of anchors with the same dimension. A pack and its windows go
    to every block of rows; a block of rows moves once and meets the packs one after another."""
    open_ = state.groupBy("dim", "pack").agg(F.collect_list(F.struct(*WINDOW)).alias("x"))
    open_ = open_.select("dim", "pack", *[F.col(f"x.{c}").alias(c) for c in WINDOW])
    pairs = blocks.select("dim", "block").join(open_.select("dim", "pack"), "dim")
    sent = pairs.join(open_, ["dim", "pack"]).join(packs, ["dim", "pack"])
    both = sent.join(blocks.drop("dim"), "block")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pair in batch.itertuples():
                yield work(pair)

    return both.mapInPandas(each, schema)


def _selected(blocks: DataFrame, packs: DataFrame, windows: DataFrame, same: bool) -> DataFrame:
    """The first ``need`` rows of each window ``(anchor, w, lo, hi, need, ...)``, by score and then id: ``FOUND``.

    Each pass counts scores by the next digit, takes the bin that holds the last row needed as the new range, and ends
    where a bin is a single score. There the count goes by block too: blocks are in the order of ids, so the block in which
    the last tie lies and how many it gives are known before any row moves. A window with fewer rows gives all.
    """
    key = ["anchor", "w"]
    step = lambda df: df.withColumn("step", F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo") + 1) / F.lit(BINS))).cast("long"))
    none = [F.lit(-1).cast("long").alias("tie_block"), F.lit(0).cast("long").alias("tie_left")]
    left = step(windows.filter("lo <= hi").withColumn("top", F.col("hi"))).select("*", *none)
    left, done = staged(left, "open"), []
    while left.limit(1).count():
        cells = _over_blocks(blocks, packs, left, lambda pair: _histograms(pair, same), CELLS).groupBy(*key, "bin", "block").agg(F.sum("n").alias("n"))
        cells = cells.withColumn("upto", F.sum("n").over(Window.partitionBy(*key).orderBy("bin", "block")))
        found = cells.join(left.select(*key, "need"), key).filter("upto >= need and upto - n < need")
        found = found.select(*key, "bin", "block", (F.col("need") - F.col("upto") + F.col("n")).alias("rest"))
        state = left.drop("tie_block", "tie_left").join(found, key, "left")
        last = F.col("step") == 1
        high = F.col("hi") - F.col("bin") * F.col("step")
        low = F.greatest("lo", high - F.col("step") + 1)
        state = state.select(
            *[c for c in state.columns if c not in ("lo", "hi", "need", "step", "bin", "block", "rest")],
            F.when(F.col("bin").isNull(), F.col("lo") - 1).when(last, high).otherwise(low).alias("lo"),
            F.coalesce(high, "hi").alias("hi"),
            F.coalesce("rest", "need").alias("need"),
            F.coalesce(F.when(last, F.col("block")), F.lit(-1)).cast("long").alias("tie_block"),
            F.coalesce(F.when(last, F.col("rest")), F.lit(0)).cast("long").alias("tie_left"),
            (last | F.col("bin").isNull()).alias("ended"),
        )
        state = staged(step(state), "digits")
        done.append(state.filter("ended").drop("ended"))
        left = state.filter("not ended").drop("ended")
    if not done:
        return blocks.sparkSession.createDataFrame([], FOUND)
    for more in done[1:]:
        done[0] = done[0].unionByName(more)
    return staged(_over_blocks(blocks, packs, done[0], lambda pair: _gathered(pair, same), FOUND), "gathered")


def hard_negatives(
    df: DataFrame,
    anchors: Column,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label: Column | None = None,
    n_positives: int = 5,
    n_negatives: int = 10,
    least_percent: int = 30,
    most_percent: int = 90,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows where ``anchors`` holds.

    Scores are inner products of ``floor(256 * x)``. Positives are an anchor's ``n_positives`` best other rows of its label;
    negatives are the best ``n_negatives`` of other labels with ``least_percent * positive <= 100 * negative <=
    most_percent * positive``. Higher scores come first, then smaller ids. Both are found by radix selection: histograms
    of scores, digit by digit, then only the rows that qualify move. Scores are made anew in each pass and never stored.

    Rows with a null id, label or vector, or a component that is null or not finite, take no part. Vectors meet those of
    their own length only; empty ones score 0. Of rows that share an id the one with the least label and components
    counts. Scores beyond 2**55 saturate. An empty table gives no rows; other columns are not read.
    """
    with scratch(df.sparkSession) as block:
        return block.result(_hard_negatives(df, anchors, id_column, vector_column, F.col("label") if label is None else label, n_positives, n_negatives, least_percent, most_percent), "hard-negatives")


def _hard_negatives(df: DataFrame, anchors: Column, id_column: str, vector_column: str, label: Column, n_positives: int, n_negatives: int, least: int, most: int) -> DataFrame:
    ship(df.sparkSession)
    base = staged(_rows(df, id_column, vector_column, label), "vectors")
    norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    all_rows, longest = base.agg(F.count("*"), F.max(norm)).first()
    parts = max(1, math.ceil(all_rows / BLOCK_ROWS))
    ordered = base.repartitionByRange(parts, "id").sortWithinPartitions("id").withColumn("part", F.spark_partition_id())
    blocks = staged(ordered.mapInPandas(_packed, "block long, dim int, ids binary, labels binary, q binary"), "blocks")

    chosen = df.filter(anchors).select(F.col(id_column).cast("long").alias("id")).filter("id is not null").distinct()
    chosen = staged(base.join(chosen, "id").withColumn("norm", norm), "anchors")
    n_packs = max(1, math.ceil(chosen.count() / BLOCK_ANCHORS))
    chosen = chosen.withColumn("pack", F.pmod(F.xxhash64("id"), F.lit(n_packs)))
    packs = staged(chosen.groupBy("dim", "pack").applyInPandas(_packed_anchors, "dim int, pack long, anchors binary, alabels binary, aq binary"), "packs")
    own = chosen.select(F.col("id").alias("anchor"), "dim", "pack", "norm")
    bound = F.least(F.lit(float(MOST_SCORE)), F.col("norm") * F.lit(float(longest or 0)) * 1.000001 + 1).cast("long")
    own = own.withColumn("bound", bound).drop("norm")

    windows = own.select("anchor", "dim", "pack", F.lit(0).alias("w"), (-F.col("bound")).alias("lo"), F.col("bound").alias("hi"), F.lit(n_positives).cast("long").alias("need"))
    positives = _selected(blocks, packs, windows, True)
    turn = Window.partitionBy("anchor").orderBy(F.desc("score"), "other")
    positives = staged(positives.select("anchor", F.row_number().over(turn).alias("w"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    low = F.expr(f"(positive_score * {least} + 99 - pmod(positive_score * {least} + 99, 100)) div 100")
    high = F.expr(f"(positive_score * {most} - pmod(positive_score * {most}, 100)) div 100")
    windows = positives.join(own.drop("bound"), "anchor").select("anchor", "dim", "pack", "w", low.alias("lo"), high.alias("hi"), F.lit(n_negatives).cast("long").alias("need"))
    found = _selected(blocks, packs, windows, False)
    rank = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "other")
    found = found.withColumn("rank", F.row_number().over(rank)).join(positives, ["anchor", "w"])
    return found.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.expr("if(vec_id % 7 = 0, (cast(label as long) + 1) % 10, cast(label as long))")
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, label=label)


OP11_SQL = """
WITH base AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM base a JOIN base b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS "rank", s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other)
QUALIFY row_number() OVER w <= 10
"""

"""Operator 7: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lading.llm.common import fresh, ship

FEATURES = ("words", "word_length", "upper", "digits", "symbols", "points", "marks", "white", "distinct_words", "distinct_pairs", "top_word", "dup_lines", "line_words", "other_bytes")
SYMBOLS = b"#*$%&|<>{}[]\\^~=_@/+"
POINTS = b".,;:'\"()-"
MARKS = b"!?"


def statistics(text: str | None) -> np.ndarray:
    """Transformed statistics of one whole text: logs of counts, logits of shares; a null text counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    n, n_bytes = len(words), max(1, len(raw))
    letters = max(1, int(counts[65:91].sum() + counts[97:123].sum() + counts[194:245].sum()))
    pairs = len(set(zip(words, words[1:], strict=False)))
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = lambda part, whole: np.log((part + 0.5) / (whole - part + 0.5))
    of = lambda chars: int(counts[np.frombuffer(chars, np.uint8)].sum())
    return np.array(
        [
            np.log1p(n),
            np.log1p(sum(map(len, words)) / max(1, n)),
            share(int(counts[65:91].sum()), letters),
            share(int(counts[48:58].sum()), n_bytes),
            share(of(SYMBOLS), n_bytes),
            share(of(POINTS), n_bytes),
            share(of(MARKS), n_bytes),
            share(int(counts[9:14].sum() + counts[32]), n_bytes),
            share(len(tally), max(n, len(tally))) / np.log1p(n + 1),
            share(pairs, max(n - 1, pairs)) / np.log1p(n + 1),
            share(max(tally.values(), default=0), n) / np.log1p(n + 1),
            share(len(lines) - len(set(lines)), len(lines)),
            np.log1p(n / max(1, len(lines))),
            share(int(counts[128:].sum()), n_bytes),
        ]
    )


@dataclass
class Discriminant:
    """Means, Cholesky factors and log determinants of both classes, made once and used for every score."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    logs: list[float]

    def score(self, x: np.ndarray, temper: float) -> np.ndarray:
        """Probability of class 1 for rows of ``x``: the difference of Mahalanobis log-densities plus log priors."""
        if not self.means:
            return np.full(len(x), self.logs[0])
        parts = []
        for mean, factor, log in zip(self.means, self.factors, self.logs, strict=True):
            z = np.linalg.solve(factor, (x - mean).T)
            parts.append(log - 0.5 * (z * z).sum(axis=0))
        return 1 / (1 + np.exp(-np.clip(temper * (parts[1] - parts[0]), -500, 500)))


def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink_pooled: float, shrink_diagonal: float) -> Discriminant:
    """``moments``: class -> (rows, sums, sums of products). Each covariance is drawn towards the pooled one, then towards
    a diagonal of the pooled variances. With one class, or none, all scores are the prior."""
    n = {k: moments[k][0] if k in moments else 0.0 for k in (0, 1)}
    if not n[0] or not n[1]:
        return Discriminant([], [], [0.5 if not sum(n.values()) else float(n[1] > 0)])
    mean = {k: moments[k][1] / n[k] for k in n}
    cov = {k: moments[k][2] / n[k] - np.outer(mean[k], mean[k]) for k in n}
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    diagonal = np.diag(np.maximum(np.diag(pooled), 1e-4))
    out = Discriminant([], [], [])
    for k in (0, 1):
        c = (1 - shrink_pooled) * cov[k] + shrink_pooled * pooled
        factor = np.linalg.cholesky((1 - shrink_diagonal) * c + shrink_diagonal * diagonal)
        out.means.append(mean[k])
        out.factors.append(factor)
        out.logs.append(float(np.log(n[k] / (n[0] + n[1])) - np.log(np.diag(factor)).sum()))
    return out


def held_out(key: Column, parts: int = 4, part: int = 2) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts == part


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the array column ``_x``."""
    ship(docs.sparkSession)

    @F.pandas_udf("array<double>")
    def stats(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([statistics(t) for t in batch], dtype=object)

    return docs.withColumn("_x", stats(F.col(text_col).cast("string")))


def train(marked: DataFrame, label: str, shrink_pooled: float = 0.1, shrink_diagonal: float = 0.1) -> Discriminant:
    """Fits on all rows of ``marked`` with a label of 0 or 1 by sums of ``_x`` and its products; a number per pair of
    features and class comes to the driver."""
    d = len(FEATURES)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {}
        for b in batches:
            for k, rows in b.groupby(label):
                x = np.hstack([np.ones((len(rows), 1)), np.stack(rows["_x"].to_numpy())])
                sums[int(k)] = sums.get(int(k), 0) + x.T @ x
        for k, m in sums.items():
            i, j = np.indices(m.shape)
            yield pd.DataFrame({"k": k, "i": i.ravel(), "j": j.ravel(), "v": m.ravel()})

    ship(marked.sparkSession)
    rows = marked.filter(F.col(label).isin(0, 1)).select(label, "_x").mapInPandas(partial, "k int, i int, j int, v double").groupBy("k", "i", "j").agg(F.sum("v").alias("v")).collect()
    moments = {}
    for k in {r["k"] for r in rows}:
        m = np.zeros((d + 1, d + 1))
        for r in rows:
            if r["k"] == k:
                m[r["i"], r["j"]] = r["v"]
        moments[k] = (m[0, 0], m[0, 1:], m[1:, 1:])
    return fit(moments, shrink_pooled, shrink_diagonal)


#: Labelled rows that are learned from at most: the first in a hashed order. Their ids are broadcast.
MOST_LABELS = 100_000


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", most_labels: int = MOST_LABELS) -> Discriminant:
    """The classifier of up to ``most_labels`` labelled documents that are not held out. Only texts of these are read for it."""
    marks = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_label")).filter("_label in (0, 1) and _id is not null")
    marks = marks.filter(~held_out(F.col("_id"))).orderBy(F.xxhash64("_id"), "_id").limit(most_labels)
    known = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(marks), "_id").select("text", "_label")
    return train(with_statistics(known).drop("text"), "_label")


def _scored(docs: DataFrame, model: Discriminant, temper: float, name: str) -> DataFrame:
    ship(docs.sparkSession)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.score(np.stack([statistics(t) for t in batch]), temper) if len(batch) else [], dtype="float64")

    return docs.withColumn(name, score(F.col("text").cast("string")))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7, temper: float = 0.5, most_labels: int = MOST_LABELS) -> DataFrame:
    """All columns but the text, with ``held_out``, ``score`` and ``predicted``.

    Labelled rows whose crc32(doc_id) modulo 4 is not 2 are learned from, up to ``most_labels`` of them; ids, source and
    language are no features. ``temper`` softens the densities, which features that hang together would make too sure.

    Nulls: a null text counts as empty, a null label or a label other than 0 and 1 is not learned from. A document with
    several labels counts once, with the highest. Repeated rows get equal scores and count each in training. Empty tables
    give empty results, or scores of 0.5 where no label is known. Columns named like the results are replaced.
    """
    model = learn(docs, labels, label, most_labels)
    rows = docs.select(*[c for c in docs.columns if c not in ("held_out", "score", "predicted")])
    out = _scored(rows, model, temper, "score").drop("text").withColumn("held_out", held_out(F.col("doc_id")))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def good_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7, temper: float = 0.5, most_labels: int = MOST_LABELS) -> DataFrame:
    """``docs`` without the rows that the classifier, trained as in :func:`classify`, rejects. A null or empty text is scored
    as an empty one, equal rows are judged alike, an empty table stays empty; other columns pass through unchanged."""
    model = learn(docs, labels, label, most_labels)
    (score,) = fresh(docs, "_score")
    return _scored(docs, model, temper, score).filter(F.col(score) >= threshold).drop(score)


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return classify(read("documents"), read("labels")).select("doc_id", "held_out", "score", "predicted")

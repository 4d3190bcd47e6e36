"""How far extracted rates can be trusted, which of two results is kept, and what mails hold rates at all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lading.functions.values import let

# Issues that ask for review only, however they are marked; those of unknown values besides.
REVIEWABLE = ("missing_agent", "unknown_agent", "expired_rate")
# Words that speak of rates.
KEYWORDS = (
    "tarifa", "tarifas", "flete", "fletes", "cotizacion", "cotización", "naviera", "carrier", "freight", "ocean freight", "rate", "rates",
    "surcharge", "validity", "vigencia", "pol", "pod", "poe", "container", "contenedor", "20gp", "40hc", "40gp",
)
# Headings of rate tables.
COLUMN_SIGNS = ("pol", "pod", "poe", "puerto de origen", "puerto destino", "ocean freight", "flete", "container", "contenedor", "20'", "20’", "40hc", "40hq")
AMOUNT = r"(?iu)(?:(?:\b(?:USD|EUR|CRC)\b|\bUS\$)[^\d\r\n]{0,12}|[$€₡]\s*)\d|\b(?:freight\s*amount|ocean\s*freight|rate\s*amount|flete)\s*[:=]\s*\d"
VALIDITY = r"(?iu)\b(?:validity|valid\s+from|valid\s+to|effective\s+date|expiry\s+date|vigencia|vencimiento|vence|valid)\b|\b\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\s+(?:AL|TO|A)\s+\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\b"
#: What a text holds (see ``folded``) wherever AMOUNT, or VALIDITY by a word, can match.
AMOUNT_MARKS = ("usd", "eur", "crc", "$", "€", "₡", "amount", "freight", "flete")
VALIDITY_MARKS = ("valid", "effective", "expiry", "vigencia", "vencimiento", "vence")
NARRATIVE = (r"(?iu)\b(?:pls|please)\s+consider\s+rate\b", r"(?iu)\bvalid\b", r"(?iu)\bcarrier\b", r"(?iu)\bPOL\s*:", r"(?iu)\bPOD\s*:")
#: References that every record needs, and those it needs where it names a value.
REQUIRED, OPTIONAL = ("origin_port", "port_of_exit", "container_type", "carrier", "currency"), ("destination_port", "agent")


def _known(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) != ""


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def hard(code: Column, blocking: Column) -> Column:
    """Whether an issue really blocks: it is marked so and is not one for review."""
    return blocking & ~code.isin(*REVIEWABLE) & ~F.startswith(F.lower(code), F.lit("unknown_"))


def catalog_match(records: DataFrame) -> DataFrame:
    """``execution_id, catalog_match``: the mean share of references that are resolved, in percent, per execution."""
    one = lambda c: F.col(f"{c}_ref").isNotNull().cast("int")
    expected = F.lit(len(REQUIRED)) + _sum([_known(c).cast("int") for c in OPTIONAL])
    matched = _sum([one(c) for c in REQUIRED] + [F.when(_known(c), one(c)).otherwise(0) for c in OPTIONAL])
    return records.groupBy("execution_id").agg(F.round(F.avg(100.0 * matched / expected), 6).alias("catalog_match"))


def issue_rows(issues: DataFrame) -> DataFrame:
    """Per execution: distinct records with blocking issues, with hard ones and with ones for review, and whether a hard or
    a blocking issue stands for all."""
    hard_, some = hard(F.col("code"), F.col("is_blocking")), F.col("record_id").isNotNull()
    n = lambda cond: F.count_distinct(F.when(cond, F.col("record_id")))
    return issues.groupBy("execution_id").agg(
        n(F.col("is_blocking")).alias("blocking_rows"), n(hard_).alias("hard_rows"), n(~hard_).alias("review_rows"),
        F.count_if(F.col("is_blocking")).alias("blocking_issues"), F.bool_or(hard_ & ~some).alias("hard_for_all"), F.bool_or(F.col("is_blocking") & ~some).alias("blocked_for_all"),
    )


def extraction_confidence(executions: DataFrame, records: DataFrame, issues: DataFrame) -> DataFrame:
    """``execution_id, structural, catalog_match, confidence``.

    ``executions(execution_id, source_type)``: source_type is null for mail bodies. Structure: the percentage of records
    without hard issues, ten more for spreadsheets and CSV, up to five less for records to review, five less for bodies.
    The confidence is the lesser of that and the catalog match; without records or with a hard issue for all it is 0.
    """
    totals = records.groupBy("execution_id").agg(F.count("*").alias("rows"))
    j = executions.join(totals, "execution_id", "left").join(issue_rows(issues), "execution_id", "left").join(catalog_match(records), "execution_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    raw = 100.0 * (n("rows") - n("hard_rows")) / n("rows") - 5.0 * n("review_rows") / n("rows") + F.when(F.col("source_type").isin("Excel", "Csv"), 10).otherwise(0) - F.when(F.col("source_type").isNull(), 5).otherwise(0)
    none = (n("rows") == 0) | F.coalesce("hard_for_all", F.lit(False))
    structural = F.when(none, 0.0).otherwise(F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw)), 6))
    match = F.when(none, 0.0).otherwise(F.coalesce("catalog_match", F.lit(0.0)))
    return j.select("execution_id", structural.alias("structural"), match.alias("catalog_match"), F.least(structural, match).alias("confidence"))


def quality(records: DataFrame, issues: DataFrame) -> DataFrame:
    """``execution_id, quality, blocking_ratio, prior_confidence`` of executions with records: weighted counts of records by
    status, of filled fields and references, less blocking issues."""
    has = lambda c, w: F.when(_known(c), w).otherwise(0)
    ref = lambda c: F.when(F.col(f"{c}_ref").isNotNull(), 5).otherwise(0)
    fields = _sum([has(c, 40) for c in ("origin_port", "port_of_exit", "container_type", "carrier")] + [has(c, 25) for c in ("currency", "valid_from", "valid_to")])
    fields = fields + F.when(F.coalesce("ocean_freight", "total_sale").isNotNull(), 40).otherwise(0) + _sum([ref(c) for c in REQUIRED])
    state = lambda s: F.count_if(F.col("status") == s)
    per = records.groupBy("execution_id").agg(F.count("*").alias("rows"), F.sum(fields).alias("fields"), state("Valid").alias("valid"), state("RequiresReview").alias("warning"), state("Invalid").alias("invalid"))
    j = per.join(issue_rows(issues), "execution_id", "left").join(catalog_match(records), "execution_id")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    score = 1000 * F.col("rows") + 250 * F.col("valid") + 100 * F.col("warning") - 500 * F.col("invalid") - 300 * n("blocking_issues") + F.col("fields")
    ratio = F.when(F.coalesce("blocked_for_all", F.lit(False)), 1.0).otherwise(F.round(n("blocking_rows") / F.col("rows"), 6))
    prior = F.least(F.round(100.0 * (F.col("valid") + F.col("warning")) / F.col("rows"), 6), F.col("catalog_match"))
    return j.select("execution_id", score.cast("long").alias("quality"), ratio.alias("blocking_ratio"), prior.alias("prior_confidence"))


def better(first: DataFrame, second: DataFrame) -> DataFrame:
    """``execution_id, take_second`` for two results of the same work, as ``quality`` rates them: the second is taken where
    the first has no records, where fewer of its records are blocked, or as few with a higher quality."""
    j = first.alias("a").join(second.alias("b"), "execution_id", "full_outer")
    less, same = F.col("b.blocking_ratio") < F.col("a.blocking_ratio"), F.col("b.blocking_ratio") == F.col("a.blocking_ratio")
    take = F.when(F.col("b.quality").isNull(), False).when(F.col("a.quality").isNull(), True).otherwise(less | (same & (F.col("b.quality") > F.col("a.quality"))))
    return j.select("execution_id", take.alias("take_second"))


def sends(confidence: Column, auto_send: Column, least: Column) -> Column:
    """Whether a result goes out without review."""
    return F.coalesce(auto_send & (confidence >= least), F.lit(False))


def keyword_hits(text: Column) -> Column:
    """How many of the words that speak of rates occur, whole and in any case."""
    bounded = lambda k: text.rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}]){k}(?![\p{{L}}\p{{N}}])").cast("int")
    seen = lambda low: _sum([F.when(text.isNull() | F.contains(low, F.lit(k)), bounded(k)).otherwise(0) for k in KEYWORDS])
    return let(folded(text), seen)


def folded(text: Column) -> Column:
    """Lower case, in which letters that a pattern in any case takes for ``i``, ``k`` and ``s`` are those. A text can only match
    such a pattern if this holds the letters that the pattern must have, which costs far less to see."""
    return F.lower(F.translate(text, "\u0130\u0131\u017f\u212a", "iisk"))


def _has_any(low: Column, marks: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(m)) for m in marks])


def text_table(body: Column) -> Column:
    """Whether two lines hold two tabs or two bars each, or a line POL is followed, within twelve, by POD, carrier and a
    container size: a table with one cell a line."""
    lines = F.filter(F.transform(F.split(F.coalesce(body, F.lit("")), "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    count = lambda x, sign: F.length(x) - F.length(F.replace(x, F.lit(sign), F.lit("")))
    barred = lambda ls: F.size(F.filter(ls, lambda x: (count(x, "\t") >= 2) | (count(x, "|") >= 2))) >= 2
    key = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")
    # keys are made of the twelve lines only, and only where the first can be POL
    begins = lambda x: x.rlike("(?i)^[^a-z0-9]*p[^a-z0-9]*o[^a-z0-9]*l[^a-z0-9]*$") & (key(x) == "pol")
    whole = lambda ks: F.array_contains(ks, "pod") & F.array_contains(ks, "carrier") & F.exists(ks, lambda c: c.rlike("^(20|40|45)(gp|hq|hc|dv|dc|nor)?$"))
    stacked = lambda ls: F.size(F.filter(ls, lambda x, i: F.when(begins(x), let(F.transform(F.slice(ls, i + 1, 12), key), whole)).otherwise(False))) > 0
    return let(lines, lambda ls: barred(ls) | stacked(ls))


def classify_messages(messages: DataFrame) -> DataFrame:
    """``messages`` with ``hits``, ``has_table``, ``body_confidence``, ``confidence``, ``process_body``, ``contains_rates``.

    Needs ``subject``, ``body``, ``attachments`` (how many are supported) and the account's ``body_with_attachments`` and
    ``body_without_attachments``. A body is worked on where it has an amount and enough of a rate's shape.
    """
    text = F.concat(F.coalesce("subject", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit("")))
    m = messages.withColumn("_text", text).withColumn("hits", keyword_hits(F.col("_text"))).withColumn("has_table", text_table(F.col("body")))
    m = m.withColumn("_columns", let(F.lower("_text"), lambda low: _has_any(low, COLUMN_SIGNS)))
    signs = let(folded(F.col("_text")), lambda low: F.struct(_has_any(low, AMOUNT_MARKS).alias("amount"), _has_any(low, VALIDITY_MARKS).alias("valid")))
    m = m.withColumn("_signs", signs)
    m = m.withColumn("_amount", F.col("_signs.amount") & F.col("_text").rlike(AMOUNT)).withColumn("_valid", (F.col("_signs.valid") | F.col("_text").rlike(r"[0-9][/.-][0-9]+[/.-][0-9]")) & F.col("_text").rlike(VALIDITY))
    m = m.withColumn("_told", reduce(lambda a, b: a & b, [F.col("_text").rlike(p) for p in NARRATIVE]) & F.col("_amount"))
    table = F.col("has_table") & F.col("_columns") & F.col("_amount")
    strong = F.col("_told") | table | (F.col("_columns") & F.col("_amount") & F.col("_valid"))
    signals = strong | ((F.col("hits") >= 3) & F.col("_amount") & F.col("_valid"))
    body = F.least(F.lit(90), 8 * F.col("hits") + F.when(signals, 15).otherwise(0) + F.when(table, 10).otherwise(0) + F.when(F.col("_told"), 25).otherwise(0))
    some = F.coalesce("attachments", F.lit(0)) > 0
    process = (F.trim(F.coalesce("body", F.lit(""))) != "") & strong & F.when(some, F.col("body_with_attachments")).otherwise(F.col("body_without_attachments"))
    out = m.withColumn("body_confidence", body).withColumn("confidence", F.greatest(F.col("body_confidence"), F.when(some, 75).otherwise(0))).withColumn("process_body", process)
    return out.withColumn("contains_rates", some | F.col("process_body")).drop("_text", "_signs", "_columns", "_amount", "_valid", "_told")

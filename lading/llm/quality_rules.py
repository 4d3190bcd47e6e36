"""Operator 8: document rules and verdicts on hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lading.llm.common import SPACE, scratch, staged

SYMBOLS = "#*$%&|<>"


def rule_counts(docs: DataFrame, window: int = 8) -> DataFrame:
    """``doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words`` of whole texts, row by row.

    ``n_lines`` are the lines that hold a word. All counts are array and string expressions of the row, so nothing is shuffled. Windows get a hash built from hashes
    of halves; a text without equal hashes stops there, others sort theirs once. Nulls: a null text counts as empty, a
    null source as a host of its own. Repeated rows give repeated results.
    """
    if window & (window - 1):
        raise ValueError("the window is a power of two")
    base = docs.select("doc_id", F.col("source").cast("string").alias("host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("w", F.filter(F.split("text", SPACE), lambda x: x != ""))
    base = base.withColumn("n_words", F.size("w").cast("long"))
    symbols = F.length("text") - F.length(F.translate("text", SYMBOLS, ""))
    base = base.withColumn("n_symbols", symbols.cast("long"))
    base = base.withColumn("word_chars", F.length(F.regexp_replace("text", SPACE, "")).cast("long"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0)
    base = base.withColumn("_lines", lines).withColumn("n_lines", F.size("_lines").cast("long")).withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    base = base.withColumn("h0", F.transform("w", lambda x: F.xxhash64(x))).drop("w", "_lines", "text")
    step, name = 1, "h0"
    while step < window:
        made = f"h{step}"
        base = base.withColumn(made, F.expr(f"if(size({name}) > {step}, transform(slice({name}, {step + 1}, size({name})), (x, i) -> xxhash64({name}[i], x)), array())"))
        base, step, name = base.drop("h0") if step > 1 else base, step * 2, made
    base = base.withColumn("h", F.col(name)).drop("h0", *[f"h{1 << k}" for k in range(20)])
    # the text's windows in order of hash; those next to an equal one are repeats, and each covers up to the next repeat
    base = base.withColumn("_s", F.expr("if(size(array_distinct(h)) = size(h), array(), array_sort(transform(h, (x, i) -> struct(x, i))))"))
    base = base.withColumn("_p", F.expr("array_sort(transform(filter(_s, (s, k) -> (k > 0 and _s[greatest(k - 1, 0)].x = s.x) or (k < size(_s) - 1 and _s[least(k + 1, size(_s) - 1)].x = s.x)), s -> s.i))"))
    covered = F.expr(f"aggregate(transform(_p, (p, k) -> if(k = size(_p) - 1, {window}, least({window}, _p[least(k + 1, size(_p) - 1)] - p))), 0L, (a, x) -> a + x)")
    return base.withColumn("n_repeat_words", covered.cast("long")).select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def host_rules(docs: DataFrame, least_words: int = 20, most_repeat_percent: int = 30, most_symbol_share: float = 0.1, most_dup_line_share: float = 0.3, host_limit: float = 0.5, certainty: float = 1.645) -> DataFrame:
    """Counts, ``base_failed``, ``kept`` and the host's ``host_rate`` and ``host_rejected`` per document.

    A document fails a rule when it is short, repeats windows, is full of symbols or repeats lines; per host the failing
    documents are counted. The rates of all hosts give a beta prior by the method of moments, weighted by documents; the
    posterior mean shrinks small hosts towards it. Documents that fail the base rules go. Those that fail another rule go
    where their host's rate exceeds the corpus rate by ``certainty`` standard deviations of the posterior (1.645: a chance of
    0.95), as the host then bears the suspicion out. All documents of a host with a shrunk rate above ``host_limit`` go. With
    one host, or hosts that differ no more than draws of documents do, the prior is the mean rate with the weight of 100
    documents, and no host bears a suspicion out.

    Nulls: a null text is empty and fails, a null source is a host of its own. Repeated rows count each; an empty table
    gives an empty result. Only ``doc_id, text, source`` are read.
    """
    with scratch(docs.sparkSession) as block:
        return block.result(_host_rules(docs, least_words, most_repeat_percent, most_symbol_share, most_dup_line_share, host_limit, certainty), "host-rules")


def _host_rules(docs: DataFrame, least_words: int, most_repeat_percent: int, most_symbol_share: float, most_dup_line_share: float, host_limit: float, certainty: float) -> DataFrame:
    counts = rule_counts(docs)
    lines = F.col("n_dup_lines")
    counts = counts.withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words")))
    failed = F.col("base_failed") | (F.col("n_symbols") > most_symbol_share * F.col("word_chars")) | (lines > most_dup_line_share * F.col("n_lines"))
    counts = staged(counts.withColumn("failed", failed).withColumn("host_key", F.coalesce(F.concat(F.lit("="), "host"), F.lit("null"))), "rule-counts")
    hosts = counts.groupBy("host_key").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("bad")).withColumn("rate", F.col("bad") / F.col("n"))
    prior = hosts.agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"), F.count("*").alias("hosts"), F.sum(F.col("n") * F.col("rate") * F.col("rate")).alias("nr2")).first()
    if prior["n"]:
        mean = prior["bad"] / prior["n"]
        noise = mean * (1 - mean) * prior["hosts"] / prior["n"]  # what the draws of documents add to the spread
        spread = max(0.0, prior["nr2"] / prior["n"] - mean * mean - noise)
        differ = prior["hosts"] > 1 and spread > 0
        weight = mean * (1 - mean) / spread - 1 if differ else 100.0
        alpha, beta = mean * max(weight, 1.0), (1 - mean) * max(weight, 1.0)
    else:
        differ, alpha, beta = False, 1.0, 1.0
    verdicts = hosts.select("host_key", ((F.col("bad") + F.lit(alpha)) / (F.col("n") + F.lit(alpha + beta))).alias("host_rate"), (F.col("n") + F.lit(alpha + beta + 1)).alias("host_weight"))
    out = counts.join(verdicts, "host_key").withColumn("host_rejected", F.col("host_rate") > host_limit)
    deviation = F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / F.col("host_weight"))
    borne_out = F.lit(differ) & F.col("failed") & (F.col("host_rate") - F.lit(alpha / (alpha + beta)) > certainty * deviation)
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected") & ~borne_out).drop("host_key", "host_weight", "failed")


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = host_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rate")

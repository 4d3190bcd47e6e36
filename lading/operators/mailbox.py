"""Messages, accounts and extraction jobs as tables: filters, pages, due work, leases and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: States of jobs that are still on their way.
ACTIVE = ("Pending", "Extracting", "AwaitingAi", "AiProcessing", "ValidatingAiResult", "AwaitingPricing")
#: States of jobs with nothing left to do.
DONE = ("SentToPricing", "Ignored")
# Extension and type of attachments that are read.
SUPPORTED = {".pdf": "Pdf", ".csv": "Csv", ".xlsx": "Excel"}
MOST_PER_PAGE = 100


def live(rows: DataFrame) -> DataFrame:
    """Rows that are not marked as deleted."""
    return rows.filter(~F.coalesce("is_deleted", F.lit(False)))


def matching(rows: DataFrame, search: str | None, columns: list[str]) -> DataFrame:
    """Rows where any of the columns holds the text in any case; a blank search finds all."""
    wanted = (search or "").strip().lower()
    if not wanted:
        return rows
    found = F.lit(False)
    for c in columns:
        found = found | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(wanted))
    return rows.filter(found)


def having(rows: DataFrame, **values) -> DataFrame:
    """Rows with these values; a value of None filters nothing."""
    for c, v in values.items():
        rows = rows if v is None else rows.filter(F.col(c) == F.lit(v))
    return rows


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> tuple[DataFrame, DataFrame]:
    """One page and the count of all rows. The size is kept within 1 to 100, the number at 1 at least. Spark takes the
    rows by a top-k per partition."""
    size, number = max(1, min(MOST_PER_PAGE, size)), max(1, number)
    return rows.orderBy(*order).offset((number - 1) * size).limit(size), rows.agg(F.count("*").alias("total"))


def allowed_sender(allowed: Column, sender: Column) -> Column:
    """Whether a list of senders (``*``, addresses, ``@domain`` or ``*@domain``, by comma, semicolon or line) admits one.
    A blank list admits all."""
    who = F.lower(F.trim(sender))
    marks = F.filter(F.transform(F.split(F.lower(F.coalesce(allowed, F.lit(""))), r"[,;\n\r]"), lambda t: F.trim(t)), lambda t: t != "")
    fits = lambda t: (t == "*") | (t == who) | (F.startswith(t, F.lit("@")) & F.endswith(who, t)) | (F.startswith(t, F.lit("*@")) & F.endswith(who, F.substr(t, F.lit(2))))
    return (F.trim(F.coalesce(allowed, F.lit(""))) == "") | F.coalesce(F.exists(marks, fits), F.lit(False))


def supported_attachment(kind: Column, extension: Column) -> Column:
    """Whether extension (with or without its dot) and detected type both name a file that is read."""
    bare = F.lower(F.trim(F.coalesce(extension, F.lit(""))))
    dotted = F.when((bare != "") & ~F.startswith(bare, F.lit(".")), F.concat(F.lit("."), bare)).otherwise(bare)
    found = F.lit(False)
    for end, name in SUPPORTED.items():
        found = found | ((dotted == end) & (kind == name))
    return F.coalesce(found, F.lit(False))


def distinct_attachments(attachments: DataFrame) -> DataFrame:
    """The first attachment of each content hash within a message; ties go by id."""
    row = F.min_by(F.struct(*attachments.columns), F.struct("position", "attachment_id")).alias("a")
    return attachments.groupBy(F.col("message_id").alias("_m"), F.col("hash").alias("_h")).agg(row).select("a.*")


def due_accounts(accounts: DataFrame, now: Column, retry_minutes: int = 2) -> DataFrame:
    """Accounts never synced, or not for their interval (a minute at least); after an error, for ``retry_minutes``."""
    failed = F.trim(F.coalesce("last_sync_error", F.lit(""))) != ""
    wait = F.when(failed, F.lit(retry_minutes)).otherwise(F.greatest(F.lit(1), "polling_interval_minutes"))
    return accounts.filter(F.col("last_sync_at").isNull() | (F.timestamp_seconds(F.unix_timestamp("last_sync_at") + 60 * wait) <= now))


def cursors(messages: DataFrame) -> DataFrame:
    """The highest number read so far per account."""
    return messages.groupBy("account_id").agg(F.max("uid").alias("last_uid"))


def claimable(now: Column) -> Column:
    return (F.col("status") == "Pending") & ~F.coalesce("is_deleted", F.lit(False)) & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now))


def stale(now: Column) -> Column:
    return (F.col("status") == "Extracting") & ~F.coalesce("is_deleted", F.lit(False)) & F.coalesce(F.col("lease_expires_at") < now, F.lit(False))


def claim(jobs: DataFrame, now: Column, owner: str, count: int = 1, lease_minutes: int = 10) -> DataFrame:
    """The ``count`` oldest jobs that may start, marked as taken by ``owner`` until the lease ends."""
    first = jobs.filter(claimable(now)).orderBy("created_at", "job_id").limit(count)
    return first.withColumn("status", F.lit("Extracting")).withColumn("lease_owner", F.lit(owner)).withColumn("lease_expires_at", F.timestamp_seconds(F.unix_timestamp(now) + 60 * lease_minutes))


def recover(jobs: DataFrame, now: Column, most_attempts: int = 3, count: int = 100) -> DataFrame:
    """Up to ``count`` jobs whose lease ran out, the longest ago first: failed where attempts are used up, else pending
    again at once."""
    lost = jobs.filter(stale(now)).orderBy("lease_expires_at", "job_id").limit(count)
    spent = F.col("attempt_count") >= most_attempts
    out = lost.withColumn("status", F.when(spent, "Failed").otherwise("Pending")).withColumn("next_attempt_at", F.when(~spent, now))
    return out.withColumn("error_code", F.lit("DataExtraction.ExtractionLeaseExpired")).withColumn("lease_expires_at", F.lit(None).cast("timestamp"))


def message_states(jobs: DataFrame) -> DataFrame:
    """``message_id, state, error_message, jobs`` from the live jobs of each message: any active one leaves it processing;
    all done make it extracted; else one for review, then a failed one, decides with the first error text by age. States
    not named leave it as it is (null)."""
    s = F.col("status")
    by_age = F.struct("created_at", "job_id")
    first = lambda state: F.min_by("error_message", F.when(s == state, by_age))
    any_ = lambda cond: F.bool_or(cond)
    active, done = any_(s.isin(*ACTIVE)), F.bool_and(s.isin(*DONE))
    review, failed = any_(s == "NeedsReview"), any_(s == "Failed")
    state = F.when(active, "Processing").when(done, "Extracted").when(review, "NeedsReview").when(failed, "Failed")
    error = F.when(active | done, None).when(review, first("NeedsReview")).when(failed, first("Failed"))
    return live(jobs).groupBy("message_id").agg(state.alias("state"), error.alias("error_message"), F.count("*").alias("jobs"))


def health(jobs: DataFrame, now: Column, warn_at: int = 100) -> DataFrame:
    """Counts of pending, active, stale, review and failed jobs in one row, and whether the backlog is too long."""
    n = lambda cond: F.count_if(cond)
    s = F.col("status")
    out = live(jobs).agg(n(s == "Pending").alias("pending"), n(s.isin(*ACTIVE)).alias("active"), n(stale(now)).alias("stale"), n(s == "NeedsReview").alias("review"), n(s == "Failed").alias("failed"))
    return out.withColumn("degraded", (F.col("pending") >= warn_at) | (F.col("stale") > 0))


def spent(rows: DataFrame, now: Column, days: int = 30, count: int = 250) -> DataFrame:
    """The oldest rows of an inbox or outbox that were dealt with ``days`` ago or longer, up to ``count``."""
    return rows.filter(F.col("processed_at") < F.timestamp_seconds(F.unix_timestamp(now) - 86400 * days)).orderBy("processed_at").limit(count)


def without_siblings(jobs: DataFrame, state: str = "SentToPricing") -> DataFrame:
    """Jobs of messages of which no job has the state."""
    return jobs.join(jobs.filter(F.col("status") == state).select("message_id").distinct(), "message_id", "left_anti")


def latest_attempts(jobs: DataFrame) -> DataFrame:
    """The newest job of each message and attachment."""
    order = Window.partitionBy("message_id", "attachment_id").orderBy(F.col("created_at").desc(), F.col("job_id").desc())
    return jobs.withColumn("_place", F.row_number().over(order)).filter("_place = 1").drop("_place")

"""The state machine of extraction jobs: replayed over stored events, or kept by a stream.

A job is claimed under a lease, waits for the answers of two services, and ends in one of four states. A lease that runs out
sends the job back, or fails it when its attempts are used up; a retry waits for some seconds. Both follow from the times
of events: a replay and a stream that have seen the same events give the same jobs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from lading.functions.values import let

EVENT = "job_id string, ts timestamp, event_id string, type string, request_id string, request_hash string, error_code string, owner string"
#: Times are microseconds since 1970, as the stream's timers count them.
JOB = "status string, attempts int, request_id string, request_hash string, error_code string, owner string, lease_until bigint, next_attempt bigint, refused int, ignored int"
STATE = f"job_id string, {JOB}"
FIELDS = tuple(f.split()[0] for f in JOB.split(", "))
CLOSED = ("SentToPricing", "NeedsReview", "Failed", "Ignored")
#: type of event -> (states it applies in, the state after it). Others are refused.
MOVES = {
    "claim": (("Pending",), "Extracting"),
    "renew": (("Extracting",), "Extracting"),
    "await_ai": (("Extracting",), "AwaitingAi"),
    "ai_started": (("AwaitingAi", "AiProcessing"), "AiProcessing"),
    "ai_completed": (("AwaitingAi", "AiProcessing", "ValidatingAiResult"), "ValidatingAiResult"),
    "await_import": (("ValidatingAiResult", "Extracting"), "AwaitingPricing"),
    "import_by_hand": (("NeedsReview",), "AwaitingPricing"),
    "import_completed": (("AwaitingPricing",), "SentToPricing"),
    "import_failed": (("AwaitingPricing",), "NeedsReview"),
    "ai_failed": (("AwaitingAi", "AiProcessing", "ValidatingAiResult"), "NeedsReview"),
    "retry": (("Extracting",), "Pending"),
    "review": (("Pending", "Extracting", "AwaitingAi", "AiProcessing", "ValidatingAiResult", "AwaitingPricing"), "NeedsReview"),
    "ignore": (("Pending", "Extracting", "NeedsReview"), "Ignored"),
    "reset": (("Extracting", "AwaitingAi", "AiProcessing", "ValidatingAiResult", "AwaitingPricing", *CLOSED), "Pending"),
}
#: Events that come late are passed over, not refused, where the job is already past them.
LATE = {
    "ai_started": ("ValidatingAiResult", "AwaitingPricing", *CLOSED),
    "ai_completed": ("AwaitingPricing", "SentToPricing", "NeedsReview"),
    "import_completed": CLOSED,
    "import_failed": CLOSED,
    "ai_failed": CLOSED,
}
AI_LEASE_LOST = "AI.EmailJobLeaseExpired"
LEASE_EXPIRED = "DataExtraction.ExtractionLeaseExpired"
MOST_ATTEMPTS, LEASE, RETRY_DELAY = 3, 600_000_000, 30_000_000


def start() -> dict[str, Any]:
    return dict.fromkeys(FIELDS) | {"status": "Pending", "attempts": 0, "refused": 0, "ignored": 0}


def expire(s: dict[str, Any], at: int) -> dict[str, Any]:
    """The job at a time: pending again, or failed, if its lease has run out before."""
    if s["status"] != "Extracting" or s["lease_until"] is None or s["lease_until"] >= at:
        return s
    spent = s["attempts"] >= MOST_ATTEMPTS
    back = {"status": "Failed" if spent else "Pending", "next_attempt": None if spent else s["lease_until"]}
    return s | back | {"error_code": LEASE_EXPIRED, "owner": None, "lease_until": None}


def _refused(s: dict[str, Any], e: dict[str, Any]) -> bool:
    kind, blank = e["type"], lambda c: not (e[c] or "").strip()
    if kind not in MOVES or s["status"] not in MOVES[kind][0]:
        return True
    if kind == "claim":
        return blank("owner") or s["next_attempt"] is not None and s["next_attempt"] > e["at"]
    if kind == "renew":
        return e["owner"] != s["owner"]
    return kind == "await_ai" and (blank("request_id") or blank("request_hash"))


def step(s: dict[str, Any], e: dict[str, Any]) -> tuple[dict[str, Any], str]:
    """The job after one event, and whether that was ``moved``, ``ignored`` or ``refused``."""
    kind, s = e["type"], expire(s, e["at"])
    if (kind or "").startswith("ai_") and (s["request_id"] is None or s["request_id"] != e["request_id"]):
        return s | {"refused": s["refused"] + 1}, "refused"
    if kind == "ai_completed" and e["request_hash"] != s["request_hash"]:
        return s | {"refused": s["refused"] + 1}, "refused"
    if kind == "ai_completed" and s["status"] in ("NeedsReview", "Failed") and s["error_code"] == AI_LEASE_LOST:
        return s | {"status": "ValidatingAiResult", "error_code": None}, "moved"
    if s["status"] in LATE.get(kind, ()):
        return s | {"ignored": s["ignored"] + 1}, "ignored"
    if _refused(s, e):
        return s | {"refused": s["refused"] + 1}, "refused"
    if kind == "renew":
        return s | {"lease_until": e["at"] + LEASE}, "moved"
    if kind == "reset":
        return start() | {"refused": s["refused"], "ignored": s["ignored"]}, "moved"
    spent = kind == "retry" and s["attempts"] >= MOST_ATTEMPTS
    out = s | {"status": "Failed" if spent else MOVES[kind][1], "error_code": e["error_code"] if kind in ("ai_failed", "import_failed", "retry") else None}
    if kind != "ai_started":
        out |= {"owner": None, "lease_until": None, "next_attempt": e["at"] + RETRY_DELAY if kind == "retry" and not spent else None}
    if kind == "claim":
        out |= {"attempts": s["attempts"] + 1, "owner": e["owner"].strip(), "lease_until": e["at"] + LEASE}
    if kind == "await_ai":
        out |= {"request_id": e["request_id"], "request_hash": e["request_hash"].strip()}
    return out, "moved"


# The same machine as column expressions, for stored events.


def _with(s: Column, **changes: Column) -> Column:
    types = dict(f.split() for f in JOB.split(", "))
    return F.struct(*[(changes[f] if f in changes else s[f]).cast(types[f]).alias(f) for f in FIELDS])


def _expired(s: Column, at: Column) -> Column:
    null = F.lit(None)
    spent = s["attempts"] >= MOST_ATTEMPTS
    gone = (s["status"] == "Extracting") & F.coalesce(s["lease_until"] < at, F.lit(False))
    after = _with(s, status=F.when(spent, "Failed").otherwise("Pending"), next_attempt=F.when(~spent, s["lease_until"]), error_code=F.lit(LEASE_EXPIRED), owner=null, lease_until=null)
    return F.when(gone, after).otherwise(s)


def _outcome(s: Column, e: Column) -> Column:
    kind, blank = F.coalesce(e["type"], F.lit("")), lambda c: F.coalesce(F.trim(e[c]) == "", F.lit(True))
    same = lambda c: s[c].eqNullSafe(e[c])
    any_of = lambda table: F.coalesce(*[F.when(kind == k, s["status"].isin(*states)) for k, states in table.items()], F.lit(False))
    foreign = (F.startswith(kind, F.lit("ai_")) & (s["request_id"].isNull() | ~same("request_id"))) | ((kind == "ai_completed") & ~same("request_hash"))
    reopens = (kind == "ai_completed") & s["status"].isin("NeedsReview", "Failed") & s["error_code"].eqNullSafe(F.lit(AI_LEASE_LOST))
    unfit = ~any_of({k: states for k, (states, _) in MOVES.items()})
    unfit = unfit | ((kind == "claim") & (blank("owner") | F.coalesce(s["next_attempt"] > e["at"], F.lit(False)))) | ((kind == "renew") & ~same("owner"))
    unfit = unfit | ((kind == "await_ai") & (blank("request_id") | blank("request_hash")))
    return F.when(foreign, "refused").when(reopens, "reopened").when(any_of(LATE), "ignored").when(unfit, "refused").otherwise("moved")


def _moved(s: Column, e: Column) -> Column:
    kind, null, fresh = e["type"], F.lit(None), start()
    spent = (kind == "retry") & (s["attempts"] >= MOST_ATTEMPTS)
    target = F.coalesce(*[F.when(kind == k, to) for k, (_, to) in MOVES.items()])
    held = kind == "ai_started"
    leased = F.when(kind == "claim", e["at"] + LEASE).when(held, s["lease_until"])
    waits = F.when((kind == "retry") & ~spent, e["at"] + RETRY_DELAY).when(held, s["next_attempt"])
    asked = lambda c: F.when(kind == "await_ai", F.trim(e[c]) if c == "request_hash" else e[c]).otherwise(s[c])
    plain = _with(
        s,
        status=F.when(spent, "Failed").otherwise(target),
        error_code=F.when(kind.isin("ai_failed", "import_failed", "retry"), e["error_code"]),
        owner=F.when(kind == "claim", F.trim(e["owner"])).when(held, s["owner"]),
        lease_until=leased,
        next_attempt=waits,
        attempts=s["attempts"] + F.when(kind == "claim", 1).otherwise(0),
        request_id=asked("request_id"),
        request_hash=asked("request_hash"),
    )
    reset = _with(s, **{f: F.lit(fresh[f]) for f in FIELDS if f not in ("refused", "ignored")})
    return F.when(kind == "renew", _with(s, lease_until=e["at"] + LEASE)).when(kind == "reset", reset).otherwise(plain)


def _after(s: Column, e: Column) -> Column:
    null = F.lit(None)
    next_ = lambda s, o: (
        F.when(o == "refused", _with(s, refused=s["refused"] + 1))
        .when(o == "ignored", _with(s, ignored=s["ignored"] + 1))
        .when(o == "reopened", _with(s, status=F.lit("ValidatingAiResult"), error_code=null))
        .otherwise(_moved(s, e))
    )
    return let(_expired(s, e["at"]), lambda x: let(_outcome(x, e), lambda o: next_(x, o)))


def timed(events: DataFrame) -> DataFrame:
    """Events with ``at``, their time in microseconds; those without job, time or id are none."""
    return events.filter("job_id is not null and ts is not null and event_id is not null").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))


def replay(events: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Each job after its events, each once, in the order of time and id; with ``as_of``, those up to it and leases that it
    finds run out. A job has some dozens of events, which meet in one row; the fold is an expression. Of events that share
    time and id the least by its other fields counts."""
    known = timed(events) if as_of is None else timed(events).filter(F.col("ts") <= as_of)
    one = known.groupBy("job_id", "at", "event_id").agg(F.min(F.struct("type", "request_id", "request_hash", "error_code", "owner")).alias("e"))
    jobs = one.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("at", "event_id", "e.*"))).alias("events"))
    types = dict(f.split() for f in JOB.split(", "))
    zero = F.struct(*[F.lit(v).cast(types[f]).alias(f) for f, v in start().items()])
    end = F.aggregate("events", zero, _after)
    end = end if as_of is None else let(end, lambda s: _expired(s, F.unix_micros(as_of.cast("timestamp"))))
    return jobs.select("job_id", end.alias("s")).select("job_id", "s.*")


#: What the stream puts out: jobs as they change (``what`` is job), and events that were refused (``what`` is dead).
OUTPUT = f"job_id string, what string, event_id string, type string, at bigint, {JOB}"
_EVENT = "type string, request_id string, request_hash string, error_code string, owner string"


class JobProcessor(StatefulProcessor):
    """Events wait in state until the watermark has passed them, so each job sees them in order, however they arrive. A
    timer stands at each time with a waiting event and at the end of each lease. An event that is delivered again meets
    itself in the waiting map, or is older than the watermark and is dropped by Spark."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", JOB)
        self.waiting = handle.getMapState("waiting", "at bigint, event_id string", _EVENT)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        fields = [f.split()[0] for f in _EVENT.split(", ")]
        for r in rows:
            place, value = (r["at"], r["event_id"]), tuple(r[f] for f in fields)
            if self.waiting.containsKey(place):
                null_first = lambda v: tuple((x is not None, x or "") for x in v)
                value = min(value, tuple(self.waiting.getValue(place)), key=null_first)
            self.waiting.updateValue(place, value)
            self.handle.registerTimer(-(-r["at"] // 1000))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        due = sorted(((k[0], k[1]), v) for k, v in self.waiting.iterator() if k[0] <= until)
        s = dict(zip(FIELDS, self.job.get(), strict=True)) if self.job.exists() else start()
        before, names, out = dict(s), [f.split()[0] for f in _EVENT.split(", ")], []
        for (at, event_id), value in due:
            self.waiting.removeKey((at, event_id))
            e = dict(zip(names, value, strict=True)) | {"at": at}
            s, what = step(s, e)
            if what == "refused":
                out.append(Row(job_id=key[0], what="dead", event_id=event_id, type=e["type"], at=at, **s))
        s = expire(s, until)
        if due or s != before:
            self.job.update(tuple(s[f] for f in FIELDS))
            out.append(Row(job_id=key[0], what="job", event_id=None, type=None, at=until, **s))
            if s["lease_until"] is not None:
                self.handle.registerTimer(s["lease_until"] // 1000 + 1)
        return iter(out)

    def close(self) -> None:
        pass


def run_stream(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Jobs and refused events (``OUTPUT``) from a stream of events that come up to ``delay`` late. The last row of a job is
    what ``replay`` gives as of the watermark. Needs the RocksDB state store (``ROCKSDB``)."""
    timed_ = timed(events.withWatermark("ts", delay))
    return timed_.groupBy("job_id").transformWithState(statefulProcessor=JobProcessor(), outputStructType=OUTPUT, outputMode="Update", timeMode="EventTime")


ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def deliver(jobs: DataFrame, jobs_path: str, dead_path: str, checkpoint: str, **trigger: Any) -> StreamingQuery:
    """Writes the stream's jobs and dead letters to two tables of files. Each micro-batch owns a folder by its number and
    writes it anew, so one that is run again after a failure leaves no row twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for what, path in (("job", jobs_path), ("dead", dead_path)):
            batch.filter(F.col("what") == what).drop("what").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        batch.unpersist()

    return jobs.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def latest(delivered: DataFrame) -> DataFrame:
    """The last state of each job among delivered rows."""
    last = delivered.groupBy("job_id").agg(F.max_by(F.struct(*FIELDS), F.struct("batch", "at")).alias("s"))
    return last.select("job_id", "s.*")

"""Jobs by stored events and by a stream."""

import random

import pytest
from pyspark.sql import functions as F

from lading.streaming import jobs

MINUTE = 60_000_000
T0 = 1_700_000_000_000_000


def events_frame(spark, rows):
    """Rows of (job, minutes, id, type, other fields)."""
    schema = "job_id string, at bigint, event_id string, type string, request_id string, request_hash string, error_code string, owner string"
    full = [(j, None if m is None else T0 + int(m * MINUTE), i, t, *[kw.get(c) for c in ("request_id", "request_hash", "error_code", "owner")]) for j, m, i, t, kw in rows]
    return spark.createDataFrame(full, schema).withColumn("ts", F.timestamp_micros("at")).select("job_id", "ts", "event_id", "type", "request_id", "request_hash", "error_code", "owner")


def after(*kinds, gap=1, code=None, request="r", owner="w", digest="h"):
    s = jobs.start()
    for k, kind in enumerate(kinds):
        s, _ = jobs.step(s, {"at": T0 + int(k * gap * MINUTE), "type": kind, "request_id": request, "request_hash": digest, "error_code": code, "owner": owner})
    return s


def test_job_states():
    happy = after("claim", "await_ai", "ai_started", "ai_completed", "await_import", "import_completed")
    assert happy["status"] == "SentToPricing" and happy["attempts"] == 1 and not happy["refused"]
    late = after("claim", "await_ai", "ai_started", "ai_completed", "await_import", "ai_started")
    assert late["status"] == "AwaitingPricing" and late["ignored"] == 1
    reopened = after("claim", "await_ai", "ai_failed", "ai_completed", code=jobs.AI_LEASE_LOST)
    assert reopened["status"] == "ValidatingAiResult" and reopened["error_code"] is None
    assert after("claim", "await_ai", "retry")["refused"] == 1
    for change in ({"request_id": "other"}, {"request_hash": "other"}):
        e = {"at": T0 + 9 * MINUTE, "type": "ai_completed", "request_id": "r", "request_hash": "h", "error_code": None, "owner": None} | change
        other, what = jobs.step(after("claim", "await_ai"), e)
        assert other["status"] == "AwaitingAi" and other["refused"] == 1 and what == "refused"
    assert after("claim", owner=" ")["refused"] == 1 and after("claim", "await_ai", digest="")["refused"] == 1
    assert after("claim", "review", "import_by_hand")["status"] == "AwaitingPricing" and after("claim", "review", "reset") == jobs.start()


def test_leases_and_retries():
    assert after("claim", "await_ai", gap=11)["refused"] == 1  # the lease has gone
    assert after("claim", "renew", "await_ai", gap=9)["status"] == "AwaitingAi"
    back = jobs.expire(after("claim"), T0 + 11 * MINUTE)
    assert (back["status"], back["error_code"], back["next_attempt"]) == ("Pending", jobs.LEASE_EXPIRED, T0 + 10 * MINUTE)
    assert jobs.expire(after("claim"), T0 + 10 * MINUTE)["status"] == "Extracting"
    assert after("claim", "claim", "claim", gap=11)["attempts"] == 3
    assert jobs.expire(after("claim", "claim", "claim", gap=11), T0 + 60 * MINUTE)["status"] == "Failed"
    assert after("claim", "retry", "claim", gap=0.3)["refused"] == 1  # before the delay is over
    assert after("claim", "retry", "claim", gap=0.6)["attempts"] == 2


def made(seed, n_jobs=25):
    """Events of all kinds, more often those that fit; some have no owner, request or known type."""
    r, rows = random.Random(seed), []
    kinds = [*jobs.MOVES, "unknown", None]
    path = ["claim", "await_ai", "ai_started", "ai_completed", "await_import", "import_completed"]
    for j in range(n_jobs):
        m = 0.0
        for k in range(r.randint(1, 14)):
            m += r.choice([0.2, 0.4, 1, 3, 9, 12, 30])
            kind = path[k % 6] if r.random() < 0.6 else r.choice(kinds)
            more = {"request_id": r.choice(["r", "r", "r", "s", None]), "request_hash": r.choice(["h", "h", "h", "g", " "]), "error_code": r.choice([None, "e", jobs.AI_LEASE_LOST]), "owner": r.choice(["w", "w", "v", " "])}
            rows.append((f"j{j}", m, f"e{k}", kind, more))
    return rows


def folded(rows, until=None):
    out = {}
    for j, m, i, t, kw in sorted(rows, key=lambda x: (x[1], x[2])):
        if until is not None and m > until:
            continue
        e = {"at": T0 + int(m * MINUTE), "type": t, **{c: kw.get(c) for c in ("request_id", "request_hash", "error_code", "owner")}}
        out[j] = jobs.step(out.get(j, jobs.start()), e)[0]
    return {j: s if until is None else jobs.expire(s, T0 + int(until * MINUTE)) for j, s in out.items()}


def as_dicts(df):
    return {r["job_id"]: {f: r[f] for f in jobs.FIELDS} for r in df.collect()}


@pytest.mark.parametrize("until", [None, 20.0])
def test_replay_is_the_fold_of_steps(spark, until):
    rows = made(1, 120)
    as_of = None if until is None else F.timestamp_micros(F.lit(T0 + int(until * MINUTE)))
    got = as_dicts(jobs.replay(events_frame(spark, rows + rows[:40]), as_of))
    want = folded(rows, until)
    assert got == want and len({s["status"] for s in want.values()}) > 4


def test_awkward_events(spark):
    rows = [(None, 1, "a", "claim", {"owner": "w"}), ("j", None, "b", "claim", {"owner": "w"}), ("j", 1, None, "claim", {"owner": "w"}), ("k", 1, "c", None, {})]
    assert as_dicts(jobs.replay(events_frame(spark, rows))) == {"k": jobs.start() | {"refused": 1}}
    assert as_dicts(jobs.replay(events_frame(spark, []))) == {}


def test_stream_equals_replay(spark, tmp_path):
    rows = made(2)
    end = max(m for _, m, *_ in rows)
    r = random.Random(3)
    # within the delay events come in any order, some twice, some again in a later batch
    arrival = sorted(((m + r.uniform(0, 8), k) for k, (_, m, *_) in enumerate(rows)))
    order = [rows[k] for _, k in arrival]
    order += [rows[k] for _, k in arrival[-30:]]
    again = [rows[k] for _, k in arrival[::7]]
    flush = [[("flush", end + 200 + 20 * k, "z", "claim", {"owner": "w"})] for k in range(2)]
    size = -(-len(order) // 4)
    batches = [order[k : k + size] + again[: k // size * 4] for k in range(0, len(order), size)] + flush
    for batch in batches:
        events_frame(spark, batch).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    before = {k: spark.conf.get(k, None) for k in jobs.ROCKSDB}
    for k, v in jobs.ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        source = spark.readStream.schema(jobs.EVENT).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in")
        for _ in range(2):  # a second start finds nothing new and leaves nothing twice
            jobs.deliver(jobs.run_stream(source), f"{tmp_path}/jobs", f"{tmp_path}/dead", f"{tmp_path}/cp").awaitTermination(300)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    got = as_dicts(jobs.latest(spark.read.parquet(f"{tmp_path}/jobs")))
    got.pop("flush", None)
    assert got == folded(rows, end + 200)
    dead = spark.read.parquet(f"{tmp_path}/dead").filter("job_id <> 'flush'")
    assert dead.count() == sum(s["refused"] for s in got.values()) == dead.select("job_id", "at", "event_id").distinct().count()

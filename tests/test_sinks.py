"""Units of several tables, the outbox, and rate lines."""

import datetime

import pytest
from pyspark.sql import functions as F

from lading.operators import replies
from lading.sources import sinks


def test_a_unit_is_whole_or_not_there(spark, tmp_path):
    rows = spark.range(10).withColumn("k", F.col("id") % 2)
    tables = {"records": rows, "issues": rows.filter("k = 1")}
    sinks.write_unit(tables, str(tmp_path), 1)
    broken = {"records": rows, "issues": rows.select(F.raise_error(F.lit("lost")).alias("id"))}
    with pytest.raises(Exception, match="lost"):
        sinks.write_unit(broken, str(tmp_path), 2)
    seen = lambda n: sinks.committed(spark, str(tmp_path), n).groupBy("batch").count().collect()
    assert [tuple(r) for r in seen("records")] == [(1, 10)] and [tuple(r) for r in seen("issues")] == [(1, 5)]
    for _ in range(2):  # the killed batch runs again, and once more
        sinks.write_unit(tables, str(tmp_path), 2)
    assert sorted(map(tuple, seen("records"))) == [(1, 10), (2, 10)]


def test_a_stream_of_units(spark, tmp_path):
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    split = lambda df: {"even": df.filter("id % 2 = 0"), "all": df}
    for _ in range(2):
        sinks.stream_units(stream, split, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    assert sinks.committed(spark, f"{tmp_path}/out", "all").count() == 30 and sinks.committed(spark, f"{tmp_path}/out", "even").count() == 15


def test_the_outbox(spark):
    now = F.lit(datetime.datetime(2026, 8, 1))
    rows = spark.createDataFrame([(k, None if k == 2 else f"n{k}") for k in range(6)], "k int, name string")
    box = sinks.integration_events(rows, "Rates", "integration", ["k"], ["k", "name"], "k", F.timestamp_seconds(F.lit(1000) - F.col("k")))
    again = sinks.integration_events(rows, "Rates", "integration", ["k"], ["k", "name"], "k", now)
    got = {r["correlation_id"]: r for r in box.collect()}
    assert got["2"]["payload_json"] == '{"k":2,"name":null}' and {r["event_id"] for r in again.collect()} == {r["event_id"] for r in got.values()} and len(got) == 6
    first = sinks.publishable(box, 2).collect()
    assert [r["correlation_id"] for r in first] == ["5", "4"]
    results = spark.createDataFrame([(got["5"]["event_id"], None), (got["4"]["event_id"], "x" * 5000), (got["4"]["event_id"], None), ("other", "e")], "event_id string, error string")
    box = spark.createDataFrame(box.collect(), box.schema)
    for tries in (1, 2, 3):
        box = spark.createDataFrame(sinks.after_publishing(box, results, now).collect(), box.schema)
        left = {r["correlation_id"]: r for r in box.collect()}
        assert (left["5"]["status"], left["4"]["retry_count"], left["4"]["status"]) == ("Processed", tries, "Failed" if tries == 3 else "Pending")
    assert len(left["4"]["error_message"]) == 4000 and left["1"]["status"] == "Pending" and box.columns == again.columns


def test_rate_lines(spark):
    body = '{"rows":[{"pol":"A, B","size":"40\'/40HC","freight":"1,200.50","remarks":"say \\"hi\\" "},{"pol":"A, B","size":"40HC","freight":1200.5,"remarks":"say \\"hi\\""},{"pol":"C","size":"box","validFrom":"2026-08-01"}],"warnings":["late","w2"]}'
    read = replies.read_replies(spark.createDataFrame([(1, body), (2, "none"), (3, '[{"pol":"X"}]'), (4, None)], "reply_id int, content string"))
    got = sinks.rate_lines(replies.reply_rows(read, 2026)).orderBy("reply_id", "pos").collect()
    one = [r["line"] for r in got if r["reply_id"] == 1]
    tail = ',,,,"say ""hi"" | AI warnings: late | w2"'
    assert one[0].startswith("POL,POE,POD,Equipo") and len(one) == 4
    assert one[1] == '"A, B",,,40DV,,,,,,,,,1200.5,,,,,' + tail and one[2] == one[1].replace("40DV", "40HC")
    assert one[3] == "C,,,box,,,,,,,2026-08-01,,,,,,,,,,,AI warnings: late | w2" and [r["line"] for r in got if r["reply_id"] == 3][1] == "X" + "," * 21
    assert {r["reply_id"] for r in got} == {1, 3}

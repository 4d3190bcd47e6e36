"""What leaves the engine: tables written as one unit, events in an outbox, and normalised rate lines."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.window import Window

from lading.functions.text import csv_escape
from lading.functions.values import containers, let

COMMITS = "_commits"


def write_unit(tables: Mapping[str, DataFrame], path: str, batch: int) -> None:
    """Writes each table's rows of one batch to ``path/name/batch=N``, then says in ``_commits`` that the batch is whole.

    A batch that is written again replaces its own folders, so a run that was killed and started anew leaves no row twice;
    readers see a batch once its commit is there, with all of its tables or none.
    """
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(sorted(tables),)], "tables array<string>").coalesce(1).write.mode("overwrite").parquet(f"{path}/{COMMITS}/batch={batch}")


def committed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of a table in batches that are whole."""
    whole = spark.read.parquet(f"{path}/{COMMITS}").filter(F.array_contains("tables", name)).select("batch")
    return spark.read.parquet(f"{path}/{name}").join(whole, "batch", "left_semi")


def stream_units(stream: DataFrame, split: Callable[[DataFrame], Mapping[str, DataFrame]], path: str, checkpoint: str, **trigger: Any) -> StreamingQuery:
    """Each micro-batch of a stream as one unit of several tables, numbered by the micro-batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        write_unit(split(batch), path, number)
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def integration_events(rows: DataFrame, name: str, kind: str, key: list[str], payload: list[str], correlation: str | None, created_at: Column, source: str = "lading") -> DataFrame:
    """A pending outbox row for each of ``rows``, with ``payload`` as JSON. The id follows from name and key, so an event that
    is made again has the id it had."""
    digest = F.sha2(F.to_json(F.struct(F.lit(name).alias("name"), *key), {"ignoreNullFields": "false"}), 256)
    event_id = F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12}).*$", "$1-$2-$3-$4-$5")
    return rows.select(
        event_id.alias("event_id"), F.lit(kind).alias("event_type"), F.lit(name).alias("event_name"), F.lit(source).alias("source"),
        F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}).alias("payload_json"), (F.col(correlation).cast("string") if correlation else F.lit(None).cast("string")).alias("correlation_id"),
        F.lit("Pending").alias("status"), F.lit(0).alias("retry_count"), F.lit(None).cast("string").alias("error_message"), created_at.alias("created_at"), F.lit(None).cast("timestamp").alias("processed_at"),
    )


def publishable(outbox: DataFrame, count: int) -> DataFrame:
    """The ``count`` oldest pending events; Spark takes them by a top-k per partition."""
    return outbox.filter("status = 'Pending'").orderBy("created_at", "event_id").limit(count)


def after_publishing(outbox: DataFrame, results: DataFrame, now: Column, most_attempts: int = 3, most_error: int = 4000) -> DataFrame:
    """``outbox`` after a round of publishing: ``results(event_id, error)`` has a null error where an event went out.

    Those are processed now; the others count an attempt and fail at ``most_attempts``. Events without a result, and those
    that are no longer pending, stay as they are; of several results an error counts.
    """
    one = results.groupBy(F.col("event_id").alias("r_id")).agg(F.max("error").alias("r_error"))
    j = outbox.join(one, F.col("event_id") == F.col("r_id"), "left")
    tried = F.col("r_id").isNotNull() & (F.col("status") == "Pending")
    sent, failed = tried & F.col("r_error").isNull(), tried & F.col("r_error").isNotNull()
    count = F.col("retry_count") + F.when(failed, 1).otherwise(0)
    changed = {
        "status": F.when(sent, "Processed").when(failed & (count >= most_attempts), "Failed").otherwise(F.col("status")),
        "retry_count": count,
        "error_message": F.when(failed, F.left("r_error", F.lit(most_error))).when(~sent, F.col("error_message")),
        "processed_at": F.when(sent, now).otherwise(F.col("processed_at")),
    }
    return j.select(*[changed.get(c, F.col(c)).alias(c) for c in outbox.columns])


# The columns of a normalised rate file, and the field that each holds.
RATE_COLUMNS = {
    "POL": "origin_port", "POE": "port_of_exit", "POD": "destination_port", "Equipo": "container", "Naviera": "carrier", "Agente": "agent", "Commodity": "commodity", "Moneda": "currency",
    "Dias Libres": "free_days", "Dias Transito": "transit_days", "Valid From": "valid_from", "Valid To": "valid_to", "Ocean Freight": "ocean_freight", "Origin Charges": "origin_charges",
    "Destination Charges": "destination_charges", "Surcharges": "surcharges", "Total Cost": "total_cost", "Total Sale": "total_sale", "Profit": "profit", "Margin": "margin", "Space": "space_comment", "Remarks": "remarks",
}


def _written(c: Column, kind: str) -> Column:
    if kind.startswith("decimal"):
        return F.regexp_replace(F.regexp_replace(c.cast("decimal(18,4)").cast("string"), "0+$", ""), "[.]$", "")
    return F.date_format(c, "yyyy-MM-dd") if kind in ("date", "timestamp") else c.cast("string")


def rate_lines(rows: DataFrame) -> DataFrame:
    """``reply_id, pos, line``: the rates of each reply (``replies.reply_rows``) as lines of a file with 22 columns, its head
    at 0. A cell that names several containers gives a line for each; equal lines of a reply are written once, where they
    come first. The reply's warnings close each line's remarks. Replies without rates have no file."""
    kinds = containers(F.col("container_type"))
    told = F.when(F.size("warnings") > 0, F.concat(F.lit("AI warnings: "), F.array_join("warnings", " | ")))
    # exploded as an expression: a bare column would be worked out once more to see whether it is empty
    named = let(kinds, lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(F.coalesce(F.trim("container_type"), F.lit("")))))
    each = rows.select("*", F.posexplode(named).alias("k", "container")).withColumn("remarks", F.concat_ws(" | ", F.when(F.trim("remarks") != "", F.trim("remarks")), told))
    types = dict(each.dtypes)
    line = F.concat_ws(",", *[F.coalesce(csv_escape(_written(F.col(c), types[c])), F.lit("")) for c in RATE_COLUMNS.values()])
    lines = each.select("reply_id", line.alias("line"), F.struct("row_number", "k").alias("at")).groupBy("reply_id", "line").agg(F.min("at").alias("at"))
    numbered = lines.select("reply_id", F.row_number().over(Window.partitionBy("reply_id").orderBy("at")).alias("pos"), "line")
    own, head = F.struct("pos", "line"), F.struct(F.lit(0).alias("pos"), F.lit(",".join(RATE_COLUMNS)).alias("line"))
    headed = numbered.select("reply_id", F.explode(F.when(F.col("pos") == 1, F.array(head, own)).otherwise(F.array(own))).alias("l"))
    return headed.select("reply_id", "l.pos", "l.line")

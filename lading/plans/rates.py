"""Rate sheets made from the star schema: the same SQL text runs in Spark and elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lading.functions.values import carrier, currency, money
from lading.operators.records import issue_codes, margin, status
from lading.operators.sheets import explode_containers, explode_routes

AS_OF = "2001-06-30"
#: ``{tables}`` are filled with DataFrames in Spark; elsewhere the braces go.
RAW_RATES = """
SELECT order_key, line_no, part_key, pol, poe, pod, carrier, container, valid_from, valid_to, cents, k,
  CASE k WHEN 0 THEN '$' || d || '.' || c WHEN 1 THEN 'USD ' || t || '.' || c WHEN 2 THEN 'EUR ' || replace(t, ',', '.') || ',' || c
         WHEN 3 THEN '(' || d || '.' || c || ')' WHEN 4 THEN '-' ELSE 'RMB ' || d || ',' || c END AS amount,
  cost_cents
FROM (
  SELECT l.l_orderkey AS order_key, l.l_linenumber AS line_no, l.l_partkey AS part_key, l.l_orderkey % 6 AS k,
    CASE WHEN l.l_orderkey % 7 = 0 THEN ns.n_name || '/' || nc.n_name ELSE ns.n_name END AS pol,
    CASE WHEN l.l_orderkey % 11 = 0 THEN '' ELSE nc.n_name END AS poe,
    CASE WHEN l.l_orderkey % 13 = 0 THEN nc.n_name END AS pod,
    s.s_name || CASE WHEN l.l_linenumber % 3 = 0 THEN ' FAK' WHEN l.l_linenumber % 3 = 1 THEN ' SPOT' ELSE '' END AS carrier,
    CASE WHEN l.l_quantity < 13 THEN '20 DV' WHEN l.l_quantity < 26 THEN '40''/40HC' WHEN l.l_quantity < 39 THEN '40HQ' ELSE '45HC' END AS container,
    CAST(o.o_orderdate AS DATE) AS valid_from, CAST(l.l_shipdate AS DATE) AS valid_to,
    CAST(round(l.l_extendedprice * 100) AS BIGINT) AS cents,
    CAST(round(l.l_extendedprice * (1 - l.l_discount) * (1 + l.l_tax) * 95) AS BIGINT) AS cost_cents,
    CAST(CAST(floor(round(l.l_extendedprice * 100) / 100) AS BIGINT) AS STRING) AS d,
    CASE WHEN l.l_extendedprice >= 1000 THEN CAST(CAST(floor(round(l.l_extendedprice * 100) / 100000) AS BIGINT) AS STRING) || ',' || lpad(CAST(CAST(floor(round(l.l_extendedprice * 100) / 100) AS BIGINT) % 1000 AS STRING), 3, '0')
         ELSE CAST(CAST(floor(round(l.l_extendedprice * 100) / 100) AS BIGINT) AS STRING) END AS t,
    lpad(CAST(CAST(round(l.l_extendedprice * 100) AS BIGINT) % 100 AS STRING), 2, '0') AS c
  FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
    JOIN {nation} ns ON s.s_nationkey = ns.n_nationkey JOIN {customer} cu ON o.o_custkey = cu.c_custkey JOIN {nation} nc ON cu.c_nationkey = nc.n_nationkey
)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with unread cells, dealt out by row: reading cells costs far more than moving rows, and a table may come in few
    row groups, each of which is one task."""
    names = ("lineitem", "orders", "supplier", "nation", "customer")
    return spark.sql(RAW_RATES, **{n: table(spark, sf_dir, n) for n in names}).repartition("order_key", "line_no")


def raw_sql() -> str:
    return RAW_RATES.replace("{", "").replace("}", "")


def typed_records(raw: DataFrame) -> DataFrame:
    """Rate rows as typed records, a row per container kind and route.

    Cells are read before rows multiply: what follows an explode names the read value, so no cell is parsed twice.
    """
    read = raw.withColumn("ocean_freight", money(F.col("amount"))).withColumn("currency", currency(F.col("amount"))).withColumn("carrier", carrier(F.col("carrier")))
    rows = explode_routes(explode_containers(read, "container"))
    rows = rows.withColumn("total_cost", (F.col("cost_cents") / 100).cast("decimal(18,4)"))
    rows = rows.withColumn("total_sale", F.col("ocean_freight")).withColumn("margin", margin(F.col("total_sale"), F.col("total_cost")))
    return rows.select(
        "order_key", "line_no", "part_key", F.col("pol").alias("origin_port"), F.col("poe").alias("port_of_exit"), F.col("pod").alias("destination_port"), F.col("container").alias("container_type"),
        "carrier", F.lit(None).cast("string").alias("agent"), "currency", "valid_from", "valid_to",
        "ocean_freight", "total_cost", "total_sale", (F.col("total_sale") - F.col("total_cost")).alias("profit"), "margin",
    )


def checked_records(raw: DataFrame, as_of: str = AS_OF) -> DataFrame:
    records = typed_records(raw).withColumn("issues", issue_codes(F.lit(as_of).cast("date")))
    return records.withColumn("status", status(F.col("issues")))

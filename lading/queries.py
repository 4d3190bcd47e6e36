"""Queries over the star schema and text tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lading.functions import text as tx
from lading.functions.values import carrier, containers, currency, money
from lading.operators import resolution, sheets
from lading.operators.records import sum_known, summary
from lading.plans.rates import AS_OF, checked_records, raw_rates, raw_sql, table, typed_records
from lading.streaming import jobs

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Records as typed_records() makes them, in SQL that knows how the amounts were written.
RAW = f"WITH raw AS ({raw_sql()})"
RECORDS = f"""{RAW}, kinds AS (SELECT *, unnest(CASE container WHEN '20 DV' THEN ['20DV'] WHEN '40HQ' THEN ['40HC'] WHEN '45HC' THEN ['45HC'] ELSE ['40DV', '40HC'] END) AS kind FROM raw),
rec AS (SELECT order_key, line_no, part_key, unnest(string_split(pol, '/')) AS origin_port, nullif(poe, '') AS port_of_exit, pod AS destination_port, kind AS container_type,
  upper(regexp_replace(carrier, ' (FAK|SPOT)$', '')) AS carrier, CASE k WHEN 2 THEN 'EUR' WHEN 5 THEN 'CNY' WHEN 4 THEN NULL WHEN 3 THEN NULL ELSE 'USD' END AS currency, valid_from, valid_to,
  CAST(CASE k WHEN 4 THEN NULL WHEN 3 THEN -cents ELSE cents END AS DECIMAL(18,2)) / 100 AS sale, CAST(cost_cents AS DECIMAL(18,2)) / 100 AS cost FROM kinds),
iss AS (SELECT *, list_filter([CASE WHEN port_of_exit IS NULL THEN 'missing_port_of_exit' END, CASE WHEN destination_port IS NULL THEN 'missing_destination_port' END, 'missing_agent',
  CASE WHEN currency IS NULL THEN 'missing_currency' END, CASE WHEN valid_to < valid_from THEN 'invalid_validity_range' END, CASE WHEN port_of_exit = destination_port THEN 'same_poe_and_pod' END,
  CASE WHEN valid_to < DATE '{AS_OF}' THEN 'expired_rate' END, CASE WHEN sale <> 0 AND (sale - cost) / sale * 100 < -0.00005 THEN 'negative_margin' END], lambda x: x IS NOT NULL) AS issues FROM rec),
st AS (SELECT *, CASE WHEN port_of_exit IS NULL OR currency IS NULL OR valid_to < valid_from THEN 'Invalid' ELSE 'RequiresReview' END AS status FROM iss)"""


@query(f"{RECORDS} SELECT order_key, line_no, origin_port, port_of_exit, destination_port, container_type, carrier, currency, valid_from, valid_to, CAST(sale AS DOUBLE) AS ocean_freight FROM rec")
def typed_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = typed_records(raw_rates(spark, sf_dir))
    return r.select("order_key", "line_no", "origin_port", "port_of_exit", "destination_port", "container_type", "carrier", "currency", "valid_from", "valid_to", F.col("ocean_freight").cast("double").alias("ocean_freight"))


@query(f"{RAW} SELECT order_key, line_no, amount, CAST(CASE k WHEN 4 THEN NULL WHEN 3 THEN -cents ELSE cents END AS DOUBLE) / 100 AS value FROM raw")
def money_parse(spark, sf_dir):
    return raw_rates(spark, sf_dir).select("order_key", "line_no", "amount", money(F.col("amount")).cast("double").alias("value"))


@query(f"{RAW} SELECT CASE k WHEN 0 THEN 'USD' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' WHEN 5 THEN 'CNY' END AS currency, count(*) AS n FROM raw GROUP BY 1")
def currency_counts(spark, sf_dir):
    return raw_rates(spark, sf_dir).groupBy(currency(F.col("amount")).alias("currency")).agg(F.count("*").alias("n"))


@query(f"{RAW} SELECT upper(regexp_replace(carrier, ' (FAK|SPOT)$', '')) AS carrier, count(*) AS n, sum(cents) AS cents FROM raw GROUP BY 1")
def carrier_totals(spark, sf_dir):
    return raw_rates(spark, sf_dir).groupBy(carrier(F.col("carrier")).alias("carrier")).agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query(f"{RAW} SELECT kind, count(*) AS n FROM (SELECT unnest(CASE container WHEN '20 DV' THEN ['20DV'] WHEN '40HQ' THEN ['40HC'] WHEN '45HC' THEN ['45HC'] ELSE ['40DV', '40HC'] END) AS kind FROM raw) GROUP BY kind")
def container_kinds(spark, sf_dir):
    return raw_rates(spark, sf_dir).select(F.explode(containers(F.col("container"))).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"{RAW} SELECT pol, nullif(poe, '') AS poe, count(*) AS n FROM (SELECT unnest(string_split(pol, '/')) AS pol, poe FROM raw) GROUP BY 1, 2")
def lanes(spark, sf_dir):
    return sheets.explode_routes(raw_rates(spark, sf_dir).select("pol", "poe"), ("pol", "poe")).groupBy("pol", "poe").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT l_orderkey AS order_key, CASE WHEN l_quantity < 17 THEN '20DV' WHEN l_quantity < 34 THEN '40DV' ELSE '40HC' END AS heading, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem)
SELECT heading, count(*) AS n, CAST(sum(c) AS DOUBLE) / 100 AS freight FROM (SELECT order_key, heading, sum(c) AS c FROM m GROUP BY 1, 2) GROUP BY heading""")
def unpivot_matrix(spark, sf_dir):
    q = F.col("l_quantity")
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_key"), F.when(q < 17, "20DV").when(q < 34, "40DV").otherwise("40HC").alias("h"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("c"))
    wide = cells.groupBy("order_key").pivot("h", ["20DV", "40DV", "40HC"]).agg((F.sum("c") / 100).cast("decimal(18,2)").cast("string"))
    long = sheets.unpivot_containers(wide, ["20DV", "40DV", "40HC"], ["order_key"])
    return long.groupBy("heading").agg(F.count("*").alias("n"), F.sum("freight").cast("double").alias("freight"))


@query("SELECT o_orderkey AS order_key, o_orderpriority AS currency, CAST(o_custkey AS VARCHAR) AS carrier, o_orderstatus AS origin FROM orders")
def mapped_cells(spark, sf_dir):
    """Headers in two languages, one of them twice and one unknown, mapped to fields."""
    orders = table(spark, sf_dir, "orders")
    cell = lambda h, v: F.struct(F.lit(h).alias("header"), v.alias("value"))
    heads = F.array(cell("Moneda", F.lit("old")), cell("CURRENCY ", F.col("o_orderpriority")), cell("Línea", F.col("o_custkey").cast("string")), cell("Port of Loading", F.col("o_orderstatus")), cell("Unknown", F.lit("x")))
    cells = orders.select(F.col("o_orderkey").alias("order_key"), F.posexplode(heads).alias("pos", "c")).select("order_key", "pos", "c.header", "c.value")
    rows = sheets.cells_to_rows(cells, sheets.default_mappings(spark), ["order_key"])
    return rows.select("order_key", F.col("fields.Currency").alias("currency"), F.col("fields.Carrier").alias("carrier"), F.col("fields.OriginPort").alias("origin"))


@query("SELECT p_partkey, regexp_replace(lower(p_brand || ' ' || p_type), '[^a-z0-9]', '', 'g') AS key FROM part")
def header_keys(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.header_key(F.concat_ws(" ", "p_brand", "p_type")).alias("key"))


@query(f"{RECORDS} SELECT code, count(*) AS n FROM (SELECT unnest(issues) AS code FROM iss) GROUP BY code")
def issue_counts(spark, sf_dir):
    return checked_records(raw_rates(spark, sf_dir)).select(F.explode(F.array_compact("issues")).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query(f"{RECORDS} SELECT carrier, count(*) AS total, CAST(0 AS BIGINT) AS valid, CAST(count(*) FILTER (status = 'RequiresReview') AS BIGINT) AS warning, CAST(count(*) FILTER (status = 'Invalid') AS BIGINT) AS invalid, true AS has_issues, 'CompletedWithIssues' AS state FROM st GROUP BY carrier")
def carrier_summary(spark, sf_dir):
    return summary(checked_records(raw_rates(spark, sf_dir)), ["carrier"])


@query(f"{RECORDS} SELECT origin_port, container_type, count(*) AS n, CAST(sum(sale - cost) AS DECIMAL(18,2))::DOUBLE AS profit, CAST(count(*) FILTER (list_contains(issues, 'negative_margin')) AS BIGINT) AS losses FROM iss GROUP BY 1, 2")
def lane_profit(spark, sf_dir):
    r = checked_records(raw_rates(spark, sf_dir))
    return r.groupBy("origin_port", "container_type").agg(F.count("*").alias("n"), F.sum("profit").cast("decimal(18,2)").cast("double").alias("profit"), F.count_if(F.array_contains("issues", "negative_margin")).alias("losses"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS a, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 1.5 WHEN c_custkey % 2 = 0 THEN c_acctbal ELSE c_acctbal + 1.5 END AS total FROM customer")
def null_skipping_sum(spark, sf_dir):
    a = F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal"))
    b = F.when(F.col("c_custkey") % 2 != 0, F.lit(1.5))
    return table(spark, sf_dir, "customer").select("c_custkey", a.alias("a"), sum_known(a, b).alias("total"))


CATALOG = "WITH c AS (SELECT min(p_partkey) AS item_id, p_name AS name FROM part GROUP BY p_name)"


def _catalog(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("item_id")).select("item_id", "name", F.lit(None).cast("string").alias("code"), F.lit(None).cast("array<string>").alias("aliases"))


@query(f"{CATALOG} SELECT upper(name) || '.' AS value, item_id, CAST(1 AS BIGINT) AS hits FROM c")
def catalog_strict(spark, sf_dir):
    catalog = _catalog(spark, sf_dir)
    values = catalog.select(F.concat(F.upper("name"), F.lit(".")).alias("value"))
    return resolution.strict(values, resolution.catalog_keys(catalog))


@query(f"""{CATALOG}, v AS (SELECT DISTINCT substr(name, 1, len(name) - 2) AS value FROM c), k AS (SELECT item_id, regexp_replace(upper(name), '[^A-Z0-9]', '', 'g') AS key FROM c),
p AS (SELECT value, item_id, len(key) - len(regexp_replace(upper(value), '[^A-Z0-9]', '', 'g')) AS far FROM v, k WHERE len(regexp_replace(upper(value), '[^A-Z0-9]', '', 'g')) >= 4 AND contains(key, regexp_replace(upper(value), '[^A-Z0-9]', '', 'g'))),
b AS (SELECT *, rank() OVER (PARTITION BY value ORDER BY far) AS place, count(*) OVER (PARTITION BY value, far) AS ties FROM p)
SELECT value, item_id, CAST(far AS INTEGER) AS far FROM b WHERE place = 1 AND ties = 1""")
def catalog_contained(spark, sf_dir):
    catalog = _catalog(spark, sf_dir)
    values = catalog.select(F.expr("substr(name, 1, length(name) - 2)").alias("value")).distinct()
    return resolution.contained(values, resolution.catalog_keys(catalog))


@query()
def catalog_tiers(spark, sf_dir):
    catalog = _catalog(spark, sf_dir)
    values = catalog.select(F.explode(F.array(F.upper("name"), F.expr("substr(name, 2)"), F.expr("concat(substr(name, 1, 3), substr(name, 5))"))).alias("value")).distinct()
    return resolution.resolve(values, catalog, "port")


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")
def jobs_by_status(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))


@query("""SELECT CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS failed, CAST(count(*) FILTER (event_type = 'click') AS BIGINT) AS pending,
CAST(count(DISTINCT CASE WHEN event_type = 'error' THEN user_id END) AS BIGINT) AS affected, count(*) FILTER (event_type = 'click') > 100 AS degraded FROM events""")
def health(spark, sf_dir):
    e = F.col("event_type")
    return table(spark, sf_dir, "events").agg(F.count_if(e == "error").alias("failed"), F.count_if(e == "click").alias("pending"), F.count_distinct(F.when(e == "error", F.col("user_id"))).alias("affected"), (F.count_if(e == "click") > 100).alias("degraded"))


@query("""SELECT user_id, CASE WHEN bool_or(event_type = 'error') THEN 'Failed' WHEN bool_and(event_type IN ('click', 'view')) THEN 'Extracted' ELSE 'Processing' END AS status,
arg_min(event_id, CASE WHEN event_type = 'error' THEN ts END) FILTER (event_type = 'error') AS first_error FROM events GROUP BY user_id""")
def message_rollup(spark, sf_dir):
    e = F.col("event_type")
    state = F.when(F.bool_or(e == "error"), "Failed").when(F.bool_and(e.isin("click", "view")), "Extracted").otherwise("Processing")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(state.alias("status"), F.min_by("event_id", F.when(e == "error", F.col("ts"))).alias("first_error"))


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def messages_without_jobs(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def jobs_with_sent_sibling(spark, sf_dir):
    sent = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    return table(spark, sf_dir, "orders").join(sent, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("SELECT o_orderpriority AS priority, n_name AS nation, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def jobs_by_account(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy(F.col("o_orderpriority").alias("priority"), F.col("n_name").alias("nation")).agg(F.count("*").alias("n"))


@query("SELECT p_brand, p_partkey, p_name, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 12")
def topk_hints(spark, sf_dir):
    order = Window.partitionBy("p_brand").orderBy(F.col("p_retailprice").desc(), "p_partkey")
    return table(spark, sf_dir, "part").withColumn("r", F.row_number().over(order)).filter("r <= 12").select("p_brand", "p_partkey", "p_name", "p_retailprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 200")
def order_page(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").offset(200).limit(100).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_orderstatus, (SELECT count(*) FROM orders) > 2000 AS is_truncated FROM orders ORDER BY o_orderkey LIMIT 2000")
def row_budget(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    total = orders.agg((F.count("*") > 2000).alias("is_truncated"))
    return orders.orderBy("o_orderkey").limit(2000).join(F.broadcast(total)).select("o_orderkey", "o_orderstatus", "is_truncated")


@query("SELECT p_brand, p_partkey, CASE WHEN n > 1 THEN p_name || '_' || CAST(n AS VARCHAR) ELSE p_name END AS header FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, lower(p_name) ORDER BY p_partkey) AS n FROM part)")
def header_numbers(spark, sf_dir):
    heads = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("pos"), F.col("p_name").alias("header"))
    return sheets.number_headers(heads, ["p_brand"]).select("p_brand", F.col("pos").alias("p_partkey"), "header")


@query("""WITH s AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM conversations)
SELECT conv_id, CAST(section AS BIGINT) AS section, count(*) AS turns, CAST(sum(len(text)) AS BIGINT) AS chars FROM s GROUP BY 1, 2""")
def thread_sections(spark, sf_dir):
    running = Window.partitionBy("conv_id").orderBy("turn")
    s = table(spark, sf_dir, "conversations").withColumn("section", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(running))
    return s.groupBy("conv_id", "section").agg(F.count("*").alias("turns"), F.sum(F.length("text").cast("long")).alias("chars"))


@query("""SELECT conv_id, CAST(max(score) AS BIGINT) AS best, arg_min(turn, CASE WHEN score >= 20 THEN turn END) FILTER (score >= 20) AS first_strong FROM (
SELECT conv_id, turn, 5 * least(12, len(regexp_extract_all(text, '[A-Z][a-z]+'))) + CASE WHEN contains(text, ',') THEN 10 ELSE 0 END AS score FROM conversations) GROUP BY conv_id""")
def thread_scores(spark, sf_dir):
    score = 5 * F.least(F.lit(12), F.regexp_count("text", F.lit("[A-Z][a-z]+"))) + F.when(F.contains("text", F.lit(",")), 10).otherwise(0)
    s = table(spark, sf_dir, "conversations").withColumn("score", score)
    return s.groupBy("conv_id").agg(F.max("score").cast("long").alias("best"), F.min_by("turn", F.when(F.col("score") >= 20, F.col("turn"))).alias("first_strong"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(h, '(?i)<(br|/p|/tr|/div|/li|/h[1-6])[^>]*>', chr(10), 'g'), '(?i)</t[dh]>', chr(9), 'g'), '(?s)<[^>]*>', ' ', 'g') AS h FROM a)
SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), ' {2,}', ' ', 'g') AS body FROM b""")
def html_bodies(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.html_text(F.col("html")).alias("body"))


@query("SELECT doc_id, CASE WHEN len(text) <= 400 THEN text ELSE substr(text, 1, 300) || chr(10) || '...' || chr(10) || right(text, 100) END AS body FROM documents")
def head_tail_cut(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.head_tail(F.col("text"), 400).alias("body"))


@query("SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1")
def text_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' OR ends_with(c_name, '7') OR lower(c_name) = 'customer#000000012'")
def allow_list(spark, sf_dir):
    n = F.lower("c_name")
    return table(spark, sf_dir, "customer").filter((F.col("c_mktsegment") == "BUILDING") | n.endswith("7") | (n == "customer#000000012")).select("c_custkey", "c_name")


@query("""WITH t AS (SELECT p_partkey, list_distinct(list_filter(string_split(upper(p_name), ' '), lambda x: len(x) >= 2)) AS a, list_distinct(list_filter(string_split(upper(p_name || ' ' || p_type), ' '), lambda x: len(x) >= 2)) AS b FROM part)
SELECT p_partkey, CAST(len(list_intersect(a, b)) AS INTEGER) AS same, CAST(len(b) - len(list_intersect(a, b)) AS INTEGER) AS rest, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS jaccard FROM t""")
def token_overlap(spark, sf_dir):
    a, b = tx.tokens(F.col("p_name")), tx.tokens(F.concat_ws(" ", "p_name", "p_type"))
    same = F.size(F.array_intersect(a, b))
    return table(spark, sf_dir, "part").select("p_partkey", same.alias("same"), F.size(F.array_except(b, a)).alias("rest"), (same / F.size(F.array_union(a, b))).alias("jaccard"))


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def json_alias(spark, sf_dir):
    value = F.coalesce(F.get_json_object("props", "$.key"), F.get_json_object("props", "$.k")).try_cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(value).alias("k"))


@query("SELECT user_id, event_type, arg_min(event_id, ts) AS event_id, min(ts) AS ts FROM events GROUP BY 1, 2")
def idempotent_ingest(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min_by("event_id", "ts").alias("event_id"), F.min("ts").alias("ts"))


@query("SELECT user_id, count(*) AS stale FROM events WHERE event_type = 'view' AND ts + INTERVAL 10 MINUTE < TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1")
def stale_leases(spark, sf_dir):
    ends = F.col("ts") + F.expr("interval 10 minutes")
    return table(spark, sf_dir, "events").filter((F.col("event_type") == "view") & (ends < F.lit("2024-01-15 00:00:00").cast("timestamp"))).groupBy("user_id").agg(F.count("*").alias("stale"))


@query("""SELECT DISTINCT CASE WHEN regexp_matches(p_name || ',' || p_brand, '[",\n\r]') THEN '"' || replace(p_name || ',' || p_brand, '"', '""') || '"' ELSE p_name || ',' || p_brand END || ',' || CAST(CAST(p_retailprice AS DECIMAL(18,4)) AS VARCHAR) AS line FROM part""")
def csv_lines(spark, sf_dir):
    first = tx.csv_escape(F.concat_ws(",", "p_name", "p_brand"))
    return table(spark, sf_dir, "part").select(F.concat_ws(",", first, F.col("p_retailprice").cast("decimal(18,4)").cast("string")).alias("line")).distinct()


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey DESC, l_suppkey DESC) = 1")
def best_offer(spark, sf_dir):
    best = F.max(F.struct("l_extendedprice", "l_partkey", "l_suppkey")).alias("b")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(best).select("l_orderkey", "b.l_partkey", "b.l_suppkey", "b.l_extendedprice")


@query("""SELECT doc_id, CAST(h1 + h2 + h3 AS INTEGER) AS hits, CASE WHEN h1 + h2 + h3 >= 2 THEN 'rates' WHEN h1 + h2 + h3 = 1 THEN 'review' ELSE 'ignored' END AS class FROM (
SELECT doc_id, CAST(regexp_matches(text, '(?i)(^|[^a-z])the([^a-z]|$)') AS INTEGER) AS h1, CAST(regexp_matches(text, '(?i)(^|[^a-z])und([^a-z]|$)') AS INTEGER) AS h2, CAST(regexp_matches(text, '[0-9]{3}') AS INTEGER) AS h3 FROM documents)""")
def keyword_classes(spark, sf_dir):
    hit = lambda p: F.col("text").rlike(p).cast("int")
    hits = hit("(?i)(^|[^a-z])the([^a-z]|$)") + hit("(?i)(^|[^a-z])und([^a-z]|$)") + hit("[0-9]{3}")
    d = table(spark, sf_dir, "documents").select("doc_id", hits.alias("hits"))
    return d.withColumn("class", F.when(F.col("hits") >= 2, "rates").when(F.col("hits") == 1, "review").otherwise("ignored"))


@query("SELECT s_suppkey, upper(left(s_name, 1)) || 'A' AS short, n_name FROM (SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)")
def acronyms(spark, sf_dir):
    named = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return named.select("s_suppkey", tx.acronym(F.concat(F.regexp_replace("s_name", "#.*", ""), F.lit(" agency"))).alias("short"), "n_name")


@query("SELECT p_partkey, i, carrier, amount FROM (SELECT p_partkey, unnest(range(0, len(cs))) AS i, cs, am FROM (SELECT p_partkey, string_split(p_name, ' ') AS cs, [p_size] AS am FROM part)) , LATERAL (SELECT cs[i + 1] AS carrier, am[least(i + 1, len(am))] AS amount)")
def paired_amounts(spark, sf_dir):
    """The last amount repeats where there are more carriers than amounts."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("cs"), F.array("p_size").alias("am"))
    return p.select("p_partkey", F.posexplode("cs").alias("i", "carrier"), "am").select("p_partkey", F.col("i").cast("long").alias("i"), "carrier", F.get("am", F.least(F.col("i"), F.size("am") - 1)).alias("amount"))


@query("SELECT c_custkey AS id, c_name AS name, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier")
def bag_union(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("customer").alias("kind"))
    return a.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("kind")))


@query("SELECT o_orderkey, 'Re: ' || o_orderpriority || ' // ' || o_orderstatus AS raw, o_orderpriority || ' | ' || o_orderstatus AS subject FROM orders")
def subjects(spark, sf_dir):
    raw = F.concat(F.lit("Re: "), F.col("o_orderpriority"), F.lit(" // "), F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"), tx.subject(raw).alias("subject"))


def job_events(spark, sf_dir) -> DataFrame:
    """The events table as events of jobs: one job per user and day."""
    kinds = F.create_map(*[F.lit(x) for pair in (("click", "claim"), ("view", "await_ai"), ("purchase", "ai_completed"), ("signup", "await_import"), ("error", "retry")) for x in pair])
    e = table(spark, sf_dir, "events")
    kind = F.coalesce(F.try_element_at(kinds, F.col("event_type")), F.lit("review"))
    job = F.concat_ws("-", "user_id", F.to_date("ts").cast("string"))
    request = F.when(F.col("event_id") % 5 > 0, "r1").otherwise("r2")
    return e.select(job.alias("job_id"), "ts", F.col("event_id").cast("string").alias("event_id"), kind.alias("type"), request.alias("request_id"), F.lit("h1").alias("request_hash"), F.lit(None).cast("string").alias("error_code"), F.lit("w1").alias("owner"))


@query("""WITH RECURSIVE e AS (
  SELECT CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS job_id, epoch_us(ts) AS us, CASE WHEN event_id % 5 > 0 THEN 'r1' ELSE 'r2' END AS request,
    CASE event_type WHEN 'click' THEN 'claim' WHEN 'view' THEN 'await_ai' WHEN 'purchase' THEN 'ai_completed' WHEN 'signup' THEN 'await_import' WHEN 'error' THEN 'retry' ELSE 'review' END AS kind,
    row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, CAST(event_id AS VARCHAR)) AS n FROM events),
s AS (
  SELECT DISTINCT job_id, 0::BIGINT AS n, 'Pending' AS status, 0 AS attempts, NULL::VARCHAR AS request_id, NULL::VARCHAR AS error_code, NULL::BIGINT AS lease, NULL::BIGINT AS wait, 0 AS refused, 0 AS ignored FROM e
  UNION ALL
  SELECT job_id, n, CASE WHEN did <> 'moved' THEN status WHEN kind = 'retry' AND attempts >= 3 THEN 'Failed' ELSE target END, attempts + (did = 'moved' AND kind = 'claim')::INT,
    CASE WHEN did = 'moved' AND kind = 'await_ai' THEN request ELSE request_id END, CASE WHEN did = 'moved' THEN NULL ELSE error_code END,
    CASE WHEN did <> 'moved' THEN lease WHEN kind = 'claim' THEN us + 600000000 END, CASE WHEN did <> 'moved' THEN wait WHEN kind = 'retry' AND attempts < 3 THEN us + 30000000 END,
    refused + (did = 'refused')::INT, ignored + (did = 'ignored')::INT
  FROM (
    SELECT *, CASE WHEN kind = 'ai_completed' AND (request_id IS NULL OR request_id <> request) THEN 'refused'
        WHEN kind = 'ai_completed' AND status IN ('AwaitingPricing', 'SentToPricing', 'NeedsReview') THEN 'ignored'
        WHEN kind = 'claim' AND status = 'Pending' AND (wait IS NULL OR wait <= us) THEN 'moved'
        WHEN kind = 'await_ai' AND status = 'Extracting' OR kind = 'ai_completed' AND status IN ('AwaitingAi', 'ValidatingAiResult') OR kind = 'await_import' AND status IN ('ValidatingAiResult', 'Extracting')
          OR kind = 'retry' AND status = 'Extracting' OR kind = 'review' AND status IN ('Pending', 'Extracting', 'AwaitingAi', 'ValidatingAiResult', 'AwaitingPricing') THEN 'moved' ELSE 'refused' END AS did,
      CASE kind WHEN 'claim' THEN 'Extracting' WHEN 'await_ai' THEN 'AwaitingAi' WHEN 'ai_completed' THEN 'ValidatingAiResult' WHEN 'await_import' THEN 'AwaitingPricing' WHEN 'retry' THEN 'Pending' ELSE 'NeedsReview' END AS target
    FROM (
      SELECT e.job_id, e.n, e.us, e.kind, e.request, s.request_id, s.attempts, s.refused, s.ignored, gone,
        CASE WHEN NOT gone THEN s.status WHEN s.attempts >= 3 THEN 'Failed' ELSE 'Pending' END AS status, CASE WHEN gone THEN 'DataExtraction.ExtractionLeaseExpired' ELSE s.error_code END AS error_code,
        CASE WHEN NOT gone THEN s.lease END AS lease, CASE WHEN NOT gone THEN s.wait WHEN s.attempts < 3 THEN s.lease END AS wait
      FROM (SELECT s.*, e.us AS seen, coalesce(s.status = 'Extracting' AND s.lease < e.us, false) AS gone FROM s JOIN e ON e.job_id = s.job_id AND e.n = s.n + 1) s JOIN e ON e.job_id = s.job_id AND e.n = s.n + 1) x) y)
SELECT job_id, status, attempts, request_id, CASE WHEN request_id IS NOT NULL THEN 'h1' END AS request_hash, error_code, CASE WHEN lease IS NOT NULL THEN 'w1' END AS owner, lease AS lease_until, wait AS next_attempt, refused, ignored
FROM s QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY n DESC) = 1""")
def job_replay(spark, sf_dir):
    return jobs.replay(job_events(spark, sf_dir))

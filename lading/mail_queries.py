"""Queries over messages, jobs, results and agents, made from the star schema; each has SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lading.operators import agents, linetables, mailbox, records, selection, sheets, tariffs
from lading.plans.rates import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
NOW = "1998-06-01 00:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def now():
    return F.lit(NOW).cast("timestamp")


#: SQL that Spark and others read alike; ``{tables}`` are filled with DataFrames in Spark, elsewhere the braces go.
JOBS = """SELECT o_orderkey AS job_id, o_custkey AS message_id, o_orderkey % 5 AS attachment_id, CAST(o_orderdate AS TIMESTAMP) AS created_at,
  CASE o_orderkey % 11 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Extracting' WHEN 2 THEN 'NeedsReview' WHEN 3 THEN 'Failed' WHEN 4 THEN 'Ignored' WHEN 5 THEN 'AwaitingAi' ELSE 'SentToPricing' END AS status,
  CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 DAY END AS next_attempt_at,
  CASE WHEN o_orderkey % 11 = 1 AND o_orderkey % 4 > 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 10 MINUTE END AS lease_expires_at,
  o_orderkey % 5 AS attempt_count, o_orderkey % 17 = 0 AS is_deleted, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS error_message,
  CASE WHEN o_orderkey % 7 > 2 THEN CAST(o_orderdate AS TIMESTAMP) END AS processed_at FROM {orders}"""
MESSAGES = """SELECT c_custkey AS message_id, CASE WHEN c_custkey % 9 = 0 THEN 'Weekly update' ELSE 'Rates ' || CASE WHEN c_custkey % 3 = 0 THEN substr(n_name, 1, len(n_name) - 1) || 'X' ELSE n_name END || ' lines S.A.' END AS subject,
  'Dear all, please find ' || lower(n_name) || ' Ltd rates below for ' || c_mktsegment AS body FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"""
BODIES = """SELECT doc_id AS message_id, CASE WHEN doc_id % 3 = 0 THEN 'Flete update' ELSE 'news' END AS subject, doc_id % 4 = 0 AS body_with_attachments, doc_id % 5 > 0 AS body_without_attachments, CAST(doc_id % 2 * (doc_id % 7) AS INT) AS attachments,
  text || CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN chr(10) || 'POL | POD | 40HC' || chr(10) || 'Shanghai | Moin | USD 1,200' WHEN 2 THEN chr(10) || 'Ocean freight: 1200 validity 01/05/2026 AL 15/05/2026'
    WHEN 3 THEN chr(10) || 'pls consider rate USD 900 valid till May. Carrier ONE POL: Ningbo POD: Caldera' WHEN 4 THEN chr(10) || 'POL' || chr(10) || 'POD' || chr(10) || 'Carrier' || chr(10) || '40HQ' || chr(10) || '$ 1,200' ELSE ' la naviera y el contenedor' END AS body FROM {documents}"""
RESULTS = """SELECT l_orderkey % 997 AS execution_id, l_orderkey * 10 + l_linenumber AS record_id, CASE l_linenumber % 3 WHEN 0 THEN 'Valid' WHEN 1 THEN 'RequiresReview' ELSE 'Invalid' END AS status,
  CASE WHEN l_partkey % 10 > 0 THEN 'P' END AS origin_port, CASE WHEN l_partkey % 9 > 0 THEN 'E' END AS port_of_exit, CASE WHEN l_partkey % 2 > 0 THEN 'D' ELSE ' ' END AS destination_port, 'C' AS container_type, 'K' AS carrier,
  CASE WHEN l_suppkey % 2 > 0 THEN 'A' END AS agent, 'USD' AS currency, CAST(l_shipdate AS DATE) AS valid_from, CASE WHEN l_partkey % 5 > 0 THEN CAST(l_shipdate AS DATE) END AS valid_to, l_extendedprice AS ocean_freight, CAST(NULL AS DOUBLE) AS total_sale,
  CASE WHEN l_partkey % 4 > 0 THEN 1 END AS origin_port_ref, CASE WHEN l_partkey % 3 > 0 THEN 1 END AS port_of_exit_ref, CASE WHEN l_partkey % 7 > 0 THEN 1 END AS container_type_ref, 1 AS carrier_ref, 1 AS currency_ref,
  CASE WHEN l_partkey % 6 > 0 THEN 1 END AS destination_port_ref, CASE WHEN l_suppkey % 4 > 0 THEN 1 END AS agent_ref FROM {lineitem}"""
ISSUES = """SELECT l_orderkey % 997 AS execution_id, CASE WHEN l_orderkey % 331 > 0 THEN l_orderkey * 10 + l_linenumber END AS record_id, l_quantity > 25 AS is_blocking,
  CASE WHEN l_linenumber % 4 = 0 THEN 'missing_agent' WHEN l_linenumber % 4 = 1 THEN 'unknown_port' WHEN l_linenumber % 4 = 2 THEN 'missing_carrier' ELSE 'expired_rate' END AS code FROM {lineitem} WHERE l_partkey % 3 = 0"""


def made(spark, sf_dir, sql, *names):
    return spark.sql(sql.replace("len(", "length("), **{n: table(spark, sf_dir, n) for n in names})


def plain(sql: str) -> str:
    return sql.replace("{", "").replace("}", "")


def jobs(spark, sf_dir):
    return made(spark, sf_dir, JOBS, "orders")


J = f"WITH j AS ({plain(JOBS)})"
R = f"WITH r AS ({plain(RESULTS)}), i AS ({plain(ISSUES)})"
MATCH = """m AS (SELECT execution_id, round(avg(100.0 * ((origin_port_ref IS NOT NULL)::INT + (port_of_exit_ref IS NOT NULL)::INT + (container_type_ref IS NOT NULL)::INT + 2 + CASE WHEN trim(coalesce(destination_port, '')) <> '' THEN (destination_port_ref IS NOT NULL)::INT ELSE 0 END
  + CASE WHEN agent IS NOT NULL THEN (agent_ref IS NOT NULL)::INT ELSE 0 END) / (5 + (trim(coalesce(destination_port, '')) <> '')::INT + (agent IS NOT NULL)::INT)), 6) AS catalog_match FROM r GROUP BY 1),
h AS (SELECT *, is_blocking AND code NOT IN ('missing_agent', 'expired_rate') AND code NOT LIKE 'unknown_%' AS hard FROM i),
s AS (SELECT execution_id, count(DISTINCT CASE WHEN is_blocking THEN record_id END) AS blocking_rows, count(DISTINCT CASE WHEN hard THEN record_id END) AS hard_rows, count(DISTINCT CASE WHEN NOT hard THEN record_id END) AS review_rows,
  count(*) FILTER (is_blocking) AS blocking_issues, bool_or(hard AND record_id IS NULL) AS hard_for_all, bool_or(is_blocking AND record_id IS NULL) AS blocked_for_all FROM h GROUP BY 1)"""


@query(f"{J} SELECT job_id, 'Extracting' AS status, 'w1' AS lease_owner, TIMESTAMP '{NOW}' + INTERVAL 10 MINUTE AS lease_expires_at FROM j WHERE status = 'Pending' AND NOT is_deleted AND (next_attempt_at IS NULL OR next_attempt_at <= TIMESTAMP '{NOW}') ORDER BY created_at, job_id LIMIT 50")
def job_claims(spark, sf_dir):
    return mailbox.claim(jobs(spark, sf_dir), now(), "w1", 50).select("job_id", "status", "lease_owner", "lease_expires_at")


@query(f"{J} SELECT job_id, CASE WHEN attempt_count >= 3 THEN 'Failed' ELSE 'Pending' END AS status, CASE WHEN attempt_count < 3 THEN TIMESTAMP '{NOW}' END AS next_attempt_at FROM j WHERE status = 'Extracting' AND NOT is_deleted AND lease_expires_at < TIMESTAMP '{NOW}' ORDER BY lease_expires_at, job_id LIMIT 100")
def job_recovery(spark, sf_dir):
    return mailbox.recover(jobs(spark, sf_dir), now()).select("job_id", "status", "next_attempt_at")


@query(f"""{J}, c AS (SELECT count(*) FILTER (status = 'Pending') AS pending, count(*) FILTER (status IN ('Pending', 'Extracting', 'AwaitingAi')) AS active, count(*) FILTER (status = 'Extracting' AND lease_expires_at < TIMESTAMP '{NOW}') AS stale,
count(*) FILTER (status = 'NeedsReview') AS review, count(*) FILTER (status = 'Failed') AS failed FROM j WHERE NOT is_deleted) SELECT *, pending >= 100 OR stale > 0 AS degraded FROM c""")
def backlog_health(spark, sf_dir):
    return mailbox.health(jobs(spark, sf_dir), now())


@query(f"""{J}, g AS (SELECT message_id, bool_or(status IN ('Pending', 'Extracting', 'AwaitingAi')) AS active, bool_and(status IN ('SentToPricing', 'Ignored')) AS done, bool_or(status = 'NeedsReview') AS review, bool_or(status = 'Failed') AS failed, count(*) AS jobs FROM j WHERE NOT is_deleted GROUP BY 1),
e AS (SELECT message_id, status, error_message FROM j WHERE NOT is_deleted QUALIFY row_number() OVER (PARTITION BY message_id, status ORDER BY created_at, job_id) = 1)
SELECT g.message_id, CASE WHEN active THEN 'Processing' WHEN done THEN 'Extracted' WHEN review THEN 'NeedsReview' WHEN failed THEN 'Failed' END AS state, CASE WHEN active OR done THEN NULL ELSE e.error_message END AS error_message, jobs
FROM g LEFT JOIN e ON e.message_id = g.message_id AND e.status = CASE WHEN review THEN 'NeedsReview' WHEN failed THEN 'Failed' END""")
def message_states(spark, sf_dir):
    return mailbox.message_states(jobs(spark, sf_dir))


@query(f"{J} SELECT message_id, attachment_id, job_id FROM j QUALIFY row_number() OVER (PARTITION BY message_id, attachment_id ORDER BY created_at DESC, job_id DESC) = 1")
def latest_attempts(spark, sf_dir):
    return mailbox.latest_attempts(jobs(spark, sf_dir)).select("message_id", "attachment_id", "job_id")


@query(f"{J} SELECT job_id FROM j WHERE message_id NOT IN (SELECT message_id FROM j WHERE status = 'SentToPricing')")
def unsent_jobs(spark, sf_dir):
    return mailbox.without_siblings(jobs(spark, sf_dir)).select("job_id")


@query("SELECT c_custkey, c_name, count(*) OVER () AS total FROM customer WHERE c_custkey % 17 > 0 AND c_nationkey = 7 AND (contains(lower(c_name), '1') OR contains(lower(c_mktsegment), '1')) ORDER BY c_custkey LIMIT 100")
def search_page(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("is_deleted", F.col("c_custkey") % 17 == 0)
    found = mailbox.matching(mailbox.having(mailbox.live(c), c_nationkey=7, c_mktsegment=None), " 1 ", ["c_name", "c_mktsegment"])
    rows, total = mailbox.page(found, [F.col("c_custkey")], 1, 5000)
    return rows.select("c_custkey", "c_name").crossJoin(F.broadcast(total))


SENDERS = "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN '*' WHEN 2 THEN '@x.com; b@y.com' WHEN 3 THEN 'A@X.com,' WHEN 4 THEN '*@y.com' ELSE 'c@z.com' END AS allowed, CASE c_custkey % 4 WHEN 0 THEN 'a@x.com' WHEN 1 THEN ' B@Y.com' WHEN 2 THEN 'c@z.org' ELSE 'd@mail.x.com' END AS sender FROM {customer}"


@query(f"""WITH s AS ({plain(SENDERS)}), t AS (SELECT *, lower(trim(sender)) AS w, list_filter(list_transform(regexp_split_to_array(lower(allowed), '[,;]'), lambda x: trim(x)), lambda x: x <> '') AS l FROM s)
SELECT c_custkey, allowed = '' OR len(list_filter(l, lambda x: x = '*' OR x = w OR (x LIKE '@%' AND ends_with(w, x)) OR (x LIKE '*@%' AND ends_with(w, substr(x, 2))))) > 0 AS allowed FROM t""")
def senders_allowed(spark, sf_dir):
    s = made(spark, sf_dir, SENDERS, "customer")
    return s.select("c_custkey", mailbox.allowed_sender(F.col("allowed"), F.col("sender")).alias("allowed"))


@query("SELECT p_partkey, (p_size % 4 = 0 AND p_partkey % 3 = 0) OR (p_size % 4 = 1 AND p_partkey % 3 = 1) OR (p_size % 4 = 2 AND p_partkey % 3 = 2) AS supported FROM part")
def attachments_supported(spark, sf_dir):
    size, key = F.col("p_size") % 4, F.col("p_partkey") % 3
    ext = F.when(size == 0, " PDF").when(size == 1, ".csv").when(size == 2, "XLSX").otherwise(F.lit(None))
    kind = F.when(key == 0, "Pdf").when(key == 1, "Csv").otherwise("Excel")
    return table(spark, sf_dir, "part").select("p_partkey", mailbox.supported_attachment(kind, ext).alias("supported"))


@query("SELECT l_orderkey AS message_id, l_suppkey AS hash, l_linenumber AS attachment_id FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber) = 1")
def attachments_once(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("message_id"), F.col("l_suppkey").alias("hash"), F.col("l_linenumber").alias("position"), F.col("l_linenumber").alias("attachment_id"))
    return mailbox.distinct_attachments(a).select("message_id", "hash", "attachment_id")


@query(f"SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 10 = 0 OR CAST(o_orderdate AS TIMESTAMP) + to_minutes(CASE WHEN o_orderkey % 4 = 1 THEN 2 ELSE greatest(1, CAST(o_orderkey % 3 AS INT) * 525600) END) <= TIMESTAMP '{NOW}'")
def accounts_due(spark, sf_dir):
    k = F.col("o_orderkey")
    a = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(k % 10 > 0, F.col("o_orderdate").cast("timestamp")).alias("last_sync_at"), F.when(k % 4 == 1, "failed").otherwise(" ").alias("last_sync_error"), ((k % 3) * 525600).cast("int").alias("polling_interval_minutes"))
    return mailbox.due_accounts(a, now()).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey AS account_id, max(o_orderkey) AS last_uid FROM orders GROUP BY 1")
def mail_cursors(spark, sf_dir):
    return mailbox.cursors(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("account_id"), F.col("o_orderkey").alias("uid")))


@query(f"{J} SELECT count(*) AS n, min(processed_at) AS first FROM (SELECT processed_at FROM j WHERE processed_at < TIMESTAMP '{NOW}' - INTERVAL 30 DAY ORDER BY processed_at LIMIT 250)")
def inbox_spent(spark, sf_dir):
    return mailbox.spent(jobs(spark, sf_dir), now()).agg(F.count("*").alias("n"), F.min("processed_at").alias("first"))


@query(f"""{R}, {MATCH}, n AS (SELECT execution_id, count(*) AS rows FROM r GROUP BY 1),
k AS (SELECT execution_id, CASE execution_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Pdf' WHEN 2 THEN 'Csv' ELSE 'Excel' END AS source_type FROM (SELECT unnest(range(0, 1000)) AS execution_id)),
o AS (SELECT k.execution_id, rows IS NULL OR coalesce(hard_for_all, false) AS none, greatest(0.0, least(100.0, 100.0 * (rows - coalesce(hard_rows, 0)) / rows - 5.0 * coalesce(review_rows, 0) / rows + CASE WHEN source_type IN ('Csv', 'Excel') THEN 10 ELSE 0 END - CASE WHEN source_type IS NULL THEN 5 ELSE 0 END)) AS st, catalog_match
  FROM k LEFT JOIN n USING (execution_id) LEFT JOIN s USING (execution_id) LEFT JOIN m USING (execution_id))
SELECT execution_id, CASE WHEN none THEN 0.0 ELSE round(st, 6) END AS structural, CASE WHEN none THEN 0.0 ELSE catalog_match END AS catalog_match, CASE WHEN none THEN 0.0 ELSE least(round(st, 6), catalog_match) END AS confidence FROM o""")
def extraction_confidence(spark, sf_dir):
    x = F.col("execution_id") % 4
    executions = spark.range(1000).select(F.col("id").alias("execution_id")).withColumn("source_type", F.when(x == 1, "Pdf").when(x == 2, "Csv").when(x == 3, "Excel"))
    return selection.extraction_confidence(executions, made(spark, sf_dir, RESULTS, "lineitem"), made(spark, sf_dir, ISSUES, "lineitem"))


@query(f"""{R}, {MATCH}, q AS (SELECT execution_id, count(*) AS rows, count(*) FILTER (status = 'Valid') AS v, count(*) FILTER (status = 'RequiresReview') AS w, count(*) FILTER (status = 'Invalid') AS x,
  sum(CASE WHEN origin_port IS NOT NULL THEN 40 ELSE 0 END + CASE WHEN port_of_exit IS NOT NULL THEN 40 ELSE 0 END + 40 + 40 + 25 + 25 + CASE WHEN valid_to IS NOT NULL THEN 25 ELSE 0 END + 40
  + CASE WHEN origin_port_ref IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN port_of_exit_ref IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN container_type_ref IS NOT NULL THEN 5 ELSE 0 END + 10) AS f FROM r GROUP BY 1)
SELECT execution_id, CAST(1000 * rows + 250 * v + 100 * w - 500 * x - 300 * coalesce(blocking_issues, 0) + f AS BIGINT) AS quality, CASE WHEN coalesce(blocked_for_all, false) THEN 1.0 ELSE round(coalesce(blocking_rows, 0) / rows, 6) END AS blocking_ratio,
  least(round(100.0 * (v + w) / rows, 6), catalog_match) AS prior_confidence FROM q LEFT JOIN s USING (execution_id) JOIN m USING (execution_id)""")
def result_quality(spark, sf_dir):
    return selection.quality(made(spark, sf_dir, RESULTS, "lineitem"), made(spark, sf_dir, ISSUES, "lineitem"))


BOUND = r"(^|[^\p{L}\p{N}])"
HITS = " + ".join(f"CAST(regexp_matches(t, '(?i){BOUND}{k}([^\\p{{L}}\\p{{N}}]|$)') AS INT)" for k in selection.KEYWORDS)
AMOUNT = selection.AMOUNT.replace("(?iu)", "(?i)")
VALIDITY = selection.VALIDITY.replace("(?iu)", "(?i)")
TOLD = " AND ".join(f"regexp_matches(t, '{p.replace('(?iu)', '(?i)')}')" for p in selection.NARRATIVE)
SIGNS = " OR ".join("contains(lower(t), '{}')".format(s.replace("'", "''")) for s in selection.COLUMN_SIGNS)


@query(rf"""WITH b AS ({plain(BODIES)}), l AS (SELECT *, subject || chr(10) || body AS t, list_filter(list_transform(regexp_split_to_array(body, '\r?\n'), lambda x: trim(x)), lambda x: x <> '') AS ls FROM b),
k AS (SELECT *, list_transform(ls, lambda x: regexp_replace(lower(x), '[^a-z0-9]+', '', 'g')) AS ks FROM l),
c AS (SELECT message_id, attachments, body_with_attachments, body_without_attachments, body, {HITS} AS hits, ({SIGNS}) AS cols, regexp_matches(t, '{AMOUNT}') AS amt, regexp_matches(t, '{VALIDITY}') AS val, ({TOLD}) AS told0,
  len(list_filter(ls, lambda x: len(x) - len(replace(x, chr(9), '')) >= 2 OR len(x) - len(replace(x, '|', '')) >= 2)) >= 2 OR
  len(list_filter(range(1, len(ks) + 1), lambda i: ks[i] = 'pol' AND list_contains(ks[i : i + 11], 'pod') AND list_contains(ks[i : i + 11], 'carrier') AND len(list_filter(ks[i : i + 11], lambda y: regexp_full_match(y, '(20|40|45)(gp|hq|hc|dv|dc|nor)?'))) > 0)) > 0 AS has_table FROM k),
d AS (SELECT *, told0 AND amt AS told, has_table AND cols AND amt AS tab, (told0 AND amt) OR (has_table AND cols AND amt) OR (cols AND amt AND val) AS strong FROM c),
e AS (SELECT *, least(90, 8 * hits + CASE WHEN strong OR (hits >= 3 AND amt AND val) THEN 15 ELSE 0 END + CASE WHEN tab THEN 10 ELSE 0 END + CASE WHEN told THEN 25 ELSE 0 END) AS body_confidence, trim(body) <> '' AND strong AND CASE WHEN attachments > 0 THEN body_with_attachments ELSE body_without_attachments END AS process_body FROM d)
SELECT message_id, CAST(hits AS INT) AS hits, has_table, CAST(body_confidence AS INT) AS body_confidence, CAST(greatest(body_confidence, CASE WHEN attachments > 0 THEN 75 ELSE 0 END) AS INT) AS confidence, process_body, attachments > 0 OR process_body AS contains_rates FROM e""")
def message_classes(spark, sf_dir):
    out = selection.classify_messages(made(spark, sf_dir, BODIES, "documents"))
    return out.select("message_id", "hits", "has_table", "body_confidence", "confidence", "process_body", "contains_rates")


@query(rf"""WITH m AS ({plain(MESSAGES)}), a AS (SELECT n_nationkey AS agent_id, n_name AS name, replace(upper(n_name), '_', ' ') AS alias, len(string_split(replace(n_name, '_', ' '), ' ')) AS words, len(n_name) AS longest FROM nation),
x AS (SELECT message_id, 'subject' AS found_in, string_split(regexp_replace(upper(CASE WHEN subject LIKE 'Rates%' THEN substr(subject, 1, len(subject) - 5) ELSE subject END), '[^A-Z0-9]+', ' ', 'g'), ' ') AS ws FROM m UNION ALL
  SELECT message_id, 'body', list_filter(string_split(trim(regexp_replace(upper(body), '[^A-Z0-9]+', ' ', 'g')), ' '), lambda w: w <> 'LTD') FROM m),
n AS (SELECT *, unnest(range(1, 5)) AS n FROM x), i AS (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM n WHERE n <= len(ws)), w AS (SELECT DISTINCT message_id, found_in, n, array_to_string(ws[i : i + n - 1], ' ') AS run FROM i),
s AS (SELECT message_id, found_in, agent_id, name, longest, max(CASE WHEN run = alias THEN 1.0 ELSE round(1.0 - levenshtein(replace(run, ' ', ''), replace(alias, ' ', '')) / greatest(len(replace(run, ' ', '')), len(replace(alias, ' ', ''))), 6) END) AS score
  FROM w, a WHERE (n BETWEEN greatest(1, words - 1) AND words + 1) GROUP BY ALL HAVING max(CASE WHEN run = alias THEN 1.0 ELSE round(1.0 - levenshtein(replace(run, ' ', ''), replace(alias, ' ', '')) / greatest(len(replace(run, ' ', '')), len(replace(alias, ' ', ''))), 6) END) >= 0.88),
r AS (SELECT *, row_number() OVER o AS place, lead(score) OVER o AS next FROM s WINDOW o AS (PARTITION BY message_id, found_in ORDER BY score DESC, longest DESC, name)),
v AS (SELECT * FROM r WHERE place = 1 AND (next IS NULL OR round(score - next, 6) >= 0.06))
SELECT message_id, agent_id, name, CAST(score AS DOUBLE) AS score, found_in FROM v WHERE found_in = 'subject' OR message_id NOT IN (SELECT message_id FROM v WHERE found_in = 'subject')""")
def mail_agents(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("agent_id"), F.col("n_name").alias("name"), F.lit(None).cast("array<string>").alias("aliases"))
    return agents.resolve_messages(made(spark, sf_dir, MESSAGES, "customer", "nation"), names)


@query("""WITH p AS (SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_quantity AS INT) AS q, l_linenumber % 3 AS c FROM lineitem),
a AS (SELECT k, n, CAST(q * 100 AS DECIMAL(18,4)) AS ocean_freight, CASE c WHEN 0 THEN CAST(q + 2 * q AS DECIMAL(18,4)) WHEN 1 THEN CAST(q AS DECIMAL(18,4)) END AS origin_charges, CAST(7 AS DECIMAL(18,4)) AS surcharges, CASE c WHEN 2 THEN CAST(q * 150 AS DECIMAL(18,4)) WHEN 0 THEN CAST(q * 120 AS DECIMAL(18,4)) END AS total_sale FROM p),
b AS (SELECT *, ocean_freight + coalesce(origin_charges, 0) + surcharges AS total_cost FROM a)
SELECT k AS order_key, n AS line_no, 'SHANGHAI' AS origin_port, '40HC' AS container_type, 'MSC' AS carrier, CAST(14 AS INT) AS free_days, CAST(ocean_freight AS DOUBLE) AS ocean_freight, CAST(origin_charges AS DOUBLE) AS origin_charges, CAST(total_cost AS DOUBLE) AS total_cost, CAST(total_sale AS DOUBLE) AS total_sale, CAST(total_sale - total_cost AS DOUBLE) AS profit, 'direct' AS remarks FROM b""")
def priced_records(spark, sf_dir):
    """Records of every field that a sheet may name: parts add up to charges, charges to costs."""
    q, c = F.col("l_quantity").cast("int"), F.col("l_linenumber") % 3
    text = lambda x: x.cast("string")
    fields = F.create_map(
        F.lit("OriginPort"), F.lit("sha"), F.lit("ContainerType"), F.lit("40' HQ"), F.lit("Carrier"), F.lit("MSC Line FAK"), F.lit("FreeDays"), F.lit("14 days"), F.lit("Remarks"), F.lit(" "), F.lit("RouteMode"), F.lit("direct"),
        F.lit("OceanFreight"), F.concat(F.lit("USD "), text(q * 100)), F.lit("AgentProfitCost"), F.when(c < 2, text(q)), F.lit("AgentReleaseCost"), F.when(c == 0, text(2 * q)), F.lit("BunkerCost"), F.lit("$7"),
        F.lit("TotalSale"), F.when(c == 2, text(q * 150)), F.lit("AllInSale"), F.when(c != 1, text(q * 120)),
    )
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_no"), fields.alias("fields")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "order_key")
    out = records.price_records(rows, 2026)
    return out.select("order_key", "line_no", "origin_port", "container_type", "carrier", "free_days", *[F.col(x).cast("double").alias(x) for x in ("ocean_freight", "origin_charges", "total_cost", "total_sale", "profit")], "remarks")


def rate_mails(spark, sf_dir):
    """Lines of mails with rates in one of three layouts, or none: rows of an order as bars, as one cell a line, or as pairs."""
    r = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    text = lambda c: F.col(c).cast("string")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_orderkey") % 4).alias("kind"), r.alias("r"), F.array(F.concat(F.lit("P"), text("l_partkey")), F.concat(F.lit("E"), text("l_suppkey")), F.lit("MSC"), F.col("l_quantity").cast("int").cast("string")).alias("cells"))
    heads = F.array(*map(F.lit, ("POL", "POE", "Carrier", " Rate ")))
    line = lambda pos, t: F.struct(pos.cast("int").alias("pos"), t.alias("text"))
    bars = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    one_each = lambda cells, at: F.transform(cells, lambda c, i: line(at + i, c))
    pairs = F.transform(F.arrays_zip(heads.alias("h"), F.col("cells").alias("c")), lambda x, i: line(4 * F.col("r") + i, F.concat(x["h"], F.when(i == 1, " = ").otherwise(": "), x["c"])))
    own = F.when(F.col("kind") == 0, F.array(line(1 + F.col("r"), bars(F.col("cells"))))).when(F.col("kind") == 1, one_each(F.col("cells"), 1 + 4 * F.col("r"))).when(F.col("kind") == 2, pairs)
    frame = F.array(line(F.lit(0), F.lit("Dear all, see our rates: valid now")), line(F.lit(1000), F.lit("Best regards, POL | POE | Carrier")))
    head = F.when(F.col("kind") == 0, F.array(line(F.lit(1), bars(heads)))).when(F.col("kind") == 1, one_each(heads, F.lit(1)))
    none = F.array().cast("array<struct<pos:int,text:string>>")
    every = F.concat(F.coalesce(own, none), F.when(F.col("r") == 1, F.concat(frame, F.coalesce(head, none))).otherwise(none))
    return rows.select("doc_id", F.explode(every).alias("l")).select("doc_id", "l.pos", "l.text")


@query("""WITH l AS (SELECT l_orderkey AS doc_id, l_orderkey % 4 AS kind, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS r, l_partkey, l_suppkey, l_quantity FROM lineitem)
SELECT doc_id, CAST(r AS BIGINT) AS row_number, CASE kind WHEN 0 THEN 'delimited' WHEN 1 THEN 'stacked' ELSE 'pairs' END AS parser, 'P' || CAST(l_partkey AS VARCHAR) AS origin, 'E' || CAST(l_suppkey AS VARCHAR) AS port_of_exit, 'MSC' AS carrier, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS rate FROM l WHERE kind < 3""")
def mail_tables(spark, sf_dir):
    """Rates found in mails of three layouts and mapped to fields."""
    lines = rate_mails(spark, sf_dir)
    mappings = sheets.default_mappings(spark)
    cells = linetables.mail_tables(lines, mappings)
    rows = sheets.cells_to_rows(cells, mappings, ["doc_id", "row_number", "parser"])
    f = lambda k: F.col(f"fields.{k}")
    return rows.select("doc_id", F.col("row_number").cast("long").alias("row_number"), "parser", f("OriginPort").alias("origin"), f("PortOfExit").alias("port_of_exit"), f("Carrier").alias("carrier"), f("OceanFreight").alias("rate"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN 'MSC' WHEN o_orderkey % 4 = 2 THEN 'CMA CGM' END AS carrier, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 30 AS INT) WHEN o_orderkey % 3 = 1 THEN 14 END AS free_days FROM orders""")
def document_hints(spark, sf_dir):
    """Carrier and free days that a whole text names."""
    k = F.col("o_orderkey")
    who = F.when(k % 4 == 1, "rates by MSC here").when(k % 4 == 2, "our cma cgm offer, not cosco's").when(k % 4 == 3, "MSC and COSCO").otherwise("none")
    free = F.when(k % 3 == 0, F.concat(F.lit("Free time at port: "), (k % 30).cast("string"), F.lit(" days"))).when(k % 3 == 1, "TIEMPO  LIBRE en destino 14 DÍAS").otherwise("")
    text = F.concat_ws("\n", who, free)
    return table(spark, sf_dir, "orders").select("o_orderkey", linetables.the_carrier(text).alias("carrier"), linetables.free_days(text).alias("free_days"))


@query("""WITH p AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS r, l_partkey, l_suppkey FROM lineitem)
SELECT doc_id, CAST(r - 1 AS INT) AS pos, 'a' || CAST(l_partkey AS VARCHAR) || ' b   c' || CAST(l_suppkey AS VARCHAR) AS text FROM p""")
def word_lines(spark, sf_dir):
    """Lines of a page from the places of its words: three words a line, heights off by up to three points."""
    r = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_partkey", "l_suppkey", r.alias("r"))
    word = lambda text, left, off: F.struct(text.alias("word"), F.lit(left).alias("left"), F.lit(left + 10.0).alias("right"), (800.0 - 12 * F.col("r") - off).alias("bottom"))
    at = F.explode(F.array(word(F.concat(F.lit("c"), F.col("l_suppkey").cast("string")), 60.0, 2.5), word(F.lit("b"), 22.0, 3.0), word(F.concat(F.lit("a"), F.col("l_partkey").cast("string")), 10.0, 0.5)))
    words = rows.select("doc_id", F.lit(1).alias("page"), at.alias("w")).select("doc_id", "page", "w.word", "w.left", "w.right", "w.bottom")
    return linetables.words_to_lines(words)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Maersk' WHEN o_orderkey % 5 > 0 THEN 'Hapag-Lloyd' END AS carrier, CASE o_orderkey % 4 WHEN 0 THEN 'Moín' WHEN 1 THEN 'Puerto Caldera' WHEN 2 THEN 'Colón' END AS port_of_exit,
CASE WHEN o_orderkey % 7 < 3 THEN make_date(1998, 8, CAST(1 + o_orderkey % 9 AS INT)) WHEN o_orderkey % 7 = 3 THEN make_date(2027, 1, CAST(1 + o_orderkey % 9 AS INT)) END AS valid_from,
CASE WHEN o_orderkey % 7 < 3 THEN DATE '1998-08-14' WHEN o_orderkey % 7 = 3 THEN DATE '2027-01-14' END AS valid_to, CASE WHEN o_orderkey % 2 = 0 THEN 'Diamond Tier' ELSE 'Marítimo' END AS route_mode FROM orders""")
def tariff_hints(spark, sf_dir):
    """Carrier, port of exit, validity and route mode that a tariff's name and text say."""
    k, day = F.col("o_orderkey"), (1 + F.col("o_orderkey") % 9).cast("string")
    name = F.when(k % 3 == 0, "MSK tariff.xlsx").otherwise("tariff.xlsx")
    line = F.when(k % 5 > 0, "Hapag-Lloyd weekly").otherwise("weekly")
    port = F.when(k % 4 == 0, "via Moín").when(k % 4 == 1, "vía Puerto Caldera").when(k % 4 == 2, "Colón").otherwise("inland")
    dates = F.when(k % 7 < 3, F.concat(F.lit("Vigencia "), day, F.lit(" al 14 de AGOSTO"))).when(k % 7 == 3, F.concat(day, F.lit("-14 jan 2027"))).when(k % 7 == 4, "31 al 2 de mayo").otherwise("30 al 31 de febrero")
    text = F.concat_ws("\n", line, port, dates, F.when(k % 2 == 0, "diamond tier"))
    of = table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name"), text.alias("text"))
    valid = tariffs.tariff_validity(F.col("text"), now().cast("date"))
    of = of.withColumn("valid", valid)
    return of.select("o_orderkey", tariffs.tariff_carrier(F.col("name"), F.col("text")).alias("carrier"), tariffs.tariff_exit(F.col("name"), F.col("text")).alias("port_of_exit"), F.col("valid.start").alias("valid_from"), F.col("valid.end").alias("valid_to"), tariffs.route_mode(F.col("text")).alias("route_mode"))

"""Queries over pages of positioned words, grids of cells and texts, made from the star schema; each has SQL for its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lading.mail_queries import made, now, plain
from lading.operators import bodies, grids, narratives, replies, sheets, wordtables
from lading.plans.rates import table
from lading.sources import sinks

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows that cost much each, dealt out to as many tasks as a shuffle has: they are too small for Spark to split them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


#: Pages of tariffs: one document per customer, two pages, a line per order; words are off their columns by some points.
WORDS = """WITH o AS (SELECT o_custkey AS d, 1 + o_orderkey % 2 AS page, o_orderkey AS k, o_orderdate AS dt, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY o_orderkey) AS r FROM {orders}),
  p AS (SELECT DISTINCT d, page FROM o),
  heads AS (SELECT d, page, CASE WHEN d % 4 = 1 AND slot = 5 THEN 'Vigencia' WHEN d % 11 = 0 AND slot = 6 THEN 'Naviera' WHEN slot = 4 AND d % 3 = 0 THEN '40''/40HC' ELSE word END AS word, x0, x0 + 6.0 * length(word) AS x1, 700.0 - 14 - slot % 3 AS y
    FROM p CROSS JOIN (VALUES (0, 'Región', 10.0), (1, 'Puerto', 82.0), (1, 'de', 120.0), (1, 'Origen', 136.0), (2, 'Puerto', 210.0), (2, 'Destino', 250.0), (3, '20''', 330.0), (4, '40HQ', 390.0), (5, 'Validity', 470.0), (6, 'Notas', 620.0)) AS v (slot, word, x0)
    WHERE NOT (slot = 0 AND d % 2 = 0) AND NOT (slot = 4 AND d % 13 = 0)),
  cells AS (SELECT d, page, r, k, slot, x0 + k % 9 - 4.0 AS x0, CASE slot WHEN 0 THEN 'Asia' WHEN 1 THEN 'Port' WHEN 2 THEN 'N' || CAST(k % 25 AS STRING) WHEN 3 THEN 'Moin' WHEN 4 THEN CASE WHEN k % 10 = 0 THEN 'n/a' ELSE '$' || CAST(1000 + k % 900 AS STRING) END
      WHEN 5 THEN CASE WHEN k % 7 = 0 THEN '-' ELSE CAST(2000 + k % 700 AS STRING) END WHEN 6 THEN '0' || CAST(1 + k % 9 AS STRING) || '/08/2026' WHEN 7 THEN CASE WHEN k % 17 = 0 THEN 'open' ELSE '31/08/2026' END END AS word
    FROM o CROSS JOIN (VALUES (0, 12.0), (1, 84.0), (2, 118.0), (3, 214.0), (4, 332.0), (5, 392.0), (6, 470.0), (7, 530.0)) AS v (slot, x0)
    WHERE NOT (slot = 3 AND k % 19 = 0)),
  notes AS (SELECT d, 1 AS page, word, x0, x0 + 20.0 AS x1, y FROM (SELECT DISTINCT d FROM o) AS ds CROSS JOIN (VALUES (0, 'PIL', 10.0, 800.0), (1, 'MSC', 60.0, 800.0), (2, 'Free', 10.0, 770.0), (2, 'time:', 40.0, 769.0), (2, '21', 70.0, 768.5), (2, 'days', 90.0, 770.0)) AS v (kind, word, x0, y)
    WHERE NOT (kind = 1 AND d % 5 > 0) AND NOT (kind = 2 AND d % 6 > 2))
SELECT d AS doc_id, CAST(page AS INT) AS page, word, CAST(x0 AS DOUBLE) AS x0, CAST(x1 AS DOUBLE) AS x1, CAST(y AS DOUBLE) AS y FROM heads
UNION ALL SELECT d, CAST(page AS INT), word, CAST(x0 AS DOUBLE), CAST(x0 + 5.0 * length(word) AS DOUBLE), CAST(686.0 - 14 * r - slot % 3 AS DOUBLE) FROM cells
UNION ALL SELECT d, CAST(page AS INT), word, CAST(x0 AS DOUBLE), CAST(x1 AS DOUBLE), CAST(y AS DOUBLE) FROM notes"""


def tariff_words(spark, sf_dir):
    words = made(spark, sf_dir, WORDS, "orders")
    return words.select("doc_id", "page", "word", F.col("x0").alias("left"), F.col("x1").alias("right"), F.col("y").alias("bottom"))


@query(f"""WITH w AS ({plain(WORDS)}), n AS (SELECT *, CAST(floor((700 - y) / 14 + 0.001) AS INT) AS line, (x0 + x1) / 2 AS centre FROM w),
starts AS (SELECT doc_id, page, max(CASE WHEN word = 'Región' THEN x0 END) AS region, min(CASE WHEN word = 'Puerto' THEN x0 END) AS origin, max(CASE WHEN word = 'Puerto' THEN x0 END) AS destination,
  max(CASE WHEN word = '20''' THEN x0 END) AS a1, max(CASE WHEN word LIKE '40%' THEN x0 END) AS a2, max(CASE WHEN word LIKE '40%' THEN CASE WHEN word = '40HQ' THEN '40HQ' ELSE '40DV/40HC' END END) AS n2, max(CASE WHEN word IN ('Validity', 'Vigencia') THEN x0 END) AS validity, bool_or(word = 'Naviera') AS carrier
  FROM n WHERE line = 1 GROUP BY ALL HAVING a2 IS NOT NULL AND NOT bool_or(word = 'Naviera')),
bounds AS (SELECT doc_id, page, unnest([
    {{'name': 'POL', 'low': coalesce((region + origin) / 2, -1e9), 'high': (origin + destination) / 2}}, {{'name': 'POE', 'low': (origin + destination) / 2, 'high': (destination + a1) / 2}},
    {{'name': '20''', 'low': (destination + a1) / 2, 'high': (a1 + a2) / 2}}, {{'name': n2, 'low': (a1 + a2) / 2, 'high': (a2 + validity) / 2}}, {{'name': 'Validity', 'low': (a2 + validity) / 2, 'high': 1e9}}], recursive := true) FROM starts),
cells AS (SELECT n.doc_id, n.page, line, name, string_agg(word, ' ' ORDER BY x0) AS text FROM n JOIN bounds b ON n.doc_id = b.doc_id AND n.page = b.page AND centre >= low AND centre < high WHERE line > 1 GROUP BY ALL),
good AS (SELECT * FROM cells WHERE CASE WHEN name IN ('POL', 'POE') THEN true WHEN name = 'Validity' THEN len(regexp_extract_all(text, '[0-9]+/[0-9]+/[0-9]+')) >= 2 ELSE regexp_matches(text, '[0-9]') END),
lines AS (SELECT doc_id, page, line FROM good GROUP BY ALL HAVING bool_or(name = 'POL') AND bool_or(name = 'POE') AND bool_or(name = 'Validity') AND bool_or(name NOT IN ('POL', 'POE', 'Validity'))),
numbered AS (SELECT *, 1 + row_number() OVER (PARTITION BY doc_id ORDER BY page, line) AS row_number FROM lines WHERE doc_id % 5 > 0)
SELECT n.doc_id, n.row_number, name AS header, text AS value FROM numbered n JOIN good g USING (doc_id, page, line)
UNION ALL SELECT doc_id, row_number, unnest(['Carrier', 'Currency']), unnest(['PIL', 'USD']) FROM numbered
UNION ALL SELECT doc_id, row_number, 'Free Time', '21 days' FROM numbered WHERE doc_id % 6 <= 2""")
def visual_tariffs(spark, sf_dir):
    """Rates in tariffs whose columns are known by the places of words only."""
    return wordtables.tariff_tables(tariff_words(spark, sf_dir)).select("doc_id", F.col("row_number").cast("long").alias("row_number"), "header", "value")


#: Replies of a model for each order, with « and » for the braces of JSON: plain, fenced, as a string, as an array, as one object, in envelopes, cut off, and with JSON in a string.
REPLIES = """WITH o AS (SELECT o_orderkey AS k, CAST(o_orderkey % 900 AS INT) AS n FROM {orders}),
  r AS (SELECT k, '«"' || CASE WHEN k % 3 = 0 THEN 'pol' WHEN k % 3 = 1 THEN 'Port_of Loading' ELSE 'puertoOrigen' END || '":" P' || CAST(n AS STRING) || ' ","poe":"Moin","size":"40HC","oceanFreight":"USD 1.' || CAST(100 + n AS STRING) || '","freeTime":"14 days","rate":5,"validFrom":"2026-08-01","validTo":"2026-08-3' || CASE WHEN k % 5 = 0 THEN '9' ELSE '1' END || '"»' AS r1,
    '«"note":[1,«"a":2»],"origin":"' || CASE WHEN k % 4 = 0 THEN ' ' ELSE 'Q' || CAST(n AS STRING) END || '","destination":true,"finalDestination":"San Jose","equipment":20,"moneda":"EUR","totalSale":' || CAST(n AS STRING) || '.50,"transit":7.5,"cost":"(' || CAST(n AS STRING) || ',5)","vigencia":"2026-08-01 to 2026-08-15"»' AS r2 FROM o),
  b AS (SELECT k, r1, r2, '«"rows":[' || r1 || ',7,' || r2 || '],"confidence":0.8,"warnings":["late",""," late","early"],"success":"0"»' AS body FROM r)
SELECT k AS reply_id, replace(replace(CASE k % 8 WHEN 0 THEN body WHEN 1 THEN '```json' || chr(10) || '«"Data":«"pricing_rows":[' || r2 || '],"score":"91"»»' || chr(10) || '```' WHEN 2 THEN '"' || replace(body, '"', chr(92) || '"') || '"' WHEN 3 THEN '[' || r1 || ',' || r2 || ']'
  WHEN 4 THEN '  ' || r1 WHEN 5 THEN '«"result":«"output":«"response":«"rates":[' || r1 || ']»»»»' WHEN 6 THEN '«"rows":[' || r1 ELSE '«"payload":"' || replace('«"items":«"tariffs":[' || r2 || ']»»', '"', chr(92) || '"') || '"»' END, '«', chr(123)), '»', chr(125)) AS content FROM b"""


@query(f"""WITH c AS (SELECT reply_id, trim(regexp_replace(regexp_replace(content, '^```json', ''), '```$', ''), ' ' || chr(10)) AS c FROM ({plain(REPLIES)})),
s AS (SELECT reply_id, CASE WHEN c LIKE '"%' THEN json_extract_string(c, '$') ELSE c END AS c FROM c WHERE json_valid(c)),
e AS (SELECT reply_id, coalesce(json_extract(c, '$.Data.pricing_rows'), json_extract(c, '$.result.output.response.rates'), json_extract(json_extract_string(c, '$.payload'), '$.items.tariffs'), json_extract(c, '$.rows'), CASE WHEN c LIKE '[%' THEN CAST(c AS JSON) ELSE json_array(CAST(c AS JSON)) END) AS rows FROM s),
u AS (SELECT reply_id, generate_subscripts(x, 1) AS n, unnest(x) AS r FROM (SELECT reply_id, list_filter(CAST(rows AS JSON[]), lambda v: json_type(v) = 'OBJECT') AS x FROM e)),
f AS (SELECT *, json_extract_string(r, '$.origin') IS NOT NULL AS second FROM u)
SELECT reply_id, CAST(n AS INT) AS row_number, nullif(trim(coalesce(json_extract_string(r, '$.pol'), json_extract_string(r, '$."Port_of Loading"'), json_extract_string(r, '$.puertoOrigen'), json_extract_string(r, '$.origin'))), '') AS origin_port,
  CASE WHEN NOT second THEN 'Moin' END AS port_of_exit, CASE WHEN second THEN 'San Jose' END AS destination_port, CASE WHEN second THEN '20' ELSE '40HC' END AS container_type, CASE WHEN second THEN 'EUR' ELSE 'USD' END AS currency,
  CASE WHEN NOT second THEN 14 END AS free_days, CASE WHEN second THEN 8 END AS transit_days, CAST(regexp_replace(json_extract_string(r, '$.oceanFreight'), '[^0-9]', '', 'g') AS DOUBLE) AS ocean_freight,
  -CAST(replace(trim(json_extract_string(r, '$.cost'), '()'), ',', '.') AS DOUBLE) AS total_cost, CAST(json_extract_string(r, '$.totalSale') AS DOUBLE) AS total_sale, DATE '2026-08-01' AS valid_from,
  CASE WHEN second THEN DATE '2026-08-15' ELSE try_cast(json_extract_string(r, '$.validTo') AS DATE) END AS valid_to FROM f""")
def reply_rates(spark, sf_dir):
    """Typed rates out of replies in eight shapes."""
    read = replies.read_replies(dealt(made(spark, sf_dir, REPLIES, "orders"), "reply_id"))
    rows = replies.reply_rows(read, 2026)
    money = [F.col(c).cast("double").alias(c) for c in ("ocean_freight", "total_cost", "total_sale")]
    return rows.select("reply_id", "row_number", "origin_port", "port_of_exit", "destination_port", "container_type", "currency", "free_days", "transit_days", *money, "valid_from", "valid_to")


#: Mails as text and HTML: an offer below a request, in HTML only, as a table of one cell a line, below an old offer, or none.
THREADS = """WITH o AS (SELECT o_orderkey AS k, CAST(o_orderkey % 5 AS INT) AS kind, chr(10) AS nl, 'Pls consider the rate USD ' || CAST(1000 + o_orderkey % 900 AS STRING) || ' per 40HC' AS head FROM {orders}),
  p AS (SELECT *, 'space is tight' || nl || '> ' || head || nl || 'with validity 31/08/2026' || nl || 'POL: Shanghai /' || nl || 'Ningbo' || nl || 'POD: Moin' AS offer, 'Please quote' || nl || 'POL: X' || nl || 'POD: Y 40HC' AS request,
    'Please consider rate USD 7 POL: A POD: B carrier validity 40HC' AS old FROM o)
SELECT k AS message_id, CASE kind WHEN 0 THEN request || nl || 'From: bob' || nl || offer || nl || 'Regards' || nl || 'Bob USD 9' || nl || 'Sent: today' || nl || old || nl || old
  WHEN 1 THEN request WHEN 2 THEN 'Dear all' || nl || '___' || nl || 'POL' || nl || 'POD' || nl || 'Carrier' || nl || '40HC' || nl || 'Validity' || nl || 'Sha' || nl || 'Moin' || nl || 'MSC' || nl || 'USD ' || CAST(k AS STRING) || nl || '1-Aug'
  WHEN 3 THEN 'On Monday bob wrote:' || nl || 'see below' END AS body_text,
  CASE kind WHEN 1 THEN '<style>p</style><p>Hi &amp; bye</p><div>' || replace(offer, nl, '<br>') || '</div>' WHEN 2 THEN '<p>' || old || '</p><p>' || old || '</p>' WHEN 3 THEN '<table><tr><td>POL</td><td>POD</td><td>USD&nbsp;5 ' || CAST(k AS STRING) || '</td></tr></table>' WHEN 4 THEN CASE WHEN k % 2 = 0 THEN ' ' END END AS body_html FROM p"""


@query(rf"""WITH m AS ({plain(THREADS)}), o AS (SELECT o_orderkey AS k, o_orderkey % 5 AS kind FROM orders),
c AS (SELECT message_id, kind, CASE kind WHEN 1 THEN regexp_replace(regexp_replace(body_html, '.*<div>', ''), '</div>.*', '') WHEN 0 THEN regexp_extract(body_text, '(space is tight[^$]*?)\nRegards', 1) END AS offer, body_text, body_html FROM m JOIN o ON k = message_id),
f AS (SELECT message_id, kind, CASE WHEN kind < 2 THEN regexp_replace(replace(replace(replace(replace(replace(offer, '<br>', chr(10)), '> ', ''), chr(10) || 'with', ' with'), '/' || chr(10), '/'), chr(10) || chr(10), chr(10)), '\s+$', '')
  WHEN kind = 2 THEN regexp_extract(body_text, '(POL\n[^$]*)$', 1) WHEN kind = 3 THEN 'POL POD USD 5 ' || CAST(message_id AS VARCHAR) ELSE '' END AS body FROM c)
SELECT message_id, CASE WHEN kind IN (0, 2) THEN 'text' WHEN kind IN (1, 3) THEN 'html' END AS source, body, CAST(CASE WHEN kind < 4 THEN
  8 * least(12, len(regexp_extract_all(body, 'USD [0-9]'))) + 14 * (body LIKE '%POL%')::INT + 14 * (body LIKE '%POD%')::INT + 8 * (body LIKE '%Carrier%')::INT + 10 * (body LIKE '%40HC%')::INT + 10 * (lower(body) LIKE '%validity%')::INT
  + 140 * (body LIKE '%consider the rate%')::INT + 8 * (body LIKE '%POL:%')::INT + 8 * (body LIKE '%POD:%')::INT ELSE 0 END AS INT) AS score FROM f""")
def thread_bodies(spark, sf_dir):
    """The offer in each mail, out of its text or HTML and its thread."""
    return bodies.preferred_bodies(dealt(made(spark, sf_dir, THREADS, "orders"), "message_id"))


@query(f"""WITH r AS ({ORACLE_SQL["reply_rates"]}),
b AS (SELECT reply_id, row_number AS n, concat_ws(',', coalesce(origin_port, ''), coalesce(port_of_exit, ''), coalesce(destination_port, ''), CASE container_type WHEN '20' THEN '20DV' ELSE container_type END, '', '', '', currency,
  coalesce(CAST(free_days AS VARCHAR), ''), coalesce(CAST(transit_days AS VARCHAR), ''), coalesce(strftime(valid_from, '%Y-%m-%d'), ''), coalesce(strftime(valid_to, '%Y-%m-%d'), ''),
  CASE WHEN ocean_freight IS NULL THEN '' ELSE CAST(CAST(ocean_freight AS INT) AS VARCHAR) END, '', '', '', CASE WHEN total_cost IS NULL THEN '' ELSE CAST(CAST(total_cost AS DECIMAL(18,1)) AS VARCHAR) END,
  CASE WHEN total_sale IS NULL THEN '' ELSE CAST(CAST(total_sale AS DECIMAL(18,1)) AS VARCHAR) END, '', '', '', CASE WHEN reply_id % 8 IN (0, 2) THEN 'AI warnings: late | early' ELSE '' END) AS line FROM r)
SELECT reply_id, CAST(n AS INT) AS pos, line FROM b
UNION ALL SELECT DISTINCT reply_id, 0, 'POL,POE,POD,Equipo,Naviera,Agente,Commodity,Moneda,Dias Libres,Dias Transito,Valid From,Valid To,Ocean Freight,Origin Charges,Destination Charges,Surcharges,Total Cost,Total Sale,Profit,Margin,Space,Remarks' FROM b""")
def reply_lines(spark, sf_dir):
    """Rates of replies as lines of a normalised file."""
    read = replies.read_replies(dealt(made(spark, sf_dir, REPLIES, "orders"), "reply_id"))
    return sinks.rate_lines(replies.reply_rows(read, 2026))


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'Failed' WHEN o_orderkey % 3 = 0 THEN 'Pending' WHEN o_orderkey % 5 = 0 AND o_orderkey % 7 > 1 THEN 'Failed' WHEN o_orderkey % 5 = 0 THEN 'Pending' ELSE 'Processed' END AS status,
CAST(CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 3 = 0 OR o_orderkey % 5 > 0 THEN o_orderkey % 7 ELSE o_orderkey % 7 + 1 END AS INT) AS retry_count, CASE WHEN o_orderkey % 4 > 0 AND o_orderkey % 3 > 0 AND o_orderkey % 5 = 0 THEN 'no ' || o_orderpriority END AS error_message,
CASE WHEN o_orderkey % 4 > 0 AND o_orderkey % 3 > 0 AND o_orderkey % 5 > 0 THEN TIMESTAMP '1998-06-01 00:00:00' END AS processed_at, '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS payload_json FROM orders""")
def outbox_round(spark, sf_dir):
    """An outbox after a round of publishing: a third without result, a fifth of the rest refused, a quarter failed before."""
    orders = table(spark, sf_dir, "orders")
    box = sinks.integration_events(orders, "RatesExtracted", "integration", ["o_orderkey"], ["o_orderkey", "o_orderstatus"], "o_orderkey", F.col("o_orderdate").cast("timestamp"))
    k = F.col("correlation_id").cast("long")
    box = box.withColumn("status", F.when(k % 4 == 0, "Failed").otherwise("Pending")).withColumn("retry_count", (k % 7).cast("int"))
    results = box.join(orders, k == F.col("o_orderkey")).filter(k % 3 > 0).select("event_id", F.when(k % 5 == 0, F.concat(F.lit("no "), "o_orderpriority")).alias("error"))
    out = sinks.after_publishing(box, results, now())
    return out.select(k.alias("k"), "status", "retry_count", "error_message", F.col("processed_at").cast("timestamp_ntz").alias("processed_at"), "payload_json")


#: Workbooks of a customer each: a sheet of notes, and one whose rows are orders, with a second block to the right of the first.
GRIDS = """WITH o AS (SELECT o_custkey AS d, o_orderkey AS k, 3 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM {orders}), d AS (SELECT DISTINCT d FROM o),
  v AS (SELECT d, sheet, rw, cl, txt FROM d CROSS JOIN (VALUES (0, 1, 1, 'Vigencia 08 al 14 de agosto 2026'), (0, 2, 1, 'IVA 13%'), (0, 2, 2, 'Mínimo de 7 días'), (1, 1, 2, 'Tarifas'), (1, 3, 1, 'Región'), (1, 3, 2, 'POL'), (1, 3, 3, '20'''), (1, 3, 4, '40''HC'), (1, 3, 5, 'Notas'), (1, 3, 6, 'POL'), (1, 3, 7, '40HC')) AS t (sheet, rw, cl, txt)
    WHERE NOT (d % 7 = 0 AND cl IN (2, 6) AND sheet = 1)),
  b AS (SELECT d, 1 AS sheet, r AS rw, cl, CASE cl WHEN 1 THEN 'Asia' WHEN 2 THEN CASE WHEN k % 11 = 0 THEN ' ' ELSE ' P' || CAST(k AS STRING) END WHEN 3 THEN CASE WHEN k % 5 = 0 THEN 'n/a' ELSE '$' || CAST(1000 + k % 900 AS STRING) END
    WHEN 4 THEN CASE WHEN k % 3 = 0 THEN '-' ELSE CAST(2000 + k % 700 AS STRING) END ELSE '99' END AS txt FROM o CROSS JOIN (VALUES (1), (2), (3), (4), (6), (7)) AS t (cl))
SELECT d AS doc_id, CASE d % 4 WHEN 0 THEN 'MSK DT via Moin.xlsx' WHEN 1 THEN 'HPL Caldera.xlsx' WHEN 2 THEN 'Caldera.xlsx' ELSE 'ONE Colon.xlsx' END AS file_name, CAST(sheet AS INT) AS sheet, CASE sheet WHEN 0 THEN 'Notas' ELSE 'FCL' END AS sheet_name,
  CAST(rw AS INT) AS row, CAST(cl AS INT) AS col, txt AS text FROM (SELECT * FROM v UNION ALL SELECT d, sheet, CAST(rw AS INT), cl, txt FROM b) AS u"""


@query("""WITH o AS (SELECT o_custkey AS d, o_orderkey AS k, CAST(3 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS r FROM orders),
h AS (SELECT d AS doc_id, r AS row_number, d % 4 AS kind, 'P' || k AS pol, CASE WHEN k % 5 > 0 THEN '$' || (1000 + k % 900) END AS a, CASE WHEN k % 3 > 0 THEN CAST(2000 + k % 700 AS VARCHAR) END AS b FROM o WHERE d % 7 > 0 AND d % 4 <> 2 AND k % 11 > 0),
c AS (SELECT *, CASE kind WHEN 0 THEN 'Moín' WHEN 1 THEN 'Puerto Caldera' ELSE 'Colón' END AS poe FROM h WHERE a IS NOT NULL OR b IS NOT NULL),
u AS (SELECT doc_id, row_number, unnest(['POL', 'POE', 'Carrier', 'Currency', 'ValidFrom', 'ValidTo', '20''', '40''HC', 'RouteMode', 'Remarks']) AS header, unnest([pol, poe, CASE kind WHEN 0 THEN 'Maersk' WHEN 1 THEN 'Hapag-Lloyd' ELSE 'ONE' END, 'USD', '2026-08-08', '2026-08-14', a, b, CASE WHEN kind = 0 THEN 'Diamond Tier' ELSE 'Marítimo' END,
  'Tarifa ' || CASE WHEN kind = 0 THEN 'Diamond Tier' ELSE 'marítima' END || ' vía ' || poe || '. Vigencia obtenida del encabezado del XLSX. Condiciones: cargos locales sujetos al 13% de IVA' || CASE WHEN kind = 0 THEN '; reservar como mínimo 7 días antes del ETA del buque' ELSE '' END || '.']) AS value FROM c)
SELECT * FROM u WHERE value IS NOT NULL""")
def grid_tariffs(spark, sf_dir):
    """Rates of workbooks that state carrier, port and validity beside the table."""
    cells = made(spark, sf_dir, GRIDS, "orders")
    return grids.tariff_grids(cells, sheets.default_mappings(spark), now().cast("date")).select("doc_id", "row_number", "header", "value")


#: Mails with an offer in a sentence, and routes below it.
OFFERS = """WITH o AS (SELECT o_orderkey AS k, CAST(o_orderkey % 4 AS INT) AS kind, CAST(1000 + o_orderkey % 900 AS STRING) AS a FROM {orders}),
  l AS (SELECT k, pos, CASE pos WHEN 0 THEN 'Dear all' WHEN 1 THEN CASE kind WHEN 0 THEN 'Pls consider rate USD' || a || '/1,950 valid 15-21 Aug 2026, Carrier MSC/ONE NAC, with 21 days free (except P' || CAST(k % 50 AS STRING) || ')' WHEN 1 THEN 'Please consider rate HPL USD ' || a || ' PIL NAC $77 valid 28 Aug - 3 Sep with 7 days free'
      WHEN 2 THEN 'Pls consider rate USD ' || a || ' valid soon, Carrier MSC, with 21 days free' ELSE 'pls consider rate USD ' || a || ' per 20GP valid 1-5 Sep Carrier ONE with 9 days free' END
    WHEN 2 THEN 'POL: P' || CAST(k % 50 AS STRING) || '/Q' || CAST(k % 7 AS STRING) || ' (+arb USD 50), R1' WHEN 3 THEN 'POD: Moin; Caldera; moin' WHEN 4 THEN 'COMM: FAK' WHEN 5 THEN 'B)' WHEN 6 THEN 'POL: S1' WHEN 7 THEN CASE WHEN k % 3 > 0 THEN 'POD: Limon' ELSE 'none' END
    WHEN 8 THEN 'Subject to PCS USD 297/cntr, EPR $28.50/container.' WHEN 9 THEN 'Regards' ELSE 'POL: T, old rate per 40HQ' END AS text
  FROM o CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10)) AS v (pos))
SELECT k AS doc_id, CAST(pos AS INT) AS pos, text FROM l"""


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 4 AS kind, o_orderkey % 3 > 0 AS more, CAST(1000 + o_orderkey % 900 AS VARCHAR) AS a, 'P' || o_orderkey % 50 AS p, 'Q' || o_orderkey % 7 AS q FROM orders),
r AS (
  SELECT k, 1 AS c, 1 AS g, 'MSC' AS carrier, 'R1/' || q || CASE WHEN more THEN '/S1' ELSE '' END AS pol, 'Moin/Caldera' || CASE WHEN more THEN '/Limon' ELSE '' END AS poe, NULL AS commodity, a AS amount, NULL AS charge FROM o WHERE kind = 0
  UNION ALL SELECT k, CASE c WHEN 'HPL' THEN 1 ELSE 2 END, 1, CASE c WHEN 'HPL' THEN 'HAPAG-LLOYD' ELSE c END, p || '/R1/' || q || CASE WHEN more THEN '/S1' ELSE '' END, 'Moin/Caldera' || CASE WHEN more THEN '/Limon' ELSE '' END, NULL, CASE c WHEN 'HPL' THEN a ELSE '77' END, NULL FROM o, (VALUES ('HPL'), ('PIL')) v(c) WHERE kind = 1
  UNION ALL SELECT k, 2, 1, 'ONE', p || '/R1', 'Moin/Caldera', 'FAK', CASE kind WHEN 0 THEN '1950' ELSE a END, NULL FROM o WHERE kind IN (0, 3)
  UNION ALL SELECT k, 2, 2, 'ONE', q, 'Moin/Caldera', 'FAK', CASE kind WHEN 0 THEN '1950' ELSE a END, '50' FROM o WHERE kind IN (0, 3)
  UNION ALL SELECT k, 2, 3, 'ONE', 'S1', 'Limon', NULL, CASE kind WHEN 0 THEN '1950' ELSE a END, NULL FROM o WHERE kind IN (0, 3) AND more)
SELECT k AS doc_id, CAST(row_number() OVER (PARTITION BY k ORDER BY c, g) AS INT) AS row_number, carrier, pol, poe, CASE k % 4 WHEN 3 THEN '20DV' ELSE '40HC' END AS container_size, commodity, amount AS freight_amount, charge AS origin_charges, '325.5' AS surcharges,
  CASE k % 4 WHEN 0 THEN '15 Aug 2026' WHEN 1 THEN '28 Aug' ELSE '1 Sep' END AS valid_from, CASE k % 4 WHEN 0 THEN '21 Aug 2026' WHEN 1 THEN '3 Sep' ELSE '5 Sep' END AS valid_to, CASE k % 4 WHEN 0 THEN '21' WHEN 1 THEN '7' ELSE '9' END AS free_days FROM r""")
def narrative_offers(spark, sf_dir):
    """Rates of offers told in sentences, in three wordings; a fourth lacks a validity."""
    lines = dealt(made(spark, sf_dir, OFFERS, "orders"), "doc_id")
    return narratives.narrative_rates(lines).drop("currency", "remarks")

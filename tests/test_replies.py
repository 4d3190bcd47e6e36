"""Rates in replies of a model."""

import decimal

from pyspark.sql import functions as F

from lading.operators import replies

ROW = '{"pol":"A","rate":5}'


def read(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "reply_id int, content string")
    return replies.read_replies(df).orderBy("reply_id").collect()


def test_envelopes(spark):
    as_text = lambda t: '"' + t.replace("\\", "\\\\").replace('"', '\\"') + '"'
    good = [ROW, f"[{ROW},1,null]", f'{{"rows":[{ROW}]}}', f"```json\n{ROW}\n```", as_text(ROW), as_text(as_text(ROW)), f'{{"data":{{"result":{{"output":{{"Tariffs":{ROW}}}}}}}}}', f'{{"content":{as_text(ROW)}}}', f'{{"items":{{"records":[{ROW}]}}}}', f'{{"x":1,"payload":[{ROW}]}}', f'{{"rows":{as_text("[" + ROW + "]")}}}']
    bad = [None, "", "  ", "no json", '{"rows":[', '{"rows":[1,2]}', '{"a":1}', "7", as_text(as_text(as_text(ROW))), '{"pol":1,"pol":2}', "```"]
    got = read(spark, *good, *bad)
    assert [r["rows"] for r in got] == [[ROW]] * len(good) + [[]] * len(bad)
    assert [r["success"] for r in got] == [True] * len(good) + [False] * len(bad)


def test_what_a_reply_says_of_itself(spark):
    got = read(spark, f'{{"rows":[{ROW}],"confianza":"0,75","issues":["a"," ",1,"a","b"],"ok":"false"}}', f'{{"rows":[{ROW}],"score":250,"warning":" w ","success":1}}', f'{{"rows":[{ROW}],"confidence":-3}}', f'{{"rows":[{ROW * 1}{("," + ROW) * 150}]}}')
    assert [(r["confidence"], r["warnings"], r["declared"]) for r in got] == [(75.0, ["a", "b"], False), (100.0, ["w"], True), (0.0, [], None), (0.0, [], None)]
    assert len(got[3]["rows"]) == replies.MOST_ROWS


def test_fields_by_their_first_name(spark):
    rows = ['{"origin":" ","pol":"B","Ocean-Rate":"EUR 1.234,5","transit":"about 12 days","freeDays":7.5,"destination":true,"margin":0.125}', '{"rate":5,"oceanFreight":6,"currency":"CRC","validFrom":"1 Aug 2026","validTo":"bad","validity":"15-21 Aug"}']
    out = replies.reply_rows(replies.read_replies(spark.createDataFrame([(1, "[" + ",".join(rows) + "]")], "reply_id int, content string")), 2026).orderBy("row_number").collect()
    a, b = out
    assert (a["origin_port"], a["port_of_exit"], a["currency"], a["ocean_freight"], a["transit_days"], a["free_days"], a["margin"]) == (None, None, "EUR", decimal.Decimal("1234.5"), 12, 8, decimal.Decimal("0.125"))
    assert (b["ocean_freight"], b["currency"], str(b["valid_from"]), str(b["valid_to"])) == (5, "CRC", "2026-08-01", "2026-08-21")


def test_flexible_numbers(spark):
    want = {"1,5": "1.5", "1,50": "1.5", "1,500": "1500", "1.500": "1500", "1.50": "1.5", "1.234.567": "1234.567", "1.234,56": "1234.56", "1,234.56": "1234.56", "(12)": "-12", "USD -3.5": "-3.5", "x": None, "": None, "-": None, "1-2": None, "12,": "12"}
    df = spark.createDataFrame([(k,) for k in want], "t string")
    got = {r["t"]: r["n"] for r in df.select("t", replies.flexible_decimal(F.col("t")).alias("n")).collect()}
    assert got == {k: None if v is None else decimal.Decimal(v) for k, v in want.items()}


def test_events_and_ids(spark):
    u = "0f8fad5b-d9cb-469f-a165-70867728950e"
    texts = {f'{{"Id":"{u}"}}': u, f'"{u.upper()}"': u, f'{{"data":{{"importBatchId":"{u}"}},"id":"x"}}': u, f'{{"result":"{u}"}}': u, '{"id":5}': None, "": None, "bad": None, u.replace("-", ""): u}
    df = spark.createDataFrame([(k,) for k in texts], "t string")
    assert {r["t"]: r["i"] for r in df.select("t", replies.batch_id(F.col("t")).alias("i")).collect()} == texts
    events = {'{"Payload":{"a":1},"data":{"b":2}}': '{"a":1}', '{"payload":"text","eventData":{"c":3}}': '{"c":3}', '{"x":1}': '{"x":1}', "[1]": "[1]"}
    df = spark.createDataFrame([(k,) for k in events], "t string")
    assert {r["t"]: r["p"] for r in df.select("t", replies.event_payload(F.col("t")).alias("p")).collect()} == events


def test_predicates(spark):
    df = replies.reply_rows(replies.read_replies(spark.createDataFrame([(1, '[{"pol":"A","poe":"B","rate":1},{"pol":"A"},{"notes":"x"},{"poe":"B","sale":2}]')], "reply_id int, content string")), 2026)
    got = df.orderBy("row_number").select(replies.has_rate().alias("r"), replies.is_usable().alias("u")).collect()
    assert [tuple(x) for x in got] == [(True, True), (True, False), (False, False), (True, False)]

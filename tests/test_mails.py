import itertools

from pyspark.sql import functions as F

from lading.functions.values import container
from lading.operators import agents, linetables, mailbox, records, selection, sheets
from lading.sources import mail


def test_every_default_heading(spark):
    fields = sheets.default_fields()
    assert len(fields) == 255
    assert (fields["bunker"], fields["freightcost"], fields["thcd"], fields["releasecosto"], fields["transshipmentport"]) == ("BunkerCost", "OceanFreight", "DestinationThcCost", "AgentReleaseCost", "PortOfExit")
    assert fields["allin"] == fields["allinventa"] == "AllInSale" and fields["carouselsale"] == "CarouselSale"
    row = spark.createDataFrame([("45 High Cube Container",)], "c string").select(container(F.col("c")).alias("c")).first()
    assert row["c"] == "45HC"


def test_currency_with_a_size_and_one_day_validity(spark):
    cells = spark.createDataFrame([(1, 0, "Moneda 20'", "EUR"), (1, 1, "Naviera", "MSC")], "k int, pos int, header string, value string")
    assert sheets.cells_to_rows(cells, sheets.default_mappings(spark), ["k"]).first()["fields"] == {"Currency": "EUR", "Carrier": "MSC"}
    df = spark.createDataFrame([({"Remarks": "weekly."}, " 3 May "), ({"ValidFrom": "x"}, None), ({}, "4 May")], "fields map<string,string>, etd string")
    got = [r["f"] for r in df.select(sheets.one_day_validity(F.col("fields"), F.col("etd")).alias("f")).collect()]
    assert got == [{"ValidFrom": "3 May", "ValidTo": "3 May", "Remarks": f"weekly. {sheets.ETD_NOTE}"}, {"ValidFrom": "x"}, {"ValidFrom": "4 May", "ValidTo": "4 May", "Remarks": sheets.ETD_NOTE}]


def test_agents(spark):
    names = spark.createDataFrame([("1", "Pacific Cargo Logistics S.A.", ["PCL"]), ("2", "Atlantic Freight, Ltda.", None), ("3", "Atlantic Freighz", None)], "agent_id string, name string, aliases array<string>")
    mails = [(1, "Rates PCL week 3", "x"), (2, "update", "from pcl"), (3, "Re: Pacfic Cargo Logistics", ""), (4, None, "the Pacific&nbsp;Cargo Logistics team"), (5, "Atlantic Freight", ""), (6, "nothing", None)]
    got = {r["message_id"]: (r["agent_id"], r["found_in"]) for r in agents.resolve_messages(spark.createDataFrame(mails, "message_id int, subject string, body string"), names).collect()}
    assert got == {1: ("1", "subject"), 3: ("1", "subject"), 4: ("1", "body"), 5: ("2", "subject")}


def test_tables_in_lines(spark):
    text = {
        1: "Hello\nPOL\tPOD\tCarrier\t40HC\nShanghai\tMoin\tMSC\t100\nPage 1 of 2\nNingbo\tCaldera\tONE\t90\textra\n\nPOL\tPOD\tCarrier\t40HC\nno\tno\tno\tno",
        2: "POL\nPOD\nCarrier\nRate\nShanghai\nMoin\nMSC\n100\nNingbo\nCaldera\nRegards\nx",
        3: "POL: Shanghai\nPOD: Moin\nCarrier: MSC\nRate: 100\nPOL: Ningbo\nRate: 3\n",
        4: "no table at all",
        5: None,
    }
    lines = linetables.text_lines(spark.createDataFrame(list(text.items()), "doc_id int, text string"))
    got = linetables.mail_tables(lines, sheets.default_mappings(spark)).orderBy("doc_id", "row_number", "pos").collect()
    rows = {k: [r["value"] for r in v] for k, v in itertools.groupby(got, lambda r: (r["doc_id"], r["parser"], r["row_number"]))}
    assert rows == {(1, "delimited", 1): ["Shanghai", "Moin", "MSC", "100"], (1, "delimited", 2): ["Ningbo", "Caldera", "ONE", "90 extra"], (2, "stacked", 1): ["Shanghai", "Moin", "MSC", "100"], (3, "pairs", 1): ["Shanghai", "Moin", "MSC", "100"]}


def test_two_results_and_records_without_fields(spark):
    a = spark.createDataFrame([(1, 10, 0.5), (2, 10, 0.5), (3, 10, 0.5), (4, 1, 0.0)], "execution_id int, quality long, blocking_ratio double")
    b = spark.createDataFrame([(1, 5, 0.1), (2, 11, 0.5), (3, 10, 0.5), (5, 1, 1.0)], "execution_id int, quality long, blocking_ratio double")
    assert {r[0]: r[1] for r in selection.better(a, b).collect()} == {1: True, 2: True, 3: False, 4: False, 5: True}
    none = records.price_records(spark.createDataFrame([(1, None), (2, {})], "k int, fields map<string,string>"), 2026).collect()
    assert all(r["currency"] == "USD" and r["total_cost"] is None and r["margin"] is None for r in none)
    known = spark.createDataFrame([("moin", "7", "Moín")], "value string, item_id string, name string")
    got = records.apply_catalog(spark.createDataFrame([("moin",), ("x",), (None,)], "port string"), "port", known).collect()
    assert {(r["port"], r["port_ref"]) for r in got} == {("Moín", "7"), ("x", None), (None, None)}


def test_pages_of_rows(spark):
    rows = spark.range(250).withColumn("is_deleted", F.col("id") % 2 == 0)
    page, total = mailbox.page(mailbox.live(rows), [F.col("id")], 2, 1000)
    assert [r["id"] for r in page.collect()][:2] == [201, 203] and total.first()["total"] == 125
    assert mailbox.page(rows, [F.col("id")], 0, 0)[0].count() == 1


def test_tariff_hints(spark):
    from lading.operators import tariffs

    rows = [("a.xlsx", "One rate, COSCO", "2026-03-01"), ("WHL.xlsx", "MSC 3 a 9 dec", "2026-03-01"), ("x", "Del 08 al 14 de AGOSTO 2025 vía Limón DT", "2026-03-01"), ("x", "5 al 6 enero", "2026-11-28"), ("x", "9 al 3 de mayo", "2026-03-01"), (None, None, "2026-03-01")]
    df = spark.createDataFrame(rows, "name string, text string, now string").withColumn("now", F.to_date("now"))
    v = tariffs.tariff_validity(F.col("text"), F.col("now"))
    got = df.select(tariffs.tariff_carrier(F.col("name"), F.col("text")), tariffs.tariff_exit(F.col("name"), F.col("text")), v["start"].cast("string"), v["end"].cast("string"), tariffs.route_mode(F.col("text"))).collect()
    sea = "Marítimo"
    assert [tuple(r) for r in got] == [("ONE", None, None, None, sea), ("Wan Hai", None, "2025-12-03", "2025-12-09", sea), (None, "Puerto Limón", "2025-08-08", "2025-08-14", "Diamond Tier"), (None, None, "2027-01-05", "2027-01-06", sea), (None, None, None, None, sea), (None, None, None, None, sea)]


def test_long_mail_bodies_are_whole(monkeypatch):
    rows = "rate 1 USD\n" * 150_000
    assert mail.parse(("Subject: x\nContent-Type: text/html\n\n" + rows).encode())["body_html"].count("rate 1 USD") == 150_000

    def broken(*args, **kw):
        raise ValueError

    monkeypatch.setattr(mail.email, "message_from_bytes", broken)
    got = mail.parse(("first\n" + ("A" * 76 + "\n") * 20_000 + "last\n").encode())["body_text"]
    assert got == "first\n[contenido binario MIME omitido]\nlast\n"
    got = mail.parse(rows.encode())["body_text"]
    assert got.startswith("rate 1 USD\n") and got.endswith("\n[contenido MIME truncado; el original se conserva como correo bruto]")

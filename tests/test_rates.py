import datetime
import io
import zipfile
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from lading import mail_queries, page_queries, queries
from lading.functions import text as tx
from lading.functions import values as v
from lading.operators import records, resolution, sheets
from lading.sources import delimited, mail, workbook

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def each(spark, f, xs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string").select("i", f(F.col("x")).alias("y")).orderBy("i").collect()
    return [r["y"] for r in rows]


def test_money(spark):
    xs = ["$8 108,00", "USD 30,000.00 por contenedor", "18-21 tons - USD 200/20'", "$6,560", "$8 108,00 $8 316,00 $8 316,00", "USD 999999999999999999999.00", "399999999999999", "(12.50)", "1.234,50", "-", "", None]
    got = [None if y is None else float(y) for y in each(spark, v.money, xs)]
    assert got == [8108, 30000, 200, 6560, 8108, None, None, -12.5, 1234.5, None, None, None]


def test_currency(spark):
    assert each(spark, v.currency, [None, "", "$6,430", "US$", "EUR", "€ 1.200", "₡ 1000", "RMB"]) == ["USD", "USD", "USD", "USD", "EUR", "EUR", "CRC", "CNY"]
    assert each(spark, lambda c: v.currency(c, None), ["6,430", ""]) == [None, None]


def test_dates(spark):
    d = datetime.date
    assert each(spark, lambda c: v.date(c, 2026), ["14", "2026-08-15", "15 Aug", "14 ago", "20 agosto", "45000", "08/10/2026", "x", None]) == [None, d(2026, 8, 15), d(2026, 8, 15), d(2026, 8, 14), d(2026, 8, 20), d(2023, 3, 15), d(2026, 10, 8), None, None]
    got = each(spark, lambda c: v.date_range(c, 2026), ["15 Aug-21 Aug", "15-21 Aug", "2026-08-01 - 2026-08-31", "01-Aug-2026 31-Aug-2026"])
    assert [tuple(r) for r in got] == [(d(2026, 8, 15), d(2026, 8, 21))] * 2 + [(d(2026, 8, 1), d(2026, 8, 31))] * 2


def test_names(spark):
    assert each(spark, v.containers, ["40'/40HC", "40SV y 40HQ", "40DV/HC", "40 DV/HC", "40GP & HC", "20' / 40ST / 40HC", "POL", None]) == [["40DV", "40HC"]] * 5 + [["20DV", "40DV", "40HC"], [], []]
    assert each(spark, v.carrier, ["MSC FAK", "MSC Basket", "ONE FAK", None]) == ["MSC", "MSC", "ONE", None]
    assert each(spark, v.port, ["SZN", "XMN", "TSN", "DLN", "Acajulta"]) == ["SHENZHEN", "XIAMEN", "TIANJIN (XINGANG)", "DALIAN", "ACAJUTLA"]
    assert each(spark, sheets.places, ["Asia base ports", "A/B y C"]) == [list(v.BASE_PORTS), ["A", "B", "C"]]
    assert each(spark, tx.subject, ["RV: A FALLS// B CONTRACT ONE-MSC / AUG"]) == ["A FALLS | B CONTRACT ONE-MSC | AUG"]


def test_shifted_validity(spark):
    r = spark.createDataFrame([("14", "01-Aug-2026 31-Aug-2026"), ("2026-01-01", "2026-02-01")], "a string, b string").select(records.shifted_validity(F.col("a"), F.col("b")).alias("s")).collect()
    assert tuple(r[0]["s"]) == (14, "01-Aug-2026", "31-Aug-2026") and r[1]["s"]["free_days"] is None


def test_resolution(spark):
    catalog = spark.createDataFrame([("1", "Yantian (Shenzhen)", "YTN", ["SHENZHEN PORT"]), ("2", "Puerto Caldera", "CAL", None), ("3", "Puerto de Moín", "MOB", None)], "item_id string, name string, code string, aliases array<string>")
    values = spark.createDataFrame([("ytn",), ("CALDERA",), ("PUERTO CALDRA",), ("nothing",)], "value string")
    got = {r["value"]: (r["item_id"], r["tier"]) for r in resolution.resolve(values, catalog, "port").collect()}
    assert got == {"ytn": ("1", "strict"), "CALDERA": ("2", "contained"), "PUERTO CALDRA": ("2", "fuzzy")}


def test_delimited(spark, tmp_path):
    Path(tmp_path / "a.csv").write_bytes("POL;POD;pol;\nMoín;X;1;y\n;;;\n\"a;b\";;2;z\n".encode("cp1252"))
    got = [(r["row_number"], [(c["header"], c["value"]) for c in r["cells"]]) for r in delimited.read_csv(spark, str(tmp_path)).orderBy("row_number").collect()]
    assert got == [(2, [("POL", "Moín"), ("POD", "X"), ("pol_2", "1")]), (4, [("POL", "a;b"), ("POD", None), ("pol_2", "2")])]
    assert delimited.decode(b"\x4d\x6f\xed\x6e") == "Moín" and delimited.decode("MoÃ­n".encode()) == "Moín"


def test_sheet_to_records(spark, tmp_path):
    Path(tmp_path / "t.csv").write_text("POL,POD,Naviera,20',40'/40HC\nAsia base ports,Colón/Manzanillo,MSC FAK,\"$1,000\",\"$2,000\"\nShanghai,Moín,ONE,-,900\n")
    rows = delimited.read_csv(spark, str(tmp_path))
    fields = sheets.cells_to_rows(delimited.long_cells(rows), sheets.default_mappings(spark), ["doc_id", "row_number"])
    wide = delimited.long_cells(rows).groupBy("doc_id", "row_number").pivot("header", ["20'", "40'/40HC"]).agg(F.first("value"))
    long = sheets.unpivot_containers(wide, ["20'", "40'/40HC"], ["doc_id", "row_number"])
    out = sheets.explode_containers(long.join(fields, ["doc_id", "row_number"]), "heading")
    out = sheets.explode_routes(out.select("heading", "freight", F.col("fields.OriginPort").alias("pol"), F.col("fields.PortOfExit").alias("poe"), F.lit(None).cast("string").alias("pod")))
    got = out.groupBy("heading").count().collect()
    assert {r["heading"]: r["count"] for r in got} == {"20DV": 20, "40DV": 21, "40HC": 21}


def test_mail(spark, tmp_path):
    Path(tmp_path / "m.eml").write_bytes(b"From: a@example.com\r\nSubject: =?utf-8?q?Tarifas_Mo=C3=ADn?=\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=x\r\n\r\n--x\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nhello\r\n--x\r\nContent-Type: text/csv\r\nContent-Disposition: attachment; filename=r.csv\r\n\r\na,b\r\n--x--\r\n")
    Path(tmp_path / "broken.eml").write_bytes(b"\xff\xfe no mime at all")
    got = {r["path"].rsplit("/", 1)[1]: r for r in mail.read_messages(spark, str(tmp_path)).collect()}
    m = got["m.eml"]
    assert m["subject"] == "Tarifas Moín" and m["body_text"].strip() == "hello" and m["attachments"][0]["name"] == "r.csv" and len(got) == 2
    kinds = spark.createDataFrame([("a.XLSX", None, b""), ("b", "text/csv", b""), ("c", None, b"%PDF-1"), ("d", None, b"?")], "n string, t string, c binary").select(mail.file_type(F.col("n"), F.col("t"), F.col("c")).alias("k")).collect()
    assert [r["k"] for r in kinds] == ["Excel", "Csv", "Pdf", "Unknown"]


def test_what_is_no_workbook(spark):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("other.txt", "x")
    df = spark.createDataFrame([("a", None), ("b", bytearray(b"")), ("c", bytearray(b"PK no zip")), ("d", bytearray(raw.getvalue()))], "path string, content binary")
    assert workbook.read_cells(df).count() == 0


def test_workbook(spark):
    raw = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        cell = lambda r, t: f'<c r="{r}" t="inlineStr"><is><t>{t}</t></is></c>'
        z.writestr("xl/worksheets/s.xml", f'<worksheet {ns}><sheetData><row r="1">{cell("A1", "Title")}</row><row r="3">{cell("A3", "POL")}{cell("C3", "POD")}</row><row r="4">{cell("A4", "X")}<c r="C4"><v>5</v></c></row></sheetData></worksheet>')
    df = spark.createDataFrame([("p", bytearray(raw.getvalue()))], "path string, content binary")
    got = workbook.read_cells(df).collect()
    assert [(r["sheet_name"], r["row_number"], [(c["header"], c["value"]) for c in r["cells"]]) for r in got] == [("S", 4, [("POL", "X"), ("POD", "5")])]


PARTS = (queries, mail_queries, page_queries)
QUERIES = {k: v for p in PARTS for k, v in p.QUERIES.items()}
ORACLE_SQL = {k: v for p in PARTS for k, v in p.ORACLE_SQL.items()}


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    if name not in ORACLE_SQL:
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = [tuple(r[i] for i in order) for r in result.fetchall()]
    same = lambda rows: sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)
    assert sorted(names) == sorted(df.columns) and same(got) == same(want)

"""Carrier tariffs in grids of cells."""

import datetime

from pyspark.sql import functions as F

from lading.operators import grids, sheets

SCHEMA = "doc_id int, file_name string, sheet int, sheet_name string, row int, col int, text string"
NAME = "MSC via Caldera 08 al 14 de agosto 2026.xlsx"
HEAD = ["Región", "POL", "20'", "40'HC", "Notas", "POL", "40HC"]


def sheet(rows, doc=1, name=NAME, at=0, title="Rates"):
    return [(doc, name, at, title, r, c, t) for r, line in rows.items() for c, t in enumerate(line, 1)]


def rates(spark, cells):
    as_of = F.lit(datetime.date(2026, 8, 1))
    got = grids.tariff_grids(spark.createDataFrame(cells, SCHEMA), sheets.default_mappings(spark), as_of).orderBy("doc_id", "row_number", "pos").collect()
    out = {}
    for r in got:
        out.setdefault((r["doc_id"], r["sheet_name"], r["row_number"]), []).append((r["header"], r["value"]))
    return out


def test_the_first_block_of_a_sheet(spark):
    rows = {1: ["Tarifas"], 4: HEAD, 5: ["Asia", " Ningbo ", "$1,000", "2000", "", "TAO", "99"], 6: ["", "Shanghai", "n/a", "2100", "x", "", ""], 7: ["", "", "1", "2"], 8: ["", "Xiamen", "-", "n/a", "5", "", "3"]}
    got = rates(spark, sheet({1: ["PCS 297", "IVA 13%"]}, title="Notes") + sheet(rows, at=1))
    said = "Tarifa marítima vía Puerto Caldera. Vigencia obtenida del encabezado del XLSX. Condiciones: PCS de USD 297 por contenedor para cargas que pasan por el Canal de Panamá; cargos locales sujetos al 13% de IVA."
    frame = [("POE", "Puerto Caldera"), ("Carrier", "MSC"), ("Currency", "USD"), ("ValidFrom", "2026-08-08"), ("ValidTo", "2026-08-14")]
    end = [("RouteMode", "Marítimo"), ("Remarks", said)]
    assert got == {(1, "Rates", 5): [("POL", "Ningbo"), *frame, ("20'", "$1,000"), ("40'HC", "2000"), *end], (1, "Rates", 6): [("POL", "Shanghai"), *frame, ("40'HC", "2100"), *end]}


def test_what_is_no_tariff(spark):
    rows = {1: HEAD, 2: ["Asia", "Ningbo", "1", "2"]}
    cells = sheet(rows, 1, "via Caldera 08 al 14 de agosto 2026") + sheet(rows, 2, "MSC 08 al 14 de agosto 2026") + sheet(rows, 3, "MSC Caldera 31 al 2 de agosto")
    cells += sheet({1: ["Origin", "20'", "40HC"], 2: ["Ningbo", "1", "2"]}, 4) + sheet({1: ["POL", "a", "b", "c", "40HC"], 2: ["Ningbo", "1", "2", "3", "4"]}, 5)
    cells += sheet({40: HEAD, 41: rows[2]} | {r: ["x"] for r in range(1, 40)}, 6)  # the head lies too low
    assert rates(spark, cells) == {} and rates(spark, []) == {}


def test_heads_sheets_and_nulls(spark):
    rows = {1: ["a", "b", "c"], 3: ["POL", "40HC", "40hc"], 4: ["Ningbo", "1", "2"], 5: [None, "1", None]}
    cells = sheet({1: HEAD, 2: ["Asia", "", "1", "2"]}, title="First") + sheet(rows, at=1, title="Second") + sheet({1: HEAD, 2: ["Asia", "Sha", "1"]}, at=2, title="Third")
    cells += [(1, NAME, 1, "Second", 9, 9, None), (None, None, 0, None, 1, 1, "x"), (2, None, 0, None, None, None, "POL")]
    got = rates(spark, cells)
    assert list(got) == [(1, "Second", 4)] and [c for c in got[1, "Second", 4] if c[0].lower().startswith("40")] == [("40HC", "1"), ("40hc_2", "2")]


def test_diamond_tier(spark):
    text = "Diamond Tier: mínimo de 7 días, no-show; máximo 21,5"
    got = rates(spark, sheet({1: [text], 2: HEAD, 3: ["Asia", "Ningbo", "1", "2"]}))
    end = dict(got[1, "Rates", 3])["Remarks"]
    assert end.startswith("Tarifa Diamond Tier vía") and end.count(";") == 2 and "21.5" in end and "siguiente zarpe" in end

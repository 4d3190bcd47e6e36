"""Carrier tariffs in the cells of workbooks: the head row, the first block of origins and container columns, and what the
sheets say about all rates.

Cells are ``doc_id, file_name, sheet, sheet_name, row, col, text``; ``sheet`` counts from 0, blank cells count as none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lading.functions.text import fold, header_key
from lading.functions.values import containers, let, money
from lading.operators import tariffs

#: Rows that are searched for a head, cells whose texts describe a workbook, and columns that a block reaches to the right.
HEAD_ROWS, DESCRIBING, REACH = 30, 800, 3
#: Headings of a dictionary that is broadcast.
MOST_KEYS = 100_000
AMOUNT_KEY = "^(20|20gp|20dc|20dv|20std|20ft|20dry|40|40gp|40dc|40dv|40std|40ft|40dry|40hc|40hq|40highcube|45hc|45hq)(usd|eur|crc|rate|rates|freight|flete|tarifa|amount|costo|venta|sale|allin|oceanfreight)?$"
# Words that all occur, or one of which occurs (any), and the condition that they stand for, in order.
CONDITIONS = (
    ("all", ("PCS", "297"), "PCS de USD 297 por contenedor para cargas que pasan por el Canal de Panamá"),
    ("all", ("13%", "IVA"), "cargos locales sujetos al 13% de IVA"),
    ("all", ("NO SE PERMITE MERCHANT",), "los BL deben cortarse a puerto y no se permite merchant"),
    ("all", ("INLAND", "REFERENCIAL"), "el inland a San José es referencial y debe confirmarse"),
    ("all", ("SCT CODE",), "la reserva debe utilizar el SCT Code aplicable"),
    ("all", ("NO SUJETAS AL GFS",), "tarifas no sujetas al GFS"),
    ("all", ("FECHA PROFORMA",), "la tarifa del BL se basa en la fecha proforma del buque en origen"),
    ("all", ("CARGOS LOCALES", "ORIGEN", "DESTINO"), "tarifa sujeta a cargos locales en origen y destino"),
    ("all", ("1000", "DEPOSITO"), "clientes nuevos deben cancelar un depósito de garantía de USD 1,000 por contenedor"),
    ("any", ("21,5", "21.5"), "peso máximo sin recargo de 21.5 toneladas"),
    ("all", ("SOBRE PESO", "150"), "recargo de USD 150 por sobrepeso después de 21.5 toneladas"),
    ("all", ("EPR", "28"), "EPR obligatorio de USD 28 por contenedor"),
    ("any", ("SOBREDIMENSIONADO", "CARGA PELIGROSA"), "no válida para equipo sobredimensionado, carga peligrosa o de alto valor"),
    ("all", ("DISPONIBILIDAD DE ESPACIO",), "sujeta a disponibilidad de espacio y equipo"),
)
# The same for the Diamond Tier only.
TIER_CONDITIONS = (
    ("all", ("MINIMO DE 7 DIAS",), "reservar como mínimo 7 días antes del ETA del buque"),
    ("all", ("PENALIDAD", "500"), "cancelaciones sujetas a penalidad de USD 500 por contenedor según las condiciones Diamond Tier"),
    ("all", ("NO PODRA SER CANCELADO",), "una vez utilizado un beneficio Diamond Tier, el servicio no puede cancelarse y se factura en su totalidad"),
    ("any", ("NO-SHOW", "NO SHOW"), "en caso de no-show, la reserva se transfiere al siguiente zarpe y las demoras son por cuenta del cliente"),
)


def used(cells: DataFrame) -> DataFrame:
    return cells.withColumn("text", F.trim("text")).filter("text <> ''")


def sheet_rows(cells: DataFrame, mappings: DataFrame) -> DataFrame:
    """``doc_id, sheet, row, sheet_name, file_name, score, xs``: a row's cells in order, and how many of them are known or
    amount headings. The rows of a workbook are in one partition, where all that follows finds them."""
    keys = mappings.select("key", F.lit(True).alias("known")).distinct()
    if mappings.limit(MOST_KEYS + 1).count() <= MOST_KEYS:
        keys = F.broadcast(keys)
    known = used(cells).withColumn("key", header_key(F.col("text"))).join(keys, "key", "left")
    # every amount heading has one of these numbers, which most cells don't
    hit = F.coalesce("known", F.lit(False)) | (F.col("key").rlike("20|4[05]") & is_amount_heading(F.col("text")))
    dealt = known.select("doc_id", "file_name", "sheet", "sheet_name", "row", "col", "text", hit.alias("hit")).repartition("doc_id")
    xs = F.array_sort(F.collect_list(F.struct("col", "text")))
    return dealt.groupBy("doc_id", "sheet", "row").agg(F.min("sheet_name").alias("sheet_name"), F.min("file_name").alias("file_name"), F.count_if("hit").alias("score"), xs.alias("xs"))


def remarks(mode: Column, port: Column, text: Column) -> Column:
    """A sentence on route and port, then the conditions that a text names, each once and in their order."""

    def met(upper: Column, kind: str, words: tuple[str, ...]) -> Column:
        found = F.lit(kind == "all")
        for w in words:
            found = found & F.contains(upper, F.lit(w)) if kind == "all" else found | F.contains(upper, F.lit(w))
        return found

    def listed(upper: Column) -> Column:
        plain = [F.when(met(upper, k, w), F.lit(said)) for k, w, said in CONDITIONS]
        tier = [F.when((mode == "Diamond Tier") & met(upper, k, w), F.lit(said)) for k, w, said in TIER_CONDITIONS]
        return F.array_join(F.array_compact(F.array(*plain, *tier)), "; ")

    head = F.when(mode == "Diamond Tier", F.concat(F.lit("Tarifa "), mode)).otherwise("Tarifa marítima")
    opening = F.concat(head, F.lit(" vía "), port, F.lit(". Vigencia obtenida del encabezado del XLSX."))
    said = lambda c: F.when(c == "", opening).otherwise(F.concat(opening, F.lit(" Condiciones: "), c, F.lit(".")))
    return let(F.upper(fold(text)), lambda upper: let(listed(upper), said))


def is_amount_heading(text: Column) -> Column:
    return (F.size(containers(text)) > 0) | header_key(text).rlike(AMOUNT_KEY)


def described(rows: DataFrame) -> DataFrame:
    """``rows`` with ``text`` at the first of each workbook: the file's name, then of each sheet its name and cells, row by
    row, up to ``DESCRIBING`` cells of the workbook; null elsewhere."""
    in_order, sheet = Window.partitionBy("doc_id").orderBy("sheet", "row"), Window.partitionBy("doc_id", "sheet")
    before = F.coalesce(F.sum(F.size("xs")).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before).withColumn("nth", F.row_number().over(in_order)).withColumn("nth_of_sheet", F.row_number().over(sheet.orderBy("row")))
    told = F.col("before") < DESCRIBING
    rows = rows.withColumn("name", F.min(F.when(told, F.col("sheet_name"))).over(sheet))
    none = F.array().cast("array<string>")
    title = F.when(F.col("nth_of_sheet") == 1, F.array(F.coalesce("name", F.lit("")))).otherwise(none)
    lines = F.when(told, F.concat(title, F.transform(F.slice("xs", 1, (F.lit(DESCRIBING) - F.col("before")).cast("int")), lambda x: x["text"])))
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("lines", lines).withColumn("all", F.collect_list("lines").over(whole)).withColumn("file", F.min(F.when(told, F.col("file_name"))).over(whole))
    text = F.array_join(F.concat(F.array(F.coalesce("file", F.lit(""))), F.flatten("all")), "\n")
    return rows.withColumn("text", F.when(F.col("nth") == 1, text)).drop("all", "lines", "before", "file_name", "name")


def said_of_all(file: Column, text: Column, as_of: Column) -> Column:
    """What name and text say of all rates of a workbook; null without carrier, port of exit and validity."""

    def told(t: Column) -> Column:
        first = F.struct(tariffs.tariff_carrier(file, t).alias("carrier"), tariffs.tariff_exit(file, t).alias("exit"), tariffs.tariff_validity(t, as_of).alias("valid"), tariffs.route_mode(t).alias("mode"))
        return let(first, lambda x: F.when(x["carrier"].isNotNull() & x["exit"].isNotNull() & x["valid"].isNotNull(), x.withField("remarks", remarks(x["mode"], x["exit"], t))))

    return F.when(text.isNotNull(), let(text, told))


def block(cols: Column) -> Column:
    """The first block of a head's cells: the column of its first heading POL and the amount headings up to ``REACH`` to the
    right; null if there is none. Repeated headings are numbered."""
    # the dictionary of headings ignores case
    before = lambda c, i: F.size(F.filter(F.slice(cols, 1, i), lambda b: F.lower(b["text"]) == F.lower(c["text"])))
    named = lambda c, i: F.struct(c["col"].alias("col"), let(before(c, i), lambda n: F.when(n > 0, F.concat(c["text"], F.lit("_"), (n + 1).cast("string"))).otherwise(c["text"])).alias("header"))

    def found(heads: Column) -> Column:
        origin = F.get(F.filter(heads, lambda c: header_key(c["header"]) == "pol"), F.lit(0))["col"]
        amounts = lambda o: F.filter(heads, lambda c: (c["col"] > o) & (c["col"] <= o + REACH) & is_amount_heading(c["header"]))
        return let(origin, lambda o: let(F.struct(o.alias("origin"), amounts(o).alias("amounts")), lambda x: F.when(o.isNotNull() & (F.size(x["amounts"]) > 0), x)))

    return let(F.transform(cols, named), found)


def tariff_grids(cells: DataFrame, mappings: DataFrame, as_of: Column) -> DataFrame:
    """Rates of carrier tariffs: ``doc_id, sheet_name, row_number, pos, header, value``.

    For workbooks whose name and texts say carrier, port of exit and validity. A sheet's block begins at its first heading
    POL and takes the amount columns up to three to its right, so further blocks in the row are left out. A row needs an
    origin and one amount. The first sheet that has such rows counts; row numbers are the sheet's. A null text is no cell.
    """
    rows = described(sheet_rows(cells, mappings).filter("doc_id is not null"))
    sheet, doc = Window.partitionBy("doc_id", "sheet"), Window.partitionBy("doc_id")
    # of a sheet's first rows the first with two known or amount headings, else the first with three cells
    rows = rows.withColumn("top", F.min("row").over(sheet))
    head = F.when((F.col("row") < F.col("top") + HEAD_ROWS) & ((F.col("score") >= 2) | (F.size("xs") >= 3)), F.struct((F.col("score") < 2).alias("weak"), "row", "xs"))
    rows = rows.withColumn("h", F.min(head).over(sheet))
    # worked out where a workbook and a sheet begin; a window hands it to the other rows
    rows = rows.withColumn("block", F.when(F.col("nth_of_sheet") == 1, block(F.col("h.xs")))).withColumn("head", F.col("h.row")).withColumn("said", said_of_all(F.col("file"), F.col("text"), as_of)).drop("h", "text", "file")
    rows = rows.withColumn("block", F.first("block", True).over(sheet)).withColumn("said", F.first("said", True).over(doc)).filter("said is not null and block is not null and row > head and sheet is not null")

    def rate(b: Column) -> Column:
        pol = F.array_max(F.transform(F.filter("xs", lambda c: c["col"] == b["origin"]), lambda c: c["text"]))
        heading = lambda c: F.get(F.filter(b["amounts"], lambda a: a["col"] == c["col"]), F.lit(0))["header"]
        near = F.transform(F.filter("xs", lambda c: (c["col"] > b["origin"]) & (c["col"] <= b["origin"] + REACH)), lambda c: F.struct(heading(c).alias("header"), c["text"].alias("value")))
        amounts = F.when(pol.isNotNull(), F.filter(near, lambda a: a["header"].isNotNull() & money(a["value"]).isNotNull()))
        return let(F.struct(pol.alias("pol"), amounts.alias("amounts")), lambda x: F.when(F.size(x["amounts"]) > 0, x))

    rows = rows.select("doc_id", "sheet", "sheet_name", "row", "said", let(F.col("block"), rate).alias("rate"))
    rows = rows.withColumn("first", F.min(F.when(F.col("rate").isNotNull(), F.col("sheet"))).over(doc)).filter("sheet = first and rate is not null")
    cell = lambda name, value: F.struct(F.lit(name).alias("header"), value.alias("value"))
    whole = F.concat(
        F.array(cell("POL", F.col("rate.pol")), cell("POE", F.col("said.exit")), cell("Carrier", F.col("said.carrier")), cell("Currency", F.lit("USD")), cell("ValidFrom", F.col("said.valid.start").cast("string")), cell("ValidTo", F.col("said.valid.end").cast("string"))),
        F.transform("rate.amounts", lambda a: F.struct(a["header"].alias("header"), a["value"].alias("value"))),
        F.array(cell("RouteMode", F.col("said.mode")), cell("Remarks", F.col("said.remarks"))),
    )
    return rows.select("doc_id", "sheet_name", F.col("row").alias("row_number"), F.posexplode(whole).alias("pos", "c")).select("doc_id", "sheet_name", "row_number", "pos", "c.header", "c.value")

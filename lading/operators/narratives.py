"""Offers told in sentences: one line with carriers, amounts and validity, then groups of routes.

Lines are ``doc_id, pos, text``, as ``bodies`` leaves them. The offer's line is read by expressions; the routes below it by a
fold whose state is the open group; carriers and amounts are paired by their places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lading.functions.text import header_key
from lading.functions.values import let

# How an offer, its parts and the end of its message are written.
OFFER = r"(?iu)\b(?:pls|please)\s+consider\s+rate\b"
VALID = r"(?iu)\bvalid\s+(.+?)(?=\s+(?:Carrier|with)\b|\s*,\s*(?:Carrier|with)\b|$)"
FREE = r"(?iu)\b(\d{1,3})\s*days?\s+free\b"
CARRIER_CLAUSE = r"(?iu)\bCarrier\s+(.+?)(?=\s+with\b|\s*,|$)"
CARRIER_AMOUNT = r"(?iu)(MSC|ONE|MSK|MAERSK|HPL|PIL|COSCO|CMA(?:\s*CGM)?|OOCL|WHL)\s*(?:NAC\s*)?(?:USD|US\$|\$)\s*(\d[\d,]*(?:\.\d+)?)"
AMOUNT = r"(?iu)(?:(?:USD|US\$|\$)\s*)?(\d[\d,]*(?:\.\d+)?)"
SIZE_AFTER_BAR = r"(?iu)/\s*(?:20|40|45)\s*['’]?\s*(?:GP|DV|DC|STD|ST|HC|HQ|NOR|RF)?\b"
EQUIPMENT = r"(?iu)\b(20|40|45)\s*['’]?\s*(GP|DV|DC|STD|ST|HC|HQ|NOR|RF)?\b"
EXCEPT = r"(?iu)\bexcept\s+([^)]+)"
PAIR = r"(?iu)^(POL|POD|COMM(?:ODITY)?)\s*:\s*(.+)$"
ENDS = r"(?iu)^(?:Un saludo|Regards|Worldwide Logistics|发件人:|De:|From:)|^[_=-]{8,}$"
ARBITRARY = r"(?iu)\(\s*\+?\s*arb(?:itrary)?\s+(?:USD|US\$|\$)\s*(\d[\d,]*(?:\.\d+)?)\s*\)"
ARBITRARY_USD = r"(?iu)\s*\(\s*\+?\s*arb\s+USD\s*\d+(?:\.\d+)?\s*\)\s*"
EACH_CONTAINER = r"(?iu)(?:USD|US\$|\$)\s*(\d[\d,]*(?:\.\d+)?)\s*/\s*(?:cntr|container)\b"
SHARED_MONTH = r"(?iu)^(\d{1,2})\s*[-–—]\s*(\d{1,2})\s+([A-Za-zÁÉÍÓÚÜÑáéíóúüñ]{3,12})(?:\s+(\d{2,4}))?$"
TWO_DAYS = r"(?iu)^(\d{1,2}\s+\p{L}{3,12}(?:\s+\d{2,4})?)\s*[-–—]\s*(\d{1,2}\s+\p{L}{3,12}(?:\s+\d{2,4})?)$"
#: Lines below an offer without equipment in which its size is looked for, and the size if there is none.
LOOK_AHEAD, USUAL_SIZE = 180, "40HC"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _first_each(items: Column, same=lambda x: F.lower(x)) -> Column:
    """Items without those that were there before, ignoring case."""
    return F.filter(items, lambda x, i: ~F.exists(F.slice(items, 1, i), lambda y: same(y).eqNullSafe(same(x))))


def _parts(text: Column) -> Column:
    bare = F.btrim(F.btrim(text, F.lit(" \t")), F.lit(".;,"))
    return F.filter(F.transform(F.split(bare, "[/;,]"), lambda x: F.trim(x)), lambda x: x != "")


def _port(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, ARBITRARY_USD, ""))


def carrier_name(text: Column) -> Column:
    clean = F.upper(F.trim(F.regexp_replace(F.trim(text), r"(?iu)\b(?:NAC|FAK|BASKET)\b", "")))
    return F.when(clean.isin("MSK", "MAERSK"), "MAERSK").when(clean.isin("CMA", "CMA CGM"), "CMA CGM").when(clean == "HPL", "HAPAG-LLOYD").otherwise(clean)


def equipment(text: Column) -> Column:
    size, kind = _found(text, EQUIPMENT, 1), F.upper(F.regexp_extract(text, EQUIPMENT, 2))
    high = kind.isin("HC", "HQ")
    return F.when(size == "20", F.when(high, "20HC").otherwise("20DV")).when(size == "45", "45HC").when(size == "40", F.when(high, "40HC").otherwise("40DV"))


def carrier_amounts(line: Column) -> Column:
    """``(carrier, amount)`` of an offer's line: named together, else the carriers of its clause with its amounts by place;
    the last amount goes on for carriers beyond it."""
    before = F.regexp_replace(F.substring_index(F.regexp_replace(line, VALID, "\u0001"), "\u0001", 1), r"(?iu)^.*?\b(?:pls|please)\s+consider\s+rate\s+", "")
    plain = lambda a: F.replace(a, F.lit(","), F.lit(""))
    pair = lambda carrier, amount: F.struct(carrier.alias("carrier"), amount.alias("amount"))

    def read(part: Column) -> Column:
        names, sums = F.regexp_extract_all(part, F.lit(CARRIER_AMOUNT), F.lit(1)), F.regexp_extract_all(part, F.lit(CARRIER_AMOUNT), F.lit(2))
        told = F.transform(F.arrays_zip(names.alias("n"), sums.alias("s")), lambda x: pair(carrier_name(x["n"]), plain(x["s"])))
        clause = F.regexp_replace(_found(line, CARRIER_CLAUSE), r"(?iu)\bNAC\b", "")
        carriers = _first_each(F.filter(F.transform(F.split(clause, r"(?iu)\s*(?:/|,|\band\b|\by\b)\s*"), carrier_name), lambda x: x != ""))
        amounts = F.transform(F.regexp_extract_all(F.regexp_replace(part, SIZE_AFTER_BAR, ""), F.lit(AMOUNT), F.lit(1)), plain)
        placed = let(F.struct(carriers.alias("c"), amounts.alias("a")), lambda x: F.when(F.size(x["a"]) > 0, F.transform(x["c"], lambda c, i: pair(c, F.get(x["a"], F.least(i, F.size(x["a"]) - 1))))))
        return F.when(F.size(told) > 0, _first_each(told, lambda x: F.lower(x["carrier"]))).otherwise(placed)

    return let(F.btrim(before, F.lit(" ,.;")), read)


def validity(line: Column) -> Column:
    """``(low, high)``, as written: ``15-21 Aug`` or ``28 Aug - 3 Sep``; null if it is neither."""
    text = F.trim(F.regexp_replace(F.replace(F.btrim(F.trim(_found(line, VALID)), F.lit(",.;")), F.lit("/"), F.lit(" ")), r"\s+", " "))
    part = lambda t, g: F.concat_ws(" ", F.regexp_extract(t, SHARED_MONTH, g), F.regexp_extract(t, SHARED_MONTH, 3), _found(t, SHARED_MONTH, 4))
    ends = lambda t, g: F.when(t.rlike(SHARED_MONTH), part(t, g)).when(t.rlike(TWO_DAYS), F.regexp_extract(t, TWO_DAYS, g))
    return let(text, lambda t: F.struct(ends(t, 1).alias("low"), ends(t, 2).alias("high")))


def route_groups(lines: Column) -> Column:
    """``(origins, ports, commodity, raw, charge)`` of the groups that lines of a message list, by a fold.

    ``A)`` closes a group, and so does a POL where one has origins and ports. Origins with different arbitrary charges make
    groups of their own; groups without origins or ports go.
    """
    null = F.lit(None).cast("string")
    group = lambda o, p, c: F.struct(o.alias("o"), p.alias("p"), c.alias("c"))
    state = lambda done, o, p, c: F.struct(done.alias("done"), o.alias("o"), p.alias("p"), c.alias("c"))
    whole = lambda s: s["o"].isNotNull() & s["p"].isNotNull()
    closed = lambda s: state(F.when(whole(s), F.concat(s["done"], F.array(group(s["o"], s["p"], s["c"])))).otherwise(s["done"]), null, null, null)

    def step(s: Column, x: Column) -> Column:
        key, value = F.upper(F.regexp_extract(x, PAIR, 1)), _found(F.trim(F.regexp_extract(x, PAIR, 2)), "(?s)(.*)")
        pol = let(F.when(whole(s), closed(s)).otherwise(s), lambda b: state(b["done"], value, b["p"], b["c"]))
        return F.when(x.rlike(r"(?i)^[A-Z]\)$"), closed(s)).when(key == "POL", pol).when(key == "POD", state(s["done"], s["o"], value, s["c"])).when(key != "", state(s["done"], s["o"], s["p"], value)).otherwise(s)

    none = F.array().cast("array<struct<o:string,p:string,c:string>>")
    groups = F.aggregate(lines, state(none, null, null, null), step, lambda s: closed(s)["done"])
    variant = lambda x: F.struct(_port(x).alias("port"), F.replace(_found(x, ARBITRARY), F.lit(","), F.lit("")).alias("charge"))

    def split(g: Column) -> Column:
        origins = _first_each(F.filter(F.transform(_parts(g["o"]), variant), lambda v: v["port"] != ""), lambda v: F.lower(F.concat_ws("|", v["port"], v["charge"])))
        ports = F.array_join(_first_each(F.filter(F.transform(_parts(g["p"]), _port), lambda x: x != "")), "/")
        return let(F.struct(origins.alias("v"), ports.alias("p")), lambda x: F.when(x["p"] != "", F.transform(F.array_distinct(x["v"]["charge"]), lambda charge: F.struct(
            F.array_join(F.filter(x["v"], lambda v: v["charge"].eqNullSafe(charge))["port"], "/").alias("origins"), x["p"].alias("ports"), _found(F.trim(g["c"]), "(?s)(.*)").alias("commodity"), g["o"].alias("raw"), charge.alias("charge"),
        ))).otherwise(F.array()))

    return F.flatten(F.transform(groups, split))


def _merged(groups: Column, excluded: Column) -> Column:
    """All groups as one, without excluded origins."""
    every = lambda f: _first_each(F.flatten(F.transform(groups, lambda g: _parts(g[f]))))
    origins = F.filter(every("origins"), lambda o: ~F.exists(excluded, lambda x: header_key(_port(o)) == x))
    null = F.lit(None).cast("string")
    raw = F.array_join(F.transform(groups, lambda g: g["raw"]), " | ")
    return F.array(F.struct(F.array_join(origins, "/").alias("origins"), F.array_join(every("ports"), "/").alias("ports"), null.alias("commodity"), raw.alias("raw"), null.alias("charge")))


def _remarks(carrier: Column, g: Column, excluded: Column, told: Column) -> Column:
    msc, some = carrier == "MSC", F.size(excluded) > 0
    arbitrary = F.when(g["charge"].isNotNull(), F.concat(F.lit("Arbitrario de origen: USD "), g["charge"], F.lit(" por contenedor"))).when(F.lower(g["raw"]).contains("arb"), F.concat(F.lit("Arbitrarios por POL según fuente: "), g["raw"]))
    notes = F.array_compact(F.array(
        F.lit("Producto comercial: NAC"),
        F.when((carrier == "ONE") & g["commodity"].isNotNull(), F.concat(F.lit("Mercancía autorizada para ONE NAC: "), g["commodity"])),
        arbitrary,
        F.when(msc & some, F.concat(F.lit("POL excluidos para la oferta general MSC: "), F.array_join(excluded, "/"))),
        F.regexp_replace(F.trim(told), r"\.+$", ""),
        F.when(msc, F.lit("Las restricciones COMM detalladas en el correo aplican expresamente a ONE NAC")),
    ))
    return F.concat(F.array_join(notes, ". "), F.lit("."))


def narrative_rates(lines: DataFrame) -> DataFrame:
    """Rates of offers told in sentences: ``doc_id, row_number, carrier, pol, poe, container_size, commodity, currency,
    freight_amount, origin_charges, surcharges, valid_from, valid_to, free_days, remarks``.

    The first line that offers a rate counts, with the lines below it up to the end of its message. It needs a validity,
    free days, and carriers with amounts. ONE keeps its groups of routes and their commodities; the others get all routes
    as one group, without origins that the offer excepts. Documents without an offer or routes give none.
    """
    order = Window.partitionBy("doc_id")
    at = F.min(F.when(F.col("text").rlike(OFFER), F.col("pos"))).over(order)
    below = lines.withColumn("at", at).filter("pos >= at")
    end = F.min(F.when((F.col("pos") > F.col("at")) & F.trim("text").rlike(ENDS), F.col("pos"))).over(order)
    below = below.withColumn("end", end).withColumn("n", F.row_number().over(order.orderBy("pos")) - 1)
    inherited = F.min(F.when((F.col("n") > 0) & (F.col("n") <= LOOK_AHEAD) & F.col("text").rlike(r"(?iu)\b(?:rate|per)\b") & equipment(F.col("text")).isNotNull(), F.struct("n", equipment(F.col("text")).alias("size"))))
    own = F.when((F.col("n") > 0) & (F.col("end").isNull() | (F.col("pos") < F.col("end"))), F.struct("pos", "text"))
    docs = below.groupBy("doc_id").agg(F.max(F.when(F.col("n") == 0, F.col("text"))).alias("line"), inherited.alias("inherited"), F.array_sort(F.collect_list(own)).alias("own"))
    excepted = _first_each(F.filter(F.transform(_parts(_found(F.col("line"), EXCEPT)), lambda x: header_key(_port(x))), lambda x: x != ""))
    told = F.struct(
        validity(F.col("line")).alias("valid"), _found(F.col("line"), FREE).alias("free_days"), carrier_amounts(F.col("line")).alias("rates"), F.col("own.text").alias("message"),
        F.coalesce(equipment(F.col("line")), F.col("inherited.size"), F.lit(USUAL_SIZE)).alias("size"), F.coalesce(excepted, F.array().cast("array<string>")).alias("excluded"),
    )
    # taken out of an array of one, as Spark would work out once more what a filter names
    whole = lambda d: d["valid"]["low"].isNotNull() & d["valid"]["high"].isNotNull() & d["free_days"].isNotNull() & (F.size(d["rates"]) > 0)
    docs = docs.select("doc_id", F.explode(F.filter(F.array(told), whole)).alias("d")).select("doc_id", "d.*")
    told = F.get(F.filter("message", lambda x: F.startswith(F.lower(x), F.lit("subject to"))), F.lit(0))
    docs = docs.withColumn("told", told).withColumn("groups", route_groups(F.col("message")))
    each = docs.select("*", F.posexplode(F.when(F.size("groups") > 0, F.col("rates"))).alias("r", "rate"))
    each = each.select("*", F.posexplode(F.when(F.col("rate.carrier") == "ONE", F.col("groups")).otherwise(_merged(F.col("groups"), F.col("excluded")))).alias("k", "g"))
    sums = F.regexp_extract_all("told", F.lit(EACH_CONTAINER), F.lit(1))
    total = F.aggregate(F.transform(sums, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("decimal(18,4)")), F.lit(0).cast("decimal(38,4)"), lambda a, x: (a + F.coalesce(x, F.lit(0))).cast("decimal(38,4)"))
    surcharges = F.when(F.size(sums) > 0, F.regexp_replace(F.regexp_replace(total.cast("string"), "0+$", ""), "[.]$", ""))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("r", "k"))
    return each.select(
        "doc_id", number.alias("row_number"), F.col("rate.carrier").alias("carrier"), F.col("g.origins").alias("pol"), F.col("g.ports").alias("poe"), F.col("size").alias("container_size"),
        F.when(F.col("rate.carrier") == "ONE", F.col("g.commodity")).alias("commodity"), F.lit("USD").alias("currency"), F.col("rate.amount").alias("freight_amount"), F.col("g.charge").alias("origin_charges"),
        surcharges.alias("surcharges"), F.col("valid.low").alias("valid_from"), F.col("valid.high").alias("valid_to"), "free_days", _remarks(F.col("rate.carrier"), F.col("g"), F.col("excluded"), F.col("told")).alias("remarks"),
    )

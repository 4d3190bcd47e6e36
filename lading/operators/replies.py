"""Rates in the replies of a language model: JSON in fences, in strings or in envelopes, with fields under many names.

A node of JSON is held as its text. ``VARIANT`` tells the kinds of its values; a map of texts keeps the order of its
properties, as the first one that has any of a field's names counts. All steps are expressions of a row; an object that names
one property twice is not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lading.functions import values

# Names of envelopes, of collections of rows and of a rate's fields, compared by their letters and digits.
ENVELOPES = ("data", "result", "output", "response", "payload", "jsonContent", "content")
NESTED = ("data", "result", "output", "payload")
ROWS = ("rows", "rates", "tariffs", "pricingRows", "items", "records", "results", "tarifas")
ROW_MARKS = (
    ("originPort", "pol", "origin", "portOfLoading"),
    ("poe", "portOfExit", "destinationPort", "destination", "portOfDischarge"),
    ("pod", "placeOfDelivery", "finalDestination"),
    ("containerType", "equipment", "container"),
    ("oceanFreight", "freight", "oceanRate", "rate"),
)
TEXTS = {
    "origin_port": ("originPort", "pol", "origin", "portOfLoading", "loadPort", "portOfOrigin", "puertoOrigen"),
    "port_of_exit": ("poe", "portOfExit", "destination", "portOfDischarge", "dischargePort", "arrivalPort", "gateway", "costaRicaGateway", "exitPort", "entryPort", "puertoSalida", "puertoEntrada", "puertoDestino"),
    "destination_port": ("pod", "destinationPort", "placeOfDelivery", "deliveryPlace", "deliveryPoint", "finalDestination", "finalDelivery", "destinoFinal", "lugarEntrega"),
    "container_type": ("containerType", "equipment", "equipmentType", "container", "sizeType", "size", "cntrType", "tipoContenedor"),
    "carrier": ("carrier", "shippingLine", "line", "naviera", "oceanCarrier"),
    "agent": ("agent", "destinationAgent", "agente"),
    "commodity": ("commodity", "cargo", "product", "mercancia"),
    "currency": ("currency", "currencyCode", "moneda"),
    "space_comment": ("spaceComment", "space", "availability", "spaceAvailability"),
    "remarks": ("remarks", "notes", "comments", "observations", "observaciones"),
}
WHOLE = {
    "free_days": ("freeDays", "freeTime", "destinationFreeTime", "diasLibres"),
    "transit_days": ("transitDays", "transitTimeDays", "transitTime", "transit", "diasTransito", "tiempoTransito"),
}
AMOUNTS = {
    "ocean_freight": ("oceanFreight", "freight", "oceanRate", "oceanFreightRate", "rate", "flete", "amount", "fleteMaritimo", "fleteMaritimoInternacional"),
    "origin_charges": ("originCharges", "originCharge", "chargesAtOrigin"),
    "destination_charges": ("destinationCharges", "destinationCharge", "chargesAtDestination"),
    "surcharges": ("surcharges", "surcharge", "additionalCharges"),
    "total_cost": ("totalCost", "cost", "totalCosto"),
    "total_sale": ("totalSale", "sale", "sellingPrice", "totalVenta"),
    "profit": ("profit", "utility", "utilidad"),
    "margin": ("margin", "marginPercent", "margen"),
}
PRICED_IN = ("oceanFreight", "freight", "oceanRate", "oceanFreightRate", "rate", "flete", "amount", "totalCost", "totalSale")
VALID_FROM = ("validFrom", "effectiveDate", "validityFrom", "startDate", "vigenciaDesde", "fechaInicio")
VALID_TO = ("validTo", "expirationDate", "expiryDate", "validityTo", "endDate", "vigenciaHasta", "fechaFin")
VALIDITY = ("validity", "validityEtd", "validityRange", "dateRange", "vigencia")
CONFIDENCE = ("confidence", "confidenceScore", "score", "confianza")
WARNINGS = ("warnings", "warning", "issues", "ambiguities", "advertencias")
SUCCESS = ("success", "isSuccess", "ok", "successful")
CURRENCY = r"(?i)\b(USD|EUR|CRC|GBP|JPY|CNY|RMB|CAD|MXN|COP|PAB)\b"
#: Envelopes, strings in strings and collections in collections that are opened; rows that are taken from one reply.
LEVELS, MOST_ROWS = 3, 100


def unfenced(c: Column) -> Column:
    """A text without the marks of a code block around it."""
    bare = F.btrim(c, F.lit(" \t\r\n"))
    inner = F.regexp_replace(F.regexp_replace(bare, r"^[^\n]*\n", ""), "```$", "")
    return F.when(F.startswith(bare, F.lit("```")), F.btrim(inner, F.lit(" \t\r\n"))).otherwise(bare)


def kind(text: Column) -> Column:
    """OBJECT, ARRAY, STRING or another type of JSON; null if the text is none. Its first character tells the first three."""
    def of(v: Column) -> Column:
        first = F.left(F.btrim(text, F.lit(" \t\r\n")), F.lit(1))
        return F.when(v.isNotNull(), F.when(first == "{", "OBJECT").when(first == "[", "ARRAY").when(first == '"', "STRING").otherwise(kind_of(v)))

    return values.let(F.try_parse_json(text), of)


def kind_of(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def json_root(text: Column) -> Column:
    """The JSON in a text, taken out of fences and out of up to two strings around it; null if there is none."""
    out = values.let(unfenced(text), lambda t: values.let(kind(t), lambda k: F.struct(t.alias("t"), k.alias("k"))))
    inner = lambda x: values.let(unfenced(F.try_variant_get(F.try_parse_json(x["t"]), "$", "string")), lambda t: F.struct(t.alias("t"), kind(t).alias("k")))
    for _ in range(LEVELS - 1):
        out = values.let(out, lambda x: F.when(x["k"] == "STRING", inner(x)).otherwise(x))
    return values.let(out, lambda x: F.when(x["k"] != "STRING", x["t"]))


def fields(text: Column) -> Column:
    """The properties of an object in their order: name in letters and digits, key in lower case, kind and text of the value. Null if the text
    is no object."""
    typed = lambda t: F.try_variant_get(F.try_parse_json(t), "$", "map<string,variant>")
    raw = lambda t: F.map_entries(F.from_json(t, "map<string,string>"))
    name = lambda k: F.regexp_replace(F.lower(k), r"[^\p{L}\p{Nd}]", "")
    one = lambda m: lambda e: F.struct(name(e["key"]).alias("name"), F.lower(e["key"]).alias("key"), kind_of(F.element_at(m, e["key"])).alias("kind"), e["value"].alias("text"))
    return values.let(typed(text), lambda m: F.when(m.isNotNull(), F.transform(raw(text), one(m))))


def pick(own: Column, names: Sequence[str]) -> Column:
    """The first property that has one of the names: ``(name, kind, text)`` or null."""
    known = ["".join(c for c in n.lower() if c.isalnum()) for n in names]
    return F.get(F.filter(own, lambda f: f["name"].isin(known)), F.lit(0))


def is_row(own: Column) -> Column:
    """Whether an object names a place, a container or a freight as rates do."""
    return F.coalesce(F.exists(own, lambda f: f["name"].isin([n.lower() for names in ROW_MARKS for n in names])), F.lit(False))


def _elements(text: Column) -> Column:
    """The texts of the objects in an array."""
    both = F.arrays_zip(F.from_json(text, "array<string>").alias("t"), F.try_variant_get(F.try_parse_json(text), "$", "array<variant>").alias("v"))
    return F.transform(F.filter(both, lambda x: kind_of(x["v"]) == "OBJECT"), lambda x: x["t"])


def _read(text: Column) -> Column:
    """A node as its text with its properties, which all that looks at the node shares."""
    return values.let(text, lambda t: F.when(t.isNotNull(), F.struct(t.alias("t"), fields(t).alias("own"))))


def _unwrapped(node: Column, levels: int = LEVELS) -> Column:
    """A node (as ``_read`` gives it) without up to three envelopes around it. What isn't opened is not looked at again."""

    def inner(x: Column) -> Column:
        closed = F.coalesce(pick(x["own"], ROWS)["kind"].isin("ARRAY", "OBJECT", "STRING"), F.lit(False)) | is_row(x["own"])
        below = values.let(pick(x["own"], ENVELOPES), lambda p: F.when(p["kind"].isin("ARRAY", "OBJECT"), p["text"]).when(p["kind"] == "STRING", json_root(p["text"])))
        return F.when(~closed, below)

    if not levels:
        return node
    opened = lambda x, t: F.when(t.isNull(), x).otherwise(_unwrapped(_read(t), levels - 1))
    return values.let(node, lambda x: values.let(inner(x), lambda t: opened(x, t)))


def _row_texts(node: Column, levels: int = LEVELS) -> Column:
    """The texts of the rows below a node (as ``_read`` gives it), through up to three collections in collections."""

    def at(t: Column, own: Column, x: Column) -> Column:
        rows, nested = x["rows"], x["nested"]
        parsed = F.when(rows["kind"] == "STRING", json_root(rows["text"]))
        single = (rows["kind"] == "OBJECT") & is_row(fields(rows["text"]))
        here = F.when(x["kind"] == "ARRAY", _elements(t)).when(rows["kind"] == "ARRAY", _elements(rows["text"])).when(single, F.array(rows["text"]))
        inner = F.when(rows["kind"] == "OBJECT", rows["text"]).otherwise(parsed)
        below = F.when(nested["kind"].isin("OBJECT", "ARRAY"), nested["text"])
        return values.let(F.struct(here.alias("here"), inner.alias("inner"), is_row(own).alias("own"), below.alias("below")), lambda y: chosen(t, y))

    def chosen(t: Column, y: Column) -> Column:
        next_ = F.coalesce(y["inner"], F.when(~y["own"], y["below"]))
        deeper = _row_texts(_read(next_), levels - 1) if levels > 1 else F.lit(None).cast("array<string>")
        return F.when(y["here"].isNotNull(), y["here"]).when(y["inner"].isNull() & y["own"], F.array(t)).otherwise(deeper)

    # what has properties is no array
    held = lambda t, own: F.struct(F.when(own.isNull(), kind(t)).alias("kind"), pick(own, ROWS).alias("rows"), pick(own, NESTED).alias("nested"))
    return values.let(node, lambda n: values.let(held(n["t"], n["own"]), lambda x: at(n["t"], n["own"], x)))


def flexible_decimal(text: Column) -> Column:
    """A number in a text: of comma and point the last is the decimal mark; a comma alone is one before one or two digits,
    a point alone is none before just three. Brackets negate."""
    kept = F.regexp_replace(F.trim(text), r"[^0-9,.\-()]", "")
    negative = F.startswith(kept, F.lit("(")) & F.endswith(kept, F.lit(")"))
    bare = F.btrim(kept, F.lit("()"))
    no = lambda c, mark: F.replace(c, F.lit(mark), F.lit(""))
    last_part = lambda c, mark: F.length(F.substring_index(c, mark, -1))
    commas_to_point = lambda c: F.replace(c, F.lit(","), F.lit("."))

    def number(t: Column) -> Column:
        comma, dot = F.contains(t, F.lit(",")), F.contains(t, F.lit("."))
        comma_last = last_part(t, ",") < last_part(t, ".")
        many_dots = F.length(t) - F.length(no(t, ".")) > 1
        joined = F.concat(no(F.left(t, F.length(t) - last_part(t, ".") - 1), "."), F.lit("."), F.substring_index(t, ".", -1))
        return (
            F.when(comma & dot & comma_last, commas_to_point(no(t, ".")))
            .when(comma & dot, no(t, ","))
            .when(comma & last_part(t, ",").isin(1, 2), commas_to_point(t))
            .when(comma, no(t, ","))
            .when(dot & many_dots, joined)
            .when(dot & (last_part(t, ".") == 3), no(t, "."))
            .otherwise(t)
        )

    plain = values.let(bare, lambda t: F.when(number(t).rlike(r"^-?(\d+\.?\d*|\.\d+)$"), number(t).try_cast("decimal(38,10)")))
    return F.when(negative, -plain).otherwise(plain)


def _text(p: Column) -> Column:
    return F.when((p["kind"] == "STRING") & (F.trim(p["text"]) != ""), F.trim(p["text"])).when(_is_number(p), p["text"])


def _is_number(p: Column) -> Column:
    return p["kind"].isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")


def _amount(p: Column) -> Column:
    return F.when(_is_number(p), p["text"].try_cast("decimal(38,10)")).when(p["kind"] == "STRING", flexible_decimal(p["text"]))


def _whole(p: Column) -> Column:
    return F.when(_is_number(p), F.round(p["text"].try_cast("decimal(38,10)"), 0).try_cast("int")).when(p["kind"] == "STRING", F.regexp_extract(p["text"], r"-?\d+", 0).try_cast("int"))


def _truth(p: Column) -> Column:
    lower = F.lower(F.trim(p["text"]))
    n = lower.try_cast("int")
    named = F.when(lower.isin("true", "false"), lower == "true")
    return F.when(p["kind"] == "BOOLEAN", p["text"] == "true").when(_is_number(p), n != 0).when(p["kind"] == "STRING", F.coalesce(named, n != 0))


def validity(low: Column, high: Column, both: Column, year: int) -> Column:
    """``(valid_from, valid_to)`` of three texts: start and end by themselves; what they lack comes from a range in the
    third, or in one of them."""
    # a text that is one date is no range
    ranged = lambda t, day: F.struct(day.alias("day"), F.when(day.isNull(), values.date_range(F.translate(t, "–—", "--"), year)).alias("range"))
    days = lambda c: values.let(c, lambda t: F.when(t.isNotNull(), values.let(values.date(t, year), lambda day: ranged(t, day))))
    def pair(of: Column) -> Column:
        low, high, both = of[0], of[1], of[2]
        ranges = [x["range"] for x in (both, low, high)]
        start = F.coalesce(low["day"], *[r["start"] for r in ranges])
        return F.struct(start.alias("valid_from"), F.coalesce(high["day"], *[r["end"] for r in ranges]).alias("valid_to"))

    return values.let(F.transform(F.array(low, high, both), days), pair)


def read_replies(replies: DataFrame) -> DataFrame:
    """``replies(reply_id, content)`` with what each holds: ``rows`` (texts of its rate objects, the first ``MOST_ROWS``),
    ``confidence`` (0 to 100; one up to 1 is a share), ``warnings``, ``declared`` (its own word on success) and ``success``.

    Null or blank content and what is no JSON has no rows. Repeated replies each give theirs.
    """
    df = replies.select("reply_id", _unwrapped(_read(json_root(F.col("content")))).alias("node"))
    df = df.select("reply_id", _row_texts(F.col("node")).alias("found"), F.col("node.own").alias("own"))
    df = df.select("reply_id", "found", pick(F.col("own"), CONFIDENCE).alias("sure"), pick(F.col("own"), WARNINGS).alias("said"), pick(F.col("own"), SUCCESS).alias("ok"))
    sure = values.let(F.coalesce(_amount(F.col("sure")), F.lit(0)), lambda c: F.least(F.lit(100), F.greatest(F.lit(0), F.when((c > 0) & (c <= 1), c * 100).otherwise(c))))
    said = F.col("said")
    listed = F.filter(F.arrays_zip(F.from_json(said["text"], "array<string>").alias("t"), F.try_variant_get(F.try_parse_json(said["text"]), "$", "array<variant>").alias("v")), lambda x: kind_of(x["v"]) == "STRING")
    texts = F.filter(F.transform(listed, lambda x: F.trim(x["t"])), lambda t: t != "")
    none = F.array().cast("array<string>")
    warnings = F.when((said["kind"] == "STRING") & (F.trim(said["text"]) != ""), F.array(F.trim(said["text"]))).when(said["kind"] == "ARRAY", F.array_distinct(texts)).otherwise(none)
    rows = F.slice(F.coalesce("found", none), 1, MOST_ROWS)
    return df.select("reply_id", rows.alias("rows"), sure.cast("double").alias("confidence"), F.coalesce(warnings, none).alias("warnings"), _truth(F.col("ok")).alias("declared"), (F.size(rows) > 0).alias("success"))


def reply_rows(read: DataFrame, year: int) -> DataFrame:
    """A typed record per row of ``read_replies``: texts, whole days, amounts as decimal(18, 4) and the validity, with the reply's warnings. A currency
    that is not named is taken from a price's text."""
    # not the bare column: Spark would work it out once more to see whether it is empty
    every = F.filter("rows", lambda t: t.isNotNull())
    flat = read.select("reply_id", "warnings", F.posexplode(every).alias("row_number", "node")).withColumn("own", fields(F.col("node")))
    names = TEXTS | WHOLE | AMOUNTS | {"priced_in": PRICED_IN, "low": VALID_FROM, "high": VALID_TO, "both": VALIDITY}
    found = flat.select("reply_id", "warnings", (F.col("row_number") + 1).alias("row_number"), *[pick(F.col("own"), n).alias(k) for k, n in names.items()])
    shown = F.when(F.col("priced_in.kind") == "STRING", F.col("priced_in.text"))
    out = {k: _text(F.col(k)) for k in TEXTS} | {k: _whole(F.col(k)) for k in WHOLE} | {k: values.let(_amount(F.col(k)), values.fits) for k in AMOUNTS}
    out["currency"] = F.coalesce(out["currency"], F.upper(F.nullif(F.regexp_extract(shown, CURRENCY, 1), F.lit(""))))
    valid = validity(*[_text(F.col(k)) for k in ("low", "high", "both")], year)
    typed = found.select("reply_id", "row_number", "warnings", *[c.alias(k) for k, c in out.items()], valid.alias("valid"))
    return typed.select("*", "valid.valid_from", "valid.valid_to").drop("valid")


def has_rate(any_of: Sequence[str] = ("origin_port", "port_of_exit", "destination_port", "container_type", "carrier", "ocean_freight", "total_cost", "total_sale")) -> Column:
    """Whether a record says anything of a rate."""
    return F.coalesce(*[F.col(c).cast("string") for c in any_of]).isNotNull()


def is_usable() -> Column:
    """Whether a record has a route and an amount."""
    routed = F.col("origin_port").isNotNull() & F.coalesce("port_of_exit", "destination_port").isNotNull()
    return routed & F.coalesce("ocean_freight", "total_cost", "total_sale").isNotNull()


def event_payload(text: Column) -> Column:
    """The JSON inside an event: the object in ``payload``, else ``data``, else ``eventData``; the event itself if none."""
    own = fields(text)
    return F.coalesce(*[_object(own, n) for n in ("payload", "data", "eventData")], text)


def _object(own: Column, name: str) -> Column:
    return F.get(F.filter(own, lambda f: (f["key"] == name.lower()) & (f["kind"] == "OBJECT")), F.lit(0))["text"]


GUID = r"(?i)^\s*[({]?[0-9a-f]{8}-?([0-9a-f]{4}-?){3}[0-9a-f]{12}[)}]?\s*$"


def batch_id(text: Column, depth: int = 2) -> Column:
    """The first identifier in a reply: the text itself, or one of ``pricingImportBatchId``, ``importBatchId`` and ``id``,
    else the same inside ``data``, ``value`` or ``result``, up to ``depth`` objects deep. Lower case with hyphens."""
    bare = F.btrim(text, F.lit(' \t\r\n"'))
    found = F.when(bare.rlike(GUID), bare)
    if depth:
        own = fields(text)
        named = lambda n: F.get(F.filter(own, lambda f: f["key"] == n.lower()), F.lit(0))
        ids = [F.when((named(n)["kind"] == "STRING") & named(n)["text"].rlike(GUID), named(n)["text"]) for n in ("pricingImportBatchId", "importBatchId", "id")]
        first = lambda n: values.let(named(n), lambda p: F.when(p["kind"] == "OBJECT", batch_id(p["text"], depth - 1)).when((p["kind"] == "STRING") & p["text"].rlike(GUID), p["text"]))
        found = F.coalesce(found, *ids, *[first(n) for n in ("data", "value", "result")])
    digits = F.lower(F.regexp_replace(found, "[^0-9a-fA-F]", ""))
    return F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")

"""From cells of a sheet to rows of rates: header mapping, unpivoting and exploding."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lading.functions.text import header_key
from lading.functions.values import BASE_PORTS, containers, is_base_ports, money

# The header keys of each field, all of them.
FIELDS = {
    "OriginPort": (
        "pol", "origin", "origen", "originport", "puertoorigen", "portloading", "portofloading", "loading", "loadingport", "loadport", "from", "por",
        "placeofreceipt", "receipt",
    ),
    "PortOfExit": (
        "poe", "portofexit", "exitport", "puertosalida", "portofentry", "entryport", "puertoentrada", "destination", "destino", "destinationport",
        "puertodestino", "portdischarge", "portofdischarge", "discharge", "dischargeport", "arrivalport", "portofarrival", "gateway",
        "costaricagateway", "transshipmentport", "transshipment", "transbordo", "via", "to", "pod",
    ),
    "DestinationPort": (
        "finaldestination", "placeofdelivery", "delivery", "deliveryplace", "deliverypoint", "finaldelivery", "destinofinal", "lugardeentrega",
        "puntodeentrega",
    ),
    "Carrier": (
        "carrier", "naviera", "linea", "lineamaritima", "shippingline", "steamshipline", "shippingcompany", "ssl", "oceanline", "line",
    ),
    "Agent": (
        "agent", "agente", "forwarder", "proveedor", "provider",
    ),
    "ContainerType": (
        "container", "containersize", "containersizetype", "containertype", "containercode", "equipment", "equipmentsize", "equipmenttype",
        "equipmentcode", "equipo", "tipocontenedor", "contenedor", "cntr", "eq", "equip", "eqtype", "type", "size", "sizetype",
    ),
    "Commodity": (
        "commodity", "mercancia", "producto", "cargo", "cargotype", "descripcion", "description",
    ),
    "Currency": (
        "currency", "moneda", "curr", "ccy", "divisa",
    ),
    "TransitDays": (
        "diastransito", "transitdays", "transittimedays", "transitdayscount", "diastransitocantidad", "tiempotransito", "tiempoentransito",
        "transittime", "tt",
    ),
    "FreeDays": (
        "diaslibres", "freedays", "freetime", "free", "fd", "demurragefreedays", "detentionfreedays", "demdetfreedays",
    ),
    "ValidFrom": (
        "validfrom", "vigencia", "vigenciadesde", "inicio", "fechainicio", "start", "startdate", "desde", "effective", "effectivedate",
        "effectiveetd", "effectivefrom", "validityfrom",
    ),
    "ValidTo": (
        "validto", "validuntil", "vigenciahasta", "vence", "vencimiento", "fechavencimiento", "fin", "fechafin", "hasta", "validity", "validityto",
        "expiration", "expirationdate", "expiracion", "expiry", "expirydate", "expiredate", "effectiveto",
    ),
    "OceanFreight": (
        "oceanfreight", "freight", "seafreight", "basicfreight", "freightrate", "rate", "rateusd", "amount", "tarifa", "precio", "price", "flete",
        "montoflete", "montotarifa", "fleteoceanico", "of", "ocf", "freightamount", "oceanfreightamount", "rateamount", "fleteamount",
        "fletemaritimocosto", "fleteoceanicocosto", "freightcost",
    ),
    "Surcharges": (
        "fixedcosts", "fixedcost", "costosfijos", "costofijo", "charges", "localcharges", "surcharges", "recargos", "extras",
    ),
    "OriginCharges": (
        "origincharges", "gastosorigen", "origencharges",
    ),
    "DestinationCharges": (
        "destinationcharges", "gastosdestino", "destinocharges",
    ),
    "TotalCost": (
        "totalcost", "totalcostos", "costototal", "costostotales",
    ),
    "TotalSale": (
        "totalsale", "venta", "totalventa", "sellingamount", "saleamount",
    ),
    "Profit": (
        "profit", "utilidad",
    ),
    "Margin": (
        "margin", "margen",
    ),
    "SpaceComment": (
        "space", "spaces", "espacios", "comentarioespacios", "comentariosdeespacios", "comentariosespacios",
    ),
    "Remarks": (
        "remarks", "observaciones", "comentarios", "comment", "comments", "notes", "nota", "notas",
    ),
    "RouteMode": (
        "route", "routemode",
    ),
    "UpdatedAt": (
        "actualizado", "updatedat", "updated", "lastupdate", "lastupdated",
    ),
    "DestinationThcCost": (
        "thcd", "thcdcosto", "thddcosto", "thcdestinationcosto",
    ),
    "PanamaHandlingCost": (
        "manejospty", "manejosptycosto", "panamahandlingcost",
    ),
    "BunkerCost": (
        "bunker", "bunkercosto",
    ),
    "AllInSale": (
        "allin", "allinventa",
    ),
    "AgentProfitCost": (
        "profitagentecosto", "agentprofitcost",
    ),
    "AgentReleaseCost": (
        "releaseagentecosto", "releasecosto", "agentreleasecost",
    ),
    "DocumentationCost": (
        "documentacioncosto", "documentationcost",
    ),
    "ContainerProtectCost": (
        "containerprotectcosto", "containerprotectioncosto",
    ),
    "WharfageCost": (
        "muellajecosto", "wharfagecost",
    ),
    "MerchantCost": (
        "merchantcosto", "merchantcost",
    ),
    "InternalFreightCost": (
        "fleteinternocosto", "internalfreightcost",
    ),
    "CarouselCost": (
        "carruselcosto", "carouselcost",
    ),
    "InternationalLandFreightCost": (
        "fleteinternacionalterrestrecosto", "landfreightcost",
    ),
    "InternationalFreightSale": (
        "fleteinternacionalventa", "internationalfreightsale",
    ),
    "DestinationChargesSale": (
        "cargosendestinoventa", "destinationchargessale",
    ),
    "CarouselSale": (
        "carruselventa", "carouselsale",
    ),
    "InternalFreightSale": (
        "fleteinternoventa", "internalfreightsale",
    ),
    "HandlingSale": (
        "manejosventa", "handlingsale",
    ),
}


def default_fields() -> dict[str, str]:
    """Header key -> field."""
    return {k: field for field, keys in FIELDS.items() for k in keys}


def default_mappings(spark: SparkSession) -> DataFrame:
    """``key, field``: which field a header key stands for."""
    return spark.createDataFrame(list(default_fields().items()), "key string, field string")


def decorated_currency(key: Column) -> Column:
    """Whether a header key is a currency with a container size, such as that of ``Moneda 20'``."""
    return key.rlike("^(currency|moneda|curr|ccy|divisa)(20|40|45)(ft|dv|dc|gp|hc|hq|rf|reefer|ot|std|st)?$")


#: Said in the remarks of rows that sail on one day.
ETD_NOTE = "Vigencia de un día derivada de Effective ETD."


def one_day_validity(fields: Column, etd: Column) -> Column:
    """``fields`` with both ends of the validity set to the sailing ``etd``, where there is one, and a note of that in the
    remarks, once."""
    remarks = F.trim(F.coalesce(F.try_element_at(fields, F.lit("Remarks")), F.lit("")))
    noted = F.when(remarks == "", F.lit(ETD_NOTE)).when(F.contains(F.lower(remarks), F.lit(ETD_NOTE.lower())), remarks)
    noted = F.coalesce(noted, F.concat(F.regexp_replace(remarks, r"\.+$", ""), F.lit(". " + ETD_NOTE)))
    rest = F.map_filter(fields, lambda k, v: ~k.isin("ValidFrom", "ValidTo", "Remarks"))
    day = F.trim(etd)
    set_ = F.create_map(F.lit("ValidFrom"), day, F.lit("ValidTo"), day, F.lit("Remarks"), noted)
    return F.when(F.coalesce(day, F.lit("")) != "", F.map_concat(rest, set_)).otherwise(fields)


def overlay(defaults: DataFrame, rules: DataFrame) -> DataFrame:
    """Defaults with the rules of a profile on top; what a route header means is never overruled."""
    fixed = F.col("d.field").isin("PortOfExit", "DestinationPort")
    both = defaults.alias("d").join(rules.alias("r"), "key", "full_outer")
    return both.select("key", F.when(fixed, F.col("d.field")).otherwise(F.coalesce("r.field", "d.field")).alias("field"))


def cells_to_rows(cells: DataFrame, mappings: DataFrame, row_keys: list[str]) -> DataFrame:
    """``cells(row keys, pos, header, value)`` -> a map of fields per row. Of several headers for a field, the last value
    that is not blank wins; unknown headers go. ``mappings`` is a dictionary of some hundred rows, so Spark broadcasts it
    by its size."""
    keyed = cells.filter(F.trim("value") != "").withColumn("key", header_key(F.col("header")))
    keyed = keyed.withColumn("key", F.when(decorated_currency(F.col("key")), "currency").otherwise(F.col("key")))
    named = keyed.join(mappings, "key").groupBy(*row_keys, "field").agg(F.max_by("value", "pos").alias("value"))
    return named.groupBy(*row_keys).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields"))


def mapping_preview(cells: DataFrame, mappings: DataFrame) -> DataFrame:
    """Distinct headers with what they map to and whether that is needed."""
    heads = cells.select("header").distinct().withColumn("key", header_key(F.col("header")))
    needed = F.col("field").isin("OriginPort", "PortOfExit", "ContainerType", "Carrier", "Currency", "ValidFrom", "ValidTo")
    return heads.join(mappings, "key", "left").select("header", "key", "field", F.col("field").isNotNull().alias("mapped"), F.coalesce(needed, F.lit(False)).alias("needed"))


def unpivot_containers(rows: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """A row per container column with a readable amount; columns of sales give ``sale``, others ``freight``."""
    long = rows.unpivot([F.col(k) for k in keep], [F.col(f"`{c}`") for c in columns], "heading", "cell")
    long = long.withColumn("amount", money(F.col("cell"))).filter("amount is not null")
    sale = header_key(F.col("heading")).rlike("venta|sale|allin")
    return long.withColumn("freight", F.when(~sale, F.col("amount"))).withColumn("sale", F.when(sale, F.col("amount"))).drop("amount", "cell")


def explode_containers(rows: DataFrame, column: str) -> DataFrame:
    """A row per kind that the cell stands for; cells that name none stay as they are."""
    with_kinds = rows.withColumn("_kinds", containers(F.col(column)))
    return with_kinds.withColumn(column, F.explode(F.when(F.size("_kinds") > 0, F.col("_kinds")).otherwise(F.array(F.col(column))))).drop("_kinds")


def places(c: Column) -> Column:
    """Parts of a list of ports; one that says base ports stands for all of them, in place of the list."""
    parts = F.filter(F.transform(F.split(c, r"(?i)\s*[/;,]\s*|\s+(?:and|y)\s+"), lambda p: F.trim(p)), lambda p: p != "")
    base = F.exists(parts, lambda p: is_base_ports(p))
    return F.when(base, F.array(*[F.lit(p) for p in BASE_PORTS])).otherwise(parts)


def explode_routes(rows: DataFrame, columns: tuple[str, ...] = ("pol", "poe", "pod")) -> DataFrame:
    """Every combination of the ports in the columns; empty ones stay null."""
    for c in columns:  # a cell without separators is its own place
        plain = F.trim(c)
        simple = ~F.col(c).rlike(r"(?i)[/;,]|\s(and|y)\s") & (plain != "") & ~is_base_ports(F.col(c))
        rows = rows.withColumn(c, F.explode_outer(F.when(simple, F.array(plain)).otherwise(F.filter(places(F.col(c)), lambda p: p != ""))))
    return rows


def number_headers(headers: DataFrame, keys: list[str]) -> DataFrame:
    """Repeated headers of a table get ``_2``, ``_3``...; blank ones go. ``headers(keys, pos, header)``."""
    from pyspark.sql.window import Window

    kept = headers.withColumn("header", F.trim("header")).filter("header <> ''")
    n = F.row_number().over(Window.partitionBy(*keys, F.lower("header")).orderBy("pos"))
    return kept.withColumn("n", n).withColumn("header", F.when(F.col("n") > 1, F.concat_ws("_", "header", F.col("n").cast("string"))).otherwise(F.col("header"))).drop("n")


def fields_map(**columns: Column) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), v) for k, v in columns.items()))

"""Typed rate records, their totals, issues, status and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lading.functions.values import carrier, container, currency, date, days, fits, money, port

#: Codes of issues that block a record.
BLOCKING = ("missing_origin_port", "missing_port_of_exit", "missing_container_type", "missing_carrier", "missing_currency", "missing_valid_from", "missing_valid_to", "invalid_validity_range", "missing_rate_amount")
REFERENCED = ("origin_port", "port_of_exit", "destination_port", "container_type", "carrier", "agent", "currency")


def sum_known(*columns: Column) -> Column:
    """Sum of what is not null; null if all is."""
    known = F.coalesce(*columns)
    return F.when(known.isNotNull(), reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in columns]))


def profit(sale: Column, cost: Column) -> Column:
    return sale - cost


def margin(sale: Column, cost: Column) -> Column:
    """Profit in percent of the sale, half-even to four places; null where nothing is sold."""
    return F.when(sale != 0, F.bround((sale - cost) / sale * 100, 4))


def issue_codes(as_of: Column, references: bool = False) -> Column:
    """Codes of all issues of a record, blocking ones among them.

    With ``references``, columns ``<name>_ref`` hold catalog matches and an unmatched value is an issue as well.
    """
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    rules = [
        ("missing_origin_port", blank("origin_port")),
        ("missing_port_of_exit", blank("port_of_exit")),
        ("missing_destination_port", blank("destination_port")),
        ("missing_container_type", blank("container_type")),
        ("missing_carrier", blank("carrier")),
        ("missing_agent", blank("agent")),
        ("missing_currency", blank("currency")),
        ("missing_valid_from", F.col("valid_from").isNull()),
        ("missing_valid_to", F.col("valid_to").isNull()),
        ("invalid_validity_range", F.col("valid_to") < F.col("valid_from")),
        ("same_poe_and_pod", F.lower("port_of_exit") == F.lower("destination_port")),
        ("missing_rate_amount", F.coalesce("total_sale", "total_cost", "ocean_freight").isNull()),
        ("expired_rate", F.col("valid_to") < as_of),
        ("negative_margin", F.col("margin") < 0),
    ]
    if references:
        rules += [(f"unknown_{c}", ~blank(c) & F.col(f"{c}_ref").isNull()) for c in REFERENCED]
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond in rules]))


def status(issues: Column) -> Column:
    blocks = F.arrays_overlap(issues, F.array(*[F.lit(b) for b in BLOCKING]))
    return F.when(blocks, "Invalid").when(F.size(issues) > 0, "RequiresReview").otherwise("Valid")


def summary(records: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by status per group and the state of the whole."""
    n = lambda s: F.count_if(F.col("status") == s)
    out = records.groupBy(*keys).agg(F.count("*").alias("total"), n("Valid").alias("valid"), n("RequiresReview").alias("warning"), n("Invalid").alias("invalid"))
    some = F.col("warning") + F.col("invalid") > 0
    return out.withColumn("has_issues", some).withColumn("state", F.when(some, "CompletedWithIssues").otherwise("Completed"))


def sails(etd: Column) -> Column:
    """False for rows whose sailing is left out."""
    return ~F.coalesce(F.trim(F.upper(etd)).isin("OMIT", "OMITTED", "NO SAILING", "CANCELLED", "CANCELED"), F.lit(False))


def shifted_validity(valid_from: Column, valid_to: Column) -> Column:
    """``(free_days, from_text, to_text)`` where a column has slipped: a bare number up to 365 in the first place is free
    days, and two dates in the second are both."""
    two = F.regexp_extract_all(valid_to, F.lit(r"([0-9]{1,2}[-/ ][A-Za-z0-9]{1,9}[-/ ][0-9]{2,4})"), F.lit(1))
    number = F.when(F.trim(valid_from).rlike("^[0-9]{1,3}$"), F.trim(valid_from).try_cast("int"))
    slipped = (number <= 365) & (F.size(two) >= 2)
    return F.struct(F.when(slipped, number).alias("free_days"), F.when(slipped, F.get(two, F.lit(0))).otherwise(valid_from).alias("from_text"), F.when(slipped, F.element_at(two, -1)).otherwise(valid_to).alias("to_text"))


def confidence(matched: Column, expected: Column, blocking: Column, review: Column, rows: Column) -> Column:
    """The lesser of what structure and catalogs say, 0 to 100."""
    structural = F.greatest(F.lit(0.0), 100.0 - 100.0 * blocking / F.greatest(rows, F.lit(1)) - 10.0 * (review > 0).cast("int"))
    return F.least(structural, F.when(expected > 0, 100.0 * matched / expected).otherwise(0.0))


#: Charges that make up a sum where the sum itself is not given.
CHARGES = {
    "origin_charges": ("OriginCharges", ("AgentProfitCost", "AgentReleaseCost")),
    "destination_charges": ("DestinationCharges", ("DestinationThcCost", "DocumentationCost", "ContainerProtectCost", "WharfageCost", "MerchantCost")),
    "surcharges": ("Surcharges", ("InternalFreightCost", "CarouselCost", "PanamaHandlingCost", "InternationalLandFreightCost", "BunkerCost")),
}
SALES = ("TotalSale", "AllInSale", "InternationalFreightSale")
MONEY = ("OceanFreight", "TotalCost", "Profit", "Margin", *SALES, *(c for whole, parts in CHARGES.values() for c in (whole, *parts)))


def first_text(*columns: Column) -> Column:
    """The first that is not blank, trimmed."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in columns])


def price_records(rows: DataFrame, as_of_year: int, fields: str = "fields") -> DataFrame:
    """Rows with a map of fields as typed records: names in their usual spelling, dates, days, and all amounts.

    Charges not given as a whole are the sum of their parts; the cost is that of freight and charges; the sale is the first
    of three fields that reads as money; profit and margin follow where they are not given. Amounts that do not fit
    decimal(18, 4) are null. A null map, or one without a field, gives nulls and the default currency.
    """
    names = [c for c in rows.columns if c != fields]
    text = lambda k: first_text(F.try_element_at(F.col(fields), F.lit(k)))
    read = rows.select(*names, F.col(fields), *[money(text(k)).alias(f"_m_{k}") for k in MONEY])
    m = lambda k: F.col(f"_m_{k}")
    slip = shifted_validity(text("ValidFrom"), text("ValidTo"))
    read = read.withColumn("_slip", slip).withColumn("ocean_freight", m("OceanFreight"))
    for name, (whole, parts) in CHARGES.items():
        read = read.withColumn(name, fits(F.coalesce(m(whole), sum_known(*map(m, parts))).cast("decimal(38,10)")))
    cost = F.coalesce(m("TotalCost"), sum_known(*[F.col(c) for c in ("ocean_freight", *CHARGES)]))
    read = read.withColumn("total_cost", fits(cost.cast("decimal(38,10)"))).withColumn("total_sale", F.coalesce(*map(m, SALES)))
    read = read.withColumn("profit", fits(F.coalesce(m("Profit"), profit(F.col("total_sale"), F.col("total_cost"))).cast("decimal(38,10)")))
    read = read.withColumn("margin", fits(F.coalesce(m("Margin"), F.when(F.col("total_sale") != 0, F.bround(F.col("profit") / F.col("total_sale") * 100, 4))).cast("decimal(38,10)")))
    return read.select(
        *names, port(text("OriginPort")).alias("origin_port"), port(text("PortOfExit")).alias("port_of_exit"), port(text("DestinationPort")).alias("destination_port"),
        container(text("ContainerType")).alias("container_type"), carrier(text("Carrier")).alias("carrier"), text("Agent").alias("agent"), text("Commodity").alias("commodity"), currency(text("Currency")).alias("currency"),
        F.coalesce(F.col("_slip.free_days"), days(text("FreeDays"))).alias("free_days"), days(text("TransitDays")).alias("transit_days"),
        date(F.col("_slip.from_text"), as_of_year).alias("valid_from"), date(F.col("_slip.to_text"), as_of_year).alias("valid_to"),
        "ocean_freight", *CHARGES, "total_cost", "total_sale", "profit", "margin", text("SpaceComment").alias("space_comment"), first_text(F.try_element_at(F.col(fields), F.lit("Remarks")), F.try_element_at(F.col(fields), F.lit("RouteMode"))).alias("remarks"),
    )


def apply_catalog(records: DataFrame, column: str, resolved: DataFrame) -> DataFrame:
    """``records`` with ``column`` in the catalog's spelling and its item in ``<column>_ref``; values that resolve to nothing
    stay as they are. ``resolved(value, item_id, name)`` has a row per distinct value, so no record repeats."""
    found = resolved.select(F.col("value").alias(column), F.col("item_id").alias(f"{column}_ref"), F.col("name").alias("_name"))
    return records.join(found, column, "left").withColumn(column, F.coalesce("_name", column)).drop("_name")

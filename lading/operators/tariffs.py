"""What the name and the text of a carrier's tariff say about all of its rates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lading.functions.text import fold
from lading.functions.values import let

# How carriers are written, the first that occurs counts.
CARRIERS = {
    "MSC": r"\bMSC\b",
    "ONE": r"\bONE\b",
    "Maersk": r"\b(?:MAERSK|MSK)\b",
    "PIL": r"\bPIL\b",
    "COSCO": r"\bCOSCO\b",
    "Hapag-Lloyd": r"\b(?:HAPAG(?:-LLOYD)?|HPL)\b",
    "CMA CGM": r"\bCMA\s*CGM\b",
    "Evergreen": r"\bEVERGREEN\b",
    "OOCL": r"\bOOCL\b",
    "Wan Hai": r"\b(?:WAN\s*HAI|WHL)\b",
    "ZIM": r"\bZIM\b",
}
# Ports of exit and how they are written without marks, the first that occurs counts.
EXITS = {"Puerto Caldera": "CALDERA", "Moín": "MOIN", "Puerto Limón": "LIMON", "Colón": "COLON", "Manzanillo": "MANZANILLO"}
# Months in Spanish and English, told apart by three letters.
MONTHS = "enero january jan febrero february feb marzo march mar abril april apr mayo may junio june jun julio july jul agosto august aug septiembre setiembre september sep octubre october oct noviembre november nov diciembre december dec".split()
NUMBERS = {"ene": 1, "jan": 1, "feb": 2, "mar": 3, "abr": 4, "apr": 4, "may": 5, "jun": 6, "jul": 7, "ago": 8, "aug": 8, "sep": 9, "set": 9, "oct": 10, "nov": 11, "dic": 12, "dec": 12}
DAYS = r"(?i)(\d{1,2})\s*(?:al|a|[-–—])\s*(\d{1,2})\s*(?:de|/|-)?\s*(" + "|".join(MONTHS) + r")(?:\s*(?:de)?\s*(20\d{2}))?"


def _first(text: Column, names: dict[str, str]) -> Column:
    return let(text, lambda t: F.coalesce(*[F.when(t.rlike(p), F.lit(name)) for name, p in names.items()]))


def tariff_carrier(file_name: Column, text: Column) -> Column:
    """The carrier that the file's name says, else the one in its text; null if neither does."""
    return F.coalesce(*[_first(F.upper(c), CARRIERS) for c in (file_name, text)])


def tariff_exit(file_name: Column, text: Column) -> Column:
    """The port of exit named in the file's name or text."""
    return _first(F.upper(fold(F.concat_ws("\n", file_name, text))), {name: rf"\b{word}\b" for name, word in EXITS.items()})


def year_of(month: Column, as_of: Column) -> Column:
    """The year in which a month without one lies: the nearest, when it is seven months or more from ``as_of``."""
    ahead = month - F.month(as_of)
    return F.year(as_of) + F.when(ahead <= -7, 1).when(ahead >= 7, -1).otherwise(0)


def tariff_validity(text: Column, as_of: Column) -> Column:
    """``(start, end)`` of the first ``08 al 14 de agosto [2026]``; null if a day doesn't exist or the end is before the
    start. Null texts give null."""
    names = F.create_map(*[F.lit(x) for pair in NUMBERS.items() for x in pair])

    def spanned(first: Column) -> Column:
        part = lambda g: F.regexp_extract(first, DAYS, g)
        month = F.try_element_at(names, F.lower(F.substring(part(3), 1, 3)))
        return let(month, lambda m: let(F.coalesce(part(4).try_cast("int"), year_of(m, as_of)), lambda y: dated(part, m, y)))

    def dated(part, month: Column, year: Column) -> Column:
        day = lambda g: F.try_to_timestamp(F.concat(year.cast("string"), F.lit("-"), month.cast("string"), F.lit("-"), part(g)), F.lit("yyyy-M-d")).cast("date")
        return let(F.struct(day(1).alias("start"), day(2).alias("end")), lambda d: F.when(d["end"] >= d["start"], d))

    # the text is folded and searched once; what was found is short
    return let(F.regexp_substr(fold(text), F.lit(DAYS)), spanned)


def route_mode(text: Column) -> Column:
    return F.when(F.upper(text).rlike(r"\bDT\b|DIAMOND\s*TIER"), "Diamond Tier").otherwise("Marítimo")

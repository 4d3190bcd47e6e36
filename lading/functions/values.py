"""Money, currency, names, containers, days and dates as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from lading.functions.text import fold

#: Largest amount that fits decimal(18, 4).
MOST = "99999999999999.9999"
NUMBER = r"\(?-?(?:[0-9]{1,3}(?:[  .,][0-9]{3})+(?:[.,][0-9]+)?|[0-9]+(?:[.,][0-9]+)?)\)?"
CODES = "USD|EUR|CRC|GBP|JPY|CNY|RMB|CAD|MXN|COP|PAB"
# Names of currencies.
CURRENCIES = {
    "USD": ("USD", "US DOLLAR", "US DOLLARS", "DOLLAR", "DOLLARS", "DOLAR", "DOLARES"),
    "CRC": ("CRC", "COLON", "COLONES", "COSTA RICAN COLON"),
    "EUR": ("EUR", "EURO", "EUROS"),
    "GBP": ("GBP", "POUND", "POUNDS", "STERLING"),
    "CNY": ("CNY", "RMB", "YUAN"),
    "CAD": ("CAD",),
    "MXN": ("MXN",),
    "COP": ("COP",),
    "PAB": ("PAB",),
    "JPY": ("JPY",),
}
# Other names of carriers.
CARRIERS = {
    "MAERSK": ("MSK", "MAERSK LINE", "MAEU"),
    "CMA CGM": ("CMA", "CMA-CGM"),
    "HAPAG-LLOYD": ("HPL", "HAPAG", "HAPAG LLOYD"),
    "MSC": ("MSC LINE", "MEDITERRANEAN SHIPPING COMPANY"),
    "ONE": ("ONE LINE", "OCEAN NETWORK EXPRESS"),
    "COSCO": ("COSCO SHIPPING",),
    "EVERGREEN": ("EMC",),
    "YANG MING": ("YML", "YANG MING LINE"),
    "ZIM": ("ZIM LINE",),
}
# Base ports in their order, and other names of ports.
BASE_PORTS = ("Shanghai", "Ningbo-Zhoushan", "Shenzhen", "Qingdao", "Guangzhou (Nansha)", "Tianjin (Xingang)", "Xiamen", "Dalian", "Lianyungang", "Yantian (Shenzhen)")
BASE_PORT_KEYS = ("chinabaseports", "chinabaseport", "baseportschina", "baseportchina", "asiabaseports", "asiabaseport", "baseportsasia", "baseportasia")
PORTS = {
    "NINGBO": ("NINGBO PORT", "NGB"),
    "SHANGHAI": ("SHANGHAI PORT", "SHA", "SHG"),
    "SHENZHEN": ("SHENZHEN PORT", "SZN", "SZX"),
    "XIAMEN": ("XIAMEN PORT", "XMN"),
    "QINGDAO": ("QINGDAO PORT", "TAO"),
    "TIANJIN (XINGANG)": ("TIANJIN PORT", "XINGANG", "TSN"),
    "DALIAN": ("DALIAN PORT", "DLN", "DLC"),
    "CALDERA": ("PTO CALDERA", "PUERTO CALDERA", "CALDERA, COSTA RICA"),
    "ACAJUTLA": ("ACAJULTA", "ACAJUTLA, EL SALVADOR"),
    "CORINTO": ("CORINTO, NICARAGUA",),
    "PUERTO LIMON": ("PTO LIMON", "LIMON", "LIMÓN"),
    "MOIN": ("MOÍN", "PUERTO MOIN", "PUERTO MOÍN"),
}
# Container spellings after the size.
DRY = ("", "DRY", "DV", "GP", "STD", "STANDARD", "STANDARDDRY", "DRYCONTAINER", "GENERALPURPOSE")
DRY_40 = (*DRY, "ST", "SV", "STANDAR")
HIGH = ("HC", "HQ", "HIGHCUBE", "HIGHCUBECONTAINER")
# Spanish months and their English short names.
MONTHS = {"ene": "Jan", "enero": "Jan", "febrero": "Feb", "marzo": "Mar", "abr": "Apr", "abril": "Apr", "mayo": "May", "junio": "Jun", "julio": "Jul", "ago": "Aug", "agosto": "Aug", "sept": "Sep", "septiembre": "Sep", "set": "Sep", "setiembre": "Sep", "octubre": "Oct", "noviembre": "Nov", "dic": "Dec", "diciembre": "Dec"}
EMPTY_AMOUNTS = ("-", "--", "$ -", "$-", "N/A", "n/a")


def _renamed(c: Column, names: dict[str, tuple[str, ...]]) -> Column:
    pairs = [(alias, name) for name, aliases in names.items() for alias in aliases]
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs)]), c), c)


def _blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def let(c: Column, then) -> Column:
    """``then`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(c), then), F.lit(0))


def money(c: Column) -> Column:
    """The amount of a cell as decimal(18, 4), or null.

    The number after a currency mark comes first, else the first number that stands alone. Of two kinds of separators the
    last is the decimal one; a single kind groups thousands if it occurs twice or three digits follow it. Brackets negate.
    """
    marked = lambda t: F.regexp_extract(t, rf"(?i)(?:(?:^|[^A-Za-z])(?:{CODES})(?![A-Za-z])|US\$|[$€₡£])\s*({NUMBER})", 1)
    alone = lambda t: F.regexp_extract(t, rf"(?:^|[^0-9])({NUMBER})(?:[^0-9]|$)", 1)
    token = lambda t: let(marked(t), lambda m: F.when(m != "", m).otherwise(alone(t)))
    read = lambda t: let(F.regexp_replace(t, r"[^0-9.,\-]", ""), lambda d: _signed(t, _number(d))).try_cast("decimal(38,10)")
    return let(F.trim(c), lambda t: F.when(~t.isin(*EMPTY_AMOUNTS), fits(let(token(t), read))))  # a null ends here


def _number(digits: Column) -> Column:
    has = lambda sign: F.instr(digits, sign) > 0
    twice = lambda sign: F.substring_index(digits, sign, 2) != digits
    without = lambda sign: F.replace(digits, F.lit(sign), F.lit(""))
    both = has(",") & has(".")
    comma_last = F.instr(F.reverse(digits), ",") < F.instr(F.reverse(digits), ".")
    return (
        F.when(both & comma_last, F.replace(without("."), F.lit(","), F.lit(".")))
        .when(both, without(","))
        .when(twice(",") | digits.rlike(",[0-9]{3}$"), without(","))
        .when(twice(".") | digits.rlike("[.][0-9]{3}$"), without("."))
        .otherwise(F.replace(digits, F.lit(","), F.lit(".")))
    )


def _signed(token: Column, number: Column) -> Column:
    return F.when(token.startswith("(") & token.endswith(")") & (F.instr(token, "-") == 0), F.concat(F.lit("-"), number)).otherwise(number)


def fits(value: Column) -> Column:
    """Rounded half away from zero to decimal(18, 4); null where it doesn't fit."""
    return let(value, lambda v: F.when(F.abs(v) <= F.lit(MOST).cast("decimal(38,10)"), F.round(v, 4)).try_cast("decimal(18,4)"))


def currency(c: Column, default: str | None = "USD") -> Column:
    """ISO code by sign, name or embedded code; the default for blanks; short unknown names in upper case, else null."""
    names = F.create_map(*[F.lit(x) for x in chain.from_iterable((a, k) for k, v in CURRENCIES.items() for a in v)])
    coded = lambda words: let(F.regexp_extract(words, rf"(?:^| )({CODES})(?: |$)", 1), lambda code: F.when(code == "RMB", "CNY").when(code != "", code))
    named = lambda text: let(F.trim(F.regexp_replace(text, "[^A-Z]+", " ")), lambda words: F.coalesce(F.try_element_at(names, words), coded(words)))
    other = lambda text: F.when((F.length(text) <= 20) & text.rlike("[A-Z]") & ~text.rlike("[0-9]"), F.regexp_replace(text, r"\s+", " "))
    signed = F.when(c.contains("₡"), "CRC").when(c.contains("€"), "EUR").when(c.contains("£"), "GBP").when(c.contains("$"), "USD")
    found = F.coalesce(signed, let(F.upper(fold(F.trim(c))), lambda text: F.coalesce(named(text), other(text))))
    return F.when(_blank_to_null(c).isNull(), F.lit(default)).otherwise(found)


def carrier(c: Column) -> Column:
    return _renamed(F.trim(F.regexp_replace(F.upper(_blank_to_null(c)), r"\s+(?:FAK|BASKET|SPOT|PREMIUM)\s*$", "")), CARRIERS)


def is_base_ports(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z]", "").isin(*BASE_PORT_KEYS)


def port(c: Column) -> Column:
    clean = F.upper(F.trim(F.replace(_blank_to_null(c), F.lit(" "), F.lit(" "))))
    return F.when(is_base_ports(clean), F.lit("/".join(BASE_PORTS))).otherwise(_renamed(clean, PORTS))


def container(c: Column) -> Column:
    names = {"20DV": tuple(f"20{x}" for x in DRY), "40DV": tuple(f"40{x}" for x in DRY_40), "40HC": tuple(f"40{x}" for x in HIGH), "45HC": tuple(f"45{x}" for x in HIGH)}
    return _renamed(F.regexp_replace(F.upper(_blank_to_null(c)), "[^A-Z0-9]", ""), names)


def containers(c: Column) -> Column:
    """The kinds that a heading or cell stands for, in the order 20DV, 40DV, 40HC, 45HC."""
    return let(F.regexp_replace(F.lower(fold(F.trim(c))), "[^a-z0-9]", ""), lambda k: _kinds(c, k))


def _kinds(c: Column, k: Column) -> Column:
    high = k.rlike("40(hc|hq|highcube)") | k.rlike("40(gp|dv|dc|std|st|sv|ft|dry|standard)(and|y)?(40)?(hc|hq|highcube)")
    several = c.contains("/") | c.contains("\\") | k.startswith("4040") | k.rlike("40(gp|dv|dc|std|st|sv)?(y|and)?40hc")
    dry = k.rlike("40(gp|dc|dv|std|st|sv|ft|dry|standard)") | k.rlike("^40(usd|eur|crc|rates?|freight|flete|tarifa|amount|costo|venta|sale|allin|oceanfreight)?$") | (high & several)
    small = k.rlike("(^|[^0-9])20([^0-9]|$)") | k.startswith("20")
    found = [F.when(small, "20DV"), F.when(dry, "40DV"), F.when(high, "40HC"), F.when(k.rlike("45(hc|hq)"), "45HC")]
    return F.coalesce(F.array_compact(F.array(*found)), F.array().cast("array<string>"))


def days(c: Column) -> Column:
    """The first whole number; negative ones are none."""
    n = F.regexp_extract(c, "(-?[0-9]+)", 1).try_cast("int")
    return F.when(n >= 0, n)


def date(c: Column, as_of_year: int) -> Column:
    """A date in any of the usual spellings, day before month; a missing year is ``as_of_year``; whole numbers of five
    digits are days of a spreadsheet. A number of one or two digits is none."""
    return let(F.trim(c), lambda t: F.when(t.isNotNull(), _date_of(t, as_of_year)))


def _date_of(t: Column, as_of_year: int) -> Column:
    text = let(F.trim(F.replace(t, F.lit("."), F.lit(""))), _english)
    text = F.replace(F.initcap(F.lower(F.regexp_replace(text, r"[\s/-]+", " "))), F.lit(" "), F.lit("-"))
    serial = let(F.regexp_extract(t, r"^([0-9]{3,5})(?:[.,][0-9]+)?$", 1).try_cast("int"), lambda n: F.when((n > 1) & (n < 60000), F.date_add(F.lit("1899-12-30").cast("date"), n)))
    return F.coalesce(let(text, lambda x: _dated(x, as_of_year)), serial)


def _english(text: Column) -> Column:
    """A text with Spanish months in English. Most texts name none, which one look at all names tells."""
    named = text
    for name, short in MONTHS.items():
        named = F.regexp_replace(named, rf"(?i)(^|[^A-Za-z]){name}([^A-Za-z]|$)", f"$1{short}$2")
    return F.when(text.rlike(rf"(?i)(?:{'|'.join(MONTHS)})"), named).otherwise(text)


def _dated(text: Column, as_of_year: int) -> Column:
    with_year = F.concat(text, F.lit(f"-{as_of_year}"))
    # patterns apply to texts of their shape only, so that a longer text is not read from its start
    tries = (
        (r"^\d{1,2}-\d{1,2}-\d{4}$", text, ("d-M-yyyy", "M-d-yyyy")),
        (r"^\d{4}-\d{1,2}-\d{1,2}$", text, ("yyyy-M-d",)),
        (r"^\d{8}$", text, ("yyyyMMdd",)),
        (r"^\d{1,2}-\d{1,2}-\d{2}$", text, ("d-M-yy", "M-d-yy")),
        (r"^\d{1,2}-[A-Z][a-z]{2}-\d{4}$", text, ("d-MMM-yyyy",)),
        (r"^\d{1,2}-[A-Z][a-z]{2}-\d{2}$", text, ("d-MMM-yy",)),
        (r"^[A-Z][a-z]{2}-\d{1,2}-\d{4}$", text, ("MMM-d-yyyy",)),
        (r"^\d{1,2}-[A-Z][a-z]{2}$", with_year, ("d-MMM-yyyy",)),
        (r"^[A-Z][a-z]{2}-\d{1,2}$", with_year, ("MMM-d-yyyy",)),
        (r"^\d{1,2}-\d{1,2}$", with_year, ("d-M-yyyy",)),
    )
    return F.coalesce(*[F.when(text.rlike(shape), F.coalesce(*[F.try_to_timestamp(value, F.lit(p)) for p in patterns])) for shape, value, patterns in tries]).cast("date")


def date_range(c: Column, as_of_year: int) -> Column:
    """``(start, end)`` of ``15-21 Aug``, ``15 Aug-21 Aug``, ``2026-08-01 - 2026-08-31`` and ``01-Aug-2026 31-Aug-2026``."""
    return let(F.trim(c), lambda text: _range_of(text, as_of_year))


def _range_of(text: Column, as_of_year: int) -> Column:
    shared = r"^([0-9]{1,2})\s*[-/]\s*([0-9]{1,2})[ /]([A-Za-z]{3,})(?:[ /-]+([0-9]{4}))?$"
    year = F.when(F.regexp_extract(text, shared, 4) != "", F.concat(F.lit(" "), F.regexp_extract(text, shared, 4))).otherwise(F.lit(""))
    ends = r"^([0-9]{1,2}[ -][A-Za-z]{3,}(?:[ -][0-9]{4})?)\s*[-/ ]\s*([0-9]{1,2}[ -][A-Za-z]{3,}(?:[ -][0-9]{4})?)$"
    iso = r"([0-9]{4}-[0-9]{2}-[0-9]{2}).*?([0-9]{4}-[0-9]{2}-[0-9]{2})"
    day = lambda g: F.concat(F.regexp_extract(text, shared, g), F.lit(" "), F.regexp_extract(text, shared, 3), year)
    side = lambda i: F.coalesce(F.when(text.rlike(iso), date(F.regexp_extract(text, iso, i), as_of_year)), F.when(text.rlike(shared), date(day(i), as_of_year)), F.when(text.rlike(ends), date(F.regexp_extract(text, ends, i), as_of_year)))
    return F.struct(side(1).alias("start"), side(2).alias("end"))

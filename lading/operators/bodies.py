"""Which body of a mail holds the offer, and which part of its thread: sections, their scores, and logical lines.

A body is split into lines once; sections are running sums over them. What follows works on one section's array of lines.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lading.functions.text import plain_text
from lading.functions.values import let

# How an offer begins, what shows a rate, and what heads or ends a message.
OFFER = (
    r"(?iu)\b(?:pls|please)\s+consider\s+(?:the\s+)?rate\b"
    r"|\bpublished\s+fak\b"
    r"|\b(?:pls|please)\s+(?:check|see|find)\s+(?:the\s+)?(?:below\s+)?(?:the\s+)?(?:updat(?:e|ed)\s+)?rates?\b"
    r"|\bupdat(?:e|ed)\s+rates?\s+for\s+(?:your\s+)?ref(?:erence)?\b"
)
RATE_SIGN = r"(?iu)\b(?:USD|EUR|CRC|US\$)\s*\d|\$\s*\d|\b(?:POL|POD|POE|COMM(?:ODITY)?|CARRIER)\s*:"
AMOUNT = r"(?iu)(?:(?:\b(?:USD|EUR|CRC)\b|\bUS\$)[^\d\r\n]{0,12}|[$€₡]\s*)\d[\d\s.,]*|\b(?:freight\s*amount|ocean\s*freight|rate\s*amount|flete)\s*[:=]\s*\d[\d\s.,]*"
STRUCTURE = r"(?iu)^(?:[A-Z]\)|POL\s*:|POD\s*:|POE\s*:|COMM(?:ODITY)?\s*:|If\s+big\s+lot\b|BUT\b|Subject\s+to\b|If\s+space\b|Below\s+the\s+details\b|Pls\s+note\b|Please\s+note\b)"
HEADER = (
    r"(?iu)^(?:De|From|发件人|Von|Da|Remitente|·¢¼þÈË)\s*:"
    r"|^(?:Enviado|Sent|发送时间|Date|Fecha|·¢ËÍÊ±¼ä)\s*:"
    r"|^(?:Asunto|Subject|主题|Ö÷Ìâ)\s*:"
    r"|^On\s+.+\bwrote\s*:$|^-{2,}\s*Original Message\s*-{2,}$"
)
SEPARATOR = r"^[_=-]{3,}$"
ENDS = ("un saludo", "regards", "best regards", "kind regards", "worldwide logistics", "发件人:", "de:", "from:", "sent:", "enviado:", "subject:", "asunto:", "·¢¼þèë:", "·¢ëíê±¼ä:", "ö÷ìâ:")
BOUNDARIES = ("un saludo", "regards", "发件人:", "de:", "from:", "subject:", "asunto:", "·¢¼þèë:", "·¢ëíê±¼ä:", "ö÷ìâ:")
CONTEXT = r"(?iu)\bspace\s+is\s+tight\b|\bspace\s+availability\b|\bavailability\b.{0,80}\bconfirm(?:ed|ation)?\b|\brollovers?\b"
KEY = r"(?iu)^(?:POL|POD|POE|COMM(?:ODITY)?)\s*:"
MONEY_LINE = r"(?iu)^(?:USD|EUR|CRC|US\$|\$)\s*\d"
EQUIPMENT = r"(?iu)^(?:20|40|45)\s*['’]?"
# What a text has, and its weight.
WEIGHTS = (
    (r"(?iu)\bPOL\b|\bPuerto\s+de\s+Origen\b|\bOrigin\s+Port\b|\bPort\s+of\s+Loading\b", 14),
    (r"(?iu)\bPOD\b|\bPOE\b|\bPuerto\s+Destino\b|\bDestination\s+Port\b|\bPort\s+of\s+Discharge\b", 14),
    (r"(?iu)\bCarrier\b|\bNaviera\b|\bShipping\s+Line\b", 8),
    (r"(?iu)\b(?:20|40|45)\s*['’]?\s*(?:GP|DV|DC|STD|ST|HC|HQ|NOR|RF)?\b", 10),
    (r"(?iu)\b(?:validity|valid\s+from|valid\s+to|effective\s+date|effective\s+etd|expiry\s+date|vigencia|vencimiento|vence)\b|\b\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\s+(?:AL|TO|A)\s+\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\b", 10),
    (OFFER + r"|\brate\s+(?:USD|EUR|CRC|US\$|[$€₡])", 20),
)
COUNTED = ((OFFER, 120), (r"(?iu)\bPOL\s*:", 8), (r"(?iu)\bPOD\s*:", 8), (r"(?iu)\bCOMM(?:ODITY)?\s*:", 6))
MOST_AMOUNTS, AMOUNT_WEIGHT, WITHOUT_AMOUNT, STRONG = 12, 8, 35, 45


def score(text: Column) -> Column:
    """How much a text looks like an offer; one without an amount stays below ``WITHOUT_AMOUNT``."""
    return let(text, lambda t: let(F.regexp_count(t, F.lit(AMOUNT)), lambda amounts: _scored(t, amounts)))


def _scored(text: Column, amounts: Column) -> Column:
    n = lambda p: F.regexp_count(text, F.lit(p))
    total = F.least(amounts, F.lit(MOST_AMOUNTS)) * AMOUNT_WEIGHT
    for pattern, weight in WEIGHTS:
        total = total + F.when(text.rlike(pattern), weight).otherwise(0)
    for pattern, weight in COUNTED:
        total = total + n(pattern) * weight
    whole = let(total, lambda x: F.when(amounts == 0, F.least(x, F.lit(WITHOUT_AMOUNT))).otherwise(x))
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", 0).otherwise(whole)


def html_lines(body: Column) -> Column:
    """Text of HTML with a line for each row and block and a tab after each cell; all character references decoded."""

    def unescaped(texts: pd.Series) -> pd.Series:
        return texts.map(html.unescape, na_action="ignore")

    c = F.regexp_replace(body, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>", "\n"), "(?i)</(td|th)>", "\t")
    c = F.regexp_replace(F.regexp_replace(c, "(?i)</(tr|p|div|li|h[1-6])>", "\n"), "<[^>]+>", " ")
    return F.when(F.contains(c, F.lit("&")), F.pandas_udf(unescaped, "string")(c)).otherwise(c)


def _squeezed(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r"[ \t]+", " "), F.lit(" \t\n\r"))


def clean_lines(texts: DataFrame) -> DataFrame:
    """``message_id, source, pos, line``: lines without quote marks and bullets at their start; blank ones are left out."""
    # lines are bared before they are parted, once each; a filter on what is worked out afterwards would do so twice
    bare = lambda x: _squeezed(F.regexp_replace(F.btrim(x, F.lit(" \t\r\n")), r"^[>|\-*]+", ""))
    lines = F.transform(F.split(plain_text(F.col("text")), "\n"), bare)
    return texts.select("message_id", "source", F.posexplode(lines).alias("pos", "line")).filter("line <> ''")


def sections(lines: DataFrame) -> DataFrame:
    """``message_id, source, section, lines, score``: a thread cut at headers of quoted messages and at rules.

    A rule belongs to no section, unless there is nothing else. Sections count from the top, the newest message first.
    """
    rule, whole = F.col("line").rlike(SEPARATOR), Window.partitionBy("message_id", "source")
    order = whole.orderBy("pos")
    begins = F.col("line").rlike(HEADER) | F.coalesce(F.lag("rule").over(order), F.lit(False))
    marked = lines.withColumn("rule", rule).withColumn("begins", begins).withColumn("others", F.count_if(~F.col("rule")).over(whole))
    running = F.sum(F.when(F.col("begins") & (F.col("others") > 0), 1).otherwise(0)).over(order)
    kept = marked.withColumn("section", running).filter("not rule or others = 0")
    own = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return kept.groupBy("message_id", "source", "section").agg(own.alias("lines")).withColumn("score", score(F.array_join("lines", "\n")))


def logical_lines(lines: Column) -> Column:
    """Lines that belong together as one, joined by line feeds: an offer with what follows it up to the next rate, and a key
    with a value that goes on. A fold with the line in hand; it reads each line once."""
    starts = lambda x: lambda names: F.exists(F.array(*map(F.lit, names)), lambda n: F.startswith(F.lower(x), n))

    def goes_on(s: Column, x: Column) -> Column:
        offer = (x == ",") | starts(x)(("valid ", "carrier ", "with ", "per ", "(")) | (~x.rlike(RATE_SIGN) & (F.length(x) <= 90))
        count = lambda mark: F.length(s["line"]) - F.length(F.replace(s["line"], F.lit(mark), F.lit("")))
        open_ = (count("(") > count(")")) | F.startswith(x, F.lit("/")) | x.rlike(MONEY_LINE) | s["line"].rlike("[/,]$")
        key = ~starts(x)(BOUNDARIES) & ~x.rlike(SEPARATOR) & open_
        return (s["mode"] > 0) & ~x.rlike(STRUCTURE) & F.when(s["mode"] == 1, offer).otherwise(key)

    def state(text: Column, line: Column, mode: Column) -> Column:
        return F.struct(text.alias("text"), line.alias("line"), mode.cast("int").alias("mode"))

    def step(s: Column, x: Column) -> Column:
        more = F.regexp_replace(x, "^,+", "")
        longer = F.when(F.trim(more) == "", s["line"]).otherwise(F.concat(s["line"], F.when(s["line"].rlike("[ /]$"), "").otherwise(" "), more))
        mode = F.when(x.rlike(OFFER), 1).when(x.rlike(KEY), 2).otherwise(0)
        return F.when(goes_on(s, x), state(s["text"], longer, s["mode"])).otherwise(state(ended(s), x, mode))

    ended = lambda s: F.concat_ws("\n", F.when(s["text"] != "", s["text"]), F.when(s["line"] != "", _squeezed(s["line"])))
    return F.aggregate(lines, state(F.lit(""), F.lit(""), F.lit(0)), step, ended)


def _any(lines: Column, fits) -> Column:
    return F.exists(lines, fits)


def _is(*names: str):
    return lambda x: F.upper(x).isin(*names)


def stacked_header(ahead: Column) -> Column:
    """Whether lines that begin with POL head a table of one cell a line: destination, carrier, equipment and validity."""
    place = lambda x: F.upper(x).isin("POD", "POE") | F.contains(F.upper(x), F.lit("DESTINATION"))
    dated = lambda x: x.rlike(r"(?iu)^(?:effective|expiry|validity|valid\s+from|valid\s+to|vigencia|vencimiento)")
    return _any(ahead, place) & _any(ahead, _is("CARRIER", "NAVIERA")) & _any(ahead, lambda x: x.rlike(EQUIPMENT)) & _any(ahead, dated)


def stacked_shape(text: Column) -> Column:
    """Whether a text holds the head of such a table, as the choice between two bodies asks."""
    dated = lambda x: F.lower(x).rlike("validity|effective|expiry|vigencia")
    whole = lambda a: _any(a, _is("POD", "POE")) & _any(a, _is("CARRIER", "NAVIERA")) & _any(a, dated) & _any(a, lambda x: x.rlike(EQUIPMENT))
    lines = F.split(text, "\n")
    return let(lines, lambda ls: F.size(F.filter(ls, lambda x, i: F.when(F.upper(x) == "POL", whole(F.slice(ls, i + 1, 12))).otherwise(False))) > 0)


def newest_offer(lines: Column) -> Column:
    """From the first line that begins an offer, with up to three lines on space before it, to the end of the message; all
    lines where none begins."""

    def begins(x: Column, i: Column) -> Column:
        named = lambda y: (F.upper(y) == "POL") | F.startswith(F.upper(y), F.lit("POL:"))
        return x.rlike(OFFER) | F.when(F.upper(x) == "FAK", _any(F.slice(lines, i + 2, 8), named)).when(F.upper(x) == "POL", stacked_header(F.slice(lines, i + 1, 12))).otherwise(False)

    places = F.filter(F.transform(lines, lambda x, i: F.when(begins(x, i), i)), lambda i: i.isNotNull())

    def cut(at: Column) -> Column:
        told = lambda k: F.coalesce(F.get(lines, at - k).rlike(CONTEXT) & (at >= k), F.lit(False))
        before = F.when(told(1) & told(2) & told(3), 3).when(told(1) & told(2), 2).when(told(1), 1).otherwise(0)
        closes = lambda x: F.exists(F.array(*map(F.lit, ENDS)), lambda n: F.startswith(F.lower(x), n)) | x.rlike(SEPARATOR)
        end = F.coalesce(F.get(F.filter(F.transform(lines, lambda x, i: F.when((i > at) & closes(x), i)), lambda i: i.isNotNull()), F.lit(0)), F.size(lines))
        return let(F.slice(lines, at - before + 1, end - at + before), logical_lines)

    return let(F.get(places, F.lit(0)), lambda at: F.when(at.isNull(), F.array_join(lines, "\n")).otherwise(cut(at)))


def _texts(messages: DataFrame) -> DataFrame:
    plain = messages.select("message_id", F.lit("text").alias("source"), F.col("body_text").alias("text"))
    return plain.unionByName(messages.select("message_id", F.lit("html").alias("source"), html_lines(F.col("body_html")).alias("text")))


def _chosen(messages: DataFrame, focused: DataFrame, prefers_text: Column) -> DataFrame:
    """The focused text or HTML of each message: text if it scores as high as HTML and above 0, else HTML if it scores, else
    the first that isn't blank."""
    of = lambda s: F.max(F.when(F.col("source") == s, F.struct("focus", score(F.col("focus")).alias("score"))))
    both = focused.groupBy("message_id").agg(of("text").alias("t"), of("html").alias("h"))
    t, h = F.coalesce("t.score", F.lit(0)), F.coalesce("h.score", F.lit(0))
    source = F.when(prefers_text, "text").when((t > 0) & (t >= h), "text").when(h > 0, "html").when(F.trim("t.focus") != "", "text").when(F.trim("h.focus") != "", "html")
    picked = both.withColumn("source", source).withColumn("body", F.when(F.col("source") == "text", F.col("t.focus")).when(F.col("source") == "html", F.col("h.focus")).otherwise(""))
    out = picked.select("message_id", "source", "body", F.when(F.col("source") == "text", t).when(F.col("source") == "html", h).otherwise(0).alias("score"))
    return messages.select("message_id").distinct().join(out, "message_id", "left").select("message_id", "source", F.coalesce("body", F.lit("")).alias("body"), F.coalesce("score", F.lit(0)).alias("score"))


def preferred_bodies(messages: DataFrame) -> DataFrame:
    """``message_id, source, body, score`` of ``messages(message_id, body_text, body_html)``: the offer in each mail.

    Of text and HTML each the first section that scores ``STRONG`` counts, from where its offer begins; without one the
    newest section. Text with a table of one cell a line wins; else the higher score, text on ties. Null and blank bodies
    give an empty one with a null source. A message has one row; messages that share an id are read as one.
    """
    of = F.struct((F.col("score") < STRONG).alias("weak"), "section", "lines")
    best = sections(clean_lines(_texts(messages))).groupBy("message_id", "source").agg(F.min(of).alias("best"))
    focused = best.select("message_id", "source", F.when(F.col("best.weak"), logical_lines(F.col("best.lines"))).otherwise(newest_offer(F.col("best.lines"))).alias("focus"))
    return _chosen(messages, focused, F.coalesce(stacked_shape(F.col("t.focus")), F.lit(False)))


def current_bodies(messages: DataFrame) -> DataFrame:
    """Like ``preferred_bodies``, but the newest message only, without what it quotes: for mails whose rates are attached."""
    first = sections(clean_lines(_texts(messages))).groupBy("message_id", "source").agg(F.min(F.struct("section", "lines")).alias("first"))
    focused = first.select("message_id", "source", logical_lines(F.col("first.lines")).alias("focus"))
    return _chosen(messages, focused, F.lit(False))

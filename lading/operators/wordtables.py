"""Tables in positioned words of a page: lines, headings by phrase, and words dealt to the nearest column.

Words are ``doc_id, page, word, left, right, bottom``. A page's headings give a short array of column bounds; each word finds
its column in it by its centre, so the join of words with columns is one on the page and moves no more than the words.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lading.functions import values
from lading.functions.text import header_key
from lading.operators import linetables

# How the columns of a tariff are headed, as keys of words; the first phrase that a line holds counts.
ORIGIN = (("puerto", "de", "origen"), ("origin", "port"), ("port", "of", "loading"), ("pol",))
DESTINATION = (("puerto", "destino"), ("destination", "port"), ("port", "of", "discharge"), ("pod",), ("poe",))
VALIDITY = (("validity", "date"), ("validity",), ("vigencia",), ("fecha", "vigencia"))
CARRIER = (("carrier",), ("naviera",), ("shipping", "line"))
REGION = (("region",),)
DATE = r"\b\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\b"


def phrase_start(words: Column, phrases: Sequence[Sequence[str]]) -> Column:
    """Where the first of ``phrases`` that occurs in a line begins: ``left`` of its first word, or null. ``words`` are
    structs with ``key`` and ``left`` in reading order."""

    def at(phrase: Sequence[str]) -> Column:
        def fits(_: Column, i: Column) -> Column:
            met = F.lit(True)
            for k, key in enumerate(phrase):
                met = met & (F.get(words, i + k)["key"] == key)
            return met

        return F.get(F.filter(words, fits), F.lit(0))["left"]

    return F.coalesce(*map(at, phrases))


def _middle(a: Column, b: Column) -> Column:
    return a + (b - a) / 2.0


def tariff_headers(words: DataFrame) -> DataFrame:
    """``doc_id, page, line, bounds``: the first line of each page that heads a tariff whose carrier is no column.

    Such a line names origin, destination and validity and has two container columns or more between the last two, in
    this order. ``bounds`` holds for each column its name and the least centre of its words: the middle between the starts
    of neighbouring headings. A region before the origin bounds it on the left and has no column of its own.
    """
    in_line = F.array_sort(F.collect_list(F.struct("left", "right", "word", header_key(F.col("word")).alias("key"))))
    lines = words.groupBy("doc_id", "page", "line").agg(in_line.alias("ws"))
    # most lines lack a first word of these phrases: they end here, before phrases are looked for
    for phrases in (ORIGIN, DESTINATION, VALIDITY):
        firsts = F.array(*[F.lit(k) for k in sorted({p[0] for p in phrases})])
        lines = lines.filter(F.arrays_overlap(F.col("ws")["key"], firsts))
    starts = {"origin": ORIGIN, "destination": DESTINATION, "validity": VALIDITY, "carrier": CARRIER, "region": REGION}
    heads = lines.select("doc_id", "page", "line", "ws", *[phrase_start(F.col("ws"), p).alias(n) for n, p in starts.items()])
    heads = heads.filter("origin < destination and validity is not null and carrier is null")
    kinds = F.transform("ws", lambda w: F.struct(w["left"].alias("start"), w["word"].alias("word"), values.containers(w["word"]).alias("kinds")))
    named = lambda w: F.struct(w["start"].alias("start"), F.when(F.size(w["kinds"]) > 1, F.array_join(w["kinds"], "/")).otherwise(F.trim(w["word"])).alias("name"))
    heads = heads.withColumn("amounts", F.transform(F.filter(kinds, lambda w: F.size(w["kinds"]) > 0), named)).filter(F.size("amounts") >= 2)
    heads = heads.filter((F.col("destination") < F.col("amounts")[0]["start"]) & (F.element_at("amounts", -1)["start"] < F.col("validity")))
    column = lambda low, name: F.struct(low.alias("low"), name.alias("name"))
    before = lambda i: F.when(i == 0, F.col("destination")).otherwise(F.get(F.col("amounts"), i - 1)["start"])
    bounds = F.concat(
        F.array(
            column(F.coalesce(_middle(F.col("region"), F.col("origin")), F.lit(float("-inf"))), F.lit("POL")),
            column(_middle(F.col("origin"), F.col("destination")), F.lit("POE")),
        ),
        F.transform("amounts", lambda a, i: column(_middle(before(i), a["start"]), a["name"])),
        F.array(column(_middle(F.element_at("amounts", -1)["start"], F.col("validity")), F.lit("Validity"))),
    )
    first = heads.select("doc_id", "page", F.struct("line", bounds.alias("bounds")).alias("h")).groupBy("doc_id", "page").agg(F.min("h").alias("h"))
    return first.select("doc_id", "page", "h.line", "h.bounds")


def in_columns(words: DataFrame, headers: DataFrame) -> DataFrame:
    """Texts of the cells below each page's header: ``doc_id, page, line, place, name, width, text``.

    A word lies in the last column whose bound is not right of its centre; words left of all bounds lie in none.
    """
    heads = headers.select("doc_id", "page", F.col("line").alias("head"), "bounds")
    centre = (F.col("left") + F.col("right")) / 2.0
    place = F.array_max(F.transform("bounds", lambda b, i: F.when(b["low"] <= F.col("centre"), i + 1).otherwise(0)))
    body = words.join(heads, ["doc_id", "page"]).filter("line > head").withColumn("centre", centre).withColumn("place", place).filter("place > 0")
    cell = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "right", "word"))), lambda w: F.trim(w["word"])), " ")
    cells = body.groupBy("doc_id", "page", "line", "place").agg(cell.alias("text"), F.first("bounds").alias("bounds"))
    return cells.select("doc_id", "page", "line", "place", F.col("bounds")[F.col("place") - 1]["name"].alias("name"), F.size("bounds").alias("width"), "text")


def tariff_tables(words: DataFrame) -> DataFrame:
    """Rows of visual tariff matrices: ``doc_id, row_number, pos, header, value`` as other sources of cells give them.

    For documents that name one carrier. A row has an origin, a destination, a validity with two dates and one amount at
    least; cells that are no amounts stay empty, and of two columns with one name the later counts. Rows are numbered from
    2 over all pages; free days that the document states go to every row. Pages without a header give none. Blank words
    are left out; null places sort first.
    """
    numbered = linetables.numbered_words(words)
    cells = in_columns(numbered, tariff_headers(numbered))
    amount = (F.col("place") > 2) & (F.col("place") < F.col("width"))
    kept = cells.withColumn("is_amount", amount).filter(~F.col("is_amount") | values.money(F.col("text")).isNotNull())
    dated = F.regexp_count("text", F.lit(DATE)) >= 2
    rows = kept.groupBy("doc_id", "page", "line").agg(
        F.max(F.when(F.col("place") == 1, F.col("text"))).alias("origin"),
        F.max(F.when(F.col("place") == 2, F.col("text"))).alias("destination"),
        F.max(F.when((F.col("place") == F.col("width")) & dated, F.col("text"))).alias("validity"),
        F.array_sort(F.collect_list(F.when(F.col("is_amount"), F.struct("place", "name", "text")))).alias("amounts"),
    )
    rows = rows.filter("origin is not null and destination is not null and validity is not null and size(amounts) > 0")
    said = document_hints(numbered.join(rows.select("doc_id").distinct(), "doc_id", "left_semi")).filter("carrier is not null")
    rows = rows.join(said, "doc_id").withColumn("row_number", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "line")) + 1)
    later = lambda a, i: ~F.exists(F.slice(F.col("amounts"), i + 2, F.size("amounts")), lambda b: F.lower(b["name"]) == F.lower(a["name"]))
    cell = lambda name, value: F.struct(F.lit(name).alias("header"), value.alias("value"))
    whole = F.concat(
        F.array(cell("POL", F.col("origin")), cell("POE", F.col("destination")), cell("Carrier", F.col("carrier")), cell("Currency", F.lit("USD"))),
        F.transform(F.filter("amounts", later), lambda a: F.struct(a["name"].alias("header"), a["text"].alias("value"))),
        F.when(F.col("free_days").isNotNull(), F.array(cell("Free Time", F.concat(F.col("free_days").cast("string"), F.lit(" days"))))).otherwise(F.array().cast("array<struct<header:string,value:string>>")),
        F.array(cell("Validity", F.col("validity"))),
    )
    return rows.select("doc_id", "row_number", F.posexplode(whole).alias("pos", "c")).select("doc_id", "row_number", "pos", "c.header", "c.value")


def document_hints(numbered: DataFrame) -> DataFrame:
    """``doc_id, carrier, free_days`` that the lines of whole documents say."""
    lines = linetables.joined_lines(numbered)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line", "text"))), lambda x: x["text"]), "\n")
    texts = lines.groupBy("doc_id").agg(text.alias("text"))
    return texts.select("doc_id", linetables.the_carrier(F.col("text")).alias("carrier"), linetables.free_days(F.col("text")).alias("free_days"))

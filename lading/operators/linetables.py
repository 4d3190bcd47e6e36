"""Tables inside lines of text: positioned words, delimited rows, one cell a line, and key and value pairs.

Lines are ``doc_id, pos, text``. What a heading means comes from a mapping table ``key, field`` (see ``sheets``), which is a
dictionary of some hundred rows that Spark broadcasts by its size. Every parser gives ``doc_id, row_number, pos, header,
value`` as the other sources do, so that ``sheets.cells_to_rows`` maps them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lading.functions.text import header_key
from lading.functions.values import let

#: Words on one line differ by so many points from the line's first word; a wider gap than GAP parts columns.
SAME_LINE, GAP = 3.0, 14.0
#: Known headings that make a line, or a run of lines, the head of a table; the longest run of lines that does.
LEAST_HEADINGS, MOST_STACKED = 3, 14
#: Delimiters in the order in which they win a tie; the last is tabs or runs of spaces.
DELIMITERS = ("|", "\t", ";", ",")
ALIGNED = r"(?:\t+| {2,})"
NOISE = r"(?i)^\s*(page|p[áa]gina)\s*\d+(\s*(of|de)\s*\d+)?\s*$"
TERMINATOR = r"(?i)^\s*(remarks?|notes?|notas?|observaciones|terms|conditions|condiciones|best regards|regards|saludos|from:|sent:|de:|enviado:)"
# How carriers are written in running text; short names count in capitals only.
CARRIER_MARKS = {
    "CMA CGM": r"(?i)\bCMA\s*CGM\b",
    "HAPAG-LLOYD": r"(?i)\bHAPAG(?:-|\s*)LLOYD\b",
    "EVERGREEN": r"(?i)\bEVERGREEN\b",
    "MAERSK": r"(?i)\bMAERSK\b",
    "COSCO": r"\bCOSCO\b",
    "OOCL": r"\bOOCL\b",
    "MSC": r"\bMSC\b",
    "PIL": r"\bPIL\b",
    "ONE": r"\bONE\b",
    "WHL": r"\bWHL\b",
}
# Fixed value: how free days are stated for a whole document.
FREE_DAYS = r"(?iu)(?:tiempo\s+libre|free\s*time|free\s*days)[^\d]{0,100}(\d{1,3})\s*(?:d[ií]as?|days?)"


def numbered_words(words: DataFrame) -> DataFrame:
    """``words(doc_id, page, word, left, right, bottom)`` with the number of their ``line``, from the top of each page down.

    A word belongs to the line whose first word is within ``SAME_LINE`` of it in height. As the tolerance is anchored at the
    first word, a fold over the page's heights finds where lines begin; a page has some hundreds of them at most. Blank
    words are left out.
    """
    of = F.struct((-F.col("bottom")).alias("down"), "left", "right", F.trim("word").alias("word"))
    pages = words.filter(F.trim("word") != "").groupBy("doc_id", "page").agg(F.collect_list(of).alias("ws"))
    begins = lambda acc, y: F.coalesce(y - F.try_element_at(acc, F.lit(-1)) > SAME_LINE, F.size(acc) == 0)
    heights = F.array_sort(F.array_distinct(F.transform("ws", lambda w: w["down"])))
    anchors = F.aggregate(heights, F.array().cast("array<double>"), lambda acc, y: F.when(begins(acc, y), F.concat(acc, F.array(y))).otherwise(acc))
    flat = pages.withColumn("anchors", anchors).select("doc_id", "page", "anchors", F.explode("ws").alias("w"))
    line = F.size(F.filter("anchors", lambda a: a <= F.col("w.down")))
    return flat.select("doc_id", "page", line.alias("line"), "w.left", "w.right", "w.word")


def joined_lines(numbered: DataFrame) -> DataFrame:
    """``doc_id, page, line, text`` of numbered words: a gap above ``GAP`` becomes three spaces, others one."""
    joint = lambda gap: F.when(gap.isNull(), "").when(gap > GAP, "   ").otherwise(" ")
    before = lambda ws, i: F.when(i > 0, F.get(ws, i - 1)["right"])
    joined = lambda ws: F.array_join(F.transform(ws, lambda w, i: F.concat(let(w["left"] - before(ws, i), joint), w["word"])), "")
    text = let(F.array_sort(F.collect_list(F.struct("left", "right", "word"))), joined)
    return numbered.groupBy("doc_id", "page", "line").agg(text.alias("text"))


def words_to_lines(words: DataFrame) -> DataFrame:
    """Lines of positioned words as ``doc_id, pos, text``, from the top of each page down."""
    lines = joined_lines(numbered_words(words))
    return lines.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "line")) - 1).alias("pos"), "text")


def text_lines(texts: DataFrame) -> DataFrame:
    """``texts(doc_id, text)`` as lines, without page numbers and other noise."""
    lines = texts.select("doc_id", F.posexplode(F.split("text", "\r?\n")).alias("pos", "text"))
    return lines.filter(~F.col("text").rlike(NOISE))


def cells_of(text: Column, delimiter: str | None) -> Column:
    """Cells of a line; bars at its ends belong to none."""
    if delimiter is None:
        return F.transform(F.split(F.trim(text), ALIGNED), lambda c: F.trim(c))
    bare = F.regexp_replace(F.trim(text), r"^\||\|$", "") if delimiter == "|" else text
    return F.transform(F.split(bare, "[" + delimiter + "]"), lambda c: F.trim(c))


def _shaped(cells: Column, width: Column) -> Column:
    """Cells in the width of the header: those beyond it go to the last column, missing ones are null."""
    last = F.array_join(F.slice(cells, width, F.size(cells)), " ")
    return F.when(F.size(cells) > width, F.concat(F.slice(cells, 1, width - 1), F.array(last))).otherwise(cells)


def delimited_tables(lines: DataFrame, mappings: DataFrame) -> DataFrame:
    """The first delimited table of each document.

    Its header is the first line where, by some delimiter, three cells or more are known headings; of delimiters the one
    with most known headings, then most cells, then the first of bar, tab, semicolon, comma and aligned spaces. Rows follow
    up to a blank or closing line. A line that repeats the header is none.
    """
    marks = [*DELIMITERS, None]
    # a line without a delimiter is one cell by it
    parted = lambda d: F.contains("text", F.lit(d)) if d else F.col("text").rlike("\t|  ")
    split = F.array_compact(F.array(*[F.when(parted(d), F.struct(F.lit(-i).alias("order"), cells_of(F.col("text"), d).alias("cells"))) for i, d in enumerate(marks)]))
    tries = lines.filter(F.col("text").rlike("[|\t;,]|  ")).withColumn("t", F.explode(split)).select("doc_id", "pos", "t.order", "t.cells").filter(F.size("cells") >= LEAST_HEADINGS)
    heads = tries.select("doc_id", "pos", "order", F.size("cells").alias("width"), F.explode(F.array_distinct(F.transform("cells", header_key))).alias("key")).join(mappings.select("key"), "key")
    heads = heads.groupBy("doc_id", "pos", "order", "width").agg(F.count("*").alias("known")).filter(F.col("known") >= LEAST_HEADINGS)
    first = heads.groupBy("doc_id").agg(F.min(F.struct("pos", (-F.col("known")).alias("k"), (-F.col("width")).alias("w"), (-F.col("order")).alias("o"))).alias("h"))
    first = first.select("doc_id", F.col("h.pos").alias("at"), (-F.col("h.o")).alias("order"))
    # documents without a header end here; of the others only lines from the header on go further
    body = lines.join(first, "doc_id").filter(F.col("pos") >= F.col("at"))
    whole = Window.partitionBy("doc_id")
    ends = (F.col("pos") > F.col("at")) & ((F.trim("text") == "") | F.col("text").rlike(TERMINATOR))
    body = body.withColumn("stop", F.min(F.when(ends, F.col("pos"))).over(whole)).filter(F.col("stop").isNull() | (F.col("pos") < F.col("stop")))
    cells = F.lit(None).cast("array<string>")
    for i, d in enumerate(marks):
        cells = F.when(F.col("order") == -i, cells_of(F.col("text"), d)).otherwise(cells)
    body = body.withColumn("cells", cells).withColumn("header", F.max(F.when(F.col("pos") == F.col("at"), F.col("cells"))).over(whole))
    rows = body.filter((F.col("pos") > F.col("at")) & (F.size("cells") >= 2) & (F.col("cells") != F.col("header")))
    return _cells(rows.withColumn("cells", _shaped(F.col("cells"), F.size("header"))), "pos")


def _cells(rows: DataFrame, order: str) -> DataFrame:
    """Rows with arrays ``header`` and ``cells`` as numbered rows of cells; blank cells are null."""
    numbered = rows.withColumn("row_number", F.row_number().over(Window.partitionBy("doc_id").orderBy(order)))
    zipped = numbered.select("doc_id", "row_number", F.posexplode(F.arrays_zip("header", "cells")).alias("pos", "c"))
    return zipped.select("doc_id", "row_number", "pos", "c.header", F.when(F.trim("c.cells") != "", F.trim("c.cells")).alias("value")).filter(F.trim("header") != "")


def stacked_tables(lines: DataFrame, mappings: DataFrame) -> DataFrame:
    """Tables that came with one cell a line: a run of four to ``MOST_STACKED`` lines that are known headings, then cells in
    the order of the headings, up to a closing line. The first of each document; a last row that is not whole goes."""
    kept = lines.filter(F.trim("text") != "")
    kept = kept.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))).withColumn("key", header_key(F.col("text")))
    known = kept.join(mappings.select("key"), "key", "left_semi")
    runs = known.withColumn("run", F.col("n") - F.row_number().over(Window.partitionBy("doc_id").orderBy("n")))
    runs = runs.groupBy("doc_id", "run").agg(F.min("n").alias("low"), F.count("*").alias("width"), F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: F.trim(x["text"])).alias("header"))
    runs = runs.filter(F.col("width").between(LEAST_HEADINGS + 1, MOST_STACKED))
    head = runs.groupBy("doc_id").agg(F.min(F.struct("low", "width", "header")).alias("h")).select("doc_id", "h.low", "h.width", "h.header")
    body = kept.join(head, "doc_id").filter(F.col("n") >= F.col("low") + F.col("width"))
    body = body.withColumn("stop", F.min(F.when(F.col("text").rlike(TERMINATOR), F.col("n"))).over(Window.partitionBy("doc_id"))).filter(F.col("stop").isNull() | (F.col("n") < F.col("stop")))
    place = F.col("n") - F.col("low") - F.col("width")
    body = body.withColumn("row", F.floor(place / F.col("width"))).withColumn("column", place % F.col("width"))
    rows = body.groupBy("doc_id", "row", "header", "width").agg(F.transform(F.array_sort(F.collect_list(F.struct("column", "text"))), lambda x: x["text"]).alias("cells"))
    return _cells(rows.filter(F.size("cells") == F.col("width")), "row")


def key_value_rows(lines: DataFrame, mappings: DataFrame, least: int = 4) -> DataFrame:
    """Rows from lines such as ``POL: Shanghai``: a row begins wherever the document's first known key comes again. Kept are
    rows of ``least`` known values or more that name a place, a carrier or an amount."""
    pair = r"^\s*([\p{L}][\p{L}0-9 '/.()-]{0,40}?)\s*[:=]\s*(\S.*)$"
    found = lines.filter(F.col("text").rlike("[:=]")).withColumn("header", F.regexp_extract("text", pair, 1)).withColumn("value", F.trim(F.regexp_extract("text", pair, 2))).filter("header <> '' and value <> ''")
    found = found.withColumn("key", header_key(F.col("header"))).join(mappings, "key")
    running = Window.partitionBy("doc_id").orderBy("pos")
    found = found.withColumn("first", F.first("field").over(running)).withColumn("row_number", F.sum(F.when(F.col("field") == F.col("first"), 1).otherwise(0)).over(running))
    telling = F.col("field").isin("OriginPort", "PortOfExit", "DestinationPort", "Carrier", "OceanFreight", "TotalSale", "AllInSale")
    row = Window.partitionBy("doc_id", "row_number")
    whole = found.withColumn("fields", F.size(F.collect_set("field").over(row))).withColumn("tells", F.bool_or(telling).over(row)).filter((F.col("fields") >= least) & F.col("tells"))
    return whole.select("doc_id", "row_number", "pos", "header", "value")


def mail_tables(lines: DataFrame, mappings: DataFrame) -> DataFrame:
    """The table of each document by the first parser that finds one: stacked cells, delimited rows, key and value pairs.
    ``parser`` says which; documents without a table give no rows."""
    parsers = (("stacked", stacked_tables), ("delimited", delimited_tables), ("pairs", key_value_rows))
    found = [p(lines, mappings).select("doc_id", "row_number", "pos", "header", "value", F.lit(name).alias("parser"), F.lit(i).alias("turn")) for i, (name, p) in enumerate(parsers)]
    every = reduce(DataFrame.unionByName, found)
    return every.withColumn("first", F.min("turn").over(Window.partitionBy("doc_id"))).filter("turn = first").drop("turn", "first")


def the_carrier(text: Column) -> Column:
    """The carrier that a text names, if it names exactly one."""
    found = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(c)) for c, p in CARRIER_MARKS.items()]))
    return F.when(F.size(found) == 1, found[0])


def free_days(text: Column) -> Column:
    """Days said to be free for all rates of a text: ``Free time at destination: 21 days``, ``Tiempo libre 14 días``."""
    return F.nullif(F.regexp_extract(text, FREE_DAYS, 1), F.lit("")).try_cast("int")

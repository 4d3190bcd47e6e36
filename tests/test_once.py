"""What costs much is worked out once for each row: Spark repeats what a filter or the explosion of a bare column names."""

from __future__ import annotations

from pyspark.sql import functions as F

from lading import mail_queries as mails
from lading import page_queries as pages
from lading import queries as rates
from lading.functions.values import currency, date, money
from lading.operators import grids
from lading.operators.selection import keyword_hits, text_table

SF = "/root/testdata/sf0.001"


def filters(df):
    """The conditions of filters in the optimized plan."""
    node, found, todo = None, [], [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "Filter":
            found.append(node.condition().toString())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return "\n".join(found)


def test_replies_are_read_once(spark):
    for query in (pages.reply_lines, pages.reply_rates):
        assert "parseJson" not in filters(query(spark, SF))


def test_issues_are_found_once(spark):
    assert "missing_agent" not in filters(rates.issue_counts(spark, SF))


def test_offers_are_read_once(spark):
    assert "regexp_extract" not in filters(pages.narrative_offers(spark, SF))


def test_lines_are_bared_once(spark):
    assert "regexp_replace" not in filters(pages.thread_bodies(spark, SF))


def test_words_are_joined_without_a_window(spark):
    plan = mails.word_lines(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "lag(" not in plan


def test_lines_are_parted_by_delimiters_they_hold(spark):
    asked = filters(mails.mail_tables(spark, SF))
    assert ", [:=])" in asked and ", [|" in asked


def test_amounts_are_read_once(spark):
    assert money(F.col("x"))._jc.toString().count("regexp_replace") == 1
    assert currency(F.col("x"))._jc.toString().count("translate") == 1


def test_dates_with_and_without_spanish_months(spark):
    df = spark.createDataFrame([(x,) for x in ("20 agosto", "14 ago", "1.set.2026", "2026-08-15", "15 Aug", None, "46235", "32 agosto")], "x string")
    out = [str(r[0]) for r in df.select(date(F.col("x"), 2026)).collect()]
    assert out == ["2026-08-20", "2026-08-14", "None", "2026-08-15", "2026-08-15", "None", "2026-08-01", "None"]
    assert "(?i)(?:ene|" in date(F.col("x"), 2026)._jc.toString()


def test_keywords_in_letters_that_fold(spark):
    texts = ["RATE\u017f pol", "val\u0130dity v\u0131gencia", "celebrate police", "", "COTIZACI\u00d3N, ocean freight", "P-O.L"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(keyword_hits(F.col("t"))).collect()] == [2, 2, 0, 0, 3, 0]
    assert "contains" in keyword_hits(F.col("t"))._jc.toString()
    stacked = spark.createDataFrame([("P-o.l:\npod\n\nCarrier\n40HC",), ("pol x\npod\ncarrier\n40hc",), ("a|b|c\nd|e|f",), (None,)], "t string")
    assert [r[0] for r in stacked.select(text_table(F.col("t"))).collect()] == [True, False, True, False]


def test_workbooks_are_read_once(spark):
    query = pages.grid_tariffs(spark, SF)
    asked = filters(query)
    assert "regexp" not in asked and "RLIKE" not in asked and "translate" not in asked
    # orders for the notes of workbooks and for the rows below, the values of both, and the dictionary
    assert query._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 5
    assert grids.remarks(F.lit("Diamond Tier"), F.lit("p"), F.col("x"))._jc.toString().count("translate") == 1

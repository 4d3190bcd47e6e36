"""Tables in positioned words."""

from lading.operators import linetables, wordtables

SCHEMA = "doc_id int, page int, word string, left double, right double, bottom double"
HEAD = [("Puerto", 80, 110), ("de", 115, 125), ("Origen", 130, 160), ("Puerto", 200, 230), ("Destino", 235, 270), ("20'", 300, 315), ("40HC", 360, 385), ("Vigencia", 430, 480)]
ROW = [("Shang", 60, 90), ("hai", 92, 110), ("Moin", 205, 230), ("$1,200", 295, 325), ("1400", 355, 380), ("01/08/2026", 420, 460), ("15-08-26", 465, 500)]


def on(line, words, page=1, doc=1):
    return [(doc, page, w, float(a), float(b), 700.0 - 14 * line) for w, a, b in words]


def tables(spark, rows):
    got = wordtables.tariff_tables(spark.createDataFrame(rows, SCHEMA)).orderBy("doc_id", "row_number", "pos").collect()
    out = {}
    for r in got:
        out.setdefault((r["doc_id"], r["row_number"]), []).append((r["header"], r["value"]))
    return out


def test_words_find_their_columns(spark):
    brand, free = on(0, [("PIL", 10, 30)]), on(1, [("Free", 10, 30), ("time:", 32, 50), ("21", 52, 60), ("days", 62, 80)])
    got = tables(spark, brand + free + on(2, HEAD) + on(3, ROW) + on(4, ROW))
    want = [("POL", "Shang hai"), ("POE", "Moin"), ("Carrier", "PIL"), ("Currency", "USD"), ("20'", "$1,200"), ("40HC", "1400"), ("Free Time", "21 days"), ("Validity", "01/08/2026 15-08-26")]
    assert got == {(1, 2): want, (1, 3): want}


def test_what_heads_no_tariff(spark):
    brand = lambda d: on(0, [("PIL", 10, 30)], doc=d)
    own = lambda d, head, row=ROW: brand(d) + on(1, head, doc=d) + on(2, row, doc=d)
    rows = own(1, [*HEAD, ("Naviera", 500, 540)])  # the carrier is a column
    rows += own(2, [h for h in HEAD if h[0] != "40HC"])  # one amount
    rows += own(3, [(w, 600 - b, 600 - a) for w, a, b in HEAD])  # in another order
    rows += own(4, HEAD) + on(9, [("and", 10, 30), ("MSC", 40, 60)], doc=4)  # two carriers
    rows += on(1, HEAD, doc=5) + on(2, ROW, doc=5)  # none
    rows += own(6, HEAD, [w for w in ROW if w[0] != "Moin"]) + own(7, HEAD, [w for w in ROW if w[0] != "15-08-26"])
    rows += own(8, HEAD, [w if w[0] not in ("$1,200", "1400") else ("n/a", *w[1:]) for w in ROW])
    rows += own(9, HEAD, [w if w[0] != "1400" else ("n/a", *w[1:]) for w in ROW])
    got = tables(spark, rows)
    assert list(got) == [(9, 2)] and ("40HC", "1400") not in got[9, 2] and ("20'", "$1,200") in got[9, 2]


def test_pages_and_a_region(spark):
    region = [("Region", 10, 40), *HEAD]
    row = [("Asia", 12, 30), *ROW]
    rows = on(0, [("PIL", 10, 30)]) + on(1, row) + on(1, HEAD, page=2) + on(2, row, page=2) + on(1, region, page=3) + on(2, row, page=3) + on(3, region, page=3)
    got = tables(spark, rows)
    assert [dict(v)["POL"] for v in got.values()] == ["Asia Shang hai", "Shang hai"] and list(got) == [(1, 2), (1, 3)]


def test_two_columns_of_one_name(spark):
    head = [("POL", 80, 100), ("POE", 200, 220), ("40HC", 300, 320), ("40hc", 360, 380), ("Validity", 430, 480)]
    got = tables(spark, on(0, [("PIL", 10, 30)]) + on(1, head) + on(2, ROW))
    assert [c for c in got[1, 2] if c[0].lower() == "40hc"] == [("40hc", "1400")]


def test_awkward_words(spark):
    rows = on(0, [("PIL", 10, 30)]) + on(1, HEAD) + on(2, ROW) + [(1, 1, " ", 1.0, 2.0, 650.0), (1, 1, None, 1.0, 2.0, 650.0), (1, 1, "x", None, None, None), (None, None, "y", 1.0, 2.0, 3.0)]
    assert list(tables(spark, rows)) == [(1, 2)] and tables(spark, []) == {}


def test_lines_are_anchored_at_their_first_word(spark):
    rows = [(1, 1, w, float(i * 20), float(i * 20 + 5), 100.0 - y) for i, (w, y) in enumerate([("a", 0), ("b", 2), ("c", 3), ("d", 4), ("e", 6.5), ("f", 7.5)])]
    got = linetables.words_to_lines(spark.createDataFrame(rows, SCHEMA)).orderBy("pos").collect()
    assert [r["text"] for r in got] == ["a   b   c", "d   e", "f"]


def test_hints_of_a_document(spark):
    texts = ["Free days at destination: 14 dias", "FREE TIME 7 Days", "tiempo libre en puerto 21 DÍAS", "Hapag Lloyd rates", "PIL", "pil one", "CMACGM and Maersk", "free time none", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", linetables.free_days(df.t).alias("f"), linetables.the_carrier(df.t).alias("c")).orderBy("i").collect()
    assert [r["f"] for r in got] == [14, 7, 21, None, None, None, None, None, None]
    assert [r["c"] for r in got] == [None, None, None, "HAPAG-LLOYD", "PIL", None, None, None, None]

"""The choice of a mail's body and of the part of its thread."""

from lading.operators import bodies

OFFER = "Pls consider the rate USD 1200 per 40HC\nwith validity 31/08/2026\nPOL: Shanghai /\nNingbo\nPOD: Moin (via\nColon) port\nUSD 50 extra"
WHOLE = "Pls consider the rate USD 1200 per 40HC with validity 31/08/2026\nPOL: Shanghai /Ningbo\nPOD: Moin (via Colon) port"
OLD = "\n".join(f"Please consider rate USD {n}00 POL: A POD: B carrier validity 40HC" for n in range(1, 9))
STACK = "POL\nPOD\nCarrier\n20'\n40HC\nValidity (ETD)\nShanghai\nMoin\nMSC\n$1\n$2\n1-Aug"


def chosen(spark, *mails, how=bodies.preferred_bodies):
    df = spark.createDataFrame([(i, *m) for i, m in enumerate(mails)], "message_id int, body_text string, body_html string")
    got = {r["message_id"]: (r["source"], r["body"], r["score"]) for r in how(df).collect()}
    return [got[i] for i in range(len(mails))]


def test_the_newest_offer_of_a_thread(spark):
    thread = f"Hello\nFrom: bob\nspace is tight\n> {OFFER}\nRegards\nUSD 9\nFrom: ann\n{OLD}"
    lone = f"{OFFER}\n____\n{OLD}"
    asked = "Please quote\nPOL: X\nPOD: Y\n40HC validity\nFrom: bob\nthanks"
    got = chosen(spark, (thread, None), (lone, None), (asked, None))
    assert got[0][:2] == ("text", f"space is tight\n{WHOLE} USD 50 extra".replace("port USD 50 extra", "port USD 50 extra"))
    assert got[1][1].startswith(WHOLE) and "USD 100" not in got[1][1]
    assert got[2] == ("text", "Please quote\nPOL: X\nPOD: Y\n40HC validity", bodies.WITHOUT_AMOUNT)


def test_text_or_html(spark):
    page = "<html><style>x{}</style><p>Hi</p><div>" + OFFER.replace("\n", "<br/>") + "</div></html>"
    cells = "<table><tr><td>POL</td><th>Rate&nbsp;&euro;</th></tr><tr><td>A&amp;B</td><td>USD 5</td></tr></table>"
    got = chosen(spark, ("news", page), (OFFER, page), (STACK, page), (" ", cells), (None, None), ("", " \n "), ("plain words", None))
    assert [g[0] for g in got] == ["html", "text", "text", "html", None, None, "text"]
    assert got[2][1].split("\n")[:3] == ["POL", "POD", "Carrier"] and got[3][1] == "POL Rate €\nA&B USD 5" and got[4] == got[5] == (None, "", 0) and got[6][2] == 0


def test_current_message(spark):
    got = chosen(spark, (f"see attachment\nkind regards\nDe: x\n{OFFER}", None), (f"{OFFER}\n===\n{OLD}", None), ("From: a\nSent: b\nhello", None), how=bodies.current_bodies)
    assert got[0][:2] == ("text", "see attachment\nkind regards") and "USD 100" not in got[1][1] and got[2][1] == "From: a"


def test_sections_and_rules(spark):
    df = spark.createDataFrame([(1, "text", "a\n___\n===\nFrom: x\nSubject: y\nb"), (2, "text", "===\n___"), (3, "text", None)], "message_id int, source string, text string")
    got = bodies.sections(bodies.clean_lines(df)).orderBy("message_id", "section").collect()
    assert [(r["message_id"], r["lines"]) for r in got] == [(1, ["a"]), (1, ["From: x"]), (1, ["Subject: y", "b"]), (2, ["===", "___"])]


def test_scores(spark):
    texts = ["", "USD 5", "POL: A POD: B COMM: c", "rate USD 5", "USD 1 " * 30, "Pls consider rate USD 5 Pls consider rate", "published FAK", None, "flete: 300 vigencia 40'"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r["s"] for r in df.select("i", bodies.score(df.t).alias("s")).orderBy("i").collect()]
    # 8 an amount up to 12, 14 each for places, 20 a rate told, 120 an offer, 10 each for validity and equipment
    assert got == [0, 8, 35, 28, 96, 268, 35, 0, 28]


def test_fak_and_stacked_headers_begin_an_offer(spark):
    fak = "intro USD 5\nFAK\nx\nPOL: A\nPOD: B\nUSD 7"
    got = chosen(spark, (fak, None), ("intro USD 5 POL: A POD: B rate USD 3\n" + STACK, None))
    assert got[0][1].startswith("FAK\nx\nPOL: A") and got[1][1].startswith("POL\nPOD\nCarrier")


def test_long_bodies(spark):
    got = chosen(spark, (("word " * 10 + "\n") * 3000 + OFFER, None), ("x" * 300000, None))
    assert "Pls consider the rate USD 1200" in got[0][1] and len(got[1][1]) == 300000

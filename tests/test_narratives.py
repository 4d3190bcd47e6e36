"""Offers told in sentences."""

from lading.operators import narratives

ROUTES = "POL: Shanghai/Ningbo/Chongqing(+arb USD850)\nPOD: Caldera, Moin\nCOMM: FAK\nB)\nPOL: Xiamen; xiamen\nPOD: Moin\nCommodity: Toys\nSubject to PCS USD 297/cntr, EPR $28.5/container.\nRegards\nPOL: Old\nPOD: Old"


def rates(spark, *texts):
    rows = [(d, i, line) for d, t in enumerate(texts) for i, line in enumerate((t or "").split("\n"))]
    got = narratives.narrative_rates(spark.createDataFrame(rows, "doc_id int, pos int, text string")).orderBy("doc_id", "row_number").collect()
    out = [[] for _ in texts]
    for r in got:
        out[r["doc_id"]].append(r)
    return out


def test_carriers_paired_with_amounts(spark):
    (got,) = rates(spark, f"Dear all\nPls consider rate USD2,100/1,950 per 40'HC valid 15-21 Aug 2026, Carrier MSC/ONE NAC, with 21 days free (except Xiamen)\nA)\n{ROUTES}")
    assert [(r["carrier"], r["freight_amount"], r["pol"], r["poe"], r["commodity"], r["origin_charges"]) for r in got] == [
        ("MSC", "2100", "Shanghai/Ningbo/Chongqing", "Caldera/Moin", None, None),
        ("ONE", "1950", "Shanghai/Ningbo", "Caldera/Moin", "FAK", None),
        ("ONE", "1950", "Chongqing", "Caldera/Moin", "FAK", "850"),
        ("ONE", "1950", "Xiamen", "Moin", "Toys", None),
    ]
    r = got[0]
    assert (r["valid_from"], r["valid_to"], r["free_days"], r["container_size"], r["currency"], r["surcharges"]) == ("15 Aug 2026", "21 Aug 2026", "21", "40HC", "USD", "325.5")
    assert r["remarks"] == "Producto comercial: NAC. Arbitrarios por POL según fuente: Shanghai/Ningbo/Chongqing(+arb USD850) | Shanghai/Ningbo/Chongqing(+arb USD850) | Xiamen; xiamen. POL excluidos para la oferta general MSC: xiamen. Subject to PCS USD 297/cntr, EPR $28.5/container. Las restricciones COMM detalladas en el correo aplican expresamente a ONE NAC."
    assert "Arbitrario de origen: USD 850 por contenedor" in got[2]["remarks"] and "Mercancía autorizada para ONE NAC: Toys" in got[3]["remarks"]


def test_named_amounts_and_inherited_equipment(spark):
    (got,) = rates(spark, "please consider rate MSK USD 1,800.50 MSC NAC $1700 msc US$5 valid 28 Aug - 3 Sep with 14 day free\nPOL: A\nPOD: B\nRegards\nold rate per 20 GP")
    assert [(r["carrier"], r["freight_amount"], r["container_size"], r["valid_from"], r["valid_to"]) for r in got] == [("MAERSK", "1800.50", "20DV", "28 Aug", "3 Sep"), ("MSC", "1700", "20DV", "28 Aug", "3 Sep")]
    (one,) = rates(spark, "Pls consider rate USD 900 valid 1-5 Sep Carrier HPL and PIL with 7 days free\nPOL: A\nPOD: B")
    assert [(r["carrier"], r["freight_amount"], r["container_size"], r["surcharges"]) for r in one] == [("HAPAG-LLOYD", "900", "40HC", None), ("PIL", "900", "40HC", None)]


def test_what_is_no_offer(spark):
    routes = "\nPOL: A\nPOD: B"
    texts = [None, "hello" + routes, "Pls consider rate USD 9 Carrier MSC with 7 days free" + routes, "Pls consider rate USD 9 valid 1-5 Sep Carrier MSC" + routes, "Pls consider rate USD 9 valid soon Carrier MSC with 7 days free" + routes]
    texts += ["Pls consider rate USD 9 valid 1-5 Sep with 7 days free" + routes, "Pls consider rate USD 9 valid 1-5 Sep Carrier MSC with 7 days free\nPOL: A\nA)\nPOD: B", "Pls consider rate USD 9 valid 1-5 Sep Carrier MSC with 7 days free\nFrom: x" + routes]
    assert rates(spark, *texts) == [[]] * len(texts)

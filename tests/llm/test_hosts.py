"""Verdicts on hosts: chance alone condemns none, a host that stands out is found."""

import random

from lading.llm import quality_rules


def documents(rates, per_host=150, seed=1):
    r, rows = random.Random(seed), []
    for h, rate in enumerate(rates):
        for _ in range(per_host):
            body = " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(40))
            rows.append((len(rows), body + " ##%%&&" * 12 if r.random() < rate else body, f"h{h}"))
    return rows


def verdicts(spark, rows):
    got = quality_rules.host_rules(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2)).collect()
    assert not any(r["base_failed"] for r in got)
    return {h: sum(not r["kept"] for r in got if r["host"] == h) for h in {r["host"] for r in got}}, got


def test_hosts_that_do_not_differ_lose_nothing(spark):
    gone, _ = verdicts(spark, documents([0.2] * 12))
    assert sum(n > 0 for n in gone.values()) <= 1


def test_a_host_that_stands_out_loses_what_fails(spark):
    gone, got = verdicts(spark, documents([0.05] * 8 + [0.4]))
    assert gone["h8"] > 40 and sum(gone.values()) == gone["h8"]
    assert 0.25 < next(r["host_rate"] for r in got if r["host"] == "h8") < 0.5


def test_most_of_a_host(spark):
    gone, _ = verdicts(spark, documents([0.05] * 8 + [0.9]))
    assert gone["h8"] == 150


def test_one_host_bears_nothing_out(spark):
    gone, _ = verdicts(spark, documents([0.3]))
    assert gone == {"h0": 0}

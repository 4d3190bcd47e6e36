"""Personal data in texts with very long runs, and against clashing columns."""

import random
import re
import time

import pytest

from lading.llm import personal_data as m

IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


@pytest.mark.parametrize("run", ["a", "7", "deadbeef", "1.", "a.", "+1 ", "1-", "@", "a@", "[at]", "0:"])
def test_long_runs_are_read_once(run):
    small, large = run * (100_000 // len(run)), run * (1_000_000 // len(run))
    m.find(small)
    began = time.time()
    m.find(small + " x [at] y")
    short = time.time() - began
    began = time.time()
    m.find(large + " x [at] y")
    assert time.time() - began < 30 * short + 2


def test_addresses_of_ten_thousand_random_texts():
    r = random.Random(1)
    for _ in range(10_000):
        text = "".join(r.choice(["1", "25", "256", "0", ".", ".", ".", " ", "a", "00", "1.2.3.4"]) for _ in range(r.randrange(24)))
        want = [(x.start(), x.end()) for x in IP.finditer(text) if all(int(p) <= 255 for p in x.group().split("."))]
        assert [(s, e) for s, k, e in m.base_spans(text) if k == 1] == want, text


def test_written_out_addresses():
    spans = lambda t: [t[s:e] for s, k, e, _ in m.find(t)[1] if k == 0]
    assert spans("mail john.doe [at] example [dot] com now") == ["john.doe [at] example [dot] com"]
    assert spans("X (AT) y.org and {z}a{at}b.de") == ["X (AT) y.org", "a{at}b.de"]


def test_columns_of_any_name(spark):
    schema = "doc_id long, text string, _s string, s string, kind string, votes string, base string, n_ip long"
    got = m.detect(spark.createDataFrame([(1, "mail a@b.com", "x", "y", "z", "v", "old", 9), (2, None, None, None, None, None, None, None)], schema)).orderBy("doc_id").collect()
    assert (got[0]["_s"], got[0]["s"], got[0]["base"], got[0]["n_ip"], got[0]["n_email"]) == ("x", "y", "email:5:12", 0, 1) and got[1]["spans"] == ""

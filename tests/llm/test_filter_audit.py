"""The audit of filters against all orders applied one document after another."""

import itertools
import random
import re

from lading.llm import filter_audit as m

DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute(docs, labels):
    out, fails = {}, []
    for doc, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        own = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": any(d is not None and doc is not None and d < doc and (t or "") == text for d, t, _ in docs),
        }
        marks = [(q, x) for d, q, x in labels if d is not None and d == doc]
        fails.append((lang or "", {k for k, v in own.items() if v}, any(q == 1 for q, _ in marks), any(x == 1 for _, x in marks)))
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            for step, letter in enumerate(order):
                open_ = [f for f in mine if not f[1] & set(order[:step])]
                gone = [f for f in open_ if letter in f[1]]
                shapley[letter] += len(gone)
                out[part, "".join(order), step + 1] = [len(open_) - len(gone), len(gone), sum(letter in f[1] for f in mine) - len(gone), sum(f[1] == {letter} for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone), letter]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = shapley[row[-1]]
    return {k: tuple(v) for k, v in out.items()}


def audit(spark, docs, labels, schema=DOCS):
    got = m.filter_audit(spark.createDataFrame(docs, schema).repartition(3), spark.createDataFrame(labels, LABELS)).collect()
    assert len({(r["part"], r["filter_order"], r["step"]) for r in got}) == len(got)
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in MEASURES) for r in got}


def made(seed, n):
    r = random.Random(seed)
    docs = []
    for i in range(n):
        words = [f"w{r.randrange(r.choice([20, 400]))}" for _ in range(r.choice([3, 199, 200, 260]))]
        text = r.choice([" ", "\n", "\t  "]).join(words)
        text += r.choice(["", "", " #", " A" * 40, " É" * 50])
        docs.append((i, r.choice(docs)[1] if docs and r.random() < 0.4 else text, r.choice(["en", "de", "", None])))
    return docs, [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, n, 2)]


def test_all_orders(spark):
    docs, labels = made(1, 150)
    want = brute(docs, labels)
    assert audit(spark, docs, labels) == want and len(want) == 3 * 600
    assert all(any(v[k] for v in want.values()) for k in range(7))


def test_awkward_rows(spark):
    docs, labels = made(2, 40)
    docs += [(None, None, None), (None, "same text", "en"), (None, "same text", "en"), (41, None, "en"), (42, "", "en"), (43, " \n ", None)]
    docs += [(50, "two texts", "en"), (50, "of one id", "de"), (50, "two texts", "en"), (50, "two texts", "fr"), (51, "two texts", "en")]  # repeated rows
    docs += [(60, "word " * 30000, "en"), (61, "x" * 200000, "en"), (62, "Ab" * 3, "en")]
    labels += [(None, 1, 1), (50, 0, None), (50, 1, 1), (60, None, None)]
    assert audit(spark, docs, labels) == brute(docs, labels)


def test_empty_tables_and_clashing_names(spark):
    assert audit(spark, [], []) == {}
    docs, labels = made(3, 30)
    extra = ("doc", "part", "print", "whole", "word", "n", "rows", "failed", "quality", "toxic")
    schema = DOCS + "".join(f", {c} string" for c in extra)
    assert audit(spark, [(*d, *["?"] * len(extra)) for d in docs], labels, schema) == brute(docs, labels)
    assert audit(spark, docs, []) == brute(docs, [])

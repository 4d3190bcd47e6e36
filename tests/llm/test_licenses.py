"""Licence places against a scan of every position."""

import random
import re
from collections import Counter

from lading.llm import licenses as m

DOCS = "doc_id long, text string"
NAMES = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def brute(texts, templates=m.TEMPLATES, drift=8, n_rare=6, least_share=0.6):
    """Tries every place of every template; words are ranked by the documents that hold them."""
    bags = [words(t) for t in texts]
    df = Counter(w for b in bags for w in set(b))
    out = []
    for bag in bags:
        places, labels, score = [], set(), 0.0
        for p in m.PHRASES:
            own = words(p.text)
            here = [i for i in range(len(bag)) if bag[i : i + len(own)] == own]
            places += here
            labels |= {p.label} if here else set()
        base = set(labels)
        for t in templates:
            own = words(t.text)
            rare = sorted(set(own), key=lambda w: (df[w], w))[:n_rare]
            for start in range(-len(own), len(bag)):
                near = {w for p, w in enumerate(own) if w in rare for i in range(max(0, start + p), min(len(bag), start + p + drift + 1)) if bag[i] == w}
                first = any(0 <= start + p < len(bag) and bag[start + p] == w for p, w in enumerate(own) if w in rare)
                window = bag[max(0, start) : max(0, start + len(own) + drift)]
                share = (Counter(window) & Counter(own)).total() / len(own)
                if first and len(near) >= (len(rare) + 1) // 2 and share >= least_share and all(any(window[i : i + len(q)] == q for i in range(len(window))) for q in map(words, t.phrases)):
                    labels.add(t.label)
                    score = max(score, share)
        out.append((len(bag), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if base else score))
    return out


def scanned(spark, texts, schema=DOCS, more=()):
    df = spark.createDataFrame([(i, t, *more) for i, t in enumerate(texts)], schema).repartition(2)
    got = {r["doc_id"]: r["license"] for r in m.scan(df).collect()}
    return [tuple(got[i][c] for c in NAMES) for i in range(len(texts))]


def edited(text, r):
    own = text.split()
    for _ in range(r.randrange(4)):
        k = r.randrange(len(own))
        own[k : k + 1] = r.choice([[], [own[k], "by", "Acme"], ["other"]])
    return " ".join(own)


def test_every_place(spark):
    r = random.Random(1)
    filler = lambda n: " ".join(r.choice("this software is the license of a program under terms use version free mit apache public general work".split()) for _ in range(n))
    texts = [f"{filler(r.randrange(12))} {edited(r.choice(m.TEMPLATES).text, r)} {filler(r.randrange(30))}" for _ in range(60)]
    texts += [filler(40) for _ in range(20)]
    want = brute(texts)
    assert scanned(spark, texts) == want
    assert len({w[5] for w in want}) > 10 and sum(w[1] > 0 for w in want) > 5


def test_base_phrases(spark):
    texts = ["MIT-License! the mit  license", "mit.\nLICENSE Apache\tLicense; gnu general public license", "mit license", "permit license", "mitlicense", "the MİT license", "General Public Licenses"]
    got = scanned(spark, texts)
    assert [g[1] for g in got] == [2, 3, 0, 0, 0, 0, 0] and got[0][2:5] == (0, 3, "mit") and got[1][4] == "apache,gpl,mit" and got == brute(texts)


def test_labels_of_its_own(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    texts = [f"Copyright 2020 A. Uthor {bsd} 1. Redistributions", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0.", "software in source form of the public", m.TEMPLATES[0].text.replace("documentation", "docs")]
    got = scanned(spark, texts)
    assert [g[5] for g in got] == ["bsd", "cc-by-nc", "cc-by", "", "mit"] and [g[4] for g in got] == [""] * 5
    assert got[0][6] == 1.0 and got[3][6] == 0.0 and 0.9 < got[4][6] < 1 and got == brute(texts)


def test_awkward_rows(spark):
    texts = [None, "", " \n", "license " * 5000, "mit license " * 3000, "x" * 300000, "mit license", "mit license", "\u0000mit license\u0000"]
    got = scanned(spark, texts)
    assert got[0] == got[1] == got[2] == (0, 0, None, None, "", "", 0.0)
    assert got[4][:4] == (6000, 3000, 0, 5998) and got[3][1] == 0 and got[5][0] == 1 and got[6] == got[7] == got[8]
    assert m.scan(spark.createDataFrame([], DOCS)).count() == 0
    schema = DOCS + ", license string, words string, word string, n string"
    assert scanned(spark, ["a mit license"], schema, ("?",) * 4)[0][2] == 1

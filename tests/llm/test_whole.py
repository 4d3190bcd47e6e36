"""What large buckets, full shards and awkward texts must not lose."""

import collections
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lading.llm import lines, minhash, pages, personal_data, quality_rules, sharding


def alike(texts, similarity=0.8, width=5):
    """Sets of connected texts by all pairs of weighted Jaccard similarities."""
    bags = [collections.Counter(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) for w in (t.split() for t in texts)]
    df, n = collections.Counter(k for b in bags for k in b), len(texts)
    weights = [{k: c * (1 + math.log(n / df[k]) / math.log(n + 1)) for k, c in b.items()} for b in bags]
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            both = sum(min(weights[i][k], weights[j][k]) for k in weights[i].keys() & weights[j].keys())
            if both >= similarity * (sum(weights[i].values()) + sum(weights[j].values()) - both):
                root = [root[j] if x == root[i] else x for x in root]
    groups = collections.defaultdict(set)
    for i, r in enumerate(root):
        groups[r].add(i)
    return set(map(frozenset, groups.values()))


def classes(spark, texts):
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    groups = collections.defaultdict(set)
    for r in got:
        groups[r["class_id"]].add(r["doc_id"])
    return set(map(frozenset, groups.values()))


@pytest.fixture
def one_bucket(monkeypatch):
    """All texts agree in all bands, so every bucket holds all of them."""
    monkeypatch.setattr(minhash, "samples", lambda h, starts, weight, count: np.zeros((count, len(starts)), np.uint32))


def test_chains_in_a_large_bucket(spark, one_bucket):
    # windows that slide over a text: each is like the next, and unlike those further on
    texts = [" ".join(f"c{chain}w{i}" for i in range(12 * k, 12 * k + 150)) for chain in range(6) for k in range(8)]
    want = alike(texts)
    assert sorted(map(len, want)) == [8] * 6 and classes(spark, texts) == want



def test_pairs_in_a_bucket_of_texts_that_share_a_passage(spark, one_bucket):
    passage, texts = [f"p{i}" for i in range(60)], []
    for pair in range(40):
        own = [f"d{pair}w{i}" for i in range(90)]
        edited = list(own)
        edited[random.Random(pair).randrange(10, 80)] = "edited"
        texts += [" ".join(own + passage), " ".join(edited + passage)]
    want = alike(texts)
    assert sorted(map(len, want)) == [2] * 40 and classes(spark, texts) == want


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def left(spark, texts):
    """The lines that stay, each in a document of its own."""
    got = lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r["doc_id"] for r in got if not r["n_removed"]}


@pytest.mark.parametrize("n", [5, 8, 12, 20, 30])
def test_lines_with_a_changed_word_or_letter(spark, n):
    r = random.Random(n)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 9)))
    texts = []
    for i in range(200):
        own = [word() for _ in range(n)]
        at, edited = r.randrange(n), list(own)
        edited[at] = edited[at][:-1] + "z" if i % 2 else word()
        texts += [" ".join(own), " ".join(edited)]
    want = [i for i in range(200) if edits(*texts[2 * i : 2 * i + 2]) <= 0.2 * max(map(len, texts[2 * i : 2 * i + 2]))]
    stay = left(spark, texts)
    found = sum(2 * i + 1 not in stay for i in want)
    assert found >= 0.97 * len(want) > 150 and all(2 * i in stay for i in range(200)), (n, found, len(want))


def test_common_ends_leave_edit_distances_alone(spark):
    r = random.Random(3)
    pairs = [("", ""), ("a", ""), ("a", "a"), ("ab", "ba"), ("aaa", "aaaa"), ("é1é", "éé"), ("x" * 40000 + "y", "x" * 40000 + "z")]
    for _ in range(2000):
        a = [r.choice("aabé😀c ") for _ in range(r.randint(0, 30))]
        b = list(a)
        for _ in range(r.randint(0, 4) if b else 0):
            b[r.randrange(len(b))] = r.choice(["", "q", "aa"])
        pairs.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(pairs, "ta string, tb string").withColumn("whole", F.levenshtein("ta", "tb"))
    left = lines._differing(df).withColumn("rest", F.levenshtein("ta", "tb"))
    assert left.filter("whole <> rest").count() == 0 and left.filter("whole > 0").count() > 1000
    assert left.agg(F.max(F.length("ta"))).first()[0] < 40


def test_lines_of_large_buckets(spark, monkeypatch):
    # all lines in one bucket, most of their words equal; each letter stands for a group
    monkeypatch.setattr(lines, "_samples", lambda worded: worded.select("h1", "len", F.lit(1).cast("long").alias("key")))
    r = random.Random(4)
    texts = ["| " * 8 + "".join(chain[max(0, k - 3) :][:40]) for chain in ([r.choice("abcdefghij") for _ in range(70)] for _ in range(8)) for k in range(0, 24, 3)]
    r.shuffle(texts)
    root = list(range(len(texts)))
    norm = [" ".join(t.split()) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if edits(norm[i], norm[j]) <= 0.2 * max(len(norm[i]), len(norm[j])):
                root = [root[j] if x == root[i] else x for x in root]
    want = {root.index(x) for x in set(root)}
    assert 4 <= len(want) < len(texts) / 2 and left(spark, texts) == want


def sharded(spark, texts):
    got = sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(got) == len(texts)
    where, sizes = collections.defaultdict(set), collections.Counter()
    for r in got:
        where[texts[r["doc_id"]]].add(r["shard"])
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) <= 1.02 * sum(sizes.values()) / 16
    return where


def test_a_third_of_the_rows_in_few_shards(spark):
    texts = ["h" * 40] * 800 + [f"pair {i // 2:035d}" for i in range(400)] + [f"alone {i:034d}" for i in range(1200)]
    where = sharded(spark, texts)
    assert len(where["h" * 40]) == 6 and all(len(s) == 1 for t, s in where.items() if t[0] != "h")


def test_groups_stay_whole_where_almost_all_rows_are_linked(spark):
    texts = [f"copy {i // (2 + i % 2):035d}" for i in range(3920)] + [f"alone {i:034d}" for i in range(80)]
    assert all(len(s) == 1 for s in sharded(spark, texts).values())


@pytest.mark.parametrize("text", ["JOHN [AT] EXAMPLE [DOT] COM", "John (At) Example (Dot) Com", "john {aT} example.com"])
def test_written_out_addresses_in_any_case(text):
    assert [text[s:e] for s, _, e, _ in personal_data.find(text)[1]] == [text]


def test_repeated_lines_are_a_share_of_lines(spark):
    r = random.Random(1)
    page = lambda: "\n".join(" ".join(f"w{r.randrange(10**6)}" for _ in range(10)) + "\nread more about us" for _ in range(20))
    docs = [(i, page(), "boilerplate") for i in range(30)] + [(100 + i, page().replace("read more about us\n", ""), "fine") for i in range(30)]
    got = {r["doc_id"]: r for r in quality_rules.host_rules(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert (got[0]["n_lines"], got[0]["n_dup_lines"], got[0]["base_failed"]) == (40, 19, False)
    assert not any(got[i]["kept"] for i in range(30)) and all(got[100 + i]["kept"] for i in range(30))


@pytest.mark.parametrize("piece", ["<script", "a<b", '<a "', "<b>", "</div>", '<a ">" ', "<!-", "<p><b>", "<li><i>"])
def test_odd_markup_takes_linear_time(piece):
    def took(size):
        page = piece * (size // len(piece))
        began = time.process_time()
        pages.main_text(page)
        return time.process_time() - began

    took(10_000)
    assert took(400_000) < 60 * max(took(40_000), 0.005)


def test_deep_unmatched_ends_take_linear_time():
    began = time.process_time()
    pages.main_text("<b>" * 50_000 + "</i>" * 50_000)
    assert time.process_time() - began < 5


def test_documents_that_fail_a_soft_rule_go_with_bad_hosts_only(spark):
    r = random.Random(7)
    fine = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(60))
    marked = lambda: " ".join(f"w{r.randrange(10**3)}##" for _ in range(60))
    docs = [(i, fine(), "good") for i in range(200)] + [(200, marked(), "good")] + [(300 + i, fine(), "bad") for i in range(60)] + [(400 + i, marked(), "bad") for i in range(40)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.host_rules(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert kept[200] and all(kept[i] for i in range(200)) and all(kept[300 + i] for i in range(60)) and not any(kept[400 + i] for i in range(40))

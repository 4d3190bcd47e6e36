"""The training-data operators on small tables with awkward rows, against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from lading.llm import decontaminate, katz, lines, minhash, mixing, pages, personal_data, quality_classifier, quality_rules, sharding
from lading.llm.chunks import ALNUM

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, n_words long, score string, gid string, place string, shard string"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{int(vocabulary * r.random() ** 2)}" + r.choice(["", "", "", ",", ".\n"]) for _ in range(n))


def texts():
    """Nulls, empty texts, ties, repeated rows, copies, near copies, a very long text and a hot source."""
    out = [(None, None), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Ümläut ONE two"), (6, "one two three four five six seven")]
    out += [(10 + i, prose(i, 60 + 7 * i)) for i in range(20)]
    out += [(40, prose(0, 60)), (41, prose(0, 60)), (41, prose(0, 60)), (42, prose(7, 109).replace("w3 ", "zzz ")), (43, prose(5, 95) + " tail words here")]
    out += [(50, prose(99, 30_000, 5000)), (51, "same line again\n" * 300), (52, "mail a.b@mail.example.com or 10.0.0.1 card 4111 1111 1111 1111 tel +1 (212) 555-0187 token = \"abcdef0123456789\"")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "en", ["hot", "hot", "b", None][i % 4], None, 1, 2, "x", "g", "p", "s") for i, (d, t) in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def multiset(rows):
    return collections.Counter(map(repr, rows))


def test_near_duplicates_match_brute_force(docs, none):
    assert minhash.near_duplicates(none).count() == 0
    got = rows_of(minhash.near_duplicates(docs))
    assert len(got) == docs.count()
    weights, n = [], len(texts())
    bags = []
    for _, t in texts():
        w = (t or "").encode().translate(ALNUM).split()
        bags.append(collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter())
    df = collections.Counter(k for b in bags for k in b)
    weights = [{k: c * (1 + math.log(n / df[k]) / math.log(n + 1)) for k, c in b.items()} for b in bags]
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            both = sum(min(weights[i][k], weights[j][k]) for k in weights[i].keys() & weights[j].keys())
            all_ = sum(weights[i].values()) + sum(weights[j].values()) - both
            if not all_ or both / all_ >= 0.8:
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    ids = [d for d, _ in texts()]
    classes = collections.defaultdict(list)
    for i, r in enumerate(root):
        classes[r].append(ids[i])
    want = multiset((d, min(c, key=lambda x: (x is not None, x)), len(c)) for c in classes.values() for d in c)
    assert multiset((r["doc_id"], r["class_id"], r["class_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(classes)
    assert any(len(c) > 2 for c in classes.values())


def test_many_near_copies_and_a_shared_passage(spark):
    base, passage = prose(1, 200), prose(2, 60)
    rows = [(i, base.replace(f"w{i % 40} ", f"x{i} ", 1)) for i in range(60)] + [(100 + i, prose(1000 + i, 100) + " " + passage) for i in range(300)]
    got = {r["doc_id"]: r["class_size"] for r in rows_of(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert all(got[i] >= 55 for i in range(60)) and all(got[100 + i] == 1 for i in range(300))


def test_one_of_each_keeps_columns_and_one_row(docs, none):
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns and minhash.one_of_each(none).count() == 0
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.count() == minhash.near_duplicates(docs).filter("kept").count() and ids.count(41) == 0


def test_katz_matches_brute_force(docs, none):
    assert katz.score_documents(none).count() == 0
    got = multiset((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5), round(r["score"], 5)) for r in rows_of(katz.score_documents(docs, per_part=500)))
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    toks = [(d, (t or "").encode().lower().split() + [b"\n"]) for d, t in texts()]
    one, two = collections.Counter(), collections.Counter()
    for d, w in toks:
        if not held(d):
            one.update(w)
            two.update(zip([b"\n", *w], w, strict=False))
    n, v = sum(one.values()), len(one)
    of = lambda c: [float(sum(1 for x in c.values() if x == r)) for r in range(1, katz.K + 2)]
    d1, d2 = katz.discounts(of(one)), katz.discounts(of(two))
    cut = lambda d, c: d[c] if c <= katz.K else 1.0
    left = sum((1 - cut(d1, c)) * c for c in one.values()) / n
    p = lambda w: one[w] * cut(d1, one[w]) / n if w in one else left
    after = collections.defaultdict(dict)
    for (h, w), c in two.items():
        after[h][w] = c
    state = {}
    for h, s in after.items():
        total = sum(s.values())
        free = sum((1 - cut(d2, c)) * c for c in s.values()) / total
        scale = total if free > 0 else total + 1
        free = free if free > 0 else 1 / (total + 1)
        state[h] = (scale, free / (1 - sum(p(w) for w in s)))
        everything = sum(c * cut(d2, c) / scale for c in s.values()) + state[h][1] * (1 - sum(p(w) for w in s))
        assert abs(everything - 1) < 1e-9
    want = []
    for d, w in toks:
        score = base = 0.0
        for h, x in zip([b"\n", *w], w, strict=False):
            base += math.log10((one[x] + 1) / (n + v + 1))
            c = two.get((h, x), 0)
            score += math.log10(c * cut(d2, c) / state[h][0] if c else (state[h][1] if h in state else 1.0) * p(x))
        want.append((d, held(d), len(w), sum(x in one for x in w), n, round(base, 5), round(score, 5)))
    assert got == multiset(want)


def test_line_dedup(spark, docs, none):
    assert lines.dedup_lines(none).count() == 0
    long = " ".join(f"word{i}" for i in range(300))
    rows = [(d, t, "x") for d, t in [(1, f"alpha beta\n{long}\n\nalpha  BETA"), (2, "alpha beta\nother"), (3, long.replace("word30", "ward30")), (4, None), (5, ""), (2, "alpha beta\nother")]]
    got = multiset((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in rows_of(lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_removed string"))))
    want = [(1, f"alpha beta\n{long}\n", 4, 1), (2, "other", 2, 1), (2, "", 2, 2), (3, "", 1, 1), (4, None, 0, 0), (5, "", 1, 0)]
    assert got == multiset(want)
    out = {r["doc_id"]: r for r in rows_of(lines.dedup_lines(docs))}
    assert out[51]["n_removed"] == 299 and len(out) == len({d for d, _ in texts()})


def test_decontamination_matches_brute_force(spark, docs, none):
    long = texts()[20][1].split()
    items = [(1, " ".join(long[5:40])), (2, "one TWO"), (3, None), (4, "..."), (5, prose(9, 123)), (5, prose(9, 123)), (6, "never seen words " * 5), (7, "same line again same line again same")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = low(t)
        for k in range(max(0, len(w) - 9) or (1 if w else 0)):
            windows[tuple(w[k : k + 10])].add(str(i))
    want = []
    for d, t in texts():
        w, hit, found = low(t), set(), set()
        for win, ids in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found |= ids
        want.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    got = multiset((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows_of(decontaminate.contamination(docs, bench)))
    assert got == multiset(want) and sum(x[5] for x in want) >= 3
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    kept = decontaminate.clean_documents(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not x[5] for x in want)


def test_mixing(spark, docs, none):
    assert mixing.mix(none).count() == 0
    got = rows_of(mixing.mix(docs))
    assert len(got) == docs.count() and multiset(got) == multiset(rows_of(mixing.mix(docs)))
    assert sorted(r["size"] for r in got) == sorted(len([x for x in SPACE.split(t or "") if x]) for _, t in texts())
    by = collections.defaultdict(lambda: [0, 0, 0])
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        key = (r["source_size"], r["target"])
        by[key][0] += r["size"]
        by[key][1] += r["taken"]
    for (size, target), (found, taken, _) in by.items():
        assert found == size and target <= 3 * size + 1e-6 and abs(taken - target) <= max(0.02 * size, 2)
    assert sum(t for _, t in by) == pytest.approx(sum(s for s, _ in by))
    plan = {r["source"]: r["target"] for r in rows_of(mixing.targets(spark.createDataFrame([("a", 10), ("b", 1000), ("c", 100), (None, 0)], "source string, source_size long")))}
    # a may take 30, and then c 300 of what is left; b has the rest
    assert plan == {"a": pytest.approx(30), "b": pytest.approx(780), "c": pytest.approx(300), None: 0}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0


def test_page_text():
    page = """<html><head><title>t</title><style>x{}</style></head><body><nav><ul><li><a href=/>Home</a></ul></nav><div class="ad">Buy</div>
    <div class="comments"><p>A reader, says a lot, of things, here, and there.</p></div>
    <article><h1>Head &amp; more</h1><p><b>First, long   paragraph of text,<br>with a break.<p>Second one &#233;.</p><form>f</form><aside>side</aside></article><footer>foot</footer>"""
    assert pages.main_text(page) == "Head & more\n\nFirst, long paragraph of text, with a break.\n\nSecond one é."
    plain = "<body><div id=menu><a>x</a></div><div><div class=content><p>One, two, three, four, five.</p><p>Six, seven.</p></div><div class=sidebar><p>No, no.</p></div></div>"
    assert pages.main_text(plain) == "One, two, three, four, five.\n\nSix, seven."
    assert pages.main_text(None) == pages.main_text("") == pages.main_text("<nav>only</nav>") == ""
    assert pages.main_text("<p>" * 3000 + "deep, text" + "</p>" * 3000) == "deep, text"


def test_page_rows(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>a, b</p></article>", "x"), (1, "u", "<article><p>a, b</p></article>", "x"), (2, None, None, None)], "page_id long, url string, html string, text string")
    assert multiset(rows_of(pages.extract(df))) == multiset([{"page_id": 1, "url": "u", "text": "a, b", "n_chars": 4}] * 2 + [{"page_id": 2, "url": None, "text": "", "n_chars": 0}])
    assert pages.extract(df.limit(0)).count() == 0


def test_quality_classifier(spark, docs, none):
    good = [(i, prose(i, 80), 1) for i in range(120)]
    bad = [(1000 + i, "BUY NOW!! " * (5 + i % 30) + "$$$ ### " * 10, 0) for i in range(60)]
    table = spark.createDataFrame([(d, t, "x", None) for d, t, _ in good + bad], "doc_id long, text string, score string, predicted string")
    labels = spark.createDataFrame([(d, q) for d, _, q in good + bad] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in rows_of(quality_classifier.classify(table, labels))}
    held = [(got[d], q) for d, _, q in good + bad if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(r["held_out"] for r, _ in held) and sum(r["predicted"] == q for r, q in held) >= 0.95 * len(held) > 20
    assert quality_classifier.classify(none, labels).count() == 0
    alone = rows_of(quality_classifier.classify(docs, labels.limit(0)))
    assert len(alone) == docs.count() and {r["score"] for r in alone} == {0.5}
    assert all(0 <= r["score"] <= 1 for r in rows_of(quality_classifier.classify(docs, labels)))
    kept = quality_classifier.good_documents(table, labels)
    assert kept.columns == table.columns and {r["doc_id"] for r in kept.collect()} == {d for d, r in got.items() if r["predicted"]}


def test_quality_rules(spark, docs, none):
    assert quality_rules.host_rules(none).count() == 0
    want = []
    for d, t in texts():
        t = t or ""
        w = [x for x in SPACE.split(t) if x]
        seen, dup = set(), 0
        for line in t.split("\n"):
            if SPACE.sub("", line):
                dup += line in seen
                seen.add(line)
        counts = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        over = {p for i in range(len(w) - 7) if counts[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
        want.append((d, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(over), len(w) < 20 or 100 * len(over) > 30 * len(w)))
    got = rows_of(quality_rules.host_rules(docs))
    assert multiset((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == multiset(want)
    hosts = [(i, prose(i, 60), "fine") for i in range(40)] + [(100 + i, "short", "junk") for i in range(39)] + [(139, prose(3, 70), "junk"), (140, prose(4, 70), "tiny"), (141, "no", "tiny")]
    kept = {r["doc_id"]: r["kept"] for r in rows_of(quality_rules.host_rules(spark.createDataFrame(hosts, "doc_id long, text string, source string")))}
    assert all(kept[i] for i in range(40)) and not kept[139] and not kept[100] and kept[140]


def test_personal_data(spark, docs, none):
    assert personal_data.detect(none).count() == 0
    rows = {r["doc_id"]: r for r in rows_of(personal_data.detect(docs)) if r["doc_id"] is not None}
    assert rows[1]["base"] == "" and len(rows) == len({d for d, _ in texts() if d is not None})
    text = dict(texts())[52]
    assert [text[int(s.split(":")[1]) : int(s.split(":")[2])] for s in rows[52]["base"].split(",")] == ["a.b@mail.example.com", "10.0.0.1", "4111 1111 1111 1111", "+1 (212) 555-0187"]
    assert (rows[52]["n_email"], rows[52]["n_ip"], rows[52]["n_card"], rows[52]["n_phone"]) == (1, 1, 1, 1)
    assert set(rows[52]["base"].split(",")) <= set(rows[52]["spans"].split(","))
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    r = random.Random(3)
    for _ in range(3000):
        t = "".join(r.choice("a@.-_ b1é") for _ in range(r.randrange(25)))
        assert [(s, e) for s, k, e in personal_data.base_spans(t) if k == 0] == [m.span() for m in email.finditer(t)], t


def test_sharding(spark, docs, none):
    assert sharding.shard(none).count() == 0
    copies = [(i, "hot copy " * 20) for i in range(400)] + [(1000 + i, prose(i, 40)) for i in range(500)] + [(2000 + i, prose(i, 40)) for i in range(30)]
    for table, n in ((docs, docs.count()), (spark.createDataFrame(copies, "doc_id long, text string"), len(copies))):
        got = rows_of(sharding.shard(table))
        assert len(got) == n and {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
        slots = collections.defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    sizes = collections.Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values())
    where = {r["doc_id"]: r["shard"] for r in got}
    assert sum(where[1000 + i] == where[2000 + i] for i in range(30)) >= 27
    same = {r["doc_id"]: r for r in got}
    assert same[1000]["text_crc32"] == zlib.crc32(prose(0, 40).encode()) and same[1000]["size"] == len(prose(0, 40).encode()) + 1

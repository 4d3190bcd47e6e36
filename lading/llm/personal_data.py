"""Operator 9: personal data by weak supervision: labelers vote, EM weighs them, and a span classifier is trained on that."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lading.llm.common import fresh, ship, staged

#: Kinds in the order of ties; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "secret")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# what begins a run of digits or letters is looked for at its start only, so that long runs are read once
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WIDE = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+\s?(?:\[at\]|\(at\)|\{at\})\s?[A-Za-z0-9-]+(?:\s?(?:\.|\[dot\]|\(dot\)|\{dot\})\s?[A-Za-z0-9-]+)+", re.I), ("at]", "at)", "at}")),
    ("ip", re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"), (":",)),
    ("phone", re.compile(r"(?<![0-9A-Za-z+])(?:\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z+])00[1-9](?:[ .()-]?[0-9]){8,12}(?![0-9A-Za-z])"), None),
    ("card", re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9A-Za-z])|(?<![0-9A-Za-z.])[0-9]{13,19}(?![0-9A-Za-z])"), None),
    ("secret", re.compile(r"(?<![0-9A-Za-z])(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|(?<![0-9A-Za-z])(?:token|password|passwd|pwd|secret|api[_-]?key)\s?[=:]\s?\"?[^\s\"]{6,}\"?", re.I), ("akia", "asia", "=", ":")),
)
# Gazetteers of domain endings, card prefixes and cue words.
ENDINGS = frozenset("com org net edu gov io info biz co de fr es it uk us ca nl pt pl ch at be eu ru jp cn br mx cr".split())
CARD_PREFIX = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|35")
SECRET_NAMES = re.compile(r"AKIA|ASIA|token|password|passwd|pwd|secret|api[_-]?key", re.I)
CUES = {
    "email": frozenset("mail email e-mail contact write correo courriel kontakt".split()),
    "ip": frozenset("ip address host server adresse direccion login".split()),
    "card": frozenset("card visa mastercard amex credit debit karte carte tarjeta payment iban".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax telefon telefono appelez llame".split()),
    "secret": frozenset("key credentials login export aws auth".split()),
}
AGAINST = frozenset("version v isbn issn page section chapter figure table invoice order item no nr model part serial id".split())
LABELERS = ("form", "check", "gazetteer", "context", "edges")
#: Votes and the length class of a span: what the final classifier sees besides the kind.
N_PATTERN = 3 ** len(LABELERS)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base, leftmost and non-overlapping within each kind."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def votes(kind: int, span: str, before: str, after: str, base: bool) -> int:
    """The labelers' votes (0 against, 1 none, 2 for) as one number in base 3."""
    name = KINDS[kind]
    digits = "".join(c for c in span if "0" <= c <= "9")
    words = before.lower().replace(":", " ").replace("=", " ").split()[-4:]
    form = 2 if base or name == "secret" else 1
    if name == "card":
        check = 2 if luhn(digits) and len(set(digits)) > 1 else 0
        listed = 2 if CARD_PREFIX.match(digits) else 0
    elif name == "ip":
        check = 2 if ":" in span or not any(len(p) > 1 and p[0] == "0" for p in span.split(".")) else 0
        listed = 1 if ":" in span else 0 if span.startswith(("0.", "1.0.", "2.0.")) else 2
    elif name == "phone":
        check = 2 if 10 <= len(digits) <= 15 and len(set(digits)) > 2 else 0
        listed = 1
    elif name == "email":
        check = 2 if ".." not in span and len(span) < 255 else 0
        listed = 2 if span.lower().rstrip(")]}").replace("dot", ".").rpartition(".")[2].strip("]() ") in ENDINGS else 0
    else:
        value = span.rpartition("=")[2] if "=" in span else span.rpartition(":")[2]
        value = value.strip(' "')
        check = 2 if any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and len(set(value)) >= 6 else 0
        listed = 2 if SECRET_NAMES.match(span) else 0
    context = 2 if CUES[name].intersection(w.strip(".,;()[]") for w in words) else 0 if words and words[-1].strip(".,;()[]") in AGAINST else 1
    edges = 0 if (before[-1:].isalnum() or after[:1].isalnum()) else 2
    pattern = 0
    for v in (form, check, listed, context, edges):
        pattern = pattern * 3 + v
    return pattern


def find(text: str | None) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int, int]]]:
    """``(start, kind, end, votes)`` of the base spans, and of further candidates that do not overlap them."""
    text = text or ""
    base = base_spans(text)
    around = lambda s, k, e, b: votes(k, text[s:e], text[max(0, s - 48) : s], text[e : e + 1], b)
    found = [(s, k, e, around(s, k, e, True)) for s, k, e in base]
    more, low = [], text.lower()
    for name, pattern, needs in WIDE:
        if needs is None or any(x in low for x in needs):  # in lower case, as the patterns take any case
            k = KINDS.index(name)
            more += [(m.start(), k, m.end()) for m in pattern.finditer(text)]
    taken = [(s, e) for s, _, e in base]
    spare, i, last = [], 0, -1
    for s, k, e in sorted(more):
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        # base spans of different kinds may overlap, so those that begin earlier are looked at as well
        if s >= last and not any(a < e and s < b for a, b in taken[max(0, i - 4) : i + 8]):
            spare.append((s, k, e, around(s, k, e, False)))
            last = e
    return found, spare


def reliabilities(counts: dict[tuple[int, int], float], rounds: int = 50) -> tuple[np.ndarray, dict[tuple[int, int], float]]:
    """EM over (kind, votes) -> count: each labeler's chances of its three votes under both truths, and the posterior of
    every pattern. Truth starts at the majority of votes; a prior of one span per cell keeps chances off 0 and 1."""
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys])
    v = np.array([[(p // 3**i) % 3 for i in reversed(range(len(LABELERS)))] for _, p in keys])
    kind = np.array([k for k, _ in keys])
    post = 1 / (1 + np.exp(-2.0 * (v - 1).sum(axis=1)))
    chances = np.zeros((2, len(LABELERS), 3))
    for _ in range(rounds):
        share = {k: (1 + (n * post)[kind == k].sum()) / (2 + n[kind == k].sum()) for k in set(kind)}
        logs = []
        for truth, w in ((0, n * (1 - post)), (1, n * post)):
            for j in range(len(LABELERS)):
                for value in range(3):
                    chances[truth, j, value] = 1 + w[v[:, j] == value].sum() + (value == 2 * truth)
            chances[truth] /= chances[truth].sum(axis=1, keepdims=True)
            logs.append(np.log(chances[truth])[np.arange(len(LABELERS)), v].sum(axis=1) + np.log([share[k] if truth else 1 - share[k] for k in kind]))
        post = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
    return chances, dict(zip(keys, post.tolist(), strict=True))


def features(kind: int, pattern: int) -> np.ndarray:
    x = np.zeros(1 + len(KINDS) + 2 * len(LABELERS))
    x[0] = 1
    x[1 + kind] = 1
    for j in range(len(LABELERS)):
        value = (pattern // 3 ** (len(LABELERS) - 1 - j)) % 3
        x[1 + len(KINDS) + 2 * j + (value == 2)] = value != 1
    return x


def train(counts: dict[tuple[int, int], float], post: dict[tuple[int, int], float], ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression of the posteriors on kind and votes, by Newton steps over the patterns and their counts."""
    keys = sorted(counts)
    x = np.stack([features(*k) for k in keys])
    n, y = np.array([counts[k] for k in keys]), np.array([post[k] for k in keys])
    n = n * min(1.0, 1e6 / n.sum())
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - y)) + ridge * w
        w = w - np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + ridge * np.eye(len(w)), slope)
    return w


SPAN = "array<struct<start:int,kind:int,end:int,votes:int>>"


def detect(docs: DataFrame, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """All columns but the text, with counts per base kind, ``base`` and ``spans``.

    Base spans always stay; a further candidate (written-out addresses, national numbers, secrets) is added when the
    trained classifier gives it ``threshold`` or more and it overlaps no base span. Learning sees a count per kind and
    pattern of votes, over all rows: at most 5 * 243 numbers come to the driver.

    Nulls: a null text counts as empty. Repeated rows give repeated results and count each in learning. Without any
    candidate, the model says no; an empty table gives an empty result. Columns named like the results are replaced, others
    pass through whatever they are called.
    """
    spark = docs.sparkSession
    ship(spark)
    names = [c for c in docs.columns if c not in (text_col, "base", "more", "spans", *(f"n_{k}" for k in KINDS[:4]))]
    (both_,) = fresh(docs, "_s")

    @F.pandas_udf(f"struct<base:{SPAN},more:{SPAN}>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cells = lambda xs: [{"start": s, "kind": k, "end": e, "votes": v} for s, k, e, v in xs]
        for batch in batches:
            both = [find(t) for t in batch]
            yield pd.DataFrame({"base": [cells(b) for b, _ in both], "more": [cells(m) for _, m in both]})

    rows = staged(docs.select(*names, spans(F.col(text_col).cast("string")).alias(both_)).select(*names, f"{both_}.base", f"{both_}.more"), "spans")
    seen = rows.select(F.explode(F.concat("base", "more")).alias("s")).groupBy("s.kind", "s.votes").agg(F.count("*").alias("n")).collect()
    counts = {(r["kind"], r["votes"]): float(r["n"]) for r in seen}
    accepted: list[int] = []
    if counts:
        _, post = reliabilities(counts)
        w = train(counts, post)
        accepted = [k * N_PATTERN + p for k, p in sorted(counts) if 1 / (1 + np.exp(-features(k, p) @ w)) >= threshold]
    yes = F.array(*[F.lit(x) for x in accepted]) if accepted else F.array().cast("array<int>")
    added = F.filter("more", lambda s: F.array_contains(yes, s["kind"] * N_PATTERN + s["votes"]))
    names_of = F.array(*[F.lit(k) for k in KINDS])
    write = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", F.element_at(names_of, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    out = rows
    for i, k in enumerate(KINDS[:4]):
        out = out.withColumn(f"n_{k}", F.expr(f"size(filter(base, s -> s.kind = {i}))").cast("long"))
    both = F.array_sort(F.concat("base", added))
    return out.withColumn("spans", write(both)).withColumn("base", write(F.col("base"))).drop("more")


def op9_personal_data(spark, sf_dir: str) -> DataFrame:
    out = detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS[:4]], F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")

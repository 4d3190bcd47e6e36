"""Operator 12: licence texts and phrases, by a positional index of rare words."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lading.llm.common import ship

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")  # the same words in lower-cased UTF-8


class Template(NamedTuple):
    label: str
    text: str
    #: Phrases that must stand near the place, or the verdict is void.
    phrases: Sequence[str]


# Phrases that count as such.
PHRASES = (
    Template("mit", "mit license", ("mit license",)),
    Template("apache", "apache license", ("apache license",)),
    Template("gpl", "general public license", ("general public license",)),
)
# The usual notices of well-known licences, shortened to their marked parts.
TEMPLATES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", ("permission is hereby granted", "free of charge", "without restriction")),
    Template("mit", "Released under the MIT License.", ("the mit license",)),
    Template("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License", ("apache license", "version 2 0")),
    Template("apache", "Licensed under the Apache License, Version 2.0.", ("apache license", "version 2 0")),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("gnu general public license",)),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public license",)),
    Template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("lesser general public license",)),
    Template("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("affero general public license",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use", "source and binary forms")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("permission to use", "with or without fee")),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla public license",)),
    Template("epl", "made available under the terms of the Eclipse Public License", ("eclipse public license",)),
    Template("boost", "Distributed under the Boost Software License, Version 1.0.", ("boost software license",)),
    Template("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", ("provided as is", "express or implied warranty")),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("cc0", "CC0 1.0 Universal Public Domain Dedication", ("cc0",)),
    Template("cc-by", "Licensed under CC BY 4.0.", ("cc by 4 0",)),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0.", ("cc by sa",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0.", ("cc by nc",)),
    Template("cc-by-nd", "Licensed under CC BY-ND 4.0.", ("cc by nd",)),
    Template("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    Template("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike",)),
    Template("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial",)),
)


def words_of(text: str) -> list[str]:
    """The words of a text; only A-Z are lower-cased."""
    return [w.decode() for w in _WORD_BYTES.findall(text.encode("utf-8", "ignore").lower())]


def document_frequencies(docs: DataFrame, words: Iterable[str]) -> dict[str, int]:
    """How many documents hold each of ``words``: a list as short as the templates', whatever the corpus holds."""
    vocabulary = F.array(*[F.lit(w) for w in sorted(set(words))])
    lower = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.array_intersect(vocabulary, F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    return {r["word"]: r["n"] for r in docs.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}


class Index:
    """Postings ``word -> (template, position)`` of each template's highest-IDF words.

    A template stands where at least half of those words (``votes``) are at the same relative position, give or take
    ``drift`` words that a copy may add or lack, its mandatory phrases stand there too, and ``least_share`` of its words do.
    """

    def __init__(self, templates: Sequence[Template], frequencies: dict[str, int], n_docs: int, n_rare: int = 6, drift: int = 8, least_share: float = 0.6) -> None:
        self.drift, self.least_share = drift, least_share
        self.labels, self.words, self.phrases, self.votes = [], [], [], []
        self.postings: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for t, template in enumerate(templates):
            words = words_of(template.text)
            rare = sorted(set(words), key=lambda w: (-math.log((n_docs + 1) / (frequencies.get(w, 0) + 1)), w))[:n_rare]
            self.labels.append(template.label)
            self.words.append(Counter(words))
            self.phrases.append([words_of(p) for p in template.phrases])
            self.votes.append((len(rare) + 1) // 2)
            for p, w in enumerate(words):
                if w in rare:
                    self.postings[w].append((t, p))

    def _places(self, hits: list[tuple[int, str]], votes: int) -> list[int]:
        """Least offsets of runs of hits within ``drift`` that hold enough different words."""
        hits.sort()
        out, held, end = [], Counter(), 0
        for start, (offset, word) in enumerate(hits):
            while end < len(hits) and hits[end][0] <= offset + self.drift:
                held[hits[end][1]] += 1
                end += 1
            if len(held) >= votes and (not out or out[-1] != offset):
                out.append(offset)
            held[word] -= 1
            if not held[word]:
                del held[word]
        return out

    def found(self, words: list[str]) -> dict[str, float]:
        """Label -> the best share of a template's words that stand at one of its places."""
        hits: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for i, word in enumerate(words):
            for t, p in self.postings.get(word, ()):
                hits[t].append((i - p, word))
        out: dict[str, float] = {}
        for t, own in hits.items():
            if len({w for _, w in own}) < self.votes[t]:
                continue
            size = self.words[t].total()
            for offset in self._places(own, self.votes[t]):
                window = words[max(0, offset) : max(0, offset + size + self.drift)]
                share = (Counter(window) & self.words[t]).total() / size
                if share >= self.least_share and share > out.get(self.labels[t], 0) and all(starts(window, p) for p in self.phrases[t]):
                    out[self.labels[t]] = share
        return out


def starts(words: list[str], phrase: list[str]) -> list[int]:
    """Where a phrase's words stand one after another."""
    return [i for i, w in enumerate(words) if w == phrase[0] and words[i : i + len(phrase)] == phrase]


class PhraseIndex:
    """Exact places of phrases: each is looked up by its highest-IDF word and verified around it."""

    def __init__(self, phrases: Sequence[Template], frequencies: dict[str, int]) -> None:
        self.postings: dict[str, list[tuple[str, int, list[str]]]] = defaultdict(list)
        for phrase in phrases:
            words = words_of(phrase.text)
            at = min(range(len(words)), key=lambda k: (frequencies.get(words[k], 0), k))
            self.postings[words[at]].append((phrase.label, at, words))

    def found(self, words: list[str]) -> list[tuple[int, str]]:
        places = ((i - at, label, phrase) for i, w in enumerate(words) for label, at, phrase in self.postings.get(w, ()))
        return [(start, label) for start, label, phrase in places if start >= 0 and words[start : start + len(phrase)] == phrase]


VERDICT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, phrases: Sequence[Template] = PHRASES) -> DataFrame:
    """``docs`` with a column ``license``: words, places of phrases, labels and a score for each whole text.

    Two passes: the documents that hold each licence word are counted over the corpus, which ranks the words; then each
    text is looked up in an index of the templates' rarest words. Nothing moves between tasks but the counts of the
    licence words, and a task holds one batch of texts.

    ``score`` is the best share of a template's words found in place; a whole phrase has 1. A null text is empty: no words,
    no places, null ``first_word`` and ``last_word``, empty labels, score 0. Repeated rows each get their verdict; an empty
    table gives none. Other columns stay; one named ``license`` is replaced.
    """
    ship(docs.sparkSession)
    vocabulary = {w for t in [*templates, *phrases] for w in words_of(t.text)}
    frequencies = document_frequencies(docs, vocabulary)
    index, exact = Index(templates, frequencies, docs.count()), PhraseIndex(phrases, frequencies)

    def verdict(text: str | None) -> tuple:
        words = words_of(text or "")
        places = exact.found(words)
        base, scores = {label for _, label in places}, index.found(words)
        own = [start for start, _ in places]
        return len(words), len(places), min(own, default=None), max(own, default=None), ",".join(sorted(base)), ",".join(sorted(base | scores.keys())), 1.0 if base else max(scores.values(), default=0.0)

    @F.pandas_udf(VERDICT)
    def verdicts(texts: pd.Series) -> pd.DataFrame:
        names = [c.split()[0] for c in VERDICT.split(", ")]
        out = pd.DataFrame([verdict(t) for t in texts], columns=names)
        return out.astype({"n_words": "int64", "n_base": "int64", "first_word": "Int64", "last_word": "Int64", "score": "float64"})

    return docs.withColumn("license", verdicts(F.col("text").cast("string")))


def op12_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select("doc_id", "license.*")

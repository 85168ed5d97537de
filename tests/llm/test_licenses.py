"""Licence scans against brute force, with odd and long texts."""

from __future__ import annotations

import random
import time

from prismdex.llm import licenses
from prismdex.llm.licence_texts import TEXTS
from tests.llm.test_corpus import WORD, lower


def by_hand(text, share=0.8):
    words, base, labels, score = WORD.findall(lower(text)), [], set(), 0.0
    for t in (*licenses.BASE, *licenses.NOTICES):
        own, key = t.words.split(), t.key.split()
        at = next(i for i in range(len(own)) if own[i : i + len(key)] == key)
        for s in range(len(words)):
            if words[s + at : s + at + len(key)] == key:
                part = sum(a == b for a, b in zip(words[s : s + len(own)], own, strict=False)) / len(own)
                if t in licenses.BASE and part == 1:
                    base.append((s, t.label))
                if part >= (1 if t in licenses.BASE else share):
                    labels.add(t.label)
                    score = max(score, part)
    names = lambda x: ",".join(sorted(set(x)))
    return len(words), len(base), min((s for s, _ in base), default=None), max((s for s, _ in base), default=None), names(b for _, b in base), names(labels), score


def test_scan_against_brute_force(spark):
    rng = random.Random(8)
    texts = [None, "", "mit " * 50, "under the mit license " * 30, "license under the mit", "cc by nc cc by nc by nc", "apache license version 2 0", "Under THE Mit-License,cc/by/nc"]
    for label, text, _ in TEXTS:
        words = text.split()
        for noise in (0.0, 0.1, 0.18, 0.25, 0.4):
            own = ["zzz" if rng.random() < noise else w for w in words]
            texts.append(" ".join(["pre"] * rng.randint(0, 3) + own + ["post"] * rng.randint(0, 3)))
        texts += [" ".join(words[: len(words) * 4 // 5 + 1]), " ".join(words[3:]), f"{text}\n{text} {label}"]
    vocabulary = "under the mit license apache version 2 0 cc by nc gnu general public software free permission granted".split()
    texts += [" ".join(rng.choices(vocabulary, k=rng.randint(0, 300))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(0, None), (None, texts[5])]
    got = sorted(map(tuple, licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted(((i, *by_hand(t)) for i, t in rows), key=str)
    assert sum(1 for r in got if r[6]) > 60


def test_long_texts_take_time_in_proportion(spark):
    rows = [(1, "mit " * 250_000), (2, "under the mit license " * 50_000), (3, "permission is hereby granted free of charge " * 25_000), (4, "x" * 1_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    licenses.scan(docs.limit(0)).collect()
    began = time.perf_counter()
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.labels) for r in licenses.scan(docs).collect()}
    assert time.perf_counter() - began < 60
    assert got == {1: (250_000, 0, None, None, ""), 2: (200_000, 50_000, 0, 199_996, "mit"), 3: (175_000, 0, None, None, ""), 4: (1, 0, None, None, "")}

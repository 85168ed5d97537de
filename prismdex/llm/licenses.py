"""Licence scans with a positional index of rare licence words, in DataFrame functions only.

Templates are licence texts, notices and phrases.  The index holds the words of highest IDF of each template, over the clauses of all templates, with
their positions.  Each file looks up those of its words that the index has; every posting gives a place where the template would begin, and the
postings of a template are intersected by these places: only where enough of its rare words agree is the template compared with the file.
A label is given where the share of its words in place is high enough and its mandatory key phrase stands whole.  Everything happens within a row: no shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismdex.llm.licence_texts import TEXTS
from prismdex.llm.tables import table
from prismdex.llm.url_filters import LOWER, UPPER

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Buckets of words in the index.
BUCKETS = 4096
#: Rare words that must agree on a place at least, where a template has as many.
AGREE = 2


@dataclass(frozen=True)
class Template:
    """words, label and the mandatory key phrase, all in lower case; the clauses of the text."""

    label: str
    words: str
    key: str
    clauses: tuple[str, ...] = ()


def _words(text: str) -> str:
    return " ".join(x for x in re.split(NOT_WORD, text.translate(str.maketrans(UPPER, LOWER))) if x)


#: Phrases that count wherever they stand whole, and their labels: fixed values.
BASE = (
    Template("mit", "under the mit license", "under the mit license"),
    Template("apache-2", "apache license version 2", "apache license version 2"),
    Template("cc-by-nc", "cc by nc", "cc by nc"),
)
NOTICES = tuple(Template(label, _words(text), key, tuple(_words(c) for c in re.split(r"[.:;,]\s", text))) for label, text, key in TEXTS)


def _anchors(templates: tuple[Template, ...], shares: list[float]) -> tuple[dict[str, list[tuple[int, int]]], list[int]]:
    """(postings, agree): (template, position) of the words of highest IDF (then the longest) of each template, and how many must agree on a place.

    A place with the template's share of words misses ``len - ceil(share * len)`` of them at most, so with ``AGREE`` more posted, and all
    postings that can't be missed asked for, no place is lost.
    """
    clauses = [set(c.split()) for t in templates for c in t.clauses or (t.words,)]
    seen = Counter(w for c in clauses for w in c)
    idf = {w: math.log(len(clauses) / n) for w, n in seen.items()}
    out: dict[str, list[tuple[int, int]]] = {}
    agree = []
    for k, (t, share) in enumerate(zip(templates, shares, strict=True)):
        words = t.words.split()
        missed = len(words) - math.ceil(share * len(words) - 1e-9)
        posted = 0
        for w in sorted(set(words), key=lambda w: (-idf[w], -len(w), w)):
            if posted >= missed + AGREE:
                break
            at = [p for p, x in enumerate(words) if x == w]
            out.setdefault(w, []).extend((k, p) for p in at)
            posted += len(at)
        agree.append(posted - missed)
    return out, agree


def _index(spark, postings: dict[str, list[tuple[int, int]]]) -> Column:
    """Buckets of (w, p): a word and, for each posting, template * 2**32 less the position.  The bucket of a word follows from its XXH64."""
    words = sorted(postings)
    rows = spark.sql("SELECT " + ", ".join(f"pmod(xxhash64('{w}'), {BUCKETS})" for w in words)).first()  # a constant: no table is read
    held: dict[int, list[str]] = {}
    for w, k in zip(words, rows, strict=True):
        held.setdefault(k, []).append(w)
    entry = lambda w: f"named_struct('w', '{w}', 'p', array({', '.join(f'{(k << 32) - p}L' for k, p in postings[w])}))"
    return F.expr("array(" + ", ".join(f"array({', '.join(map(entry, held[k]))})" if k in held else "null" for k in range(BUCKETS)) + ")")


def scan(docs: DataFrame, base: tuple[Template, ...] = BASE, notices: tuple[Template, ...] = NOTICES, share: float = 0.8) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base, first_word and last_word: places (from 0) where a template of ``base`` stands whole; its anchor words stand there too, so the
    index finds every one.  labels: those of base, and of notices of which ``share`` of the words and the whole key phrase stand in
    place.  score: the best share among the labels given, else 0.  A null or empty text has no words; equal places all count;
    repeated rows repeat; other columns are ignored; an empty table gives an empty one.  A very long text is one row of arrays, in time and memory
    in proportion to its words.
    """
    templates = (*base, *notices)
    postings, agree = _anchors(templates, [1.0] * len(base) + [share] * len(notices))
    index = _index(docs.sparkSession, postings)
    texts = F.array(*[F.array(*[F.lit(w) for w in t.words.split()]) for t in templates])
    keys = F.array(*[F.array(*[F.lit(w) for w in t.key.split()]) for t in templates])
    key_at = F.array(*[F.lit(_find(t.words.split(), t.key.split())) for t in templates])
    labels = F.array(*[F.lit(t.label) for t in templates])
    least = F.array(*[F.lit(n) for n in agree])
    bucket = lambda w: F.get(index, F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))

    words = F.array_remove(F.split(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), NOT_WORD, -1), "")
    rows = docs.select("doc_id", words.alias("words"))
    rows = rows.select("doc_id", "words", F.size("words").cast("long").alias("n_words"))
    at = F.array_compact(F.transform("words", lambda w, i: F.when(bucket(w).isNotNull(), i)))
    rows = rows.select("doc_id", "words", "n_words", at.alias("at"))

    def begins(i: Column) -> Column:
        own = F.filter(bucket(F.get("words", i)), lambda e: e["w"] == F.get("words", i))
        return F.flatten(F.transform(own, lambda e: F.transform(e["p"], lambda p: p + i)))

    # template * 2**32 + place, once for each rare word that agrees; places before the text wrap around to beyond its end.
    places = F.filter(F.flatten(F.transform("at", begins)), lambda c: _place(c) < F.col("n_words"))
    rows = rows.select("doc_id", "words", "n_words", F.sort_array(places).alias("places"))
    first = lambda c, i: (i == 0) | (F.get("places", F.greatest(i - 1, F.lit(0))) != c)
    enough = lambda c, i: F.coalesce(F.get("places", i + F.get(least, _template(c)) - 1) == c, F.lit(False))
    rows = rows.select("doc_id", "words", "n_words", F.filter("places", lambda c, i: first(c, i) & enough(c, i)).alias("places"))

    def judged(c: Column) -> Column:
        t, s = _template(c), _place(c).cast("int")
        text, key = F.get(texts, t), F.get(keys, t)
        there = F.slice("words", s + 1, F.size(text))
        same = F.filter(F.zip_with(there, text, lambda a, b: a.eqNullSafe(b)), lambda x: x)
        whole = F.slice("words", s + 1 + F.get(key_at, t), F.size(key)) == key
        return F.struct(t.alias("t"), s.alias("s"), F.when(whole, F.size(same) / F.size(text)).alias("share"))

    rows = rows.select("doc_id", "n_words", F.transform("places", judged).alias("places"))
    n = len(base)
    found = F.filter("places", lambda c: F.coalesce(c["share"] >= F.when(c["t"] < n, 1.0).otherwise(share), F.lit(False)))
    rows = rows.select("doc_id", "n_words", found.alias("found"))
    rows = rows.withColumn("whole", F.transform(F.filter("found", lambda c: c["t"] < n), lambda c: c["s"]))
    named = lambda places: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(places, lambda c: F.get(labels, c["t"])))))
    return rows.select(
        "doc_id", "n_words", F.size("whole").cast("long").alias("n_base"), F.array_min("whole").cast("long").alias("first_word"), F.array_max("whole").cast("long").alias("last_word"),
        named(F.filter("found", lambda c: c["t"] < n)).alias("base_labels"), named(F.col("found")).alias("labels"), F.coalesce(F.array_max(F.transform("found", lambda c: c["share"])), F.lit(0.0)).alias("score"),
    )


def _template(c: Column) -> Column:
    return F.shiftright(c, 32).cast("int")


def _place(c: Column) -> Column:
    return c.bitwiseAND(F.lit((1 << 32) - 1))


def _find(words: list[str], key: list[str]) -> int:
    at = next((i for i in range(len(words)) if words[i : i + len(key)] == key), None)
    if at is None:
        raise ValueError(f"the key phrase {' '.join(key)!r} is not part of its template")
    return at


def op9_licenses(spark, sf_dir) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    rows = [(t, base) for ts, base in ((BASE, True), (NOTICES, False)) for t in ts]
    values = ",\n".join(f"  ('{t.label}', '{t.words}', '{t.key}', {_find(t.words.split(), t.key.split())}, {base})" for t, base in rows)
    return rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t(label, words, keys, key_at, base) AS (VALUES
{values}),
p AS (SELECT label, string_split(words, ' ') AS x, string_split(keys, ' ') AS k, key_at, base FROM t),
c AS (SELECT doc_id, w, label, x, k, key_at, base, unnest(range(1, len(w) + 1)) AS i FROM d, p WHERE list_contains(w, k[1])),
h AS (SELECT doc_id, label, base, x, w, i - 1 - key_at AS s FROM c WHERE w[i : i + len(k) - 1] = k AND i - 1 - key_at >= 0),
g AS (SELECT doc_id, label, base, s, len(list_filter(range(1, len(x) + 1), lambda j : coalesce(w[s + j] = x[j], false))) / len(x) AS share FROM h),
f AS (SELECT * FROM g WHERE share >= CASE WHEN base THEN 1.0 ELSE 0.8 END),
a AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM f GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN a USING (doc_id)
"""


OP9_SQL = _sql()

"""Tokens and stems as a full-text index makes them: Unicode words without diacritics, then Porter's algorithm (1980)."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings and what replaces them where the measure of the stem is positive (fixed values of the published algorithm, steps 2 and 3).
STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
# Endings that go where the measure is over one (step 4).
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _pairs(text: str) -> list[tuple[str, str]]:
    return sorted((tuple(x.split(":")) for x in text.split()), key=lambda p: -len(p[0]))


_STEP2, _STEP3, _STEP4 = _pairs(STEP2), _pairs(STEP3), sorted(STEP4.split(), key=len, reverse=True)


def _shape(word: str) -> str:
    """v for each vowel and c for each consonant; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short(stem: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _replaced(word: str, rules: list[tuple[str, str]]) -> str:
    for end, new in rules:
        if word.endswith(end):
            stem = word[: len(word) - len(end)]
            return stem + new if _measure(stem) > 0 else word
    return word


def porter(word: str) -> str:
    """The stem of a lower-case word; words under three or over 64 letters stay."""
    if not 3 <= len(word) <= 64:
        return word
    if word.endswith("s"):
        long_ = (len(word) > 4 and word.endswith("sses")) or (len(word) > 3 and word.endswith("ies"))  # a stem must be left
        word = word[:-2] if long_ else word if word.endswith("ss") else word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and "v" in _shape(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, _STEP2), _STEP3)
    for end in _STEP4:
        if word.endswith(end):
            stem = word[: len(word) - len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short(stem)):
            word = stem
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


#: Runs of letters, digits and private-use characters, with the marks among them.
WORD = r"[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}\p{Mn}]*"


def folded(word: str) -> str:
    """In lower case, Latin letters without their marks."""
    if word.isascii():
        return word.lower()
    bare = (unicodedata.normalize("NFKD", ch)[0] if unicodedata.decomposition(ch)[:1] not in ("", "<") else ch for ch in word if unicodedata.category(ch) != "Mn")
    return "".join(bare).lower()


def _stems(column: pa.Array) -> pa.Array:
    """Stems of lists of words; each distinct word of a batch is folded and stemmed once."""
    lists = column.fill_null([]) if column.null_count else column
    coded = lists.flatten().dictionary_encode()
    own = pa.array([porter(folded(w)) for w in coded.dictionary.to_pylist()], pa.string())
    bounds = pa.array([0], pa.int32()) if not len(lists) else pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(pc.list_value_length(lists)).cast(pa.int32())])
    return pa.ListArray.from_arrays(bounds, own.take(coded.indices))


def stemmed_words(text: Column) -> Column:
    """Stems of a text in order, repeats included; words are found by a built-in expression and only stems in Python, on Arrow batches."""
    return F.arrow_udf(_stems, "array<string>")(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)))

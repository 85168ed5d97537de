"""Quality rules by repetition coverage: which share of a text lies inside repeated n-grams and lines.

For every n-gram length from 2 to 10 words, rolling hashes over the words find windows that occur
more than once in the same text; a window of n + 1 words can only repeat where both of its n-word parts
do, so each length looks only at what the previous one left.  Words and lines are compared by their bytes, and windows of equal hash by
the window of one word less and the last word, so unlike ones never count as equal.  The characters that later occurrences
cover, each counted once, over the characters of all words give the coverage of that length.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismdex.llm import textblocks as tb
from prismdex.llm.tables import boxed, table, unboxed

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
NEWLINE = 10
ROW = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, top_ngram double, dup_ngram double, dup_line double, base_failed boolean, kept boolean"


@dataclass(frozen=True)
class Rules:
    """Limits as shares of the characters of all words; a text that passes one of them is rejected."""

    min_words: int = 50
    max_repeat_percent: int = 50
    #: One n-gram, all its occurrences: by n.
    top: dict[int, float] = field(default_factory=lambda: {2: 0.30, 3: 0.25, 4: 0.20})
    #: Later occurrences of any n-gram: by n.
    dup: dict[int, float] = field(default_factory=lambda: {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20})
    #: Later occurrences of lines.
    line: float = 0.30


def _repeated(keys: np.ndarray, confirm: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(repeated, later, group size, first) of each key: whether it occurs again, whether it occurred before, where it occurs first.

    confirm: rows that are equal exactly where the keys stand for the same; where equal keys have unlike rows, the rows decide.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    head = np.ones(n, bool)
    head[1:] = ranked[1:] != ranked[:-1]
    if confirm is not None and n and (confirm[order[1:]] != confirm[order[:-1]])[~head[1:]].any():
        return _repeated(np.unique(np.column_stack([confirm, keys.view(np.int64)]), axis=0, return_inverse=True)[1].ravel())
    at = np.flatnonzero(head)
    size = np.diff(np.append(at, n))
    later, group, first = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
    group[order] = np.repeat(size, size)
    first[order] = np.repeat(order[at], size)
    later[order] = ~head
    return group > 1, later, group, first


def measure(raw: np.ndarray, off: np.ndarray, rules: Rules) -> dict[str, np.ndarray]:
    """Counts and coverage of each text of a block."""
    texts = len(off) - 1
    starts, ends, first = tb.word_spans(tb.SPACE[raw], off)
    n_words, owner = np.diff(first), tb.spread(first)
    points = np.zeros(len(raw) + 1, np.int64)  # code points before each byte
    np.cumsum((raw & 0xC0) != 0x80, out=points[1:])
    chars = points[ends] - points[starts]
    word_chars = tb.sums(chars, first)
    symbols = tb.sums(SYMBOLS[raw], off)
    salt = tb.mix((np.arange(texts, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    names = tb.named(raw, starts, ends)[0].astype(np.int64)
    words = tb.mix(names.view(np.uint64) + np.uint64(1))
    n = len(words)
    share = lambda x: x / np.maximum(word_chars, 1)

    # Lines: \n ends one, and so does the text.
    cut = np.flatnonzero(raw == NEWLINE)
    edge = np.sort(np.concatenate([cut, off[1:]]), kind="stable")
    begin = np.sort(np.concatenate([cut + 1, off[:-1]]), kind="stable")
    line_first = np.searchsorted(cut, off) + np.arange(texts + 1)
    line_owner = tb.spread(line_first)
    in_words = np.searchsorted(starts, begin), np.searchsorted(starts, edge)
    real = in_words[1] > in_words[0]
    keys = tb.named(raw, begin[real], edge[real])[0].astype(np.int64) << 32 | line_owner[real]
    later = np.zeros(len(begin), bool)
    later[real] = _repeated(keys)[1]
    n_dup_lines = tb.sums(later, line_first)
    upto = np.zeros(n + 1, np.int64)
    np.cumsum(chars, out=upto[1:])
    dup_line = share(tb.sums(np.where(later, upto[in_words[1]] - upto[in_words[0]], 0), line_first))

    # Windows of words: ``at`` holds the starts that can still repeat.
    top_ngram, dup_ngram = np.zeros(texts), np.zeros(texts)
    n_repeat, failed = np.zeros(texts, np.int64), dup_line > rules.line
    rolling, step = words.copy(), 1
    shorter = owner * n + names  # then: where the window of one word less at this place occurs first
    at = np.flatnonzero(owner[:-1] == owner[1:]) if n > 1 else np.zeros(0, np.int64)
    base = 0xD6E8FEB86659FD93
    for size in range(2, max([3, *rules.top, *rules.dup]) + 1):
        step = step * base % (1 << 64)
        at = at[at + size <= n]
        rolling[at] = rolling[at] + words[at + size - 1] * np.uint64(step)
        keys = tb.mix(rolling[at] ^ salt[owner[at]])
        repeated, again, group, where = _repeated(keys, shorter[at] * n + names[at + size - 1])
        shorter[at] = at[where] if len(at) else at
        if size == 3:
            n_repeat = tb.sums(tb.covered(at[repeated], 3, n), first)
        if size in rules.top:
            most = np.zeros(texts)
            np.maximum.at(most, owner[at[repeated]], ((upto[at + size] - upto[at]) * group)[repeated])
            top_ngram = np.maximum(top_ngram, share(most))
            failed |= share(most) > rules.top[size]
        if size in rules.dup:
            inside = share(tb.sums(np.where(tb.covered(at[again], size, n), chars, 0), first))
            dup_ngram = np.maximum(dup_ngram, inside)
            failed |= inside > rules.dup[size]
        at = at[repeated]
        if len(at):  # both parts of a longer window must repeat, in the same text
            last = at[-1] + 1
            goes = np.zeros(last + 1, bool)
            goes[at] = True
            at = at[goes[np.minimum(at + 1, last)] & (at + 1 < n)]
            at = at[owner[at] == owner[np.minimum(at + size, n - 1)]]
    base_failed = (n_words < rules.min_words) | (100 * n_repeat > rules.max_repeat_percent * n_words)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat,
        "top_ngram": top_ngram, "dup_ngram": dup_ngram, "dup_line": dup_line, "base_failed": base_failed, "kept": ~(base_failed | failed),
    }


def verdict(rules: Rules | None = None):
    """An Arrow function: text to a struct of counts, coverage and the verdict (see ROW)."""
    rules = rules or Rules()

    @F.arrow_udf(ROW)
    def judged(text: pa.Array) -> pa.Array:
        parts = [measure(raw, off, rules) for raw, off in tb.blocks(text, tb.SMALL)]
        names = [x.split()[0] for x in ROW.split(", ")]
        if not parts:
            parts = [measure(np.zeros(0, np.uint8), np.zeros(1, np.int64), rules)]
        return pa.StructArray.from_arrays([pa.array(np.concatenate([p[k] for p in parts])) for k in names], names)

    return judged


def judge(docs: DataFrame, rules: Rules | None = None, text: str = "text", into: str = "quality") -> DataFrame:
    """Each row of ``docs`` with a struct column ``into`` (see ROW).

    No shuffle: each text is judged where it is read.  A null or empty text has no words, so it fails
    ``min_words``; a very long text is measured whole, in a block of its own (about a hundred times its bytes of memory at most); repeated rows get the same verdict; an empty table gives an empty table; other
    columns pass unchanged, also one named as a field of the struct.  One named ``into`` is replaced.
    """
    return docs.withColumn(into, verdict(rules)(F.col(text)))


def keep_good(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """The rows of ``docs`` that pass the rules, with their columns, whatever the names of these."""
    return unboxed(boxed(docs, quality=verdict(rules)(F.col("text"))).where("quality.kept"))


def op3_quality_rules(spark, sf_dir) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text"), into="q").select("doc_id", "q.*")

"""Fill-in-the-middle transformation by an Aho-Corasick event scan.

One automaton reports every ASCII character at which the class of characters changes (white space and punctuation, or line ends, by the kind of unit)
and every sentinel.  Between two such events lie characters of one class, so the units of a gap follow from its length alone; units are summed
over events and gaps, and the place of any unit is found by a search in these sums and arithmetic inside a gap.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismdex.llm.tables import table

#: In front of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
SPACES = " \t\n\v\f\r"
MARKS = "".join(c for c in map(chr, range(128)) if not (c.isalnum() or c == "_" or c in SPACES))
ROW = "units long, form string, prefix_units long, middle_units long, output string"
#: Texts that are held as Python strings together.
HELD = 256
_SPACE, _MARK, _SENTINEL = 0, 1, 2


class Events:
    """The automaton of a kind of unit.

    Units: "point", every code point; "word", every run of characters that are neither ASCII white space nor ASCII punctuation and every
    punctuation character (white space goes with what follows it); "line", what ``\\n`` or the end of the text ends.
    """

    def __init__(self, unit: str, sentinels: tuple[str, ...]) -> None:
        if unit not in ("point", "word", "line"):
            raise ValueError(f"no such unit: {unit}")
        check(sentinels)
        self.unit = unit
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for c in "\n" if unit == "line" else SPACES + MARKS:
            self.automaton.add_word(c, _SPACE if c in SPACES else _MARK)
        for k, word in enumerate(sentinels):
            self.automaton.add_word(word, _SENTINEL + k)
        self.automaton.make_automaton()

    def scan(self, text: str) -> Units:
        found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2) if text else np.zeros((0, 2), np.int64)
        mark = found[:, 1] >= _SENTINEL
        return Units(self.unit, len(text), found[~mark, 0], found[~mark, 1], bool(mark.any()))


class Units:
    """Units of a text, from its events alone."""

    def __init__(self, unit: str, length: int, at: np.ndarray, kind: np.ndarray, sentinels: bool) -> None:
        self.unit, self.length, self.sentinels = unit, length, sentinels
        # Pieces: gap, event, gap, event, ..., gap; each with its end and its units.
        self.ends = np.empty(2 * len(at) + 1, np.int64)
        self.ends[0:-1:2], self.ends[1::2], self.ends[-1] = at, at + 1, length
        gap = self.ends[0::2] - np.concatenate([[0], self.ends[1::2]])
        units = np.empty(len(self.ends), np.int64)
        if unit == "point":
            units[0::2], units[1::2] = gap, 1
        elif unit == "word":
            units[0::2], units[1::2] = gap > 0, kind == _MARK
        else:
            units[0::2], units[1::2] = 0, 1
            units[-1] = gap[-1] > 0
        self.upto = np.cumsum(units)

    @property
    def n(self) -> int:
        return int(self.upto[-1])

    def place(self, k: int) -> int:
        """Code points before the end of the first k units; all of the text for all units."""
        if k <= 0:
            return 0
        if k >= self.n:
            return self.length
        piece = int(np.searchsorted(self.upto, k))
        end = int(self.ends[piece])
        return end - (int(self.upto[piece]) - k) if self.unit == "point" else end


def check(sentinels: tuple[str, ...]) -> None:
    """Sentinels must be told apart wherever they stand: none may begin with what another one ends with, or lie in another."""
    for k, a in enumerate(sentinels):
        for j, b in enumerate(sentinels):
            if not a or (k != j and a in b) or any(a[-n:] == b[:n] for n in range(1, min(len(a), len(b)))):
                raise ValueError(f"sentinels {a!r} and {b!r} can't be told apart")


@cache
def events(unit: str, sentinels: tuple[str, ...]) -> Events:
    return Events(unit, sentinels)


def _strings(column: pa.Array) -> Iterator[str]:
    for at in range(0, len(column), HELD):
        for text in column.slice(at, HELD).to_pylist():
            yield text or ""


def arranged(text: str, a: int, b: int, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> str:
    """The text cut at places a and b, in the order of the form."""
    p, s, m = sentinels
    if form == "plain":
        return text
    return f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}" if form == "psm" else f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}"


def rearranged(output: str, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> str:
    """The exact text of an output of ``arranged``: between three sentinels, which are found by the automaton."""
    if form == "plain":
        return output
    found = [(end + 1, kind - _SENTINEL) for end, kind in events("line", sentinels).automaton.iter(output) if kind >= _SENTINEL]
    ends = [begin - len(sentinels[k]) for begin, k in found[1:]] + [len(output)]
    part = {k: output[begin:end] for (begin, k), end in zip(found, ends, strict=True)}
    return part[0] + part[2] + part[1]


def transformed(unit: str, plain_percent: int, spm_percent: int, sentinels: tuple[str, str, str]):
    """An Arrow function of (text, four draws) to a struct (see ROW)."""
    check(sentinels)

    @F.arrow_udf(ROW)
    def run(text: pa.Array, one: pa.Array, two: pa.Array, three: pa.Array, four: pa.Array) -> pa.Array:
        scan = events(unit, sentinels).scan
        rows: list[tuple] = []
        draws = zip(*[x.to_pylist() for x in (one, two, three, four)], strict=True)
        for t, (h1, h2, h3, h4) in zip(_strings(text), draws, strict=True):
            units = scan(t)
            n = units.n
            if not t or units.sentinels or h3 % 100 >= 100 - plain_percent:
                rows.append((n, "plain", None, None, t))
                continue
            a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
            form = "spm" if h4 % 100 < spm_percent else "psm"
            rows.append((n, form, a, b - a, arranged(t, units.place(a), units.place(b), form, sentinels)))
        n, form, prefix, middle, out = zip(*rows, strict=True) if rows else [()] * 5
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip((n, form, prefix, middle, out), kinds, strict=True)], [x.split()[0] for x in ROW.split(", ")])

    return run


def draws(key: Column, seed: str) -> list[Column]:
    """Four numbers below 2**32: the first 8-digit groups of the SHA-256 of ``seed:key``; a null key counts as no digits."""
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, unit: str = "point", seed: str = "1", plain_percent: int = 10, spm_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS, text: str = "text", key: str = "doc_id", into: str = "fim") -> DataFrame:
    """Each row of ``docs`` with a struct column ``into``: units of the text, form (plain, psm, spm), units of prefix and middle, output (see ROW).

    A text is cut into whole units.  Texts that are null or empty or contain a sentinel stay plain, and so do ``plain_percent`` in a hundred; of the others
    ``spm_percent`` in a hundred have the suffix first.  Draws follow from seed and key, so equal keys have equal draws and reruns agree.  No shuffle; a very long text is
    scanned whole (about 40 bytes of memory an event); repeated rows get equal results; other columns pass unchanged, one named ``into`` is replaced; an empty table gives an empty one.
    """
    column = lambda c: F.col(f"`{c}`")
    return docs.withColumn(into, transformed(unit, plain_percent, spm_percent, sentinels)(column(text), *draws(column(key), seed)))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The exact text from output and form."""
    check(sentinels)

    @F.arrow_udf("string")
    def run(output: pa.Array, form: pa.Array) -> pa.Array:
        return pa.array([rearranged(x, k, sentinels) for x, k in zip(_strings(output), form.to_pylist(), strict=True)], pa.string())

    return run(output, form)


def op12_fill_middle(spark, sf_dir) -> DataFrame:
    done = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fim.*")
    done = done.withColumn("restored", restored(F.col("output"), F.col("form")))
    return done.select("doc_id", F.col("units").alias("n"), "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
e AS (
  SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS y,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
f AS (
  SELECT doc_id, n, t, form, least(x, y) AS a, abs(x - y) AS m,
    '<P>' || substr(t, 1, least(x, y)) AS p, '<S>' || substr(t, greatest(x, y) + 1) AS s, '<M>' || substr(t, least(x, y) + 1, abs(x - y)) AS i
  FROM e)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(m AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN p || s || i ELSE s || p || i END) AS output_sha256, sha256(t) AS restored_sha256
FROM f
"""

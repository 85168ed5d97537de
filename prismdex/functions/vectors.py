"""Vector expressions, and sparse hashed word vectors, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prismdex.functions import fixed
from prismdex.functions.text import let, letters, tokens


def dot(a: Column, b: Column) -> Column:
    """In double precision, terms in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Scaled to length 1; a zero vector stays as it is."""

    def scaled(v: Column) -> Column:
        return let(F.greatest(norm(v), F.lit(0.0)), lambda n: F.transform(v, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0)))

    return let(a, scaled)


def bucket(word: Column) -> Column:
    """One of 256 buckets of a word: the last byte of its MD5."""
    return F.conv(F.substring(F.md5(word), 31, 2), 16, 10).cast("int")


def word_buckets(text: Column) -> Column:
    """The bucket of every token of the text, repeats included."""
    return F.transform(tokens(text), bucket)


def hashed_words(text: Column) -> Column:
    """Unit vector of token counts in 256 buckets."""
    every = F.sequence(F.lit(0), F.lit(fixed.BUCKETS - 1))
    counts = let(word_buckets(text), lambda found: F.transform(every, lambda b: F.size(F.filter(found, lambda x: x == b)).cast("double")))
    return unit(counts)


def colour_words(text: Column) -> Column:
    """Unit vector of eight numbers: the sum of the colours named in the text, then zeros."""
    parts = F.create_map(*[x for name, rgb in fixed.COLOURS.items() for x in (F.lit(name), F.array(*[F.lit(float(v)) for v in rgb]))])
    known = F.filter(letters(text), lambda w: parts[w].isNotNull())
    zero = F.array(*[F.lit(0.0)] * 3)
    total = F.aggregate(known, zero, lambda acc, w: F.zip_with(acc, parts[w], lambda x, y: x + y))
    return unit(F.concat(total, F.array(*[F.lit(0.0)] * 5)))

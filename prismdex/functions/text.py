"""Text expressions: tokens, query terms, chunks, snippets and display forms, all built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from prismdex.functions import fixed
from prismdex.functions.chunks import chunk_lists, chunk_rows


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where a lambda inside uses it again and again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapsed(text: Column) -> Column:
    """Runs of (Unicode) white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 in the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def spaced_tokens(text: Column) -> Column:
    """The tokens as one string, a space between any two: it is made and moved in far less time than a list of them."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def split_tokens(spaced: Column) -> Column:
    """The list of tokens of ``spaced_tokens``."""
    return F.filter(F.split(spaced, " "), lambda t: t != "")


def letters(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def query_terms(text: Column) -> Column:
    """Distinct tokens of a query in order, without stop words and single characters."""
    stop = F.array(*[F.lit(w) for w in fixed.STOP_WORDS])
    return F.array_distinct(F.filter(tokens(text), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t)))


def intents(text: Column) -> Column:
    """Media types that the words of a query point to, sorted."""
    words = letters(text)
    found = [F.when(F.arrays_overlap(words, F.array(*[F.lit(w) for w in ws])), F.lit(kind)) for kind, ws in sorted(fixed.INTENT_WORDS.items())]
    return F.array_compact(F.array(*found))


def chunks(text: Column, size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP, least: int = fixed.CHUNK_LEAST) -> Column:
    """Overlapping chunks of the collapsed text (see ``functions.chunks``).

    Python on Arrow batches: an expression would read the text from its start again for each chunk.
    """
    return F.arrow_udf(chunk_lists(size, overlap, least), "array<string>")(collapsed(text))


def exploded_chunks(rows: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys..., n, text): the rows of ``chunks`` with their numbers, without lists of them: a task holds the chunks of a few texts at a time."""
    schema = StructType([*[rows.schema[k] for k in keys], StructField("n", IntegerType()), StructField("text", StringType())])
    return rows.select(*keys, collapsed(F.col(text)).alias("text")).mapInArrow(chunk_rows(), schema)


def snippet(text: Column, size: int = fixed.SNIPPET) -> Column:
    """The first characters, with an ellipsis where more follow; null for null or empty."""
    return F.when(F.length(text) > 0, F.concat(F.substring(text, 1, size), F.when(F.length(text) > size, "…").otherwise("")))


def first_words(text: Column, count: int = fixed.VISUAL_WORDS) -> Column:
    return F.array_join(F.slice(F.split(collapsed(text), " "), 1, count), " ")


def highlighted(text: Column, query: Column) -> Column:
    """Occurrences of the query's words of more than two characters between mark tags."""
    words = F.filter(F.split(query, r"\W+"), lambda w: F.length(w) > 2)
    return F.when(F.size(words) > 0, F.regexp_replace(text, F.concat(F.lit("(?i)("), F.array_join(words, "|"), F.lit(")")), F.lit("<mark>$1</mark>"))).otherwise(text)


def without_tags(html: Column) -> Column:
    """Tags as spaces, the five XML entities and no-break spaces resolved, trimmed."""
    plain = F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(char))
    return F.regexp_replace(plain, r"(?U)^\s+|\s+$", "")


def display_size(size: Column) -> Column:
    kb, mb = F.format_string("%.0f KB", F.bround(size / 1e3)), F.format_string("%.1f MB", size / 1e6)
    return F.when(size >= 1e6, mb).when(size >= 1e3, kb).otherwise(F.concat(size.cast("string"), F.lit(" B")))


def minutes(seconds: Column) -> Column:
    s = F.bround(F.coalesce(seconds, F.lit(0.0))).cast("long")
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)


def match_label(kind: Column, ref: Column) -> Column:
    """What a hit points at."""
    return (
        F.when(kind == "frame", F.concat(F.lit("frame at "), minutes(ref)))
        .when(kind == "transcript", F.concat(F.lit("speech at "), minutes(ref)))
        .when(kind.isin("page", "chunk"), F.concat(F.lit("page "), ref.cast("long").cast("string")))
        .otherwise(kind)
    )


def listed(text: Column) -> Column:
    """A comma-separated list: trimmed, lower-cased, blanks dropped; null where nothing is left."""
    items = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return F.when(F.size(items) > 0, items)


def fourcc(code: Column) -> Column:
    """A codec number as its four characters, lowest byte first."""
    return F.concat(*[F.char(F.shiftright(code, 8 * k).bitwiseAND(255)) for k in range(4)])

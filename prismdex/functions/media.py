"""Expressions about files: endings, media types, MIME types, paths, frame times and page picks."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column
from pyspark.sql import functions as F

from prismdex.functions import fixed


def ending(name: Column) -> Column:
    """Lower-case ending with its dot; empty where there is none (a leading dot alone is none)."""
    return F.lower(F.regexp_extract(name, r"[^/.]\.*(\.[^./]*)$", 1))


def media_type(ext: Column) -> Column:
    """image, video or pdf; null for anything else."""
    out = F.lit(None).cast("string")
    for kind, endings in fixed.ENDINGS.items():
        out = F.when(F.lower(ext).isin(*endings), kind).otherwise(out)
    return out


def mime_type(ext: Column) -> Column:
    table = {e: mimetypes.guess_type(f"x{e}")[0] for endings in fixed.ENDINGS.values() for e in endings}
    return F.create_map(*[F.lit(x) for e, m in sorted(table.items()) if m for x in (e, m)])[F.lower(ext)]


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def top_folders(relative: Column, depth: int = 2) -> Column:
    """The first components of a relative folder; a dot for the root."""
    return F.when(F.coalesce(relative, F.lit("")) == "", ".").otherwise(F.array_join(F.slice(F.split(relative, "/"), 1, depth), "/"))


def is_hidden(name: Column) -> Column:
    return F.startswith(name, F.lit(".")) | F.lower(name).isin(*fixed.IGNORED_NAMES)


def sample_times(duration: Column, most: int, interval: float) -> Column:
    """Middles of n equal parts of a video; n is a part for each interval, 1 at least and ``most`` at most."""
    n = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(duration / max(interval, 0.1)).cast("int")))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i + 0.5) * duration / n)


def sequential_picks(frames: Column, fps: Column, interval: float, most: int) -> Column:
    """Frame numbers when a video can only be read from front to back."""
    step = F.greatest(F.lit(1), F.bround(interval * F.when(fps > 0, fps).otherwise(25.0)).cast("int"))
    every = F.filter(F.sequence(F.lit(0), frames - 1), lambda i: i % step == 0)
    return F.when(frames > 0, F.slice(every, 1, most)).otherwise(F.array().cast("array<int>"))


def page_picks(pages: Column, most: int) -> Column:
    """At most ``most`` page numbers (from 0), evenly spaced from the first to the last, rounded half to even."""
    k = F.least(pages, F.lit(most))
    spaced = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.bround(i * (pages - 1) / F.greatest(k - 1, F.lit(1))).cast("int"))
    return F.when(k > 0, F.array_sort(F.array_distinct(spaced))).otherwise(F.array().cast("array<int>"))

"""Catalogue queries over assets, files and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def files_by_state(files: DataFrame) -> DataFrame:
    return files.where("present").groupBy("state").agg(F.count("*").alias("n"))


def stats_by_type(assets: DataFrame, files: DataFrame) -> DataFrame:
    """Assets, files and bytes by type over present files; bytes count every copy."""
    both = files.where("present").select("asset_id", "path").join(assets.select("asset_id", "type", "size"), "asset_id")
    return both.groupBy("type").agg(F.countDistinct("asset_id").alias("assets"), F.count("*").alias("files"), F.sum("size").alias("bytes"))


def ready_assets_by_type(assets: DataFrame) -> DataFrame:
    return assets.where("status = 'ready'").groupBy("type").agg(F.count("*").alias("n"))


def _copies(files: DataFrame) -> DataFrame:
    return files.where("present AND asset_id IS NOT NULL")


def duplicate_count(files: DataFrame) -> DataFrame:
    """One row: the number of assets with more than one present file."""
    return _copies(files).groupBy("asset_id").count().where("count > 1").agg(F.count("*").alias("duplicate_groups"))


def duplicate_groups(files: DataFrame, limit: int = 200) -> DataFrame:
    """(asset_id, n, paths) of the assets with the most copies; ties by asset_id.

    The largest groups are found by counting; paths are gathered for these only.
    """
    largest = _copies(files).groupBy("asset_id").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.col("n").desc(), "asset_id").limit(limit)
    paths = _copies(files).select("asset_id", "path").join(largest, "asset_id")
    return paths.groupBy("asset_id", "n").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def total_bytes(files: DataFrame) -> DataFrame:
    return files.where("present").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def vectors_by_space(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("space").agg(F.count("*").alias("n"))


def listed_files(files: DataFrame, states: list[str] | None = None, limit: int = 200, offset: int = 0) -> DataFrame:
    """A page of present files in some states, by state and path."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must be from 1 to 1000 and offset 0 or more")
    found = files.where("present").where(F.col("state").isin(*(states or ["failed", "unsupported"])))
    return found.orderBy("state", "path").offset(offset).limit(limit)


def orphans(assets: DataFrame, files: DataFrame) -> DataFrame:
    """Assets that no file refers to, present or not."""
    return assets.join(files.select("asset_id").where("asset_id IS NOT NULL"), "asset_id", "left_anti")


def without_orphans(assets: DataFrame, files: DataFrame, *dependent: DataFrame) -> tuple[DataFrame, ...]:
    """assets and the tables that depend on them (by asset_id), without what belongs to orphans."""
    kept = assets.join(files.select("asset_id").where("asset_id IS NOT NULL"), "asset_id", "left_semi")
    return kept, *[d.join(kept.select("asset_id"), "asset_id", "left_semi") for d in dependent]


def current_vectors(vectors: DataFrame, assets: DataFrame, pipeline: str) -> DataFrame:
    """Vectors of ready assets of the current pipeline."""
    return vectors.join(assets.where((F.col("pipeline") == pipeline) & (F.col("status") == "ready")).select("asset_id"), "asset_id", "left_semi")


def signature(vectors: DataFrame, pipeline: str) -> DataFrame:
    """What a cache of the vectors depends on."""
    return vectors.agg(F.count("*").alias("n"), F.coalesce(F.max("vid"), F.lit(0)).alias("last")).withColumn("pipeline", F.lit(pipeline))


def hydrated(hits: DataFrame, assets: DataFrame, files: DataFrame, vectors: DataFrame) -> DataFrame:
    """Hits of one page with their asset, present files by path, best match and text match.

    Only the assets and vectors of the page are looked up.  The text match is the text hit, or else the keyword hit, if it has a text.
    """
    from prismdex.functions.text import snippet

    wanted = hits.select("asset_id").distinct()
    own = files.where("present").join(F.broadcast(wanted), "asset_id", "left_semi")
    own = own.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("path", "name", "folder"))).alias("files"))
    best = F.when(F.col("best_signal") == "clip", F.col("clip.vid")).when(F.col("best_signal") == "text", F.col("text.vid")).otherwise(F.col("kw.vid"))
    hits = hits.withColumn("best_vid", best).withColumn("text_vid", F.coalesce("text.vid", "kw.vid"))
    look = vectors.join(F.broadcast(hits.select("asset_id", F.explode(F.array("best_vid", "text_vid")).alias("vid")).distinct()), ["asset_id", "vid"], "left_semi")
    match = look.select("asset_id", F.col("vid").alias("best_vid"), F.struct("kind", "ref", "thumb", snippet(F.col("text")).alias("snippet")).alias("match"))
    text = look.where(F.length("text") > 0).select("asset_id", F.col("vid").alias("text_vid"), F.struct("kind", "ref", snippet(F.col("text")).alias("snippet")).alias("text_match"))
    evidence = F.struct(*[F.round(f"{s}.raw", 3).alias(s) for s in ("clip", "text", "kw")]).alias("evidence")
    joined = hits.drop("type").join(assets, "asset_id", "left").join(own, "asset_id", "left").join(match, ["asset_id", "best_vid"], "left").join(text, ["asset_id", "text_vid"], "left")
    joined = joined.withColumn("match", F.when(F.col("match").isNotNull(), F.col("match").withField("thumb", F.coalesce("match.thumb", "thumb"))))
    return joined.select(
        "qid", "place", "asset_id", "type", "ext", "size", "width", "height", "duration", "pages", "mime", F.try_element_at("files", F.lit(1))["name"].alias("name"), F.round("relative", 4).alias("score"),
        F.round("confidence", 4).alias("confidence"), evidence, "match", "text_match", "thumb", "files", F.greatest(F.coalesce(F.size("files"), F.lit(0)) - 1, F.lit(0)).alias("duplicates"), "warnings", "meta", "indexed_ts",
    ).orderBy("qid", "place")

"""Analysis of media files as jobs: facts of the files, a plan as expressions, what the plan names, and tables from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from prismdex.functions import media, text as text_
from prismdex.functions.vectors import dot
from prismdex.operators import folds, ingest
from prismdex.settings import Settings
from prismdex.sources import decoders, scratch
from prismdex.sources.embedders import Embedder

#: Entries of a PDF's description that are kept, and those that make a text of their own (fixed values).
KEPT_META, HEAD_META = ("title", "author", "subject", "keywords", "creator", "producer", "creationDate"), ("title", "subject", "keywords")
HEAD_LEAST, TEXT_LEAST, BLANK = 5, 50, 2.0


@dataclass(frozen=True)
class Found:
    """outcome: one row a content (sha256, path, ok, error_kind, error, ...facts, notes); pictures (sha256, n, kind, ref, thumb, vector); texts (sha256, n, kind, ref, text, vector)."""

    outcome: DataFrame
    pictures: DataFrame
    texts: DataFrame


def planned(settings: Settings) -> Column:
    """What is to be fetched from a file, by its facts."""
    known = (F.col("fps") > 0) & (F.col("frames") > 0) & (F.col("frames") < 1_000_000_000)
    times = F.when(known, media.sample_times(F.col("frames") / F.col("fps"), settings.video_max_frames, settings.video_min_interval)).otherwise(F.array().cast("array<double>"))
    pages = media.page_picks(F.col("pages"), settings.pdf_max_render_pages).cast("array<double>")
    rate = F.when(F.col("fps") > 0, F.col("fps")).otherwise(25.0)
    read = F.least(F.col("pages"), F.lit(settings.pdf_max_text_pages))
    return F.struct(
        F.when(F.col("type") == "video", times).when(F.col("type") == "pdf", pages).alias("places"), F.greatest(F.lit(1), F.bround(settings.video_min_interval * rate)).cast("int").alias("every"),
        F.lit(settings.video_max_frames).alias("most"), F.when((F.col("type") == "pdf") & (read > 0), F.sequence(F.lit(0), read - 1)).alias("read"),
    )


def refused() -> tuple[Column, Column]:
    """(error kind, error) of a file that its facts rule out."""
    kind = F.when(F.col("error_kind").isNotNull(), F.col("error_kind")).when(F.col("locked"), "unsupported").when((F.col("type") == "pdf") & (F.coalesce("pages", F.lit(0)) == 0), "corrupt")
    return kind, F.when(F.col("error_kind").isNotNull(), F.col("error")).when(F.col("locked"), "the PDF asks for a password").when(kind == "corrupt", "a PDF without pages")


def kept_visuals(threshold: float) -> Column:
    """Of the pictures of a file: no blank frames of a video, unless all are, and none that is as similar as the threshold to the last one kept."""
    some = F.filter("visuals", lambda x: F.coalesce(x["deviation"], F.lit(255.0)) > BLANK)
    some = F.when((F.col("type") == "video") & (F.size(some) > 0), some).otherwise(F.col("visuals"))

    def add(kept: Column, x: Column) -> Column:
        return F.when((F.size(kept) == 0) | (dot(F.element_at(kept, -1)["vector"], x["vector"]) < threshold), F.concat(kept, F.array(x))).otherwise(kept)

    kept = F.aggregate(some, F.slice(some, 1, 0), add)
    return F.when(F.col("type") == "video", kept).otherwise(F.col("visuals"))


def analysed(work: DataFrame, settings: Settings, embedder: Embedder, openers: dict | None = None, pause: float = decoders.PAUSE) -> Found:
    """What is found in the files of ``work`` (sha256, path, ext, size, priority), one row a content.

    Files are dealt evenly, in each task pictures first and small files before large ones; a failure is the outcome of its file.
    """
    spark = work.sparkSession
    arrow = lambda ddl: to_arrow_schema(StructType.fromDDL(ddl))
    tasks = max(settings.workers, spark.sparkContext.defaultParallelism)
    files = work.where("size > 0").withColumn("type", media.media_type(F.col("ext"))).repartition(tasks, "sha256").sortWithinPartitions("priority", "size").select("sha256", "path", "ext", "size", "type")
    kind, error = refused()
    facts = files.mapInArrow(decoders.probe(openers, settings, arrow(decoders.PROBED)), decoders.PROBED).withColumns({"error_kind": kind, "error": error})
    facts = scratch.written(facts.withColumn("plan", planned(settings)), "facts")
    task = decoders.fetch(openers, embedder, settings, pause, arrow(decoders.FETCHED))
    got = facts.where("error_kind IS NULL").repartition(tasks, "sha256").mapInArrow(task, decoders.FETCHED)
    got = scratch.written(got.withColumn("visuals", kept_visuals(settings.video_dedupe_threshold)), "fetched")

    shown = got.where("error_kind IS NULL").select("sha256", "type", F.posexplode("visuals").alias("n", "x"))
    ref = F.when(F.col("type") == "video", F.round("x.place", 2)).when(F.col("type") == "pdf", F.col("x.place") + 1)
    pictures = shown.select("sha256", "n", F.when(F.col("type") == "video", "frame").when(F.col("type") == "pdf", "page").otherwise("image").alias("kind"), ref.alias("ref"), "x.thumb", "x.vector")

    meta = F.map_filter("meta", lambda k, v: k.isin(*KEPT_META))
    head = F.concat_ws(". ", *[F.element_at("meta", k) for k in HEAD_META])
    heads = facts.where("error_kind IS NULL AND type = 'pdf'").select("sha256", F.lit(-1).alias("n"), F.lit("meta").alias("kind"), F.lit(None).cast("double").alias("ref"), head.alias("text")).where(F.length("text") >= HEAD_LEAST)
    pages = got.select("sha256", F.explode("read").alias("p")).select("sha256", (F.col("p.page") + 1).alias("page"), F.posexplode(text_.chunks(F.col("p.text"))).alias("k", "text"))
    number = F.expr("row_number() OVER (PARTITION BY sha256 ORDER BY page, k)") - 1  # pages of one file, as many as the settings allow
    chunks = pages.select("sha256", number.alias("n"), F.lit("chunk").alias("kind"), F.col("page").cast("double").alias("ref"), "text").where(F.col("n") < settings.pdf_max_chunks)
    said = got.select("sha256", F.posexplode("said").alias("k", "x")).select("sha256", "k", F.col("x.start").alias("start"), F.col("x.text").alias("text"))
    said = folds.transcript_buffers(said, "sha256", "k", "start", "text").select("sha256", F.col("ordinal").alias("n"), F.lit("transcript").alias("kind"), "ref", "text")
    texts = heads.union(chunks).union(said).withColumn("x", embedder.text(F.col("text")))
    texts = scratch.written(texts.select("sha256", "n", "kind", "ref", "text", "x.vector", "x.error"), "texts")

    failed = texts.where("error IS NOT NULL").groupBy("sha256").agg(F.min("error").alias("text_error"))
    some = texts.groupBy("sha256").agg(F.count("*").alias("n_texts"))
    chars = F.aggregate("read", F.lit(0), lambda n, x: n + F.length(x["text"]))
    told = got.select("sha256", F.col("error_kind").alias("got_kind"), F.col("error").alias("got_error"), F.coalesce(F.size("visuals"), F.lit(0)).alias("n_pictures"), F.col("duration").alias("read_for"), "notes", chars.alias("chars"), F.exists("visuals", lambda x: x["deviation"] > BLANK).alias("any"))
    every = facts.join(told, "sha256", "left").join(some, "sha256", "left").join(failed, "sha256", "left")
    nothing = F.coalesce("n_pictures", F.lit(0)) + F.coalesce("n_texts", F.lit(0)) == 0
    kind = F.coalesce("error_kind", "got_kind", F.when(F.col("text_error").isNotNull(), "embedder"), F.when(nothing, "corrupt"))
    error = F.coalesce("error", "got_error", "text_error", F.when(nothing, "nothing can be searched in it"))
    note = lambda when, text: F.when(F.coalesce(when, F.lit(False)), F.array(text)).otherwise(F.array().cast("array<string>"))
    notes = F.concat(
        F.coalesce("notes", F.array().cast("array<string>")), note((F.col("type") == "video") & ~F.col("any"), F.lit("frames: all are blank")), note((F.col("type") == "pdf") & (F.col("chars") < TEXT_LEAST), F.lit("text: next to none, only pages are searched")),
        note(F.col("pages") > settings.pdf_max_text_pages, F.format_string("text: of the first %d of %d pages", F.lit(settings.pdf_max_text_pages), "pages")),
    )
    length = F.when((F.col("fps") > 0) & (F.col("frames") > 0) & (F.col("frames") < 1_000_000_000), F.col("frames") / F.col("fps"))
    video = F.create_map(F.lit("fps"), F.regexp_replace(F.col("fps").cast("string"), r"\.0$", ""), F.lit("codec"), F.coalesce("codec", F.lit("")), F.lit("frames_sampled"), F.coalesce("n_pictures", F.lit(0)).cast("string"))
    outcome = every.select(
        "sha256", "path", "ext", "size", kind.isNull().alias("ok"), kind.alias("error_kind"), error.alias("error"), "type", "width", "height", F.when(F.col("type") == "video", F.round(F.coalesce("read_for", length), 2)).alias("duration"), "pages",
        F.when(F.col("type") == "video", video).when(F.col("type") == "pdf", meta).otherwise(F.col("meta")).alias("meta"), notes.alias("warnings"),
    )
    empty = work.where("coalesce(size, 0) <= 0").select("sha256", "path", "ext", "size", F.lit(False).alias("ok"), F.lit("empty").alias("error_kind"), F.lit("").alias("error"))
    outcome = scratch.written(outcome.unionByName(empty, allowMissingColumns=True), "outcome")
    good = outcome.where("ok").select("sha256")
    return Found(outcome, pictures.join(good, "sha256", "left_semi"), texts.drop("error").join(good, "sha256", "left_semi"))


def tables(found: Found, pipeline: str, now: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New rows of assets, vectors and thumbs."""
    good = found.outcome.where("ok OR error_kind = 'embedder'")
    place = lambda n: F.concat(F.substring("sha256", 1, 2), F.lit("/"), F.col("sha256"), F.lit("_"), n.cast("string"), F.lit(".jpg"))
    first = found.pictures.where("n = 0 AND thumb IS NOT NULL").select("sha256", place(F.col("n")).alias("thumb"))
    assets = good.join(first, "sha256", "left").select(
        F.col("sha256").alias("asset_id"), "sha256", "type", "ext", media.mime_type(F.col("ext")).alias("mime"), "size", "width", "height", "duration", "pages", "meta", F.when(F.col("ok"), "ready").otherwise("failed").alias("status"),
        F.when(~F.col("ok"), ingest.error_state(F.col("error_kind"), F.col("error"))["error"]).alias("error"), "warnings", "thumb", F.lit(pipeline).alias("pipeline"), F.lit(now).alias("created_ts"), F.lit(now).alias("indexed_ts"),
    )
    vid = lambda space: F.format_string(f"%s:{space}:%s:%06d", "sha256", F.substring("kind", 1, 1), F.col("n") + 1)
    shown = F.when(F.col("thumb").isNotNull(), place(F.col("n")))
    none = F.lit(None).cast("string")
    visual = found.pictures.select(vid("clip").alias("vid"), F.col("sha256").alias("asset_id"), F.lit("clip").alias("space"), "kind", "ref", none.alias("text"), shown.alias("thumb"), "vector")
    texts = found.texts.select(vid("text").alias("vid"), F.col("sha256").alias("asset_id"), F.lit("text").alias("space"), "kind", "ref", "text", none.alias("thumb"), "vector")
    thumbs = found.pictures.where("thumb IS NOT NULL").select(place(F.col("n")).alias("path"), F.col("sha256").alias("asset_id"), F.col("thumb").alias("jpeg"))
    return assets, visual.unionByName(texts), thumbs

"""The catalogue's tables as views of the sample tables, for the registered queries.

A document is a file, its distinct texts are the assets, their chunks are the text vectors and postings, embeddings are picture vectors, and benchmark
passages are the search queries.  States and flags follow from ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismdex.functions import text as text_
from prismdex.functions.media import media_type
from prismdex.functions.vectors import word_buckets

PIPELINE = "p2"
ENDINGS = (".jpg", ".png", ".mp4", ".pdf", ".txt")
PER_ASSET = 1000  # vid = asset_id * PER_ASSET + chunk; a text of more chunks goes on into the next numbers, so a chunk is known by vid and asset_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With asset_id: the least doc_id of its text, by a grouped minimum over hashes."""
    docs = table(spark, sf_dir, "documents").withColumn("sha256", F.sha2("text", 256))
    least = docs.groupBy("sha256").agg(F.min("doc_id").alias("asset_id"))
    return docs.join(least, "sha256")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (F.col("doc_id") % 5 + 1).cast("int"))
    docs = documents(spark, sf_dir).withColumn("ext", ext)
    folder = F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("lang"))
    name = F.concat(F.col("doc_id").cast("string"), F.col("ext"))
    state = F.when(F.col("doc_id") % 11 == 0, "failed").when(F.col("doc_id") % 11 == 1, "pending").when(F.col("doc_id") % 11 == 2, "unsupported").when(F.col("doc_id") % 11 == 3, "processing").otherwise("done")
    return docs.select(
        F.concat(folder, F.lit("/"), name).alias("path"), folder.alias("folder"), name.alias("name"), "ext", F.col("n_chars").alias("size"), (F.col("doc_id") * 1_000_000_007).alias("mtime_ns"), "asset_id", state.alias("state"),
        F.when(state == "failed", "old error").alias("error"), F.when(state == "failed", 2).otherwise(1).alias("attempts"), (F.col("doc_id") % 13 != 0).alias("present"), "sha256", "doc_id",
    )


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).where("doc_id = asset_id")
    kind = F.when(F.col("lang") == "en", "pdf").when(F.col("lang") == "de", "video").otherwise("image")
    ext = F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (F.col("doc_id") % 5 + 1).cast("int"))
    return docs.select(
        "asset_id", "sha256", kind.alias("type"), ext.alias("ext"), F.col("n_chars").alias("size"), F.when(F.col("asset_id") % 17 == 0, "failed").otherwise("ready").alias("status"),
        F.when(F.col("asset_id") % 19 == 0, "p1").otherwise(PIPELINE).alias("pipeline"), (F.col("asset_id") * 3600.0 + 1_700_000_000).alias("indexed_ts"),
    )


def chunks(spark: SparkSession, sf_dir: str, marked: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """(vid, asset_id, text) of the chunks of every asset, or of those of ``only`` (asset_id); with ``marked`` (asset_id) also whether the asset is among them.

    Assets are told apart before their texts are cut, so that chunks are not shuffled for it.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    first = docs.groupBy(F.sha2("text", 256)).agg(F.min("doc_id").alias("asset_id")).select("asset_id")
    first = first if only is None else first.join(only.select("asset_id").distinct(), "asset_id", "left_semi")
    if marked is not None:
        mark = marked.select("asset_id", F.lit(True).alias("marked")).distinct()
        first = first.join(mark, "asset_id", "left").select("asset_id", F.coalesce("marked", F.lit(False)).alias("marked"))
    first = first.hint("merge")  # it grows with the corpus: never broadcast
    own = text_.exploded_chunks(docs.join(first, docs.doc_id == first.asset_id), *first.columns)
    return own.select((F.col("asset_id") * PER_ASSET + F.col("n")).alias("vid"), *first.columns, "text")


def bucketed(rows: DataFrame, *key: str) -> DataFrame:
    """(key..., vector): the buckets of the words of ``text``."""
    return rows.select(*key, word_buckets(F.col("text")).alias("vector"))


def worded(rows: DataFrame) -> DataFrame:
    """(vid, asset_id, words): unstemmed tokens of ``text``, with spaces between them; other columns stay."""
    return rows.select(*[c for c in rows.columns if c != "text"], text_.spaced_tokens(F.col("text")).alias("words"))


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vid, asset_id, vector): embeddings of the asset whose document has their number."""
    own = documents(spark, sf_dir).select("doc_id", "asset_id")
    rows = table(spark, sf_dir, "embeddings")
    return rows.join(own, rows.vec_id == own.doc_id).select(F.col("vec_id").alias("vid"), "asset_id", F.col("embedding").alias("vector"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vid, asset_id, vector): every embedding, its label taken as the asset."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vid"), F.col("label").alias("asset_id"), F.col("embedding").alias("vector"))


def picture_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, text, vector): benchmark passages, each with the embedding of its number."""
    items, rows = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    return items.join(rows, items.item_id == rows.vec_id).select(F.col("item_id").alias("qid"), "text", F.col("embedding").alias("vector"))


def weighted_buckets(rows: DataFrame, key: list[str]) -> DataFrame:
    """Non-zero parts (key..., bucket, weight) of the unit vectors of hashed words."""
    counts = rows.select(*key, F.explode(word_buckets(F.col("text"))).alias("bucket")).groupBy(*key, "bucket").agg(F.count("*").alias("n"))
    total = F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(*key))
    return counts.select(*key, "bucket", (F.col("n") / F.sqrt(total)).alias("weight"))


def postings(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) of unstemmed tokens of (vid, asset_id, text); a posting has the length of its text too.  Words are counted within their row."""
    words = rows.select("vid", "asset_id", text_.tokens(F.col("text")).alias("w"))
    counted = F.transform(F.array_distinct("w"), lambda t: F.struct(t.alias("term"), (F.size("w") - F.size(F.array_remove("w", t))).cast("long").alias("tf")))
    posted = words.select("vid", "asset_id", F.size("w").alias("len"), F.explode(counted).alias("p")).select("vid", "asset_id", "p.term", "p.tf", "len")
    return posted, words.select("vid", "asset_id", F.size("w").alias("len"))


def terms(rows: DataFrame) -> DataFrame:
    return rows.select("qid", F.explode(text_.query_terms(F.col("text"))).alias("term"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later listing: every seventh file is gone, every fifth changed, and every third has a new neighbour."""
    own = files(spark, sf_dir)
    kept = own.where("doc_id % 7 <> 0").withColumn("size", F.when(F.col("doc_id") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")))
    new = own.where("doc_id % 3 = 0").withColumn("path", F.concat("folder", F.lit("/new-"), "name")).withColumn("name", F.concat(F.lit("new-"), "name"))
    return kept.unionByName(new).select("path", "folder", "name", "ext", "size", "mtime_ns")


def is_media(ext: str = "ext"):
    return media_type(F.col(ext)).isNotNull()

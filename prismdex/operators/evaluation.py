"""Retrieval quality, score calibration and dataset summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismdex.functions.media import media_type, top_folders

SUMMARY_SKIPS = ("manifest.json", "ATTRIBUTION.csv")


def weak_labels(queries: DataFrame, indexed: DataFrame) -> DataFrame:
    """(qid, path): files of an expected type whose metadata text matches the query's pattern, without regard to case.

    queries (qid, expect_types, pattern), indexed (path, type, text); patterns are met by expected type, not by every pair.
    """
    by_type = queries.select("qid", "pattern", F.explode("expect_types").alias("type"))
    return indexed.join(by_type, "type").where(F.regexp_like(F.coalesce("text", F.lit("")), F.concat(F.lit("(?i)"), F.col("pattern")))).select("qid", "path").distinct()


def metrics(results: DataFrame, relevant: DataFrame, queries: DataFrame, k: int = 10, count_assets: bool = False) -> DataFrame:
    """One row a query: hits_at_5, p_at_5, p_at_k, recall, first_rank, mrr, negative.

    results (qid, place from 0, asset_id, path; one row for each present file of a result), relevant (qid, path), queries (qid, negative).  A result is a hit if any of its
    paths is relevant.  Precision divides by 5 and k even if fewer came.  Recall divides by relevant paths (or, with ``count_assets``, relevant
    assets among the results' paths); null if there are none.
    """
    marked = results.where(F.col("place") < k).join(relevant.withColumn("__hit", F.lit(1)), ["qid", "path"], "left")
    hits = marked.groupBy("qid", "place", "asset_id").agg(F.coalesce(F.max("__hit"), F.lit(0)).alias("hit"))
    wanted = relevant if not count_assets else results.join(relevant, ["qid", "path"], "left_semi").select("qid", F.col("asset_id").alias("path"))
    n = wanted.groupBy("qid").agg(F.countDistinct("path").alias("n"))
    by = hits.groupBy("qid").agg(F.sum(F.when(F.col("place") < 5, F.col("hit")).otherwise(0)).alias("h5"), F.sum("hit").alias("hk"), F.min(F.when(F.col("hit") == 1, F.col("place") + 1)).alias("first_rank"))
    out = queries.select("qid", "negative").join(by, "qid", "left").join(n, "qid", "left").fillna(0, ["h5", "hk"])
    return out.select("qid", "negative", (F.col("h5") / 5).alias("p_at_5"), (F.col("hk") / k).alias("p_at_k"), (F.col("hk") / F.col("n")).alias("recall"), "first_rank", F.coalesce(1 / F.col("first_rank"), F.lit(0.0)).alias("mrr"))


def mean_metrics(each: DataFrame) -> DataFrame:
    """Means over the queries that are no negative controls; recall where there is one."""
    return each.where("NOT negative").agg(*[F.avg(c).alias(c) for c in ("p_at_5", "p_at_k", "recall", "mrr")])


def calibration(tops: DataFrame) -> DataFrame:
    """(signal, floor, highest_negative, n_positive, weak): a floor just above the best score of queries that should find nothing.

    tops (qid, signal, top, negative).  weak: positives below the floor, to three decimals, sorted; signals without both kinds are left out.
    """
    own = tops.groupBy("signal").agg(F.max(F.when(F.col("negative"), F.col("top"))).alias("highest_negative"), F.count_if(~F.col("negative")).alias("n_positive"))
    own = own.where("highest_negative IS NOT NULL AND n_positive > 0").withColumn("floor", F.col("highest_negative") + 0.01)
    below = tops.where("NOT negative").join(own, "signal").where("top < floor").groupBy("signal").agg(F.array_sort(F.collect_list(F.round("top", 3))).alias("weak"))
    return own.join(below, "signal", "left").select("signal", "floor", "highest_negative", "n_positive", F.coalesce("weak", F.array().cast("array<double>")).alias("weak"))


def dataset_summary(listing: DataFrame) -> DataFrame:
    """(section, name, files, bytes): by type, by the first two folders, and in total.

    listing (folder relative to its root, name, ext, size); hidden names and the dataset's own two files don't count, hidden folders do.
    """
    own = listing.where(~F.startswith("name", F.lit(".")) & ~F.col("name").isin(*SUMMARY_SKIPS))
    own = own.select(F.coalesce(media_type(F.col("ext")), F.lit("unsupported/other")).alias("type"), top_folders(F.col("folder")).alias("top"), "size")
    sets = own.select(F.explode(F.array(*[F.struct(F.lit(k).alias("section"), v.alias("name")) for k, v in (("type", F.col("type")), ("folder", F.col("top")), ("total", F.lit("total")))])).alias("s"), "size")
    return sets.groupBy("s.section", "s.name").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def numbered_cases(cases: DataFrame) -> DataFrame:
    """Report cases (section_no, position, query, ...) with a running ``case_no``; placeholders keep their number and are marked."""
    sizes = cases.groupBy(F.col("section_no").alias("__section")).agg(F.count("*").alias("n"))  # one row a section
    before = sizes.select("__section", F.coalesce(F.sum("n").over(Window.orderBy("__section").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("section_no").orderBy("position"))
    rows = cases.join(before, cases["section_no"].eqNullSafe(before["__section"])).withColumn("case_no", (F.col("__before") + own).cast("int"))
    return rows.drop("__section", "__before").withColumn("placeholder", F.startswith("query", F.lit("<<<")))

"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Targets: sources share the words of the whole corpus by weight; none gets more than ``most`` times its own words, and what
it leaves goes to the others by weight (water filling over the table of sources).  A target is made of complete epochs of
its source first; the rest is a weighted sample without replacement: each document draws the exponential key
-ln(u) / quality, documents are taken in key order, and prefix sums of words stop at the budget.

The prefix sums never sort a whole source in one task: keys fall into buckets of about ``BUCKET`` documents, sums by
bucket (combined before the shuffle) find the bucket in which the budget ends, and only that one is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismdex.llm.tables import boxed, table, unboxed, written

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating.
CYCLE = (1, 2, 3)
MOST = 3
BUCKET = 4096
#: Quality label to sampling weight; documents without a label weigh 1.
GOOD, BAD = 2.0, 0.5
WEIGHTS = (GOOD, 1.0, BAD)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _keyed(rows: DataFrame, labels: DataFrame | None, seed: int) -> DataFrame:
    """``rows`` (doc_id, text, source and maybe row) with size, weight and key instead of the text: the exponential key is smaller for better documents, equal only for equal ids and texts."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), 11) + 0.5) / float(1 << 53)
    rows = rows.withColumns({"size": n_words(F.col("text")), "draw": -F.log(u)}).drop("text")
    if labels is None:
        return rows.withColumns({"weight": F.lit(1.0), "key": F.col("draw")}).drop("draw")
    quality = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("known")).agg(F.max("quality").alias("quality"))
    quality = quality.hint("merge")  # labels grow with the corpus: never broadcast
    weight = F.when(F.col("quality") > 0, GOOD).when(F.col("quality") <= 0, BAD).otherwise(1.0)
    joined = rows.join(quality, rows["doc_id"] == quality["known"], "left").withColumn("weight", weight)
    return joined.withColumn("key", F.col("draw") / F.col("weight")).drop("known", "quality", "draw")


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE, most: int = MOST) -> DataFrame:
    """(source, source_size, n, target) from (source, source_size, n), one row per source."""
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.select("source", "source_size", "n", F.element_at(weights, ((F.col("rank") - 1) % len(cycle) + 1).cast("int")).alias("w"))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # If all with a smaller cap for their weight are at their caps, the others share the remainder at this level.
    level = (F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("w").over(after)
    ranked = ranked.withColumn("level", level)
    shared = F.max("level").over(everything)  # it rises up to the first source below its cap and falls after it
    return ranked.select("source", "source_size", "n", F.least(shared * F.col("w"), (most * F.col("source_size")).cast("double")).alias("target"))


def _plan(rows: DataFrame, cycle: tuple[int, ...], most: int) -> DataFrame:
    """(of, source_size, target, epochs, shares, buckets, bucket, cut) by source ``of``, from (source, size, weight, key)."""
    counts = [F.count_if(F.col("weight") == w).alias(f"n{k}") for k, w in enumerate(WEIGHTS)]
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"), *counts)
    sizes = written(sizes.select("source", "source_size", "n", F.array(*[F.col(f"n{k}") / F.col("n") for k in range(len(WEIGHTS))]).alias("shares")), "sources")
    targets = source_targets(sizes.drop("shares"), cycle, most).join(sizes.select(F.col("source").alias("s"), "shares"), F.col("source").eqNullSafe(F.col("s")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.select(F.col("source").alias("of"), "source_size", "target", epochs.alias("epochs"), (F.col("target") - epochs * F.col("source_size")).alias("rest"), "shares", F.ceil(F.col("n") / BUCKET).alias("buckets"))
    plan = written(plan, "targets")
    placed = rows.join(plan, rows["source"].eqNullSafe(plan["of"])).withColumn("at", bucket())
    sums = placed.groupBy("of", "rest", "at").agg(F.sum("size").alias("s"))
    upto = F.sum("s").over(Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = sums.withColumn("upto", upto).where("upto > rest").groupBy("of").agg(F.min_by(F.struct("at", (F.col("upto") - F.col("s")).alias("before")), "at").alias("e"))
    ends = written(ends.select(F.col("of").alias("s"), F.col("e.at").alias("bucket"), F.col("e.before").alias("before")), "ends")
    last = placed.join(ends, placed["of"].eqNullSafe(ends["s"]) & (placed["at"] == ends["bucket"]))
    last = last.groupBy(ends["s"].alias("c"), "rest", "before", "key").agg(F.sum("size").alias("words"))
    prior = F.coalesce(F.sum("words").over(Window.partitionBy("c").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("before")
    cut = last.withColumn("prior", prior).where(F.col("prior") + F.col("words") / 2 <= F.col("rest")).groupBy("c").agg(F.max("key").alias("cut"))
    plan = plan.join(ends, plan["of"].eqNullSafe(ends["s"]), "left")
    return written(plan.join(cut, plan["of"].eqNullSafe(cut["c"]), "left").select("of", "source_size", "target", "epochs", "shares", "buckets", "bucket", "cut"), "plan")


def bucket() -> Column:
    """Buckets in key order, even in the mean: the distribution of the keys follows from the shares of the weights in the source."""
    below = [F.get("shares", F.lit(k)) * (1 - F.exp(-w * F.col("key"))) for k, w in enumerate(WEIGHTS)]
    return F.floor(sum(below[1:], below[0]) * F.col("buckets")).cast("long")


def _with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    sampled = (F.col("bucket").isNull() & (F.col("epochs") == 0)) | (F.col("at") < F.col("bucket")) | ((F.col("at") == F.col("bucket")) & (F.col("key") <= F.col("cut")))
    sampled = F.coalesce(sampled, F.lit(False)) & (F.col("target") > F.col("epochs") * F.col("source_size"))
    joined = rows.join(plan, rows["source"].eqNullSafe(plan["of"])).withColumn("at", bucket())
    return joined.withColumn("copies", F.col("epochs") + F.when(sampled, 1).otherwise(0))


def mix(docs: DataFrame, labels: DataFrame | None = None, seed: int = 7, cycle: tuple[int, ...] = CYCLE, most: int = MOST) -> DataFrame:
    """One row (doc_id, source, size, source_size, target, copies) per row of ``docs`` (doc_id, text, source).

    size: words of the text (null: 0).  copies: how often the mix takes the document: the complete epochs of its source and
    1 more if sampled, ``most`` at most.  Within its source the sample stops where its words are nearest to the budget.  Equal rows (same id and text) share one
    key and go together, so taken words miss the target by half of one document and its equal rows at most.  Null sources are one source, after all others; a source without words has target 0; labels may repeat (the best
    counts) or be None (all weigh 1); other columns are ignored; an empty table gives an empty one.
    """
    rows = written(_keyed(docs.select("doc_id", "source", "text"), labels, seed), "keys")
    return _with_copies(rows, _plan(rows, cycle, most)).select("doc_id", "source", "size", "source_size", "target", "copies")


def mixed(docs: DataFrame, labels: DataFrame | None = None, seed: int = 7, cycle: tuple[int, ...] = CYCLE, most: int = MOST) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their columns, whatever the names of these."""
    rows = _keyed(boxed(docs, doc_id=F.col("doc_id"), source=F.col("source"), text=F.col("text")), labels, seed)
    plan = _plan(written(rows.select("source", "size", "weight", "key"), "keys"), cycle, most)
    taken = _with_copies(rows, plan).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return unboxed(taken)


def op6_mixing(spark, sf_dir) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))

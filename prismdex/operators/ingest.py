"""Incremental ingest as pure functions from one catalogue snapshot to the next.

files: path, folder, name, ext, size, mtime_ns, asset_id, state, error, attempts, present.  listing: path, folder, name, ext, size, mtime_ns.  States: pending,
processing, done, failed, unsupported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismdex.functions.media import media_type

FILE_COLUMNS = ["path", "folder", "name", "ext", "size", "mtime_ns", "asset_id", "state", "error", "attempts", "present"]


def unsupported_reason(ext: Column) -> Column:
    return F.concat(F.lit("unsupported file type '"), F.when(F.coalesce(ext, F.lit("")) == "", "(none)").otherwise(ext), F.lit("'"))


def recovered(files: DataFrame) -> DataFrame:
    """Files that a broken run left in work are pending again."""
    return files.withColumn("state", F.when(F.col("state") == "processing", "pending").otherwise(F.col("state")))


def requeue_stale(files: DataFrame, assets: DataFrame, pipeline: str) -> DataFrame:
    """Present files done by another pipeline are pending again."""
    stale = assets.where(F.col("pipeline") != pipeline).select("asset_id", F.lit(True).alias("__stale"))
    joined = files.join(stale, "asset_id", "left")
    again = F.col("__stale") & F.col("present") & (F.col("state") == "done")
    again = F.coalesce(again, F.lit(False))
    return joined.withColumns({"state": F.when(again, "pending").otherwise(F.col("state")), "attempts": F.when(again, 0).otherwise(F.col("attempts"))}).select(*files.columns)


def classified(files: DataFrame, listing: DataFrame, retry_failed: bool = False, force: bool = False) -> DataFrame:
    """Next files with ``change``: new, changed, redone, unsupported, unchanged or unseen, by one full outer join on path.

    A listed file without a row is new: pending, or unsupported with a reason.  A supported one is queued again if forced, if size or mtime differ, if it
    never got done, or if it failed and failures are retried; its error and attempts are cleared.  An unsupported ending sets the state.  Anything
    else is unchanged and present.  Rows that are not listed are unseen and stay as they are.
    """
    seen = listing.select("path", F.struct("folder", "name", "ext", "size", "mtime_ns").alias("l"))
    had = files.select("path", F.struct(*[c for c in FILE_COLUMNS if c != "path"]).alias("f"))
    both = had.join(seen, "path", "full")
    known, listed = F.col("f").isNotNull(), F.col("l").isNotNull()
    supported = media_type(F.col("l.ext")).isNotNull()
    same = F.col("f.size").eqNullSafe(F.col("l.size")) & F.col("f.mtime_ns").eqNullSafe(F.col("l.mtime_ns"))
    undone = F.col("f.state").isin("pending", "processing", "unsupported") | ((F.col("f.state") == "failed") & F.lit(retry_failed))
    redo = supported & (F.lit(force) | ~same | F.coalesce(undone, F.lit(False)))
    change = (
        F.when(~listed, "unseen").when(~known, F.when(supported, "new").otherwise("new_unsupported")).when(redo, F.when(same, "redone").otherwise("changed"))
        .when(~supported, "unsupported").otherwise("unchanged")
    )
    both = both.withColumn("change", change)
    queued, refused = F.col("change").isin("new", "changed", "redone"), F.col("change").isin("new_unsupported", "unsupported")
    fresh = queued | refused
    return both.select(
        "path", *[F.coalesce(f"f.{c}", f"l.{c}").alias(c) for c in ("folder", "name", "ext")], *[F.when(fresh, F.col(f"l.{c}")).otherwise(F.col(f"f.{c}")).alias(c) for c in ("size", "mtime_ns")], F.col("f.asset_id").alias("asset_id"),
        F.when(queued, "pending").when(refused, "unsupported").otherwise(F.col("f.state")).alias("state"),
        F.when(queued, F.lit(None)).when(refused, unsupported_reason(F.col("l.ext"))).otherwise(F.col("f.error")).alias("error"),
        F.when(queued, 0).otherwise(F.coalesce("f.attempts", F.lit(0))).alias("attempts"), F.when(listed, True).otherwise(F.col("f.present")).alias("present"), "change",
    )


def mark_missing(files: DataFrame) -> DataFrame:
    """Classified files, the unseen ones no longer present; nothing is marked if nothing at all was seen (a folder that isn't mounted)."""
    if files.where("change <> 'unseen'").limit(1).count() == 0:
        return files
    return files.withColumn("present", F.when(F.col("change") == "unseen", False).otherwise(F.col("present")))


def counters() -> list[Column]:
    """Counts over classified files, for an aggregation or an observation."""
    n = lambda *kinds: F.count_if(F.col("change").isin(*kinds))
    return [
        n("new", "new_unsupported", "changed", "redone", "unsupported", "unchanged").alias("scanned"), n("new", "new_unsupported").alias("new"), n("changed").alias("changed"),
        n("unchanged").alias("unchanged"), n("new", "changed", "redone").alias("queued"), n("unsupported", "new_unsupported").alias("unsupported"),
    ]


def outcome_counters() -> list[Column]:
    """Counts over the outcome of queued files (new_state, was_reused)."""
    is_ = lambda state: F.col("new_state") == state
    return [
        F.count("*").alias("processed"), F.count_if("was_reused").alias("reused"), F.count_if(is_("done") & ~F.col("was_reused")).alias("indexed"), F.count_if(is_("failed")).alias("failed"), F.count_if(is_("unsupported")).alias("refused"),
    ]


def run_counters(files: DataFrame) -> DataFrame:
    """One row of counts over classified files."""
    return files.agg(*counters())


def priority(ext: Column) -> Column:
    """Images first, then PDFs, then videos."""
    kind = media_type(ext)
    return F.when(kind == "image", 0).when(kind == "pdf", 1).when(kind == "video", 2).otherwise(3)


def split_reuse(pending: DataFrame, assets: DataFrame, pipeline: str) -> tuple[DataFrame, DataFrame]:
    """(reused, work): hashed pending files (with sha256) whose content is a ready asset of this pipeline, and one file for each other content.

    Copies within ``work`` share the analysis of the first path; it is found by a grouped minimum, so copies of one content never meet in a task.
    """
    ready = assets.where((F.col("pipeline") == pipeline) & (F.col("status") == "ready")).select("sha256", F.col("asset_id").alias("reused_asset"))
    joined = pending.join(ready, "sha256", "left")
    work = joined.where("reused_asset IS NULL").groupBy("sha256").agg(F.min(F.struct("path", "ext", "size")).alias("x"), F.count("*").alias("copies"))
    work = work.select("sha256", "x.path", "x.ext", "x.size", "copies").withColumn("priority", priority(F.col("ext")))
    return joined.where("reused_asset IS NOT NULL"), work


def error_state(kind: Column, message: Column) -> Column:
    """(state, error) of a failed analysis by the kind of its error."""
    error = (
        F.when(kind == "unsupported", message).when(kind == "empty", F.lit("corrupt or unreadable: empty file (0 bytes)")).when(kind == "corrupt", F.concat(F.lit("corrupt or unreadable: "), message))
        .when(kind == "embedder", F.concat(F.lit("AI processing failed: "), message)).otherwise(F.concat(F.lit("unexpected error: "), message))
    )
    return F.struct(F.when(kind == "unsupported", "unsupported").otherwise("failed").alias("state"), error.alias("error"))


def updated_assets(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows, with the asset_id and created_ts of the old row of their content if there is one."""
    before = old.select("sha256", F.col("asset_id").alias("id"), F.col("created_ts").alias("created"))
    both = new.alias("n").join(before.alias("b"), F.col("n.sha256") == F.col("b.sha256"), "left")
    own = {"asset_id": F.coalesce("b.id", "n.asset_id"), "created_ts": F.coalesce("b.created", "n.created_ts")}
    return both.select(*[own.get(c, F.col(f"n.{c}")).alias(c) for c in old.columns])


def merged_assets(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by content hash: new rows replace old ones but keep their asset_id and created_ts."""
    return old.join(new.select("sha256"), "sha256", "left_anti").select(*old.columns).unionByName(updated_assets(old, new))


def replaced_children(old: DataFrame, new: DataFrame, assets: DataFrame) -> DataFrame:
    """Rows of a dependent table: those of re-analysed assets are replaced."""
    return old.join(assets.select("asset_id"), "asset_id", "left_anti").unionByName(new.select(*old.columns))

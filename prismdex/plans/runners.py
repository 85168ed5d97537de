"""Evaluation, calibration and report of an index: JSON files in, Markdown and figures out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismdex.operators import evaluation
from prismdex.operators.retrieval import Filters
from prismdex.plans.engine import Engine
from prismdex.sources import documents

#: Queries that should find nothing: fixed values.
NEGATIVES = ("spaceship on Mars", "underwater volcano erupting at night", "a purple elephant playing the violin", "medieval knights jousting")
_SHOWN = "n int, name string, type string, confidence double, size bigint, duration double, pages int, duplicates int, match struct<kind:string,ref:double>, said struct<ref:double,snippet:string>"
_RESULTS = "qid string, place int, asset_id string, path string"


def evaluate(engine: Engine, queries: str, manifest: str, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(one row a query, means): precision, recall and rank of the searches, by weak labels from the manifest's texts, which the index has not seen."""
    spark, root = engine.spark, engine.settings.media_dir.rstrip("/")
    asked = documents.evaluation_queries(spark, queries).withColumnRenamed("id", "qid").persist()
    texts = documents.metadata_text(documents.manifest(spark, manifest)).select(F.concat(F.lit(f"{root}/"), "path").alias("path"), F.lower("text").alias("text"))
    ready = engine.store.read("assets").where("status = 'ready'").select("asset_id", "type")
    indexed = engine.store.read("files").where("present").join(ready, "asset_id").select("path", "type").join(texts, "path", "left")
    relevant = evaluation.weak_labels(asked.select("qid", F.col("relevant_regex").alias("pattern"), "expect_types"), indexed)
    rows = [(q.qid, n, r["asset_id"], f["path"]) for q in asked.collect() for n, r in enumerate(engine.search(q.query, limit=k)["results"]) for f in r["files"]]
    each = evaluation.metrics(spark.createDataFrame(rows, _RESULTS), relevant, asked.select("qid", (F.size("expect_types") == 0).alias("negative")), k)
    return each.join(asked.select("qid", "query"), "qid"), evaluation.mean_metrics(each)


def calibrate(engine: Engine, queries: str, negatives: tuple[str, ...] = NEGATIVES) -> DataFrame:
    """(signal, floor, highest_negative, n_positive, weak) from the highest similarities of all queries, found in one pass."""
    positive = [r.query for r in documents.evaluation_queries(engine.spark, queries).where(F.size("expect_types") > 0).collect()]
    tops = engine.raw_tops([*positive, *negatives])
    return evaluation.calibration(tops.select("qid", "signal", "top", (F.col("qid") >= len(positive)).alias("negative")))


def report(engine: Engine, cases: str, limit: int = 10) -> str:
    """The cases of a report file as Markdown: a heading for each section, a numbered case for each query and its results as a list."""
    rows = evaluation.numbered_cases(documents.report_cases(engine.spark, cases)).orderBy("case_no").collect()
    lines, section = [], None
    for r in rows:
        if r.section != section:
            lines, section = [*lines, f"## {r.section}", ""], r.section
        lines.append(f"### {r.case_no}. {r.query}")
        if not r.placeholder:
            found = engine.search(r.query, Filters(types=tuple(r.types) if r.types else None), limit)["results"]
            own = []
            for n, x in enumerate(found):
                match, text = x["match"] or {}, x["text_match"] or {}
                said = text if text.get("snippet") else match
                own.append((n + 1, *[x[c] for c in ("name", "type", "confidence", "size", "duration", "pages", "duplicates")], {"kind": match.get("kind"), "ref": match.get("ref")}, {"ref": said.get("ref"), "snippet": said.get("snippet")}))
            shown = engine.spark.createDataFrame(own, _SHOWN).select("n", documents.report_line(F.col("n")).alias("line"))
            lines += ["", *[x.line for x in shown.orderBy("n").collect()]] if own else ["", "No results."]
        lines.append("")
    return "\n".join(lines)

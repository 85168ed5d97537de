"""Sources and sinks of small documents: JSON configurations, CSV attributions and Markdown reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismdex.functions.text import display_size, minutes
from prismdex.schemas import EVAL_QUERIES, MANIFEST_ENTRY
from prismdex.sources import committed

CASES = "map<string,array<string>>"
#: Characters of a text that a line of a report shows (fixed value).
SHOWN = 160


def evaluation_queries(spark: SparkSession, path: str) -> DataFrame:
    """id, query, intent, expect_types, relevant_regex, expected_hint from an array of objects."""
    return spark.read.schema(EVAL_QUERIES).json(path, multiLine=True)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, kind, ..., categories, description) from an object by path."""
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", f"map<string,{MANIFEST_ENTRY}>")).alias("path", "entry"))
    return entries.select("path", "entry.*")


def metadata_text(entries: DataFrame) -> DataFrame:
    return entries.select("path", F.concat_ws(" ", "title", F.array_join("categories", " "), "description").alias("text"))


def report_cases(spark: SparkSession, path: str) -> DataFrame:
    """(section_no, section, position, query, types) from an object of arrays whose items are strings or objects."""
    text = spark.read.text(path, wholetext=True)
    names = F.json_object_keys("value")
    section = text.select("value", F.posexplode(names).alias("section_no", "section"))
    items = F.from_json("value", CASES)[F.col("section")]  # an object in an array is kept as its JSON text
    rows = section.select("section_no", "section", F.posexplode(items).alias("position", "item"))
    as_object = F.from_json("item", "query string, types array<string>")
    is_object = F.startswith(F.ltrim("item"), F.lit("{"))
    return rows.select("section_no", "section", "position", F.when(is_object, as_object["query"]).otherwise(F.col("item")).alias("query"), F.when(is_object, as_object["types"]).alias("types"))


def append_attributions(rows: DataFrame, path: str, batch: str | None = None) -> None:
    """Rows that come all or not at all, and once under one name of a batch."""
    committed.write(rows.select("file", "title", "author", "license", "source_url"), path, "csv", batch)


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def report_line(number: Column) -> Column:
    """A result (name, type, confidence, size, duration, pages, duplicates, match, said) as a line of a Markdown list; match: (kind, ref), said: (ref, snippet) of its text."""
    video, pdf = F.col("type") == "video", F.col("type") == "pdf"
    kind = F.when(pdf, "PDF").otherwise(F.initcap("type"))
    frame = F.when(F.col("match.kind") == "frame", F.concat(F.lit("match at **"), minutes(F.col("match.ref")), F.lit("**"))).otherwise("match n/a")
    page = F.concat(F.lit("visual match on page "), F.col("match.ref").cast("int").cast("string"))
    words = F.substring(F.regexp_replace(F.trim("said.snippet"), r"\s+", " "), 1, SHOWN)
    text = F.format_string('text on page %s: "%s…"', F.coalesce(F.when(F.col("said.ref") > 0, F.col("said.ref").cast("int").cast("string")), F.lit("-")), words)
    parts = [
        F.concat(F.lit("**"), F.col("name"), F.lit("**")), F.concat(kind, F.lit(" **"), F.bround(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%**")), display_size(F.col("size")),
        F.when(video, minutes(F.col("duration"))), F.when(video, frame), F.when(pdf, F.concat(F.col("pages").cast("string"), F.when(F.col("pages") == 1, " page").otherwise(" pages"))),
        F.when(pdf & (F.col("match.kind") == "page"), page), F.when(pdf & (F.length("said.snippet") > 0), text), F.when(F.col("duplicates") > 0, F.concat((F.col("duplicates") + 1).cast("string"), F.lit(" copies"))),
    ]
    return F.concat(number.cast("string"), F.lit(". "), F.concat_ws(" — ", *parts))


def markdown_table(rows: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown; more than ``most`` rows are an error, as all come to the driver."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows")
    lines = [rows.columns, ["---"] * len(rows.columns), *[["" if v is None else str(v) for v in r] for r in found]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)

"""Substring search over paths: postings of three-character grams by segment, verified against the paths themselves.

Paths are numbered in their order, so a segment of ``SEGMENT`` paths is a stretch of neighbouring folders; a gram's postings in a segment are the places that have it.  Case
of A-Z counts for nothing.  A path is followed by two ``END`` characters in its grams, so one or two characters are the beginning of a gram wherever they
stand, and short patterns need no scan.  What the postings yield are candidates; each is compared, so results are exact whatever grams were used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from prismdex.operators.retrieval import ascii_lower
from prismdex.sources import scratch

GRAM, END = 3, "\0"
#: Bits of a place in its segment and of a segment in its folder of the table; rarest grams of a pattern that are intersected.
PLACES, SEGMENTS, PICKED = 14, 6, 6
POSTINGS = "gram string, segment long, n int, places array<int>"


def grams(text: Column) -> Column:
    """Distinct grams of lower-cased text, in order; none of a text that is shorter than one, or null."""
    at = F.when(F.length(text) >= GRAM, F.sequence(F.lit(1), F.length(text) - (GRAM - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(GRAM))))


class PathIndex:
    """``paths`` (part, segment, place, path and the carried columns) and ``postings`` (gram, segment, n, places), both Parquet under ``root``."""

    def __init__(self, spark: SparkSession, root: str, columns: StructType) -> None:
        self.spark, self.root = spark, root
        self.paths = spark.read.schema(_numbered(columns)).parquet(f"{root}/paths")
        self.postings = spark.read.schema(POSTINGS).parquet(f"{root}/postings")

    @classmethod
    def opened(cls, files: DataFrame, root: str, signature: str) -> PathIndex:
        """The index of ``files`` (path and any columns but part, segment, place) under ``root``: the one there is for this signature, or else a new one.

        Null paths are left out, since they contain nothing; equal paths are rows of their own.  No rows make an empty index.
        """
        spark, path = files.sparkSession, f"{root.rstrip('/')}/{signature}"
        there, place = scratch.file_system(spark, f"{path}/postings/_SUCCESS")
        if not there.exists(place):
            _build(files.where("path IS NOT NULL"), path)
        return cls(spark, path, files.schema)

    def _verified(self, candidates: DataFrame, parts: list[int] | None = None) -> DataFrame:
        """Rows of paths by candidates (qid, pattern, segment, place) that contain the pattern."""
        paths = self.paths if parts is None else self.paths.where(F.col("part").isin(parts))
        return candidates.join(paths, ["segment", "place"]).where(F.contains(ascii_lower(F.col("path")), F.col("pattern"))).drop("segment", "place", "part")

    def candidates(self, patterns: DataFrame) -> DataFrame:
        """(qid, pattern, segment, place) of paths that have the rarest grams of each pattern (qid, pattern); qids are distinct.  A null or empty pattern has none."""
        asked = patterns.select("qid", ascii_lower(F.col("pattern")).alias("pattern")).where("length(pattern) > 0")
        long = asked.where(F.length("pattern") >= GRAM).select("qid", "pattern", F.explode(grams(F.col("pattern"))).alias("gram"))
        number = self.postings.select("gram", "n").join(long.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.sum("n").alias("n"))
        rarest = Window.partitionBy("qid").orderBy(F.coalesce("n", F.lit(0)), "gram")
        picked = long.join(number, "gram", "left").withColumn("k", F.row_number().over(rarest)).where(F.col("k") <= PICKED)
        picked = picked.withColumn("of", F.count("*").over(Window.partitionBy("qid"))).select("qid", "pattern", "gram", "of")
        met = picked.join(self.postings, "gram").groupBy("qid", "pattern", "segment").agg(F.collect_list("places").alias("lists"), F.first("of").alias("of"))
        found = met.where(F.size("lists") == F.col("of")).select("qid", "pattern", "segment", F.explode(_common(F.col("lists"))).alias("place"))
        for n in range(1, GRAM):
            begins = self.postings.select(F.substring("gram", 1, n).alias("pattern"), "segment", F.explode("places").alias("place")).distinct()
            found = found.unionByName(asked.where(F.length("pattern") == n).join(begins, "pattern"))
        return found

    def matches(self, patterns: DataFrame) -> DataFrame:
        """(pattern in lower case, path, carried columns) of every path that contains a pattern (pattern): each distinct pattern is looked up once, however often it is asked."""
        lower = patterns.select(ascii_lower(F.col("pattern")).alias("pattern")).distinct()
        return self._verified(self.candidates(lower.select(F.col("pattern").alias("qid"), "pattern"))).drop("qid")

    def search(self, patterns: DataFrame) -> DataFrame:
        """(qid, pattern in lower case, path, carried columns) of every path that contains a pattern."""
        asked = patterns.select("qid", ascii_lower(F.col("pattern")).alias("pattern"))
        found = asked.join(self.matches(patterns), "pattern")
        return found.select("qid", "pattern", *[c for c in found.columns if c not in ("qid", "pattern")])

    def find(self, pattern: str) -> DataFrame:
        """(path, carried columns) of the paths that contain one pattern.

        Its grams are filters of the scan of the postings, and only the folders of the table of paths that hold candidates are read: their numbers, one for each
        million paths, come to the driver.
        """
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in pattern)
        if not lower:
            return self.paths.drop("segment", "place", "part").limit(0)
        if len(lower) < GRAM:
            found = self.postings.where(F.startswith("gram", F.lit(lower))).select("segment", F.explode("places").alias("place")).distinct()
        else:
            wanted = sorted({lower[k : k + GRAM] for k in range(len(lower) - GRAM + 1)})
            number = {r.gram: r.n for r in self.postings.where(F.col("gram").isin(wanted)).groupBy("gram").agg(F.sum("n").alias("n")).collect()}
            if len(number) < len(wanted):
                return self.paths.drop("segment", "place", "part").limit(0)
            picked = sorted(wanted, key=lambda g: (number[g], g))[:PICKED]
            met = self.postings.where(F.col("gram").isin(picked)).groupBy("segment").agg(F.collect_list("places").alias("lists"))
            found = met.where(F.size("lists") == len(picked)).select("segment", F.explode(_common(F.col("lists"))).alias("place"))
        found = scratch.written(found.select(F.lit(0).alias("qid"), F.lit(lower).alias("pattern"), "segment", "place"), "candidates")
        parts = [r[0] for r in found.select(F.shiftright("segment", SEGMENTS)).distinct().collect()]
        return self._verified(found, parts).drop("qid", "pattern")


def _numbered(columns: StructType) -> StructType:
    return StructType([*columns.fields, StructField("segment", LongType()), StructField("place", IntegerType()), StructField("part", LongType())])


def _common(lists: Column) -> Column:
    return F.aggregate(lists, lists[0], lambda a, b: F.array_intersect(a, b))


def _build(files: DataFrame, root: str) -> None:
    """Numbers are given once, by the order of paths, and written; the postings are made of what was written."""
    spark, number = files.sparkSession, F.col("__number")
    rows = files.repartitionByRange("path").sortWithinPartitions("path").withColumn("__number", F.monotonically_increasing_id())
    rows = rows.withColumns({"segment": F.shiftright(number, PLACES), "place": number.bitwiseAND((1 << PLACES) - 1).cast("int"), "part": F.shiftright(number, PLACES + SEGMENTS)})
    rows.drop("__number").write.mode("overwrite").partitionBy("part").parquet(f"{root}/paths")
    written = spark.read.schema(_numbered(files.schema)).parquet(f"{root}/paths")
    each = written.select("segment", "place", F.explode(grams(F.concat(ascii_lower(F.col("path")), F.lit(END * (GRAM - 1))))).alias("gram"))
    posted = each.groupBy("segment", "gram").agg(F.collect_list("place").alias("places")).select("gram", "segment", F.size("places").alias("n"), "places")
    posted.repartitionByRange("gram", "segment").sortWithinPartitions("gram", "segment").write.mode("overwrite").parquet(f"{root}/postings")

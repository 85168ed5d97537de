"""The corpus pipeline: documents through quality rules, near-duplicates, decontamination and mixing into token files.

Every stage but the last keeps the columns of its rows, whatever their names (it carries a row as one struct), and defines nulls, ties, repeated rows and very long texts as its
operator does; an empty table goes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prismdex.llm.decontaminate import drop_contaminated
from prismdex.llm.mixing import mixed
from prismdex.llm.near_copies import keep_one_near
from prismdex.llm.quality_rules import keep_good
from prismdex.llm.tables import table, written
from prismdex.llm.token_files import encoded


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; null and empty texts do not."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (SimHash fingerprints within 2 bits, or five-word similarity of 0.8 or more): the one with the smallest doc_id; rows without doc_id come after all others."""
    return keep_one_near(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs, rows without doc_id among them; an empty benchmark keeps all."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them; null is a source, documents without a label are of middle quality."""
    return mixed(docs, table(spark, sf_dir, "labels"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, as read back: doc_id, start, n_tokens, ids_crc32; rows without doc_id come first."""
    return encoded(docs)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID / binary output", tokens),
]

#: Tokenizing and near-duplicates are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read back by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs

"""A corpus through five operators: STAGES in order, each on what the one before it kept.

run() gives the mix; every stage but the last returns the columns of documents. SimHash uses XXH64, which
DuckDB SQL doesn't have, so ORACLE_SQL is None; tests/llm/test_pipeline.py holds run() on a small corpus against a plain
version of every stage, row by row.

Results for odd input, by stage. Quality rules: a null, empty or short text fails; a null source is a host. Line dedup: a
document whose lines all go has an empty text; null stays null; rows of one doc_id, or without any, are one document.
Near-dedup: null and wordless texts are copies of each other; of a class the row of the smallest doc_id stays, one without
doc_id only if no other has one. Decontamination: rows go by their text, whatever their doc_id. Mixing: rows without words are
never taken; equal rows draw alike, and the first go in where the cut falls among them. Repeated rows are copies,
an empty table gives an empty one, and other columns, whatever their names, pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.common import kept_table
from spanloom.llm.decontamination import drop_contaminated
from spanloom.llm.line_dedup import drop_repeated_lines
from spanloom.llm.mixing import mixed
from spanloom.llm.near_copies import drop_near_copies
from spanloom.llm.quality_rules import keep_good
from spanloom.shipping import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return drop_repeated_lines(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mixing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each returns is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = kept_table(docs, "stage")
    return docs

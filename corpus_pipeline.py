"""The corpus pipeline: quality, line dedup, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written before the next stage
reads it. All but the last return the columns of documents. Tables that a stage stages belong to its result;
common.clear(result) deletes them once it is written.

Cases, for every stage: null, empty and wordless texts go at the first stage (low quality by rule), and where a stage is
used by itself it treats them as its operator states: line dedup keeps texts that were empty before and drops texts that were
nothing but copies, near-duplicates keep them all, decontamination finds nothing in them, packing gives each its end token.
Ids may be null, repeat or be strings; rows that repeat are one near-duplicate group of which the first stays.
Texts of any length are handled whole; empty tables pass through as empty ones; further columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from midbase.llm import common, decontaminate, linededup, neardup, packing, quality


@common.owned
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are neither of low quality nor toxic."""
    report = common.free_name(docs.columns, "__judged")
    judged = quality.judge(docs, common.table(spark, sf_dir, "labels"), report=report)
    return judged.filter(F.col(report)["kept"]).drop(report)


@common.owned
def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated runs; documents that were nothing but copies go, n_chars is counted anew."""
    report = common.free_name(docs.columns, "__cut")
    cut = linededup.cut_repeats(docs, report=report).filter(~F.col(report)["emptied"])
    count = F.when(F.col(report)["removed"] > 0, F.length("text")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", count.cast(docs.schema["n_chars"].dataType)).drop(report)


@common.owned
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingle sets are alike to 0.8 or more."""
    return neardup.drop_near_duplicates(docs)


@common.owned
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item: here one leaked passage is enough."""
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"), min_items=1)


@common.owned
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences with every window mixed in the sources' proportions."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("line dedup", cut_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]


@common.owned
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again. The stages' outputs and staged tables belong to the
    result; what no later stage reads is deleted on the way."""
    docs, last = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with common.inner():
            made = common.staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last is not None:
            common.release(last)
        docs = last = made
    return STAGES[-1][1](spark, docs, sf_dir)


#: Likelihood, classifier and hash order can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None

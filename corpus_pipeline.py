"""The training-data pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads again as the
next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import common, decontaminate, langid, linededup, minhash, packing


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language isn't accepted go: null, empty and letterless texts too. Repeated rows are judged alike; further columns pass through."""
    return langid.accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of too many documents go; every document stays, and a copy of another one is left whole for the next stage. Nulls, empty texts, repeats and further columns as dedup_lines() says."""
    return linededup.dedup_lines(docs, spare_copies=True).select(*map(common.column, docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the least id. Null and empty texts are in no group and stay; of repeated rows one stays; further columns pass through."""
    return minhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which a benchmark item leaks go. Rows with a null id, a null or an empty text stay; repeated rows go or stay alike; further columns pass through."""
    return decontaminate.decontaminated(docs, common.table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences. Null and empty texts have no piece; repeated rows have their own; further columns are ignored."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the classifier, the signatures and the packing; the tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, in their order. An empty table runs through and gives no row. Each stage's table is deleted once the next one is written; the last one stays until common.clean_up() or the driver's end."""
    docs = common.table(spark, sf_dir, "documents")
    at = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(common.keep_until_end(spark, f"{at}/{name}"))
        docs = spark.read.parquet(f"{at}/{name}")
        docs._corpusloom_path = f"{at}/{name}"
        if before is not None:
            common.discard(before)
        before = docs
    return docs

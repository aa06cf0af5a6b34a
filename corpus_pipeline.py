"""Cleaning pipeline over documents: toxicity, exact and near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), reads all that its predecessor kept, and returns
documents, but for the last, which returns the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.llm.common import beside, release, staged, table
from threadlake.llm.exact_dedup import exact_dedup
from threadlake.llm.minhash import near_duplicates
from threadlake.llm.packing import pack
from threadlake.llm.substring import remove_repeats
from threadlake.llm.toxicity import given_labels, score_toxicity


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with _row, which tells rows apart and has the order of ids, null ids last.

    It is the id where ids are keys, as counting shows; else a number that is written once with the rows.
    """
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        return docs.withColumn("_row", F.col("doc_id"))
    return staged(docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id()), "keyed")


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of _keyed but for those whose _row is a doc_id of gone, a staged table."""
    return beside(rows, gone.select(F.col("doc_id").alias("_row")), "left_anti", "_row").select(*(c for c in rows.columns if c != "_row"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, with or without an id, and no other row of the same id."""
    rows = _keyed(docs)
    labels = given_labels(spark, sf_dir)
    # labels name ids: each row of an id has its label
    own = labels.join(rows.select("doc_id", "_row"), "doc_id").select(F.col("_row").alias("doc_id"), *(c for c in labels.columns if c != "doc_id"))
    return _without(rows, staged(score_toxicity(rows, own, id_col="_row").where("rejected"), "rejected"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of equal texts stays, that with the smallest id; rows that repeat an id or have none are documents each."""
    rows = _keyed(docs)
    return _without(rows, staged(exact_dedup(rows, id_col="_row").where("not kept"), "copies"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest id; rows that repeat an id or have none are documents each."""
    rows = _keyed(docs)
    return _without(rows, staged(near_duplicates(rows, id_col="_row").where("not kept"), "near"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that an earlier document has are cut from the text.

    Texts that lose nothing stay as they are; n_chars is the new length of others.
    A document that loses all words goes.  Rows that repeat an id or have none are documents each.
    """
    rows = _keyed(docs)
    cut = staged(remove_repeats(rows, id_col="_row").where("n_removed > 0").select(F.col("doc_id").alias("_row"), F.col("kept_text").alias("_kept")), "cut")
    changed = rows.join(cut, "_row", "left")
    new = F.col("_kept").isNotNull()
    kept = changed.where(~new | (F.col("_kept") != ""))
    return kept.withColumns({"text": F.when(new, F.col("_kept")).otherwise(F.col("text")), "n_chars": F.when(new, F.length("_kept").cast("long")).otherwise(F.col("n_chars"))}).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and batches of what is left."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("near dedup", near), ("substring dedup", passages), ("packing", packing)]

#: The first and last stages are a fitted model and a dynamic programme, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written and read again, and goes when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        kept = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if i:
            release(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)

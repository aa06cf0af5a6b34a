"""Exact de-duplication with a heavy-hitter split; DataFrame functions only.

A Misra-Gries summary (Spark's ``approx_top_k``, a mergeable frequent-items
sketch with a fixed number of counters) names every digest that can have more than about N / counters
rows.  One exact, map-side combined count verifies them; the winners, at most one for each counter,
are broadcast and settle their copies without a shuffle.  The remaining digests go through
ordinary shuffling, which has no hot key any more: a map-side combined aggregate, and a
join with those of its groups that have several rows.  The split only moves work: results are
exact whatever the sketch says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.llm.common import staged, table

#: Counters of the summary, and so the most winners that are broadcast.
COUNTERS = 4096


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    # A single space needs no replacement, so only other runs are matched.
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _groups(rows: DataFrame) -> DataFrame:
    """text_sha256, keep_id, group_size of the digests that several rows have."""
    return rows.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")


def heavy_digests(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The verified groups of all digests that the summary holds, a staged table of at most ``counters`` rows."""
    frequent = rows.agg(F.expr(f"approx_top_k(text_sha256, {counters}, {counters})").alias("top")).select(F.explode("top.item").alias("text_sha256"))
    return staged(_groups(rows.join(F.broadcast(frequent), "text_sha256")), "winners")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their white-space-normalised SHA-256 digests are; null
    counts as empty.  The smallest id of a group is keep_id; null ids lose against
    any id, and a group of null ids only keeps them all.  Rows that repeat an id
    share its verdict and count each.  Other columns are not read.  An empty
    table gives an empty result.
    """
    rows = staged(docs.select(F.col(id_col).alias("doc_id"), F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256")), "digests")
    winners = heavy_digests(rows, counters)
    hot = rows.join(F.broadcast(winners), "text_sha256")
    rest = rows.join(F.broadcast(winners), "text_sha256", "left_anti")
    rest = rest.join(_groups(rest), "text_sha256", "left")
    alone = F.col("group_size").isNull()
    rest = rest.select("text_sha256", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.when(alone, F.lit(1)).otherwise(F.col("group_size")).alias("group_size"))
    return hot.unionByName(rest).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

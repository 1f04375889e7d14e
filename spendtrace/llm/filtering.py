"""Keeping the documents that a verdict keeps, as a stage of a pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendtrace.llm.membership import maybe_member
from spendtrace.llm.staging import stored


def kept_only(docs: DataFrame, verdicts: DataFrame, name: str) -> DataFrame:
    """Rows of ``docs`` whose id has a verdict (doc_id, kept) that keeps it, null ids included.

    A document is named by doc_id: rows that repeat an id stay or go together, and stay if one of
    their verdicts keeps them. Rows that a bitmap shows not to be rejected pass without a
    shuffle of their texts; the others are joined with the rejected ids. Columns are those of ``docs``.
    """
    by_id = verdicts.groupBy("doc_id").agg(F.bool_or("kept").alias("kept"))
    rejected = stored(by_id.where("not coalesce(kept, false)").select("doc_id"), name)
    maybe = maybe_member(rejected.select(F.xxhash64("doc_id").alias("id")), F.xxhash64("doc_id"))
    ids = rejected.withColumnRenamed("doc_id", "rejected_id")
    kept = docs.where(maybe).join(ids, docs["doc_id"].eqNullSafe(ids["rejected_id"]), "left_anti")
    return docs.where(~maybe).union(kept)

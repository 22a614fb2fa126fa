"""Labelled training rows for the classifiers, and the held-out fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; a row without id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(doc_id, text, label) of at most ``max_rows`` labelled rows outside the held-out fold, one per id.

    The bound takes the ids with the smallest hash, the same ids at every size of the rest; rows
    without id or label don't count. Labels that contradict each other for an id count as their
    largest, and of rows that share an id the text with the smallest hash (then the smallest text) stands
    for it, chosen in the map tasks first; so the bound holds however often an id repeats."""
    known = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
             .where("doc_id IS NOT NULL AND label IS NOT NULL").where(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("label").alias("label")))
    # max_rows ids at most, so the semi-join below may broadcast them
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return (texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label")
            .agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("doc_id", "text", "label"))

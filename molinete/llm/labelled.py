"""Labelled training rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molinete.llm.common import durable, held_out, text_of

#: Rows a classifier is fitted on at most; statistics and scores cover all documents.
SAMPLE_ROWS = 16_384


def training_sample(docs: DataFrame, labels: DataFrame, column: str, *, rows: int = SAMPLE_ROWS, folds: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, body, label)``: up to ``rows`` labelled documents outside the held-out fold, the first by hash of their id.

    A document labelled more than once has its largest label; labels other than 0 and 1, null ids and unlabelled documents are
    left out. Only ids and labels are sorted; texts are read for the chosen ids alone. Equal texts count once.
    """
    named = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col(column).cast("int").alias("label"))
        .where("id IS NOT NULL AND label IN (0, 1)")
        .where(~held_out("id", folds))
        .groupBy("id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(rows)
    )
    found = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("body")).join(durable(named), F.col("doc_id") == F.col("id"))
    once = found.groupBy(F.md5(F.col("body").cast("binary")).alias("same")).agg(F.min(F.struct("doc_id", "label", "body")).alias("row"))
    return durable(once.select("row.doc_id", "row.body", "row.label"))

"""What several operators share: word patterns, column order, lineage cuts and sliced running sums."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from molinete.session import durable

__all__ = ["WORD", "durable", "fresh", "held_out", "read", "running_before", "text_of", "word_count"]

#: White space is these six ASCII characters and nothing else; a word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{table}.parquet"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names`` made unlike every column of ``df`` (and unlike one another) by underscores in front."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(column: Column | str) -> Column:
    """A text column without nulls; other types are read as their strings."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))


def held_out(doc_id: Column | str, folds: int) -> Column:
    """Whether crc32 of the id's decimal text leaves no remainder; a null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % folds == 0


def word_count(column: Column | str) -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def running_before(
    df: DataFrame, key: Sequence[str], order: Sequence[str], slice_of: Column, value: str, out: str, per_key: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """``out``: the sum of ``value`` over the rows of the same ``key`` that come before in ``order``.

    ``slice_of`` cuts each key's order into consecutive integer slices, so that a key with a third of all rows
    is sorted by as many tasks as it has slices. Slice totals (at most one row per key and slice) are summed over
    the slices before and joined back; the rows themselves are shuffled once, by key and slice. ``per_key`` makes more columns
    for each key from the table ``(key, total)``; they come along by the same join. Key columns must not be null.
    """
    part, start, total = fresh(df, "slice", "slice_start", "slice_total")
    cut = df.withColumn(part, slice_of)
    sums = cut.groupBy(*key, part).agg(F.sum(value).alias(total))
    before = Window.partitionBy(*key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*key, part, F.coalesce(F.sum(total).over(before), F.lit(0)).alias(start))
    if per_key is not None:
        starts = starts.join(per_key(sums.groupBy(*key).agg(F.sum(total).alias("total"))), list(key))
    inside = Window.partitionBy(*key, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = cut.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return ranked.join(starts, [*key, part]).withColumn(out, F.col(out) + F.col(start)).drop(part, start)

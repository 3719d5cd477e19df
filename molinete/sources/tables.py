"""Scans, sinks and schema conformance (SRC-*)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from molinete.functions.scalars import blank_to_null
from molinete.schema import TABLES, table_schema


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One of the 19 tables from Parquet, with its declared schema (no inference, no footer merge)."""
    return spark.read.schema(TABLES[table]).parquet(f"{folder.rstrip('/')}/{table}")


def load_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    key: str = "id",
    lower: int,
    upper: int,
    partitions: int,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """A live table over JDBC, read in ``partitions`` ranges of its integer key."""
    reader = (
        spark.read.format("jdbc")
        .option("url", url)
        .option("dbtable", table)
        .option("partitionColumn", key)
        .option("lowerBound", lower)
        .option("upperBound", upper)
        .option("numPartitions", partitions)
    )
    for name, value in (options or {}).items():
        reader = reader.option(name, value)
    target = table_schema(table)
    return conform(reader.load().select(*target.names), target)


def conform(df: DataFrame, target: T.StructType, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """``df`` in the target's columns, order and types; absent columns get their default (else NULL).

    A blank e-mail becomes NULL, so that uniqueness treats it as missing.
    """
    defaults = defaults or {}
    have = {c.lower(): c for c in df.columns}

    def column(f: T.StructField):
        if f.name.lower() not in have:
            return F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name)
        source = F.col(have[f.name.lower()])
        if f.name == "email":
            source = blank_to_null(source)
        return source.cast(f.dataType).alias(f.name)

    return df.select(*[column(f) for f in target])


def merge_generations(*frames: DataFrame, target: T.StructType, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Files written under older schemas next to newer ones, as one table."""
    out = conform(frames[0], target, defaults)
    for df in frames[1:]:
        out = out.unionByName(conform(df, target, defaults))
    return out


def append(df: DataFrame, path: str, *, partition_by: str | None = None) -> None:
    """Append facts; ``partition_by`` a low-cardinality column (a month, say)."""
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def rows_from_ids(requests: DataFrame, key: str, ids: str, child: str) -> DataFrame:
    """One row per id of an array column: the multi-row insert of a bridge table. Ids below 1 are dropped."""
    return requests.select(key, F.explode(ids).alias(child)).filter(F.col(child) > 0)


def publish(df: DataFrame, path: str, version: str) -> str:
    """Write a new snapshot next to the old ones; readers switch to it by name.

    The old snapshot is untouched, so a job can read it while this one is written,
    and a failed write leaves nothing half-replaced.
    """
    target = f"{path.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(target)
    return target


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int, *, sort: bool = True) -> None:
    """A catalog table bucketed on ``key``: later joins and groupings on it need no shuffle."""
    writer = df.write.mode("overwrite").bucketBy(buckets, key)
    (writer.sortBy(key) if sort else writer).saveAsTable(table)


def to_document(df: DataFrame) -> DataFrame:
    """Each row, nested arrays included, as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("document"))

"""Streaming forms of the append-only facts (ST-1 .. ST-4).

Input streams are bounded per trigger (files or bytes), so a key that fills a
third of the stream fills at most a third of one bounded micro-batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from molinete.functions.scalars import expense, income, signed_amount
from molinete.operators.attendance import COOLDOWN_MINUTES
from molinete.operators.rows import latest_per_key
from molinete.plans.members import register_entries
from molinete.session import durable, work_folder
from molinete.sources.store import WIDTH, Append, Put, Replace, Store

TOTAL = "decimal(38,2)"


def read_stream(
    spark: SparkSession, folder: str, schema: StructType | str, *, name_filter: str | None = None, files_per_trigger: int = 64
) -> DataFrame:
    """Parquet files as they arrive, at most ``files_per_trigger`` per micro-batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.parquet(folder)


def gate_batches(
    swipes: DataFrame, clients: DataFrame, memberships: DataFrame, store: Store, checkpoint: str, *, minutes: int = COOLDOWN_MINUTES, width: int = WIDTH
):
    """Each swipe accepted or rejected with a reason and the next allowed time, as it arrives; returns the running query.

    ``swipes``: ``id, client_id, entered_at``. Every micro-batch is judged by :func:`register_entries` (no client in one task, no row in Python) against the
    last accepted entry of its clients. That is all the gate keeps: one row per client in the keyed table ``gate_last``, of which a batch opens and
    rewrites only the ranges its clients fall into. Verdicts go to ``entries``; both are published by one commit that notes the batch's number, so a
    batch that is run again after a stop is judged once.

    Swipes are judged in the order of arrival, and within a batch by time. One that is older than the client's last accepted entry, however
    late, gets its answer: ``cooldown``, until ``minutes`` after that entry. One of an unknown client is ``client_not_found``.
    """

    def judge(batch: DataFrame, epoch: int) -> None:
        now = store.snapshot()
        if now.notes.get("gate", -1) >= epoch:
            return
        known = "gate_last" in now.tables
        judged = durable(register_entries(batch, clients, memberships, now.read_for("gate_last", batch) if known else None, minutes=minutes))
        last = judged.filter("accepted").groupBy("client_id").agg(F.max("entered_at").alias("entered_at"))
        change = Put(last) if known else Replace(last, key="client_id", width=width)
        store.commit({"entries": Append(judged), "gate_last": change}, base=now, notes={"gate": epoch})

    return swipes.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drawer_totals(movements: DataFrame) -> DataFrame:
    """Running totals per session (update mode)."""
    return movements.groupBy("cash_session_id").agg(
        F.count(F.lit(1)).alias("movements_count"),
        F.sum(income()).cast(TOTAL).alias("total_income"),
        F.sum(expense()).cast(TOTAL).alias("total_expenses"),
    )


def tumbling_counts(
    stream: DataFrame, ts: str, width: str = "1 day", *, amount: str | None = None, late: str = "1 day"
) -> DataFrame:
    """Rows (and ``amount``) per fixed window; late rows within ``late`` still count."""
    at = stream.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    sums = [F.sum(amount).cast(TOTAL).alias("total")] if amount else []
    return (
        at.groupBy(F.window("_at", width).alias("w"))
        .agg(F.count(F.lit(1)).alias("count"), *sums)
        .select(
            F.col("w.start").cast("timestamp_ntz").alias("window_start"),
            F.col("w.end").cast("timestamp_ntz").alias("window_end"),
            "count",
            *(["total"] if amount else []),
        )
    )


def stream_balances(ledger: DataFrame) -> DataFrame:
    """Running balance per client (update mode)."""
    return ledger.groupBy("client_id").agg(F.sum(signed_amount()).cast(TOTAL).alias("balance"))


def run_available(stream: DataFrame, *, mode: str, keys: list[str] | None = None, folder: str | None = None) -> DataFrame:
    """Run a stream over what has arrived and read its result back.

    Batches are written under their own number. In ``update`` mode the last row written per key is its
    current value.
    """
    spark = stream.sparkSession
    base = folder or f"{work_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{base}/out"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema.fields]).add("epoch", IntegerType())).parquet(out)
    if mode == "update" and keys:
        rows = latest_per_key(rows, keys, ["epoch"])
    return rows.drop("epoch")



"""Streams over several micro-batches equal their batch twins."""

from __future__ import annotations

import datetime as dt
import random
import shutil

import pytest
from pyspark.sql import functions as F

from molinete.plans import members
from molinete.sources.store import Store
from molinete.streaming import streams

T0 = dt.datetime(2024, 1, 1)
MEMBERSHIP = "id bigint, client_id bigint, start_date date, end_date date, status string"


@pytest.fixture(scope="module")
def swipes(spark, tmp_path_factory):
    """Five files in time order; one client makes half of the swipes."""
    rng = random.Random(5)
    rows = [(i, 1 if rng.random() < 0.5 else rng.randint(2, 9), T0 + dt.timedelta(seconds=i * 200 + rng.randint(0, 199))) for i in range(500)]
    folder = str(tmp_path_factory.mktemp("swipes"))
    ddl = "id bigint, client_id bigint, entered_at timestamp_ntz"
    for n in range(5):
        spark.createDataFrame(rows[n * 100 : n * 100 + 100], ddl).coalesce(1).write.mode("append").parquet(folder)
    df = spark.read.schema(ddl).parquet(folder)
    return folder, ddl, df


def membership(spark):
    rows = [(c, c, dt.date(2023, 12, 1), dt.date(2024, 1, 31) if c != 3 else dt.date(2024, 1, 1), "active") for c in range(1, 9)]
    return spark.createDataFrame(rows, MEMBERSHIP)


def in_order_of_arrival(spark, batches, clients, ms):
    """The batch operator, one arrival after the other, told the last accepted entries so far."""
    out, last = {}, None
    for rows in batches:
        judged = members.register_entries(rows, clients, ms, last).collect()
        out |= {r.id: (r.accepted, r.reason, r.membership_id, r.next_allowed_at) for r in judged}
        new = [(r.client_id, r.entered_at) for r in judged if r.accepted] + ([] if last is None else [tuple(r) for r in last.collect()])
        last = spark.createDataFrame(new, "client_id bigint, entered_at timestamp_ntz").groupBy("client_id").agg(F.max("entered_at").alias("entered_at"))
    return out


def test_gate_over_batches(spark, swipes, tmp_path):
    """Five batches in order of time are judged as one; then the gate is stopped, and a late file comes with strangers in it."""
    folder, ddl, df = swipes
    ms, clients, store = membership(spark), spark.range(1, 10), Store(spark, f"{tmp_path}/store")
    answers = lambda df: {r.id: (r.accepted, r.reason, r.membership_id, r.next_allowed_at) for r in df.collect()}
    files = f"{tmp_path}/files"
    shutil.copytree(folder, files)
    run = lambda: streams.gate_batches(streams.read_stream(spark, files, ddl, files_per_trigger=1), clients, ms, store, f"{tmp_path}/checkpoint", width=4).awaitTermination()
    run()
    assert answers(store.read("entries")) == answers(members.register_entries(df, clients, ms))
    assert store.numbers() == [1, 2, 3, 4, 5]
    late = [(1000 + i, client, T0 + dt.timedelta(hours=h, seconds=i)) for i, (client, h) in enumerate([(1, 2), (1, 30), (2, 5), (77, 1), (None, 1), (5, 31), (5, 31), (6, -24)])]
    rows = spark.createDataFrame(late, ddl)
    rows.coalesce(1).write.mode("append").parquet(files)
    before = store.snapshot()
    run()
    assert answers(store.read("entries")) == in_order_of_arrival(spark, [df, rows], clients, ms)
    got = {r.id: r.reason for r in store.read("entries").filter("id >= 1000").collect()}
    assert got == {1000: "cooldown", 1001: None, 1002: "cooldown", 1003: "client_not_found", 1004: "client_not_found", 1005: None, 1006: "cooldown", 1007: "cooldown"}
    was, now = before.tables["gate_last"].ranges, store.snapshot().tables["gate_last"].ranges
    assert {no for no in now if was[no] != now[no]} == {0, 1} and set(was) == {0, 1, 2}  # clients 8 and 9 were not touched


def test_a_batch_that_is_run_again_is_judged_once(spark, swipes, tmp_path):
    folder, ddl, df = swipes
    ms, clients, store = membership(spark), spark.range(1, 10), Store(spark, f"{tmp_path}/store")
    for checkpoint in ("a", "a", "b"):  # a lost checkpoint starts again with batch 0, which the store has noted
        stream = streams.read_stream(spark, folder, ddl, files_per_trigger=100)
        streams.gate_batches(stream, clients, ms, store, f"{tmp_path}/{checkpoint}").awaitTermination()
    assert store.numbers() == [1] and store.read("entries").count() == 500


def test_windows_over_batches(spark, swipes, tmp_path):
    folder, ddl, df = swipes
    stream = streams.read_stream(spark, folder, ddl, files_per_trigger=2)
    out = streams.run_available(
        streams.tumbling_counts(stream, "entered_at", "6 hours"), mode="update", keys=["window_start", "window_end"], folder=f"{tmp_path}/w"
    )
    assert out.agg(F.sum("count")).first()[0] == 500
    assert out.select("window_start").distinct().count() == out.count()

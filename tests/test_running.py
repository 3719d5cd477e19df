"""Running values: the sliced path must equal the plain one, row for row."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from molinete.operators.running import Running, previous_value, row_numbers, running, size_probe
from molinete.operators.rows import Details, latest_per_key, nest

BASE = dt.datetime(2024, 1, 1)


def skewed(spark, seed=3, n=3000, ties=False):
    """One key holds most rows; with ``ties`` a third of them share one timestamp."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = 0 if rng.random() < 0.6 else (None if rng.random() < 0.1 else rng.randint(1, 40))
        ts = BASE + dt.timedelta(seconds=0 if ties and rng.random() < 0.4 else rng.randint(-5000, 5000))
        rows.append((i, key, ts, Decimal(rng.randint(-999, 999)) / 100, f"t{rng.randint(0, 30):02d}"))
    return spark.createDataFrame(rows, "id bigint, k bigint, ts timestamp_ntz, v decimal(10,2), s string")


OUTPUTS = {
    "total": lambda: Running("sum", F.col("v")),
    "before": lambda: Running("sum", F.col("v"), inclusive=False),
    "n": lambda: Running("count"),
    "top": lambda: Running("max", F.col("v")),
    "low": lambda: Running("min", F.struct("ts", "id"), inclusive=False),
}


@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("order", [["ts", "id"], ["id"], ["s", "id"], ["v", "ts", "id"]])
def test_sliced_equals_plain(spark, ties, order):
    df = skewed(spark, ties=ties)
    outputs = {name: make() for name, make in OUTPUTS.items()}
    plain = {r.id: r for r in running(df, ["k"], order, outputs).collect()}
    sliced = running(df, ["k"], order, outputs, hot_rows=50)
    assert sliced.columns == [*df.columns, *outputs]
    got = sliced.collect()
    assert len(got) == len(plain)
    assert all(plain[r.id] == r for r in got)


def test_sliced_path_splits_the_hot_key(spark):
    from molinete.operators.running import _cut

    df = skewed(spark)
    cut, _ = _cut(df, ["k"], ["ts", "id"], 50)
    widest = cut.filter("k = 0").groupBy("_slice").count().agg(F.max("count")).first()[0]
    assert widest < 60  # of about 1,800 rows


def test_tied_timestamps_are_split_by_id(spark):
    from molinete.operators.running import _cut

    cut, _ = _cut(skewed(spark, ties=True), ["k"], ["ts", "id"], 50)
    widest = cut.filter("k = 0").groupBy("_slice").count().agg(F.max("count")).first()[0]
    assert widest < 60


def test_row_numbers_and_previous(spark):
    df = skewed(spark, n=800)
    numbered = row_numbers(df, ["k"], ["ts", "id"], hot_rows=20)
    seen = previous_value(numbered, ["k"], ["ts", "id"], "v", "previous", hot_rows=20).collect()
    by_key = {}
    for r in sorted(seen, key=lambda r: (r.ts, r.id)):
        done = by_key.setdefault(r.k, [])
        assert r.row_no == len(done) + 1
        assert r.previous == (done[-1] if done else None)
        done.append(r.v)


def test_probe_weights(spark):
    df = spark.createDataFrame([(1, 2), (1, 3), (2, 1)], "k int, w int")
    assert size_probe(df, ["k"]) == (3, 2)
    assert size_probe(df, ["k"], F.col("w")) == (6, 5)
    assert size_probe(df.limit(0), ["k"]) == (0, 0)


def test_latest_per_key_limits_before_the_shuffle(spark):
    df = skewed(spark)
    out = latest_per_key(df, ["k"], ["ts", "id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    want = {}
    for r in df.collect():
        if r.k not in want or (r.ts, r.id) > (want[r.k].ts, want[r.k].id):
            want[r.k] = r
    assert {r.k: r for r in out.collect()} == want


@pytest.mark.parametrize("items", [7, 10_000])
def test_nest_keeps_every_detail_in_order(spark, items):
    df = skewed(spark, n=600).filter("k IS NOT NULL")
    header = spark.range(0, 45).withColumnRenamed("id", "id")
    docs = nest(header, "k", {"rows": Details(df, ["ts", "id"], ["id", "v"])}, items=items).collect()
    want = {}
    for r in sorted(df.collect(), key=lambda r: (r.ts, r.id)):
        want.setdefault(r.k, []).append((r.id, r.v))
    got = {}
    for d in sorted(docs, key=lambda d: (d.id, d.part)):
        assert len(d.rows) <= items
        got.setdefault(d.id, []).extend((x.id, x.v) for x in d.rows)
    assert set(got) == set(range(45))
    assert {k: v for k, v in got.items() if v} == want


def test_adjacent_ids_at_one_instant_spread_over_slices(spark):
    """A bulk load: 20,000 rows of one key share an instant and have adjacent ids; as many are spread over time."""
    from molinete.operators import running as R

    load = spark.range(20_000).selectExpr("1 AS k", "id + 10000000 AS id", "timestamp_ntz'2024-01-05 00:00:00' AS ts")
    rest = spark.range(20_000).selectExpr("1 AS k", "id * 977 AS id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 37) AS ts")
    for df, order in ((load.union(rest), ["ts", "id"]), (load.union(rest).selectExpr("k", "id", "concat('Venta #', lpad(id, 12, '0')) AS name"), ["name", "id"])):
        cut, hot = R._cut(df, ["k"], order, 1000)
        sizes = [r["count"] for r in cut.groupBy("_slice").count().collect()]
        assert hot.count() == 40_000 and max(sizes) < 2_000 and len(sizes) > 60
        got = R.running(df, ["k"], order, {"n": R.Running("count")}, hot_rows=1000)
        assert [r.n for r in got.orderBy(*order).select("n").collect()] == list(range(1, 40_001))

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from molinete.functions.predicates import text_search
from molinete.operators.deep_pages import seek_page
from molinete.operators.kept import advance_running, keep_running
from molinete.operators.sketches import ERROR, daily_sketches, distinct_over
from molinete.operators.trigrams import build_index, candidates, indexed_search

T0 = dt.datetime(2024, 1, 1)
LEDGER = "id bigint, client_id bigint, created_at timestamp_ntz, amount bigint"
KEYS, ORDER = ["client_id"], ["created_at", "id"]


# --- running values kept up to date --------------------------------------------


def full_pass(rows):
    out, sums = {}, {}
    for i, client, at, amount in sorted(rows, key=lambda r: (r[2], r[0])):
        sums[client] = sums.get(client, 0) + amount
        out[i] = sums[client]
    return out


@pytest.mark.parametrize("hot_rows", [1_000_000, 200])
def test_late_batches_equal_a_full_pass(spark, hot_rows):
    """Client 1 owns most rows; three batches come late, one after the other, the last far back in time."""
    rng = random.Random(7)
    rows = [(i, 1 if rng.random() < 0.7 else rng.choice([2, 3, 4, 5, None]), T0 + dt.timedelta(minutes=i * 90 + rng.randint(0, 300)), rng.randint(-500, 900)) for i in range(3000)]
    batches = [[], [], []]
    stored = []
    for r in rows:
        if r[0] > 2700 and rng.random() < 0.1:
            batches[0].append(r)
        elif r[0] > 2400 and r[1] in (2, 3) and rng.random() < 0.5:
            batches[1].append(r)
        elif r[0] < 300 and r[1] == 4:
            batches[2].append(r)
        else:
            stored.append(r)
    batches[1].append((9000, 77, T0 + dt.timedelta(days=1), 5))  # a client without any row so far
    kept = keep_running(spark.createDataFrame(stored, LEDGER), KEYS, ORDER, F.col("amount"), "balance", every=50, hot_rows=hot_rows)
    values, marks = kept.values, kept.marks
    for n, batch in enumerate(batches):
        late = spark.createDataFrame(batch, LEDGER)
        step = advance_running(values, marks, late, KEYS, ORDER, F.col("amount"), "balance", every=50, hot_rows=hot_rows)
        stored += batch
        read = step.read.count()
        if n == 0:
            assert read < 450 and step.read.agg(F.min("created_at")).first()[0] > T0 + dt.timedelta(days=140)  # of 3000 rows, the hot client's last ones too
        if n == 2:
            assert step.read.filter("client_id <> 4").count() == 0
        values = values.join(step.changed.select("id"), "id", "left_anti").select(*values.columns).unionByName(step.changed.select(*values.columns))
        assert {r.id: r.balance for r in values.collect()} == full_pass(stored)
        marks = step.marks
        fresh = keep_running(spark.createDataFrame(stored, LEDGER), KEYS, ORDER, F.col("amount"), "balance", every=50).marks
        tops = lambda m: {(r.client_id, r.period): (r.m["at"]["id"], r.m["value"]) for r in m.groupBy("client_id", "period").agg(F.max(F.struct("at", "value")).alias("m")).collect()}
        assert tops(marks) == tops(fresh)


def test_an_empty_batch_changes_nothing(spark):
    rows = spark.createDataFrame([(1, 1, T0, 5), (2, 1, T0, 6)], LEDGER)
    kept = keep_running(rows, KEYS, ORDER, F.col("amount"), "balance")
    step = advance_running(kept.values, kept.marks, rows.limit(0), KEYS, ORDER, F.col("amount"), "balance")
    assert step.changed.count() == 0 and step.read.count() == 0
    assert sorted(map(tuple, step.marks.collect())) == sorted(map(tuple, kept.marks.collect()))
    none = keep_running(rows.limit(0), KEYS, ORDER, F.col("amount"), "balance")
    first = advance_running(none.values, none.marks, rows, KEYS, ORDER, F.col("amount"), "balance")
    assert {r.id: r.balance for r in first.changed.collect()} == {1: 5, 2: 11}


# --- deep pages -----------------------------------------------------------------


def test_page_ten_thousand_sorts_one_part(spark):
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).alias("id"), F.timestamp_seconds(F.col("id") * 7919 % 200_003 * 60).cast("timestamp_ntz").alias("at"))
    found = seek_page(df, ["at", "id"], 10_000, 10)
    want = [r.id for r in df.orderBy(F.desc("at"), F.desc("id")).offset(99_990).limit(10).collect()]
    assert [r.id for r in found.rows.collect()] == want and found.total == 200_000 and found.sorted < 5_000
    up = seek_page(df, ["at", "id"], 10_000, 10, descending=False)
    assert [r.id for r in up.rows.collect()] == [r.id for r in df.orderBy("at", "id").offset(99_990).limit(10).collect()]


@pytest.mark.parametrize("descending", [True, False])
def test_every_page_equals_the_sort(spark, descending):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 1, 1, 1, 2, 5, 9]), rng.choice(["", None, "aa", "prefix one", "prefix two", "é"])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, n int, s string").cache()
    for order in (["n", "id"], ["s", "id"], ["id"]):
        by = [F.desc(c) if descending else F.asc(c) for c in order]
        want = [r.id for r in df.orderBy(*by).collect()]
        for page in (1, 2, 5, 9, 30, 31):
            found = seek_page(df, order, page, 10, descending=descending, big=20)
            assert [r.id for r in found.rows.collect()] == want[page * 10 - 10 : page * 10] and found.total == 300
    hot = seek_page(df, ["n", "id"], 18 if descending else 10, 10, descending=descending, big=20)
    assert hot.sorted < 60  # of more than a hundred rows with one value
    assert seek_page(df.limit(0), ["id"], 3).rows.count() == 0


# --- text index -----------------------------------------------------------------


def test_index_finds_what_the_scan_finds(spark):
    rng = random.Random(11)
    syllables = ["ra", "mé", "lu", "Ño", "ti", "sa", "100%", "_x", "o'b", "Zü"]
    rows = [(i, "".join(rng.choices(syllables, k=rng.randint(1, 6))) if rng.random() < 0.95 else None, f"{rng.randint(0, 9999):04}") for i in range(2000)]
    df = spark.createDataFrame(rows, "id bigint, name string, code string")
    index = build_index(df, "id", ["name", "code"])
    terms = ["RAME", "lunoti", "no", "x", "", None, " 123 ", "ra%sa", "m_lu", "0%", "_x_", "%%", "zzzz", "melu%999", "ño", "\\%ra", "o'bzu"]
    for term in terms:
        want = sorted(r.id for r in text_search(df, ["name", "code"], term).collect())
        assert sorted(r.id for r in indexed_search(index, df, term).collect()) == want, term
    assert candidates(index, df, "ramelu").count() < 200 and candidates(index, df, "zzzz").count() == 0
    empty = build_index(df.limit(0), "id", ["name"])
    assert indexed_search(empty, df.limit(0), "abc").count() == 0


# --- sketches -------------------------------------------------------------------


def test_sketches_add_up_within_their_error(spark):
    visits = spark.range(300_000).select((F.xxhash64("id") % 40_000).alias("who"), F.timestamp_seconds(F.col("id") * 25).alias("at"))
    sketches = daily_sketches(visits, "at", "who")
    for period in (F.date_trunc("month", "day"), F.date_trunc("week", "day"), F.lit("ever")):
        got = {r.period: (r["distinct"], r.n) for r in distinct_over(sketches, period).collect()}
        exact = visits.withColumn("day", F.to_date("at")).groupBy(period.alias("period")).agg(F.countDistinct("who").alias("d"), F.count("*").alias("n"))
        for r in exact.collect():
            assert abs(got[r.period][0] - r.d) <= ERROR * r.d and got[r.period][1] == r.n
    with_null = daily_sketches(spark.createDataFrame([(None, T0)], "who bigint, at timestamp"), "at", "who")
    assert distinct_over(with_null, F.lit(1)).first()["distinct"] == 0

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from molinete.operators import numbering
from molinete.operators.numbering import dense_ids, insert_ids, next_id
from molinete.operators.rows import apply_updates, settle_changes
from molinete.sources.store import Append, Conflict, Delete, Put, Replace, Store, Update


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


# --- dense ids ----------------------------------------------------------------


def test_ids_are_dense_and_in_order(spark, monkeypatch):
    parts = []
    keep = numbering.durable
    monkeypatch.setattr(numbering, "durable", lambda df: parts.append(written := keep(df)) or written)
    df = spark.range(10_000).select((F.col("id") * 7919 % 10_007).alias("at"), F.col("id").alias("name")).repartition(5)
    got = dense_ids(df, ["at"], "no", start=11, partitions=8).collect()
    assert [r["no"] for r in sorted(got, key=lambda r: r["at"])] == list(range(11, 10_011))
    shares = [r["count"] for r in parts[0].groupBy(F.shiftright("_at", 33)).count().collect()]
    assert len(shares) == 8 and max(shares) < 3_000  # no task had all rows
    again = dense_ids(df.repartition(3), ["at"], "no", start=11, partitions=5).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_ids_of_awkward_tables(spark):
    rows = [(None, "b", 5), (2, None, 6), (None, "a", 7), (1, "x", 8), (1, "x", 8)]
    df = spark.createDataFrame(rows, "a int, b string, id int")
    got = dense_ids(df, ["a", "b"], "id")
    assert got.columns == ["a", "b", "id"]
    assert sorted(tuple(r) for r in got.select("id", "a", "b").collect()) == [(1, None, "a"), (2, None, "b"), (3, 1, "x"), (4, 1, "x"), (5, 2, None)]
    by_old = dense_ids(df, ["id"]).collect()  # the column that is replaced may be the order
    assert sorted((r["id"], r["b"] or "") for r in by_old) == [(1, "b"), (2, ""), (3, "a"), (4, "x"), (5, "x")]
    assert dense_ids(df.limit(0), ["a"]).collect() == [] and next_id(df.limit(0)) == 1 and next_id(df) == 9


def test_children_name_their_headers_new_id(spark):
    headers = spark.createDataFrame([(7, 3), (5, 1), (6, 2)], "request_id bigint, at int")
    lines = spark.createDataFrame([(6, 2), (5, 1), (6, 1), (9, 1)], "request_id bigint, line_no int")
    out = insert_ids(headers, {"lines": (lines, ["line_no"])}, ["at"], link="sale_id", starts={"sales": 100, "lines": 1}, name="sales")
    assert rows_of(out["sales"].select("id", "request_id")) == [(100, 5), (101, 6), (102, 7)]
    assert rows_of(out["lines"].select("id", "sale_id", "request_id", "line_no")) == [(1, 100, 5, 1), (2, 101, 6, 1), (3, 101, 6, 2)]


# --- settled changes ----------------------------------------------------------


def test_changes_of_one_key_count_in_order(spark):
    changes = spark.createDataFrame(
        [(1, "a", None, 2, 1), (1, None, 5, 1, 9), (1, "b", None, 1, 3), (2, None, None, 1, 1), (2, "c", 1, 0, 1)], "id bigint, s string, n int, requested_at int, request_id int"
    )
    order = ["requested_at", "request_id"]
    assert rows_of(settle_changes(changes, ["id"], order)) == [(1, "a", 5), (2, "c", 1)]
    assert rows_of(settle_changes(changes, ["id"], order, overwrite=True).fillna("-").fillna(0)) == [(1, "a", 0), (2, "-", 0)]
    now = spark.createDataFrame([(1, "x", 0), (2, "y", 0), (3, "z", 0)], "id bigint, s string, n int")
    assert rows_of(apply_updates(now, changes, ["id"], order=order)) == [(1, "a", 5), (2, "c", 1), (3, "z", 0)]
    doubled = changes.select("id", "s", "n")
    assert apply_updates(now, doubled, ["id"]).count() == 3


# --- the store ----------------------------------------------------------------


def broken(df):
    return df.withColumn("x", F.when(F.col("x") >= 0, F.raise_error(F.lit("stopped here"))).otherwise(F.col("x")))


def test_a_stopped_commit_leaves_readers_on_the_old_set(spark, tmp_path):
    store, numbers = Store(spark, f"{tmp_path}/s"), spark.range(10).withColumnRenamed("id", "x")
    assert store.snapshot().number == 0
    first = store.commit({"a": Replace(numbers), "b": Replace(numbers)})
    with pytest.raises(Exception, match="stopped here"):
        store.commit({"a": Append(numbers), "b": Append(broken(numbers))})
    assert store.numbers() == [1] and store.read("a").count() == 10 and store.read("b").count() == 10
    assert len(os.listdir(f"{tmp_path}/s/a")) == 1 and len(os.listdir(f"{tmp_path}/s/b")) == 1  # nothing half-written stays
    second = store.commit({"a": Append(numbers), "b": Append(numbers), "c": Replace(numbers)})
    assert second.read("a").count() == second.read("b").count() == 20
    assert first.read("a").count() == 10 and set(first.tables) == {"a", "b"}  # a reader of the old state is not disturbed


def test_of_two_commits_on_one_state_one_wins(spark, tmp_path):
    store, numbers = Store(spark, f"{tmp_path}/s"), spark.range(3).withColumnRenamed("id", "x")
    base = store.commit({"a": Replace(numbers)})
    store.commit({"a": Append(numbers)}, base=base)
    with pytest.raises(Conflict):
        store.commit({"a": Append(numbers)}, base=base)
    assert store.read("a").count() == 6 and store.numbers() == [1, 2]


def test_rollback_and_forget(spark, tmp_path):
    store, numbers = Store(spark, f"{tmp_path}/s"), spark.range(3).withColumnRenamed("id", "x")
    store.commit({"a": Replace(numbers), "b": Replace(numbers)})
    store.commit({"a": Replace(numbers.limit(1)), "b": Replace(numbers.limit(0))})
    assert store.read("b").count() == 0
    store.rollback(1)
    assert store.snapshot().number == 3 and store.read("a").count() == store.read("b").count() == 3
    gone = store.forget(keep=1)
    assert store.numbers() == [3] and {p.split("/")[0] for p in gone} == {"a", "b"} and store.read("a").count() == 3


def files(snapshot, name):
    root = snapshot.store.root
    return {no: sorted(f for f in os.listdir(f"{root}/{path}") if f.endswith(".parquet")) for no, path in snapshot.tables[name].ranges.items()}


def test_changes_rewrite_only_the_ranges_they_touch(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    rows = spark.range(-100, 10_000).select("id", (F.col("id") % 3).alias("x"), F.lit("old").alias("s"))
    before = store.commit({"t": Replace(rows, key="id", width=100)})
    assert len(before.tables["t"].ranges) == 101 and all(len(f) == 1 for f in files(before, "t").values())
    changes = spark.createDataFrame(
        [(i, "new", 1, i) for i in range(500, 600)] + [(i, "newer", 2, i) for i in range(500, 550)] + [(-7, "minus", 1, 1), (10**12, "nowhere", 1, 2), (None, "none", 1, 3)],
        "id bigint, s string, requested_at int, request_id bigint",
    )
    after = store.commit({"t": Update(changes)})
    was, now = files(before, "t"), files(after, "t")
    assert {no for no in was if was[no] != now[no]} == {-1, 5} and set(was) == set(now)
    want = {i: ("newer" if 500 <= i < 550 else "new" if 550 <= i < 600 else "minus" if i == -7 else "old") for i in range(-100, 10_000)}
    assert {r["id"]: r["s"] for r in after.read("t").collect()} == want and after.read("t").count() == len(want)
    assert rows_of(after.read("t", [-7, 505, 10**12]).select("id", "s")) == [(-7, "minus"), (505, "newer")]
    put = store.commit({"t": Put(spark.createDataFrame([(9_999, 8, "put"), (10_250, 9, "put")], "id bigint, x bigint, s string"))})
    assert {no for no in files(put, "t") if files(put, "t")[no] != files(after, "t").get(no)} == {99, 102}
    assert rows_of(put.read("t", [9_999, 10_250])) == [(9_999, 8, "put"), (10_250, 9, "put")] and put.read("t").count() == len(want) + 1
    gone = store.commit({"t": Delete(spark.range(300, 400))})
    assert 3 not in gone.tables["t"].ranges and gone.read("t").count() == len(want) - 99
    same = store.commit({"t": Update(changes.limit(0))})
    assert same.tables["t"] == gone.tables["t"]


def test_kinds_of_tables_are_not_mixed(spark, tmp_path):
    store, numbers = Store(spark, f"{tmp_path}/s"), spark.range(3)
    store.commit({"plain": Append(numbers), "keyed": Replace(numbers, key="id")})
    for name, change in (("plain", Put(numbers)), ("plain", Delete(numbers)), ("keyed", Append(numbers)), ("missing", Update(numbers))):
        with pytest.raises(ValueError):
            store.commit({name: change})
    assert store.numbers() == [1]


def test_a_posting_is_published_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    """Stopped between two of its tables, a posting leaves no trace; done again, all of its tables change at once."""
    from molinete.registry.sales import _posted
    from molinete.sources.roles import Roles

    roles = Roles(spark, "/root/testdata/sf0.001")
    store, out = Store(spark, f"{tmp_path}/s"), _posted(roles)
    names = ("sales", "sale_items", "sale_payments")
    store.commit({"products": Replace(roles.products, key="id", width=50)})
    stock = rows_of(store.read("products").select("id", "stock"))
    written, keep = [], Store._write

    def stops(self, rows, folder):
        if len(written) == 2:
            raise OSError("lost")
        written.append(folder)
        return keep(self, rows, folder)

    changes = {**{n: Append(out[n]) for n in names}, "products": Update(out["products"].select("id", "stock"))}
    with monkeypatch.context() as m:
        m.setattr(Store, "_write", stops)
        with pytest.raises(OSError, match="lost"):
            store.commit(changes)
    assert len(written) == 2 and set(store.snapshot().tables) == {"products"}
    assert rows_of(store.read("products").select("id", "stock")) == stock
    after = store.commit(changes)
    sold = after.read("sale_items").groupBy("product_id").agg(F.sum("quantity").alias("q"))
    left = roles.products.join(sold, F.col("id") == F.col("product_id"), "left").select("id", (F.col("stock") - F.coalesce("q", F.lit(0))).alias("left"))
    assert after.read("sales").count() > 0
    assert {r["id"]: r["left"] for r in left.collect()} == {r["id"]: r["stock"] for r in after.read("products").collect()}

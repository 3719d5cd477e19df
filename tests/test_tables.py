"""Sources, sinks, dimensions and deletes."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from molinete.plans import dims, quality
from molinete.schema import DOMAINS, FOREIGN_KEYS, TABLES, table_schema
from molinete.sources import tables

T0 = dt.datetime(2024, 1, 1, 8)


def test_every_table_is_declared(spark):
    assert len(TABLES) == 19
    for k in FOREIGN_KEYS:
        assert k.column in table_schema(k.child).names and k.parent in TABLES
    for table, column in DOMAINS:
        assert column in table_schema(table).names
    assert not any("password" in ddl for ddl in TABLES.values())


def test_load_append_publish(spark, tmp_path):
    plans = spark.createDataFrame([(1, "Mensual", 30, None, None, True)], table_schema("plans"))
    tables.append(plans, f"{tmp_path}/plans")
    tables.append(plans, f"{tmp_path}/plans")
    back = tables.load(spark, str(tmp_path), "plans")
    assert back.count() == 2 and back.schema.names == plans.schema.names
    first = tables.publish(plans, f"{tmp_path}/snap", "1")
    with pytest.raises(Exception):
        tables.publish(plans, f"{tmp_path}/snap", "1")
    assert spark.read.parquet(first).count() == 1


def test_conform_and_generations(spark):
    old = spark.createDataFrame([(1, " ", "ana")], "id int, EMAIL string, username string")
    new = spark.createDataFrame([(2, "b@c.d", "bea", "admin")], "id long, email string, username string, role string")
    out = tables.merge_generations(old, new, target=table_schema("users"), defaults={"role": "empleado", "active": True})
    got = {r.id: r for r in out.collect()}
    assert got[1].email is None and got[1].role == "empleado" and got[2].role == "admin" and got[2].active is True
    assert out.schema.simpleString() == table_schema("users").simpleString()


def test_documents_and_bridges(spark):
    df = spark.createDataFrame([(1, [(2, "x")])], "id int, items array<struct<n:int,s:string>>")
    assert json.loads(tables.to_document(df).first().document) == {"id": 1, "items": [{"n": 2, "s": "x"}]}
    req = spark.createDataFrame([(1, [3, 0, -1, 4])], "plan_id int, ids array<int>")
    assert {r.instructor_id for r in tables.rows_from_ids(req, "plan_id", "ids", "instructor_id").collect()} == {3, 4}


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for name, n in (("b_sales", 50), ("b_items", 500)):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            df = spark.range(n).select((F.col("id") % 50).alias("sale_id"), F.col("id").alias(name))
            df.write.mode("overwrite").option("path", f"{tmp_path}/{name}").bucketBy(4, "sale_id").sortBy("sale_id").saveAsTable(name)
        joined = spark.table("b_items").join(spark.table("b_sales"), "sale_id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("b_sales", "b_items"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_upsert_instructors_keeps_what_is_not_named(spark):
    cur = spark.createDataFrame([(1, "Ana", "10", "5", True), (2, "Bea", "20", None, True)], "id bigint, name string, dni string, phone string, active boolean")
    ch = spark.createDataFrame(
        [(1, T0, " Ana María ", None, None, None, False), (2, T0, None, "10", None, None, False), (3, T0, "Caro", " 30 ", " ", None, False), (4, T0, None, "40", None, None, False), (9, T0, None, None, None, None, True)],
        "id bigint, requested_at timestamp_ntz, name string, dni string, phone string, active boolean, deleted boolean",
    )
    out = dims.upsert_dimension(cur, ch, dims.SPECS["instructors"])
    got = {r.id: tuple(r) for r in out["table"].collect()}
    assert got[1] == (1, "Ana María", "10", "5", True) and got[3] == (3, "Caro", "30", None, True) and got[2][2] == "20"
    assert {r.id: r.reason for r in out["rejected"].collect()} == {2: "dni_taken", 4: "name_required", 9: "not_found"}


def test_upsert_users(spark):
    cur = spark.createDataFrame([(1, "admin", "A", None, "admin", True), (2, "emp", "E", "e@x.ar", "empleado", True)], "id bigint, username string, name string, email string, role string, active boolean")
    rows = [(1, T0, "admin", "A2", " ", "admin", None, None), (3, T0, "ÁDMIN ", "N", None, "empleado", None, None), (4, T0, "z", "N", "no-mail", "empleado", None, None),
            (5, T0, "y", "N", "E@X.AR", "empleado", None, None), (6, T0, "x", "N", None, "jefe", None, None), (2, T0, None, None, None, None, None, True)]
    ch = spark.createDataFrame(rows, "id bigint, requested_at timestamp_ntz, username string, name string, email string, role string, active boolean, deleted boolean")
    out = dims.upsert_dimension(cur, ch, dims.SPECS["users"])
    got = {r.id: tuple(r) for r in out["table"].collect()}
    assert got[1] == (1, "admin", "A2", None, "admin", True) and got[2] == (2, "emp", "E", "e@x.ar", "empleado", False)
    # row 2 is deleted in the batch and keeps its address
    assert {r.id: r.reason for r in out["rejected"].collect()} == {3: "username_taken", 4: "email_invalid", 5: "email_taken", 6: "role_invalid"}


def test_unique_values_change_hands_in_request_order(spark):
    t1, t2 = T0 + dt.timedelta(hours=1), T0 + dt.timedelta(hours=2)
    cur = spark.createDataFrame([(i, n, n, str(i), True) for i, n in enumerate("abcdef", 1)], "id bigint, username string, name string, dni string, active boolean")
    spec = dims.Spec(columns=("username", "name", "dni"), required=("username", "name"), unique=("username", "dni"))

    def run(rows):
        out = dims.upsert_dimension(cur, spark.createDataFrame(rows, "id bigint, requested_at timestamp_ntz, username string, name string, dni string, deleted boolean"), spec)
        assert quality.uniqueness_conflicts(out["table"], "username").count() == 0 and quality.uniqueness_conflicts(out["table"], "dni").count() == 0
        return {r.id: r.reason for r in out["rejected"].collect()}

    # given up before it is asked for, and after
    assert run([(1, T0, "x", "n", "1", None), (2, t1, "a", "n", "2", None)]) == {}
    assert run([(1, t1, "x", "n", "1", None), (2, T0, "a", "n", "2", None)]) == {2: "username_taken"}
    # a rejected or deleting change gives nothing up; a change that loses one value takes no other
    assert run([(1, T0, " ", "n", "1", None), (2, t1, "a", "n", "2", None)]) == {1: "username_required", 2: "username_taken"}
    assert run([(1, T0, None, None, None, True), (2, t1, "a", "n", "2", None)]) == {2: "username_taken"}
    assert run([(7, T0, "new", "n", "3", None), (8, t1, "new", "n", "9", None)]) == {7: "dni_taken"}
    # a chain, a swap, a doubled id
    chain = [(1, T0, "z", "n", "1", None), *[(i, T0 + dt.timedelta(minutes=i), "abcdef"[i - 2], "n", str(i), None) for i in range(2, 7)]]
    assert run(chain) == {}
    assert run([(1, T0, "b", "n", "1", None), (2, t1, "a", "n", "2", None)]) == {1: "username_taken", 2: "username_taken"}
    assert run([(1, T0, "q", "n", "1", None), (1, t2, "r", "n", "1", None), (2, t1, "a", "n", "2", None)]) == {1: "superseded", 2: "username_taken"}


def test_delete_propagates(spark):
    t = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    db = {
        "instructors": t([(1,), (2,)], "id bigint"),
        "plan_instructors": t([(7, 1), (7, 2)], "plan_id bigint, instructor_id bigint"),
        "memberships": t([(1, 1, 7), (2, 2, 7)], "id bigint, instructor_id bigint, plan_id bigint"),
        "plans": t([(7,), (8,)], "id bigint"),
    }
    out = dims.delete_with_propagation(db, "instructors", t([(1,)], "id bigint"))
    assert out["plan_instructors"].collect() == [(7, 2)] and out["instructors"].count() == 1
    assert {tuple(r) for r in out["memberships"].collect()} == {(1, None, 7), (2, 2, 7)} and out["blocked"].count() == 0
    out = dims.delete_with_propagation(db, "plans", t([(7,), (8,)], "id bigint"))
    assert [r.id for r in out["plans"].collect()] == [7]
    assert [tuple(r) for r in out["blocked"].collect()] == [(7, "memberships", "plan_id")]


def test_deletion_reads_each_table_once(spark, monkeypatch):
    """Entries go by their client and by their membership; both are found in one pass, and what holds a client stops all of it."""
    t = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    db = {
        "clients": t([(i,) for i in range(1, 6)], "id bigint"),
        "memberships": t([(10 + i, i, 7, None) for i in range(1, 6)], "id bigint, client_id bigint, plan_id bigint, instructor_id bigint"),
        "client_entries": t([(1, 1, 11), (2, 1, 12), (3, 2, 11), (4, 3, None), (5, None, 13), (6, 4, 14)], "id bigint, client_id bigint, membership_id bigint"),
        "membership_payments": t([(1, 11), (2, 15)], "id bigint, membership_id bigint"),
        "notes": t([(1, 15)], "id bigint, membership_id bigint"),
        "sales": t([(1, 1), (2, 2)], "id bigint, client_id bigint"),
    }
    keys = [*dims.FOREIGN_KEYS, dims.ForeignKey("notes", "membership_id", "memberships", "RESTRICT")]
    order = [name for name, _ in dims._in_order("clients", db, keys)]
    assert sorted(order) == ["client_entries", "membership_payments", "memberships", "notes"] and order.index("memberships") == 0
    written = []
    monkeypatch.setattr(dims, "durable", lambda df, keep=dims.durable: written.append(1) or keep(df))
    out = dims.delete_with_propagation(db, "clients", t([(1,), (3,), (5,), (99,)], "id bigint"), foreign_keys=keys)
    ids = lambda name: sorted(r.id for r in out[name].collect())
    assert [tuple(r) for r in out["blocked"].collect()] == [(5, "notes", "membership_id")]
    assert ids("clients") == [2, 4, 5] and ids("memberships") == [12, 14, 15] and ids("client_entries") == [6]
    assert ids("membership_payments") == [2] and sorted(map(tuple, out["sales"].collect())) == [(1, None), (2, 2)]
    assert len(written) == 1 + len(order)
    with pytest.raises(ValueError, match="go round"):
        dims._in_order("a", {"a": None, "b": None, "c": None}, [dims.ForeignKey("b", "x", "a", "CASCADE"), dims.ForeignKey("c", "x", "b", "CASCADE"), dims.ForeignKey("b", "y", "c", "CASCADE")])


def test_audits(spark):
    users = spark.createDataFrame([(1, "Ana "), (2, "áNA"), (3, None), (4, None), (5, "Bea")], "id bigint, username string")
    assert {r.id for r in quality.uniqueness_conflicts(users, "username").collect()} == {1, 2}
    db = {"users": users, "notices": spark.createDataFrame([(1, 9, "info"), (2, 9, "ojo"), (3, 1, None)], "id bigint, created_by bigint, type string")}
    assert [tuple(r) for r in quality.fk_audit(db).collect()] == [("notices", "created_by", "users", 9, 2)]
    assert [tuple(r) for r in quality.domain_audit(db).collect()] == [("notices", "type", "ojo", 1)]

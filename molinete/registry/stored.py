"""Ids handed out, and tables that are published together."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from molinete.operators.numbering import dense_ids, insert_ids, next_id
from molinete.registry.core import query
from molinete.registry.sales import _WALK, _posted, sale_requests
from molinete.session import work_folder
from molinete.sources.roles import Roles
from molinete.sources.store import Append, Delete, Put, Replace, Store, Update
from molinete.sources.tables import append, merge_generations


def _store(r: Roles) -> Store:
    return Store(r.spark, f"{work_folder(r.spark)}/store-{uuid.uuid4().hex}")


@query("dense_ids", "SELECT id AS sale_id, client_id, created_at, row_number() OVER (ORDER BY created_at, id) AS id FROM sales")
def _(r: Roles):
    return dense_ids(r.sales.select(F.col("id").alias("sale_id"), "client_id", "created_at"), ["created_at", "sale_id"])


@query(
    "insert_ids",
    """SELECT n.id AS sale_id, n.request_id, l.product_id, l.quantity,
        (SELECT max(sale_id) FROM sale_items) + row_number() OVER (ORDER BY n.id, l.product_id) AS id
    FROM (SELECT o_orderkey AS request_id, (SELECT max(id) FROM sales) + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id FROM orders) n
    JOIN sale_request_lines l ON l.request_id = n.request_id""",
)
def _(r: Roles):
    starts = {"sales": next_id(r.sales), "sale_items": next_id(r.sale_items, "sale_id")}
    requests = sale_requests(r).select("request_id", "requested_at", "client_id")
    lines = {"sale_items": (r.sale_request_lines.select("request_id", "product_id", "quantity"), ["product_id"])}
    return insert_ids(requests, lines, ["requested_at", "request_id"], link="sale_id", starts=starts, name="sales")["sale_items"]


@query(
    "published_sales",
    f"""WITH RECURSIVE {_WALK}, taken AS (SELECT * FROM verdict WHERE reason IS NULL),
        opened AS (SELECT count(*) AS n FROM cash_sessions WHERE status = 'open')
    SELECT 'sales' AS name, count(*) AS n, CAST(sum(subtotal - off) AS DECIMAL(38,3)) AS total FROM taken
    UNION ALL SELECT 'sale_items', count(*), CAST(sum(a.line_total) AS DECIMAL(38,3)) FROM asked a JOIN taken USING (request_id)
    UNION ALL SELECT 'sale_payments', count(*), CAST(sum(subtotal - off) AS DECIMAL(38,3)) FROM taken
    UNION ALL SELECT 'stock_movements', count(*), CAST(-sum(a.quantity) AS DECIMAL(38,3)) FROM asked a JOIN taken USING (request_id)
    UNION ALL SELECT 'cash_movements', count(*), CAST(sum(subtotal - off) AS DECIMAL(38,3)) FROM taken, opened WHERE method_no <> '4' AND subtotal - off > 0 AND opened.n > 0
    UNION ALL SELECT 'current_account', (SELECT count(*) FROM current_account) + count(*),
        CAST((SELECT sum(amount) FROM current_account) + sum(subtotal - off) AS DECIMAL(38,3)) FROM taken WHERE method_no = '4' AND subtotal - off > 0
    UNION ALL SELECT 'products', count(*), CAST(sum(coalesce(w.v, p.stock)) AS DECIMAL(38,3)) FROM products p LEFT JOIN walk w ON w.k = 1 AND w.id = p.id""",
)
def _(r: Roles):
    """All tables of a posting are published by one commit on top of ledger and stock; read back, they hold what was posted."""
    store = _store(r)
    ledger = r.current_account
    store.commit({"current_account": Replace(ledger), "products": Replace(r.products, key="id", width=1_000)})
    out = _posted(r)
    facts = ("sales", "sale_items", "sale_payments", "stock_movements", "cash_movements")
    entries = out["current_account"].select(*[(F.col(c) if c in out["current_account"].columns else F.lit(None)).alias(c) for c in ledger.columns])
    stock = out["products"].select("id", "stock")
    after = store.commit({**{n: Append(out[n]) for n in facts}, "current_account": Append(entries), "products": Update(stock)})
    measure = {"sales": "total", "sale_items": "subtotal", "stock_movements": "quantity", "products": "stock"}
    rows = [
        after.read(n).agg(F.count(F.lit(1)).alias("n"), F.sum(measure.get(n, "amount")).cast("decimal(38,3)").alias("total")).select(F.lit(n).alias("name"), "n", "total")
        for n in (*facts, "current_account", "products")
    ]
    out = rows[0]
    for one in rows[1:]:
        out = out.unionByName(one)
    return out


@query(
    "published_membership_updates",
    """WITH one AS (SELECT CAST(max(id) // 100 AS BIGINT) AS top, max(id) AS last FROM memberships)
    SELECT m.id, m.plan_id, CASE WHEN m.id <= top AND m.id % 2 = 0 THEN 'cancelled' WHEN m.id <= top THEN 'expired' ELSE m.status END AS status,
        CASE WHEN m.id <= top THEN 'pending' ELSE m.payment_status END AS payment_status FROM memberships m, one WHERE m.id <> last
    UNION ALL SELECT last + id, plan_id, status, payment_status FROM memberships, one WHERE id <= top AND id > 0""",
)
def _(r: Roles):
    """A keyed table is changed in place of its first hundredth, gets new rows behind its last and loses one: only the ranges of these keys are written again."""
    store = _store(r)
    rows = r.memberships.select("id", "plan_id", "status", "payment_status", "created_at")
    store.commit({"memberships": Replace(rows, key="id", width=500)})
    last = next_id(rows) - 1
    first = rows.filter(F.col("id") <= last // 100)
    asked = first.select("id", F.lit("expired").alias("status"), F.lit("pending").alias("payment_status"), F.col("created_at").alias("requested_at"), F.lit(1).alias("request_id"))
    again = first.filter("id % 2 = 0").select("id", F.lit("cancelled").alias("status"), F.lit(None).alias("payment_status"), F.col("created_at").alias("requested_at"), F.lit(2).alias("request_id"))
    store.commit({"memberships": Update(asked.unionByName(again))})
    store.commit({"memberships": Put(first.filter("id > 0").withColumn("id", F.col("id") + last))})
    store.commit({"memberships": Delete(r.spark.range(last, last + 1))})
    return store.read("memberships").select("id", "plan_id", "status", "payment_status")


@query("appended_entries", "SELECT id, client_id, entered_at, CAST(date_trunc('month', entered_at) AS DATE) AS month FROM client_entries")
def _(r: Roles):
    """Entries appended in two goes to a table that is partitioned by month, and read back."""
    rows = r.client_entries.select("id", "client_id", "entered_at").withColumn("month", F.date_trunc("month", "entered_at").cast("date"))
    path = f"{work_folder(r.spark)}/entries-{uuid.uuid4().hex}"
    for half in (0, 1):
        append(rows.filter(F.col("id") % 2 == half), path, partition_by="month")
    return r.spark.read.schema(rows.schema).parquet(path)


@query(
    "merged_generations",
    """SELECT id, username, name, CASE WHEN id % 2 = 1 AND trim(email) <> '' THEN email END AS email, CASE WHEN id % 2 = 0 THEN 'empleado' ELSE role END AS role, active FROM users""",
)
def _(r: Roles):
    """Files of before e-mail and role existed next to newer ones, written and read back as one table: missing roles get their default, blank e-mails are none."""
    path = f"{work_folder(r.spark)}/users-{uuid.uuid4().hex}"
    users = r.users.select("id", "username", "name", "email", "role", "active")
    append(users.filter("id % 2 = 0").drop("email", "role"), f"{path}/first")
    append(users.filter("id % 2 = 1"), f"{path}/second")
    read = lambda name, fields: r.spark.read.schema(users.select(*fields).schema).parquet(f"{path}/{name}")
    old, new = read("first", ["id", "username", "name", "active"]), read("second", users.columns)
    return merge_generations(old, new, target=users.schema, defaults={"role": "empleado"})

"""Sales and stock queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from molinete.plans import sales as S
from molinete.plans import stock as K
from molinete.registry.core import query
from molinete.schema import table_schema
from molinete.session import durable
from molinete.sources.roles import Roles
from molinete.sources.tables import conform

_LIST = """SELECT s.*, u.name AS user_name, c.name AS client_name FROM sales s LEFT JOIN users u ON u.id = s.user_id
    LEFT JOIN clients c ON c.id = s.client_id"""


@query("list_sales", _LIST + " WHERE s.status = 'completed'")
def _(r: Roles):
    return S.list_sales(r.sales, r.users, r.clients, status="completed", payment_method="bitcoin", page=None)


@query(
    "list_sales_page",
    _LIST
    + """ WHERE s.created_at >= TIMESTAMP '1997-03-01' AND s.created_at < TIMESTAMP '1999-01-01' AND s.payment_method = 'cash'
    ORDER BY s.created_at DESC, s.id DESC LIMIT 50 OFFSET 150""",
)
def _(r: Roles):
    return S.list_sales(
        r.sales,
        r.users,
        r.clients,
        date_from="1997-03-01",
        date_to="1998-12-31",
        payment_method="cash",
        status="lost",
        page=4,
        limit=50,
    )


def _documents(part: int) -> str:
    """Each item and each payment once, in the part its number within the sale says."""
    return f"""WITH i AS (SELECT sale_id, (no - 1) // {part} AS part,
            string_agg(line_no || ':' || product_id || ':' || product_name || ':' || quantity || ':' || subtotal, ';' ORDER BY no) AS items
        FROM (SELECT *, row_number() OVER (PARTITION BY sale_id ORDER BY line_no, product_id, quantity, subtotal) AS no FROM sale_items)
        GROUP BY 1, 2),
    p AS (SELECT sale_id, (no - 1) // {part} AS part, string_agg(payment_method || ':' || amount, ';' ORDER BY no) AS payments
        FROM (SELECT *, row_number() OVER (PARTITION BY sale_id ORDER BY payment_method, amount) AS no FROM sale_payments)
        GROUP BY 1, 2),
    b AS (SELECT coalesce(i.sale_id, p.sale_id) AS sale_id, coalesce(i.part, p.part) AS part, items, payments
        FROM i FULL JOIN p ON p.sale_id = i.sale_id AND p.part = i.part)
    SELECT s.id, CAST(coalesce(b.part, 0) AS BIGINT) AS part, s.total, u.name AS user_name, c.name AS client_name,
        coalesce(b.items, '') AS items, coalesce(b.payments, '') AS payments
    FROM sales s LEFT JOIN users u ON u.id = s.user_id LEFT JOIN clients c ON c.id = s.client_id LEFT JOIN b ON b.sale_id = s.id"""


def _document_rows(r: Roles, part: int):
    def line(i):
        return F.concat_ws(
            ":",
            i["line_no"].cast("string"),
            i["product_id"].cast("string"),
            i["product_name"],
            i["quantity"].cast("string"),
            i["subtotal"].cast("string"),
        )

    def payment(p):
        return F.concat_ws(":", p["payment_method"], p["amount"].cast("string"))

    documents = S.sale_documents(r.sales, r.sale_items, r.sale_payments, r.users, r.clients, part=part)
    return documents.select(
        "id",
        "part",
        "total",
        "user_name",
        "client_name",
        F.array_join(F.transform("items", line), ";").alias("items"),
        F.array_join(F.transform("payments", payment), ";").alias("payments"),
    )


@query("sale_documents", _documents(10_000))
def _(r: Roles):
    return _document_rows(r, 10_000)


@query("sale_document_parts", _documents(2))
def _(r: Roles):
    return _document_rows(r, 2)


@query(
    "sale_audit",
    """SELECT * FROM (SELECT s.id, s.subtotal, CAST(coalesce(i.t, 0) AS DECIMAL(38,2)) AS items_total, s.total,
        CAST(coalesce(p.t, 0) AS DECIMAL(38,2)) AS paid_total, coalesce(i.t, 0) = s.subtotal AS items_ok,
        s.subtotal - s.discount = s.total AS total_ok, abs(coalesce(p.t, 0) - s.total) <= 0.01 AS payments_ok
    FROM sales s LEFT JOIN (SELECT sale_id, sum(subtotal) AS t FROM sale_items GROUP BY sale_id) i ON i.sale_id = s.id
    LEFT JOIN (SELECT sale_id, sum(amount) AS t FROM sale_payments GROUP BY sale_id) p ON p.sale_id = s.id)
    WHERE NOT (items_ok AND total_ok AND payments_ok)""",
)
def _(r: Roles):
    return S.sale_audit(r.sales, r.sale_items, r.sale_payments)


# --- posting ------------------------------------------------------------------


def sale_requests(r: Roles):
    """One request per order, with its lines summed per product and a payment by order priority."""
    key = F.col("o_orderkey")
    digit = F.substring("o_orderpriority", 1, 1)
    items = r.sale_request_lines.groupBy("request_id").agg(
        F.sort_array(F.collect_list(F.struct("product_id", "quantity"))).alias("items")
    )
    no_split = F.array().cast("array<struct<payment_method:string,amount:decimal(12,2)>>")
    return (
        r.raw("orders")
        .select(
            key.alias("request_id"),
            F.col("o_orderdate").alias("requested_at"),
            (key % 25).alias("user_id"),
            F.when(key % 13 != 0, F.col("o_custkey")).alias("client_id"),
            F.when(digit == "1", "cash")
            .when(digit == "2", "transfer")
            .when(digit == "3", "credit_card")
            .when(digit == "4", "current_account")
            .otherwise("cheque")
            .alias("payment_method"),
            no_split.alias("payments"),
            (key % 5 - 1).cast("decimal(12,2)").alias("discount"),
            F.when(key % 2 == 0, " ").otherwise(" nota ").alias("notes"),
        )
        .join(items, "request_id", "left")
    )


def _posted(r: Roles):
    return S.post_sales(durable(sale_requests(r)), r.products, r.clients, r.cash_sessions, r.current_account)


# One recursive step per sale in request order; ``walk`` keeps one row per key: (0, 0) the sale just decided,
# (1, product) what is left of it, (2, sale) whether it was accepted.
_WALK = """asked AS (SELECT q.request_id, q.product_id, q.quantity, p.id IS NULL AS unknown, p.name, p.code, p.unit, p.sale_price,
        CAST(round(p.sale_price * q.quantity, 2) AS DECIMAL(12,2)) AS line_total
        FROM sale_request_lines q LEFT JOIN products p ON p.id = q.product_id AND p.active WHERE q.product_id <> 0),
    summed AS (SELECT request_id, bool_or(unknown) AS unknown, sum(line_total) AS subtotal FROM asked GROUP BY request_id),
    req AS (SELECT o.o_orderkey AS request_id, o.o_orderdate AS requested_at, substr(o_orderpriority, 1, 1) AS method_no,
            CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey END AS client_id, s.subtotal,
            CAST(greatest(0, o_orderkey % 5 - 1) AS DECIMAL(12,2)) AS off, CASE WHEN s.request_id IS NULL THEN 'no_items'
                WHEN s.unknown THEN 'product_not_found' END AS early,
            CASE WHEN substr(o_orderpriority, 1, 1) = '5' THEN 'invalid_payment_method'
                WHEN substr(o_orderpriority, 1, 1) = '4' AND o_orderkey % 13 = 0 THEN 'client_required'
                WHEN substr(o_orderpriority, 1, 1) = '4' AND o_custkey % 10 = 0 THEN 'client_not_found' END AS late
        FROM orders o LEFT JOIN summed s ON s.request_id = o.o_orderkey),
    ranked AS (SELECT request_id, late IS NOT NULL AS dry, row_number() OVER (ORDER BY requested_at, request_id) AS n
        FROM req WHERE early IS NULL),
    todo AS MATERIALIZED (SELECT k.n, k.dry, a.product_id AS p, a.quantity AS q FROM ranked k JOIN asked a ON a.request_id = k.request_id),
    walk(k, id, v) USING KEY (k, id) AS (
        SELECT 0 AS k, CAST(0 AS BIGINT) AS id, CAST(0 AS DECIMAL(18,3)) AS v
        UNION ALL SELECT 1, id, CAST(stock AS DECIMAL(18,3)) FROM products WHERE active
        UNION
        SELECT kind, CASE kind WHEN 0 THEN 0 WHEN 1 THEN p ELSE n END,
            CAST(CASE kind WHEN 0 THEN n WHEN 1 THEN level - q ELSE CAST(fits AS INTEGER) END AS DECIMAL(18,3))
        FROM (SELECT t.n, t.dry, t.p, t.q, r.v AS level, bool_and(r.v >= t.q) OVER () AS fits
            FROM walk w JOIN todo t ON w.k = 0 AND t.n = CAST(w.v AS BIGINT) + 1 JOIN recurring.walk r ON r.k = 1 AND r.id = t.p) s,
            (VALUES (0), (1), (2)) kinds(kind) WHERE kind <> 1 OR (fits AND NOT dry)),
    verdict AS (SELECT q.*, coalesce(q.early, CASE WHEN w.v = 0 THEN 'insufficient_stock' END, q.late) AS reason
        FROM req q LEFT JOIN ranked k ON k.request_id = q.request_id LEFT JOIN walk w ON w.k = 2 AND w.id = k.n)"""


@query(
    "post_sales_rejected", f"WITH RECURSIVE {_WALK} SELECT request_id, reason FROM verdict WHERE reason IS NOT NULL"
)
def _(r: Roles):
    return _posted(r)["rejected"]


@query(
    "post_sales_sales",
    f"""WITH RECURSIVE {_WALK} SELECT request_id AS id, request_id % 25 AS user_id, client_id,
        (SELECT id FROM cash_sessions WHERE status = 'open') AS cash_session_id,
        CASE WHEN method_no <> '4' AND subtotal - off > 0 THEN 288230376151711744 + request_id * 32768 + 1 END AS cash_movement_id,
        CASE method_no WHEN '1' THEN 'cash' WHEN '2' THEN 'transfer' WHEN '3' THEN 'credit_card' ELSE 'current_account' END AS payment_method,
        CAST(subtotal AS DECIMAL(38,2)) AS subtotal, off AS discount, CAST(subtotal - off AS DECIMAL(38,2)) AS total,
        'completed' AS status, CASE WHEN request_id % 2 <> 0 THEN 'nota' END AS notes, requested_at AS created_at
    FROM verdict WHERE reason IS NULL""",
)
def _(r: Roles):
    return _posted(r)["sales"]


@query(
    "post_sales_products",
    f"""WITH RECURSIVE {_WALK} SELECT p.id, CAST(coalesce(w.v, p.stock) AS DECIMAL(18,3)) AS stock FROM products p
    LEFT JOIN walk w ON w.k = 1 AND w.id = p.id""",
)
def _(r: Roles):
    return _posted(r)["products"].select("id", "stock")


@query(
    "post_sales_items",
    f"""WITH RECURSIVE {_WALK} SELECT a.request_id AS sale_id, a.product_id, a.name AS product_name, a.code AS product_code, a.quantity, a.unit,
        CAST(a.sale_price AS DECIMAL(12,2)) AS unit_price, a.line_total AS subtotal FROM asked a JOIN verdict v USING (request_id) WHERE v.reason IS NULL""",
)
def _(r: Roles):
    return _posted(r)["sale_items"].select("sale_id", "product_id", "product_name", "product_code", "quantity", "unit", "unit_price", "subtotal")


@query(
    "post_sales_stock_movements",
    f"""WITH RECURSIVE {_WALK} SELECT a.request_id AS source_id, a.product_id, 'salida' AS type, CAST(-a.quantity AS DECIMAL(12,3)) AS quantity,
        'Venta #' || a.request_id AS notes, a.request_id % 25 AS created_by, v.requested_at AS created_at
    FROM asked a JOIN verdict v USING (request_id) WHERE v.reason IS NULL""",
)
def _(r: Roles):
    return _posted(r)["stock_movements"].select("source_id", "product_id", "type", "quantity", "notes", "created_by", "created_at")


@query(
    "post_sales_cash_movements",
    f"""WITH RECURSIVE {_WALK} SELECT request_id AS source_id, (SELECT id FROM cash_sessions WHERE status = 'open') AS cash_session_id, 'sale' AS type,
        CASE method_no WHEN '1' THEN 'cash' WHEN '2' THEN 'transfer' ELSE 'credit_card' END AS payment_method, CAST(subtotal - off AS DECIMAL(12,2)) AS amount,
        'Venta #' || request_id AS description FROM verdict WHERE reason IS NULL AND method_no <> '4' AND subtotal - off > 0""",
)
def _(r: Roles):
    return _posted(r)["cash_movements"].select("source_id", "cash_session_id", "type", "payment_method", "amount", "description")


@query(
    "post_sales_ledger",
    f"""WITH RECURSIVE {_WALK}, opening AS (SELECT client_id, balance FROM current_account
        QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY created_at DESC, id DESC) = 1)
    SELECT q.request_id AS source_id, q.client_id, CAST(q.subtotal - q.off AS DECIMAL(12,2)) AS amount,
        'Venta #' || q.request_id AS description, CAST(coalesce(o.balance, 0) + sum(q.subtotal - q.off) OVER (PARTITION BY q.client_id
        ORDER BY q.requested_at, q.request_id ROWS UNBOUNDED PRECEDING) AS DECIMAL(18,2)) AS balance
    FROM verdict q LEFT JOIN opening o ON o.client_id = q.client_id
    WHERE q.reason IS NULL AND q.method_no = '4' AND q.subtotal - q.off > 0""",
)
def _(r: Roles):
    return _posted(r)["current_account"].select("source_id", "client_id", "amount", "description", "balance")


@query(
    "post_sales_links",
    f"""WITH RECURSIVE {_WALK} SELECT request_id AS sale_id, 288230376151711744 + request_id * 32768 + 1 AS id,
        CAST(subtotal - off AS DECIMAL(12,2)) AS amount,
        CASE WHEN method_no <> '4' AND subtotal - off > 0 THEN 288230376151711744 + request_id * 32768 + 1 END AS cash_movement_id,
        CASE WHEN method_no <> '4' AND subtotal - off > 0 THEN 288230376151711744 + request_id * 32768 + 1 END AS header_movement_id
    FROM verdict WHERE reason IS NULL""",
)
def _(r: Roles):
    out = _posted(r)
    header = out["sales"].select(F.col("id").alias("sale_id"), F.col("cash_movement_id").alias("header_movement_id"))
    return out["sale_payments"].join(header, "sale_id").select("sale_id", "id", "amount", "cash_movement_id", "header_movement_id")


@query(
    "post_then_cancel_sales",
    f"""WITH RECURSIVE {_WALK} SELECT count(*) AS posted, count(*) AS cancelled, CAST(0 AS DECIMAL(38,2)) AS drawer_net,
        CAST(0 AS BIGINT) AS products_changed, CAST(0 AS DECIMAL(38,2)) AS ledger_net FROM verdict WHERE reason IS NULL""",
)
def _(r: Roles):
    """Everything posted goes into its tables as it is and is cancelled from there: nothing is left in drawer, stock and ledger."""
    out = _posted(r)
    put = lambda name, rows: durable(conform(rows, table_schema(name)))
    names = ("sales", "sale_items", "sale_payments", "cash_movements", "current_account", "products")
    stored = {name: put(name, out[name]) for name in names}
    undo = stored["sales"].select(
        F.col("id").alias("request_id"), F.expr("created_at + INTERVAL 1 DAY").alias("requested_at"), F.col("id").alias("sale_id"), F.col("user_id").alias("created_by")
    )
    back = S.cancel_sales(
        undo, *(stored[n] for n in ("sales", "sale_items", "sale_payments", "cash_movements")), r.cash_sessions, stored["current_account"], stored["products"]
    )
    signed = F.when(F.col("type").isin("expense", "debit"), -F.col("amount")).otherwise(F.col("amount"))
    net = lambda name: stored[name].select("type", "amount").unionByName(back[name].select("type", "amount")).agg(F.coalesce(F.sum(signed), F.lit(0)).cast("decimal(38,2)")).scalar()
    before, after = r.products.select("id", F.col("stock").alias("_was")), back["products"].select("id", "stock")
    changed = before.join(after, "id").filter("_was <> stock").agg(F.count("*")).scalar()
    return stored["sales"].agg(F.count("*").alias("posted")).select(
        "posted",
        back["cancelled"].agg(F.count("*")).scalar().alias("cancelled"),
        net("cash_movements").alias("drawer_net"),
        changed.alias("products_changed"),
        net("current_account").alias("ledger_net"),
    )


@query(
    "price_sale_lines",
    """SELECT q.request_id, q.product_id, p.name AS product_name, q.quantity,
        CAST(round(p.sale_price * q.quantity, 2) AS DECIMAL(12,2)) AS subtotal
    FROM sale_request_lines q LEFT JOIN products p ON p.id = q.product_id AND p.active WHERE q.product_id <> 0""",
)
def _(r: Roles):
    return S.price_lines(sale_requests(r), r.products).select(
        "request_id", "product_id", "product_name", "quantity", "subtotal"
    )


def _cancelled(r: Roles):
    requests = r.raw("orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.col("o_orderdate").alias("requested_at"),
        (F.col("o_orderkey") - F.col("o_orderkey") % 2).alias("sale_id"),
        (F.col("o_orderkey") % 25).alias("created_by"),
    )
    # Payment rows that belong to no sale leave every fourth sale its header alone.
    payments = r.sale_payments.withColumn("sale_id", F.when(F.col("sale_id") % 4 == 0, -F.col("sale_id")).otherwise(F.col("sale_id")))
    return S.cancel_sales(
        requests, r.sales, r.sale_items, payments, r.cash_movements, _sessions_one_open(r), r.current_account
    )


def _sessions_one_open(r: Roles):
    """Session 28 is the open one: sales of even ids belong to it."""
    return r.cash_sessions.withColumn("status", F.when(F.col("id") == 28, "open").otherwise("closed"))


_CANCEL = """req AS (SELECT o_orderkey AS request_id, o_orderdate AS asked_at, o_orderkey - o_orderkey % 2 AS sale_id FROM orders),
    judged AS (SELECT r.*, s.client_id, s.cash_session_id, s.payment_method AS header_method, s.total, s.cash_movement_id AS header_movement,
        CASE WHEN s.id IS NULL THEN 'sale_not_found' WHEN s.status = 'cancelled' THEN 'sale_already_cancelled'
            WHEN s.cash_session_id <> 28 THEN 'session_closed'
            WHEN row_number() OVER (PARTITION BY r.sale_id ORDER BY r.asked_at, r.request_id) > 1 THEN 'sale_already_cancelled' END AS reason
        FROM req r LEFT JOIN sales s ON s.id = r.sale_id),
    good AS (SELECT * FROM judged WHERE reason IS NULL),
    rows AS (SELECT * REPLACE (CASE WHEN sale_id % 4 = 0 THEN -sale_id ELSE sale_id END AS sale_id) FROM sale_payments),
    paid AS (SELECT g.*, p.payment_method AS method, p.amount, p.cash_movement_id AS movement FROM good g JOIN rows p ON p.sale_id = g.sale_id
        UNION ALL SELECT g.*, g.header_method, g.total, g.header_movement FROM good g WHERE g.sale_id NOT IN (SELECT sale_id FROM rows))"""


@query("cancel_sales_rejected", f"WITH {_CANCEL} SELECT request_id, reason FROM judged WHERE reason IS NOT NULL")
def _(r: Roles):
    return _cancelled(r)["rejected"]


@query(
    "cancel_sales_stock",
    f"""WITH {_CANCEL} SELECT g.sale_id AS source_id, i.product_id, i.quantity, 'entrada' AS type,
        'Cancelación venta #' || g.sale_id AS notes FROM good g JOIN sale_items i ON i.sale_id = g.sale_id""",
)
def _(r: Roles):
    return _cancelled(r)["stock_movements"].select("source_id", "product_id", "quantity", "type", "notes")


@query(
    "cancel_sales_refunds",
    f"""WITH {_CANCEL} SELECT p.sale_id, p.cash_session_id, 'expense' AS type, v.payment_method, v.amount
    FROM paid p JOIN cash_movements v ON v.id = p.movement""",
)
def _(r: Roles):
    return _cancelled(r)["cash_movements"].select("sale_id", "cash_session_id", "type", "payment_method", "amount")


@query(
    "cancel_sales_ledger",
    f"""WITH {_CANCEL}, opening AS (SELECT client_id, balance FROM current_account
        QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY created_at DESC, id DESC) = 1)
    SELECT p.sale_id, p.client_id, p.amount, CAST(coalesce(o.balance, 0) - sum(p.amount) OVER (PARTITION BY p.client_id
        ORDER BY p.asked_at, p.request_id ROWS UNBOUNDED PRECEDING) AS DECIMAL(18,2)) AS balance
    FROM paid p LEFT JOIN opening o ON o.client_id = p.client_id
    WHERE p.method = 'current_account' AND p.client_id IS NOT NULL AND p.amount > 0""",
)
def _(r: Roles):
    return _cancelled(r)["current_account"].select("sale_id", "client_id", "amount", "balance")


# --- products and stock ---------------------------------------------------------


@query("list_products", "SELECT * FROM products WHERE active AND (name ILIKE '%ing%' OR code ILIKE '%ing%' OR description ILIKE '%ing%')")
def _(r: Roles):
    return K.list_products(r.products, search="ÍNG")


@query("list_products_by_category", "SELECT * FROM products WHERE active AND category = 'Brand#7' AND name ILIKE '%r_d%'")
def _(r: Roles):
    return K.list_products(r.products, search="r_d", category=" Brand#7 ")


_ALERT = """CASE WHEN stock <= 0 THEN 'out' WHEN min_stock > 0 AND stock < min_stock THEN 'low'
    WHEN min_stock > 0 AND stock < min_stock * 1.2 THEN 'near' END"""


@query("stock_alerts", f"SELECT *, {_ALERT} AS alert_type FROM products WHERE active AND {_ALERT} IS NOT NULL")
def _(r: Roles):
    return K.stock_alerts(r.products)


@query("stock_alerts_out", f"SELECT *, {_ALERT} AS alert_type FROM products WHERE active AND {_ALERT} = 'out'")
def _(r: Roles):
    return K.stock_alerts(r.products, kind="OUT")


@query(
    "stock_alert_counts",
    f"""SELECT count(*) FILTER (WHERE {_ALERT} = 'out') AS out, count(*) FILTER (WHERE {_ALERT} = 'low') AS low,
        count(*) FILTER (WHERE {_ALERT} = 'near') AS near FROM products WHERE active""",
)
def _(r: Roles):
    return K.alert_counts(r.products)


_MOVES = """SELECT m.*, p.name AS product_name, p.code AS product_code, p.unit AS product_unit, u.name AS created_by_name
    FROM stock_movements m JOIN products p ON p.id = m.product_id LEFT JOIN users u ON u.id = m.created_by WHERE p.active"""


@query("list_stock_movements", _MOVES + " AND m.type = 'salida' AND (p.name ILIKE '%red%' OR p.code ILIKE '%red%')")
def _(r: Roles):
    return K.list_stock_movements(r.stock_movements, r.products, r.users, search="Red", type_="salida")


@query(
    "list_stock_movements_page",
    _MOVES + " ORDER BY m.created_at DESC, m.source_id DESC, m.product_id DESC, m.quantity LIMIT 100 OFFSET 200",
)
def _(r: Roles):
    return K.list_stock_movements(r.stock_movements, r.products, r.users, type_="unknown", page=3, limit=100)


@query(
    "product_movements",
    """SELECT m.*, u.name AS created_by_name FROM stock_movements m LEFT JOIN users u ON u.id = m.created_by
    WHERE m.product_id IN (SELECT id FROM products WHERE stock <= 0)""",
)
def _(r: Roles):
    return K.product_movements(r.stock_movements, r.users, r.products.filter("stock <= 0").select("id"))


@query(
    "running_stock",
    """SELECT m.product_id, m.created_at, m.source_id, m.quantity, CAST(p.stock + sum(m.quantity) OVER (
        PARTITION BY m.product_id ORDER BY m.created_at, m.source_id, m.quantity ROWS UNBOUNDED PRECEDING) AS DECIMAL(18,3))
        AS running_stock FROM stock_movements m JOIN products p ON p.id = m.product_id""",
)
def _(r: Roles):
    opening = r.products.select(F.col("id").alias("product_id"), F.col("stock").alias("opening_stock"))
    return K.running_stock(r.stock_movements, opening).select(
        "product_id", "created_at", "source_id", "quantity", "running_stock"
    )


@query(
    "stock_audit",
    """SELECT p.id, p.code, p.stock, CAST(coalesce(sum(m.quantity), 0) AS DECIMAL(18,3)) AS moved
    FROM products p LEFT JOIN stock_movements m ON m.product_id = p.id GROUP BY p.id, p.code, p.stock
    HAVING p.stock <> coalesce(sum(m.quantity), 0)""",
)
def _(r: Roles):
    return K.stock_audit(r.products, r.stock_movements)


def _movement_requests(r: Roles):
    """A stock movement request per event, on products that get several each."""
    kind = F.col("event_type")
    return r.raw("events").select(
        F.col("event_id").alias("request_id"),
        F.col("ts").alias("requested_at"),
        (F.col("user_id") * 7 % 205).alias("product_id"),
        F.when(kind == "signup", "entrada").when(kind.isin("purchase", "view"), "salida").otherwise("ajuste").alias("type"),
        F.when(kind == "click", -F.floor("value") % 40).otherwise(F.floor("value") % 30).cast("decimal(12,3)").alias("quantity"),
        F.lit(" ").alias("notes"),
        (F.col("user_id") % 25).alias("created_by"),
    )


_STOCK_WALK = """req AS (SELECT event_id AS request_id, ts, user_id * 7 % 205 AS product_id,
        CASE event_type WHEN 'signup' THEN 'entrada' WHEN 'purchase' THEN 'salida' WHEN 'view' THEN 'salida' ELSE 'ajuste' END AS type,
        CAST(CASE event_type WHEN 'signup' THEN floor(value) % 30 WHEN 'purchase' THEN -(floor(value) % 30) WHEN 'view' THEN -(floor(value) % 30)
            WHEN 'click' THEN -floor(value) % 40 ELSE floor(value) % 30 END AS DECIMAL(12,3)) AS delta FROM events),
    checked AS (SELECT r.*, p.stock, CASE WHEN p.id IS NULL THEN 'product_not_found' WHEN delta = 0 THEN 'quantity_is_zero' END AS early
        FROM req r LEFT JOIN products p ON p.id = r.product_id AND p.active),
    lined AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY ts, request_id) AS i FROM checked WHERE early IS NULL),
    walk AS (SELECT DISTINCT product_id, CAST(0 AS BIGINT) AS i, CAST(stock AS DECIMAL(18,3)) AS level, CAST(NULL AS BIGINT) AS request_id, true AS ok FROM lined
        UNION ALL SELECT w.product_id, l.i,
            CAST(CASE WHEN l.type = 'entrada' OR w.level + l.delta >= 0 THEN w.level + l.delta ELSE w.level END AS DECIMAL(18,3)),
            l.request_id, l.type = 'entrada' OR w.level + l.delta >= 0
        FROM walk w JOIN lined l ON l.product_id = w.product_id AND l.i = w.i + 1)"""


@query(
    "post_stock_movements",
    f"""WITH RECURSIVE {_STOCK_WALK} SELECT c.request_id AS id, c.product_id, c.type, c.delta AS quantity
    FROM walk w JOIN checked c ON c.request_id = w.request_id WHERE w.ok""",
)
def _(r: Roles):
    out = K.post_stock_movements(_movement_requests(r), r.products)["stock_movements"]
    return out.select("id", "product_id", "type", "quantity")


@query(
    "post_stock_movements_products",
    f"""WITH RECURSIVE {_STOCK_WALK} SELECT p.id, CAST(p.stock + coalesce(m.moved, 0) AS DECIMAL(18,3)) AS stock FROM products p LEFT JOIN (
        SELECT c.product_id, sum(c.delta) AS moved FROM walk w JOIN checked c ON c.request_id = w.request_id WHERE w.ok GROUP BY c.product_id) m ON m.product_id = p.id""",
)
def _(r: Roles):
    return K.post_stock_movements(_movement_requests(r), r.products)["products"].select("id", "stock")


@query(
    "post_stock_movements_rejected",
    f"""WITH RECURSIVE {_STOCK_WALK} SELECT c.request_id, coalesce(c.early, 'insufficient_stock') AS reason
    FROM checked c LEFT JOIN walk w ON c.request_id = w.request_id WHERE c.early IS NOT NULL OR NOT w.ok""",
)
def _(r: Roles):
    return K.post_stock_movements(_movement_requests(r), r.products)["rejected"]


def _product_changes(r: Roles):
    """A change per customer: ids overlap the products of the first half, codes clash now and then."""
    key = F.col("c_custkey")
    return r.raw("customer").select(
        (key * 2).alias("id"),
        F.lit("2001-06-15 10:00:00").cast("timestamp_ntz").alias("requested_at"),
        (key % 25).alias("created_by"),
        F.concat(F.lit(" Producto "), key.cast("string")).alias("name"),
        F.concat(F.lit(" p"), (key * 2 + F.when(key % 10 == 3, 1).when(key % 10 == 7, 2).otherwise(0)).cast("string")).alias("code"),
        F.lit(" ").alias("description"),
        F.col("c_mktsegment").alias("category"),
        F.when(key % 7 == 0, "gratis").otherwise(F.col("c_acctbal").cast("decimal(12,2)").cast("string")).alias("sale_price"),
        F.lit("-1").alias("cost_price"),
        (key % 3).cast("string").alias("stock_inicial"),
        F.lit("5").alias("min_stock"),
        F.when(key % 2 == 0, "kg").otherwise("litro").alias("unit"),
    )


_CHANGES = """ch AS (SELECT c_custkey * 2 AS id, 'Producto ' || c_custkey AS name,
        'P' || (c_custkey * 2 + CASE c_custkey % 10 WHEN 3 THEN 1 WHEN 7 THEN 2 ELSE 0 END) AS code, c_custkey % 10 AS d, c_mktsegment AS category,
        CASE WHEN c_custkey % 7 <> 0 AND c_acctbal >= 0 THEN CAST(c_acctbal AS DECIMAL(12,2)) ELSE 0 END AS sale_price,
        CAST(c_custkey % 3 AS DECIMAL(12,3)) AS initial, CASE WHEN c_custkey % 2 = 0 THEN 'kg' ELSE 'unidad' END AS unit FROM customer),
    -- A product keeps its code unless its own change is accepted; nobody asks for a code that is given up. Without such a product the
    -- change before (7) has taken the code that the next one (8) asks for.
    good AS (SELECT * FROM ch WHERE NOT EXISTS (SELECT 1 FROM products p WHERE p.code = ch.code AND p.id <> ch.id)
        AND NOT (d = 8 AND EXISTS (SELECT 1 FROM ch e WHERE e.id = ch.id - 2) AND NOT EXISTS (SELECT 1 FROM products p WHERE p.id = ch.id)))"""


@query(
    "upsert_products",
    f"""WITH {_CHANGES} SELECT g.id, g.name, g.code, g.category, CAST(g.sale_price AS DECIMAL(12,2)) AS sale_price,
        CAST(0 AS DECIMAL(12,2)) AS cost_price, CAST(coalesce(p.stock, g.initial) AS DECIMAL(12,3)) AS stock, g.unit, coalesce(p.active, true) AS active
    FROM good g LEFT JOIN products p ON p.id = g.id
    UNION ALL SELECT id, name, code, category, sale_price, cost_price, stock, unit, active FROM products WHERE id NOT IN (SELECT id FROM good)""",
)
def _(r: Roles):
    out = K.upsert_products(_product_changes(r), r.products)["products"]
    return out.select("id", "name", "code", "category", "sale_price", "cost_price", "stock", "unit", "active")


@query(
    "upsert_products_stock",
    f"""WITH {_CHANGES} SELECT id AS product_id, 'entrada' AS type, initial AS quantity, 'Stock inicial' AS notes FROM good
    WHERE initial > 0 AND id NOT IN (SELECT id FROM products)""",
)
def _(r: Roles):
    return K.upsert_products(_product_changes(r), r.products)["stock_movements"].select(
        "product_id", "type", "quantity", "notes"
    )

"""The same roles as DuckDB common table expressions, for the oracle queries."""

from __future__ import annotations

import re

AS_OF = "DATE '2001-06-15'"

_METHOD = """CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'cash' WHEN '2' THEN 'transfer'
    WHEN '3' THEN 'credit_card' WHEN '4' THEN 'current_account' ELSE 'combined' END"""

ROLE_SQL = {
    "users": """SELECT CAST(n_nationkey AS BIGINT) AS id, lower(n_name) AS username, n_name AS name,
        CASE WHEN n_nationkey % 5 = 0 THEN ' ' ELSE lower(n_name) || '@example.org' END AS email,
        CASE WHEN n_nationkey % 5 = 1 THEN 'admin' ELSE 'empleado' END AS role,
        n_nationkey % 6 <> 0 AS active,
        CAST(DATE '2000-01-01' + n_regionkey AS TIMESTAMP) AS created_at FROM nation""",
    "clients": """SELECT c_custkey AS id, lower(replace(c_name, '#', '_')) AS username, c_name AS name,
        '381' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS phone, lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS dni,
        c_custkey % 10 <> 0 AS active,
        CAST(DATE '2000-01-01' + CAST(c_custkey % 500 AS INTEGER) AS TIMESTAMP) AS created_at,
        CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 25 END AS created_by FROM customer""",
    "plans": """SELECT p_partkey AS id, p_name AS name, p_size AS duration_days,
        CAST(p_retailprice AS DECIMAL(10,2)) AS price, p_type AS description, p_partkey % 9 <> 0 AS active FROM part""",
    "instructors": """SELECT s_suppkey AS id, s_name AS name, lpad(CAST(s_suppkey AS VARCHAR), 12, '0') AS dni,
        '381' || lpad(CAST(s_suppkey AS VARCHAR), 7, '0') AS phone, s_suppkey % 4 <> 0 AS active FROM supplier""",
    "plan_instructors": "SELECT DISTINCT l_partkey AS plan_id, l_suppkey AS instructor_id FROM lineitem",
    "memberships": f"""SELECT o_orderkey AS id, o_custkey AS client_id, p_partkey AS plan_id,
        CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 10 END AS instructor_id,
        CAST(o_orderdate AS DATE) AS start_date, CAST(o_orderdate AS DATE) + p_size AS end_date,
        CASE WHEN o_orderstatus = 'P' THEN 'cancelled' WHEN o_orderstatus = 'F' AND o_orderkey % 2 <> 0 THEN 'expired'
            ELSE 'active' END AS status,
        {_METHOD} AS payment_method,
        CASE WHEN substr(o_orderpriority, 1, 1) = '4' THEN 'pending' ELSE 'paid' END AS payment_status,
        CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2', '3') THEN o_orderkey END AS cash_movement_id,
        CAST(o_orderkey % 5 * 10 AS DECIMAL(12,2)) AS discount,
        CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '5' WHEN 2 THEN '5,3' ELSE '3' END AS reminder_sent_days,
        CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 25 END AS created_by, o_orderdate AS created_at
        FROM orders JOIN part ON p_partkey = o_orderkey % 200""",
    "membership_due": """SELECT m.id, m.payment_method,
        CAST(greatest(0, p.price - m.discount) + CASE WHEN m.id % 17 = 0 THEN 1 ELSE 0 END AS DECIMAL(12,2)) AS total
        FROM memberships m JOIN plans p ON p.id = m.plan_id""",
    "membership_payments": """SELECT * REPLACE (CASE WHEN membership_id % 3 = 0 THEN -membership_id ELSE membership_id END AS membership_id) FROM (
        SELECT id AS membership_id, payment_method, total AS amount,
            CASE WHEN payment_method <> 'current_account' THEN id END AS cash_movement_id
        FROM membership_due WHERE payment_method <> 'combined'
        UNION ALL SELECT id, 'cash', CAST(round(total * 0.40, 2) AS DECIMAL(12,2)), id
        FROM membership_due WHERE payment_method = 'combined'
        UNION ALL SELECT id, 'transfer', CAST(total - round(total * 0.40, 2) AS DECIMAL(12,2)), id
        FROM membership_due WHERE payment_method = 'combined')""",
    "sales": f"""SELECT o_orderkey AS id, o_orderkey % 25 AS user_id,
        CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey END AS client_id, o_orderkey % 30 AS cash_session_id,
        CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2', '3') THEN o_orderkey END AS cash_movement_id,
        {_METHOD} AS payment_method,
        CAST(CAST(o_totalprice AS DECIMAL(12,2)) + o_orderkey % 5 AS DECIMAL(12,2)) AS subtotal,
        CAST(o_orderkey % 5 AS DECIMAL(12,2)) AS discount, CAST(o_totalprice AS DECIMAL(12,2)) AS total,
        CASE WHEN o_orderstatus = 'P' THEN 'cancelled' ELSE 'completed' END AS status, o_orderdate AS created_at
        FROM orders""",
    "sale_payments": """SELECT id AS sale_id, payment_method, total AS amount,
            CASE WHEN payment_method <> 'current_account' THEN id END AS cash_movement_id
        FROM sales WHERE payment_method <> 'combined'
        UNION ALL SELECT id, 'cash', CAST(round(total * 0.40, 2) AS DECIMAL(12,2)), id
        FROM sales WHERE payment_method = 'combined'
        UNION ALL SELECT id, 'transfer', CAST(total - round(total * 0.40, 2) AS DECIMAL(12,2)), id
        FROM sales WHERE payment_method = 'combined'""",
    "sale_items": """SELECT l_orderkey AS sale_id, l_linenumber AS line_no, l_partkey AS product_id,
        p_name AS product_name, p_brand AS product_code, CAST(l_quantity AS DECIMAL(12,3)) AS quantity,
        'unidad' AS unit, CAST(p_retailprice AS DECIMAL(12,2)) AS unit_price,
        CAST(l_extendedprice AS DECIMAL(12,2)) AS subtotal FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "products": """SELECT p_partkey AS id, p_name AS name, 'P' || p_partkey AS code, p_type AS description,
        p_brand AS category, CAST(p_retailprice AS DECIMAL(12,2)) AS sale_price,
        CAST(round(CAST(p_retailprice AS DECIMAL(12,2)) * 0.60, 2) AS DECIMAL(12,2)) AS cost_price,
        CAST(p_partkey * 37 % 101 - 10 AS DECIMAL(12,3)) AS stock, CAST(p_size AS DECIMAL(12,3)) AS min_stock,
        CASE WHEN p_partkey % 3 = 0 THEN 'kg' ELSE 'unidad' END AS unit, p_partkey % 10 <> 7 AS active FROM part""",
    "categories": """SELECT min(p_partkey) AS id, p_brand AS name, min(p_type) AS description,
        min(p_partkey) % 3 <> 0 AS active FROM part GROUP BY p_brand""",
    "classes": """SELECT s_suppkey AS id, 'Clase ' || s_suppkey AS name, s_name AS instructor,
        (['Domingo', 'Lunes', 'Martes', 'Miércoles', 'Jueves', 'Viernes', 'Sábado', 'Feriado'])[s_suppkey % 8 + 1]
            AS day_of_week,
        lpad(CAST(s_suppkey * 5 % 14 + 7 AS VARCHAR), 2, '0') || ':00:00' AS start_time, 20 AS capacity,
        s_suppkey % 4 <> 0 AS active, CAST(s_nationkey AS BIGINT) AS created_by FROM supplier""",
    "notices": """SELECT event_id AS id, 'Aviso ' || event_id AS title,
        (['info', 'warning', 'success'])[event_id % 3 + 1] AS type, event_id % 4 <> 0 AS active,
        user_id % 30 AS created_by, ts AS created_at FROM events WHERE event_type = 'signup'""",
    "stock_movements": """SELECT l_partkey AS product_id,
        CASE l_returnflag WHEN 'R' THEN 'entrada' WHEN 'A' THEN 'salida' ELSE 'ajuste' END AS type,
        CAST(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE -l_quantity END AS DECIMAL(12,3)) AS quantity,
        'Venta #' || l_orderkey AS notes, l_suppkey % 25 AS created_by, l_shipdate AS created_at,
        l_orderkey AS source_id FROM lineitem""",
    "client_entries": """SELECT event_id AS id, user_id AS client_id, event_id AS membership_id,
        CAST(date_trunc('second', ts) - INTERVAL 8250 DAY AS TIMESTAMP) AS entered_at, user_id % 25 AS created_by
        FROM events""",
    "cash_movements": """SELECT event_id AS id, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS cash_session_id,
        CASE event_type WHEN 'purchase' THEN 'sale' WHEN 'signup' THEN 'membership_payment' WHEN 'error' THEN 'expense'
            ELSE 'income' END AS type,
        (['cash', 'transfer', 'credit_card'])[event_id % 3 + 1] AS payment_method,
        CAST(value AS DECIMAL(10,2)) AS amount, 'Movimiento ' || event_id AS description,
        user_id % 25 AS created_by, ts AS created_at FROM events""",
    "session_totals": """SELECT cash_session_id AS id,
        sum(CASE WHEN type IN ('income', 'membership_payment', 'sale') THEN amount ELSE 0 END) AS total_in,
        sum(CASE WHEN type = 'expense' THEN amount ELSE 0 END) AS total_out
        FROM cash_movements GROUP BY cash_session_id""",
    "session_expected": """SELECT id, CAST(100 + total_in - total_out + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END
            AS DECIMAL(10,2)) AS expected, id < (SELECT max(id) FROM session_totals) AS closed FROM session_totals""",
    "cash_sessions": """SELECT id, id % 25 AS user_id, CAST(100 AS DECIMAL(10,2)) AS opening_amount,
        CASE WHEN closed THEN CAST(expected + id % 3 AS DECIMAL(10,2)) END AS closing_amount,
        CASE WHEN closed THEN expected END AS expected_amount,
        CASE WHEN closed THEN CAST(id % 3 AS DECIMAL(10,2)) END AS difference,
        CASE WHEN closed THEN 'closed' ELSE 'open' END AS status,
        CAST(DATE '2024-01-01' + CAST(id AS INTEGER) AS TIMESTAMP) + INTERVAL 8 HOUR AS opened_at,
        CASE WHEN closed THEN CAST(DATE '2024-01-01' + CAST(id AS INTEGER) AS TIMESTAMP) + INTERVAL 22 HOUR END
            AS closed_at FROM session_expected""",
    "ledger_moves": """SELECT event_id AS id, user_id AS client_id,
        CASE WHEN event_id % 3 = 0 THEN event_id END AS membership_id,
        CASE WHEN event_type = 'purchase' THEN 'debit' ELSE 'credit' END AS type,
        CAST(value AS DECIMAL(10,2)) AS amount, user_id % 25 AS created_by, ts AS created_at
        FROM events WHERE event_type IN ('purchase', 'signup')""",
    "current_account": """SELECT *, CAST(sum(CASE WHEN type = 'debit' THEN amount ELSE -amount END) OVER (
            PARTITION BY client_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS DECIMAL(18,2)) AS balance
        FROM ledger_moves""",
    "sale_request_lines": """SELECT l.l_orderkey AS request_id, l.l_partkey AS product_id,
        CAST(sum(CAST(l.l_quantity AS DECIMAL(12,3))) AS DECIMAL(12,3)) AS quantity, min(o.o_orderdate) AS requested_at
        FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey GROUP BY ALL""",
}


def _needs(sql: str) -> set[str]:
    return {name for name in ROLE_SQL if re.search(rf"\b{name}\b", sql)}


def with_roles(sql: str) -> str:
    """``sql`` behind the role definitions it uses, directly or through another role."""
    found, todo = set(), _needs(sql)
    while todo:
        name = todo.pop()
        if name not in found:
            found.add(name)
            todo |= _needs(ROLE_SQL[name]) - {name}
    parts = [f"{name} AS ({ROLE_SQL[name]})" for name in ROLE_SQL if name in found]
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join([*parts, body[len("WITH RECURSIVE ") :]])
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join([*parts, body[len("WITH ") :]])
    return (f"WITH {', '.join(parts)} " if parts else "") + body

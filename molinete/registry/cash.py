"""Ledger and drawer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from molinete.plans import cash as C
from molinete.plans import ledger as L
from molinete.registry.core import query
from molinete.sources.roles import Roles

_LATEST = """SELECT client_id, balance FROM current_account
    QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY created_at DESC, id DESC) = 1"""
_SIGNED = "CASE WHEN type = 'debit' THEN amount ELSE -amount END"


@query(
    "running_balance",
    f"""SELECT id, client_id, type, amount, CAST(sum({_SIGNED}) OVER (PARTITION BY client_id ORDER BY created_at, id
        ROWS UNBOUNDED PRECEDING) AS DECIMAL(18,2)) AS running_balance FROM ledger_moves""",
)
def _(r: Roles):
    return L.running_balance(r.ledger_moves).select("id", "client_id", "type", "amount", "running_balance")


@query(
    "client_statement",
    f"""SELECT a.id, a.client_id, a.type, a.amount, a.balance, a.created_at, u.username AS created_by_name,
        m.start_date AS membership_date, p.name AS plan_name, l.balance AS current_balance
    FROM current_account a LEFT JOIN users u ON u.id = a.created_by LEFT JOIN memberships m ON m.id = a.membership_id
    LEFT JOIN plans p ON p.id = m.plan_id JOIN ({_LATEST}) l ON l.client_id = a.client_id""",
)
def _(r: Roles):
    return L.client_statement(r.current_account, r.users, r.memberships, r.plans).select(
        "id",
        "client_id",
        "type",
        "amount",
        "balance",
        "created_at",
        "created_by_name",
        "membership_date",
        "plan_name",
        "current_balance",
    )


@query(
    "debtors",
    f"""SELECT c.id, c.name, c.phone, l.balance FROM clients c JOIN ({_LATEST}) l ON l.client_id = c.id
    WHERE l.balance > 0""",
)
def _(r: Roles):
    return L.debtors(r.clients, r.current_account)


def _payment_requests(r: Roles):
    return (
        r.raw("events")
        .select(
            F.col("event_id").alias("request_id"),
            F.col("ts").alias("requested_at"),
            # some payers are no clients
            F.when(F.col("event_id") % 11 == 0, -F.col("user_id")).otherwise(F.col("user_id")).alias("client_id"),
            F.col("value").cast("decimal(10,2)").alias("amount"),
            F.lit("cash").alias("payment_method"),
            F.when(F.col("event_id") % 2 == 0, " ").otherwise("Abono").alias("description"),
            (F.col("user_id") % 25).alias("created_by"),
        )
    )


_ASKED = """SELECT event_id AS source_id, CASE WHEN event_id % 11 = 0 THEN -user_id ELSE user_id END AS client_id, CAST(value AS DECIMAL(10,2)) AS amount,
    CASE WHEN event_id % 2 = 0 THEN 'Pago de cuenta corriente' ELSE 'Abono' END AS description, ts FROM events"""
_PAYMENTS = f"SELECT * FROM ({_ASKED}) WHERE client_id IN (SELECT id FROM clients)"


@query(
    "account_payments_ledger",
    f"""WITH pay AS ({_PAYMENTS}), l AS ({_LATEST})
    SELECT 3 * 288230376151711744 + p.source_id * 32768 + 1 AS id, 3 * 288230376151711744 + p.source_id * 32768 + 1 AS cash_movement_id,
        p.source_id, p.client_id, 'credit' AS type, p.amount, p.description,
        CAST(coalesce(l.balance, 0) - sum(p.amount) OVER (PARTITION BY p.client_id ORDER BY p.ts, p.source_id
            ROWS UNBOUNDED PRECEDING) AS DECIMAL(18,2)) AS balance
    FROM pay p LEFT JOIN l ON l.client_id = p.client_id""",
)
def _(r: Roles):
    out = L.post_account_payments(_payment_requests(r), r.current_account, r.cash_sessions, r.clients)["current_account"]
    return out.select("id", "cash_movement_id", "source_id", "client_id", "type", "amount", "description", "balance")


@query(
    "account_payments_cash",
    f"""SELECT (SELECT id FROM cash_sessions WHERE status = 'open') AS cash_session_id, 'income' AS type, amount, description,
        'cuenta_corriente_' || (3 * 288230376151711744 + source_id * 32768 + 1) AS reference FROM ({_PAYMENTS})""",
)
def _(r: Roles):
    out = L.post_account_payments(_payment_requests(r), r.current_account, r.cash_sessions, r.clients)["cash_movements"]
    return out.select("cash_session_id", "type", "amount", "description", "reference")


@query(
    "account_payments_rejected",
    f"SELECT source_id AS request_id, 'client_not_found' AS reason FROM ({_ASKED}) WHERE client_id NOT IN (SELECT id FROM clients)",
)
def _(r: Roles):
    return L.post_account_payments(_payment_requests(r), r.current_account, r.cash_sessions, r.clients)["rejected"]


@query(
    "ledger_audit",
    """SELECT id, client_id, CAST(balance + CASE WHEN id % 50 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,2)) AS balance,
        balance AS expected_balance FROM current_account WHERE id % 50 = 0""",
)
def _(r: Roles):
    wrong = F.when(F.col("id") % 50 == 0, F.lit(1)).otherwise(F.lit(0))
    return L.ledger_audit(r.current_account.withColumn("balance", (F.col("balance") + wrong).cast("decimal(18,2)")))


_TOTALS = """coalesce(n, 0) AS movements_count, CAST(coalesce(i, 0) AS DECIMAL(38,2)) AS total_income,
    CAST(coalesce(e, 0) AS DECIMAL(38,2)) AS total_expenses"""
_SUMS = """(SELECT cash_session_id, count(*) AS n,
        sum(CASE WHEN type IN ('income', 'membership_payment', 'sale') THEN amount ELSE 0 END) AS i,
        sum(CASE WHEN type = 'expense' THEN amount ELSE 0 END) AS e FROM cash_movements GROUP BY cash_session_id)"""


@query(
    "session_history",
    f"""SELECT s.*, u.username, u.name AS user_name, {_TOTALS} FROM cash_sessions s JOIN users u ON u.id = s.user_id
    LEFT JOIN {_SUMS} t ON t.cash_session_id = s.id WHERE s.status = 'closed'""",
)
def _(r: Roles):
    return C.session_history(r.cash_sessions, r.cash_movements, r.users)


_ITEM = "v.id || ':' || v.type || ':' || v.payment_method || ':' || v.amount || ':' || w.name"


def _flat(documents):
    item = F.transform(
        "movements",
        lambda m: F.concat_ws(
            ":", m["id"].cast("string"), m["type"], m["payment_method"], m["amount"].cast("string"), m["created_by_name"]
        ),
    )
    return documents.select(
        "id", "part", "status", "user_name", "total_income", "total_expenses", F.array_join(item, ";").alias("movements")
    )


_DOCUMENT = f"""SELECT s.id, CAST(0 AS BIGINT) AS part, s.status, u.name AS user_name, CAST(coalesce(t.i, 0) AS DECIMAL(38,2)) AS total_income,
        CAST(coalesce(t.e, 0) AS DECIMAL(38,2)) AS total_expenses, coalesce(d.movements, '') AS movements
    FROM cash_sessions s JOIN users u ON u.id = s.user_id LEFT JOIN {_SUMS} t ON t.cash_session_id = s.id
    LEFT JOIN (SELECT v.cash_session_id, string_agg({_ITEM}, ';' ORDER BY v.created_at DESC, v.id DESC) AS movements
        FROM cash_movements v JOIN users w ON w.id = v.created_by GROUP BY v.cash_session_id) d ON d.cash_session_id = s.id"""


@query("session_detail", _DOCUMENT)
def _(r: Roles):
    return _flat(C.session_detail(r.cash_sessions, r.cash_movements, r.users))


@query("open_session_detail", _DOCUMENT + " WHERE s.status = 'open'")
def _(r: Roles):
    return _flat(C.open_session_detail(r.cash_sessions, r.cash_movements, r.users))


_INCOME = """SELECT cash_session_id, payment_method, CAST(sum(amount) AS DECIMAL(38,2)) AS total FROM cash_movements
    WHERE type IN ('income', 'membership_payment', 'sale') AND payment_method IS NOT NULL"""


@query("income_by_method", _INCOME + " GROUP BY ALL")
def _(r: Roles):
    return C.income_by_method(r.cash_movements)


@query(
    "income_by_method_open",
    _INCOME + " AND cash_session_id = (SELECT id FROM cash_sessions WHERE status = 'open') GROUP BY ALL",
)
def _(r: Roles):
    return C.income_by_method(r.cash_movements, r.cash_sessions)


def _closings(r: Roles):
    """Counted amounts for every session; those of even ids are still open here."""
    sessions = r.cash_sessions.withColumn("status", F.when(F.col("id") % 2 == 0, "open").otherwise("closed"))
    part_of = lambda c, n: (F.col(c) * n).cast("decimal(10,2)")
    part = lambda n: part_of("id", n)
    counts = r.cash_sessions.select(
        F.col("id").alias("session_id"),
        F.when(F.col("id") % 4 == 0, F.lit("150.00").cast("decimal(10,2)")).alias("closing_amount"),
        F.when(F.col("id") % 3 != 0, part(10)).alias("closing_cash"),
        F.when(F.col("id") % 3 != 0, part(5)).alias("closing_transfer"),
        F.lit(None).cast("decimal(10,2)").alias("closing_card"),
        F.lit("").alias("notes"),
        F.col("opened_at").alias("closed_at"),
    )
    # every sixth session is counted again an hour later
    again = counts.filter("session_id % 6 = 0").withColumns({"closing_cash": part_of("session_id", 20), "closed_at": F.expr("closed_at + INTERVAL 1 HOUR")})
    return C.close_sessions(sessions, r.cash_movements, counts.unionByName(again))


_FIRST = "CASE WHEN id % 3 <> 0 AND id > 0 THEN CAST(id * 15 AS DECIMAL(18,2)) WHEN id % 4 = 0 THEN CAST(150 AS DECIMAL(18,2)) END"
_COUNTED = f"coalesce({_FIRST}, CASE WHEN id % 6 = 0 THEN CAST(id * 20 AS DECIMAL(18,2)) END)"


@query(
    "close_sessions",
    f"""SELECT s.id, {_COUNTED} AS closing_amount, CAST(100 + coalesce(i, 0) - coalesce(e, 0) AS DECIMAL(18,2)) AS expected_amount,
        CAST({_COUNTED} - (100 + coalesce(i, 0) - coalesce(e, 0)) AS DECIMAL(18,2)) AS difference, 'closed' AS status
    FROM cash_sessions s LEFT JOIN {_SUMS} t ON t.cash_session_id = s.id
    WHERE s.id % 2 = 0 AND {_COUNTED} IS NOT NULL""",
)
def _(r: Roles):
    return _closings(r)["cash_sessions"].select("id", "closing_amount", "expected_amount", "difference", "status")


@query(
    "close_sessions_rejected",
    f"""SELECT id AS session_id, CASE WHEN {_FIRST} IS NULL THEN 'closing_amount_missing' ELSE 'session_not_open' END AS reason
    FROM cash_sessions WHERE {_FIRST} IS NULL OR id % 2 <> 0
    UNION ALL SELECT id, 'session_not_open' FROM cash_sessions WHERE id % 6 = 0 AND {_FIRST} IS NOT NULL""",
)
def _(r: Roles):
    return _closings(r)["rejected"]


def _movement_requests(r: Roles):
    return r.raw("events").select(
        F.col("event_id").alias("request_id"),
        F.col("ts").alias("requested_at"),
        F.when(F.col("event_type") == "error", "expense").otherwise("income").alias("type"),
        F.lit("cash").alias("payment_method"),
        F.col("value").alias("amount"),
        F.col("event_type").alias("description"),
        F.lit("").alias("reference"),
        (F.col("user_id") % 25).alias("created_by"),
    )


@query(
    "post_cash_movements",
    """SELECT event_id AS id, (SELECT id FROM cash_sessions WHERE status = 'open') AS cash_session_id,
        CASE WHEN event_type = 'error' THEN 'expense' ELSE 'income' END AS type, CAST(value AS DECIMAL(10,2)) AS amount,
        CAST(NULL AS VARCHAR) AS reference FROM events""",
)
def _(r: Roles):
    out = C.post_cash_movements(_movement_requests(r), r.cash_sessions)["cash_movements"]
    return out.select("id", "cash_session_id", "type", "amount", "reference")


def _opening_requests(r: Roles):
    return r.raw("events").select(
        F.col("event_id").alias("request_id"),
        F.col("ts").alias("requested_at"),
        (F.col("user_id") % 25).alias("user_id"),
        F.col("value").alias("opening_amount"),
        F.lit("").alias("notes"),
    )


@query(
    "open_sessions",
    """SELECT event_id AS id, user_id % 25 AS user_id, CAST(value AS DECIMAL(10,2)) AS opening_amount, 'open' AS status, ts AS opened_at
    FROM events ORDER BY ts, event_id LIMIT 1""",
)
def _(r: Roles):
    closed = r.cash_sessions.filter("status = 'closed'")
    out = C.open_sessions(_opening_requests(r), closed)["cash_sessions"]
    return out.select("id", "user_id", "opening_amount", "status", "opened_at")


@query("open_sessions_rejected", "SELECT event_id AS request_id, 'session_already_open' AS reason FROM events")
def _(r: Roles):
    return C.open_sessions(_opening_requests(r), r.cash_sessions)["rejected"]


@query(
    "session_audit",
    f"""SELECT s.id, s.expected_amount, CAST(100 + i - e AS DECIMAL(18,2)) AS recomputed_expected, s.difference,
        CAST(s.closing_amount - (100 + i - e) AS DECIMAL(18,2)) AS recomputed_difference
    FROM cash_sessions s JOIN {_SUMS} t ON t.cash_session_id = s.id
    WHERE s.status = 'closed' AND (s.expected_amount <> 100 + i - e OR s.difference <> s.closing_amount - (100 + i - e))""",
)
def _(r: Roles):
    return C.session_audit(r.cash_sessions, r.cash_movements)


@query(
    "open_session_count",
    """SELECT count(*) AS open_sessions, count(*) <= 1 AS allowed FROM cash_sessions WHERE status = 'open'""",
)
def _(r: Roles):
    return C.open_session_count(r.cash_sessions)

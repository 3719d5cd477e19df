"""Membership, client and attendance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from molinete.functions.scalars import day, normalize_phone_ar
from molinete.operators import attendance
from molinete.operators.rows import latest_per_key, page_info
from molinete.plans import members as M
from molinete.registry.core import query
from molinete.registry.roles_sql import AS_OF as D
from molinete.sources.roles import AS_OF, Roles

_SWEPT = f"CASE WHEN m.status = 'active' AND m.end_date < {D} THEN 'expired' ELSE m.status END"
_ACTIVE = f"status = 'active' AND start_date <= {D} AND end_date >= {D}"
_M = f"m.status = 'active' AND m.start_date <= {D} AND m.end_date >= {D}"

_LIST = f"""SELECT m.* REPLACE ({_SWEPT} AS status), c.name AS client_name, c.dni AS client_dni, c.phone AS client_phone,
    p.name AS plan_name, p.price AS plan_price, p.duration_days AS plan_duration,
    u.name AS created_by_name, i.name AS instructor_name,
    CAST(m.end_date - {D} AS INTEGER) AS days_remaining
    FROM memberships m JOIN clients c ON c.id = m.client_id JOIN plans p ON p.id = m.plan_id
    LEFT JOIN users u ON u.id = m.created_by LEFT JOIN instructors i ON i.id = m.instructor_id"""


@query("list_memberships", _LIST)
def _(r: Roles):
    return M.list_memberships(r.memberships, r.clients, r.plans, r.users, r.instructors, as_of=AS_OF)


@query(
    "list_memberships_page",
    _LIST + f" WHERE {_SWEPT} = 'expired' AND c.phone LIKE '%81_0%' ORDER BY m.created_at DESC, m.id DESC LIMIT 20 OFFSET 40",
)
def _(r: Roles):
    return M.list_memberships(
        r.memberships,
        r.clients,
        r.plans,
        r.users,
        r.instructors,
        as_of=AS_OF,
        status="expired",
        search=" 81_0 ",
        page=3,
        limit=20,
    )


@query(
    "membership_detail",
    f"""SELECT m.* REPLACE ({_SWEPT} AS status), c.name AS client_name, c.dni AS client_dni, c.phone AS client_phone,
    p.name AS plan_name, p.price AS plan_price, p.duration_days AS plan_duration, i.name AS instructor_name
    FROM memberships m JOIN clients c ON c.id = m.client_id JOIN plans p ON p.id = m.plan_id
    LEFT JOIN instructors i ON i.id = m.instructor_id
    WHERE m.id IN (SELECT event_id FROM events WHERE event_type = 'click')""",
)
def _(r: Roles):
    ids = r.raw("events").filter("event_type = 'click'").select("event_id")
    return M.membership_detail(r.memberships, r.clients, r.plans, r.instructors, as_of=AS_OF, ids=ids)


_CURRENT = f"""SELECT m.*, p.name AS plan_name, p.price AS plan_price, p.duration_days AS plan_duration,
    CAST(m.end_date - {D} AS INTEGER) AS days_remaining
    FROM memberships m JOIN plans p ON p.id = m.plan_id WHERE {_M}
    QUALIFY row_number() OVER (PARTITION BY m.client_id ORDER BY m.end_date DESC, m.id DESC) = 1"""


@query("current_membership", _CURRENT)
def _(r: Roles):
    return M.current_membership(r.memberships, r.plans, as_of=AS_OF)


@query(
    "last_expired",
    f"""SELECT m.*, p.name AS plan_name FROM memberships m JOIN plans p ON p.id = m.plan_id
    WHERE (m.status = 'expired' OR m.end_date < {D})
      AND NOT EXISTS (SELECT 1 FROM memberships a WHERE a.client_id = m.client_id AND a.{_ACTIVE.replace('AND ', 'AND a.')})
    QUALIFY row_number() OVER (PARTITION BY m.client_id ORDER BY m.end_date DESC, m.id DESC) = 1""",
)
def _(r: Roles):
    return M.last_expired(r.memberships, r.plans, as_of=AS_OF)


_CLIENTS = """WITH b AS (SELECT client_id, balance FROM current_account
        QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY created_at DESC, id DESC) = 1)
    SELECT c.id, c.username, c.name, c.phone, c.dni, c.active, c.created_at, u.name AS created_by_name, b.balance
    FROM clients c LEFT JOIN users u ON u.id = c.created_by LEFT JOIN b ON b.client_id = c.id """


@query("list_clients", _CLIENTS + "WHERE c.active ORDER BY c.created_at DESC, c.id DESC LIMIT 100")
def _(r: Roles):
    return M.list_clients(r.clients, r.current_account, r.memberships, r.users, as_of=AS_OF, limit=100)


@query(
    "list_clients_with_debt",
    _CLIENTS + "WHERE c.active AND balance > 0 AND (c.name ILIKE '%omer#0%' OR c.username ILIKE '%omer#0%')",
)
def _(r: Roles):
    return M.list_clients(
        r.clients, r.current_account, r.memberships, r.users, as_of=AS_OF, debt="with_debt", search="oMÉr#0", page=None
    )


@query("list_clients_up_to_date", _CLIENTS + "WHERE NOT c.active AND (balance IS NULL OR balance <= 0)")
def _(r: Roles):
    return M.list_clients(
        r.clients, r.current_account, r.memberships, r.users, as_of=AS_OF, active="inactive", debt="al_day", page=None
    )


@query(
    "list_clients_expiring",
    _CLIENTS
    + f"""WHERE c.active AND c.id IN (SELECT client_id FROM memberships WHERE {_ACTIVE} AND end_date - {D} = 3)""",
)
def _(r: Roles):
    return M.list_clients(
        r.clients, r.current_account, r.memberships, r.users, as_of=AS_OF, days_remaining=3, lapsed=True, page=None
    )


@query(
    "list_clients_lapsed",
    _CLIENTS
    + f"""WHERE c.active AND c.id IN (SELECT client_id FROM memberships WHERE status = 'expired')
      AND c.id NOT IN (SELECT client_id FROM memberships WHERE {_ACTIVE})""",
)
def _(r: Roles):
    return M.list_clients(r.clients, r.current_account, r.memberships, r.users, as_of=AS_OF, lapsed=True, page=None)


@query("list_clients_page_info", "SELECT 2 AS page, 10 AS \"limit\", count(*) AS total, CAST(ceil(count(*) / 10.0) AS BIGINT) AS total_pages FROM clients WHERE active")
def _(r: Roles):
    return page_info(r.clients.filter("active"), 2, 10)


@query(
    "client_membership_status",
    f"""WITH now AS ({_CURRENT}),
    past AS (SELECT m.client_id, m.end_date, m.status, p.name AS plan_name FROM memberships m JOIN plans p ON p.id = m.plan_id
        WHERE (m.status = 'expired' OR m.end_date < {D}) AND m.client_id NOT IN (SELECT client_id FROM now)
        QUALIFY row_number() OVER (PARTITION BY m.client_id ORDER BY m.end_date DESC, m.id DESC) = 1)
    SELECT c.id, c.name, n.id AS membership_id, n.plan_name AS active_plan, n.end_date AS active_end, n.days_remaining,
        n.plan_duration AS duration_days, n.reminder_sent_days, e.end_date AS expired_end, e.status AS expired_status,
        e.plan_name AS expired_plan
    FROM clients c LEFT JOIN now n ON n.client_id = c.id LEFT JOIN past e ON e.client_id = c.id""",
)
def _(r: Roles):
    a, e = "active_membership", "expired_membership"
    return M.with_membership_status(r.clients, r.memberships, r.plans, as_of=AS_OF).select(
        "id",
        "name",
        f"{a}.membership_id",
        F.col(f"{a}.plan_name").alias("active_plan"),
        F.col(f"{a}.end_date").alias("active_end"),
        f"{a}.days_remaining",
        f"{a}.duration_days",
        f"{a}.reminder_sent_days",
        F.col(f"{e}.end_date").alias("expired_end"),
        F.col(f"{e}.status").alias("expired_status"),
        F.col(f"{e}.plan_name").alias("expired_plan"),
    )


_ENTRIES = """SELECT e.id, e.client_id, e.entered_at, p.name AS plan_name, m.end_date AS membership_end_date
    FROM client_entries e JOIN memberships m ON m.id = e.membership_id JOIN plans p ON p.id = m.plan_id"""


@query("client_entries_list", _ENTRIES)
def _(r: Roles):
    return M.client_entries_list(r.client_entries, r.memberships, r.plans)


@query("client_entries_page", _ENTRIES + " ORDER BY e.client_id, e.entered_at DESC, e.id DESC LIMIT 25 OFFSET 50")
def _(r: Roles):
    return M.client_entries_list(r.client_entries, r.memberships, r.plans, page=3, limit=25)


@query(
    "reminder_worklist",
    f"""SELECT m.id AS membership_id, m.client_id, c.name AS client_name, '549' || c.phone AS whatsapp_phone,
        p.name AS plan_name, m.end_date, CAST(m.end_date - {D} AS INTEGER) AS days_remaining, m.reminder_sent_days
    FROM memberships m JOIN clients c ON c.id = m.client_id JOIN plans p ON p.id = m.plan_id
    WHERE {_M} AND m.end_date - {D} IN (5, 3, 1)
      AND NOT list_contains(string_split(m.reminder_sent_days, ','), CAST(m.end_date - {D} AS VARCHAR))""",
)
def _(r: Roles):
    return M.reminder_worklist(r.memberships, r.clients, r.plans, as_of=AS_OF)


@query(
    "expire_memberships",
    f"""SELECT m.id, m.client_id, m.end_date, {_SWEPT} AS status,
    (SELECT count(*) FROM memberships WHERE status = 'active' AND end_date < {D}) AS affected FROM memberships m""",
)
def _(r: Roles):
    swept, affected = M.expire_memberships(r.memberships, as_of=AS_OF)
    return swept.select("id", "client_id", "end_date", "status").withColumn("affected", affected.scalar())


def _reminders(r: Roles):
    """A reminder request per event, for one of eight days."""
    return r.raw("events").select(
        F.col("event_id").alias("request_id"),
        (F.col("event_id") + F.col("user_id")).alias("membership_id"),
        (F.col("event_id") % 8).cast("int").alias("days_remaining"),
    )


_SENT = """SELECT event_id AS request_id, event_id + user_id AS membership_id, event_id % 8 AS days_remaining
    FROM events"""


@query(
    "record_reminders",
    f"""WITH sent AS ({_SENT}),
    good AS (SELECT DISTINCT s.membership_id, s.days_remaining AS d FROM sent s JOIN memberships m ON m.id = s.membership_id
        WHERE s.days_remaining <= 5 AND {_M}),
    old AS (SELECT id AS membership_id, CAST(x AS BIGINT) AS d
        FROM (SELECT id, unnest(string_split(reminder_sent_days, ',')) AS x FROM memberships) WHERE x <> ''),
    merged AS (SELECT membership_id, string_agg(CAST(d AS VARCHAR), ',' ORDER BY d DESC) AS days
        FROM (SELECT * FROM good UNION SELECT * FROM old WHERE membership_id IN (SELECT membership_id FROM good))
        GROUP BY membership_id)
    SELECT m.id, coalesce(g.days, m.reminder_sent_days) AS reminder_sent_days
    FROM memberships m LEFT JOIN merged g ON g.membership_id = m.id""",
)
def _(r: Roles):
    out = M.record_reminders(r.memberships, _reminders(r), as_of=AS_OF)["memberships"]
    return out.select("id", "reminder_sent_days")


@query(
    "record_reminders_rejected",
    f"""WITH sent AS ({_SENT}) SELECT s.request_id,
        CASE WHEN s.days_remaining > 5 THEN 'day_out_of_range' ELSE 'membership_not_active' END AS reason
    FROM sent s LEFT JOIN memberships m ON m.id = s.membership_id
    WHERE s.days_remaining > 5 OR m.id IS NULL OR NOT ({_M})""",
)
def _(r: Roles):
    return M.record_reminders(r.memberships, _reminders(r), as_of=AS_OF)["rejected"]


@query(
    "latest_per_key",
    """SELECT id, client_id, entered_at FROM client_entries
    QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY entered_at DESC, id DESC) = 1""",
)
def _(r: Roles):
    return latest_per_key(r.client_entries.select("id", "client_id", "entered_at"), ["client_id"], ["entered_at", "id"])


@query(
    "entry_gaps",
    """SELECT id, client_id, entered_at, lag(entered_at) OVER w AS previous_entered_at,
        CAST(epoch(entered_at - lag(entered_at) OVER w) AS BIGINT) // 60 AS minutes_since_previous
    FROM client_entries WINDOW w AS (PARTITION BY client_id ORDER BY entered_at, id)""",
)
def _(r: Roles):
    return attendance.entry_gaps(r.client_entries.select("id", "client_id", "entered_at"))


@query(
    "entry_asof",
    """SELECT e.id, e.client_id, e.entered_at, m.id AS membership_id, m.end_date AS membership_end_date
    FROM client_entries e LEFT JOIN memberships m ON m.client_id = e.client_id AND m.status = 'active'
        AND m.start_date <= CAST(e.entered_at AS DATE) AND m.end_date >= CAST(e.entered_at AS DATE)
    QUALIFY row_number() OVER (PARTITION BY e.id ORDER BY m.end_date DESC NULLS LAST, m.id DESC) = 1""",
)
def _(r: Roles):
    out = attendance.attribute_entries(r.client_entries.select("id", "client_id", "entered_at"), r.memberships)
    return out.select("id", "client_id", "entered_at", "membership_id", "membership_end_date")


_FOLD = """t AS (SELECT id, client_id, entered_at, CAST(epoch(entered_at) AS BIGINT) AS sec FROM {source}),
    g AS (SELECT client_id, list(struct_pack(sec := sec, id := id) ORDER BY sec, id) AS rows FROM t GROUP BY client_id),
    walk AS (SELECT client_id, rows, 1 AS i, rows[1].sec AS last, true AS ok FROM g
        UNION ALL SELECT client_id, rows, i + 1,
            CASE WHEN rows[i + 1].sec >= last + 1800 THEN rows[i + 1].sec ELSE last END, rows[i + 1].sec >= last + 1800
        FROM walk WHERE i < len(rows))"""


@query(
    "entry_cooldown",
    f"WITH RECURSIVE {_FOLD.format(source='client_entries')} "
    "SELECT t.id, t.client_id, t.entered_at, w.ok AS accepted FROM walk w JOIN t ON t.id = w.rows[w.i].id",
)
def _(r: Roles):
    return attendance.entry_cooldown(r.client_entries.select("id", "client_id", "entered_at"))


REGISTER_SQL = f"""WITH RECURSIVE able AS (SELECT e.id, e.client_id, e.entered_at, m.id AS membership_id FROM client_entries e
        JOIN clients c ON c.id = e.client_id JOIN memberships m ON m.client_id = e.client_id AND m.status = 'active'
        AND m.start_date <= CAST(e.entered_at AS DATE) AND m.end_date >= CAST(e.entered_at AS DATE)
        QUALIFY row_number() OVER (PARTITION BY e.id ORDER BY m.end_date DESC, m.id DESC) = 1),
    {_FOLD.format(source='able')},
    done AS (SELECT t.id, w.ok FROM walk w JOIN t ON t.id = w.rows[w.i].id),
    last AS (SELECT a.id, max(CASE WHEN d.ok THEN a.entered_at END) OVER (PARTITION BY a.client_id ORDER BY a.entered_at, a.id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS at FROM able a JOIN done d ON d.id = a.id)
    SELECT e.id, e.client_id, e.entered_at, a.membership_id, coalesce(d.ok, false) AS accepted,
        CASE WHEN d.ok THEN NULL WHEN d.id IS NULL THEN 'no_active_membership' ELSE 'cooldown' END AS reason,
        CASE WHEN NOT d.ok THEN l.at + INTERVAL 30 MINUTE END AS next_allowed_at
    FROM client_entries e LEFT JOIN able a ON a.id = e.id LEFT JOIN done d ON d.id = e.id LEFT JOIN last l ON l.id = e.id"""


@query("register_entries", REGISTER_SQL)
def _(r: Roles):
    return M.register_entries(r.client_entries.select("id", "client_id", "entered_at"), r.clients, r.memberships)


@query(
    "normalize_phone_ar",
    """WITH raw AS (SELECT c_custkey AS id, (CASE c_custkey % 6 WHEN 0 THEN '+54 ' WHEN 1 THEN '+54 9 ' WHEN 2 THEN '15 '
            WHEN 3 THEN '0' ELSE '' END) || '381-' || substr(lpad(CAST(c_custkey AS VARCHAR), 7, '0'), 1, CASE WHEN
            c_custkey % 6 = 2 THEN 6 ELSE 7 END) AS phone FROM customer),
    d AS (SELECT id, phone, regexp_replace(phone, '[^0-9]', '', 'g') AS x FROM raw)
    SELECT id, phone, CASE WHEN length(x) < 10 THEN NULL
        WHEN x LIKE '54%' THEN CASE WHEN length(x) = 12 AND substr(x, 3, 1) <> '9' THEN '549' || substr(x, 3)
            WHEN length(x) >= 12 THEN x END
        WHEN length(x) = 11 AND x LIKE '15%' THEN '549' || substr(x, 3)
        WHEN length(x) = 10 THEN '549' || x END AS normalized FROM d""",
)
def _(r: Roles):
    key = F.col("c_custkey")
    prefix = (
        F.when(key % 6 == 0, "+54 ").when(key % 6 == 1, "+54 9 ").when(key % 6 == 2, "15 ").when(key % 6 == 3, "0").otherwise("")
    )
    digits = F.lpad(key.cast("string"), 7, "0")
    short = F.when(key % 6 == 2, F.substring(digits, 1, 6)).otherwise(digits)
    raw = r.raw("customer").select(key.alias("id"), F.concat(prefix, F.lit("381-"), short).alias("phone"))
    return raw.withColumn("normalized", normalize_phone_ar("phone"))


# --- enrolment and cancellation over request tables --------------------------


def enrol_requests(r: Roles):
    """One request per order: start around ``as_of``, payments by priority, some with mistakes."""
    key = F.col("o_orderkey")
    digit = F.substring("o_orderpriority", 1, 1)
    price = r.plans.select(F.col("id").alias("_plan"), F.col("price").alias("_price"))
    due = F.greatest(F.lit(0), F.col("_price") - (key % 3 * 10)).cast("decimal(12,2)")
    half = F.round(due / 2, 2).cast("decimal(12,2)")
    pay = lambda m, a: F.struct(F.lit(m).alias("payment_method"), a.cast("decimal(12,2)").alias("amount"))
    off = F.when(key % 19 == 0, F.lit(5)).otherwise(F.lit(0))
    split = F.array(pay("cash", half + off), pay("current_account", due - half), pay("cheque", due))
    return (
        r.raw("orders")
        .join(price, key % 200 == F.col("_plan"))
        .select(
            key.alias("request_id"),
            F.col("o_orderdate").alias("requested_at"),
            F.col("o_custkey").alias("client_id"),
            (key % 200).alias("plan_id"),
            F.when(key % 6 != 0, key % 10).alias("instructor_id"),
            F.when(key % 23 == 0, "not a date")
            .otherwise(F.date_add(day(AS_OF), (key % 45 - 9).cast("int")).cast("string"))
            .alias("start_date"),
            F.when(digit == "1", "cash").when(digit == "2", "transfer").when(digit == "3", "current_account").alias("payment_method"),
            F.when(digit == "4", split).alias("payments"),
            (key % 3 * 10).cast("decimal(12,2)").alias("discount"),
            F.lit(None).cast("string").alias("notes"),
            (key % 25).alias("created_by"),
        )
    )


def _enrolled(r: Roles):
    # All pairs, moved to every third plan and to three instructors: plans with none, one and several, so that all three instructor rules occur.
    pairs = r.plan_instructors.selectExpr(
        "plan_id - plan_id % 3 AS plan_id",
        "CASE WHEN plan_id % 6 < 3 THEN plan_id div 6 % 3 + 1 ELSE instructor_id % 3 + 1 END AS instructor_id",
    ).distinct()
    return M.enrol(
        enrol_requests(r),
        r.clients,
        r.plans,
        pairs,
        r.memberships,
        r.cash_sessions,
        r.current_account,
        as_of=AS_OF,
    )


_JUDGED = f"""pairs AS (SELECT DISTINCT plan_id - plan_id % 3 AS plan_id,
            CASE WHEN plan_id % 6 < 3 THEN plan_id // 6 % 3 + 1 ELSE instructor_id % 3 + 1 END AS instructor_id FROM plan_instructors),
    per_plan AS (SELECT plan_id, count(*) AS n, min(instructor_id) AS sole FROM pairs GROUP BY plan_id),
    req AS (SELECT o_orderkey AS id, o_orderdate AS asked_at, o_custkey AS client_id, o_orderkey % 200 AS plan_id,
            CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 10 END AS asked,
            CASE WHEN o_orderkey % 23 <> 0 THEN {D} + CAST(o_orderkey % 45 - 9 AS INTEGER) END AS start,
            substr(o_orderpriority, 1, 1) AS k, CAST(greatest(0, p.price - o_orderkey % 3 * 10) AS DECIMAL(12,2)) AS due,
            p.active AS plan_active, p.duration_days AS dur, p.name AS plan_name FROM orders JOIN plans p ON p.id = o_orderkey % 200),
    checked AS (SELECT r.*, start + dur AS fin, dur <= 3 AS is_class, coalesce(n, 0) AS n, sole,
            CAST(round(due / 2.0, 2) AS DECIMAL(12,2)) AS half,
            CASE WHEN start IS NULL THEN 'invalid_start_date' WHEN NOT plan_active THEN 'plan_not_found' END AS early,
            CASE WHEN k = '5' THEN 'payment_missing' WHEN k = '4' AND r.id % 19 = 0 THEN 'payments_do_not_sum'
                WHEN coalesce(n, 0) > 1 AND asked IS NULL THEN 'instructor_required'
                WHEN coalesce(n, 0) > 0 AND asked IS NOT NULL AND (n > 1 OR asked <> 0)
                    AND NOT EXISTS (SELECT 1 FROM pairs q WHERE q.plan_id = r.plan_id AND q.instructor_id = asked)
                    THEN 'instructor_not_in_plan' END AS late
        FROM req r LEFT JOIN per_plan USING (plan_id)),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY asked_at, id) AS i FROM checked),
    start_state AS (SELECT c.client_id, max(m.end_date) AS s FROM (SELECT DISTINCT client_id FROM checked) c
        LEFT JOIN memberships m ON m.client_id = c.client_id AND {_M} GROUP BY c.client_id),
    walk AS (SELECT client_id, CAST(0 AS BIGINT) AS i, s, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS reason FROM start_state
        UNION ALL SELECT w.client_id, n.i,
            CASE WHEN n.early IS NULL AND n.late IS NULL AND (n.is_class OR w.s IS NULL OR n.start = w.s)
                AND n.start <= {D} AND n.fin >= {D} THEN greatest(w.s, n.fin) ELSE w.s END,
            n.id, coalesce(n.early, CASE WHEN NOT n.is_class AND w.s IS NOT NULL AND n.start <> w.s
                THEN 'membership_in_force' END, n.late)
        FROM walk w JOIN numbered n ON n.client_id = w.client_id AND n.i = w.i + 1)"""


@query(
    "enrol_rejected",
    f"WITH RECURSIVE {_JUDGED} SELECT id AS request_id, reason FROM walk WHERE i > 0 AND reason IS NOT NULL",
)
def _(r: Roles):
    return _enrolled(r)["rejected"]


@query(
    "enrol_memberships",
    f"""WITH RECURSIVE {_JUDGED} SELECT c.id, c.client_id, c.plan_id,
        CASE WHEN c.n = 0 THEN NULL WHEN c.n = 1 AND (c.asked IS NULL OR c.asked = 0) THEN c.sole ELSE c.asked END AS instructor_id,
        c.start AS start_date, c.fin AS end_date, 'active' AS status,
        CASE c.k WHEN '1' THEN 'cash' WHEN '2' THEN 'transfer' WHEN '3' THEN 'current_account' ELSE 'combined' END AS payment_method,
        CASE WHEN c.k IN ('3', '4') THEN 'pending' ELSE 'paid' END AS payment_status,
        CASE WHEN c.k IN ('1', '2') THEN c.asked_at END AS paid_at
    FROM walk w JOIN checked c ON c.id = w.id WHERE w.reason IS NULL""",
)
def _(r: Roles):
    return _enrolled(r)["memberships"].select(
        "id",
        "client_id",
        "plan_id",
        "instructor_id",
        "start_date",
        "end_date",
        "status",
        "payment_method",
        "payment_status",
        "paid_at",
    )


_PAID_LINES = """lines AS (SELECT c.*, 1 AS line_no, CASE c.k WHEN '1' THEN 'cash' WHEN '2' THEN 'transfer' WHEN '3'
            THEN 'current_account' ELSE 'cash' END AS method, CASE WHEN c.k = '4' THEN half ELSE due END AS amount
        FROM walk w JOIN checked c ON c.id = w.id WHERE w.reason IS NULL
        UNION ALL SELECT c.*, 2, 'current_account', CAST(due - half AS DECIMAL(12,2))
        FROM walk w JOIN checked c ON c.id = w.id WHERE w.reason IS NULL AND c.k = '4')"""


@query(
    "enrol_payments",
    f"""WITH RECURSIVE {_JUDGED}, {_PAID_LINES}
    SELECT id AS membership_id, line_no, method AS payment_method, amount FROM lines""",
)
def _(r: Roles):
    return _enrolled(r)["membership_payments"].select("membership_id", "line_no", "payment_method", "amount")


@query(
    "enrol_ledger",
    f"""WITH RECURSIVE {_JUDGED}, {_PAID_LINES},
    opening AS (SELECT client_id, balance FROM current_account
        QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY created_at DESC, id DESC) = 1)
    SELECT l.id AS membership_id, l.line_no, l.client_id, l.amount, 'Membresía - ' || l.plan_name AS description,
        CAST(coalesce(o.balance, 0) + sum(l.amount) OVER (PARTITION BY l.client_id ORDER BY l.asked_at, l.id, l.line_no
            ROWS UNBOUNDED PRECEDING) AS DECIMAL(18,2)) AS balance
    FROM lines l LEFT JOIN opening o ON o.client_id = l.client_id WHERE l.method = 'current_account'""",
)
def _(r: Roles):
    return _enrolled(r)["current_account"].select(
        "membership_id", "line_no", "client_id", "amount", "description", "balance"
    )


@query(
    "enrol_cash_movements",
    f"""WITH RECURSIVE {_JUDGED}, {_PAID_LINES}
    SELECT l.id AS source_id, l.line_no, s.id AS cash_session_id, 'membership_payment' AS type, l.method AS payment_method, l.amount,
        'Pago de membresía - ' || l.plan_name AS description, l.asked_at AS created_at
    FROM lines l, (SELECT id FROM cash_sessions WHERE status = 'open') s WHERE l.method <> 'current_account' AND l.amount > 0""",
)
def _(r: Roles):
    return _enrolled(r)["cash_movements"].select("source_id", "line_no", "cash_session_id", "type", "payment_method", "amount", "description", "created_at")


@query(
    "enrol_client_entries",
    f"""WITH RECURSIVE {_JUDGED} SELECT c.id AS membership_id, c.client_id, c.asked_at AS entered_at
    FROM walk w JOIN checked c ON c.id = w.id WHERE w.reason IS NULL AND c.dur = 1""",
)
def _(r: Roles):
    return _enrolled(r)["client_entries"].select("membership_id", "client_id", "entered_at")


@query(
    "update_memberships",
    """SELECT id, CASE WHEN id % 6 = 0 THEN 'expired' WHEN id % 3 = 0 THEN 'cancelled' ELSE status END AS status,
        CASE WHEN id % 6 = 0 THEN NULL WHEN id % 3 = 0 THEN 'pending' ELSE payment_status END AS payment_status,
        CASE WHEN id % 6 = 0 THEN 'second' WHEN id % 3 = 0 THEN 'first' END AS notes FROM memberships""",
)
def _(r: Roles):
    """The three columns are overwritten together; of two requests for one membership the later counts, its empty columns too."""
    rows = r.memberships.withColumn("notes", F.lit(None).cast("string"))
    asked = rows.filter("id % 3 = 0").select("id", F.col("created_at").alias("requested_at"), F.lit(1).alias("request_id"))
    first = asked.select("*", F.lit("cancelled").alias("status"), F.lit("pending").alias("payment_status"), F.lit("first").alias("notes"))
    again = asked.filter("id % 2 = 0").withColumn("request_id", F.lit(2))
    second = again.select("*", F.lit("expired").alias("status"), F.lit(None).cast("string").alias("payment_status"), F.lit("second").alias("notes"))
    return M.update_memberships(rows, first.unionByName(second), overwrite=True).select("id", "status", "payment_status", "notes")


def _cancelled(r: Roles):
    requests = r.raw("events").select(
        F.col("event_id").alias("request_id"),
        F.col("ts").alias("requested_at"),
        (F.col("event_id") - F.col("event_id") % 4).alias("membership_id"),
        (F.col("user_id") % 25).alias("created_by"),
    )
    return M.cancel_memberships(
        requests,
        r.memberships,
        r.membership_payments,
        r.clients,
        r.plans,
        r.cash_movements,
        r.cash_sessions.withColumn("status", F.when(F.col("id") % 2 == 0, "open").otherwise("closed")),
        r.current_account,
        as_of="1999-06-15",
    )


_CANCEL = """req AS (SELECT event_id AS request_id, ts AS at, event_id - event_id % 4 AS membership_id FROM events),
    swept AS (SELECT m.* REPLACE (CASE WHEN m.status = 'active' AND m.end_date < DATE '1999-06-15' THEN 'expired'
            ELSE m.status END AS status), c.name AS client_name, p.name AS plan_name, p.price
        FROM memberships m JOIN clients c ON c.id = m.client_id JOIN plans p ON p.id = m.plan_id),
    judged AS (SELECT r.*, s.* EXCLUDE (created_at), CASE WHEN s.id IS NULL THEN 'membership_not_found'
            WHEN s.status = 'expired' THEN 'membership_expired' WHEN s.status = 'cancelled' THEN 'membership_already_cancelled'
            WHEN row_number() OVER (PARTITION BY r.membership_id ORDER BY r.at, r.request_id) > 1
            THEN 'membership_already_cancelled' END AS reason
        FROM req r LEFT JOIN swept s ON s.id = r.membership_id),
    good AS (SELECT * FROM judged WHERE reason IS NULL),
    pay AS (SELECT g.*, p.payment_method AS method, p.amount, p.cash_movement_id AS movement, true AS detailed
            FROM good g JOIN membership_payments p ON p.membership_id = g.id
        UNION ALL SELECT g.*, g.payment_method, CAST(greatest(0, g.price - g.discount) AS DECIMAL(12,2)), g.cash_movement_id, false
            FROM good g WHERE g.id NOT IN (SELECT membership_id FROM membership_payments))"""


@query(
    "cancel_memberships_rejected", f"WITH {_CANCEL} SELECT request_id, reason FROM judged WHERE reason IS NOT NULL"
)
def _(r: Roles):
    return _cancelled(r)["rejected"]


@query(
    "cancel_memberships_refunds",
    f"""WITH {_CANCEL} SELECT g.id AS membership_id, v.cash_session_id, 'expense' AS type, v.payment_method, v.amount,
        'Cancelación membresía #' || g.id || ' - ' || g.client_name || ' - ' || g.plan_name AS description
    FROM pay g JOIN cash_movements v ON v.id = g.movement WHERE v.cash_session_id % 2 = 0""",
)
def _(r: Roles):
    return _cancelled(r)["cash_movements"].select(
        "membership_id", "cash_session_id", "type", "payment_method", "amount", "description"
    )


@query(
    "cancel_memberships_ledger",
    f"""WITH {_CANCEL}, opening AS (SELECT client_id, balance FROM current_account
        QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY created_at DESC, id DESC) = 1)
    SELECT g.id AS membership_id, g.client_id, g.amount, CAST(coalesce(o.balance, 0) - sum(g.amount) OVER (PARTITION BY g.client_id
        ORDER BY g.at, g.request_id ROWS UNBOUNDED PRECEDING) AS DECIMAL(18,2)) AS balance
    FROM pay g LEFT JOIN opening o ON o.client_id = g.client_id
    WHERE g.method = 'current_account' AND (NOT g.detailed OR g.amount > 0)""",
)
def _(r: Roles):
    return _cancelled(r)["current_account"].select("membership_id", "client_id", "amount", "balance")

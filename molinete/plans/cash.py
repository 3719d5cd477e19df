"""Drawer sessions and movements (QRY-22 .. QRY-25, JOB-8 .. JOB-10, V-19)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from molinete.functions.scalars import epoch_micros, expense, income
from molinete.operators.rows import Details, enrich, nest
from molinete.schema import INCOME_TYPES

TOTAL = "decimal(38,2)"


def open_session(sessions: DataFrame) -> DataFrame:
    """The open session opened last: no row or one."""
    return sessions.filter("status = 'open'").orderBy(F.desc("opened_at"), F.desc("id")).limit(1)


def session_totals(movements: DataFrame) -> DataFrame:
    """Movement count, income and expenses of each session, in one pass."""
    return movements.groupBy("cash_session_id").agg(
        F.count(F.lit(1)).alias("movements_count"),
        F.sum(income()).cast(TOTAL).alias("total_income"),
        F.sum(expense()).cast(TOTAL).alias("total_expenses"),
    )


def _with_user(sessions: DataFrame, users: DataFrame) -> DataFrame:
    return enrich(sessions, users, "user_id", {"username": "username", "name": "user_name"}, how="inner")


def _with_totals(sessions: DataFrame, movements: DataFrame) -> DataFrame:
    totals = session_totals(movements).withColumnRenamed("cash_session_id", "_session")
    zero = F.lit(0).cast(TOTAL)
    return (
        sessions.join(totals, F.col("id") == F.col("_session"), "left")
        .drop("_session")
        .withColumns(
            {
                "movements_count": F.coalesce("movements_count", F.lit(0)).cast("bigint"),
                "total_income": F.coalesce("total_income", zero),
                "total_expenses": F.coalesce("total_expenses", zero),
            }
        )
    )


def session_history(sessions: DataFrame, movements: DataFrame, users: DataFrame) -> DataFrame:
    """Closed sessions, last closed first, with totals."""
    closed = _with_user(sessions.filter("status = 'closed'"), users)
    return _with_totals(closed, movements).orderBy(F.desc("closed_at"), F.desc("opened_at"), F.desc("id"))


def session_movements(movements: DataFrame, users: DataFrame) -> DataFrame:
    """Movements with their author."""
    return enrich(
        movements, users, "created_by", {"username": "created_by_username", "name": "created_by_name"}, how="inner"
    )


MOVEMENT_FIELDS = (
    "id",
    "type",
    "payment_method",
    "amount",
    "description",
    "created_by",
    "created_by_username",
    "created_by_name",
    "created_at",
)


def session_documents(sessions: DataFrame, movements: DataFrame, users: DataFrame, *, items: int = 10_000) -> DataFrame:
    """Sessions with totals by ``part``, with their movements, newest first, as arrays of at most ``items``."""
    newest_first = {"_age": -epoch_micros("created_at"), "_back": -F.col("id")}
    ordered = session_movements(movements, users).withColumns(newest_first)
    header = _with_totals(_with_user(sessions, users), movements)
    return nest(header, "cash_session_id", {"movements": Details(ordered, ["_age", "_back"], MOVEMENT_FIELDS, sizes=movements)}, items=items)


def session_detail(
    sessions: DataFrame, movements: DataFrame, users: DataFrame, ids: DataFrame | None = None, *, items: int = 10_000
) -> DataFrame:
    """Documents of the sessions named by the one-column ``ids``; of all when it is not given."""
    if ids is not None:
        wanted = ids.select(F.col(ids.columns[0]).alias("id"))
        sessions = sessions.join(wanted, "id", "left_semi")
        movements = movements.join(wanted.withColumnRenamed("id", "cash_session_id"), "cash_session_id", "left_semi")
    return session_documents(sessions, movements, users, items=items)


def open_session_detail(sessions: DataFrame, movements: DataFrame, users: DataFrame, *, items: int = 10_000) -> DataFrame:
    """The open session with its movements; no row when no drawer is open."""
    return session_detail(sessions, movements, users, open_session(sessions).select("id"), items=items)


def income_by_method(movements: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Income per session and method; of the open session alone when ``sessions`` is given.

    A refund is an expense row and does not lower the income of its method.
    """
    rows = movements.filter(F.col("type").isin(*INCOME_TYPES) & F.col("payment_method").isNotNull())
    if sessions is not None:
        rows = rows.filter(F.col("cash_session_id") == open_session(sessions).select("id").scalar())
    return rows.groupBy("cash_session_id", "payment_method").agg(F.sum("amount").cast(TOTAL).alias("total"))


def close_sessions(sessions: DataFrame, movements: DataFrame, counts: DataFrame) -> dict[str, DataFrame]:
    """Close sessions by their counted amounts.

    ``counts``: ``session_id, closing_amount, closing_cash, closing_transfer, closing_card, notes, closed_at``.
    The closing amount is the sum of the given methods if above zero, else ``closing_amount``. Of several valid counts of a session the first
    closes it (by ``closed_at``, then the larger count); the others find it closed.
    """
    zero = F.lit(0).cast("decimal(12,2)")
    by_method = sum(
        (F.coalesce(F.col(c).cast("decimal(12,2)"), zero) for c in ("closing_cash", "closing_transfer", "closing_card")),
        start=zero,
    )
    counted = F.when(by_method > 0, by_method).otherwise(F.col("closing_amount").cast("decimal(12,2)"))
    asked = counts.select(
        F.col("session_id"),
        counted.cast("decimal(18,2)").alias("counted"),
        *[F.col(c).cast("decimal(10,2)") for c in ("closing_cash", "closing_transfer", "closing_card")],
        F.col("notes").alias("new_notes"),
        F.col("closed_at").alias("new_closed_at"),
    )
    state = sessions.select(
        F.col("id"), "user_id", "opening_amount", "status", "opened_at", *(["notes"] if "notes" in sessions.columns else [])
    )
    if "notes" not in sessions.columns:
        state = state.withColumn("notes", F.lit(None).cast("string"))
    checked = asked.join(state, F.col("session_id") == F.col("id"), "left").withColumn(
        "reason",
        F.when(F.col("counted").isNull(), "closing_amount_missing").when(
            F.col("id").isNull() | (F.col("status") != "open"), "session_not_open"
        ),
    )
    valid = F.col("reason").isNull()
    first = Window.partitionBy("session_id", valid).orderBy("new_closed_at", F.desc("counted"))
    judged = (
        checked.withColumn("_turn", F.row_number().over(first))
        .withColumn("reason", F.when(valid & (F.col("_turn") > 1), "session_not_open").otherwise(F.col("reason")))
        .drop("_turn")
    )
    accepted = judged.filter(F.col("reason").isNull())
    money = "decimal(18,2)"
    expected = (F.col("opening_amount") + F.col("total_income") - F.col("total_expenses")).cast(money)
    closed = _with_totals(accepted, movements).select(
        "id",
        "user_id",
        "opening_amount",
        F.col("counted").alias("closing_amount"),
        expected.alias("expected_amount"),
        (F.col("counted") - expected).cast(money).alias("difference"),
        "closing_cash",
        "closing_transfer",
        "closing_card",
        F.lit("closed").alias("status"),
        "opened_at",
        F.col("new_closed_at").alias("closed_at"),
        F.coalesce(F.nullif("new_notes", F.lit("")), "notes").alias("notes"),
    )
    return {"cash_sessions": closed, "rejected": judged.filter("reason IS NOT NULL").select("session_id", "reason")}


def open_sessions(requests: DataFrame, sessions: DataFrame) -> dict[str, DataFrame]:
    """Open a drawer: the first request wins if none is open; every other is rejected.

    ``requests``: ``request_id, requested_at, user_id, opening_amount, notes``.
    """
    already = sessions.filter("status = 'open'").limit(1).agg(F.count(F.lit(1))).scalar()
    first = requests.agg(F.min(F.struct("requested_at", "request_id")).alias("f")).select("f.request_id").scalar()
    wins = (already == 0) & (F.col("request_id") == first)
    opened = requests.filter(wins).select(
        F.col("request_id").alias("id"),
        "user_id",
        F.coalesce(F.col("opening_amount"), F.lit(0)).cast("decimal(10,2)").alias("opening_amount"),
        F.lit("open").alias("status"),
        F.col("requested_at").alias("opened_at"),
        F.nullif("notes", F.lit("")).alias("notes"),
    )
    rejected = requests.filter(~wins).select("request_id", F.lit("session_already_open").alias("reason"))
    return {"cash_sessions": opened, "rejected": rejected}


def post_cash_movements(requests: DataFrame, sessions: DataFrame) -> dict[str, DataFrame]:
    """Manual drawer rows go to the open session; all rejected when there is none.

    ``requests``: ``request_id, requested_at, type, payment_method, amount, description, reference, created_by``.
    """
    attached = requests.withColumn("cash_session_id", open_session(sessions).select("id").scalar())
    posted = attached.filter("cash_session_id IS NOT NULL").select(
        F.col("request_id").alias("id"),
        "cash_session_id",
        "type",
        "payment_method",
        F.col("amount").cast("decimal(10,2)").alias("amount"),
        "description",
        F.nullif("reference", F.lit("")).alias("reference"),
        "created_by",
        F.col("requested_at").alias("created_at"),
    )
    rejected = attached.filter("cash_session_id IS NULL").select("request_id", F.lit("no_open_session").alias("reason"))
    return {"cash_movements": posted, "rejected": rejected}


def session_audit(sessions: DataFrame, movements: DataFrame) -> DataFrame:
    """Closed sessions whose stored expected amount or difference is not the recomputed one."""
    money = "decimal(18,2)"
    rows = _with_totals(
        sessions.filter("status = 'closed'").select(
            "id", "opening_amount", "closing_amount", "expected_amount", "difference"
        ),
        movements,
    )
    expected = (F.col("opening_amount") + F.col("total_income") - F.col("total_expenses")).cast(money)
    return (
        rows.withColumn("recomputed_expected", expected)
        .withColumn("recomputed_difference", (F.col("closing_amount") - F.col("recomputed_expected")).cast(money))
        .filter(
            ~F.col("expected_amount").eqNullSafe(F.col("recomputed_expected"))
            | ~F.col("difference").eqNullSafe(F.col("recomputed_difference"))
        )
        .select("id", "expected_amount", "recomputed_expected", "difference", "recomputed_difference")
    )


def open_session_count(sessions: DataFrame) -> DataFrame:
    """How many sessions are open, and whether that is allowed (at most one)."""
    n = sessions.filter("status = 'open'").agg(F.count(F.lit(1)).alias("open_sessions"))
    return n.withColumn("allowed", F.col("open_sessions") <= 1)

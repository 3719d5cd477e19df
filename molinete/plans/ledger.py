"""Client ledger: balances, statements, debtors, payments, audit (QRY-20/21, JOB-11, V-15)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molinete.functions.predicates import debt_filter
from molinete.functions.scalars import blank_to_null, posted_id, signed_amount
from molinete.operators.rows import enrich, latest_per_key
from molinete.operators.running import HOT_ROWS, Running, running, size_probe
from molinete.plans.cash import open_session

BALANCE = "decimal(18,2)"
PAYMENT_TEXT = "Pago de cuenta corriente"


def running_balance(ledger: DataFrame, *, name: str = "running_balance", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Balance after each row: debits add, credits subtract, in ``(created_at, id)`` order per client."""
    out = running(
        ledger, ["client_id"], ["created_at", "id"], {name: Running("sum", signed_amount())}, hot_rows=hot_rows
    )
    return out.withColumn(name, F.col(name).cast(BALANCE))


def latest_balances(ledger: DataFrame) -> DataFrame:
    """The stored balance of each client's last row."""
    rows = ledger.select("client_id", "created_at", "id", "balance")
    return latest_per_key(rows, ["client_id"], ["created_at", "id"]).select("client_id", "balance")


def client_statement(ledger: DataFrame, users: DataFrame, memberships: DataFrame, plans: DataFrame) -> DataFrame:
    """Every ledger row, newest first per client, with author, plan and the client's current balance."""
    bought = enrich(memberships, plans, "plan_id", {"name": "plan_name"}).select(
        "id", F.col("start_date").alias("membership_date"), "plan_name"
    )
    rows = enrich(ledger, users, "created_by", {"username": "created_by_name"})
    rows = enrich(
        rows, bought, "membership_id", {"membership_date": "membership_date", "plan_name": "plan_name"}
    )
    current = latest_balances(ledger).withColumnRenamed("balance", "current_balance")
    return rows.join(current, "client_id").orderBy("client_id", F.desc("created_at"), F.desc("id"))


def debtors(clients: DataFrame, ledger: DataFrame) -> DataFrame:
    """Clients who owe, largest balance first."""
    owed = debt_filter(latest_balances(ledger), "with_debt")
    return (
        clients.select("id", "name", "phone")
        .join(owed, F.col("id") == F.col("client_id"))
        .select("id", "name", "phone", "balance")
        .orderBy(F.desc("balance"), "id")
    )


def post_to_ledger(
    rows: DataFrame, ledger: DataFrame | None, *, hot_rows: int = HOT_ROWS, sizes: tuple[int, int] | None = None
) -> DataFrame:
    """Give new rows their balance: what the client owed before, plus the running sum of the new rows.

    ``rows`` has ``client_id, type, amount, created_at, source_id, line_no``; ``sizes`` bounds its rows per client.
    """
    if ledger is None:
        opened = rows.withColumn("opening_balance", F.lit(0).cast(BALANCE))
    else:
        opening = latest_balances(ledger).select("client_id", F.col("balance").alias("opening_balance"))
        opened = rows.join(opening, "client_id", "left")
    out = running(
        opened,
        ["client_id"],
        ["created_at", "source_id", "line_no", "amount"],
        {"_moved": Running("sum", signed_amount())},
        hot_rows=hot_rows,
        sizes=sizes,
    )
    balance = (F.coalesce("opening_balance", F.lit(0)) + F.col("_moved")).cast(BALANCE)
    return out.withColumn("balance", balance).drop("_moved", "opening_balance")


def with_keys(rows: DataFrame, job: str) -> DataFrame:
    """Posted rows with ``source_id`` and ``line_no``, and the key those two give."""
    return rows.withColumn("id", posted_id(job, "source_id", "line_no"))


def post_account_payments(requests: DataFrame, ledger: DataFrame, sessions: DataFrame, clients: DataFrame) -> dict[str, DataFrame]:
    """Payments on account: a credit row and an ``income`` drawer row each; rejected without an open drawer or for an unknown client.

    ``requests``: ``request_id, requested_at, client_id, amount, payment_method, description, created_by``.
    Paying more than is owed is allowed and leaves a negative balance. The ledger row and its drawer row have the same key, and the ledger row names it.
    """
    session = open_session(sessions).select("id").scalar()
    text = F.coalesce(blank_to_null("description"), F.lit(PAYMENT_TEXT))
    known = clients.select(F.col("id").alias("_client")).distinct()
    judged = (
        requests.withColumn("cash_session_id", session)
        .join(known, F.col("client_id") == F.col("_client"), "left")
        .withColumn("reason", F.when(F.col("cash_session_id").isNull(), "no_open_session").when(F.col("_client").isNull(), "client_not_found"))
        .drop("_client")
    )
    accepted = judged.filter("reason IS NULL")
    rejected = judged.filter("reason IS NOT NULL").select("request_id", "reason")
    key = posted_id("account_payment", "request_id", F.lit(1))
    credits = accepted.select(
        F.col("request_id").alias("source_id"),
        F.lit(1).alias("line_no"),
        "client_id",
        F.lit("credit").alias("type"),
        "amount",
        text.alias("description"),
        "payment_method",
        key.alias("cash_movement_id"),
        "created_by",
        F.col("requested_at").alias("created_at"),
    )
    movements = accepted.select(
        key.alias("id"),
        "cash_session_id",
        F.lit("income").alias("type"),
        "payment_method",
        "amount",
        text.alias("description"),
        F.concat(F.lit("cuenta_corriente_"), key.cast("string")).alias("reference"),
        "created_by",
        F.col("requested_at").alias("created_at"),
    )
    sizes = size_probe(requests, ["client_id"])
    return {
        "current_account": with_keys(post_to_ledger(credits, ledger, sizes=sizes), "account_payment"),
        "cash_movements": movements,
        "rejected": rejected,
    }


def ledger_audit(ledger: DataFrame, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows whose stored balance is not the running balance."""
    checked = running_balance(ledger, name="expected_balance", hot_rows=hot_rows)
    return checked.filter(~F.col("balance").eqNullSafe(F.col("expected_balance"))).select(
        "id", "client_id", "balance", "expected_balance"
    )

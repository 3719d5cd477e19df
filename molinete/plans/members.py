"""Membership lists, lifecycle and attendance (QRY-15 .. 19, 32, 38; JOB-3 .. 7, 13)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molinete.functions.predicates import (
    by_keys,
    debt_filter,
    ends_in,
    is_active,
    is_expired,
    is_stale,
    opt_filter,
    text_search,
    visible,
)
from molinete.functions.scalars import (
    Money,
    at_least_zero,
    day,
    days_remaining,
    end_date,
    format_day_set,
    money,
    normalize_phone_ar,
    parse_day_set,
    payment_label,
    posted_id,
)
from molinete.operators.attendance import COOLDOWN_MINUTES, attribute_entries, entry_cooldown
from molinete.operators.rows import apply_updates, enrich, latest_per_key, paginate
from molinete.plans.cash import open_session
from molinete.operators.running import HOT_ROWS, Running, running, size_probe
from molinete.plans.ledger import latest_balances, post_to_ledger, with_keys
from molinete.session import durable
from molinete.schema import DRAWER_METHODS, PAYMENT_METHODS, REMINDER_DAYS

Day = date | str
CLASS_PLAN_DAYS = 3
PLAN_COLUMNS = {"name": "plan_name", "price": "plan_price", "duration_days": "plan_duration"}
CLIENT_COLUMNS = {"name": "client_name", "dni": "client_dni", "phone": "client_phone"}


def sweep(memberships: DataFrame, *, as_of: Day) -> DataFrame:
    """Stale memberships shown as ``expired``."""
    return memberships.withColumn("status", F.when(is_stale(as_of), "expired").otherwise(F.col("status")))


def expire_memberships(memberships: DataFrame, *, as_of: Day) -> tuple[DataFrame, DataFrame]:
    """(new snapshot, one-row ``affected`` count). Running it twice changes nothing more."""
    affected = memberships.filter(is_stale(as_of)).agg(F.count(F.lit(1)).alias("affected"))
    return sweep(memberships, as_of=as_of), affected


def update_memberships(memberships: DataFrame, changes: DataFrame, *, overwrite: bool = False) -> DataFrame:
    """Set status, payment status and notes; a NULL leaves the column unless ``overwrite``. Several changes of one membership count in the order they were asked for."""
    order = [c for c in ("requested_at", "request_id") if c in changes.columns]
    asked = changes.select("id", "status", "payment_status", "notes", *order)
    return apply_updates(memberships, asked, ["id"], overwrite=overwrite, order=order)


def list_memberships(
    memberships: DataFrame,
    clients: DataFrame,
    plans: DataFrame,
    users: DataFrame,
    instructors: DataFrame,
    *,
    as_of: Day,
    status: str | None = None,
    plan_id: int | None = None,
    search: str | None = None,
    page: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Newest first. Names that cannot drop rows are joined to the page, not to the table."""
    rows = opt_filter(sweep(memberships, as_of=as_of), status=status, plan_id=plan_id)
    rows = enrich(rows, clients, "client_id", CLIENT_COLUMNS, how="inner")
    rows = enrich(rows, plans, "plan_id", PLAN_COLUMNS, how="inner")
    rows = text_search(rows, ("client_name", "client_dni", "client_phone"), search)
    newest = [F.desc("created_at"), F.desc("id")]
    if page is not None and limit is not None:
        rows = paginate(rows, newest, page, limit)
    rows = enrich(rows, users, "created_by", {"name": "created_by_name"})
    rows = enrich(rows, instructors, "instructor_id", {"name": "instructor_name"})
    return rows.withColumn("days_remaining", days_remaining(as_of)).orderBy(*newest)


def membership_detail(
    memberships: DataFrame,
    clients: DataFrame,
    plans: DataFrame,
    instructors: DataFrame,
    *,
    as_of: Day,
    ids: DataFrame | Sequence[int] | None = None,
) -> DataFrame:
    rows = sweep(memberships, as_of=as_of)
    if ids is not None:
        rows = by_keys(rows, "id", ids)
    rows = enrich(rows, clients, "client_id", CLIENT_COLUMNS, how="inner")
    rows = enrich(rows, plans, "plan_id", PLAN_COLUMNS, how="inner")
    return enrich(rows, instructors, "instructor_id", {"name": "instructor_name"})


def current_membership(memberships: DataFrame, plans: DataFrame, *, as_of: Day) -> DataFrame:
    """Of every client with one in force: the membership ending last."""
    in_force = enrich(memberships.filter(is_active(as_of)), plans, "plan_id", PLAN_COLUMNS, how="inner")
    return latest_per_key(in_force, ["client_id"], ["end_date", "id"]).withColumn(
        "days_remaining", days_remaining(as_of)
    )


def last_expired(memberships: DataFrame, plans: DataFrame, *, as_of: Day) -> DataFrame:
    """Of every client without a membership in force: the lapsed one that ended last."""
    lapsed = enrich(memberships.filter(is_expired(as_of)), plans, "plan_id", {"name": "plan_name"}, how="inner")
    in_force = memberships.filter(is_active(as_of)).select("client_id")
    without = lapsed.join(in_force, "client_id", "left_anti")
    return latest_per_key(without, ["client_id"], ["end_date", "id"])


def lapsed_clients(memberships: DataFrame, *, as_of: Day) -> DataFrame:
    """Ids of clients with an ``expired`` membership and none in force."""
    expired = memberships.filter("status = 'expired'").select("client_id").distinct()
    in_force = memberships.filter(is_active(as_of)).select("client_id")
    return expired.join(in_force, "client_id", "left_anti")


def list_clients(
    clients: DataFrame,
    ledger: DataFrame,
    memberships: DataFrame,
    users: DataFrame,
    *,
    as_of: Day,
    search: str | None = None,
    active: str = "active",
    debt: str = "all",
    days_remaining: int | None = None,
    lapsed: bool = False,
    page: int | None = 1,
    limit: int | None = 10,
) -> DataFrame:
    """Client list with current balance, newest first; ``days_remaining`` (0..5) wins over ``lapsed``."""
    rows = text_search(visible(clients, active), ("name", "username", "dni", "phone"), search)
    if days_remaining in REMINDER_DAYS:
        rows = by_keys(rows, "id", memberships.filter(ends_in(as_of, days_remaining)).select("client_id"))
    elif lapsed:
        rows = by_keys(rows, "id", lapsed_clients(memberships, as_of=as_of))
    newest = [F.desc("created_at"), F.desc("id")]

    def with_balance(part: DataFrame, account: DataFrame) -> DataFrame:
        balances = latest_balances(account).withColumnRenamed("client_id", "_client")
        return part.join(balances, F.col("id") == F.col("_client"), "left").drop("_client")

    if debt not in ("with_debt", "al_day") and page is not None and limit is not None:
        # The balance filters nothing: look up the balances of the page alone.
        rows = paginate(rows, newest, page, limit)
        rows = with_balance(rows, by_keys(ledger, "client_id", rows.select("id")))
    else:
        rows = paginate(debt_filter(with_balance(rows, ledger), debt), newest, page, limit)
    rows = enrich(rows, users, "created_by", {"name": "created_by_name"})
    shown = ["id", "username", "name", "phone", "dni", "active", "created_at", "created_by_name", "balance"]
    return rows.select(*shown).orderBy(*newest)


def with_membership_status(clients: DataFrame, memberships: DataFrame, plans: DataFrame, *, as_of: Day) -> DataFrame:
    """Clients with ``active_membership`` and, where there is none, ``expired_membership`` (structs or NULL)."""
    now = current_membership(memberships, plans, as_of=as_of).select(
        F.col("client_id").alias("_now"),
        F.struct(
            F.col("id").alias("membership_id"),
            "plan_name",
            "end_date",
            "days_remaining",
            F.col("plan_duration").alias("duration_days"),
            F.coalesce("reminder_sent_days", F.lit("")).alias("reminder_sent_days"),
        ).alias("active_membership"),
    )
    past = last_expired(memberships, plans, as_of=as_of).select(
        F.col("client_id").alias("_past"), F.struct("end_date", "status", "plan_name").alias("expired_membership")
    )
    return (
        clients.join(now, F.col("id") == F.col("_now"), "left")
        .join(past, F.col("id") == F.col("_past"), "left")
        .drop("_now", "_past")
    )


def client_entries_list(
    entries: DataFrame,
    memberships: DataFrame,
    plans: DataFrame,
    *,
    client_id: int | None = None,
    page: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Entries with plan and membership end, newest first."""
    bought = enrich(memberships, plans, "plan_id", {"name": "plan_name"}, how="inner").select(
        "id", "plan_name", F.col("end_date").alias("membership_end_date")
    )
    rows = enrich(
        opt_filter(entries, client_id=client_id),
        bought,
        "membership_id",
        {"plan_name": "plan_name", "membership_end_date": "membership_end_date"},
        how="inner",
    ).select("id", "client_id", "entered_at", "plan_name", "membership_end_date")
    newest = [F.desc("entered_at"), F.desc("id")]
    return paginate(rows, newest if client_id is not None else ["client_id", *newest], page, limit)


def reminder_worklist(
    memberships: DataFrame, clients: DataFrame, plans: DataFrame, *, as_of: Day, days: Sequence[int] = (5, 3, 1)
) -> DataFrame:
    """Memberships in force whose remaining days call for a reminder not sent yet."""
    left = days_remaining(as_of)
    due = memberships.filter(
        is_active(as_of)
        & (F.col("end_date") <= F.date_add(day(as_of), max(days)))
        & left.isin(*days)
        & ~F.array_contains(parse_day_set("reminder_sent_days"), left)
    ).withColumn("days_remaining", left)
    named = enrich(due, clients, "client_id", {"name": "client_name", "phone": "_phone"}, how="inner")
    return (
        enrich(named, plans, "plan_id", {"name": "plan_name"}, how="inner")
        .withColumn("whatsapp_phone", normalize_phone_ar("_phone"))
        .select(
            F.col("id").alias("membership_id"),
            "client_id",
            "client_name",
            "whatsapp_phone",
            "plan_name",
            "end_date",
            "days_remaining",
            "reminder_sent_days",
        )
        .orderBy("days_remaining", "membership_id")
    )


def record_reminders(memberships: DataFrame, sent: DataFrame, *, as_of: Day) -> dict[str, DataFrame]:
    """Add sent days to each membership's set. ``sent``: ``request_id, membership_id, days_remaining``."""
    state = memberships.select(F.col("id").alias("membership_id"), is_active(as_of).alias("_live"))
    judged = sent.join(state, "membership_id", "left").withColumn(
        "reason",
        F.when(~F.coalesce(F.col("days_remaining").isin(*REMINDER_DAYS), F.lit(False)), "day_out_of_range").when(
            ~F.coalesce("_live", F.lit(False)), "membership_not_active"
        ),
    )
    added = (
        judged.filter("reason IS NULL")
        .groupBy(F.col("membership_id").alias("_m"))
        .agg(F.collect_set("days_remaining").alias("_days"))  # at most six values
    )
    merged = F.array_union(parse_day_set("reminder_sent_days"), F.col("_days").cast("array<int>"))
    snapshot = (
        memberships.join(added, F.col("id") == F.col("_m"), "left")
        .withColumn(
            "reminder_sent_days",
            F.when(F.col("_days").isNull(), F.col("reminder_sent_days")).otherwise(format_day_set(merged)),
        )
        .drop("_m", "_days")
    )
    return {"memberships": snapshot, "rejected": judged.filter("reason IS NOT NULL").select("request_id", "reason")}


def register_entries(
    swipes: DataFrame,
    clients: DataFrame,
    memberships: DataFrame,
    last_entries: DataFrame | None = None,
    *,
    minutes: int = COOLDOWN_MINUTES,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Swipes with ``accepted``, ``reason``, the membership used and ``next_allowed_at``.

    ``swipes``: ``id, client_id, entered_at`` (and more). A swipe needs a client, a
    membership in force that day, and ``minutes`` since the last accepted entry.
    """
    known = clients.select(F.col("id").alias("client_id"), F.lit(True).alias("_known"))
    judged = attribute_entries(swipes, memberships).join(known, "client_id", "left")
    # Written once: the cooldown reads its swipes several times, and their judgement is not to be worked out anew each time.
    judged = durable(judged.withColumn("_cooled", F.coalesce(F.col("_known") & F.col("membership_id").isNotNull(), F.lit(False))))
    both = entry_cooldown(judged, minutes=minutes, last_entries=last_entries, eligible=F.col("_cooled"))
    earlier = Running("max", F.when(F.col("accepted"), F.col("entered_at")), inclusive=False)
    sizes = size_probe(swipes, ["client_id"])
    timed = running(both, ["client_id"], ["entered_at", "id"], {"_last": earlier}, hot_rows=hot_rows, sizes=sizes)
    if last_entries is not None:
        before = last_entries.groupBy("client_id").agg(F.max("entered_at").alias("_before"))
        timed = timed.join(before, "client_id", "left").withColumn("_last", F.greatest("_last", "_before")).drop("_before")
    reason = (
        F.when(F.col("accepted"), None)
        .when(F.col("_known").isNull(), "client_not_found")
        .when(~F.col("_cooled"), "no_active_membership")
        .otherwise("cooldown")
    )
    wait = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    return (
        timed.withColumn("reason", reason)
        .withColumn("next_allowed_at", F.when(F.col("reason") == "cooldown", F.col("_last") + wait))
        .drop("_known", "_cooled", "_last", "entry_day", "membership_end_date")
    )


# --- enrolment -------------------------------------------------------------


def _requested_payments(amount_due: Column) -> Column:
    """Usable payments of a request; a single method without an amount pays what is due."""
    usable = F.filter(
        F.transform(
            F.coalesce("payments", F.array().cast("array<struct<payment_method:string,amount:decimal(12,2)>>")),
            lambda p: F.struct(F.trim(p["payment_method"]).alias("payment_method"), money(p["amount"]).alias("amount")),
        ),
        lambda p: p["payment_method"].isin(*PAYMENT_METHODS) & (p["amount"] > 0),
    )
    single = F.array(F.struct(F.col("payment_method").alias("payment_method"), money(amount_due).alias("amount")))
    return F.when(F.size(usable) > 0, usable).when(F.col("payment_method").isin(*PAYMENT_METHODS), single)


def payment_count(payments: str = "payments") -> Column:
    """At most how many payment rows a request gives rise to."""
    return F.greatest(F.coalesce(F.size(payments), F.lit(1)), F.lit(1))


def _paid(payments: Column) -> Column:
    return F.aggregate(payments, F.lit(0).cast("decimal(18,2)"), lambda s, p: (s + p["amount"]).cast("decimal(18,2)"))


def _instructor_rule(requests: DataFrame, plan_instructors: DataFrame) -> DataFrame:
    """Adds ``final_instructor_id`` and ``instructor_reason``."""
    per_plan = plan_instructors.groupBy("plan_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("instructor_id").alias("_only")
    )
    pairs = plan_instructors.select(
        "plan_id", F.col("instructor_id").alias("_asked"), F.lit(True).alias("_belongs")
    ).distinct()
    n = F.coalesce("_n", F.lit(0))
    asked = F.col("_asked")
    given = asked.isNotNull() & ((n > 1) | (asked != 0))
    return (
        requests.withColumn("_asked", F.col("instructor_id"))
        .join(per_plan, "plan_id", "left")
        .join(pairs, ["plan_id", "_asked"], "left")
        .withColumn(
            "instructor_reason",
            F.when((n > 1) & asked.isNull(), "instructor_required").when(
                (n > 0) & given & F.col("_belongs").isNull(), "instructor_not_in_plan"
            ),
        )
        .withColumn("final_instructor_id", F.when(n == 0, None).when((n == 1) & ~given, F.col("_only")).otherwise(asked))
        .drop("_n", "_only", "_asked", "_belongs")
    )


def _in_force_before(
    judged: DataFrame, memberships: DataFrame, *, as_of: Day, hot_rows: int, sizes: tuple[int, int]
) -> DataFrame:
    """Adds ``in_force_end``: the latest end among the client's memberships in force when the request is decided.

    Requests of one client depend on those accepted before, but only on the latest
    end in force, which never falls:

    * a class plan is always accepted, so its ends form a running maximum;
    * with nothing in force, the first request that takes force is accepted;
    * a longer plan is otherwise accepted only if it starts on that latest end, and
      takes force only if it starts by ``as_of``: so only while that end is ``as_of``
      itself, and the first such request that ends later lifts it for good.

    So three running values per client, in one partitioning, replace a fold over
    the client's requests.
    """
    today = day(as_of)
    order = ["requested_at", "request_id"]
    current = (
        memberships.filter(is_active(as_of))
        .groupBy(F.col("client_id").alias("_c0"))
        .agg(F.max("end_date").alias("_s0"))
    )
    takes_force = F.col("_valid") & (F.col("start") <= today) & (F.col("new_end") >= today)
    rows = (
        judged.join(current, F.col("client_id") == F.col("_c0"), "left").drop("_c0").withColumn("_force", takes_force)
    )
    taker = F.struct(*order, F.col("new_end").alias("end"))
    first = Running("min", F.when(F.col("_force") & F.col("_s0").isNull(), taker), inclusive=False)
    classes = Running("max", F.when(F.col("_force") & F.col("is_class"), F.col("new_end")), inclusive=False)
    rows = running(
        rows, ["client_id"], order, {"_p0": first, "_class_end": classes}, hot_rows=hot_rows, sizes=sizes
    )
    lifts = (
        F.col("_force")
        & (F.col("new_end") > today)
        & (F.coalesce("_s0", F.col("_p0.end")) == today)
        & (F.col("is_class") | (F.col("start") == today))
    )
    second = Running("min", F.when(lifts, taker), inclusive=False)
    rows = running(rows, ["client_id"], order, {"_p1": second}, hot_rows=hot_rows, sizes=sizes)
    in_force = F.greatest("_s0", F.col("_p0.end"), F.col("_p1.end"), F.col("_class_end"))
    return rows.withColumn("in_force_end", in_force).drop("_s0", "_p0", "_p1", "_class_end", "_force")


def judge_enrolments(
    requests: DataFrame,
    clients: DataFrame,
    plans: DataFrame,
    plan_instructors: DataFrame,
    memberships: DataFrame,
    sessions: DataFrame,
    *,
    as_of: Day,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Requests with everything their acceptance turns on, and ``reason`` (NULL = accepted).

    ``requests``: ``request_id, requested_at, client_id, plan_id, instructor_id, start_date`` (text or
    date), ``payment_method, payments, discount, notes, created_by``.
    """
    plan = plans.filter("active").select(
        F.col("id").alias("_plan"),
        F.col("name").alias("plan_name"),
        F.col("price").alias("plan_price"),
        F.col("duration_days").alias("plan_duration"),
    )
    client = clients.select(F.col("id").alias("_client"), F.lit(True).alias("_client_known"))
    drawer = open_session(sessions).select("id").scalar()
    zero = F.lit(0).cast(Money)
    off = at_least_zero(money(F.coalesce(F.col("discount").cast(Money), zero)))
    rows = (
        requests.withColumn("start", F.col("start_date").try_cast("date"))
        .join(plan, F.col("plan_id") == F.col("_plan"), "left")
        .join(client, F.col("client_id") == F.col("_client"), "left")
        .withColumn("discount_amount", off)
        .withColumn("amount_due", at_least_zero(money(F.col("plan_price") - F.col("discount_amount"))))
        .withColumn("paid_with", _requested_payments(F.col("amount_due")))
        .withColumn("new_end", end_date("start", "plan_duration"))
        .withColumn("is_class", F.coalesce(F.col("plan_duration") <= CLASS_PLAN_DAYS, F.lit(False)))
        .withColumn("drawer_id", drawer)
        .drop("_client")
    )
    rows = _instructor_rule(rows, plan_instructors)
    methods = F.transform("paid_with", lambda p: p["payment_method"])
    by_drawer = F.exists("paid_with", lambda p: p["payment_method"].isin(*DRAWER_METHODS))
    gap = F.abs(_paid(F.col("paid_with")) - F.col("amount_due"))
    first = F.when(F.col("start").isNull(), "invalid_start_date").when(F.col("_plan").isNull(), "plan_not_found")
    after = (
        F.when(F.col("paid_with").isNull(), "payment_missing")
        .when(gap > F.lit("0.01").cast(Money), "payments_do_not_sum")
        .when(by_drawer & F.col("drawer_id").isNull(), "no_open_session")
        .when(F.col("instructor_reason").isNotNull(), F.col("instructor_reason"))
        .when(F.col("_client_known").isNull(), "client_not_found")
    )
    rows = (
        rows.withColumn("methods", methods)
        .withColumn("_first", first)
        .withColumn("_after", after)
        .withColumn("_valid", F.col("_first").isNull() & F.col("_after").isNull())
    )
    sizes = size_probe(requests, ["client_id"])
    rows = _in_force_before(rows, memberships, as_of=as_of, hot_rows=hot_rows, sizes=sizes)
    blocked = ~F.col("is_class") & F.col("in_force_end").isNotNull() & (F.col("start") != F.col("in_force_end"))
    reason = F.coalesce(F.col("_first"), F.when(blocked, "membership_in_force"), F.col("_after"))
    return rows.withColumn("reason", reason).drop(
        "_plan", "_client_known", "_first", "_after", "_valid", "instructor_reason"
    )


def enrol(
    requests: DataFrame,
    clients: DataFrame,
    plans: DataFrame,
    plan_instructors: DataFrame,
    memberships: DataFrame,
    sessions: DataFrame,
    ledger: DataFrame | None = None,
    *,
    as_of: Day,
    hot_rows: int = HOT_ROWS,
) -> dict[str, DataFrame]:
    """Enrol memberships from a request table; each request is taken whole or rejected with a reason.

    New rows use ``request_id`` as their key and ``(request_id, line_no)`` for their payments.
    """
    judged = judge_enrolments(
        requests, clients, plans, plan_instructors, memberships, sessions, as_of=as_of, hot_rows=hot_rows
    )
    accepted = judged.filter("reason IS NULL")
    on_account = F.array_contains("methods", "current_account")
    drawer_line = F.array_position(F.transform("methods", lambda m: m.isin(*DRAWER_METHODS)), True)
    made = accepted.select(
        F.col("request_id").alias("id"),
        "client_id",
        "plan_id",
        F.col("final_instructor_id").alias("instructor_id"),
        F.col("start").alias("start_date"),
        F.col("new_end").alias("end_date"),
        F.lit("active").alias("status"),
        payment_label(F.col("methods")).alias("payment_method"),
        F.when(on_account, "pending").otherwise("paid").alias("payment_status"),
        F.when(~on_account, F.col("requested_at")).alias("paid_at"),
        F.when((drawer_line > 0) & (F.col("amount_due") > 0), drawer_line).cast("int").alias("cash_movement_line"),
        F.when(
            (drawer_line > 0) & (F.col("amount_due") > 0) & F.col("drawer_id").isNotNull(), posted_id("membership", "request_id", drawer_line)
        ).alias("cash_movement_id"),
        F.col("discount_amount").alias("discount"),
        "notes",
        F.lit("").alias("reminder_sent_days"),
        "created_by",
        F.col("requested_at").alias("created_at"),
    )
    lines = accepted.select(
        F.col("request_id").alias("membership_id"),
        "client_id",
        "plan_name",
        "drawer_id",
        "created_by",
        F.col("requested_at").alias("created_at"),
        F.posexplode("paid_with").alias("line_no", "payment"),
    ).select("*", (F.col("line_no") + 1).alias("_line"), "payment.*")
    lines = lines.drop("payment", "line_no").withColumnRenamed("_line", "line_no")
    in_drawer = F.col("payment_method").isin(*DRAWER_METHODS) & F.col("drawer_id").isNotNull() & (F.col("amount") > 0)
    line_id = posted_id("membership", "membership_id", "line_no")
    payments = lines.select(
        line_id.alias("id"),
        "membership_id",
        "line_no",
        "payment_method",
        "amount",
        F.when(in_drawer, line_id).alias("cash_movement_id"),
        in_drawer.alias("in_drawer"),
        "created_at",
    )
    movements = lines.filter(in_drawer).select(
        line_id.alias("id"),
        F.col("membership_id").alias("source_id"),
        "line_no",
        F.col("drawer_id").alias("cash_session_id"),
        F.lit("membership_payment").alias("type"),
        "payment_method",
        "amount",
        F.concat(F.lit("Pago de membresía - "), "plan_name").alias("description"),
        "created_by",
        "created_at",
    )
    debits = lines.filter("payment_method = 'current_account'").select(
        F.col("membership_id").alias("source_id"),
        "line_no",
        "client_id",
        "membership_id",
        F.lit("debit").alias("type"),
        "amount",
        F.concat(F.lit("Membresía - "), "plan_name").alias("description"),
        "created_by",
        "created_at",
    )
    sizes = size_probe(requests, ["client_id"], payment_count())
    entries = accepted.filter("plan_duration = 1").select(
        posted_id("membership", "request_id", F.lit(0)).alias("id"),
        F.col("request_id").alias("membership_id"), "client_id", F.col("requested_at").alias("entered_at"), "created_by"
    )
    return {
        "memberships": made,
        "membership_payments": payments,
        "cash_movements": movements,
        "current_account": with_keys(post_to_ledger(debits, ledger, hot_rows=hot_rows, sizes=sizes), "membership"),
        "client_entries": entries,
        "rejected": judged.filter("reason IS NOT NULL").select("request_id", "reason"),
    }


def open_reversals(payments: DataFrame, movements: DataFrame, sessions: DataFrame) -> DataFrame:
    """Drawer movements behind payments whose session is still open: what a cancellation gives back.

    ``payments`` has ``cash_movement_id`` plus any columns to carry along.
    """
    moved = movements.select(
        F.col("id").alias("_movement"),
        F.col("amount").alias("moved_amount"),
        F.coalesce("payment_method", F.lit("cash")).alias("moved_method"),
        "cash_session_id",
    )
    still_open = sessions.filter("status = 'open'").select(F.col("id").alias("cash_session_id"))
    return (
        payments.join(moved, F.col("cash_movement_id") == F.col("_movement"))
        .join(still_open, "cash_session_id", "left_semi")
        .drop("_movement")
    )


def cancel_memberships(
    requests: DataFrame,
    memberships: DataFrame,
    payments: DataFrame,
    clients: DataFrame,
    plans: DataFrame,
    movements: DataFrame,
    sessions: DataFrame,
    ledger: DataFrame | None = None,
    *,
    as_of: Day,
    hot_rows: int = HOT_ROWS,
) -> dict[str, DataFrame]:
    """Cancel memberships still active after the expiry sweep.

    ``requests``: ``request_id, requested_at, membership_id, created_by``; of several for one
    membership the first counts. Account payments are credited; drawer payments are
    given back as ``expense`` rows while their session is open. Memberships without
    payment rows use their own header.
    """
    state = (
        enrich(sweep(memberships, as_of=as_of), clients, "client_id", {"name": "client_name"}, how="inner")
        .transform(lambda df: enrich(df, plans, "plan_id", {"name": "plan_name", "price": "plan_price"}, how="inner"))
        .select(
            F.col("id").alias("membership_id"),
            "client_id",
            "status",
            F.col("payment_method").alias("header_method"),
            F.col("cash_movement_id").alias("header_movement"),
            F.coalesce("discount", F.lit(0)).alias("discount"),
            "client_name",
            "plan_name",
            "plan_price",
        )
    )
    firsts = requests.groupBy("membership_id").agg(F.min(F.struct("requested_at", "request_id")).alias("_first"))
    judged = (
        requests.join(firsts, "membership_id")
        .join(state, "membership_id", "left")
        .withColumn(
            "reason",
            F.when(F.col("status").isNull(), "membership_not_found")
            .when(F.col("status") == "expired", "membership_expired")
            .when(F.col("status") == "cancelled", "membership_already_cancelled")
            .when(F.col("request_id") != F.col("_first.request_id"), "membership_already_cancelled"),
        )
        .drop("_first")
    )
    accepted = judged.filter("reason IS NULL")
    detail = payments.select("membership_id", "payment_method", "amount", "cash_movement_id")
    with_rows = accepted.join(detail, "membership_id")
    due = at_least_zero(money(F.col("plan_price") - F.col("discount")))
    from_header = (
        accepted.join(detail.select("membership_id"), "membership_id", "left_anti")
        .withColumn("payment_method", F.col("header_method"))
        .withColumn("amount", due)
        .withColumn("cash_movement_id", F.col("header_movement"))
    )
    on_account = F.col("payment_method") == "current_account"
    columns = [
        "request_id",
        "requested_at",
        "membership_id",
        "client_id",
        "client_name",
        "plan_name",
        "payment_method",
        "amount",
        "cash_movement_id",
        "created_by",
    ]
    # A payment row of zero is not credited; a header of zero is.
    to_credit = with_rows.filter(on_account & (F.col("amount") > 0)).select(*columns).unionByName(
        from_header.filter(on_account).select(*columns)
    )
    credits = to_credit.select(
        F.col("request_id").alias("source_id"),
        F.lit(1).alias("line_no"),
        "client_id",
        "membership_id",
        F.lit("credit").alias("type"),
        "amount",
        F.concat(F.lit("Cancelación membresía - "), "plan_name").alias("description"),
        "created_by",
        F.col("requested_at").alias("created_at"),
    )
    paid = with_rows.select(*columns).unionByName(from_header.select(*columns)).filter("cash_movement_id IS NOT NULL")
    given_back = open_reversals(paid, movements, sessions).select(
        "membership_id",
        "cash_session_id",
        F.lit("expense").alias("type"),
        F.col("moved_method").alias("payment_method"),
        F.col("moved_amount").alias("amount"),
        F.concat(
            F.lit("Cancelación membresía #"),
            F.col("membership_id").cast("string"),
            F.lit(" - "),
            "client_name",
            F.lit(" - "),
            "plan_name",
        ).alias("description"),
        "created_by",
        F.col("requested_at").alias("created_at"),
    )
    return {
        "cancelled": accepted.select("membership_id"),
        "cash_movements": given_back,
        "current_account": post_to_ledger(credits, ledger, hot_rows=hot_rows),
        "rejected": judged.filter("reason IS NOT NULL").select("request_id", "reason"),
    }


def apply_cancellations(memberships: DataFrame, cancelled: DataFrame) -> DataFrame:
    """New membership snapshot after :func:`cancel_memberships`."""
    changes = cancelled.select(F.col("membership_id").alias("id"), F.lit("cancelled").alias("status"))
    return apply_updates(memberships, changes, ["id"])



"""Column functions (FN-*, PRJ-*): all built-in expressions, no Python UDF."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from molinete.schema import INCOME_TYPES

Money = "decimal(12,2)"


def day(d: date | str) -> Column:
    return F.lit(str(d)).cast("date")


def months_before(as_of: date | str, months: int) -> Column:
    """Clamps to the month's end, as calendar subtraction does."""
    return F.add_months(day(as_of), -months)


def month_label(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM")


def days_remaining(as_of: date | str, end: str | Column = "end_date") -> Column:
    return F.datediff(end, day(as_of))


def end_date(start: str | Column, duration: str | Column) -> Column:
    return F.date_add(start, duration)


def epoch_seconds(ts: str | Column) -> Column:
    """Whole wall-clock seconds since 1970 of a time-zone-free timestamp, whatever the session's zone."""
    col = F.col(ts) if isinstance(ts, str) else ts
    clock = F.hour(col) * 3600 + F.minute(col) * 60 + F.second(col)
    return F.unix_date(F.to_date(col)).cast("bigint") * 86_400 + clock


def epoch_micros(ts: str | Column) -> Column:
    """The same in microseconds, fractions kept."""
    col = F.col(ts) if isinstance(ts, str) else ts
    fraction = (F.extract(F.lit("SECOND"), col) * 1_000_000).cast("bigint") % 1_000_000
    return epoch_seconds(col) * 1_000_000 + fraction


def blank_to_null(c: str | Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def product_code(c: str | Column) -> Column:
    return F.upper(F.trim(c))


def money(c: Column) -> Column:
    """Two places, HALF_UP, on decimals."""
    return F.round(c, 2).cast(Money)


def line_subtotal(price: str | Column, quantity: str | Column) -> Column:
    p = F.col(price) if isinstance(price, str) else price
    q = F.col(quantity) if isinstance(quantity, str) else quantity
    return money(p.cast("decimal(12,2)") * q.cast("decimal(12,3)"))


def at_least_zero(c: Column) -> Column:
    return F.greatest(c, F.lit(0).cast("decimal(12,2)"))


def non_negative_or_zero(c: str | Column, type_: str = "decimal(12,2)") -> Column:
    """A number that is missing, not a number or negative counts as zero."""
    col = F.col(c) if isinstance(c, str) else c
    n = col.try_cast(type_)
    return F.when(n >= 0, n).otherwise(F.lit(0).cast(type_))


def signed_amount(type_: str | Column = "type", amount: str | Column = "amount") -> Column:
    """Ledger sign: a debit adds to what the client owes, a credit lowers it."""
    t = F.col(type_) if isinstance(type_, str) else type_
    a = F.col(amount) if isinstance(amount, str) else amount
    return F.when(t == "debit", a).otherwise(-a)


def income(type_: str = "type", amount: str = "amount") -> Column:
    return F.when(F.col(type_).isin(*INCOME_TYPES), F.col(amount)).otherwise(F.lit(0))


def expense(type_: str = "type", amount: str = "amount") -> Column:
    return F.when(F.col(type_) == "expense", F.col(amount)).otherwise(F.lit(0))


def payment_label(methods: Column) -> Column:
    """One method keeps its name, several become ``combined``."""
    return F.when(F.size(methods) == 1, methods[0]).otherwise(F.lit("combined"))


def normalize_phone_ar(c: str | Column) -> Column:
    """Argentine number to international digits (no ``+``), NULL if it cannot be one."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(n < 10, None)
        .when(
            digits.startswith("54"),
            F.when(
                (n == 12) & (F.substring(digits, 3, 1) != "9"),
                F.concat(F.lit("549"), F.substr(digits, F.lit(3))),
            ).when(n >= 12, digits),
        )
        .when((n == 11) & digits.startswith("15"), F.concat(F.lit("549"), F.substr(digits, F.lit(3))))
        .when(n == 10, F.concat(F.lit("549"), digits))
    )


def is_email(c: str | Column) -> Column:
    return F.rlike(c, F.lit(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"))


def leading_int(c: Column) -> Column:
    """The integer a text starts with, NULL if none."""
    return F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("int")


def parse_day_set(csv: str | Column) -> Column:
    """``'5, 3,x'`` -> ``[5, 3]``; NULL and blank give an empty array."""
    text = F.coalesce(csv if isinstance(csv, Column) else F.col(csv), F.lit(""))
    return F.array_distinct(F.array_compact(F.transform(F.split(text, ","), leading_int)))


def format_day_set(days: Column) -> Column:
    """Array of days to CSV, largest first."""
    return F.array_join(F.transform(F.sort_array(days, asc=False), lambda d: d.cast("string")), ",")


def half_up_ratio(total: Column, n: Column) -> Column:
    """``total / n`` with one decimal, half up, in exact integer arithmetic; 0 when either is 0."""
    safe = F.greatest(n, F.lit(1))
    doubled = F.lit(2) * safe
    tenths = ((F.lit(20) * total + safe - F.pmod(F.lit(20) * total + safe, doubled)) / doubled).cast("decimal(18,0)")
    ratio = (tenths / F.lit(10)).cast("decimal(18,1)")
    return F.when((total > 0) & (n > 0), ratio).otherwise(F.lit(0).cast("decimal(18,1)"))


def weekday_rank(c: str | Column, names: tuple[str, ...]) -> Column:
    """Position in ``names`` from 1; 0 (sorts first) for anything else."""
    return F.find_in_set(c, F.lit(",".join(names)))


# The jobs whose rows get keys of their own.
POSTED_BY = {"sale": 1, "membership": 2, "account_payment": 3, "sale_cancellation": 4}


def posted_id(job: str, request: str | Column, line: str | Column) -> Column:
    """The key of a row that a job posts, from its request and line: the same on every run, and no two alike.

    Job, request and line stand side by side in 62 bits above all keys below 2**58, so nothing is counted or looked up. A request
    beyond 2**43 or a line beyond 2**15 stops the query.
    """
    request, line = (F.col(c) if isinstance(c, str) else c for c in (request, line))
    fits = request.between(0, (1 << 43) - 1) & line.between(0, (1 << 15) - 1)
    key = F.lit(POSTED_BY[job] << 58).cast("bigint") + request.cast("bigint") * (1 << 15) + line.cast("bigint")
    return F.when(fits, key).otherwise(F.raise_error(F.lit("request or line number too large for a key")).cast("bigint"))

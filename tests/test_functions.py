from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from molinete.functions import predicates as P
from molinete.functions import scalars as S
from molinete.operators.rows import apply_updates, page_after, page_info, paginate
from molinete.plans import quality as Q
from molinete.plans.stock import alert_type

PHONES = {
    "381 1234567": "5493811234567",
    "+54 381 1234567": "5493811234567",
    "+54 9 381 1234567": "5493811234567",
    "15 381 123456": "549381123456",
    "3815000001": "5493815000001",
    "15 381 1234567": None,  # twelve digits: not a number the rule knows, whatever its written examples say
    "0381-1234567": None,
    "5438112345": None,
    "123": None,
    "": None,
    None: None,
}


def test_phones(spark):
    df = spark.createDataFrame([(k,) for k in PHONES], "p string")
    assert {r.p: r.n for r in df.select("p", S.normalize_phone_ar("p").alias("n")).collect()} == PHONES


def test_day_sets(spark):
    rows = [("", 5, "5"), ("5", 3, "5,3"), ("3", 5, "5,3"), ("5, 3,x,5", 1, "5,3,1"), (None, 0, "0"), ("10,2", 5, "10,5,2")]
    df = spark.createDataFrame(rows, "old string, add int, want string")
    out = df.withColumn("new", S.format_day_set(F.array_union(S.parse_day_set("old"), F.array("add"))))
    assert out.filter("NOT (new <=> want)").count() == 0


def test_ratio_is_half_up(spark):
    df = spark.createDataFrame([(29, 20, "1.5"), (145, 100, "1.5"), (144, 100, "1.4"), (0, 5, "0.0"), (5, 0, "0.0")], "t bigint, n bigint, w string")
    got = df.filter("true").select(F.when(F.col("n") > 0, S.half_up_ratio(F.col("t"), F.greatest("n", F.lit(1)))).otherwise(0).alias("x"), "w").collect()
    assert all(r.x == D(r.w) for r in got)


def test_money_and_numbers(spark):
    r = spark.createDataFrame([("1.005", "-3", "x", " a1 ", "  ")], "a string, b string, c string, d string, e string").select(
        S.money(F.col("a").cast("decimal(10,3)")).alias("a"),
        S.non_negative_or_zero("b").alias("b"),
        S.non_negative_or_zero("c").alias("c"),
        S.product_code("d").alias("d"),
        S.blank_to_null("e").alias("e"),
        S.line_subtotal(F.lit("3.33"), F.lit("1.250")).alias("f"),
    ).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == (D("1.01"), 0, 0, "A1", None, D("4.16"))


def test_wall_clock_ignores_the_session_zone(spark):
    rows = [dt.datetime(2024, 3, 10, 1, 59, 59), dt.datetime(2024, 3, 10, 2, 30, 0, 250000), dt.datetime(1969, 12, 31, 23, 59, 59, 999999)]
    df = spark.createDataFrame([(t,) for t in rows], "t timestamp_ntz")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = [tuple(r) for r in df.select(S.epoch_seconds("t"), S.epoch_micros("t")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    day = dt.timedelta(microseconds=1)
    want = [(t - dt.datetime(1970, 1, 1)) // day for t in rows]
    assert [g[1] for g in got] == want and [g[0] for g in got] == [w // 1_000_000 for w in want]


def test_text_search(spark):
    df = spark.createDataFrame([(1, "María González", "x"), (2, "MARIA", None), (3, "Juan", "50%_a"), (4, None, None)], "id int, a string, b string")
    ids = lambda t: {r.id for r in P.text_search(df, ["a", "b"], t).collect()}
    assert ids("maria") == ids(" MARÍA ") == {1, 2} and ids("gonzalez") == {1}
    assert ids("m_r%a") == {1, 2} and ids("ju%n") == {3} and ids("  ") == {1, 2, 3, 4} and ids(None) == {1, 2, 3, 4}


def test_one_accent_rule_with_and_without_wildcards(spark):
    names = ["Nováček", "NOVACEK", "Nova\u0301c\u030cek", "Łukasz Ő", "novak"]
    df = spark.createDataFrame(list(enumerate(names)), "id int, a string")
    for term in ("acek", "acek%", "a_ek", "ÁČEK"):
        assert {r.id for r in P.text_search(df, ["a"], term).collect()} == {0, 1, 2}
    assert {r.id for r in P.text_search(df, ["a"], "sz o").collect()} == {3}


def test_key_lists_of_any_length(spark):
    df = spark.range(5000)
    assert P.by_keys(df, "id", range(10, 4010)).count() == 4000
    assert P.by_keys(df, "id", []).count() == 0


def test_validity_and_periods(spark):
    d = dt.date(2024, 1, 31)
    rows = [(1, "active", d, d), (2, "active", d - dt.timedelta(9), d - dt.timedelta(1)), (3, "expired", d, d), (4, "active", d + dt.timedelta(1), d + dt.timedelta(2))]
    df = spark.createDataFrame(rows, "id int, status string, start_date date, end_date date")
    ids = lambda c: {r.id for r in df.filter(c).collect()}
    assert ids(P.is_active(d)) == {1} and ids(P.is_stale(d)) == {2} and ids(P.is_expired(d)) == {2, 3}
    ts = spark.createDataFrame([(dt.datetime(2024, 1, 31, 23, 59, 59),), (dt.datetime(2024, 2, 1),), (dt.datetime(2023, 12, 31, 23, 0),)], "t timestamp_ntz")
    assert P.in_period(ts, "t", "2024-01-01", d).count() == 1
    assert P.enum_filter(df, "status", "lost", ("active",)).count() == 4


def test_stock_alert_edges(spark):
    rows = [("0", 10, "out"), ("-1", 10, "out"), ("9.999", 10, "low"), ("10", 10, "near"), ("11.999", 10, "near"), ("12", 10, None), ("1", 0, None)]
    df = spark.createDataFrame([(D(a), D(b), w) for a, b, w in rows], "stock decimal(12,3), min_stock decimal(12,3), w string")
    assert df.filter(~alert_type().eqNullSafe(F.col("w"))).count() == 0


def test_pages(spark):
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, base + dt.timedelta(days=i // 3)) for i in range(25)], "id bigint, created_at timestamp_ntz")
    newest = [F.desc("created_at"), F.desc("id")]
    whole = [r.id for r in paginate(df, newest, None, None).collect()]
    assert [r.id for r in paginate(df, newest, 2, 10).collect()] == whole[10:20]
    assert len(paginate(df, newest, -4, 0).collect()) == 1
    info = page_info(df, 1, 10).first()
    assert (info.total, info.total_pages) == (25, 3)
    assert page_info(df.limit(0)).first().total_pages == 1
    seen, last = [], None
    while True:
        page = page_after(df, "created_at", last, 7).collect()
        if not page:
            break
        seen += [r.id for r in page]
        last = (page[-1].created_at, page[-1].id)
    assert seen == whole


def test_apply_updates(spark):
    cur = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id bigint, s string, t string")
    ch = spark.createDataFrame([(1, None, "z"), (9, "q", "q")], "id bigint, s string, t string")
    assert {tuple(r) for r in apply_updates(cur, ch, ["id"]).collect()} == {(1, "a", "z"), (2, "b", "y")}
    assert {tuple(r) for r in apply_updates(cur, ch, ["id"], overwrite=True).collect()} == {(1, None, "z"), (2, "b", "y")}


def test_sale_item_messages(spark):
    df = spark.createDataFrame(
        [(1, [(0, D(1)), (5, D(0)), (5, D(1))], "cash", None, None)],
        "id int, items array<struct<product_id:bigint,quantity:decimal(12,3)>>, payment_method string, "
        "payments array<struct<payment_method:string,amount:decimal(12,2)>>, client_id bigint",
    )
    r = Q.apply_rules(df, Q.sale_rules()).select(Q.item_errors().alias("i"), Q.first_error().alias("e")).first()
    assert r.i == ["El item 1 debe tener product_id", "El item 2 debe tener cantidad mayor a 0"]
    assert r.e == "El item 1 debe tener product_id"


def test_search_and_uniqueness_take_the_same_letters_for_one(spark):
    from molinete.functions.predicates import fold
    from molinete.plans.dims import same_text

    pairs = [("Łódź", "lodz"), ("SØREN", "Soren"), ("Đorđe", "dordje"), ("đorđe", "DORDE"), ("Straße", "strasse"), ("Œuvre", "oeuvre"), ("Æsir", "aesir"), ("Ñandú", "nandu"), ("ħal", "hal"), ("a", "b"), ("ana ", "aná")]
    got = spark.createDataFrame(pairs, "a string, b string").select((fold(F.rtrim("a")) == fold(F.rtrim("b"))).alias("f"), (same_text("a") == same_text("b")).alias("s")).collect()
    assert [r.f for r in got] == [r.s for r in got] and sum(r.f for r in got) == 9


def test_scratch_takes_its_tables_with_it(spark):
    import os

    from molinete.session import durable, scratch

    with scratch(spark) as folder:
        assert durable(spark.range(5)).count() == 5 and os.listdir(folder)
        with scratch(spark) as inner:
            durable(spark.range(1))
        assert not os.path.exists(inner) and os.path.exists(folder)
    assert not os.path.exists(folder)

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import pytest

from molinete.operators import unique
from molinete.operators.unique import settle_claims

START = dt.datetime(2024, 1, 1)
CLAIMS = "id bigint, requested_at timestamp_ntz, place int, key string"
HELD = CLAIMS + ", moves boolean"


def at(second):
    return START + dt.timedelta(seconds=second)


def frames(spark, rows, changes):
    """``rows``: id -> {place: key}; ``changes``: id -> (second, {place: key})."""
    claims = [(i, at(t), p, k) for i, (t, new) in changes.items() for p, k in new.items()]
    held = []
    for i, own in rows.items():
        for p, k in own.items():
            t, new = changes.get(i, (None, None))
            held.append((i, None if t is None else at(t), p, k, t is not None and new.get(p) != k))
    return spark.createDataFrame(claims, CLAIMS), spark.createDataFrame(held, HELD)


def one_by_one(rows, changes):
    owners = defaultdict(set)
    for i, own in rows.items():
        for p, k in own.items():
            owners[p, k].add(i)
    failed = set()
    for i, (_, new) in sorted(changes.items(), key=lambda x: (x[1][0], x[0])):
        bad = {(i, p) for p, k in new.items() if owners[p, k] - {i}}
        failed |= bad
        if not bad:
            for p, k in rows.get(i, {}).items():
                owners[p, k].discard(i)
            for p, k in new.items():
                owners[p, k].add(i)
    return failed


def counted(monkeypatch):
    rounds, steps = [], []
    monkeypatch.setattr(unique, "_judged", lambda *a, keep=unique._judged: rounds.append(1) or keep(*a))
    keep = unique.durable
    monkeypatch.setattr(unique, "durable", lambda df: steps.append(1) or keep(df))
    return rounds, steps


def settled(spark, rows, changes):
    return {tuple(r) for r in settle_claims(*frames(spark, rows, changes)).collect()}


@pytest.mark.parametrize("seed", range(6))
def test_settled_as_if_one_after_the_other(spark, seed):
    rng = random.Random(seed)
    keys = [f"k{i}" for i in range(rng.choice([6, 25, 60]))]
    free = {p: rng.sample(keys, len(keys)) for p in range(2)}
    rows = {i: {p: free[p].pop() for p in range(2) if free[p] and rng.random() < 0.9} for i in range(20)}
    changes = {i: (rng.randint(0, 12), {p: rng.choice(keys) for p in range(2) if rng.random() < 0.8}) for i in rng.sample(range(40), 30)}
    changes = {i: c for i, c in changes.items() if c[1]}
    assert settled(spark, rows, changes) == one_by_one(rows, changes)


@pytest.mark.parametrize("last_fails", [False, True])
def test_a_thousand_links_take_few_rounds(spark, monkeypatch, last_fails):
    """Row ``i`` wants what row ``i + 1`` gives up a second earlier, for two unique columns."""
    n = 1000
    rows = {i: {0: f"a{i}", 1: f"b{i}"} for i in range(n)} | {5000: {0: "held"}}
    changes = {i: (n - i, {0: f"a{i + 1}", 1: f"b{i + 1}"}) for i in range(n)}
    if last_fails:
        changes[n - 1] = (1, {0: "held"})
    rounds, steps = counted(monkeypatch)
    got = settled(spark, rows, changes)
    assert got == one_by_one(rows, changes) and len(got) == (1 + 2 * (n - 1) if last_fails else 0)
    assert len(rounds) <= 4 and len(rounds) + len(steps) <= 20


def test_links_that_need_the_other_refused_are_followed_too(spark, monkeypatch):
    """Change ``i`` wants two new values, the first wanted by ``i - 1`` too: every other one is refused."""
    n = 60
    changes = {i: (i, {0: f"v{i}"} | ({1: f"v{i // 2}"} if i % 2 == 0 else {1: f"v{(i - 1) // 2}"})) for i in range(n)}
    changes |= {100 + i: (100 + i, {0: f"w{i}", 1: f"w{i - 1}"} if i % 2 else {0: f"w{i - 1}", 1: f"w{i}"}) for i in range(n)}
    rounds, _ = counted(monkeypatch)
    assert settled(spark, {}, changes) == one_by_one({}, changes)
    assert len(rounds) <= 4


def test_a_value_that_everybody_wants(spark, monkeypatch):
    rows = {i: {0: f"own{i}"} for i in range(200)} | {999: {0: "gold"}}
    changes = {i: (10 + i, {0: "gold"}) for i in range(200)} | {999: (1, {0: "silver"}), 1000: (5, {0: "own7"})}
    rounds, _ = counted(monkeypatch)
    got = settled(spark, rows, changes)
    assert got == one_by_one(rows, changes) and len(got) == 200 and len(rounds) <= 5


def test_a_change_that_claims_nothing_frees_what_it_held(spark):
    claims = spark.createDataFrame([(1, at(5), 0, "x")], CLAIMS)
    held = spark.createDataFrame([(2, at(1), 0, "x", True)], HELD)
    assert settle_claims(claims, held).collect() == []
    assert settle_claims(claims.limit(0), held).collect() == []

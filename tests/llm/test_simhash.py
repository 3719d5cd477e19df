from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from molinete.operators.components import components
from molinete.llm.simhash import drop_near_copies, fingerprints, near_groups, near_links
from tests.llm.frames import AWKWARD, awkward_copies, frame


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(prints):
    """Smallest index reachable over pairs within two bits."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    values = np.array(prints, np.uint64)
    for i in range(len(prints)):
        for j in i + 1 + np.flatnonzero(np.bitwise_count(values[i] ^ values[i + 1 :]) <= 2):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_equal_brute_force():
    texts = [r[1] or "" for r in AWKWARD]
    assert fingerprints([t.encode() for t in texts]).tolist() == [brute_print(t) for t in texts]
    assert fingerprints([]).tolist() == []


def test_links_reach_all_pairs_within_two_bits(spark):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(40)]
    values = list({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(12)} | {0, 1, (1 << 64) - 1, 1 << 63})
    want = brute_roots(values)
    df = spark.createDataFrame([(signed(v),) for v in values], "bits bigint")
    for bucket in (64, 3):
        roots = {r.node: r.root for r in components(near_links(df, bucket=bucket)).collect()}
        got = [roots.get(signed(v), signed(v)) for v in values]
        assert len(set(got)) == len(set(want))
        assert len(set(zip(got, want, strict=True))) == len(set(want))


def test_a_crowded_bucket_makes_no_pairs(spark):
    # 2,081 fingerprints around one, all in the same buckets
    values = {0} | {1 << a for a in range(64)} | {1 << a | 1 << b for a in range(64) for b in range(a)}
    links = near_links(spark.createDataFrame([(signed(v),) for v in values], "bits bigint"))
    # at most 65 ties each, and in six small buckets each half of 64 pairs; all pairs within two bits would be millions
    assert links.count() <= (65 + 6 * 32) * len(values) < len(values) ** 2 / 8
    assert len({r.root for r in components(links).collect()}) == 1


def test_long_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(300)]
    hub = [(1000, 1000 + i) for i in range(1, 400)]
    got = {r.node: r.root for r in components(spark.createDataFrame([*chain, *hub, (5, 5), (7, 6)], "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(301), 0), **dict.fromkeys(range(1000, 1400), 1000)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_groups_equal_brute_force(spark):
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 400)}" for _ in range(900)]
    near = []
    for i in range(25):
        words = list(base)
        words[rng.randrange(900)] = f"other{i}"
        near.append((200 + i, " ".join(words), "en", "n", 0))
    rows = [r for r in AWKWARD if r[0] is not None] + awkward_copies(40) + near
    prints = [brute_print(r[1]) for r in rows]
    roots = brute_roots(prints)
    low = {}
    for r, root in zip(rows, roots, strict=True):
        low[root] = min(low.get(root, r[0]), r[0])
    want = sorted((r[0], format(p, "016x"), low[root]) for r, p, root in zip(rows, prints, roots, strict=True))
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in near_groups(frame(spark, rows, clash=True)).collect())
    assert got == want
    kept = drop_near_copies(frame(spark, rows, clash=True))
    assert sorted({r.doc_id for r in kept.collect()}) == sorted(set(low.values()))


def test_null_ids_and_empty_tables(spark):
    got = near_groups(frame(spark, [(None, "x y z", None, None, None), (None, "q", None, None, None), (3, "q", None, None, None)])).collect()
    assert sorted(repr((r.doc_id, r.component_id)) for r in got) == ["(3, 3)", "(None, 3)", "(None, None)"]
    assert near_groups(frame(spark, [])).collect() == []


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    # id 5 stands on a near copy of 3 and on a text of its own; 3 twice; copies without ids
    rows = [(3, "x y z", None, None, 1), (3, "x y z", None, None, 2), (5, "x y z", None, None, 3), (5, "its own words", None, None, 4)]
    rows += [(None, "no id", None, None, 5), (None, "no id", None, None, 6), (None, "x y z", None, None, 7)]
    df = frame(spark, rows, clash=True)
    kept = drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect()))) == ["(3, 'x y z')", "(5, 'its own words')", "(None, 'no id')"]

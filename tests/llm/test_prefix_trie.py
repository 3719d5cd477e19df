from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from molinete.llm import queries
from molinete.llm.prefix_trie import BLOCK, grafted_turns, number_turns, prefix_trie
from molinete.llm.terms import list_digests
from molinete.operators import running as running_module

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def whole(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            out[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in out.items()}


def rest(c, n):
    return c - (abs(c) // n * n if c >= 0 else -(abs(c) // n * n))


def grafted(found, group, heads):
    out = {}
    for c, turns in found.items():
        h = zlib.crc32(str(c).encode()) % heads
        out[c] = found.get(c - rest(c, group), [])[:h] + turns[h:]
    return out


def brute_nodes(found):
    members = defaultdict(list)
    for c, turns in sorted(found.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = set()
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[:-1] == p for q in members if len(q) == len(p) + 1)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in convs if len(found[c]) == len(path))
        out.add((convs[0], len(path), members[path[:-1]][0] if path else None, len(convs), len(children), len(leaves), saved, ends))
    return out


def nodes_of(trie):
    ends = defaultdict(list)
    for r in trie.ends.collect():
        ends[r.node].append(r.conv_id)
    rows = trie.nodes.collect()
    assert len({r.node for r in rows}) == len(rows)
    return {(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_bytes, ",".join(map(str, sorted(ends[r.node])))) for r in rows}


def check(spark, rows, block=BLOCK):
    trie = prefix_trie(number_turns(spark.createDataFrame(rows, SCHEMA)), block=block)
    assert nodes_of(trie) == brute_nodes(whole(rows))


@pytest.mark.parametrize(("block", "seed"), [(1, 1), (4, 2), (4, 3), (3, 4)])
def test_nodes_equal_brute_force(spark, block, seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 400), 30):
        for turn in range(rng.choice([1, 2, 4, 5, 8, 11])):
            rows.append((c, turn, "user" if turn % 2 else "assistant", rng.choice(["a", "b", "é"]) if turn > rng.randint(0, 9) else "same"))
    check(spark, rows, block)


def test_awkward_conversations(spark):
    rows = [(1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (2, None, "", ""), (2, 0, "user", ""), (2, 0, "user", ""), (3, 5, "u", "x" * 100_000), (None, 1, "u", "lost")]
    rows += [(c, t, "u", f"step {t}") for c in (7, 8, 9) for t in range(4)] + [(10, t, "u", f"step {t}") for t in range(3)]
    rows += [(11, 0, "us", "er"), (12, 0, "user", ""), (13, 0, "u", "ser")]  # other role, other node
    check(spark, rows)
    clash = spark.createDataFrame(rows, SCHEMA)
    for name in ("no", "node", "digest", "block", "parent", "depth"):
        clash = clash.selectExpr("*", f"1 AS {name}")
    assert nodes_of(prefix_trie(number_turns(clash))) == brute_nodes(whole(rows))
    empty = prefix_trie(number_turns(spark.createDataFrame([], SCHEMA)))
    assert empty.nodes.count() == 0 and empty.ends.count() == 0


def test_a_hot_conversation_is_numbered_and_summed_in_slices(spark, monkeypatch):
    monkeypatch.setattr(running_module, "HOT_ROWS", 20)
    monkeypatch.setattr(running_module.running, "__kwdefaults__", {**running_module.running.__kwdefaults__, "hot_rows": 20})
    rows = [(1, t, "u", f"turn {t % 7}") for t in range(60)] + [(c, t, "u", f"turn {t % 7}") for c in (2, 3) for t in range(c + 5)]
    check(spark, rows)


def test_branches_nested_deep_take_few_rounds(spark, monkeypatch):
    """Conversation ``c`` leaves that of ``c - 1`` at its last turn, so branches hang on one another 40 deep."""
    from molinete.llm import prefix_trie as module

    written = []
    monkeypatch.setattr(module, "durable", lambda df, keep=module.durable: written.append(1) or keep(df))
    rows = [(c, t, "u", "way" if t < c else "end") for c in range(40) for t in range(c + 1)]
    trie = prefix_trie(number_turns(spark.createDataFrame(rows, SCHEMA)))
    assert nodes_of(trie) == brute_nodes(whole(rows))
    assert len(written) <= 4 + 7


def test_grafts_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [(c, t, "u", f"{c} {t}") for c in [*rng.sample(range(60), 25), -3, -5, 100] for t in range(rng.choice([1, 2, 6, 12]))]
    turns, conversations = grafted_turns(number_turns(spark.createDataFrame(rows, SCHEMA)), group=5, heads=9)
    trie = prefix_trie(turns, conversations)
    assert nodes_of(trie) == brute_nodes(grafted(whole(rows), 5, 9))


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = [(c, None if t == 0 and c % 3 == 0 else t, rng.choice(["u", None]), rng.choice(["x", "yé", None])) for c in range(40) for t in range(rng.randint(1, 10))]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.QUERIES["op11_prefix_trie"](spark, str(tmp_path)).collect()
    want = {(*n[:7], hashlib.sha256(n[7].encode()).hexdigest()) for n in brute_nodes(grafted(whole(rows), 5, 9))}
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert {tuple(r[n] for n in names) for r in got} == want and len(got) == len(want)


def test_lists_are_digested_in_slices(spark):
    numbers = [-5000, -1, 0, 1, 4095, 4096, 9999, *range(20_000, 32_000, 3)]
    rows = [("hot", n, str(n)) for n in numbers] + [("one", 7, "seven"), ("two", 8, ""), ("two", 9, "é")]
    got = {r.key: (r.n, r.sha256) for r in list_digests(spark.createDataFrame(rows, "key string, no bigint, name string"), "key").collect()}
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert got == {"hot": (len(numbers), sha(",".join(map(str, numbers)))), "one": (1, sha("seven")), "two": (2, sha(",é"))}
    assert list_digests(spark.createDataFrame([], "key string, no bigint, name string"), "key").collect() == []

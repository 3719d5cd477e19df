from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from molinete.llm.packing import WordIds, pack, pack_documents, packing_plan
from tests.llm.frames import AWKWARD, awkward_copies, frame

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=200))
def test_plan_uses_every_piece_once(lengths):
    counts = np.bincount(np.array(lengths, int), minlength=41)
    used, sequences = Counter(), 0
    for parts, times in packing_plan(counts):
        assert sum(parts) <= 40 and times > 0
        sequences += times
        for x in parts:
            used[x] += times
    assert used == Counter(lengths)
    # no worse than first fit, which never needs twice the least number
    assert sequences <= max(-(-2 * sum(lengths) // 40), 1) or not lengths


def test_exact_fillings_are_found():
    counts = np.zeros(101, int)
    counts[[100, 60, 40, 50, 30, 20, 25]] = [2, 3, 3, 2, 3, 3, 2]
    plan = packing_plan(counts)
    assert sum(t for _, t in plan) == -(-int((counts * np.arange(101)).sum()) // 100)


def test_many_lengths_pack_close_to_the_bound():
    rng = np.random.default_rng(1)
    counts = np.bincount(np.minimum(rng.lognormal(5, 1.2, 40_000).astype(int) + 1, 2048), minlength=2049)
    sequences = sum(t for _, t in packing_plan(counts))
    assert sequences <= 1.001 * -(-int((counts * np.arange(2049)).sum()) // 2048) + 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", ".", ",", "'s", "don't", "I'LL", "<|endoftext|>", "<|STARTOFTEXT|>", "é", "Σ", "İ", "K", " ", "\n", "\x1c", "\x85", "\xa0", "12", "...", "!!", "日本", "🙂", "Ab", "ß", "ǆ"]), max_size=8))
def test_ids_equal_the_librarys(parts):
    text = "".join(parts)
    library = Tokenizer.from_file(PATH)
    assert np.frombuffer(WordIds(PATH).of([text.encode()])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_packed_documents(spark):
    rows = AWKWARD + awkward_copies(80)
    out = pack_documents(frame(spark, rows, clash=True), tokenizer=PATH, capacity=64).collect()
    library = Tokenizer.from_file(PATH)
    want = Counter()
    for r in rows:
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), 64)):
            part = np.array(ids[at : at + 64], "<u4")
            want[(r[0], n, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    places = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(places) <= 1.05 * -(-sum(r.length for r in out) // 64) + 1


def test_empty_table_and_bad_lengths(spark):
    import pytest

    assert pack_documents(frame(spark, []), tokenizer=PATH).collect() == []
    with pytest.raises(ValueError, match="between 1 and 10"):
        pack(spark.createDataFrame([(1, 0, 11)], "doc_id bigint, piece int, length bigint"), capacity=10)

"""The registered queries of the package, and the pipeline against a brute-force walk through its stages."""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from molinete.llm.queries import ORACLES, QUERIES
from molinete.llm.toxicity import fit_toxicity
from tests.compare import connect, differences
from tests.llm.frames import AWKWARD, SCHEMA, awkward_copies, frame
from tests.llm.test_mixing import brute_targets, sizes_of
from tests.llm.test_simhash import brute_print, brute_roots

FOLDER = "/root/testdata/sf0.001"
given_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="supplied tables not present")


@given_tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name]) == []


@given_tables
def test_one_query_for_each_operator(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    n = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for name in ("op2_toxicity", "op3_quality", "op4_token_counts", "op6_context_mixing", "op7_simhash"):
        assert QUERIES[name](spark, FOLDER).count() == n


def brute_mix(rows):
    """Each row as often as the mix takes it."""
    targets, by_source = brute_targets(sizes_of(rows)), defaultdict(list)
    for r in rows:
        by_source[r[3]].append((hashlib.md5(f"mix:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r))
    out = []
    for source, members in by_source.items():
        size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
        total = sum(size(r) for _, r in members)
        budget = int(float(targets[source]) + 0.5)
        passes, before = (budget // total if total else 0), 0
        rest = budget - passes * total
        for _, r in sorted(members, key=lambda x: (x[0], x[1][0], size(x[1]))):
            more = rest > 0 and 2 * (rest - before) >= size(r)
            out += [r] * (passes + more if size(r) else 1)
            before += size(r)
    return out


def brute_pipeline(rows, model):
    rows = [r for r in rows if model.score(r[1] or "") < 0.5]
    first = {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), r)
    rows = list(first.values())
    roots, low = brute_roots([brute_print(r[1]) for r in rows]), {}
    for r, root in zip(rows, roots, strict=True):
        low[root] = min(low.get(root, r[0]), r[0])
    rows = [r for r, root in zip(rows, roots, strict=True) if r[0] == low[root]]
    library, pieces = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for r in brute_mix(rows):
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4")
            pieces[(r[0], n, at, len(part), zlib.crc32(part.tobytes()))] += 1
    return pieces


def check_rows(got, want):
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


@given_tables
def test_pipeline_equals_brute_force(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    check_rows(corpus_pipeline.run(spark, FOLDER).collect(), brute_pipeline(rows, fit_toxicity(docs, labels)))


def test_pipeline_of_awkward_rows(spark, tmp_path):
    rows = [r for r in AWKWARD if r[0] is not None] + awkward_copies(40)
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(1, 1, 1), (3, 1, 0), (9, 0, 0)], "doc_id bigint, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check_rows(got, brute_pipeline(rows, fit_toxicity(docs, labels)))
    stage = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, str(tmp_path))
        assert stage.columns == docs.columns, name


def test_pipeline_of_rows_without_ids_and_clashing_columns(spark, tmp_path):
    """The row without an id is a copy of another and goes; columns of any name come through all stages but the last."""
    rows = [*AWKWARD, *awkward_copies(40)]
    docs = frame(spark, rows, clash=True)
    labels = spark.createDataFrame([(1, 1, 1), (3, 1, 0), (None, 0, 0)], "doc_id bigint, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    check_rows(corpus_pipeline.run(spark, str(tmp_path)).collect(), brute_pipeline(rows, fit_toxicity(docs, labels)))
    stage = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, str(tmp_path))
        assert stage.columns == docs.columns, name


def test_pipeline_of_an_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []

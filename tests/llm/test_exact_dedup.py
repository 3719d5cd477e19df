from __future__ import annotations

import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from molinete.llm.exact_dedup import drop_exact_copies, exact_groups
from tests.llm.frames import AWKWARD, awkward_copies, frame


def brute(rows):
    groups = defaultdict(list)
    body = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    for r, b in zip(rows, body, strict=True):
        groups[b].append(r[0])
    low = {b: min((i for i in ids if i is not None), default=None) for b, ids in groups.items()}
    return sorted((repr(r[0]), repr(low[b]), len(groups[b]), hashlib.sha256(b.encode()).hexdigest()) for r, b in zip(rows, body, strict=True))


def found(df):
    return sorted((repr(r.doc_id), repr(r.keep_id), r.group_size, r.text_sha256) for r in df.collect())


def test_groups_equal_brute_force(spark):
    rows = AWKWARD + awkward_copies(50)
    out = exact_groups(frame(spark, rows, clash=True))
    assert found(out) == brute(rows)
    kept = [r.text_sha256 for r in out.collect() if r.kept]
    assert len(kept) == len(set(kept)) == len({b for *_, b in brute(rows)})


def test_colliding_hashes_stay_apart(spark):
    weak = lambda t: F.substring(F.unhex(F.md5(t)), 1, 0)  # noqa: E731  every text has the same hash
    assert found(exact_groups(frame(spark), digest=weak)) == brute(AWKWARD)
    assert drop_exact_copies(frame(spark), digest=weak).count() == drop_exact_copies(frame(spark)).count()


def test_kept_rows_are_whole(spark):
    df = frame(spark, AWKWARD + awkward_copies(50), clash=True)
    out = drop_exact_copies(df)
    assert out.columns == df.columns
    ids = [r.doc_id for r in out.collect()]
    # 2 is 1 with other white space; null and empty are one class; 6 is one space; 10 stands for its repetition and the null id.
    assert sorted(ids) == [1, 3, 4, 6, 7, 8, 9, 10, 11, 12, 1000]


def test_empty_table(spark):
    assert exact_groups(frame(spark, [])).collect() == []
    assert drop_exact_copies(frame(spark, [])).collect() == []

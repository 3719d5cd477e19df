"""Run registered queries against their SQL twins: ``python tests/run_oracles.py [sf] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]

from tests.compare import connect, differences  # noqa: E402


def main() -> int:
    import __spark_entry__ as entry
    from molinete.session import local_session, scratch

    QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
    folder = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    names = sys.argv[2:] or list(QUERIES)
    spark, con, bad = local_session(8), connect(folder), 0
    for name in names:
        t0 = time.time()
        try:
            with scratch(spark):
                df = QUERIES[name](spark, folder)
                if name in ORACLES:
                    t1 = time.time()
                    found = differences(df, con, ORACLES[name])
                    note = f"{df.count() if not found else 0} rows"
                else:
                    t1, found, note = time.time(), [], f"{len(df.collect())} rows, no SQL twin"
        except Exception as e:  # noqa: BLE001
            t1, found, note = time.time(), [str(e)[:1500]], "failed"
        bad += bool(found)
        print(f"{'BAD' if found else 'ok '} {name} {note} build {t1 - t0:.1f}s all {time.time() - t0:.1f}s", *found, flush=True)
    print(f"{len(names) - bad} of {len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())

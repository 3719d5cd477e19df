"""Words as search and decontamination read them, and SHA-256 of long id lists."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A-Z become a-z; digits, a-z and every byte of a character beyond ASCII stay; all else parts words.
_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

#: Ids of a list that are joined before they are hashed: ``2 ** SLICE_BITS``.
SLICE_BITS = 12


def terms_of(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text in order, repeats included."""
    return text.translate(_BYTES).split()


def list_digests(rows: DataFrame, key: str) -> DataFrame:
    """``(key, n, sha256)``: for each text ``key`` the SHA-256 of its ``name`` values joined by commas, in ascending ``no``.

    ``no`` is a whole number that differs within a key. A list is first joined in slices of 4,096 consecutive numbers, so no group has
    more rows than that; the digest then reads a key's slices one after the other, so a list with a third of all ids costs a task
    its bytes but never its memory.
    """
    entry = F.sort_array(F.collect_list(F.struct("no", "name")))
    slices = (
        rows.groupBy(key, F.shiftright("no", SLICE_BITS).alias("slice"))
        .agg(entry.alias("list"))
        .select(F.col(key).alias("key"), "slice", F.size("list").alias("n"), F.array_join(F.col("list.name"), ",").cast("binary").alias("part"))
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, state = None, 0, None
        for batch in batches:
            keys, sizes, found = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
            for i, name in enumerate(keys):
                if name != now or state is None:
                    if state is not None:
                        found.append((now, n, state.hexdigest()))
                    now, n, state = name, 0, hashlib.sha256()
                else:
                    state.update(b",")
                n += sizes[i]
                state.update(batch.column(3)[i].as_py())
            yield _batch(found)
        if state is not None:
            yield _batch([(now, n, state.hexdigest())])

    ordered = slices.repartition("key").sortWithinPartitions("key", "slice")
    return ordered.mapInArrow(digest, "key string, n bigint, sha256 string").withColumnRenamed("key", key)


def _batch(found: list[tuple[str, int, str]]) -> pa.RecordBatch:
    keys, sizes, digests = zip(*found, strict=True) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], ["key", "n", "sha256"])

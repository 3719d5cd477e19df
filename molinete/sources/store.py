"""Tables that change together: immutable versions, and a manifest that names the files of one state of all of them.

A commit writes new files next to the old ones and then puts one small manifest in place by a rename. Readers open
only what a manifest names, so they see all tables of a commit or none, and a job that stops half-way leaves them where they were.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from molinete.operators.rows import apply_updates, settle_changes
from molinete.session import durable, remove

#: Keys of a range of a keyed table: at most as many rows, since keys are unique.
WIDTH = 1_000_000
_MANIFESTS = "_manifests"


class Conflict(RuntimeError):
    """Another commit came first; nothing of this one can be seen."""


@dataclass(frozen=True)
class Table:
    """A table's files in one state. Plain: ``folders``, one a commit. Keyed: ``ranges``, the folder of each range of ``width`` keys."""

    schema: str
    folders: tuple[str, ...] = ()
    key: str | None = None
    width: int = WIDTH
    ranges: Mapping[int, str] = field(default_factory=dict)

    def paths(self) -> list[str]:
        return sorted(self.ranges.values()) if self.key else list(self.folders)

    def to_json(self) -> dict:
        return {"schema": self.schema, "folders": list(self.folders), "key": self.key, "width": self.width, "ranges": {str(k): v for k, v in self.ranges.items()}}

    @staticmethod
    def from_json(d: dict) -> Table:
        return Table(d["schema"], tuple(d["folders"]), d["key"], d["width"], {int(k): v for k, v in d["ranges"].items()})


@dataclass(frozen=True)
class Snapshot:
    """One state of all tables. It stays readable while later ones are written."""

    store: Store
    number: int
    tables: Mapping[str, Table]
    #: What writers noted with their commits, the latest of each name: how far a stream has come, say.
    notes: Mapping[str, int] = field(default_factory=dict)

    def read(self, name: str, keys: Sequence[int] | None = None) -> DataFrame:
        """A table as this state has it; of a keyed table only the ranges that may hold ``keys``, if given."""
        table = self.tables[name]
        if keys is None:
            return self.store._open(table, table.paths())
        wanted = {k // table.width for k in keys}
        return self.store._open(table, [p for no, p in sorted(table.ranges.items()) if no in wanted]).filter(F.col(table.key).isin(list(keys)))

    def read_for(self, name: str, rows: DataFrame) -> DataFrame:
        """Of a keyed table the ranges that hold keys of ``rows`` (which has the key column): the rest is not opened."""
        table = self.tables[name]
        wanted = _ranges_of(rows, table)
        return self.store._open(table, [p for no, p in sorted(table.ranges.items()) if no in wanted])


# --- what a commit may do to a table ------------------------------------------


@dataclass(frozen=True)
class Replace:
    """All rows anew. With ``key`` (whole numbers, unique) the rows are placed by key range, so that later changes rewrite few files."""

    rows: DataFrame
    key: str | None = None
    width: int = WIDTH

    def stage(self, store: Store, now: Table | None, folder: str) -> Table:
        if self.key is None:
            return Table(self.rows.schema.json(), tuple(store._write(self.rows, folder)))
        return Table(self.rows.schema.json(), (), self.key, self.width, store._write_ranges(self.rows, self.key, self.width, folder))


@dataclass(frozen=True)
class Append:
    """More rows of a plain table; it begins with them if it is not there."""

    rows: DataFrame

    def stage(self, store: Store, now: Table | None, folder: str) -> Table:
        if now is None:
            return Replace(self.rows).stage(store, now, folder)
        _plain(now)
        target = T.StructType.fromJson(json.loads(now.schema))
        return Table(now.schema, (*now.folders, *store._write(self.rows.select(*[F.col(f.name).cast(f.dataType) for f in target]), folder)))


@dataclass(frozen=True)
class Update:
    """Changed columns of rows that are there, as :func:`apply_updates`; several changes of a key are settled by ``order``, last one first."""

    changes: DataFrame
    order: Sequence[str] = ("requested_at", "request_id")
    overwrite: bool = False

    def stage(self, store: Store, now: Table | None, folder: str) -> Table:
        key = _keyed(now).key
        changes = durable(settle_changes(self.changes, [key], [c for c in self.order if c in self.changes.columns], overwrite=self.overwrite))
        return store._rewrite(now, folder, changes, lambda rows: apply_updates(rows, changes, [key], overwrite=self.overwrite, settled=True), False)


@dataclass(frozen=True)
class Put:
    """Whole rows by key: new ones are added, those there are replaced."""

    rows: DataFrame

    def stage(self, store: Store, now: Table | None, folder: str) -> Table:
        key = _keyed(now).key
        target = T.StructType.fromJson(json.loads(now.schema))
        rows = durable(self.rows.select(*[F.col(f.name).cast(f.dataType) for f in target]))
        return store._rewrite(now, folder, rows, lambda old: old.join(rows.select(key), key, "left_anti").select(*target.names).unionByName(rows), True)


@dataclass(frozen=True)
class Delete:
    """Rows whose key is in ``keys`` go."""

    keys: DataFrame

    def stage(self, store: Store, now: Table | None, folder: str) -> Table:
        key = _keyed(now).key
        gone = durable(self.keys.select(F.col(self.keys.columns[0]).alias(key)).distinct())
        return store._rewrite(now, folder, gone, lambda rows: rows.join(gone, key, "left_anti"), False)


Change = Replace | Append | Update | Put | Delete


def _plain(now: Table) -> Table:
    if now.key is not None:
        raise ValueError("a keyed table takes Put, Update and Delete")
    return now


def _keyed(now: Table | None) -> Table:
    if now is None or now.key is None:
        raise ValueError("only a keyed table that is there can be changed by key")
    return now


class Store:
    """Tables below one folder that all executors reach. On file systems whose rename puts a file in place at once or fails (HDFS, local), commits are atomic."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def snapshot(self, number: int | None = None) -> Snapshot:
        """The latest state, or the one of that ``number``; state 0 has no tables."""
        if number is None:
            number = max(self.numbers(), default=0)
        if number == 0:
            return Snapshot(self, 0, {})
        body = json.loads(self._text(f"{self.root}/{_MANIFESTS}/{number}"))
        return Snapshot(self, number, {name: Table.from_json(t) for name, t in body["tables"].items()}, body["notes"])

    def read(self, name: str) -> DataFrame:
        return self.snapshot().read(name)

    def numbers(self) -> list[int]:
        """The states that are there, ascending."""
        return sorted(int(n) for n in self._names(f"{self.root}/{_MANIFESTS}") if n.isdigit())

    def commit(self, changes: Mapping[str, Change], *, base: Snapshot | None = None, notes: Mapping[str, int] | None = None) -> Snapshot:
        """All of ``changes`` on top of ``base`` (else the latest state), or nothing; ``notes`` are kept with the state.

        Tables that are not named stay as they are. If another commit was made on the same ``base``, :class:`Conflict` is raised. What a
        failed commit has written is removed, and nothing ever names it.
        """
        base = base or self.snapshot()
        stamp = uuid.uuid4().hex
        folders = {name: f"{name}/v-{stamp}" for name in changes}
        try:
            staged = {name: change.stage(self, base.tables.get(name), folders[name]) for name, change in changes.items()}
            return self._publish(base.number + 1, {**base.tables, **staged}, {**base.notes, **(notes or {})})
        except BaseException:
            for folder in folders.values():
                remove(self.spark, f"{self.root}/{folder}")
            raise

    def rollback(self, number: int) -> Snapshot:
        """A new state that names the files of state ``number`` again."""
        old = self.snapshot(number)
        return self._publish(max(self.numbers(), default=0) + 1, old.tables, old.notes)

    def forget(self, keep: int = 10) -> list[str]:
        """Drop all but the last ``keep`` states (one at least) and the files that only they name; returns these folders."""
        numbers = self.numbers()
        old, kept = numbers[: -max(1, keep)], numbers[-max(1, keep) :]
        paths = lambda some: {p for n in some for t in self.snapshot(n).tables.values() for p in t.paths()}
        gone = sorted(paths(old) - paths(kept))
        for number in old:  # first what names them
            remove(self.spark, f"{self.root}/{_MANIFESTS}/{number}")
        for path in gone:
            remove(self.spark, f"{self.root}/{path}")
        return gone

    # --- files ---------------------------------------------------------------

    def _open(self, table: Table, paths: Sequence[str]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(table.schema))
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in paths])

    def _write(self, rows: DataFrame, folder: str) -> list[str]:
        rows.write.mode("errorifexists").parquet(f"{self.root}/{folder}")
        return [folder]

    def _write_ranges(self, rows: DataFrame, key: str, width: int, folder: str) -> dict[int, str]:
        """Every range of keys in a folder of its own, sorted by key; their folders."""
        name = "key_range"
        while name in rows.columns:
            name += "_"
        placed = rows.withColumn(name, range_of(key, width))
        placed.repartition(name).sortWithinPartitions(name, key).write.mode("errorifexists").partitionBy(name).parquet(f"{self.root}/{folder}")
        found = [n for n in self._names(f"{self.root}/{folder}") if n.startswith(f"{name}=")]
        return {int(n.split("=", 1)[1]): f"{folder}/{n}" for n in found}

    def _rewrite(self, now: Table, folder: str, changes: DataFrame, make, adds: bool) -> Table:
        """``now`` with the ranges that ``changes`` touch made anew from their rows; the others keep their files."""
        touched = _ranges_of(changes, now)
        if not adds:
            touched &= set(now.ranges)
        if not touched:
            return now
        rows = self._open(now, [now.ranges[n] for n in sorted(touched & set(now.ranges))])
        made = self._write_ranges(make(rows), now.key, now.width, folder)
        kept = {n: p for n, p in now.ranges.items() if n not in touched}
        return Table(now.schema, (), now.key, now.width, {**kept, **made})

    def _publish(self, number: int, tables: Mapping[str, Table], notes: Mapping[str, int]) -> Snapshot:
        body = json.dumps({"number": number, "tables": {name: t.to_json() for name, t in sorted(tables.items())}, "notes": dict(notes)})
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path
        target = path(f"{self.root}/{_MANIFESTS}/{number}")
        waiting = path(f"{self.root}/{_MANIFESTS}/.waiting-{uuid.uuid4().hex}")
        files = target.getFileSystem(conf)
        files.mkdirs(target.getParent())
        out = files.create(waiting, False)
        try:
            out.write(bytearray(body.encode()))
        finally:
            out.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        names = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        names[0] = rename
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf).rename(files.makeQualified(waiting), files.makeQualified(target), names)
        except Exception as e:
            files.delete(waiting, False)
            if files.exists(target):
                raise Conflict(f"state {number} is there already") from e
            raise
        return Snapshot(self, number, dict(tables), dict(notes))

    def _names(self, folder: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []

    def _text(self, file: str) -> str:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(file)
        stream = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()


def _ranges_of(rows: DataFrame, table: Table) -> set[int]:
    """The ranges that keys of ``rows`` fall into: at most one number a range comes to the driver."""
    return {r[0] for r in rows.select(range_of(table.key, table.width)).distinct().collect() if r[0] is not None}


def range_of(key: str, width: int) -> Column:
    """The number of the key's range, rounded down: the same rule for the stored rows and for what changes them."""
    return F.expr(f"cast((`{key}` - pmod(`{key}`, {width}L)) div {width}L AS bigint)")

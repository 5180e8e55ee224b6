"""Sinks for change logs: NDJSON, message queues, databases, statements for PostgreSQL.

The queue and database writers need their connectors on Spark's class path; the
frames they write are made here and tested without them.
"""

from __future__ import annotations

import os
import shutil
import sqlite3
import uuid
from collections.abc import Iterable
from contextlib import closing
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..envelope import META, OLD
from ..functions.names import message_key, topic
from ..functions.values import event_json
from ..operators import merge
from ..scratch import ship

#: PostgreSQL types of the metadata columns, in order.
META_TYPES = ["text", "bigint", "bigint", "boolean", "text", "text", "text"]


def json_lines(log: DataFrame) -> DataFrame:
    """One envelope for each event, in a column ``value``."""
    return log.select(event_json().alias("value"))


def write_json_lines(log: DataFrame, path: str) -> None:
    json_lines(log).write.mode("append").text(path)


def queue_records(log: DataFrame, prefix: str) -> DataFrame:
    """topic, key and value of each event; a table's events share a key, hence a partition."""
    schema, table = F.col("schema"), F.col("table")
    return log.select(topic(prefix, schema, table).alias("topic"), message_key(schema, table).alias("key"), event_json().alias("value"))


def write_queue(log: DataFrame, prefix: str, servers: str, **options: str) -> None:
    """Events as messages; ``queue_sink`` calls it for each batch of a stream."""
    extra = {"kafka.request.timeout.ms": "5000", "kafka.delivery.timeout.ms": "30000"} | options
    queue_records(log, prefix).write.format("kafka").option("kafka.bootstrap.servers", servers).options(**extra).save()


def queue_sink(prefix: str, servers: str, **options: str):
    return lambda batch, number: write_queue(batch, prefix, servers, **options)


def write_database(flat: DataFrame, url: str, table: str, **options: str) -> None:
    """Rows appended to a database table by Spark's JDBC writer, from all executors at once."""
    flat.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()


def _q(name: str) -> str:
    return f'"{name}"'


def _target(schema: str, table: str) -> str:
    return f"{_q(schema)}.{_q(table)}"


def _cast(i: int, column: str, kinds: dict[str, str]) -> str:
    return f"${i}::{kinds.get(column, 'text')}"


def flattened_ddl(schema: str, table: str, columns: dict[str, str]) -> str:
    parts = [f"{_q(m)} {k} NOT NULL" for m, k in zip(META, META_TYPES, strict=True)]
    parts += [f"{_q(prefix + c)} {k}" for prefix in ("", OLD) for c, k in columns.items()]
    return f"CREATE TABLE IF NOT EXISTS {_target(schema, table)} ({', '.join(parts)})"


def replication_ddl(schema: str, table: str, columns: dict[str, str], pk: list[str]) -> str:
    parts = [f"{_q(c)} {k}" for c, k in columns.items()] + [f"PRIMARY KEY ({', '.join(map(_q, pk))})"]
    return f"CREATE TABLE IF NOT EXISTS {_target(schema, table)} ({', '.join(parts)})"


def add_columns_ddl(schema: str, table: str, columns: dict[str, str]) -> str:
    return f"ALTER TABLE {_target(schema, table)} " + ", ".join(f"ADD COLUMN IF NOT EXISTS {_q(c)} {k}" for c, k in columns.items())


def drop_columns_ddl(schema: str, table: str, columns: Iterable[str]) -> str:
    return f"ALTER TABLE {_target(schema, table)} " + ", ".join(f"DROP COLUMN IF EXISTS {_q(c)}" for c in columns)


def insert_sql(target: str, columns: list[str], kinds: dict[str, str]) -> str:
    """Parameterised INSERT of a flattened event."""
    names = [*META, *columns, *(OLD + c for c in columns)]
    types = [*META_TYPES, *(kinds.get(c, "text") for c in columns), *(kinds.get(c, "text") for c in columns)]
    values = ", ".join(f"${i}::{t}" for i, t in enumerate(types, 1))
    return f"INSERT INTO {target} ({', '.join(map(_q, names))}) VALUES ({values})"


def upsert_sql(target: str, columns: list[str], pk: list[str], kinds: dict[str, str]) -> str:
    values = [_cast(i, c, kinds) for i, c in enumerate(columns, 1)]
    sets = [f"{_q(c)} = {v}" for c, v in zip(columns, values, strict=True) if c not in pk]
    action = f"DO UPDATE SET {', '.join(sets)}" if sets else "DO NOTHING"
    names = ", ".join(map(_q, columns))
    return f"INSERT INTO {target} ({names}) VALUES ({', '.join(values)}) ON CONFLICT ({', '.join(map(_q, pk))}) {action}"


def delete_sql(target: str, pk: list[str], kinds: dict[str, str]) -> str:
    return f"DELETE FROM {target} WHERE " + " AND ".join(f"{_q(c)} = {_cast(i, c, kinds)}" for i, c in enumerate(pk, 1))


class DatabaseTarget:
    """Tables of a database that speaks SQL through a DB-API connection.

    ``connect`` opens a connection; ``mark`` is the placeholder of its driver; a
    dialect with ``ON CONFLICT`` is expected (PostgreSQL, SQLite).  DDL comes first
    and commits for itself.  Then a batch is one transaction: folded changes go to
    a staging table in blocks, deletes and upserts are one statement each, and the
    number of the batch is kept, so a repeated batch changes nothing.  ``stage``
    may load the staging table in another way, such as Spark's JDBC writer, which
    writes from all executors at once, or ``sqlite_stage``; then no row goes through
    the driver.
    """

    BLOCK = 5000
    APPLIED = "_changeloom_applied"

    def __init__(self, connect, mark: str = "?", stage=None):
        self.connect, self.mark, self.stage = connect, mark, stage

    def _columns(self, cursor, table: str) -> list[str] | None:
        """Columns of a table, none if it is not there."""
        try:
            cursor.execute(f"SELECT * FROM {_q(table)} WHERE 1 = 0")
        except Exception:
            return None
        return [d[0] for d in cursor.description]

    def _run(self, *statements: str) -> None:
        with closing(self.connect()) as db:
            cursor = db.cursor()
            for one in statements:
                cursor.execute(one)
            db.commit()

    def columns(self, table: str) -> list[str] | None:
        with closing(self.connect()) as db:
            return self._columns(db.cursor(), table)

    def ensure(self, table: str, columns: dict[str, str], pk: list[str] = ()) -> list[str]:
        """The table's columns; it is created if it is not there."""
        known = self.columns(table)
        if known is not None:
            return known
        parts = [f"{_q(c)} {k}" for c, k in columns.items()] + ([f"PRIMARY KEY ({', '.join(map(_q, pk))})"] if pk else [])
        self._run(f"CREATE TABLE IF NOT EXISTS {_q(table)} ({', '.join(parts)})")
        return [*columns]

    def evolve(self, table: str, added: dict[str, str], dropped: Iterable[str] = ()) -> None:
        """New columns, then dropped ones; what is done already is passed over."""
        known = set(self.columns(table) or ())
        more = [f"ALTER TABLE {_q(table)} ADD COLUMN {_q(c)} {k}" for c, k in added.items() if c not in known]
        self._run(*more, *[f"ALTER TABLE {_q(table)} DROP COLUMN {_q(c)}" for c in dropped if c in known])

    def index(self, table: str, column: str) -> None:
        """An index, so that parts of a column are read without the rest."""
        self._run(f"CREATE INDEX IF NOT EXISTS {_q(f'{table}_{column}')} ON {_q(table)} ({_q(column)})")

    def _seen(self, cursor, name: str, number: int) -> bool:
        cursor.execute(f"CREATE TABLE IF NOT EXISTS {_q(self.APPLIED)} (name TEXT PRIMARY KEY, number BIGINT NOT NULL)")
        return number <= self._number(cursor, name)

    def _number(self, cursor, name: str) -> int:
        cursor.execute(f"SELECT number FROM {_q(self.APPLIED)} WHERE name = {self.mark}", (name,))
        found = cursor.fetchone()
        return merge.NEVER if found is None else found[0]

    def _done(self, cursor, name: str, number: int) -> None:
        cursor.execute(f"INSERT INTO {_q(self.APPLIED)} VALUES ({self.mark}, {self.mark}) ON CONFLICT (name) DO UPDATE SET number = excluded.number", (name, number))

    def _insert(self, cursor, table: str, columns: list[str], rows: DataFrame) -> None:
        """Rows in blocks; a block is all that the driver holds."""
        statement = f"INSERT INTO {_q(table)} ({', '.join(map(_q, columns))}) VALUES ({', '.join([self.mark] * len(columns))})"
        found = rows.select(*[f"`{c}`" for c in columns]).toLocalIterator(prefetchPartitions=True)
        while block := [tuple(r) for r in islice(found, self.BLOCK)]:
            cursor.executemany(statement, block)

    def append(self, table: str, rows: DataFrame, name: str, number: int) -> None:
        """Rows of a flattened log, once for each batch."""
        own, staging, names = _q(table), _q(f"_stage_{table}"), ", ".join(map(_q, rows.columns))
        if self.stage:
            self._run(f"DROP TABLE IF EXISTS {staging}", f"CREATE TABLE {staging} AS SELECT {names} FROM {own} WHERE 1 = 0")
        with closing(self.connect()) as db:
            cursor = db.cursor()
            if not self._seen(cursor, name, number):
                if self.stage:
                    self.stage(rows, f"_stage_{table}")
                    cursor.execute(f"INSERT INTO {own} ({names}) SELECT {names} FROM {staging}")
                else:
                    self._insert(cursor, table, rows.columns, rows)
                self._done(cursor, name, number)
            db.commit()
        if self.stage:
            self._run(f"DROP TABLE IF EXISTS {staging}")

    def apply(self, table: str, changes: DataFrame, pk: list[str], name: str, number: int, truncated: int | None = None) -> None:
        """A batch's folded changes: ``seq``, ``op`` and the columns, one row at most for each key.

        The ``seq`` of each key and of the last truncate (``truncated``, if the batch
        has one) stay in tables beside the target, and what is older than they are
        is passed over, so batches may come in any order.
        """
        columns = [c for c in changes.columns if c not in ("seq", "op")]
        staging, known, keys, names = _q(f"_stage_{table}"), _q(f"_changeloom_{table}"), ", ".join(map(_q, pk)), ", ".join(map(_q, columns))
        own = _q(table)
        sets = ", ".join(f"{_q(c)} = excluded.{_q(c)}" for c in columns if c not in pk)
        same = lambda a, b: " AND ".join(f"{a}.{_q(c)} = {b}.{_q(c)}" for c in pk)
        self._run(
            f"DROP TABLE IF EXISTS {staging}",
            f"CREATE TABLE {staging} AS SELECT 0 AS seq, 'x' AS op, {names} FROM {own} WHERE 1 = 0",
            f"CREATE TABLE IF NOT EXISTS {known} AS SELECT {keys}, 0 AS seq FROM {own} WHERE 1 = 0",
            f"CREATE UNIQUE INDEX IF NOT EXISTS {_q(f'_changeloom_{table}_keys')} ON {known} ({keys})",
        )
        with closing(self.connect()) as db:
            cursor = db.cursor()
            if not self._seen(cursor, name, number):
                if self.stage:
                    self.stage(changes, f"_stage_{table}")
                else:
                    self._insert(cursor, f"_stage_{table}", ["seq", "op", *columns], changes)
                barrier = self._number(cursor, f"truncate {table}")
                if truncated is not None and truncated > barrier:
                    barrier = truncated
                    cursor.execute(f"DELETE FROM {own} WHERE NOT EXISTS (SELECT 1 FROM {known} WHERE {same(known, own)} AND {known}.seq > {int(barrier)})")
                    self._done(cursor, f"truncate {table}", barrier)
                cursor.execute(f"DELETE FROM {staging} WHERE seq <= {int(barrier)} OR EXISTS (SELECT 1 FROM {known} WHERE {same(known, staging)} AND {known}.seq >= {staging}.seq)")
                cursor.execute(f"DELETE FROM {own} WHERE ({keys}) IN (SELECT {keys} FROM {staging} WHERE op = 'D')")
                action = f"DO UPDATE SET {sets}" if sets else "DO NOTHING"
                cursor.execute(f"INSERT INTO {own} ({names}) SELECT {names} FROM {staging} WHERE op <> 'D' ON CONFLICT ({keys}) {action}")
                cursor.execute(f"INSERT INTO {known} ({keys}, seq) SELECT {keys}, seq FROM {staging} WHERE 1 = 1 ON CONFLICT ({keys}) DO UPDATE SET seq = excluded.seq")
                self._done(cursor, name, number)
            db.commit()
        self._run(f"DROP TABLE IF EXISTS {staging}")


def sqlite_stage(file: str, folder: str, together: int = 8):
    """A ``stage`` for a SQLite database in ``file``: the driver gets names of files, no rows.

    Each task writes its rows to a file of its own in ``folder``, which all machines
    share; a task that is repeated makes another, and only files of tasks that ended
    well count.  The database attaches a few of them at a time (it can ten at most).
    """

    def stage(rows: DataFrame, table: str) -> None:
        ship(rows.sparkSession)
        top = os.path.join(folder, uuid.uuid4().hex)
        os.makedirs(top)
        names, marks = ", ".join(map(_q, rows.columns)), ", ".join("?" * len(rows.columns))

        def write(batches):
            name = uuid.uuid4().hex
            with closing(sqlite3.connect(os.path.join(top, name), isolation_level=None)) as db:
                for one in ("PRAGMA journal_mode = OFF", "PRAGMA synchronous = OFF", f"CREATE TABLE part ({names})", "BEGIN"):
                    db.execute(one)
                for batch in batches:
                    db.executemany(f"INSERT INTO part VALUES ({marks})", zip(*(c.to_pylist() for c in batch.columns), strict=True))
                db.execute("COMMIT")
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

        try:
            made = [os.path.join(top, r.name) for r in rows.mapInArrow(write, "name string").collect()]
            with closing(sqlite3.connect(file)) as db:
                for some in (made[i : i + together] for i in range(0, len(made), together)):
                    for i, path in enumerate(some):
                        db.execute(f"ATTACH ? AS part_{i}", (path,))
                    for i, _ in enumerate(some):
                        db.execute(f"INSERT INTO main.{_q(table)} ({names}) SELECT {names} FROM part_{i}.part")
                    db.commit()
                    for i, path in enumerate(some):
                        db.execute(f"DETACH part_{i}")
                        os.remove(path)
        finally:
            shutil.rmtree(top, ignore_errors=True)

    return stage


def database_sink(target: DatabaseTarget, table: str, kinds: dict[str, str], pk: list[str], name: str, seq: str = "seq"):
    """A stream's batches into a replicated table of a database, which does not depend on their order.

    Columns that come later are added before the batch is applied.
    """

    def write(batch: DataFrame, number: int) -> None:
        columns = [c for c in batch.columns if c not in (seq, "op")]
        known = target.ensure(table, {c: kinds.get(c, "TEXT") for c in columns}, pk)
        if added := {c: kinds.get(c, "TEXT") for c in columns if c not in known}:
            target.evolve(table, added)
        folded = merge.part(batch, pk, [c for c in columns if c not in pk], seq=seq)
        truncated = batch.where("op = 'T'").agg(F.max(seq)).first()[0]
        target.apply(table, folded.where("op <> 'T'").select("seq", "op", *columns), pk, name, number, truncated)

    return write

"""Configuration of a job: source, sink, offsets and mode, from JSON."""

from __future__ import annotations

import json
import sqlite3
from dataclasses import MISSING, dataclass, field, fields

from .errors import ConfigError
from .functions.names import connection_url


@dataclass(frozen=True)
class PostgresSource:
    host: str
    user: str
    database: str
    slot_name: str
    port: int = 5432
    password: str | None = None
    publication_name: str = "changeloom_pub"
    create_publication: bool = True
    tables: list[str] = field(default_factory=list)

    def url(self) -> str:
        return connection_url("postgresql", self.host, self.port, self.user, self.password, self.database)


@dataclass(frozen=True)
class MySqlSource:
    host: str
    user: str
    database: str
    server_id: int
    port: int = 3306
    password: str | None = None
    tables: list[str] = field(default_factory=list)

    def url(self) -> str:
        return connection_url("mysql", self.host, self.port, self.user, self.password, self.database)


@dataclass(frozen=True)
class FileSource:
    path: str
    format: str = "parquet"


@dataclass(frozen=True)
class FrameFolder:
    """A recording of a replication stream (``sources.frames``)."""

    path: str
    start: str = "0/0"
    feedback: str | None = None


@dataclass(frozen=True)
class StdoutSink:
    pass


@dataclass(frozen=True)
class QueueSink:
    brokers: str
    topic_prefix: str = "cdc"
    properties: dict = field(default_factory=dict)


@dataclass(frozen=True)
class DatabaseSink:
    host: str
    user: str
    database: str
    port: int = 5432
    password: str | None = None
    schema: str = "public"
    table_prefix: str = ""

    def connect(self):
        """A DB-API connection, by the driver that is installed, and its placeholder."""
        try:
            import psycopg
        except ImportError as e:
            raise ConfigError("a PostgreSQL sink needs the driver psycopg") from e
        return psycopg.connect(host=self.host, port=self.port, user=self.user, password=self.password, dbname=self.database, options=f"-c search_path={self.schema}")


@dataclass(frozen=True)
class FileDatabaseSink:
    """Tables in a SQLite file, for one machine."""

    path: str
    table_prefix: str = ""

    def connect(self):
        return sqlite3.connect(self.path)


@dataclass(frozen=True)
class LakeSink:
    path: str
    table_prefix: str = ""


@dataclass(frozen=True)
class SqliteOffset:
    path: str
    key: str


@dataclass(frozen=True)
class MemoryOffset:
    pass


#: The names by which a configuration chooses its parts.
SOURCES = {"postgres": PostgresSource, "mysql": MySqlSource, "files": FileSource, "frames": FrameFolder}
SINKS = {"stdout": StdoutSink, "kafka": QueueSink, "postgres": DatabaseSink, "iceberg": LakeSink, "sqlite": FileDatabaseSink}
OFFSETS = {"sqlite": SqliteOffset, "memory": MemoryOffset}
#: The modes, and the sinks that can hold a table's state.
MODES = ("cdc", "replication")
STATEFUL_SINKS = ("iceberg", "postgres", "sqlite")


def _part(kinds: dict, raw: object, what: str):
    if not isinstance(raw, dict) or raw.get("type") not in kinds:
        raise ConfigError(f"{what}: a type of {', '.join(kinds)} is needed")
    kind = kinds[raw["type"]]
    known = {f.name for f in fields(kind)}
    missing = [f.name for f in fields(kind) if f.default is MISSING and f.default_factory is MISSING and f.name not in raw]
    if missing:
        raise ConfigError(f"{what}: missing {', '.join(missing)}")
    return kind(**{k: v for k, v in raw.items() if k in known})


@dataclass(frozen=True)
class Config:
    source: object
    sink: object
    offset: object
    mode: str = "cdc"

    @classmethod
    def parse(cls, text: str) -> Config:
        try:
            raw = json.loads(text)
        except ValueError as e:
            raise ConfigError(str(e)) from e
        if not isinstance(raw, dict):
            raise ConfigError("an object is needed")
        mode = raw.get("mode", "cdc")
        if mode not in MODES:
            raise ConfigError(f"unknown mode {mode}")
        if mode == "replication" and (raw.get("sink") or {}).get("type") not in STATEFUL_SINKS:
            raise ConfigError(f"replication needs a sink of {', '.join(STATEFUL_SINKS)}")
        return cls(_part(SOURCES, raw.get("source"), "source"), _part(SINKS, raw.get("sink"), "sink"), _part(OFFSETS, raw.get("offset"), "offset"), mode)

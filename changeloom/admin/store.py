"""Jobs, workers and metrics in SQLite, and the same reports over DataFrames."""

from __future__ import annotations

import datetime
import sqlite3
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import AdminError
from ..streaming.metrics import Snapshot

#: States of a worker that a missing heartbeat turns into lost.
ALIVE = ("registered", "running")

_TABLES = """
CREATE TABLE IF NOT EXISTS jobs (id TEXT PRIMARY KEY, name TEXT UNIQUE NOT NULL, config_json TEXT NOT NULL,
  description TEXT NOT NULL, created_at TEXT NOT NULL, updated_at TEXT NOT NULL);
CREATE TABLE IF NOT EXISTS workers (id TEXT PRIMARY KEY, job_id TEXT NOT NULL, address TEXT NOT NULL, hostname TEXT NOT NULL,
  pid INTEGER NOT NULL, status TEXT NOT NULL, registered_at TEXT NOT NULL, last_heartbeat TEXT NOT NULL);
CREATE TABLE IF NOT EXISTS metrics (id INTEGER PRIMARY KEY AUTOINCREMENT, worker_id TEXT NOT NULL, timestamp TEXT NOT NULL,
  events_total INTEGER, events_per_sec REAL, batches_total INTEGER, last_batch_size INTEGER, errors_total INTEGER,
  uptime_secs INTEGER, status TEXT);
"""


def utc_now() -> datetime.datetime:
    return datetime.datetime.now(datetime.UTC)


class Store:
    def __init__(self, path: str = ":memory:", clock=utc_now):
        self.db = sqlite3.connect(path, check_same_thread=False)
        self.db.row_factory = sqlite3.Row
        self.db.executescript(_TABLES)
        self.clock = clock

    def _now(self, back: float = 0) -> str:
        return (self.clock() - datetime.timedelta(seconds=back)).isoformat(timespec="microseconds")

    def _change(self, sql: str, *values) -> int:
        with self.db:
            return self.db.execute(sql, values).rowcount

    def _all(self, sql: str, *values) -> list[dict]:
        return [dict(r) for r in self.db.execute(sql, values)]

    def _one(self, what: str, sql: str, *values) -> dict:
        found = self._all(sql, *values)
        if not found:
            raise AdminError(f"{what} not found")
        return found[0]

    def _must(self, what: str, changed: int) -> None:
        if not changed:
            raise AdminError(f"{what} not found")

    def create_job(self, name: str, config_json: str, description: str = "") -> dict:
        job, now = uuid.uuid4().hex, self._now()
        try:
            self._change("INSERT INTO jobs VALUES (?, ?, ?, ?, ?, ?)", job, name, config_json, description, now, now)
        except sqlite3.IntegrityError as e:
            raise AdminError(f"job {name} exists") from e
        return self.job(job)

    def job(self, job: str) -> dict:
        return self._one("job", "SELECT * FROM jobs WHERE id = ?", job)

    def job_by_name(self, name: str) -> dict:
        return self._one("job", "SELECT * FROM jobs WHERE name = ?", name)

    def jobs(self) -> list[dict]:
        return self._all("SELECT * FROM jobs ORDER BY created_at DESC")

    def update_job(self, job: str, **changes: str) -> dict:
        known = self.job(job) | {k: v for k, v in changes.items() if k in ("name", "config_json", "description") and v is not None}
        self._change("UPDATE jobs SET name = ?, config_json = ?, description = ?, updated_at = ? WHERE id = ?", known["name"], known["config_json"], known["description"], self._now(), job)
        return self.job(job)

    def delete_job(self, job: str) -> None:
        self._must("job", self._change("DELETE FROM jobs WHERE id = ?", job))

    def register(self, worker: str, job: str, address: str, hostname: str, pid: int) -> dict:
        now = self._now()
        self._change("INSERT OR REPLACE INTO workers VALUES (?, ?, ?, ?, ?, 'registered', ?, ?)", worker, job, address, hostname, pid, now, now)
        return self.worker(worker)

    def worker(self, worker: str) -> dict:
        return self._one("worker", "SELECT * FROM workers WHERE id = ?", worker)

    def workers(self) -> list[dict]:
        return self._all("SELECT * FROM workers ORDER BY registered_at DESC")

    def heartbeat(self, worker: str) -> None:
        self._must("worker", self._change("UPDATE workers SET status = 'running', last_heartbeat = ? WHERE id = ?", self._now(), worker))

    def deregister(self, worker: str) -> None:
        self._change("UPDATE workers SET status = 'stopped' WHERE id = ?", worker)

    def mark_lost(self, timeout: float) -> int:
        return self._change("UPDATE workers SET status = 'lost' WHERE status IN (?, ?) AND last_heartbeat < ?", *ALIVE, self._now(timeout))

    def record(self, worker: str, s: Snapshot, status: str) -> None:
        self._change(
            "INSERT INTO metrics (worker_id, timestamp, events_total, events_per_sec, batches_total, last_batch_size, errors_total, uptime_secs, status) VALUES (?, ?, ?, ?, ?, ?, ?, ?, ?)",
            worker, self._now(), s.events_total, s.events_per_sec, s.batches_total, s.last_batch_size, s.errors_total, s.uptime_secs, status,
        )

    def latest(self, worker: str) -> dict | None:
        return next(iter(self._all("SELECT * FROM metrics WHERE worker_id = ? ORDER BY id DESC LIMIT 1", worker)), None)

    def history(self, worker: str, limit: int = 100) -> list[dict]:
        return self._all("SELECT * FROM metrics WHERE worker_id = ? ORDER BY id DESC LIMIT ?", worker, limit)

    def prune(self, days: float) -> int:
        return self._change("DELETE FROM metrics WHERE timestamp < ?", self._now(days * 86_400))


# the same over frames


def lost_workers(workers: DataFrame, now: Column, timeout: int) -> DataFrame:
    """Workers that are alive by status and silent for longer than ``timeout`` seconds."""
    return workers.where(F.col("status").isin(*ALIVE) & (F.col("last_heartbeat") < now - F.make_dt_interval(secs=F.lit(timeout))))


def latest_metrics(metrics: DataFrame, values: list[str]) -> DataFrame:
    last = metrics.groupBy("worker_id").agg(F.max_by(F.struct("id", *values), "id").alias("_last"))
    return last.select("worker_id", "_last.*")


def metrics_history(metrics: DataFrame, limit: int) -> DataFrame:
    """The last ``limit`` rows of each worker."""
    place = F.row_number().over(Window.partitionBy("worker_id").orderBy(F.desc("id")))
    return metrics.withColumn("place", place).where(F.col("place") <= limit)


def kept_metrics(metrics: DataFrame, now: Column, days: int) -> DataFrame:
    return metrics.where(F.col("timestamp") >= now - F.make_dt_interval(days=F.lit(days)))

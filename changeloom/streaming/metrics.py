"""Counters of a pipeline."""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass


@dataclass(frozen=True)
class Snapshot:
    events_total: int
    events_per_sec: float
    batches_total: int
    last_batch_size: int
    errors_total: int
    last_flush_at: int
    uptime_secs: int


class Metrics:
    def __init__(self, clock=time.time):
        self._clock, self._lock, self._start = clock, threading.Lock(), clock()
        self.events = self.batches = self.last = self.errors = self.flushed_at = 0

    def batch(self, events: int) -> None:
        with self._lock:
            self.events, self.batches, self.last = self.events + events, self.batches + 1, events
            self.flushed_at = int(self._clock())

    def error(self) -> None:
        with self._lock:
            self.errors += 1

    def snapshot(self) -> Snapshot:
        up = int(self._clock() - self._start)
        with self._lock:
            return Snapshot(self.events, self.events / up if up else 0.0, self.batches, self.last, self.errors, self.flushed_at, up)

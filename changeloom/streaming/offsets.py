"""Resume positions by key: a SQLite file, or memory shared by copies."""

from __future__ import annotations

import sqlite3


class SqliteOffsets:
    """Durable before ``save`` returns; many keys share a file."""

    def __init__(self, path: str, key: str):
        self.path, self.key = path, key
        with sqlite3.connect(path) as db:
            db.execute("CREATE TABLE IF NOT EXISTS offsets (key TEXT PRIMARY KEY, value TEXT NOT NULL)")

    def load(self) -> str | None:
        with sqlite3.connect(self.path) as db:
            found = db.execute("SELECT value FROM offsets WHERE key = ?", [self.key]).fetchone()
        return found[0] if found else None

    def save(self, offset: str) -> None:
        with sqlite3.connect(self.path) as db:
            db.execute("INSERT OR REPLACE INTO offsets VALUES (?, ?)", [self.key, offset])


class MemoryOffsets:
    def __init__(self, store: dict | None = None):
        self.store = {} if store is None else store

    def load(self) -> str | None:
        return self.store.get("offset")

    def save(self, offset: str) -> None:
        self.store["offset"] = offset

    def copy(self) -> MemoryOffsets:
        return MemoryOffsets(self.store)

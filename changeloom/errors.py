"""Errors of the engine; each kind names the part that failed."""

from __future__ import annotations


class ChangeError(Exception):
    kind = "change"

    def __str__(self) -> str:
        return f"{self.kind} error: {super().__str__()}"


def _kind(name: str, kind: str) -> type[ChangeError]:
    return type(name, (ChangeError,), {"kind": kind, "__module__": __name__})


PostgresError = _kind("PostgresError", "postgres")
ProtocolError = _kind("ProtocolError", "protocol")
ParseError = _kind("ParseError", "parse")
StorageError = _kind("StorageError", "io")
JsonError = _kind("JsonError", "json")
ConfigError = _kind("ConfigError", "config")
SnapshotError = _kind("SnapshotError", "snapshot")
MySqlError = _kind("MySqlError", "mysql")
LakeError = _kind("LakeError", "iceberg")
KafkaError = _kind("KafkaError", "kafka")
HttpError = _kind("HttpError", "http")
AdminError = _kind("AdminError", "admin")
DatabaseError = _kind("DatabaseError", "database")
SchemaError = _kind("SchemaError", "schema")

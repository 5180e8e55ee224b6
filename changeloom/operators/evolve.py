"""Schema evolution: new and dropped columns found in a log, and evolved schemas.

Schemas are StructTypes whose fields carry ``field_id`` in their metadata.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..envelope import OLD, UPSERTS
from ..errors import SchemaError
from ..functions.types import spark_type


def new_columns(log: DataFrame, known: list[str]) -> DataFrame:
    """(column, first_seq) of columns that events carry and a target lacks.

    New images of inserts, updates and snapshots count, and old images of
    deletes; order them by (first_seq, column).
    """
    image = F.when(F.col("op").isin(*UPSERTS), F.col("new")).when(F.col("op") == "D", F.col("old"))
    names = log.select("seq", F.explode(F.map_keys(image)).alias("column"))
    found = names.groupBy("column").agg(F.min("seq").alias("first_seq"))
    return found.where(~F.col("column").isin(*known)) if known else found


def dropped_columns(target: list[str], source: list[str]) -> list[str]:
    """Target columns that the source no longer has, in order."""
    have = set(source)
    return [c for c in target if c not in have]


def drop_candidates(log: DataFrame, target: DataFrame, flattened: bool = False) -> DataFrame:
    """Target columns (one column ``column``) that no full row carries; none without full rows."""
    full = log.where(F.col("op").isin(*UPSERTS))
    carried = full.select(F.explode(F.map_keys("new")).alias("column")).distinct()
    any_full = full.limit(1).select(F.lit(1).alias("_any"))
    wanted = target.where(~F.col("column").startswith("_cdc_") & ~F.col("column").startswith(OLD)) if flattened else target
    return wanted.join(carried, "column", "left_anti").crossJoin(any_full).select("column")


def confirmed_drops(candidates: DataFrame, live_source: DataFrame) -> DataFrame:
    """Candidates that the live source schema lacks too."""
    return candidates.join(live_source.select("column"), "column", "left_anti")


def field_of(name: str, kind: str, number: int, nullable: bool = True) -> T.StructField:
    return T.StructField(name, spark_type(kind), nullable, {"field_id": number, "canonical": kind})


def replication_schema(columns: dict[str, str], pk: list[str]) -> T.StructType:
    """Source columns, numbered from 1; the key is required."""
    return T.StructType([field_of(c, k, i + 1, c not in pk) for i, (c, k) in enumerate(columns.items())])


def flattened_schema(columns: dict[str, str]) -> T.StructType:
    """Metadata, source and old columns, numbered from 1."""
    from ..envelope import META

    kinds = ["Text", "BigInt", "BigInt", "Boolean", "Text", "Text", "Text"]
    rows = [(m, k, False) for m, k in zip(META, kinds, strict=True)]
    rows += [(c, k, True) for c, k in columns.items()] + [(OLD + c, k, True) for c, k in columns.items()]
    return T.StructType([field_of(c, k, i + 1, n) for i, (c, k, n) in enumerate(rows)])


def highest_id(schema: T.StructType) -> int:
    return max((f.metadata.get("field_id", 0) for f in schema), default=0)


def add_columns(schema: T.StructType, columns: dict[str, str], flattened: bool = False) -> T.StructType:
    """``schema`` with optional columns; flattened logs get pairs that keep the layout."""
    fields, number = list(schema), highest_id(schema)
    at = next((i for i, f in enumerate(fields) if f.name.startswith(OLD)), len(fields)) if flattened else len(fields)
    for name, kind in columns.items():
        number += 1
        fields.insert(at, field_of(name, kind, number))
        at += 1
        if flattened:
            number += 1
            fields.append(field_of(OLD + name, kind, number))
    return T.StructType(fields)


def without_columns(schema: T.StructType, names: list[str], flattened: bool = False) -> T.StructType:
    gone = {*names, *([OLD + n for n in names] if flattened else [])}
    return T.StructType([f for f in schema if f.name not in gone])


@dataclass
class SchemaLog:
    """Versions of a table's schema; a commit names the version it was made from."""

    versions: list[T.StructType] = field(default_factory=list)
    current: int = -1
    last_field_id: int = 0

    def commit(self, schema: T.StructType, expected: int) -> int:
        """The id of ``schema``: the current one if equal, an older one if it was there before, else a new one."""
        if expected != self.current:
            raise SchemaError(f"schema {self.current} is current, not {expected}")
        shape = lambda s: [(f.name, f.dataType, f.nullable, f.metadata.get("field_id")) for f in s]
        for number, known in enumerate(self.versions):
            if shape(known) == shape(schema):
                self.current = number
                break
        else:
            self.versions.append(schema)
            self.current = len(self.versions) - 1
        self.last_field_id = max(self.last_field_id, highest_id(schema))
        return self.current


def aligned(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns of ``schema``: missing ones null, others gone."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

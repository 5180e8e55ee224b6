"""Source types, canonical types and target types.

A canonical type is written as text: ``BigInt``, ``VarString(20)``,
``Decimal(10,2)``.  The maps run on the driver for schemas; ``canonical_column``
does the same for a column of a metadata frame.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spellings of the PostgreSQL types (others are Text).
PG_NAMES = {
    "SmallInt": ["smallint", "int2"],
    "Int": ["integer", "int", "int4"],
    "BigInt": ["bigint", "int8"],
    "Boolean": ["boolean", "bool"],
    "Float": ["real", "float4"],
    "Double": ["double precision", "float8"],
    "Decimal": ["numeric", "decimal"],
    "Text": ["text", "name"],
    "VarString": ["varchar", "character varying"],
    "FixedString": ["char", "character"],
    "Timestamp": ["timestamp without time zone", "timestamp"],
    "TimestampTz": ["timestamp with time zone", "timestamptz"],
    "Date": ["date"],
    "Time": ["time", "time without time zone"],
    "Binary": ["bytea"],
    "Uuid": ["uuid"],
    "Json": ["json", "jsonb"],
}
#: Spellings of the MySQL types without their parentheses (others are Text).
MYSQL_NAMES = {
    "Decimal": ["decimal", "numeric"],
    "VarString": ["varchar"],
    "FixedString": ["char"],
    "Int": ["int", "integer", "mediumint"],
    "BigInt": ["bigint"],
    "SmallInt": ["smallint", "tinyint"],
    "Float": ["float"],
    "Double": ["double", "real"],
    "Timestamp": ["timestamp", "datetime"],
    "Date": ["date"],
    "Time": ["time"],
    "Year": ["year"],
    "Binary": ["blob", "tinyblob", "mediumblob", "longblob", "binary", "varbinary"],
    "Json": ["json"],
}
#: MySQL spellings that stand for a flag.
MYSQL_FLAGS = ["tinyint(1)", "bool", "boolean"]
#: PostgreSQL DDL and lake types of canonical types.
TARGETS = {
    "Boolean": ("boolean", "boolean"),
    "SmallInt": ("smallint", "int"),
    "Int": ("integer", "int"),
    "BigInt": ("bigint", "long"),
    "Float": ("real", "float"),
    "Double": ("double precision", "double"),
    "Decimal": ("numeric", "decimal(38,18)"),
    "VarString": ("character varying", "string"),
    "FixedString": ("character(1)", "string"),
    "Text": ("text", "string"),
    "Timestamp": ("timestamp without time zone", "timestamp"),
    "TimestampTz": ("timestamp with time zone", "timestamptz"),
    "Date": ("date", "date"),
    "Time": ("time without time zone", "time"),
    "Binary": ("bytea", "binary"),
    "Uuid": ("uuid", "uuid"),
    "Json": ("jsonb", "string"),
    "Year": ("smallint", "int"),
}
_SPARK = {
    "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(),
    "string": T.StringType(), "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(), "date": T.DateType(),
    "time": T.LongType(), "binary": T.BinaryType(), "uuid": T.BinaryType(),
}
_SIZED = ("Decimal", "VarString", "FixedString")


def _spelled(names: dict[str, list[str]]) -> dict[str, str]:
    return {spelling: kind for kind, spellings in names.items() for spelling in spellings}


def _split(raw: str) -> tuple[str, str]:
    """Lower-case type name and what stands in its parentheses."""
    text = raw.strip().lower()
    name, bracket, rest = text.partition("(")
    return name, rest.partition(")")[0] if bracket else ""


def _sized(kind: str, inside: str) -> str:
    numbers = [x.strip() for x in inside.split(",")]
    numbers = [x for x in numbers[: 2 if kind == "Decimal" else 1] if re.fullmatch(r"\+?\d+", x)]
    return f"{kind}({','.join(numbers)})" if numbers else kind


def canonical(dialect: str, raw: str) -> str:
    """Canonical type of a source type; ``dialect`` is postgres or mysql."""
    name, inside = _split(raw)
    text = raw.strip().lower()
    if dialect == "mysql":
        if text in MYSQL_FLAGS:
            return "Boolean"
        kind = _spelled(MYSQL_NAMES).get(name, "Text")
        return _sized(kind, inside) if kind in _SIZED else kind
    kind = _spelled(PG_NAMES).get(name, "Text")
    if "(" in text:  # of PostgreSQL's types only these may carry a size
        return _sized(kind, inside) if kind in _SIZED else "Text"
    return kind


def canonical_column(dialect: str, raw: Column) -> Column:
    """``canonical`` for a column, without leaving the JVM."""
    text = F.lower(F.trim(raw))
    name = F.split_part(text, F.lit("("), F.lit(1))
    inside = F.regexp_extract(text, r"\(([^)]*)\)", 1)
    spelled = _spelled(MYSQL_NAMES if dialect == "mysql" else PG_NAMES)
    kinds = F.create_map(*[F.lit(x) for pair in spelled.items() for x in pair])
    kind = F.coalesce(F.try_element_at(kinds, name), F.lit("Text"))
    first, second = (F.trim(F.split_part(inside, F.lit(","), F.lit(i))) for i in (1, 2))
    number = lambda x: x.rlike(r"\A\+?\d+\z")
    two = F.when(number(first) & number(second), F.concat(kind, F.lit("("), first, F.lit(","), second, F.lit(")")))
    one = F.when(number(first), F.concat(kind, F.lit("("), first, F.lit(")")))
    sized = F.when(kind == "Decimal", F.coalesce(two, one, kind)).otherwise(F.coalesce(F.when(number(inside), one), kind))
    if dialect == "mysql":
        return F.when(text.isin(*MYSQL_FLAGS), "Boolean").when(kind.isin(*_SIZED), sized).otherwise(kind)
    return F.when(~text.contains("("), kind).when(kind.isin(*_SIZED), sized).otherwise("Text")


def pg_ddl(kind: str) -> str:
    """PostgreSQL type of a canonical type."""
    name, inside = kind.partition("(")[0], kind.partition("(")[2].rstrip(")")
    if inside and name in _SIZED:
        base = {"Decimal": "numeric", "VarString": "character varying", "FixedString": "character"}[name]
        return f"{base}({inside})"
    return TARGETS[name][0]


def lake_type(kind: str) -> str:
    """Type of a canonical type in a lake table; decimals default to (38,18)."""
    name, inside = kind.partition("(")[0], kind.partition("(")[2].rstrip(")")
    if name == "Decimal":
        precision, _, scale = (inside or "38,18").partition(",")
        return f"decimal({precision},{scale or 18})"
    return TARGETS[name][1]


def spark_type(kind: str) -> T.DataType:
    name = lake_type(kind)
    if name.startswith("decimal"):
        precision, scale = map(int, name[8:-1].split(","))
        return T.DecimalType(precision, scale)
    return _SPARK[name]

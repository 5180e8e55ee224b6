"""Columns, keys and replication objects of a source, from its catalog tables.

Catalogs are frames: read them with ``read_jdbc`` (``PG_ATTRIBUTES`` is the one
subquery needed) or give them as they are.  One pass serves any number of tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.types import canonical_column

#: ``dbtable`` for PostgreSQL's columns with their full type names.
PG_ATTRIBUTES = "(select attrelid, attname, attnum, attnotnull, attisdropped, format_type(atttypid, atttypmod) as source_type from pg_attribute) as attributes"


def _described(dialect: str, name: str, source_type: str, nullable: Column, place: str) -> list[Column]:
    kind = canonical_column(dialect, F.col(source_type))
    return ["schema", "table", F.col(name).alias("name"), F.col(source_type).alias("source_type"), kind.alias("canonical"), nullable.alias("nullable"), F.col(place).cast("int").alias("ordinal")]


def pg_columns(attributes: DataFrame, classes: DataFrame, namespaces: DataFrame) -> DataFrame:
    """(schema, table, name, source_type, canonical, nullable, ordinal) of PostgreSQL tables."""
    spaces = namespaces.select(F.col("oid").alias("relnamespace"), F.col("nspname").alias("schema"))
    tables = classes.select(F.col("oid").alias("attrelid"), F.col("relname").alias("table"), "relnamespace").join(spaces, "relnamespace")
    live = attributes.where((F.col("attnum") > 0) & ~F.col("attisdropped"))
    return live.join(tables, "attrelid").select(*_described("postgres", "attname", "source_type", ~F.col("attnotnull"), "attnum"))


def mysql_columns(columns: DataFrame) -> DataFrame:
    """The same of MySQL's ``information_schema.columns``."""
    named = columns.withColumn("schema", F.col("table_schema")).withColumn("table", F.col("table_name"))
    return named.select(*_described("mysql", "column_name", "column_type", F.lower("is_nullable") == "yes", "ordinal_position"))


def constraint_keys(usage: DataFrame, constraints: DataFrame | None = None) -> DataFrame:
    """(schema, table, pk) from ``key_column_usage``; without ``table_constraints`` MySQL's fixed name marks a key."""
    if constraints is None:
        keys = usage.where("constraint_name = 'PRIMARY'")
    else:
        own = constraints.where("constraint_type = 'PRIMARY KEY'").select("table_schema", "table_name", "constraint_name")
        keys = usage.join(own, ["table_schema", "table_name", "constraint_name"], "left_semi")
    parts = F.array_sort(F.collect_list(F.struct("ordinal_position", "column_name")))
    lists = keys.groupBy(F.col("table_schema").alias("schema"), F.col("table_name").alias("table")).agg(parts.alias("parts"))
    return lists.select("schema", "table", F.transform("parts", lambda x: x["column_name"]).alias("pk"))


def flag_columns(columns: DataFrame) -> DataFrame:
    """(schema, table, name) of MySQL columns that hold flags: tinyint(1) as spelled."""
    return columns.where(F.lower("source_type") == "tinyint(1)").select("schema", "table", "name")


def column_subset(wanted: DataFrame, columns: DataFrame) -> DataFrame:
    """``columns`` for ``wanted`` (schema, table, name), which is Text where the source has no such column."""
    found = wanted.join(columns, ["schema", "table", "name"], "left")
    fallback = {"source_type": F.lit("text"), "canonical": F.lit("Text"), "nullable": F.lit(True), "ordinal": F.lit(0)}
    return found.select("schema", "table", "name", *[F.coalesce(c, x).alias(c) for c, x in fallback.items()])


# replication objects of PostgreSQL


def _name(text: str) -> str:
    return '"' + text.replace('"', '""') + '"'


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def slot_statements(slot: str) -> dict[str, str]:
    """Statements that create, drop and describe a logical replication slot."""
    return {
        "create": f"SELECT lsn FROM pg_create_logical_replication_slot({_literal(slot)}, 'pgoutput')",
        "drop": f"SELECT pg_drop_replication_slot({_literal(slot)})",
        "info": f"SELECT slot_name, plugin, confirmed_flush_lsn, active FROM pg_replication_slots WHERE slot_name = {_literal(slot)}",
    }


def publication_statement(publication: str, tables: list[str]) -> str:
    """CREATE PUBLICATION for ``tables`` (schema.table or table), all tables if there are none."""
    if not tables:
        return f"CREATE PUBLICATION {_name(publication)} FOR ALL TABLES"
    names = [".".join(_name(part) for part in t.split(".", 1)) for t in tables]
    return f"CREATE PUBLICATION {_name(publication)} FOR TABLE {', '.join(names)}"


def ensured_publication(publication: str, published: list[str] | None, wanted: list[str], create: bool = True) -> str | None:
    """The statement that is missing, if any; ``published`` is None where there is no such publication."""
    if published is None:
        if not create:
            raise ConfigError(f"publication {publication} does not exist and may not be created")
        return publication_statement(publication, wanted)
    missing, extra = sorted(set(wanted) - set(published)), sorted(set(published) - set(wanted))
    if wanted and (missing or extra):
        raise ConfigError(f"publication {publication}: missing {missing}, extra {extra}")
    return None

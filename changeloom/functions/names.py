"""Names and statements: identifiers, topics, COPY text, TRUNCATE statements."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F


def quote_identifier(name: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))


def topic(prefix: str, schema: Column, table: Column) -> Column:
    return F.concat_ws(".", F.lit(prefix), schema, table)


def message_key(schema: Column, table: Column) -> Column:
    return F.concat_ws(".", schema, table)


def target_name(prefix: str, table: Column) -> Column:
    return F.concat(F.lit(prefix), table)


def table_parts(name: Column, default_schema: str) -> Column:
    """struct(schema, table) of ``schema.table`` or ``table``, cut at the first dot."""
    dotted = name.contains(".")
    schema = F.when(dotted, F.substring_index(name, ".", 1)).otherwise(default_schema)
    table = F.when(dotted, F.regexp_replace(name, r"(?s)\A[^.]*\.", "")).otherwise(name)
    return F.struct(schema.alias("schema"), table.alias("table"))


def unescape_copy(text: Column) -> Column:
    r"""COPY text: ``\n``, ``\t``, ``\r`` and ``\\`` are unescaped, other backslashes stay."""
    out = F.replace(text, F.lit("\\\\"), F.lit("\x01"))
    for letter, char in (("n", "\n"), ("t", "\t"), ("r", "\r")):
        out = F.replace(out, F.lit("\\" + letter), F.lit(char))
    return F.replace(out, F.lit("\x01"), F.lit("\\"))


def copy_fields(line: Column) -> Column:
    r"""Fields of a COPY text line: split at tabs, ``\N`` null, the rest unescaped."""
    return F.transform(F.split(line, "\t"), lambda x: F.when(x != "\\N", unescape_copy(x)))


def strip_comments(sql: Column) -> Column:
    """A statement without its block comments; an open one takes the rest."""
    return F.regexp_replace(sql, r"(?s)/\*.*?(\*/|\z)", "")


def truncated_table(sql: Column, default_schema: Column) -> Column:
    """struct(schema, table) of a TRUNCATE statement, null for others."""
    bare = F.trim(F.regexp_replace(strip_comments(sql), r"\A\s+|\s+\z", ""))
    rest = F.regexp_replace(bare, r"(?is)\Atruncate(\s+table\b)?", "")
    name = F.regexp_replace(F.regexp_replace(rest, r"[;\s]+\z", ""), r"\A\s+", "")
    tidy = lambda x: F.regexp_replace(F.regexp_replace(x, r"\A\s+|\s+\z", ""), r"\A`+|`+\z", "")
    dotted = name.contains(".")
    schema = F.when(dotted, tidy(F.substring_index(name, ".", 1))).otherwise(default_schema)
    table = F.when(dotted, tidy(F.regexp_replace(name, r"(?s)\A[^.]*\.", ""))).otherwise(tidy(name))
    return F.when(bare.rlike(r"(?is)\Atruncate\b"), F.struct(schema.alias("schema"), table.alias("table")))


def fallback_names(n: Column) -> Column:
    """``col_0`` to ``col_{n-1}``."""
    numbers = F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda i: F.concat(F.lit("col_"), i.cast("string")))


def commit_url(uri: str, namespace: list[str], table: str, prefix: str | None = None) -> str:
    """URL of a table in a REST catalog; levels of the namespace are joined by the unit separator."""
    parts = [uri.rstrip("/"), "v1", *([prefix] if prefix else []), "namespaces", "\u001f".join(namespace), "tables", table]
    return "/".join(parts)


def connection_url(dialect: str, host: str, port: int, user: str, password: str | None, database: str) -> str:
    secret = f":{quote(password, safe='')}" if password else ""
    return f"{dialect}://{quote(user, safe='')}{secret}@{host}:{port}/{database}"

"""Cells, images and events as text and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..envelope import is_snapshot

#: Canonical types inferred from type tags.
INFERRED = {
    "Null": "Text", "Bool": "Boolean", "Int": "BigInt", "Float": "Double", "Text": "Text",
    "Bytes": "Binary", "Timestamp": "Timestamp", "Date": "Date", "Time": "Time", "UnchangedToast": "Text",
}


def plain_number(text: Column) -> Column:
    """A double's text without exponent and without a trailing ``.0``."""
    shape = r"\A(-?)(\d)\.(\d+)E(-?\d+)\z"
    part = lambda i: F.regexp_extract(text, shape, i)
    power = part(4).try_cast("int")
    digits = F.regexp_replace(F.concat(part(2), part(3)), r"0+\z", "")
    large = F.when(power + 1 >= F.length(digits), F.rpad(digits, power + 1, F.lit("0"))).otherwise(
        F.concat(F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2))
    )
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    return F.when(text.contains("E"), F.concat(part(1), F.when(power >= 0, large).otherwise(small))).otherwise(
        F.regexp_replace(text, r"\.0\z", "")
    )


def is_finite(text: Column) -> Column:
    return ~F.lower(text).rlike(r"nan|inf")


def to_text(c: Column) -> Column:
    """Text of a cell; null for Null, unchanged large values and numbers that are not finite."""
    value = c["value"]
    number = F.when(is_finite(value), plain_number(value.try_cast("double").cast("string")))
    return F.when(c["type"].isin("Null", "UnchangedToast"), F.lit(None).cast("string")).when(c["type"] == "Float", number).otherwise(value)


def fallback_text(c: Column) -> Column:
    """Text of a cell for string columns, which keep NaN and the infinities."""
    special = F.regexp_replace(F.regexp_replace(c["value"], "(?i)infinity", "inf"), "(?i)nan", "NaN")
    return F.when((c["type"] == "Float") & ~is_finite(c["value"]), special).otherwise(to_text(c))


def quoted(text: Column) -> Column:
    """A JSON string."""
    array = F.to_json(F.array(text))
    return F.substr(array, F.lit(2), F.length(array) - 2)


def to_json_value(c: Column) -> Column:
    """JSON text of a cell."""
    none = F.lit("null")
    number = F.when(is_finite(c["value"]), c["value"].try_cast("double").cast("string")).otherwise(none)
    return (
        F.when(c["type"].isin("Null", "UnchangedToast") | c["value"].isNull(), none)
        .when(c["type"].isin("Bool", "Int"), c["value"])
        .when(c["type"] == "Float", number)
        .otherwise(quoted(c["value"]))
    )


def _object(entries: Column, value) -> Column:
    pairs = F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(":"), value(e["value"])))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def row_json(image: Column) -> Column:
    """An image as a plain JSON object, names in code point order."""
    return _object(F.array_sort(F.map_entries(image)), to_json_value)


def typed_row_json(image: Column) -> Column:
    """``{"values": {...}, "types": {...}}`` of an image, null without one."""
    entries = F.array_sort(F.map_entries(image))
    types = _object(entries, lambda c: quoted(c["type"]))
    return F.concat(F.lit('{"values":'), _object(entries, to_json_value), F.lit(',"types":'), types, F.lit("}"))


def event_json(lsn="lsn", timestamp_us="timestamp_us", schema="schema", table="table", op="op", pk="pk", new="new", old="old") -> Column:
    """The JSON envelope of a change event."""
    c = F.col
    meta = F.to_json(
        F.struct(
            c(op).alias("op"), c(lsn).alias("lsn"), c(timestamp_us).alias("timestamp_us"), is_snapshot(c(op)).alias("snapshot"),
            c(schema).alias("schema"), c(table).alias("table"), c(pk).alias("primary_key_columns"),
        )
    )
    side = lambda x: F.coalesce(typed_row_json(c(x)), F.lit("null"))
    return F.concat(F.lit('{"metadata":'), meta, F.lit(',"new":'), side(new), F.lit(',"old":'), side(old), F.lit("}"))


def inferred_type(c: Column) -> Column:
    """Canonical type of a cell by its type tag."""
    pairs = [F.lit(x) for pair in INFERRED.items() for x in pair]
    return F.element_at(F.create_map(*pairs), c["type"])


def key_names_json(pk: Column) -> Column:
    return F.to_json(pk)

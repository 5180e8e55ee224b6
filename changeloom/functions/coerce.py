"""Cells to typed columns, exactly as strict as the targets need.

Spark's casts trim blanks, accept exponents and round; regular expressions
guard each of them.  A cell is struct(type, value).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INT = r"\A[+-]?\d+\z"
_DECIMAL = r"\A[+-]?(\d+(\.\d*)?|\.\d+)\z"
_TIME = r"\A(\d{1,2}):(\d{2}):(\d{2})(?:\.(\d{1,9}))?\z"
_STAMP = r"\A\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}(:?\d{2})?)?\z"


def _is(c: Column, *types: str) -> Column:
    return c["type"].isin(*types)


def parse_long(text: Column) -> Column:
    return F.when(text.rlike(_INT), text.try_cast("long"))


def to_long(c: Column) -> Column:
    return F.when(_is(c, "Int", "Text"), parse_long(c["value"]))


def to_int(c: Column) -> Column:
    """An Int keeps its low 32 bits; a Text must fit."""
    low = to_long(c).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    wrapped = F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low).cast("int")
    return F.when(_is(c, "Int"), wrapped).when(_is(c, "Text") & c["value"].rlike(_INT), c["value"].try_cast("int"))


def to_double(c: Column) -> Column:
    number = r"(?i)\A[+-]?(\d+(\.\d*)?([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|infinity|nan)\z"
    return F.when(_is(c, "Float", "Int", "Text") & c["value"].rlike(number), c["value"].try_cast("double"))


def to_boolean(c: Column) -> Column:
    """Bool as is, Int by being other than 0, Text by being t, true or 1; others null."""
    return (
        F.when(_is(c, "Bool"), c["value"] == "true")
        .when(_is(c, "Int"), c["value"].try_cast("long") != 0)
        .when(_is(c, "Text"), c["value"].isin("t", "true", "1"))
    )


def to_timestamp_us(text: Column) -> Column:
    """Microseconds since 1970; times without a zone are UTC (the session's zone)."""
    return F.when(text.rlike(_STAMP), F.unix_micros(text.try_cast("timestamp")))


def to_days(text: Column) -> Column:
    return F.when(text.rlike(r"\A\d{4}-\d{1,2}-\d{1,2}\z"), F.unix_date(text.try_cast("date")))


def to_time_us(text: Column) -> Column:
    """Microseconds since midnight of ``H:MM:SS`` with up to nine decimals."""
    part = lambda i: F.regexp_extract(text, _TIME, i).try_cast("long")
    fraction = F.rpad(F.substring(F.regexp_extract(text, _TIME, 4), 1, 6), 6, "0").try_cast("long")
    good = text.rlike(_TIME) & (part(1) < 24) & (part(2) < 60) & (part(3) < 60)
    return F.when(good, (part(1) * 3600 + part(2) * 60 + part(3)) * 1_000_000 + fraction)


def decimal_text(text: Column, scale: int) -> Column:
    """Decimal of plain digits; decimals beyond ``scale`` are cut off."""
    cut = F.regexp_replace(text, rf"\A([+-]?\d*\.\d{{{scale}}})\d+\z" if scale else r"\A([+-]?\d*)\.\d*\z", "$1")
    return F.when(text.rlike(_DECIMAL), cut.try_cast(f"decimal(38,{scale})"))


def to_decimal(c: Column, scale: int) -> Column:
    """Text is cut off, Float is rounded, Int is scaled."""
    rounded = F.round(c["value"].try_cast("decimal(38,18)"), scale).try_cast(f"decimal(38,{scale})")
    return (
        F.when(_is(c, "Text"), decimal_text(c["value"], scale))
        .when(_is(c, "Float"), rounded)
        .when(_is(c, "Int"), c["value"].try_cast(f"decimal(38,{scale})"))
    )


def to_uuid_bytes(text: Column) -> Column:
    """16 bytes of the 32 hexadecimal digits of a text, whatever stands between them."""
    digits = F.regexp_replace(text, "[^0-9A-Fa-f]", "")
    return F.when(F.length(digits) == 32, F.unhex(digits))


def to_binary(c: Column) -> Column:
    """Only Bytes cells (hexadecimal) have a binary value."""
    return F.when(_is(c, "Bytes"), F.try_to_binary(c["value"], F.lit("hex")))


def typed(c: Column, canonical: str) -> Column:
    """A cell as a column of a canonical type, e.g. ``BigInt`` or ``Decimal(10,2)``."""
    name, _, rest = canonical.partition("(")
    text = F.when(~_is(c, "Null", "UnchangedToast"), c["value"])
    if name == "Decimal":
        scale = int(rest.rstrip(")").split(",")[1]) if "," in rest else 18
        return to_decimal(c, scale)
    return {
        "Boolean": lambda: to_boolean(c),
        "SmallInt": lambda: to_int(c),
        "Int": lambda: to_int(c),
        "Year": lambda: to_int(c),
        "BigInt": lambda: to_long(c),
        "Float": lambda: to_double(c).cast("float"),
        "Double": lambda: to_double(c),
        "Timestamp": lambda: F.timestamp_micros(to_timestamp_us(text)).cast("timestamp_ntz"),
        "TimestampTz": lambda: F.timestamp_micros(to_timestamp_us(text)),
        "Date": lambda: F.date_from_unix_date(to_days(text)),
        "Time": lambda: to_time_us(text),
        "Binary": lambda: to_binary(c),
        "Uuid": lambda: to_uuid_bytes(text),
    }.get(name, lambda: text)()


# values from the wire

#: PostgreSQL type oids and the type tag their text gets.
PG_TAGS = {
    16: "Bool", 20: "Int", 21: "Int", 23: "Int", 26: "Int", 700: "Float", 701: "Float", 17: "Bytes",
    1082: "Date", 1083: "Time", 1266: "Time", 1114: "Timestamp", 1184: "Timestamp",
}
_FLOAT = r"(?i)\A[+-]?(\d+(\.\d*)?(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity|nan)\z"


def pg_cell(text: Column, oid: Column) -> Column:
    """Cell of a PostgreSQL text value; what does not parse stays Text."""
    as_text = F.struct(F.lit("Text").alias("type"), text.alias("value"))
    value = lambda tag, v: F.struct(F.lit(tag).alias("type"), v.alias("value"))
    out = as_text
    for number, tag in PG_TAGS.items():
        if tag == "Bool":
            here = value(tag, (text == "t").cast("string"))
        elif tag == "Int":
            here = F.when(parse_long(text).isNotNull(), value(tag, parse_long(text).cast("string"))).otherwise(as_text)
        elif tag == "Float":
            here = F.when(text.rlike(_FLOAT), value(tag, text)).otherwise(as_text)
        elif tag == "Bytes":
            digits = F.regexp_replace(text, r"\A\\x", "")
            good = text.startswith("\\x") & F.unhex(digits).isNotNull() & (F.length(digits) % 2 == 0)
            here = F.when(good, value(tag, F.lower(digits))).otherwise(as_text)
        else:
            here = value(tag, text)
        out = F.when(oid == number, here).otherwise(out)
    return F.when(text.isNull(), cell_null()).otherwise(out)


def cell_null() -> Column:
    return F.struct(F.lit("Null").alias("type"), F.lit(None).cast("string").alias("value"))


def mysql_cell(text: Column, column_type: Column) -> Column:
    """Cell of MySQL bytes by the declared column type; decimals and what does not parse stay Text."""
    base = F.regexp_replace(F.lower(F.trim(F.split_part(column_type, F.lit("("), F.lit(1)))), r"( unsigned| zerofill)+\z", "")
    trimmed = F.trim(text)
    whole = base.isin("int", "integer", "mediumint", "bigint", "smallint", "tinyint") & parse_long(trimmed).isNotNull()
    real = base.isin("float", "double", "real") & trimmed.rlike(_FLOAT)
    tag = F.when(whole, "Int").when(real, "Float").otherwise("Text")
    value = F.when(whole, parse_long(trimmed).cast("string")).when(real, trimmed).otherwise(text)
    return F.when(text.isNull(), cell_null()).otherwise(F.struct(tag.alias("type"), value.alias("value")))


def mysql_number(value: Column, is_bool: Column) -> Column:
    """Cell of an unsigned number given as decimal(20,0): flags become Bool, beyond a long Text."""
    fits = value <= F.lit("9223372036854775807").cast("decimal(20,0)")
    tag = F.when(value.isNull(), "Null").when(is_bool, "Bool").when(fits, "Int").otherwise("Text")
    return F.struct(tag.alias("type"), F.when(is_bool, (value != 0).cast("string")).otherwise(value.cast("string")).alias("value"))


def mysql_date(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column, us: Column, column_type: Column | None = None) -> Column:
    """Date at midnight, else date and time, with microseconds if there are any.

    Where ``column_type`` is known (``date``, ``datetime(3)``), the text has its parts,
    whatever they are: the midnight of a ``datetime`` is a date and a time.
    """
    day = F.format_string("%04d-%02d-%02d", y, mo, d)
    time = F.format_string(" %02d:%02d:%02d", h, mi, s)
    fraction = F.format_string(".%06d", us)
    full = F.concat(day, time, F.when(us == 0, "").otherwise(fraction))
    by_value = F.when((h == 0) & (mi == 0) & (s == 0) & (us == 0), day).otherwise(full)
    if column_type is None:
        return by_value
    kind = F.lower(F.trim(column_type))
    digits = F.coalesce(F.regexp_extract(kind, r"\(\s*(\d)", 1).try_cast("int"), F.lit(0))
    typed = F.concat(day, time, F.when(digits > 0, F.substring(fraction, F.lit(1), digits + 1)).otherwise(""))
    return F.when(kind == "date", day).when(kind.rlike("^(datetime|timestamp)"), typed).otherwise(by_value)


def mysql_time(negative: Column, days: Column, h: Column, mi: Column, s: Column, us: Column) -> Column:
    hours = (days.cast("long") * 24 + h).cast("string")
    rest = F.format_string(":%02d:%02d", mi, s)
    return F.concat(F.when(negative, "-").otherwise(""), hours, rest, F.when(us == 0, "").otherwise(F.format_string(".%06d", us)))

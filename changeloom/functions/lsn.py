"""Log positions: PostgreSQL LSNs as longs, MySQL file and offset, epochs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: microseconds from 1970-01-01 to 2000-01-01, PostgreSQL's epoch.
PG_EPOCH_US = 946_684_800_000_000


def lsn_format(lsn: Column) -> Column:
    """``XX/YY``: upper-case hexadecimal without padding; negative longs are the upper half of u64."""
    return F.concat(F.hex(F.shiftrightunsigned(lsn, 32)), F.lit("/"), F.hex(lsn.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))))


def lsn_parse(text: Column) -> Column:
    """The long of ``XX/YY``, null for anything else."""
    half = lambda i: F.conv(F.split_part(text, F.lit("/"), F.lit(i)), 16, 10).cast("long")
    good = text.rlike(r"\A\+?[0-9A-Fa-f]{1,8}/\+?[0-9A-Fa-f]{1,8}\z")
    return F.when(good, F.shiftleft(half(1), 32).bitwiseOR(half(2)))


def mysql_offset_format(file: Column, position: Column) -> Column:
    return F.concat(file, F.lit(":"), position.cast("string"))


def mysql_offset_parse(text: Column) -> Column:
    """struct(file, position), cut at the last colon; null without a colon or a position."""
    good = text.rlike(r"(?s)\A.*:\+?\d+\z")
    file = F.regexp_extract(text, r"(?s)\A(.*):\+?\d+\z", 1)
    position = F.regexp_extract(text, r":\+?(\d+)\z", 1).try_cast("long")
    return F.when(good & position.isNotNull(), F.struct(file.alias("file"), position.alias("position")))


def pg_time_us(us: Column) -> Column:
    """Microseconds since 1970 of PostgreSQL's microseconds since 2000."""
    return us + F.lit(PG_EPOCH_US)

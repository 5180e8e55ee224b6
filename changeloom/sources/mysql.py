"""MySQL's binary log as rows, and its changes as events.

A decoded binlog event is a row: seq, file, position, kind, and what the kind
carries.  Kinds: ``table_map`` (table_id, schema, table, names), ``write``,
``update``, ``delete`` (table_id, images), ``query`` (sql), ``xid``, ``rotate``.
Row images are arrays of cells; updates list before and after in turn.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..envelope import CELL
from ..errors import MySqlError
from ..functions.coerce import cell_null, mysql_cell, mysql_number
from ..functions.names import fallback_names, truncated_table
from ..operators.ordered import last_known

EVENT = (
    "seq long, file string, position long, timestamp_us long, kind string, table_id long, schema string, table string, "
    f"names array<string>, images array<array<{CELL}>>, sql string, xid long"
)


def with_files(log: DataFrame, span: int = 100_000) -> DataFrame:
    """``log`` with the current file: rotate events name the one that follows."""
    return last_known(log, F.when(F.col("kind") == "rotate", F.col("file")), "_file", span=span).withColumn("file", F.coalesce("_file", "file")).drop("_file")


def binlog_cell(kind: Column, value: Column, column_type: Column, is_flag: Column) -> Column:
    """Cell of a decoded binary log value given as its kind and its text.

    Kinds: ``int``, ``uint``, ``double``, ``bytes`` (typed by ``column_type``, Text
    where that is null), ``date``, ``time``, ``json``, and ``json_diff``, whose
    partial update cannot be applied and is marked as such.  Numbers of flag
    columns become Bool.
    """
    as_is = lambda tag: F.struct(F.lit(tag).alias("type"), value.alias("value"))
    whole = mysql_number(value.try_cast("decimal(20,0)"), F.lit(False))
    typed = F.when(column_type.isNull(), as_is("Text")).otherwise(mysql_cell(value, column_type))
    day = F.when(value.contains(" "), as_is("Timestamp")).otherwise(as_is("Date"))
    marked = F.struct(F.lit("Text").alias("type"), F.lit("[json_diff]").alias("value"))
    found = (
        F.when(kind == "json_diff", marked)
        .when(value.isNull(), cell_null())
        .when(kind == "int", as_is("Int"))
        .when(kind == "uint", whole)
        .when(kind == "double", as_is("Float"))
        .when(kind == "bytes", typed)
        .when(kind == "date", day)
        .when(kind == "time", as_is("Time"))
        .otherwise(as_is("Text"))
    )
    flag = F.struct(F.lit("Bool").alias("type"), (found["value"] != "0").cast("string").alias("value"))
    return F.when(F.coalesce(is_flag, F.lit(False)) & (found["type"] == "Int"), flag).otherwise(found)


#: Statements that show the current position, the newer one first.
POSITION_STATEMENTS = ["SHOW BINARY LOG STATUS", "SHOW MASTER STATUS"]


def snapshot_position(run: Callable[[str], list[tuple]]) -> str:
    """``file:position`` of the server, from the first statement that it knows; ``run`` gives a statement's rows."""
    for statement in POSITION_STATEMENTS:
        try:
            found = run(statement)
        except Exception:
            continue
        if found:
            return f"{found[0][0]}:{found[0][1]}"
    raise MySqlError("the server shows no binary log position; is its binary log on?")


def refreshed_names(columns: DataFrame) -> DataFrame:
    """(schema, table, names) of ``information_schema.columns``, in order of place."""
    place = F.struct(F.col("ordinal_position").alias("at"), F.col("column_name").alias("name"))
    lists = columns.groupBy(F.col("table_schema").alias("schema"), F.col("table_name").alias("table")).agg(F.array_sort(F.collect_list(place)).alias("names"))
    return lists.withColumn("names", F.transform("names", lambda x: x["name"]))


def _named(cells: Column, *names: Column) -> Column:
    """Cells by the first list of names that is as wide as they are."""
    out = fallback_names(F.size(cells))
    for one in reversed(names):
        out = F.when(F.size(one) == F.size(cells), one).otherwise(out)
    return F.map_from_arrays(out, cells)


def row_events(log: DataFrame, primary_keys: DataFrame | None = None, tables: list[str] | None = None, span: int = 100_000, columns: DataFrame | None = None) -> DataFrame:
    """Insert, update, delete and truncate events; ``tables`` (schema.table) filters.

    A row event takes the names of the last table map of its table id.  Where the
    widths differ (names are not logged, or a column came later), the names of
    ``columns`` (``refreshed_names``) are taken if they fit, else columns are called
    ``col_0`` and so on.  ``part`` orders the rows of one event.
    """
    mapped = F.when(F.col("kind") == "table_map", F.struct("schema", "table", "names"))
    rows = last_known(log.where(F.col("kind").isin("table_map", "write", "update", "delete")), mapped, "map", by=["table_id"], span=span)
    rows = rows.where(F.col("kind") != "table_map")
    step = F.when(F.col("kind") == "update", 2).otherwise(1)
    n = F.floor(F.size("images") / step).cast("int")
    rows = rows.withColumn("part", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))))
    first, second = F.get("images", F.col("part") * step), F.get("images", F.col("part") * step + 1)
    kind = F.col("kind")
    new = F.when(kind == "write", first).when(kind == "update", second)
    old = F.when(kind.isin("update", "delete"), first)
    names = [F.col("map.names")]
    if columns is not None:
        fresh = columns.select(F.col("schema").alias("_schema"), F.col("table").alias("_table"), F.col("names").alias("_fresh"))
        rows = rows.join(fresh, (F.col("map.schema") == F.col("_schema")) & (F.col("map.table") == F.col("_table")), "left")
        names.append(F.col("_fresh"))
    changes = rows.select(
        "seq", "part", F.col("position").alias("lsn"), "timestamp_us", F.col("map.schema").alias("schema"), F.col("map.table").alias("table"),
        F.when(kind == "write", "I").when(kind == "update", "U").otherwise("D").alias("op"),
        F.when(new.isNotNull(), _named(new, *names)).alias("new"), F.when(old.isNotNull(), _named(old, *names)).alias("old"),
    )
    target = truncated_table(F.col("sql"), F.col("schema"))
    empty = F.lit(None).cast(changes.schema["new"].dataType)
    truncates = log.where(F.col("kind") == "query").withColumn("target", target).where("target is not null").select(
        "seq", F.lit(0).alias("part"), F.col("position").alias("lsn"), "timestamp_us", F.col("target.schema").alias("schema"),
        F.col("target.table").alias("table"), F.lit("T").alias("op"), empty.alias("new"), empty.alias("old"),
    )
    out = changes.unionByName(truncates)
    if tables is not None:
        out = out.where(F.concat_ws(".", "schema", "table").isin(*tables))
    if primary_keys is not None:
        out = out.join(primary_keys.select("schema", "table", "pk"), ["schema", "table"], "left")
        out = out.withColumn("pk", F.coalesce("pk", F.array().cast("array<string>")))
    return out


def commits(log: DataFrame) -> DataFrame:
    """(seq, offset): positions at which a batch may end; a truncate ends its own transaction."""
    target = truncated_table(F.col("sql"), F.col("schema"))
    ends = log.where((F.col("kind") == "xid") | ((F.col("kind") == "query") & target.isNotNull()))
    return ends.select("seq", F.concat("file", F.lit(":"), F.col("position").cast("string")).alias("offset"))

"""Initial snapshots: files, COPY text and JDBC tables as events with op S."""

from __future__ import annotations

import sqlite3
from contextlib import closing
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..envelope import cell, envelope, image, no_image
from ..functions.coerce import pg_cell
from ..functions.names import copy_fields
from ..operators.ordered import SPAN, positions
from ..scratch import ship

#: Fixed value: rows between two checkpoints of a snapshot.
CHECKPOINT_ROWS = 10_000


def snapshot(df: DataFrame, table: str, pk: list[str], tags: dict[str, str], *, seq: Column, lsn: Column | None = None, schema: str = "public", timestamp_us: Column | None = None) -> DataFrame:
    """Every row of ``df`` as a snapshot event; ``tags`` gives the type tag of each column."""
    cells = {c: cell(F.col(c), tag) for c, tag in tags.items()}
    zero = F.lit(0)
    return envelope(df, table, pk, F.lit("S"), image(cells), no_image(), schema=schema, seq=seq, lsn=zero if lsn is None else lsn, timestamp_us=zero if timestamp_us is None else timestamp_us, xid=zero)


def checkpoints(events: DataFrame, rows: int = CHECKPOINT_ROWS) -> DataFrame:
    """(schema, table, seq, rows, complete): the points of a snapshot at which its progress may be saved.

    One after each ``rows`` events of a table, in order, and one at its end; only
    that one is complete, and only it lets a restart pass over the table.
    """
    placed = events.withColumn("_n", F.row_number().over(Window.partitionBy("schema", "table", F.floor(F.col("seq") / SPAN)).orderBy("seq")))
    spans = events.groupBy("schema", "table", F.floor(F.col("seq") / SPAN).alias("_span")).agg(F.count("*").alias("_size"), F.max("seq").alias("_end"))
    earlier = Window.partitionBy("schema", "table").orderBy("_span")
    spans = spans.withColumn("_before", F.coalesce(F.sum("_size").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    spans = spans.withColumn("_last", F.lead("_span").over(earlier).isNull())
    placed = placed.withColumn("_span", F.floor(F.col("seq") / SPAN)).join(spans, ["schema", "table", "_span"])
    done = F.col("_before") + F.col("_n")
    partial = placed.where(done % rows == 0).select("schema", "table", "seq", done.alias("rows"), F.lit(False).alias("complete"))
    ends = spans.where("_last").select("schema", "table", F.col("_end").alias("seq"), (F.col("_before") + F.col("_size")).alias("rows"), F.lit(True).alias("complete"))
    return partial.unionByName(ends)


def copy_events(lines: DataFrame, table: str, columns: list[tuple[str, int]], pk: list[str], *, line: str = "value", seq: str = "seq", lsn: int = 0, schema: str = "public") -> DataFrame:
    """Events of COPY text lines; ``columns`` are names with their type oids."""
    fields = copy_fields(F.col(line))
    cells = {name: pg_cell(F.get(fields, i), F.lit(oid)) for i, (name, oid) in enumerate(columns)}
    return envelope(lines, table, pk, F.lit("S"), image(cells), no_image(), schema=schema, seq=F.col(seq), lsn=F.lit(lsn))


def read_copy(spark: SparkSession, path: str) -> DataFrame:
    """(seq, value) of the lines of COPY text files; a line's order is its place in the scan."""
    lines = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id())
    return positions(lines, "_at", "seq", 1 << 33).drop("_at")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A database table, read in parts of its key under one repeatable snapshot per part."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, isolationLevel="REPEATABLE_READ", **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def read_sqlite(spark: SparkSession, file: str, table: str, schema: T.StructType, key: str, bounds: tuple[int, int], parts: int = 8, block: int = 10_000) -> DataFrame:
    """A table of a SQLite database in a file that all machines share, read in parts of its key, one read transaction each.

    As with ``read_jdbc``, ``bounds`` only say where the parts are cut: the first has
    what is below them too, and rows without a key, and the last what is above.
    """
    ship(spark)
    low, high = bounds
    cuts = [low + (high - low) * i // parts for i in range(1, parts)]
    kinds, names = to_arrow_schema(schema), ", ".join(f'"{f.name}"' for f in schema)

    def read(batches):
        with closing(sqlite3.connect(f"file:{quote(file)}?mode=ro", uri=True)) as db:
            for i in (i for batch in batches for i in batch.column(0).to_pylist()):
                below = f'("{key}" < {cuts[i]}' + (")" if i else f' OR "{key}" IS NULL)') if i < len(cuts) else "1 = 1"
                above = f'"{key}" >= {cuts[i - 1]}' if i else "1 = 1"
                found = db.execute(f'SELECT {names} FROM "{table}" WHERE {above} AND {below}')
                while rows := found.fetchmany(block):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    return spark.range(parts, numPartitions=parts).mapInArrow(read, schema)


def primary_keys(attributes: DataFrame, classes: DataFrame, namespaces: DataFrame, indexes: DataFrame) -> DataFrame:
    """(schema, table, oid, pk) from PostgreSQL's catalogs."""
    keys = indexes.where("indisprimary").select(F.col("indrelid").alias("oid"), F.posexplode("indkey").alias("place", "attnum"))
    named = keys.join(attributes.select(F.col("attrelid").alias("oid"), "attnum", "attname"), ["oid", "attnum"])
    lists = named.groupBy("oid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "attname"))), lambda x: x["attname"]).alias("pk"))
    tables = classes.select("oid", F.col("relname").alias("table"), "relnamespace")
    spaces = namespaces.select(F.col("oid").alias("relnamespace"), F.col("nspname").alias("schema"))
    return lists.join(tables, "oid").join(spaces, "relnamespace").select("schema", "table", "oid", "pk")

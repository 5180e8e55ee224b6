"""Exact deduplication that takes frequent digests out before the shuffle.

Texts are equal when they are identical after each run of white space is
replaced by one space; they are compared by the SHA-256 of the normalised
UTF-8.  Three steps:

1. every partition summarises its digests with Misra-Gries counters, the
   summaries are added up, and at most ``counters + 1`` digests pass as
   candidates (a digest on more than ``2 n / (counters + 1)`` of ``n`` rows
   always does);
2. candidates are counted exactly, which verifies them and finds their winner;
   this table, bounded by ``counters + 1`` rows, is broadcast, so rows of heavy
   digests are settled map-side and never meet in one task;
3. all other digests, each on a small share of the rows, are shuffled as usual:
   counts and winners are aggregated map-side, and those of digests on several
   rows are joined back, a join whose hot keys Spark splits.

Defined results: a null text counts as empty; an empty text is a text like any
other; a null id sorts after every other id; of rows with equal text and equal
id exactly one stays; an empty table gives an empty result; other columns,
whatever their names, are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Scratch, free_name, quoted, ship, whole_text

COUNTERS = 1024


def text_digest(text_col: str):
    """SHA-256 of the normalised text, as 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(whole_text(text_col), SPACE, " "), 256))


def misra_gries(counters: int):
    """A partition's digests reduced to at most ``counters`` lower bounds of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        counts: dict[bytes, int] = {}
        for batch in batches:
            seen = pc.value_counts(batch.column(0))
            for digest, n in zip(seen.field(0).to_pylist(), seen.field(1).to_pylist(), strict=True):
                counts[digest] = counts.get(digest, 0) + n
            if len(counts) > counters:
                cut = -int(np.partition(-np.fromiter(counts.values(), np.int64, len(counts)), counters)[counters])
                counts = {d: n - cut for d, n in counts.items() if n > cut}
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["digest", "bound"]
        )

    return run


def heavy_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Candidates for frequent values of the one column ``digest``: at most ``counters + 1`` rows."""
    rows = digests.count()
    return (
        digests.select("digest")
        .mapInArrow(misra_gries(counters), "digest binary, bound long")
        .groupBy("digest")
        .agg(F.sum("bound").alias("bound"))
        .where((F.col("bound") * (counters + 1) >= F.lit(rows)) & (F.col("bound") > 0))
        .select("digest")
    )


def _first():
    """The row that stays: the smallest id, null after all others."""
    return F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")


def _settled(spark, df: DataFrame, id_col: str, text_col: str, counters: int):
    """(scratch, keys of all rows, exact winners of the heavy digests), both tables written."""
    ship(spark)
    scratch = Scratch(spark, "exact")
    keys = scratch.keep(
        df.select(
            F.monotonically_increasing_id().alias("row"), F.col(quoted(id_col)).alias("id"), text_digest(text_col).alias("digest")
        ),
        "keys",
    )
    heavy = scratch.keep(
        keys.join(F.broadcast(heavy_digests(keys, counters)), "digest")
        .groupBy("digest")
        .agg(F.count("*").alias("n"), _first())
        .where("n > 1"),
        "heavy",
    )
    return scratch, keys, heavy


def exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row for each row of ``df``: id_col, keep_id, group_size, kept, text_sha256."""
    scratch, keys, heavy = _settled(df.sparkSession, df, id_col, text_col, counters)
    marked = keys.join(F.broadcast(heavy), "digest", "left")
    rest = marked.where(F.col("n").isNull()).drop("n", "first")
    several = scratch.keep(rest.groupBy("digest").agg(F.count("*").alias("n"), _first()).where("n > 1"), "several")
    rows = marked.where(F.col("n").isNotNull()).unionByName(rest.join(several, "digest", "left"))
    alone = F.col("n").isNull()
    return rows.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("first.row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns.

    Rows of heavy digests other than the winner go before the shuffle; what is
    left has few rows for each digest.
    """
    _, _, heavy = _settled(df.sparkSession, df, id_col, text_col, counters)
    digest, winner, rank = (free_name(df, x) for x in ("_digest", "_winner", "_rank"))
    heavy = heavy.select(F.col("digest").alias(digest), F.struct(F.col("first.id").alias("id")).alias(winner))
    rows = df.withColumn(digest, text_digest(text_col)).join(F.broadcast(heavy), digest, "left")
    rows = rows.where(F.col(winner).isNull() | F.col(winner)["id"].eqNullSafe(F.col(quoted(id_col))))
    order = Window.partitionBy(digest).orderBy(F.col(quoted(id_col)).asc_nulls_last())
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).select(*[quoted(c) for c in df.columns])

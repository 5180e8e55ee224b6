"""Token ids in ORC files, in order of document id.

Documents are range-partitioned by id (splitters sampled by Spark) and sorted
inside each partition; each task writes one ORC file.  ORC stores the ids with
integer run-length encoding in stripes, with row indexes every ``stride`` rows
and Bloom filters on the document id, so that

* readers split a file at its stripes and run on them in parallel;
* a lookup by document id skips files, stripes and row groups by their minimum,
  maximum and Bloom filter (``find``).

A row holds its file's number, the ids before it in the file and its own ids;
the start in the whole corpus is that offset plus the totals of earlier files,
one number for each file, which stand in the folder ``_totals`` of the store, so
a lookup reads no more than the rows it asks for.

Defined results: a null text counts as empty; an empty document is its end token
alone; null ids come last; rows with equal id stand in order of their text; an
empty table gives an empty store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import quoted, ship, whole_text
from .tokens import default_vocabulary

END = 0
#: Hidden from readers of the store, as its name begins with an underscore.
TOTALS = "_totals"
STRIPE_BYTES = 16 << 20
STRIDE = 1000


def _encoded(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        from .tokens import encoder, sliced

        encode, end = encoder(vocabulary).batch, END.to_bytes(4, "little")
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in sliced(batch):
                ids = [x + end for x in encode(rows.column(1).to_pylist())]
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                ends = np.cumsum(sizes)
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                del ids
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        pa.array(np.full(len(sizes), part, np.int32)),
                        pa.array(before + ends - sizes),
                        pa.array(sizes),
                        pa.ListArray.from_arrays(offsets, values),
                    ],
                    ["doc_id", "file", "offset", "n_tokens", "ids"],
                )
                before += int(ends[-1]) if len(ends) else 0

    return run


def write_tokens(
    df: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    stripe_bytes: int = STRIPE_BYTES,
    stride: int = STRIDE,
    partitions: int | None = None,
) -> None:
    """Write the ids of all documents to ``path``."""
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(quoted(id_col)).alias("doc_id"), whole_text(text_col).alias("text"))
    order = F.col("doc_id").asc_nulls_last()
    rows = rows.repartitionByRange(*([partitions] if partitions else []), order).sortWithinPartitions(order, "text")
    schema = f"doc_id {kind}, file int, offset long, n_tokens long, ids array<int>"
    (
        rows.mapInArrow(_encoded(vocabulary or default_vocabulary()), schema)
        .write.mode("overwrite")
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.row.index.stride", stride)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", 0.01)
        .orc(path)
    )
    sums = df.sparkSession.read.orc(path).groupBy("file").agg(F.sum("n_tokens").alias("n"))
    sums.coalesce(1).write.mode("overwrite").orc(f"{path}/{TOTALS}")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of a store."""
    rows = spark.read.orc(path)
    totals = spark.read.schema("file int, n long").orc(f"{path}/{TOTALS}")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # one row for each file, whatever the files hold
    return rows.join(F.broadcast(bases), "file").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids")


def find(spark: SparkSession, path: str, ids: list) -> DataFrame:
    """The rows of some documents, with stripes pruned by their metadata."""
    return read_tokens(spark, path).where(F.col("doc_id").isin(ids))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zlib

    import numpy as np

    for batch in batches:
        ids = batch.column(3)
        values = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        cuts = ids.offsets.to_numpy()
        sums = [zlib.crc32(values[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(np.array(sums, np.int64))],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def checksums(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the rows of ``read_tokens``."""
    kind = stored.schema["doc_id"].dataType.simpleString()
    rows = stored.select("doc_id", "start", "n_tokens", "ids")
    return rows.mapInArrow(_summed, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")

"""Best-fit packing of token pieces under three capacities.

Documents become pieces of at most ``tokens`` tokens (only longer documents are
cut; their first piece takes the remainder).  A sequence has capacities for
tokens, documents and attention cost (the sum of squared piece lengths), and a
piece demands (length, 1, length**2) of them.  Pieces are placed longest first;
among the open sequences that can take a piece under every constraint, the one
with the least weighted residual norm after placement wins (``rule="norm"``), or
the one with the greatest weighted dot product of demand and residual
(``rule="dot"``).  Ties go to the sequence opened first.

The capacity for documents is ``DOCUMENTS`` by default, or four times the pieces
that a sequence holds on average where that is more: it binds where short pieces
would crowd in one sequence, and adds no sequences.  The capacity for attention
cost defaults to that of one full piece, the least that takes every piece.

Pieces are dealt by a hash of their row to shards of about ``shard_rows``
pieces, which are packed apart; a shard bounds a task's memory and leaves a few
sequences partly filled, so the waste is a fixed small share of the corpus at any
size.  Nothing depends on the order of arrival, so a task that runs again gives
the same sequences.

Defined results: a null text counts as empty; an empty document is its end token
alone; repeated rows are packed as documents of their own; a null id is carried
along; a piece over a capacity on its own raises ValueError; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name, quoted, ship, whole_text
from .tokens import default_vocabulary

TOKENS = 2048
DOCUMENTS = 64
SHARD_ROWS = 8192
END = 0
WEIGHTS = (1.0, 0.05, 0.05)


def pieces_of(length: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first one may be shorter."""
    first = length % most or most
    cuts = [0, *range(first, length + 1, most)] if length > most else [0, length]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _cut(vocabulary: str, most: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        from .tokens import encoder, sliced

        encode, end = encoder(vocabulary).batch, END.to_bytes(4, "little")
        for batch in batches:
            for part in sliced(batch):
                rows, pieces, starts, lengths, sums, ids = [], [], [], [], [], []
                for row, all_ids in enumerate(encode(part.column(1).to_pylist())):
                    all_ids += end
                    for piece, (start, length) in enumerate(pieces_of(len(all_ids) // 4, most)):
                        own = all_ids[4 * start : 4 * (start + length)]
                        rows.append(row)
                        pieces.append(piece)
                        starts.append(start)
                        lengths.append(length)
                        sums.append(zlib.crc32(own))
                        ids.append(own if with_ids else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(rows, pa.int64())),
                        pa.array(pieces, pa.int32()),
                        pa.array(starts, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(sums, pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    ["id", "piece", "start", "length", "ids_crc32", "ids"],
                )

    return run


def token_pieces(
    df: DataFrame, id_col: str, text_col: str, vocabulary: str | None = None, tokens: int = TOKENS, with_ids: bool = False
) -> DataFrame:
    """id, piece, start, length, ids_crc32, ids (little-endian, null unless asked for) of all documents."""
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(quoted(id_col)).alias("id"), whole_text(text_col).alias("text"))
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, ids binary"
    return rows.mapInArrow(_cut(vocabulary or default_vocabulary(), tokens, with_ids), schema)


def best_fit(lengths, tokens: int, documents: int, attention: int, rule: str = "norm", weights=WEIGHTS):
    """(bin, offset) for each of ``lengths`` (positive, sorted in descending order)."""
    import numpy as np

    lengths = np.asarray(lengths, np.int64)
    if len(lengths) and (lengths[0] > tokens or lengths[0] ** 2 > attention or documents < 1):
        raise ValueError(f"a piece of {lengths[0]} tokens exceeds a capacity")
    capacity = np.array([tokens, documents, attention], np.int64)
    weight = np.asarray(weights, float) / capacity.astype(float) ** 2  # squares: residuals are shares of their capacity
    left = np.empty((len(lengths), 3), np.int64)  # residuals of the open sequences
    names = np.empty(len(lengths), np.int64)
    used, made = 0, 0
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    least = lengths[-1] if len(lengths) else 0
    for i, n in enumerate(lengths.tolist()):
        demand = np.array([n, 1, n * n], np.int64)
        open_ = left[:used]
        fits = np.flatnonzero((open_[:, 0] >= n) & (open_[:, 1] >= 1) & (open_[:, 2] >= n * n))
        if len(fits):
            rest = open_[fits]
            if rule == "norm":
                at = fits[int(np.argmin(((rest - demand) ** 2 * weight).sum(axis=1)))]
            else:
                at = fits[int(np.argmax((rest * demand * weight).sum(axis=1)))]
        else:
            at, left[used], names[used] = used, capacity, made
            used, made = used + 1, made + 1
        bins[i], offsets[i] = names[at], tokens - left[at, 0]
        left[at] -= demand
        if left[at, 0] < least or left[at, 1] < 1 or left[at, 2] < least * least:  # no piece to come fits
            left[at : used - 1] = left[at + 1 : used].copy()
            names[at : used - 1] = names[at + 1 : used].copy()
            used -= 1
    return bins, offsets


def packed(
    pieces: DataFrame,
    tokens: int = TOKENS,
    documents: int | None = None,
    attention: int | None = None,
    rule: str = "norm",
    weights=WEIGHTS,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``pieces`` (with a column ``length``, and none named sequence_id or offset) with sequence_id and offset."""
    if clash := {"sequence_id", "offset"} & {c.lower() for c in pieces.columns}:
        raise ValueError(f"columns that packing adds are there already: {sorted(clash)}")
    spark = pieces.sparkSession
    scratch = Scratch(spark, "packing")
    tag = free_name(pieces, "tag")
    tagged = scratch.keep(pieces.withColumn(tag, F.monotonically_increasing_id()), "pieces")
    rows, total = tagged.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    shards = max(1, -(-rows // shard_rows))
    crowd = max(DOCUMENTS, 4 * -(-rows // max(1, -(-total // tokens))))
    limits = (tokens, documents or crowd, attention or tokens * tokens)

    def pack(rows):
        rows = rows.sort_values(["length", "tag"], ascending=[False, True], ignore_index=True)
        bins, offsets = best_fit(rows["length"].to_numpy(), *limits, rule, weights)
        return rows.assign(sequence_id=(rows["shard"].to_numpy() << 32) + bins, offset=offsets)[["tag", "sequence_id", "offset"]]

    own = F.col(quoted(tag)).alias("tag")
    shard = F.pmod(F.xxhash64(own), F.lit(shards)).alias("shard")
    placed = tagged.select(own, "length", shard).groupBy("shard").applyInPandas(pack, "tag long, sequence_id long, offset long")
    return tagged.join(placed.withColumnRenamed("tag", tag), tag).select(*map(quoted, pieces.columns), "sequence_id", "offset")


def sequences(placed: DataFrame) -> DataFrame:
    """Token sequences of ``packed`` pieces that carry ids: sequence_id, length, ids (little-endian).

    A sequence holds at most the token capacity, so its pieces are few.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    rows = placed.groupBy("sequence_id").agg(parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda all_, x: F.concat(all_, x["ids"]))
    size = F.aggregate("parts", F.lit(0).cast("long"), lambda n, x: n + x["length"])
    return rows.select("sequence_id", size.alias("length"), joined.alias("ids"))

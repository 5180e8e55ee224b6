"""Pipelines: a stream of changes into a sink, batch by batch.

Spark's checkpoint holds the offsets; a batch is written, and only then is its
offset committed, so a restart repeats the last batch at most.  Sinks here
recognise a repeated batch by (query, batch id).  An offset store may follow: it
gets the position of each batch once that is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..envelope import META, OLD, UPSERTS
from ..operators import evolve, merge
from ..operators.flatten import flatten, project
from ..sinks.lake import LakeTable
from ..sources import pgoutput
from .metrics import Metrics

#: Batches of a folded state after which it is compacted.
COMPACT_EVERY = 16

Sink = Callable[[DataFrame, int], None]


def run(stream: DataFrame, checkpoint: str, sink: Sink, metrics: Metrics | None = None, available: bool = True, offsets=None, position: Column | None = None):
    """Start a query; ``available`` drains what is there and ends, else it runs on.

    ``offsets`` (a store with ``load`` and ``save``) gets the greatest ``position``
    so far of the batches written, as a string.
    """

    def write(batch: DataFrame, number: int) -> None:
        try:
            sink(batch, number)
            if offsets is not None:
                last = batch.agg(F.max(position).cast("string")).first()[0]
                if last is not None and (offsets.load() is None or int(offsets.load()) < int(last)):
                    offsets.save(last)
        except Exception:
            if metrics:
                metrics.error()
            raise

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    query = (writer.trigger(availableNow=True) if available else writer.trigger(processingTime="1 second")).start()
    if available:
        query.awaitTermination()
    return query


def counted(sink: Sink, metrics: Metrics | None) -> Sink:
    """``sink``, whose events are counted while it reads them, not by another pass."""
    if metrics is None:
        return sink

    def write(batch: DataFrame, number: int) -> None:
        seen = Observation()
        sink(batch.observe(seen, F.count(F.lit(1)).alias("n")), number)
        metrics.batch(seen.get["n"])

    return write


def append_sink(table: LakeTable, name: str, metrics: Metrics | None = None) -> Sink:
    """Append-only log: each batch is one version, committed once."""

    def write(batch: DataFrame, number: int) -> None:
        before = table.state()["version"]
        done = table.append(batch, f"{name}:{number}")
        if metrics and done["version"] > before:
            metrics.batch(done["summary"]["added-records"])

    return write


def fold_sink(table: LakeTable, name: str, key: list[str], values: list[str], metrics: Metrics | None = None, seq: str = "seq", carried: list[str] = (), unchanged: str | None = None, compact_every: int = COMPACT_EVERY) -> Sink:
    """Replicated state that does not depend on the order in which batches arrive.

    A batch is folded to one row for each key and appended, so it costs what it
    holds, not what the table holds.  ``state`` merges these parts as it reads;
    after ``compact_every`` of them they are replaced by their merge, in which
    deletes stay as rows, since older batches may still come.  ``unchanged`` names
    an array column with those of the ``carried`` columns that a change leaves as
    they are; their last values are carried across batches.
    """
    tidy = list(carried)

    def write(batch: DataFrame, number: int) -> None:
        if table.seen(f"{name}:{number}"):
            return
        done = counted(lambda b, n: table.append(merge.part(b, key, values, tidy, unchanged, seq), f"{name}:{n}"), metrics)
        done(batch, number)
        if len(table.state()["data"]) >= compact_every:
            table.compact(merge.merged(table.read(), key, values, tidy))

    return write


def state(table: LakeTable, key: list[str], values: list[str], carried: list[str] = ()) -> DataFrame:
    """The current rows of a table that ``fold_sink`` keeps."""
    return merge.current(table.read(), key, values, list(carried))


# tables that evolve with their log

Types = Callable[[list[str]], dict[str, str]]


def _grown(table: LakeTable, schema: T.StructType) -> None:
    """Commit an evolved schema, before any row of it is written."""
    if schema != table.schema():
        table.evolve(schema, table.state()["version"])


def _first_seen(log: DataFrame, known: list[str]) -> list[str]:
    """Names that a batch adds; a handful at most, as each becomes a column."""
    return [r["column"] for r in evolve.new_columns(log, known).orderBy("first_seq", "column").collect()]


def evolving_append_sink(table: LakeTable, name: str, types: Types, metrics: Metrics | None = None) -> Sink:
    """A flattened log whose table gets a pair of columns for each new column of its events.

    Batches are in the envelope's layout.  ``types`` gives the canonical types of
    columns that the source knows; others are Text.  Columns are never dropped.
    """

    def write(batch: DataFrame, number: int) -> None:
        if table.seen(f"{name}:{number}"):
            return
        known = {f.name: f.metadata.get("canonical", "Text") for f in table.schema() if f.name not in META and not f.name.startswith(OLD)}
        added = _first_seen(batch, list(known))
        found = types(added) if added else {}
        more = {c: found.get(c, "Text") for c in added}
        if not table.versions():
            table.create(evolve.flattened_schema(more))
        elif more:
            _grown(table, evolve.add_columns(table.schema(), more, flattened=True))
        names = {f.name: f for f in table.schema()}
        rows = flatten(batch, known | more).select(*[f"`{n}`" for n in names])
        before = table.state()["version"]
        done = table.append(rows, f"{name}:{number}")
        if metrics and done["version"] > before:
            metrics.batch(done["summary"]["added-records"])

    return write


def evolving_fold_sink(table: LakeTable, name: str, key: list[str], types: Types, live: Callable[[], list[str]] | None = None, metrics: Metrics | None = None, compact_every: int = COMPACT_EVERY) -> Sink:
    """Replicated state whose columns follow its events.

    New columns of events are added first.  A column that no full row of a batch
    carries is dropped if the live source (``live``) lacks it too.  Then the batch
    is folded and appended; ``evolved_state`` reads the result.
    """

    def write(batch: DataFrame, number: int) -> None:
        if table.seen(f"{name}:{number}"):
            return
        own = [f for f in table.schema() if f.name not in ("seq", "op", "died")]
        known = {f.name: f.metadata.get("canonical", "Text") for f in own}
        added = _first_seen(batch, list(known))
        found = types(added) if added else {}
        columns = known | {c: found.get(c, "Text") for c in added}
        if live is not None and known:
            frame = batch.sparkSession.createDataFrame([(c,) for c in known if c not in key] or [("",)], "column string")
            doubtful = [r["column"] for r in evolve.drop_candidates(batch, frame).collect()]
            gone = set(evolve.dropped_columns(doubtful, live())) if doubtful else set()
            columns = {c: k for c, k in columns.items() if c not in gone}
        head = [T.StructField("seq", T.LongType()), T.StructField("op", T.StringType())]
        schema = T.StructType([*head, *[evolve.field_of(c, k, i + 1) for i, (c, k) in enumerate(columns.items())], T.StructField("died", T.LongType())])
        if not table.versions():
            table.create(schema)
        else:
            _grown(table, schema)
        image = F.when(F.col("op").isin(*UPSERTS), F.col("new")).otherwise(F.col("old"))
        rows = project(batch.withColumn("new", image), columns)
        done = counted(lambda b, n: table.append(merge.part(b, key, [c for c in columns if c not in key]), f"{name}:{n}"), metrics)
        done(rows, number)
        if len(table.state()["data"]) >= compact_every:
            values = [c for c in columns if c not in key]
            table.compact(merge.merged(table.read(), key, values))

    return write


def evolved_state(table: LakeTable, key: list[str]) -> DataFrame:
    """The current rows of a table that ``evolving_fold_sink`` keeps, with its current columns."""
    values = [f.name for f in table.schema() if f.name not in ("seq", "op", "died", *key)]
    return merge.current(table.read(), key, values)


# decoded messages of a replication stream


def resolving(sink: Sink, context: LakeTable, name: str, primary_keys: DataFrame | None = None) -> Sink:
    """A sink of decoded messages (``pgoutput.messages``) that gives ``sink`` the events of each batch.

    A change may need what an earlier batch said: the definition of its relation and
    the beginning of its transaction.  ``context`` keeps the last of each, which is
    as many rows as there are relations, and one.  It is replaced after the sink
    has the batch, so a batch that is repeated resolves as it did before.
    """

    def write(batch: DataFrame, number: int) -> None:
        if context.seen(f"{name}:{number}"):
            return
        batch = batch.persist()  # events read it several times, and each would decode it again
        try:
            known = context.read().unionByName(batch) if context.versions() else batch
            sink(pgoutput.events(known, primary_keys), number)
            keep(known.where(F.col("kind").isin("R", "B", "C")), number)
        finally:
            batch.unpersist()

    def keep(lasting: DataFrame, number: int) -> None:
        about = F.when(F.col("kind") == "R", F.col("rel_id"))  # null: the one transaction that is open or was last
        last = lasting.groupBy(about.alias("_about")).agg(F.max_by(F.struct(*[f"`{c}`" for c in lasting.columns]), "seq").alias("_last"))
        context.overwrite(last.select("_last.*"), f"{name}:{number}")

    return write


# a snapshot first, then the stream


def replicate(snapshot: Callable[[], tuple[DataFrame, str]], stream: Callable[[str], DataFrame], offsets, checkpoint: str, sink: Sink, position: Column, metrics: Metrics | None = None, available: bool = True, ordered: bool = False):
    """A snapshot unless one was completed, then the stream from its position on.

    ``snapshot()`` gives the snapshot's events and the position at which it was
    taken; that is saved only after all its events are written, so a snapshot that
    breaks off is made again (as batch -1, which a sink takes once).  ``stream``
    gives the events after a position.  With ``ordered``, as from a server, the
    saved position follows each batch; files that may come late need the
    snapshot's, and Spark's checkpoint to know them.
    """
    at = offsets.load()
    if at is None:
        events, at = snapshot()
        sink(events, -1)
        offsets.save(at)
    return run(stream(at), checkpoint, sink, metrics, available, offsets if ordered else None, position)

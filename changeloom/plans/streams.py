"""Queries: streams into lake tables and databases, resumes, recorded replication."""

from __future__ import annotations

import os
import sqlite3
from urllib.parse import unquote, urlparse

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..envelope import META, OLD
from ..functions.coerce import typed
from ..operators.flatten import flatten
from ..scratch import folder, one_process
from ..sinks.lake import LakeTable
from ..sinks.out import DatabaseTarget, database_sink, sqlite_stage, write_database
from ..sources import frames, pgoutput, snapshot
from ..sources.log import ChangeLogSource
from ..streaming import runner
from ..streaming.metrics import Metrics
from ..streaming.offsets import MemoryOffsets, SqliteOffsets
from .base import COLUMNS, change_events, change_log, query, rows, table
from .logs import _raw


def _local(uri: str) -> str:
    """The path of a folder that this process can open; the folder is there then."""
    path = unquote(urlparse(uri).path)
    os.makedirs(path, exist_ok=True)
    return path


def _stream_of(spark, log, parts):
    """A log in ``parts`` files as a stream of one file a batch."""
    path = folder(spark, "stream")
    log.repartitionByRange(parts, "seq").write.parquet(f"{path}/log")
    return path, spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/log")


def _files(spark, sf, parts=4):
    return _stream_of(spark, change_log(spark, sf).select("seq", "op", "user_id", "event_type", "value"), parts)


@query("""LOG , b as (select *, coalesce(max(case when op = 'T' then seq end) over (), -1) as barrier from cl),
r as (select *, row_number() over (partition by user_id order by seq desc) as rn from b where seq > barrier and op <> 'T') select user_id, event_type, value from r where rn = 1 and op <> 'D'""")
def stream_fold_events(spark, sf):
    """The fold as a stream, restarted between batches; files may arrive in any order."""
    path, stream = _files(spark, sf)
    t = LakeTable(spark, f"{path}/state")
    sink = runner.fold_sink(t, "fold", ["user_id"], ["event_type", "value"])
    runner.run(stream, f"{path}/checkpoint", sink)
    runner.run(stream, f"{path}/checkpoint", sink)
    return runner.state(t, ["user_id"], ["event_type", "value"])


@query("LOG select seq, op, user_id, event_type, value from cl")
def stream_append_cdc(spark, sf):
    """The append-only log as a stream; a restart with an empty checkpoint adds nothing."""
    path, stream = _files(spark, sf)
    t = LakeTable(spark, f"{path}/table")
    runner.run(stream, f"{path}/one", runner.append_sink(t, "log"))
    runner.run(stream, f"{path}/two", runner.append_sink(t, "log"))
    return t.read()


@query("select count(*) as events_total, 4 as batches_total, 0 as errors_total, 2.0 as events_per_sec_x from events".replace("2.0 as events_per_sec_x", "count(*) / 10.0 as events_per_sec"))
def m01_metrics(spark, sf):
    path, stream = _files(spark, sf)
    clock = iter([0.0] + [10.0] * 100)
    m = Metrics(lambda: next(clock))
    runner.run(stream, f"{path}/checkpoint", runner.append_sink(LakeTable(spark, f"{path}/table"), "m", m), m)
    s = m.snapshot()
    return rows(spark, "events_total long, batches_total int, errors_total int, events_per_sec double", (s.events_total, s.batches_total, s.errors_total, s.events_per_sec))


@query("LOG select 'batch' as read, op, count(*) as n, sum(user_id)::bigint as users, sum(round(value * 100))::bigint as cents from cl group by op union all select 'stream', op, count(*), sum(user_id)::bigint, sum(round(value * 100))::bigint from cl group by op")
def s01_change_log_files(spark, sf):
    """A change log in NDJSON files, read by its data source as a table and as a stream that is restarted."""
    top = folder(spark, "changelog")
    fields = "seq long, op string, user_id long, value double"
    change_log(spark, sf).select("seq", "op", "user_id", "value", "event_type").repartitionByRange(4, "seq").write.json(f"{top}/in")
    spark.dataSource.register(ChangeLogSource)
    read = spark.read.format("changelog").option("fields", fields).load(f"{top}/in")
    stream = spark.readStream.format("changelog").option("fields", fields).load(f"{top}/in")
    t = LakeTable(spark, f"{top}/table")
    for _ in range(2):
        runner.run(stream, f"{top}/checkpoint", runner.append_sink(t, "q"))
    both = read.withColumn("read", F.lit("batch")).unionByName(t.read().withColumn("read", F.lit("stream")))
    cents = F.round(F.col("value") * 100).cast("long")
    return both.groupBy("read", "op").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"), F.sum(cents).alias("cents"))


_STATE = """LOG , b as (select *, coalesce(max(case when op = 'T' then seq end) over (), -1) as barrier from cl),
r as (select *, row_number() over (partition by user_id order by seq desc) as rn from b where seq > barrier and op <> 'T') select user_id, event_type, value from r where rn = 1 and op <> 'D'"""


@query("""LOG , d as (select user_id, max(case when op = 'D' then seq end) as died from cl group by 1),
a as (select cl.*, coalesce(died, -1) as died from cl join d using (user_id) where seq > coalesce(died, -1) and op <> 'T' and seq > coalesce((select max(seq) from cl where op = 'T'), -1)),
r as (select *, row_number() over (partition by user_id order by seq desc) as rn,
 row_number() over (partition by user_id, event_type = 'view' order by seq desc) as rv from a)
select user_id, max(case when rn = 1 then event_type end) as kind, max(case when event_type <> 'view' and rv = 1 then seq end) as body from r group by user_id""")
def stream_toast_carry(spark, sf):
    """Large values that a change leaves unchanged are carried from batch to batch, through compactions too."""
    left = F.when(F.col("event_type") == "view", F.array(F.lit("body"))).otherwise(F.array().cast("array<string>"))
    log = change_log(spark, sf).select("seq", "op", "user_id", F.col("event_type").alias("kind"), F.when(F.col("event_type") != "view", F.col("seq")).alias("body"), left.alias("unchanged"))
    path, stream = _stream_of(spark, log, 8)
    t = LakeTable(spark, f"{path}/state")
    runner.run(stream, f"{path}/checkpoint", runner.fold_sink(t, "q", ["user_id"], ["kind", "body"], carried=["body"], unchanged="unchanged", compact_every=3))
    return runner.state(t, ["user_id"], ["kind", "body"], ["body"])


_LATE = "case when op in ('I', 'U') and seq >= (select count(*) // 2 from events) then value end as value"


@query(f"""LOG select op as _cdc_op, xid * 256 as _cdc_lsn, epoch_us(ts) as _cdc_timestamp_us, false as _cdc_snapshot, 'public' as _cdc_schema, 'events' as _cdc_table, '["user_id"]' as _cdc_primary_key_columns,
case when op in ('I', 'U') then user_id end as user_id, case when op in ('I', 'U') then event_type end as event_type, {_LATE},
case when op in ('U', 'D') then user_id end as _old_user_id, cast(null as varchar) as _old_event_type, cast(null as double) as _old_value from cl""")
def e14_stream_evolution(spark, sf):
    """A flattened log whose events get a column in the middle: its table gets it before the batch is written."""
    path, stream = _stream_of(spark, _grown_log(spark, sf), 4)
    t = LakeTable(spark, f"{path}/table")
    runner.run(stream, f"{path}/checkpoint", runner.evolving_append_sink(t, "q", lambda c: {n: COLUMNS[n] for n in c}))
    return t.read()


@query(f"""LOG , b as (select *, coalesce(max(case when op = 'T' then seq end) over (), -1) as barrier from cl),
r as (select *, row_number() over (partition by user_id order by seq desc) as rn from b where seq > barrier and op <> 'T') select user_id, event_type, {_LATE} from r where rn = 1 and op <> 'D'""")
def e14_replication_evolution(spark, sf):
    """Replicated state that follows its events: one column comes, another goes from the source and then from the table."""
    log = _grown_log(spark, sf)
    half = table(spark, sf, "events").count() // 2
    gone = F.map_from_arrays(F.array(F.lit("gone")), F.array(F.struct(F.lit("Text").alias("type"), F.lit("x").alias("value"))))
    log = log.withColumn("new", F.when(F.col("new").isNotNull() & (F.col("seq") < half), F.map_concat("new", gone)).otherwise(F.col("new")))
    path, stream = _stream_of(spark, log.where(F.col("seq") < half), 2)
    t = LakeTable(spark, f"{path}/table")
    sink = runner.evolving_fold_sink(t, "q", ["user_id"], lambda c: {n: COLUMNS[n] for n in c if n in COLUMNS}, live=lambda: list(COLUMNS), compact_every=3)
    runner.run(stream, f"{path}/checkpoint", sink)
    if "gone" not in t.schema().fieldNames():
        raise RuntimeError("a column is missing that full rows carry")
    log.where(F.col("seq") >= half).repartitionByRange(2, "seq").write.mode("append").parquet(f"{path}/log")
    runner.run(stream, f"{path}/checkpoint", sink)
    return runner.evolved_state(t, ["user_id"])


def _grown_log(spark, sf):
    log = change_events(spark, sf)
    half = table(spark, sf, "events").count() // 2
    late = F.map_filter("new", lambda k, v: (k != "value") | (F.col("seq") >= half))
    return log.withColumn("new", late).withColumn("old", F.map_filter("old", lambda k, v: k != "value"))


@query(_STATE)
def k05_database_state(spark, sf):
    """The fold applied to a table of a database, batch by batch in transactions, restarted in between (k04 to k08)."""
    path, stream = _files(spark, sf)
    file = _local(f"{path}/db") + "/state.db"
    target = DatabaseTarget(lambda: sqlite3.connect(file), stage=sqlite_stage(file, _local(f"{path}/parts")))
    sink = database_sink(target, "events", {"user_id": "BIGINT", "event_type": "TEXT", "value": "DOUBLE PRECISION"}, ["user_id"], "q")
    failed = []

    def once(batch, number):
        sink(batch, number)
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("after the transaction, before the checkpoint")

    ordered = stream.select("seq", "op", "user_id", "event_type", "value")
    try:
        runner.run(ordered, f"{path}/checkpoint", once)
    except Exception:
        if not failed:
            raise
    runner.run(ordered, f"{path}/checkpoint", once)
    with sqlite3.connect(file) as db:
        n, least, most = db.execute("SELECT count(*), min(user_id), max(user_id) FROM events").fetchone()
    shape = T.StructType.fromDDL("user_id long, event_type string, value double")
    return snapshot.read_sqlite(spark, file, "events", shape, "user_id", (least or 0, (most or 0) + 1), max(4, n // 250_000))


@query("""LOG select op as _cdc_op, count(*) as n, sum(xid * 256)::bigint as lsn, count(case when op in ('I', 'U') then value end) as n_value, count(case when op in ('U', 'D') then old_value end) as n_old from cl group by 1""")
def k04_database_log(spark, sf):
    """The flattened log appended to a table of a database; its columns are created with it and a repeated batch is not written."""
    flat = flatten(change_events(spark, sf), COLUMNS)
    top = _local(folder(spark, "db"))
    file = f"{top}/log.db"
    target = DatabaseTarget(lambda: sqlite3.connect(file), stage=sqlite_stage(file, top))
    kinds = {c: "TEXT" for c in flat.columns} | {META[1]: "BIGINT", META[2]: "BIGINT", "value": "DOUBLE", f"{OLD}value": "DOUBLE"}
    target.ensure("log", {c: k for c, k in kinds.items() if not c.endswith("value")})
    target.evolve("log", {c: k for c, k in kinds.items() if c.endswith("value")})
    for _ in range(2):
        target.append("log", flat, "q", 0)
    with sqlite3.connect(file) as db:
        found = db.execute("SELECT _cdc_op, count(*), sum(_cdc_lsn), count(value), count(_old_value) FROM log GROUP BY 1").fetchall()
    return rows(spark, "_cdc_op string, n long, lsn long, n_value long, n_old long", *found)


@query("""select 'S' as _cdc_op, o_orderkey, o_orderstatus, o_totalprice from orders""")
def s21_jdbc_snapshot(spark, sf):
    """Orders in a database, and their snapshot in parts of the key (k04, s21).

    Where Spark is one process, by the JDBC writer and reader: the database is Derby
    in Spark's own JVM, which comes with Spark.  On a cluster each JVM would have a
    Derby of its own, and Spark brings no server; there it is SQLite in a file that
    all machines share, which tasks load and tasks read.
    """
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    last = o.agg(F.max("o_orderkey")).first()[0]
    bounds = (0, 1 if last is None else last + 1)
    if one_process(spark):
        spark._jvm.java.lang.System.setProperty("derby.stream.error.file", os.devnull)
        url = f"jdbc:derby:memory:{os.path.basename(folder(spark, 'derby')).replace('-', '')};create=true"
        driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
        write_database(o, url, "orders", **driver)
        found = snapshot.read_jdbc(spark, url, "orders", "o_orderkey", bounds, 4, **driver)
    else:
        top = _local(folder(spark, "db"))
        file = f"{top}/orders.db"
        target = DatabaseTarget(lambda: sqlite3.connect(file), stage=sqlite_stage(file, top))
        target.ensure("orders", {"o_orderkey": "BIGINT", "o_orderstatus": "TEXT", "o_totalprice": "DOUBLE"})
        target.append("orders", o, "q", 0)
        target.index("orders", "o_orderkey")
        found = snapshot.read_sqlite(spark, file, "orders", o.schema, "o_orderkey", bounds, max(4, bounds[1] // 250_000))
    kinds = {"o_orderkey": "BigInt", "o_orderstatus": "Text", "o_totalprice": "Double"}
    events = snapshot.snapshot(found, "orders", ["o_orderkey"], {"o_orderkey": "Int", "o_orderstatus": "Text", "o_totalprice": "Float"}, seq=F.col("o_orderkey"))
    return flatten(events, kinds).select("_cdc_op", *kinds)


@query("""select 'sqlite' as store, cast(max(event_id) as varchar) as "offset" from events union all select 'memory', cast(max(event_id) as varchar) from events
union all select 'other key', null""")
def o01_offsets(spark, sf):
    """Offset stores behind a stream whose files come out of order (o01 to o03)."""
    path, stream = _files(spark, sf)
    file = _local(f"{path}/offsets") + "/o.db"
    memory = MemoryOffsets()
    for name, store in (("one", SqliteOffsets(file, "a")), ("two", memory.copy())):
        runner.run(stream, f"{path}/{name}", lambda b, n: None, offsets=store, position=F.col("seq"))
    return rows(spark, "store string, offset string", ("sqlite", SqliteOffsets(file, "a").load()), ("memory", memory.load()), ("other key", SqliteOffsets(file, "b").load()))


@query("""LOG , s as (select o_orderkey as key, o_orderstatus as status, -1 as seq, 'S' as op from orders),
c as (select user_id * 3 as key, event_type as status, seq, op from cl where op <> 'T' and seq >= 500),
r as (select *, row_number() over (partition by key order by seq desc) as rn from (select * from s union all select * from c))
select key, status from r where rn = 1 and op <> 'D'""")
def s07_snapshot_or_resume(spark, sf):
    """A snapshot, a stream from its position on, and restarts: the snapshot that broke off is made again, the complete one is not (s07, s12, s25)."""
    log = change_log(spark, sf).where("op <> 'T'").select("seq", "op", (F.col("user_id") * 3).alias("key"), F.col("event_type").alias("status"))
    path, stream = _stream_of(spark, log, 4)
    t = LakeTable(spark, f"{path}/state")
    store = SqliteOffsets(_local(f"{path}/offsets") + "/o.db", "job")
    sink = runner.fold_sink(t, "q", ["key"], ["status"])
    made = []

    def take():
        made.append(1)
        events = snapshot.snapshot(table(spark, sf, "orders"), "orders", ["o_orderkey"], {"o_orderkey": "Int", "o_orderstatus": "Text"}, seq=F.lit(-1))
        value = lambda c, kind: typed(F.col("new")[c], kind)
        return events.select("seq", "op", value("o_orderkey", "BigInt").alias("key"), value("o_orderstatus", "Text").alias("status")), "499"

    def breaks(batch, number):
        if len(made) == 1:
            raise RuntimeError("the snapshot broke off")
        sink(batch, number)

    after = lambda at: stream.where(F.col("seq") > int(at))
    for _ in range(3):
        try:
            runner.replicate(take, after, store, f"{path}/checkpoint", breaks, F.col("seq"))
        except RuntimeError:
            continue
    if len(made) != 2:
        raise RuntimeError(f"the snapshot was made {len(made)} times")
    return runner.state(t, ["key"], ["status"])


@query("""LOG , c as (select max(xid) * 256 + 8 as confirmed from cl where seq % 10 = 9)
select 'events' as "table", op, count(*) as n, sum(case when op in ('I', 'U') then user_id end)::bigint as users, sum(xid)::bigint as xids, (select confirmed from c) as confirmed from cl group by op
union all select 'audit', 'T', count(*), null, sum(xid)::bigint, (select confirmed from c) from cl where op = 'T' having count(*) > 0""")
def s09_recorded_stream(spark, sf):
    """Replication frames in files as a stream of two runs, each of which begins inside a transaction's files:
    decoded, resolved with the context of earlier batches, appended; positions are confirmed (s09 to s18)."""
    top = folder(spark, "frames")
    path, later, feedback = _local(f"{top}/in"), _local(f"{top}/later"), _local(f"{top}/out") + "/feedback"
    ends = F.when(F.substring(F.hex("data"), 1, 2) == "43", F.conv(F.substring(F.hex("data"), 21, 16), 16, 10).cast("long"))
    # one file for each run of 205 changes, so files cut transactions
    part = F.floor(F.col("seq") / (8 * 205)).cast("long").alias("part")
    half = table(spark, sf, "events").agg(F.max("event_id")).first()[0] // 205 // 2
    frames.write_groups(_raw(spark, sf).select(part, "seq", ends.alias("end"), "data"), path, later, half)
    spark.dataSource.register(frames.FrameSource)
    stream = pgoutput.messages(spark.readStream.format("replication_frames").load(path))
    t, m, store = LakeTable(spark, f"{top}/events"), Metrics(), frames.Feedback(feedback)
    sink = runner.resolving(runner.append_sink(t, "q", m), LakeTable(spark, f"{top}/context"), "q")
    for _ in range(2):
        runner.run(stream, f"{top}/checkpoint", sink, m, offsets=store, position=F.col("end_lsn"))
        for name in sorted(os.listdir(later)):
            os.replace(f"{later}/{name}", f"{path}/{name}")
    users = F.sum(typed(F.col("new")["user_id"], "BigInt")).alias("users")
    return t.read().groupBy("table", "op").agg(F.count("*").alias("n"), users, F.sum("xid").alias("xids")).withColumn("confirmed", F.lit(int(store.load())))

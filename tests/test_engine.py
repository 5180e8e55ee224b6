"""Decoders, policies, the lake, configuration, administration and the command line."""

import hashlib
import json
import random
import socket
import sqlite3
import struct
import threading
import time

import oracle
import pytest
from pyspark.sql import functions as F

from changeloom import cli, config
from changeloom.admin.server import AdminClient, admin_server, call, worker_server
from changeloom.admin.store import Store
from changeloom.envelope import cell, image, no_image
from changeloom.errors import AdminError, ChangeError, ConfigError, LakeError, MySqlError, PostgresError, ProtocolError, SchemaError
from changeloom.functions import coerce, lsn, types, values
from changeloom.operators import evolve, fold, merge, ordered
from changeloom.operators.flatten import flatten
from changeloom.plans import registry, streams
from changeloom.sinks import lake
from changeloom.sinks.lake import LakeTable
from changeloom.sinks.out import DatabaseTarget, database_sink, sqlite_stage
from changeloom.sources import discovery, frames, mysql, snapshot, wire
from changeloom.sources import pgoutput as pg
from changeloom.sources.log import ChangeLogSource
from changeloom.streaming import runner
from changeloom.streaming.metrics import Metrics
from changeloom.streaming.offsets import MemoryOffsets, SqliteOffsets


def test_messages():
    assert pg.decode(pg.begin(1 << 63, 5, 9)) == {"kind": "B", "lsn": -(1 << 63), "pg_time_us": 5, "xid": 9}
    assert pg.decode(pg.commit(1, 2, 3))["end_lsn"] == 2
    r = pg.decode(pg.relation(7, "s", "t", [("id", 20, True), ("b", 25, False)]))
    assert (r["schema"], r["table"], [c["name"] for c in r["columns"]], r["columns"][0]["is_key"]) == ("s", "t", ["id", "b"], True)
    u = pg.decode(pg.change("U", 7, [1, pg.UNCHANGED], [1, None], key_only=True))
    assert u["old_kind"] == "K" and [x["kind"] for x in u["new"]] == ["t", "u"] and u["old"][1]["value"] is None
    assert pg.decode(pg.truncate([1, 2]))["rel_ids"] == [1, 2]
    assert pg.decode(b"Y\0\0") is None
    for bad in (b"Z", b"B\0", b"I\0\0\0\1X", b"D\0\0\0\1N", pg.change("I", 7, ["abc"])[:-1], b"I" + struct.pack(">I", 1) + b"N\0\1q"):
        with pytest.raises(ProtocolError):
            pg.decode(bad)


def test_frames():
    assert pg.frame(b"w" + struct.pack(">QQq", 1, 2, 3) + b"body") == {"kind": "w", "start": 1, "end": 2, "time": 3, "data": b"body"}
    assert pg.frame(b"k" + struct.pack(">QqB", 1, 2, 1))["reply"] and pg.frame(b"c") == {"kind": "c"}
    assert pg.status_update(5, 6)[:9] == b"r" + struct.pack(">Q", 5)
    assert "SLOT \"a\"\"b\" LOGICAL 0/0" in pg.start_replication('a"b', "0/0", ["p"])


def test_changes_need_their_context(spark):
    raw = lambda *m: spark.createDataFrame(list(enumerate(m)), "seq long, data binary")
    rel = pg.relation(7, "s", "t", [("id", 20, True)])
    ok = pg.events(pg.messages(raw(pg.begin(1, 0, 3), rel, pg.change("I", 7, [5]), pg.commit(1, 2, 0)))).collect()
    assert ok[0].new["id"].value == "5" and ok[0].pk == ["id"]
    for bad in ((rel, pg.change("I", 7, [5])), (pg.begin(1, 0, 3), pg.change("I", 7, [5])), (pg.begin(1, 0, 3), rel, pg.change("I", 7, [5, 6])), (pg.begin(1, 0, 3), rel, pg.commit(1, 2, 0), pg.change("I", 7, [5]))):
        with pytest.raises(Exception, match="change|tuple"):
            pg.events(pg.messages(raw(*bad))).collect()


def test_relation_changes_apply_from_then_on(spark):
    m = [pg.begin(1, 0, 3), pg.relation(7, "s", "t", [("id", 20, True)]), pg.change("I", 7, [1]), pg.relation(7, "s", "t", [("id", 20, True), ("b", 25, False)]), pg.change("I", 7, [2, "x"]), pg.commit(1, 2, 0)]
    rows = pg.events(pg.messages(spark.createDataFrame(list(enumerate(m)), "seq long, data binary")), span=2).orderBy("seq").collect()
    assert [sorted(r.new) for r in rows] == [["id"], ["b", "id"]]


LSN = [("0/16B3748", 0x16B3748), ("1/0", 1 << 32), ("0/0", 0), ("FFFFFFFF/FFFFFFFF", -1), ("", None), ("noslash", None), ("G/0", None), ("0/G", None), ("/", None), ("0/", None)]


def test_lsn(spark):
    rows = spark.createDataFrame([(t,) for t, _ in LSN], "t string").select(lsn.lsn_parse(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == [n for _, n in LSN]
    good = [x for x in LSN if x[1] is not None]
    rows = spark.createDataFrame([(n,) for _, n in good], "n long").select(lsn.lsn_format(F.col("n")).alias("t")).collect()
    assert [r.t for r in rows] == [t for t, _ in good]


@pytest.mark.parametrize(
    ("function", "cases"),
    [
        (lambda c: coerce.decimal_text(c, 2), [("123", "123.00"), ("123.45", "123.45"), ("-99.5", "-99.50"), ("1.999", "1.99"), ("abc", None), ("1e3", None), (" 1", None)]),
        (coerce.to_time_us, [("10:30:00", 37_800_000_000), ("10:30:00.500000", 37_800_500_000), ("00:00:00", 0), ("838:59:59", None), ("x", None)]),
        (coerce.to_timestamp_us, [("1970-01-01 00:00:01", 1_000_000), ("1970-01-01T00:00:01.5Z", 1_500_000), ("1970-01-01 05:30:00+05:30", 0), ("2024", None), ("not-a-timestamp", None)]),
        (lambda c: F.hex(coerce.to_uuid_bytes(c)), [("550e8400-e29b-41d4-a716-446655440000", "550E8400E29B41D4A716446655440000"), ("short", None)]),
        (coerce.parse_long, [("1", 1), ("+2", 2), (" 3", None), ("4.0", None), ("9223372036854775808", None)]),
    ],
)
def test_parsing(spark, function, cases):
    rows = spark.createDataFrame([(t,) for t, _ in cases], "t string").select(function(F.col("t")).alias("x")).collect()
    assert [str(r.x) if isinstance(w, str) else r.x for r, (_, w) in zip(rows, cases, strict=True)] == [w for _, w in cases]


def test_types_agree_on_driver_and_in_frames(spark):
    from changeloom.plans.scalars import _CANONICAL, _TYPES

    for dialect in _TYPES:
        assert [types.canonical(dialect, t) for t in _TYPES[dialect]] == _CANONICAL[dialect]


def test_event_json(spark):
    df = spark.range(1).select(
        F.lit(12345).alias("lsn"), F.lit(1000000).alias("timestamp_us"), F.lit("public").alias("schema"), F.lit("users").alias("table"), F.lit("I").alias("op"),
        F.array(F.lit("id")).alias("pk"),
        image({"id": cell(F.lit(1), "Int"), "name": cell(F.lit('A"\n'), "Text"), "x": cell(F.lit(float("nan")), "Float"), "y": cell(F.lit(1e20), "Float"), "b": cell(F.lit("0aff"), "Bytes")}).alias("new"),
        no_image().alias("old"),
    )
    out = json.loads(df.select(values.event_json()).first()[0])
    assert out["metadata"] == {"op": "I", "lsn": 12345, "timestamp_us": 1000000, "snapshot": False, "schema": "public", "table": "users", "primary_key_columns": ["id"]}
    assert out["new"]["values"] == {"id": 1, "name": 'A"\n', "x": None, "y": 1e20, "b": "0aff"} and out["old"] is None
    assert out["new"]["types"]["name"] == "Text"


def random_log(seed, n=400, keys=12):
    rng = random.Random(seed)
    return [(i, i // 20, rng.choice("IIUUUDS") if rng.random() > 0.01 else "T", rng.randrange(keys), rng.randrange(1000)) for i in range(n)]


def test_folds_against_a_loop(spark):
    for seed in range(3):
        log = random_log(seed)
        df = spark.createDataFrame(log, "seq long, batch_id long, op string, k long, v long").repartition(4)
        state = {}
        for _, _, op, k, v in log:
            if op == "T":
                state.clear()
            elif op == "D":
                state.pop(k, None)
            else:
                state[k] = v
        got = fold.sequential_fold(df, ["k"], ["v"]).collect()
        assert {r.k: r.v for r in got} == state and len(got) == len(state)
        last_t = max((s for s, _, op, _, _ in log if op == "T"), default=-1)
        live = [x for x in log if x[0] > last_t]
        want = sorted((k, v) for s, b, op, k, v in live if op in "IUS" and not any(o in "DU" and k2 == k and b2 > b for _, b2, o, k2, _ in live))
        assert sorted((r.k, r.v) for r in fold.delta_apply(df, ["k"], ["v"]).collect()) == want


def test_mixed_batch_under_both_semantics(spark):
    log = spark.createDataFrame([(0, 0, "I", 1, "a"), (1, 0, "I", 2, "b"), (2, 0, "U", 1, "a_updated"), (3, 0, "D", 2, None)], "seq long, batch_id long, op string, id long, name string")
    assert [(r.id, r.name) for r in fold.sequential_fold(log, ["id"], ["name"]).collect()] == [(1, "a_updated")]
    assert sorted((r.id, r.name) for r in fold.delta_apply(log, ["id"], ["name"]).collect()) == [(1, "a"), (1, "a_updated"), (2, "b")]


def test_order_operators(spark):
    rng = random.Random(3)
    rows = [(i * 3 + rng.randrange(3), rng.choice([None, None, i])) for i in range(300)]
    df = spark.createDataFrame(rows, "seq long, v long").repartition(5)
    assert [r.position for r in ordered.positions(df, span=17).orderBy("seq").collect()] == list(range(300))
    last, want = None, []
    for _, v in rows:
        last = v if v is not None else last
        want.append(last)
    assert [r.x for r in ordered.last_known(df, F.col("v"), "x", span=17).orderBy("seq").collect()] == want
    split = ordered.batches(spark.range(10_500).withColumnRenamed("id", "seq"), 10_000).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in split] == [10_000, 500]


def test_key_changes_and_collisions(spark):
    log = spark.createDataFrame([(1, "U", 5, 4), (2, "U", 6, None), (3, "U", 7, 7)], "seq long, op string, id long, old_id long")
    assert sorted((r.seq, r.op, r.id) for r in fold.with_key_changes(log, ["id"], ["old_id"]).collect()) == [(1, "D", 4), (1, "U", 5), (2, "U", 6), (3, "U", 7)]
    with pytest.raises(SchemaError):
        flatten(log, {"_old_x": "Text"})


def test_empty_logs(spark):
    log = spark.createDataFrame([], "seq long, batch_id long, op string, k long, v long")
    assert fold.sequential_fold(log, ["k"], ["v"]).count() == fold.delta_apply(log, ["k"], ["v"]).count() == ordered.positions(log).count() == 0


def test_binlog_names_and_files(spark):
    row = lambda seq, kind, **x: {"seq": seq, "file": "f1", "position": seq, "timestamp_us": 0, "kind": kind, "table_id": 1, "schema": "s"} | x
    c = lambda v: {"type": "Int", "value": str(v)}
    log = spark.createDataFrame(
        [row(1, "table_map", table="t", names=["a", "b"]), row(2, "write", images=[[c(1), c(2)], [c(3), c(4)]]), row(3, "update", images=[[c(1), c(2)], [c(1), c(5)]]), row(4, "rotate", file="f2"), row(5, "write", images=[[c(9)]]), row(6, "query", sql="/* x */ truncate `t`"), row(7, "xid", xid=3)],
        mysql.EVENT,
    )
    rows = mysql.row_events(log, spark.createDataFrame([("s", "t", ["a"])], "schema string, table string, pk array<string>")).orderBy("seq", "part").collect()
    assert [(r.op, r.pk) for r in rows] == [("I", ["a"]), ("I", ["a"]), ("U", ["a"]), ("I", ["a"]), ("T", ["a"])]
    assert rows[2].old["b"].value == "2" and rows[2].new["b"].value == "5" and list(rows[3].new) == ["col_0"]
    assert [r.offset for r in mysql.commits(mysql.with_files(log)).orderBy("seq").collect()] == ["f2:6", "f2:7"]
    assert mysql.row_events(log, tables=["s.other"]).count() == 0


def test_lake(spark, tmp_path):
    t = LakeTable(spark, f"file://{tmp_path}/t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    t.create(df.schema, ["id"])
    t.append(df, "q:0")
    t.append(df, "q:0")
    assert t.read().count() == 2
    t.row_delta(df.where("id = 1").withColumn("v", F.lit("new")), df.where("id = 1"))
    assert sorted((r.id, r.v) for r in t.read().collect()) == [(1, "new"), (2, "b")] and t.read(1).count() == 2
    assert t.state()["summary"]["added-equality-deletes"] == 1
    state = t.state()
    t.truncate()
    with pytest.raises(LakeError):
        t._commit(state, "append", None)
    with pytest.raises(LakeError):
        t.evolve(df.schema, 1)
    assert t.read().count() == 0
    with pytest.raises(LakeError):
        t.state(99)


def test_a_commit_is_there_as_a_whole_or_not_at_all(spark, tmp_path):
    t = LakeTable(spark, f"file://{tmp_path}/t")
    df = spark.createDataFrame([(1, "a")], "id long, v string")
    t.append(df, "q:0")
    move = t._move
    t._move = lambda *x: 1 / 0  # the writer dies when its version is written and not yet named
    with pytest.raises(LakeError):
        t.append(df, "q:1")
    t._move = move
    (tmp_path / "t/_log/_left.tmp").write_text('{"vers')
    assert t.versions() == [0] and t.read().count() == 1
    one, two = t.state(), t.state()
    t._commit(one, "append", "q:1")
    with pytest.raises(LakeError):
        t._commit(two, "append", "q:1")
    assert t.state()["version"] == 1 and not [n for n in (tmp_path / "t/_log").iterdir() if n.name.startswith("_") and n.name != "_left.tmp"]


def test_batches_are_taken_once_however_many_there_are(spark, tmp_path):
    t = LakeTable(spark, f"file://{tmp_path}/t")
    for n in range(3000, 5000, 100):
        t._commit(t.state(), "append", f"q:{n}")
    t._commit(t.state(), "append", "other:1")
    assert t.state()["done"] == {"q": 4900, "other": 1}
    assert t.seen("q:3000") and t.seen("q:7") and not t.seen("q:4901") and not t.seen("other:2") and not t.seen("third")


def test_lake_reads_stay_one_scan(spark, tmp_path):
    t = LakeTable(spark, f"file://{tmp_path}/t")
    for n in range(6):
        t.append(spark.createDataFrame([(n, "a")], "id long, v string"))
    t.evolve(t.schema().add("w", "string"), 5)
    t.append(spark.createDataFrame([(9, "a", "w")], "id long, v string, w string"))
    plan = t.read()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and sorted((r.id, r.w) for r in t.read().collect()) == [*[(n, None) for n in range(6)], (9, "w")]
    t.compact()
    assert t.expire() and len(t.state()["data"]) == 1 and len(list((tmp_path / "t/data").iterdir())) == 1 and t.read().count() == 7
    with pytest.raises(ConfigError):
        t.ensure(t.schema(), replicated=True)


def test_files_are_full_whichever_tasks_write_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lake, "TASK_ROWS", 20)
    t = LakeTable(spark, f"file://{tmp_path}/t", file_rows=7)
    rows = spark.range(1000, numPartitions=5).select((F.col("id") * 60_001 % 1009).alias("k"), F.col("id").cast("string").alias("_place x"))
    done = t.append(rows, order="k")["summary"]
    assert (done["added-data-files"], done["added-records"]) == (143, 1000)
    data = spark.read.parquet(f"file://{tmp_path}/t/data/*").select("k", F.col("_metadata.file_path").alias("f"))
    found = data.groupBy("f").agg(F.count("*").alias("n"), F.min("k").alias("a"), F.max("k").alias("b")).orderBy("a").collect()
    assert [r.n for r in found] == [7] * 142 + [6] and all(x.b < y.a for x, y in zip(found, found[1:]))
    assert len({r.f.rsplit("/", 1)[1].split("-")[1] for r in found}) > 2
    assert sorted(map(tuple, t.read().collect())) == sorted(map(tuple, rows.collect()))


def test_parts_of_a_fold_merge_in_any_order(spark):
    for seed in (5, 6):
        rng = random.Random(seed)
        log = [(*x[:1], *x[2:], ["w"] if rng.random() < 0.5 else None) for x in random_log(seed, 300, 9)]
        state = {}
        for s, op, k, v, left in log:
            if op == "T":
                state.clear()
            elif op == "D":
                state.pop(k, None)
            else:
                state[k] = (v, state.get(k, (0, None))[1] if left else v)
        df = spark.createDataFrame([(*x[:4], x[3], x[4]) for x in log], "seq long, op string, k long, v long, w long, left array<string>")
        parts = [merge.part(df.where(f"seq % 4 = {n}"), ["k"], ["v", "w"], ["w"], "left") for n in range(4)]
        rng.shuffle(parts)
        both = merge.merged(parts[0].unionByName(parts[1]), ["k"], ["v", "w"], ["w"])
        rows = merge.current(both.unionByName(parts[2]).unionByName(parts[3]), ["k"], ["v", "w"], ["w"]).collect()
        assert {r.k: (r.v, r.w) for r in rows} == state and len(rows) == len(state)


def test_folds_of_several_tables(spark):
    log = spark.createDataFrame([(1, 0, "I", "a", 1, "x"), (2, 0, "I", "b", 1, "y"), (3, 1, "T", "a", None, None), (4, 1, "I", "a", 2, "z"), (5, 1, "D", "b", 7, None)], "seq long, batch_id long, op string, tab string, id long, v string")
    want = [("a", 2, "z"), ("b", 1, "y")]
    assert sorted(tuple(r) for r in fold.sequential_fold(log, ["id"], ["v"], ["tab"]).collect()) == want
    assert sorted(tuple(r) for r in fold.delta_apply(log, ["id"], ["v"], tables=["tab"]).collect()) == want
    cells = log.withColumn("v", cell(F.col("v"), "Text"))
    assert sorted(tuple(r) for r in fold.fold_with_toast(cells, ["id"], ["v"], tables=["tab"]).collect()) == want


def test_null_keys_fold_like_others(spark):
    log = spark.createDataFrame([(1, 0, "I", None, "x"), (2, 0, "U", None, "y"), (3, 0, "I", 1, "z")], "seq long, batch_id long, op string, id long, v string")
    assert sorted(map(str, ((r.id, r.v) for r in fold.sequential_fold(log, ["id"], ["v"]).collect()))) == ["(1, 'z')", "(None, 'y')"]
    cells = log.withColumn("v", cell(F.col("v"), "Text"))
    assert fold.fold_with_toast(cells, ["id"], ["v"]).count() == 2


def test_checkpoints_of_a_snapshot(spark):
    events = spark.range(0, 250).select(F.lit("s").alias("schema"), F.lit("t").alias("table"), (F.col("id") * 3001).alias("seq"))
    rows = snapshot.checkpoints(events, 100).orderBy("rows").collect()
    assert [(r.rows, r.seq, r.complete) for r in rows] == [(100, 99 * 3001, False), (200, 199 * 3001, False), (250, 249 * 3001, True)]


def test_binlog_position():
    def run(sql):
        if "BINARY" in sql:
            raise ValueError("unknown statement")
        return [("bin.000003", 77, "", "", "")]

    assert mysql.snapshot_position(run) == "bin.000003:77"
    with pytest.raises(MySqlError):
        mysql.snapshot_position(lambda sql: [])


def test_recorded_frames(spark, tmp_path):
    made = [frames.keepalive(5, 0), *[frames.data_frame(0, 10 * n + 10, 0, b"m%d" % n) for n in range(5)], b"c", frames.data_frame(0, 99, 0, b"late")]
    (tmp_path / "in").mkdir()
    assert frames.write_recording(iter(made[:4]), str(tmp_path / "in"), 2) == 2
    (tmp_path / "in" / "1.frames").write_bytes(frames.record(made[4:]))
    spark.dataSource.register(frames.FrameSource)
    read = lambda **o: sorted((r.seq, bytes(r.data)) for r in spark.read.format("replication_frames").options(**o).load(str(tmp_path / "in")).collect())
    assert read() == [(n, b"m%d" % n) for n in range(5)]
    assert read(start="0/1E") == [(3, b"m3"), (4, b"m4")]
    (tmp_path / "bad.frames").write_bytes(frames.record(made[:3])[:-3])
    with pytest.raises(ProtocolError):
        list(frames.frames_of(str(tmp_path), "bad.frames"))
    with pytest.raises(ProtocolError):
        frames.position("x/y")


def test_many_recorded_files_are_written_by_tasks_and_read_in_few(spark, tmp_path, monkeypatch):
    for name in ("in", "later"):
        (tmp_path / name).mkdir()
    messages = spark.range(600).select((F.col("id") / 2).cast("long").alias("part"), F.col("id").alias("seq"), F.when(F.col("id") % 2 == 1, F.col("id") * 10).alias("end"), F.col("id").cast("string").cast("binary").alias("data"))
    assert frames.write_groups(messages, f"{tmp_path}/in", f"{tmp_path}/later", 249) == 300
    assert [len(list((tmp_path / name).iterdir())) for name in ("in", "later")] == [250, 50]
    for f in (tmp_path / "later").iterdir():
        f.rename(tmp_path / "in" / f.name)
    names = sorted(f.name for f in (tmp_path / "in").iterdir())
    assert [f["kind"] for f in frames.frames_of(f"{tmp_path}/in", names[3])] == ["k", "w", "w"]
    reader = frames._Batch(None, {"path": f"{tmp_path}/in"})
    assert len(reader.partitions()) == 1 and len(reader.parts(names[9], names[19])[0].names) == 10 and reader.parts(names[9], names[19])[0].first == 20
    monkeypatch.setattr(frames, "LEAST", 1)
    parts = reader.partitions()
    assert 10 < len(parts) <= 128 and sum((p.names for p in parts), []) == names
    monkeypatch.setattr(frames, "BLOCK", 7)  # frames go over the ends of what is read at once
    monkeypatch.setattr(frames, "ROWS", 3)
    rows = [tuple(r.values()) for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert rows == [(n, n * 10 if n % 2 else 1, b"%d" % n) for n in range(600)]
    spark.dataSource.register(frames.FrameSource)
    assert sorted(tuple(r) for r in spark.read.format("replication_frames").load(f"{tmp_path}/in").collect()) == rows
    (tmp_path / "in" / "9.frames").write_bytes(frames.record([b"w123"]))
    with pytest.raises(ProtocolError):
        reader.partitions()


def test_scram_by_the_example_of_its_rfc():
    s = wire.Scram("pencil", "user", "rOprNGfwEbeRWgbNEkqO")
    first = "r=rOprNGfwEbeRWgbNEkqO%hvYDpWUa2RaTCAfuxFIlj)hNlF$k0,s=W22ZaJ0SNY7soEsUEjb6gQ==,i=4096"
    assert s.final(first) == "c=biws,r=rOprNGfwEbeRWgbNEkqO%hvYDpWUa2RaTCAfuxFIlj)hNlF$k0,p=dHzbZapWIk4jUhN+Ute9ytag9zjfMHgsqmmiz7AndVQ="
    s.verify("v=6rriTRBi23WpRR/wtup+mMhUZUn/dB5nLTJRsjl95G4=")
    for wrong in (lambda: s.verify("v=AAAA"), lambda: s.final("r=other,s=W22Z,i=1")):
        with pytest.raises(PostgresError):
            wrong()


def served(script):
    """A server that plays (bytes to send) and (function of what came) in turn; returns its end of the link, and what came."""
    ours, theirs = socket.socketpair()
    came = []

    def play():
        for step in script:
            if callable(step):
                came.append(theirs.recv(65536))
                step = step(came[-1])
            if step:
                theirs.sendall(step)

    threading.Thread(target=play, daemon=True).start()
    return ours, came


def test_connection():
    ask = lambda how, rest=b"": wire.message(b"R", struct.pack(">I", how) + rest)
    ready = ask(0) + wire.message(b"S", b"a\0b\0") + wire.message(b"Z", b"I")
    row = wire.message(b"D", struct.pack(">hi", 2, 1) + b"x" + struct.pack(">i", -1))
    frame = frames.data_frame(1, 2, 0, b"body")
    link, came = served([lambda got: ask(5, b"salt"), lambda got: ready, lambda got: wire.message(b"N", b"S\0") + row + wire.message(b"Z", b"I"),
                         lambda got: wire.message(b"W", b"\0\0\0") + wire.message(b"d", frame) + wire.message(b"c", b""), lambda got: b""])
    c = wire.Connection(link, "u", "d", "p")
    inner = hashlib.md5(b"pu").hexdigest()
    assert came[1] == wire.message(b"p", b"md5" + hashlib.md5(inner.encode() + b"salt").hexdigest().encode() + b"\0")
    assert b"replication\0database" in came[0] and c.query("SELECT 1") == [["x", None]]
    assert list(c.replicate("s", "0/0", ["p"])) == [frame]
    c.confirm(5)
    time.sleep(0.1)
    assert came[-1][5:6] == b"r"
    for script, text in (([lambda got: wire.message(b"E", b"SFATAL\0C28P01\0Mno such user\0\0")], "28P01: no such user"), ([lambda got: ask(10, b"OTHER\0\0")], "no login"), ([lambda got: ask(7)], "kind 7")):
        with pytest.raises(PostgresError, match=text):
            wire.Connection(served(script)[0], "u", "d")
    link, came = served([lambda got: ask(3), lambda got: ready])
    wire.Connection(link, "u", "d", "secret")
    assert came[1] == wire.message(b"p", b"secret\0")


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from changeloom import scratch

    far = SimpleNamespace(master="spark://host:7077", applicationId="x", getConf=lambda: SimpleNamespace(get=lambda k: None))
    with pytest.raises(ConfigError):
        scratch.folder(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=far), "l")
    df = scratch.written(spark.range(5), "numbers")
    assert df.count() == 5


def test_publications():
    assert discovery.ensured_publication("p", ["a.b"], []) is None
    assert discovery.ensured_publication("p", ["a.b", "a.c"], ["a.c", "a.b"]) is None
    with pytest.raises(ConfigError, match="missing"):
        discovery.ensured_publication("p", ["a.b"], ["a.c"])
    with pytest.raises(ConfigError, match="may not be created"):
        discovery.ensured_publication("p", None, ["a.b"], create=False)


def test_binlog_values(spark):
    df = spark.createDataFrame(
        [("uint", "18446744073709551615", None, False), ("int", "1", None, True), ("int", None, None, True), ("bytes", "12", "int(11)", False),
         ("bytes", "12", None, False), ("json_diff", None, None, False), ("json", '{"a":1}', None, False), ("int", "7", None, None)],
        "kind string, value string, type string, flag boolean",
    )
    made = df.select(mysql.binlog_cell(*[F.col(c) for c in df.columns]).alias("c")).select("c.*").collect()
    assert [tuple(r) for r in made] == [
        ("Text", "18446744073709551615"), ("Bool", "true"), ("Null", None), ("Int", "12"), ("Text", "12"), ("Text", "[json_diff]"), ("Text", '{"a":1}'), ("Int", "7"),
    ]


def test_flag_columns(spark):
    columns = spark.createDataFrame([("s", "t", "a", "tinyint(1)"), ("s", "t", "b", "tinyint(4)")], "schema string, table string, name string, source_type string")
    assert [r["name"] for r in discovery.flag_columns(columns).collect()] == ["a"]


def test_date_texts_by_column_type(spark, tmp_path):
    """A date and time stays one at midnight and at a round second, where its column's type is known."""
    n = lambda *v: [F.lit(x) for x in v]
    text = lambda *v, kind=None: coerce.mysql_date(*n(*v), *([] if kind is None else [F.lit(kind)]))
    midnight = (2024, 1, 2, 0, 0, 0, 0)
    got = spark.range(1).select(
        text(*midnight), text(*midnight, kind="date"), text(*midnight, kind="datetime"), text(*midnight, kind="DATETIME(6)"), text(*midnight, kind="blob"),
        text(2024, 1, 2, 3, 4, 5, 60700, kind="timestamp(3)"), text(2024, 1, 2, 3, 4, 5, 60700, kind="datetime"), text(2024, 1, 2, 3, 4, 5, 60700),
    ).first()
    assert list(got) == ["2024-01-02", "2024-01-02", "2024-01-02 00:00:00", "2024-01-02 00:00:00.000000", "2024-01-02", "2024-01-02 03:04:05.060", "2024-01-02 03:04:05", "2024-01-02 03:04:05.060700"]
    at = ["2024-01-02 00:00:00", "2024-01-02 10:00:00", "2024-01-02 10:20:30.000001", "1969-12-31 23:59:59.25"]
    e = spark.createDataFrame([(i, t) for i, t in enumerate(t for t in at for _ in range(3))], "event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    e.write.parquet(f"{tmp_path}/events.parquet")
    assert oracle.difference(spark, str(tmp_path), registry.queries()["f29_mysql_date"], registry.oracle_sql()["f29_mysql_date"]) == ""


def test_schema_log():
    log, one = evolve.SchemaLog(), evolve.replication_schema({"id": "BigInt"}, ["id"])
    assert log.commit(one, -1) == 0
    with pytest.raises(SchemaError):
        log.commit(one, 7)
    assert not one["id"].nullable and evolve.highest_id(evolve.flattened_schema({"a": "Int"})) == 9


def test_database_batches_are_transactions(spark, tmp_path):
    file = str(tmp_path / "s.db")
    target = DatabaseTarget(lambda: sqlite3.connect(file))
    found = lambda: sqlite3.connect(file).execute("select * from t order by id").fetchall()
    frame = lambda *x: spark.createDataFrame(list(x), "seq long, op string, id long, v string")
    assert target.ensure("t", {"id": "BIGINT", "v": "TEXT"}, ["id"]) == ["id", "v"] == target.ensure("t", {"x": "TEXT"})
    target.apply("t", frame((1, "I", 1, "a"), (2, "I", 2, "b")), ["id"], "q", 0)
    target.apply("t", frame((5, "U", 1, "c"), (6, "D", 2, None)), ["id"], "q", 1)
    target.apply("t", frame((9, "U", 1, "again")), ["id"], "q", 1)  # repeated
    target.apply("t", frame((3, "U", 1, "late"), (4, "U", 2, "late"), (4, "I", 3, "d")), ["id"], "other", 0)  # older
    target.apply("t", frame(), ["id"], "other", 1, truncated=4)  # older too, but for one key
    assert found() == [(1, "c")]
    target._done = lambda *x: 1 / 0
    with pytest.raises(ZeroDivisionError):
        target.apply("t", frame((7, "U", 1, "lost")), ["id"], "q", 2, truncated=6)
    del target._done
    assert found() == [(1, "c")]
    target.evolve("t", {"v": "TEXT", "more": "TEXT"})
    target.evolve("t", {"more": "TEXT"}, ["gone"])
    assert target.columns("t") == ["id", "v", "more"]
    target.evolve("t", {}, ["more"])
    sink = database_sink(target, "t", {}, ["id"], "q")
    log = spark.createDataFrame([(10, "I", 8, "x", "n"), (11, "T", None, None, None), (12, "I", 9, "y", "n"), (13, "U", 9, "z", "m")], "seq long, op string, id long, v string, late string")
    sink(log, 2)
    assert found() == [(9, "z", "m")]


def test_rows_are_staged_by_tasks(spark, tmp_path, monkeypatch):
    file = str(tmp_path / "s.db")
    (tmp_path / "parts").mkdir()
    target = DatabaseTarget(lambda: sqlite3.connect(file), stage=sqlite_stage(file, f"{tmp_path}/parts"))
    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", lambda *a, **b: pytest.fail("rows go through the driver"))
    sizes, collect = [], type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda self: sizes.append(n := collect(self)) or n)
    rows = spark.range(5000, numPartitions=23).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("a'\""), F.col("id").cast("string"))).alias("v w"), (F.col("id") / 8).alias("x"), (F.col("id") % 2 == 0).alias("even"))
    target.ensure("t", {"id": "BIGINT", "v w": "TEXT", "x": "DOUBLE", "even": "TEXT"})
    for number in (0, 0, 1):
        target.append("t", rows, "q", number)
    found = sqlite3.connect(file).execute("select id, \"v w\", x, even from t order by id").fetchall()
    assert found == [(i, f"a'\"{i}" if i % 3 else None, i / 8, str(int(i % 2 == 0))) for i in range(5000) for _ in range(2)]
    assert [len(s) for s in sizes] == [23, 23] and not list((tmp_path / "parts").iterdir())
    target._done = lambda *x: 1 / 0
    with pytest.raises(ZeroDivisionError):
        target.append("t", rows, "q", 2)
    del target._done
    assert sqlite3.connect(file).execute("select count(*) from t").fetchone() == (10_000,)
    target.append("t", rows, "q", 2)
    assert sqlite3.connect(file).execute("select count(*) from t").fetchone() == (15_000,)
    assert not [n for n in sqlite3.connect(file).execute("select name from sqlite_master").fetchall() if "stage" in n[0]]


def test_a_shared_database_is_read_in_parts_of_its_key(spark, tmp_path, monkeypatch):
    file = str(tmp_path / "a b.db")
    rows = [(k, f"v{i}" if i % 3 else None) for i, k in enumerate([*range(-3, 20), 7, 7, None, None, 99])]
    with sqlite3.connect(file) as db:
        db.execute("create table t (k bigint, v text)")
        db.executemany("insert into t values (?, ?)", rows)
    schema = spark.createDataFrame([], "k long, v string").schema
    for parts in (1, 2, 5, 40):
        found = snapshot.read_sqlite(spark, file, "t", schema, "k", (0, 20), parts, block=3)
        assert found.rdd.getNumPartitions() == parts and sorted(map(tuple, found.collect()), key=repr) == sorted(rows, key=repr)
    monkeypatch.setattr(streams, "one_process", lambda spark: False)  # as on a cluster, where Derby is not one database
    name = "s21_jdbc_snapshot"
    assert oracle.difference(spark, "/root/testdata/sf0.001", registry.queries()[name], registry.oracle_sql()[name]) == ""


def test_offsets(tmp_path):
    one, two = (SqliteOffsets(str(tmp_path / "o.db"), k) for k in "ab")
    assert one.load() is None
    one.save("1/2")
    one.save("1/3")
    assert one.load() == "1/3" and two.load() is None
    m = MemoryOffsets()
    m.copy().save("x")
    assert m.load() == "x"


def test_metrics():
    now = [0.0]
    m = Metrics(lambda: now[0])
    assert m.snapshot().events_per_sec == 0.0
    m.batch(2)
    m.batch(1)
    m.error()
    now[0] = 2.9
    s = m.snapshot()
    assert (s.events_total, s.batches_total, s.last_batch_size, s.errors_total, s.uptime_secs, s.events_per_sec) == (3, 2, 1, 1, 2, 1.5)


def test_failing_sink_counts_and_is_retried(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    m, seen = Metrics(), []

    def sink(batch, number):
        if not seen:
            seen.append(None)
            raise ValueError("once")
        seen.append((number, batch.count()))

    with pytest.raises(Exception, match="once"):
        runner.run(stream, f"{tmp_path}/cp", sink, m)
    runner.run(stream, f"{tmp_path}/cp", sink, m)
    assert m.errors == 1 and seen[1:] == [(0, 5)]


def test_change_log_source(spark, tmp_path):
    for part in range(3):
        lines = [json.dumps({"seq": part * 10 + i, "op": "U", "key": i % 4, "value": part + 0.5}) for i in range(10)]
        (tmp_path / f"{part:03d}.json").write_text("\n".join(lines) + "\n")
    spark.dataSource.register(ChangeLogSource)
    fields = "seq long, op string, key long, value double"
    assert spark.read.format("changelog").option("fields", fields).load(str(tmp_path)).count() == 30
    stream = spark.readStream.format("changelog").option("fields", fields).load(str(tmp_path))
    t = LakeTable(spark, f"file://{tmp_path}/state")
    m = Metrics(lambda: 0.0)
    runner.run(stream, f"{tmp_path}/cp", runner.fold_sink(t, "q", ["key"], ["value"], m), m)
    assert m.snapshot().events_total == 30 and m.batches >= 1
    assert sorted((r.key, r.value) for r in runner.state(t, ["key"], ["value"]).collect()) == [(k, 2.5) for k in range(4)]


SOURCE = {"type": "postgres", "host": "h", "user": "u", "database": "d", "slot_name": "s"}


def test_config():
    parse = lambda **x: config.Config.parse(json.dumps({"source": SOURCE, "sink": {"type": "stdout"}, "offset": {"type": "memory"}} | x))
    c = parse()
    assert (c.mode, c.source.port, c.source.create_publication, c.source.tables) == ("cdc", 5432, True, [])
    assert parse(sink={"type": "iceberg", "path": "/x"}, mode="replication").mode == "replication"
    assert config.MySqlSource("h", "u", "d", 1).url() == "mysql://u@h:3306/d"
    for bad in ({"mode": "replication"}, {"mode": "x"}, {"source": {"type": "postgres"}}, {"sink": {"type": "?"}}, {"offset": None}):
        with pytest.raises(ConfigError):
            parse(**bad)
    with pytest.raises(ConfigError):
        config.Config.parse("{")


def test_admin_and_worker_servers():
    store = Store()
    admin = admin_server(store)
    url = f"http://127.0.0.1:{admin.server_port}"
    stopped, metrics = [], Metrics()
    worker = worker_server(metrics, lambda: stopped.append(1))
    job = call("POST", f"{url}/api/jobs", {"name": "j", "config_json": "{\"a\": 1}"})
    assert call("GET", f"{url}/api/jobs/{job['id']}/config") == {"a": 1}
    assert call("PUT", f"{url}/api/jobs/{job['id']}", {"description": "new"})["description"] == "new"
    client = AdminClient(url)
    assert client.config("j") == (job["id"], '{"a": 1}')
    client.register("w", job["id"], f"127.0.0.1:{worker.server_port}", "h", 1)
    client.heartbeat("w", metrics)
    assert call("GET", f"{url}/api/workers")[0]["status"] == "running"
    assert call("GET", f"{url}/api/metrics/w/latest")["events_total"] == 0 and len(call("GET", f"{url}/api/metrics/w?limit=5")) == 1
    call("POST", f"{url}/api/workers/w/stop", {})
    assert stopped == [1] and call("GET", f"http://127.0.0.1:{worker.server_port}/health") == {"status": "ok"}
    client.deregister("w")
    assert store.worker("w")["status"] == "stopped"
    call("DELETE", f"{url}/api/jobs/{job['id']}")
    with pytest.raises(ChangeError):
        call("GET", f"{url}/api/jobs/{job['id']}")
    with pytest.raises(AdminError):
        client.config("j")
    admin.tended = False
    admin.shutdown()
    worker.shutdown()


def test_command_line(spark, tmp_path, capsys):
    spark.createDataFrame([(1, "I", 1, "a"), (2, "U", 1, "b"), (3, "I", 2, "c"), (4, "D", 2, None)], "seq long, op string, key long, v string").write.parquet(f"{tmp_path}/in")
    text = json.dumps({"source": {"type": "files", "path": f"{tmp_path}/in"}, "sink": {"type": "iceberg", "path": f"file://{tmp_path}/out"}, "offset": {"type": "memory"}, "mode": "replication"})
    (tmp_path / "c.json").write_text(text)
    assert cli.main(["job", "run", "-c", str(tmp_path / "c.json"), "--checkpoint", str(tmp_path / "cp")]) == 0
    rows = runner.state(LakeTable(spark, f"file://{tmp_path}/out"), ["key"], ["v"]).collect()
    assert [(r.key, r.v) for r in rows] == [(1, "b")]
    for mode, rows in (("replication", 1), ("cdc", 4)):
        (tmp_path / "c.json").write_text(json.dumps(json.loads(text) | {"mode": mode, "sink": {"type": "sqlite", "path": f"{tmp_path}/{mode}.db"}}))
        for _ in range(2):
            assert cli.main(["job", "run", "-c", str(tmp_path / "c.json"), "--checkpoint", str(tmp_path / f"cp-{mode}")]) == 0
        assert len(sqlite3.connect(f"{tmp_path}/{mode}.db").execute("select * from events").fetchall()) == rows
    (tmp_path / "c.json").write_text("{}")
    assert cli.main(["job", "run", "-c", str(tmp_path / "c.json"), "--checkpoint", "x"]) == 1
    assert "config error" in capsys.readouterr().err


def test_command_line_with_recorded_frames(spark, tmp_path):
    messages = [pg.begin(1, 0, 3), pg.relation(7, "s", "t", [("id", 20, True)]), pg.change("I", 7, [1])]
    later = [pg.change("I", 7, [2]), pg.commit(1, 24, 0), pg.begin(30, 0, 4), pg.relation(7, "s", "t", [("id", 20, True), ("b", 25, False)]), pg.change("U", 7, [2, "x"], [2, None]), pg.commit(30, 40, 0)]
    (tmp_path / "in").mkdir()
    config_ = {"source": {"type": "frames", "path": str(tmp_path / "in")}, "sink": {"type": "iceberg", "path": f"file://{tmp_path}/out"}, "offset": {"type": "memory"}}
    (tmp_path / "c.json").write_text(json.dumps(config_))
    first = 0
    for part in (messages, later):  # the second batch begins inside a transaction
        first = frames.write_recording((frames.data_frame(0, 50, 0, m) for m in part), str(tmp_path / "in"), 100, first)
        assert cli.main(["job", "run", "-c", str(tmp_path / "c.json"), "--checkpoint", str(tmp_path / "cp")]) == 0
    rows = LakeTable(spark, f"file://{tmp_path}/out").read().orderBy("id", "_cdc_op").collect()
    assert [(r._cdc_op, r._cdc_lsn, r.id, r.b, r._old_id, r._old_b) for r in rows] == [("I", 1, "1", None, None, None), ("I", 1, "2", None, None, None), ("U", 30, "2", "x", "2", None)]
    (tmp_path / "c.json").write_text(json.dumps(config_ | {"mode": "replication"}))
    assert cli.main(["job", "run", "-c", str(tmp_path / "c.json"), "--checkpoint", str(tmp_path / "other")]) == 1


def test_admin_in_the_background(tmp_path, capsys):
    home = ["--home", str(tmp_path / "home")]
    assert cli.main(["admin", "logs", *home]) == 0 and cli.main(["admin", "stop", *home]) == 1
    assert cli.main(["admin", "start", "--port", "0", "--db", str(tmp_path / "a.db"), *home]) == 0
    try:
        assert cli.main(["admin", "start", *home]) == 1
        for _ in range(100):
            time.sleep(0.2)
            capsys.readouterr()
            cli.main(["admin", "logs", *home])
            if "listening" in (shown := capsys.readouterr().out):
                break
        port = int(shown.split()[-1])
        assert call("GET", f"http://127.0.0.1:{port}/api/jobs") == []
    finally:
        assert cli.main(["admin", "stop", *home]) == 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0 and set(entry.oracle_sql()) <= set(entry.queries())

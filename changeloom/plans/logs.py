"""Queries: snapshots, decoders, as-of resolution, lake tables, streams, administration."""

from __future__ import annotations

import datetime

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..admin import store
from ..envelope import cell
from ..functions.coerce import mysql_number, typed
from ..operators.flatten import flatten, project
from ..operators.ordered import last_known
from ..functions import names
from ..scratch import folder, ship, written
from ..sinks.lake import LakeTable
from ..sources import discovery, mysql, pgoutput, snapshot
from ..streaming.metrics import Metrics
from .base import change_log, query, rows, table


_ORDERS = {"o_orderkey": ("Int", "BigInt"), "o_custkey": ("Int", "BigInt"), "o_orderstatus": ("Text", "Text"), "o_totalprice": ("Float", "Double"), "o_orderdate": ("Timestamp", "Text"), "o_orderpriority": ("Text", "Text")}
_OLD_ORDERS = ", ".join(f"cast(null as {'bigint' if k == 'BigInt' else 'double' if k == 'Double' else 'varchar'}) as _old_{c}" for c, (_, k) in _ORDERS.items())


def _snapshot(spark, sf):
    return snapshot.snapshot(table(spark, sf, "orders"), "orders", ["o_orderkey"], {c: tag for c, (tag, _) in _ORDERS.items()}, seq=F.col("o_orderkey"), lsn=F.lit(4096))


@query("""select 'S' as _cdc_op, 4096 as _cdc_lsn, 0 as _cdc_timestamp_us, true as _cdc_snapshot, 'public' as _cdc_schema, 'orders' as _cdc_table, '["o_orderkey"]' as _cdc_primary_key_columns,
o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as o_orderdate, o_orderpriority, """ + _OLD_ORDERS + " from orders")
def s02_snapshot_orders(spark, sf):
    return flatten(_snapshot(spark, sf), {c: kind for c, (_, kind) in _ORDERS.items()})


@query("""with n as (select o_orderkey as seq, row_number() over (order by o_orderkey) as rows from orders)
select 'public' as schema, 'orders' as "table", seq, rows, false as complete from n where rows % 1000 = 0
union all select 'public', 'orders', max(seq), max(rows), true from n""")
def s03_snapshot_checkpoints(spark, sf):
    return snapshot.checkpoints(_snapshot(spark, sf), 1000)


@query("select c_custkey, case when c_custkey % 5 <> 0 then replace(c_name, '#', chr(9)) end as c_name, c_custkey % 2 = 0 as flag from customer")
def s04_copy_line(spark, sf):
    """Customers written as COPY text lines and parsed again."""
    c = table(spark, sf, "customer")
    name = F.when(F.col("c_custkey") % 5 != 0, F.replace(F.replace("c_name", F.lit("\\"), F.lit("\\\\")), F.lit("#"), F.lit("\\t"))).otherwise("\\N")
    flag = F.when(F.col("c_custkey") % 2 == 0, "t").otherwise("f")
    lines = c.select(F.col("c_custkey").alias("seq"), F.concat_ws("\t", F.col("c_custkey").cast("string"), name, flag).alias("value"))
    events = snapshot.copy_events(lines, "customer", [("c_custkey", 20), ("c_name", 25), ("flag", 16)], ["c_custkey"])
    return project(events, {"c_custkey": "BigInt", "c_name": "Text", "flag": "Boolean"}).drop("seq", "op")


@query("select r_name as schema, n_name as \"table\", n_nationkey as oid, case when n_nationkey % 2 = 0 then ['b', 'a'] else ['c'] end as pk from nation join region on r_regionkey = n_regionkey")
def s06_primary_keys(spark, sf):
    """Catalogs with a table for each nation and a schema for each region."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    oid = F.col("n_nationkey").alias("oid")
    att = n.select(F.col("n_nationkey").alias("attrelid"), F.posexplode(F.array(*map(F.lit, "abc"))).alias("attnum", "attname")).withColumn("attnum", F.col("attnum") + 1)
    cls = n.select(oid, F.col("n_name").alias("relname"), F.col("n_regionkey").alias("relnamespace"))
    nsp = r.select(F.col("r_regionkey").alias("oid"), F.col("r_name").alias("nspname"))
    keys = lambda *k: F.array(*map(F.lit, k))
    idx = n.select(F.col("n_nationkey").alias("indrelid"), F.when(F.col("n_nationkey") % 2 == 0, keys(2, 1)).otherwise(keys(3)).alias("indkey"), F.lit(True).alias("indisprimary"))
    return snapshot.primary_keys(att, cls, nsp, idx.unionAll(idx.select("indrelid", keys(1), F.lit(False))))


@query("""select * from (values ('public', 'users', 'id', 'integer', 'Int', false, 1), ('public', 'users', 'name', 'character varying(20)', 'VarString(20)', true, 2),
('shop', 'lines', 'price', 'numeric(10,2)', 'Decimal(10,2)', true, 1), ('shop', 'flags', 'on', 'tinyint(1)', 'Boolean', false, 1), ('shop', 'flags', 'n', 'int(11) unsigned', 'Int', true, 2),
('public', 'users', 'gone', 'text', 'Text', true, 0)) t("schema", "table", name, source_type, canonical, nullable, ordinal)""")
def e11_discovered_columns(spark, sf):
    """Columns from both databases' catalogs, and one that the source does not have (s06, s23)."""
    att = rows(spark, "attrelid int, attname string, attnum int, attnotnull boolean, attisdropped boolean, source_type string",
        (1, "id", 1, True, False, "integer"), (1, "name", 2, False, False, "character varying(20)"), (1, "old", 3, False, True, "text"), (1, "ctid", -1, True, False, "tid"), (2, "price", 1, False, False, "numeric(10,2)"))
    cls = rows(spark, "oid int, relname string, relnamespace int", (1, "users", 10), (2, "lines", 11))
    nsp = rows(spark, "oid int, nspname string", (10, "public"), (11, "shop"))
    own = rows(spark, "table_schema string, table_name string, column_name string, column_type string, is_nullable string, ordinal_position long",
        ("shop", "flags", "on", "tinyint(1)", "NO", 1), ("shop", "flags", "n", "int(11) unsigned", "YES", 2))
    known = discovery.pg_columns(att, cls, nsp).unionByName(discovery.mysql_columns(own))
    names = known.select("schema", "table", "name").unionByName(rows(spark, "schema string, table string, name string", ("public", "users", "gone")))
    return discovery.column_subset(names, known)


@query("select * from (values ('pg', 'public', 'users', 'b,a'), ('my', 'shop', 'flags', 'on')) t(dialect, \"schema\", \"table\", keys)")
def e11_discovered_keys(spark, sf):
    shape = "table_schema string, table_name string, constraint_name string, column_name string, ordinal_position long"
    usage = rows(spark, shape, ("public", "users", "users_pkey", "a", 2), ("public", "users", "users_pkey", "b", 1), ("public", "users", "users_c_key", "c", 1))
    kinds = rows(spark, "table_schema string, table_name string, constraint_name string, constraint_type string", ("public", "users", "users_pkey", "PRIMARY KEY"), ("public", "users", "users_c_key", "UNIQUE"))
    own = rows(spark, shape, ("shop", "flags", "PRIMARY", "on", 1), ("shop", "flags", "other", "n", 1))
    pg, my = discovery.constraint_keys(usage, kinds), discovery.constraint_keys(own)
    both = pg.withColumn("dialect", F.lit("pg")).unionByName(my.withColumn("dialect", F.lit("my")))
    return both.select("dialect", "schema", "table", F.array_join("pk", ",").alias("keys"))


_OBJECTS = {
    "create": "SELECT lsn FROM pg_create_logical_replication_slot('it''s', 'pgoutput')",
    "drop": "SELECT pg_drop_replication_slot('it''s')",
    "info": "SELECT slot_name, plugin, confirmed_flush_lsn, active FROM pg_replication_slots WHERE slot_name = 'it''s'",
    "all": 'CREATE PUBLICATION "p" FOR ALL TABLES',
    "some": 'CREATE PUBLICATION "p""q" FOR TABLE "public"."users", "logs"',
    "start": """START_REPLICATION SLOT "it's" LOGICAL 0/10 (proto_version '1', publication_names 'p,q')""",
}


@query("select * from (values " + ", ".join(f"('{k}', '{v.replace(chr(39), chr(39) * 2)}')" for k, v in _OBJECTS.items()) + ") t(kind, statement)")
def s19_replication_objects(spark, sf):
    """Statements for slots, publications and the stream (s11, s19, s20)."""
    made = discovery.slot_statements("it's") | {"all": discovery.ensured_publication("p", None, []), "some": discovery.publication_statement('p"q', ["public.users", "logs"]), "start": pgoutput.start_replication("it's", "0/10", ["p", "q"])}
    return rows(spark, "kind string, statement string", *made.items())


def _wire(batches):
    """The change log as pgoutput messages: two relations, truncates of both."""
    P = pgoutput
    for batch in batches:
        seqs, data = [], []
        for seq, xid, op, user, kind, value, old in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            out = []
            if seq % 10 == 0:
                out.append((0, P.begin(xid * 256, seq, xid)))
                out.append((1, P.relation(16384, "public", "events", [("user_id", 20, True), ("event_type", 25, False), ("value", 701, False)])))
                out.append((2, P.relation(16385, "public", "audit", [("id", 20, True)])))
            if op == "T":
                out.append((3, P.truncate([16384, 16385])))
            elif op == "D":
                out.append((3, P.change("D", 16384, old=[user, None, None], key_only=True)))
            elif op == "U":
                out.append((3, P.change("U", 16384, [user, P.UNCHANGED if seq % 3 == 0 else kind, value], [user, None, old])))
            else:
                out.append((3, P.change("I", 16384, [user, kind, value])))
            if seq % 10 == 9:
                out.append((4, P.commit(xid * 256, xid * 256 + 8, seq)))
            seqs += [seq * 8 + i for i, _ in out]
            data += [d for _, d in out]
        yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), pa.array(data, pa.binary())], ["seq", "data"])


def _raw(spark, sf):
    ship(spark)
    log = change_log(spark, sf).select("seq", "xid", "op", "user_id", "event_type", "value", "old_value")
    # a recording comes in many files; here the rows are few bytes and would meet in one task
    return log.repartition(spark.sparkContext.defaultParallelism, "xid").mapInArrow(_wire, "seq long, data binary")


def _decoded(spark, sf):
    """Messages that are decoded once and read from where they are written."""
    return written(pgoutput.messages(_raw(spark, sf)), "messages")


@query("""LOG , e as (select *, 'events' as tab from cl union all select *, 'audit' as tab from cl where op = 'T')
select seq * 8 + 3 as seq, xid * 256 as lsn, seq + 946684800000000 - xid * 0 as timestamp_seq, xid, tab as "table", op, case when tab = 'audit' then 'id' else 'user_id' end as pk,
case when op in ('I', 'U') then user_id end as user_id, case when op = 'I' or (op = 'U' and seq % 3 <> 0) then event_type end as event_type,
case when op in ('I', 'U') then value end as value, op = 'U' and seq % 3 = 0 as unchanged, case when op in ('U', 'D') then user_id end as old_user, case when op = 'U' then old_value end as old_value from e""".replace("seq + 946684800000000 - xid * 0", "xid * 10 + 946684800000000"))
def s13_pgoutput(spark, sf):
    """pgoutput bytes to events: parse, tuples, relations, transactions, keys, truncates (s13 to s18)."""
    e = pgoutput.events(_decoded(spark, sf), span=5000)
    get = lambda side, c, kind: F.when(F.col(side).isNotNull(), typed(F.col(side)[c], kind))
    return e.select(
        "seq", "lsn", F.col("timestamp_us").alias("timestamp_seq"), "xid", "table", "op", F.array_join("pk", ",").alias("pk"),
        get("new", "user_id", "BigInt").alias("user_id"), get("new", "event_type", "Text").alias("event_type"), get("new", "value", "Double").alias("value"),
        F.coalesce(F.col("new")["event_type"]["type"] == "UnchangedToast", F.lit(False)).alias("unchanged"),
        get("old", "user_id", "BigInt").alias("old_user"), get("old", "value", "Double").alias("old_value"),
    )


@query("LOG select seq * 8 + 3 as seq, 'user_id' as by_flag, 'user_id,event_type' as pk from cl where op <> 'T'")
def s17_pk_resolution(spark, sf):
    """Keys from the catalog take the place of the relation's flags."""
    known = rows(spark, "rel_id long, pk array<string>", (16384, ["user_id", "event_type"]))
    events = pgoutput.events(_decoded(spark, sf), known, flags=True).where("op <> 'T'")
    return events.select("seq", F.array_join("flag_pk", ",").alias("by_flag"), F.array_join("pk", ",").alias("pk"))


@query("""LOG , r as (select seq, user_id % 4 as rel, case when event_type = 'signup' then seq end as version from cl)
select seq, rel, max(version) over (partition by rel order by seq) as version from r""")
def s15_relation_asof(spark, sf):
    log = change_log(spark, sf).select("seq", (F.col("user_id") % 4).alias("rel"), F.when(F.col("event_type") == "signup", F.col("seq")).alias("v"))
    return last_known(log, F.col("v"), "version", by=["rel"], span=700).select("seq", "rel", "version")


@query("LOG , b as (select seq, case when seq % 10 = 0 then xid end as begun from cl) select seq, max(begun) over (order by seq) as xid from b")
def s16_tx_context(spark, sf):
    log = change_log(spark, sf).select("seq", F.when(F.col("seq") % 10 == 0, F.col("xid")).alias("begun"))
    return last_known(log, F.col("begun"), "xid", span=900).select("seq", "xid")


@query("LOG select seq * 2 + k as seq, case k when 0 then 'events' else 'audit' end as \"table\" from cl, (values (0), (1)) v(k) where op = 'T'")
def s18_truncate_explode(spark, sf):
    t = change_log(spark, sf).where("op = 'T'").select("seq", F.posexplode(F.array(F.lit("events"), F.lit("audit"))).alias("k", "table"))
    return t.select((F.col("seq") * 2 + F.col("k")).alias("seq"), "table")


@query("select n_name as \"table\", case when n_nationkey < 5 then 'missing' else 'extra' end as problem from nation where n_nationkey < 5 or n_nationkey >= 20")
def s20_publication(spark, sf):
    names = table(spark, sf, "nation").withColumn("table", F.col("n_name"))
    return pgoutput.publication_difference(names.where("n_nationkey < 20"), names.where("n_nationkey >= 5"))


@query("""select o_orderkey, case when o_orderkey % 3 = 0 then 'Bool' when o_orderkey % 3 = 1 then 'Int' else 'Text' end as type,
case when o_orderkey % 3 = 0 then case when o_orderkey = 0 then 'false' else 'true' end when o_orderkey % 3 = 1 then cast(o_orderkey as varchar) else cast(9223372036854775808::hugeint + o_orderkey as varchar) end as value from orders""")
def s24_mysql_numbers(spark, sf):
    k = F.col("o_orderkey").cast("decimal(20,0)")
    big = (F.lit("9223372036854775808").cast("decimal(20,0)") + k).cast("decimal(20,0)")
    value = F.when(F.col("o_orderkey") % 3 == 2, big).otherwise(k)
    return table(spark, sf, "orders").select("o_orderkey", mysql_number(value, F.col("o_orderkey") % 3 == 0).alias("c")).select("o_orderkey", "c.type", "c.value")


def _binlog(spark, sf):
    """The change log as binary log events; updates carry two images."""
    log = change_log(spark, sf)
    cells = lambda v: F.array(cell(F.col("user_id"), "Int"), cell(v, "Float"))
    op = F.col("op")
    images = F.when(op == "U", F.array(cells(F.col("old_value")), cells(F.col("value")))).when(op != "T", F.array(cells(F.col("value"))))
    empty = lambda kind: F.lit(None).cast(kind)
    base = log.select(
        (F.col("seq") * 2 + 1).alias("seq"), F.lit("bin.000001").alias("file"), (F.col("seq") * 2 + 1).alias("position"), F.lit(0).cast("long").alias("timestamp_us"),
        F.when(op == "I", "write").when(op == "U", "update").when(op == "D", "delete").otherwise("query").alias("kind"), F.lit(7).cast("long").alias("table_id"),
        F.lit("shop").alias("schema"), empty("string").alias("table"), empty("array<string>").alias("names"), images.alias("images"),
        F.when(op == "T", "TRUNCATE TABLE events").alias("sql"), empty("long").alias("xid"),
    )
    maps = base.where("(seq - 1) % 40 = 0").withColumn("seq", F.col("seq") - 1).withColumn("kind", F.lit("table_map")).withColumn("table", F.lit("events"))
    maps = maps.withColumn("names", F.when(F.col("seq") % 800 == 0, F.array(F.lit("only"))).otherwise(F.array(F.lit("user_id"), F.lit("value")))).withColumn("images", empty(base.schema["images"].dataType))
    return base.unionByName(maps.withColumn("sql", empty("string")))


@query("""LOG select seq * 2 + 1 as seq, 'shop' as schema, 'events' as "table", op,
case when op in ('I', 'U') then user_id end as new_user, case when op in ('U', 'D') then user_id end as old_user,
case op when 'U' then old_value when 'D' then value end as old_value,
case when op = 'T' then null when (seq // 20) * 40 % 800 = 0 then 'col_0' else 'user_id' end as first_name from cl""")
def s27_binlog_rows(spark, sf):
    """Row events with both images, truncates, and names from the last table map (s26 to s30)."""
    e = mysql.row_events(_binlog(spark, sf), tables=["shop.events"], span=3000)
    pick = lambda side, a, b: F.coalesce(F.col(side)[a], F.col(side)[b])
    either = F.coalesce("new", "old")
    return e.select(
        "seq", "schema", "table", "op", typed(pick("new", "user_id", "col_0"), "BigInt").alias("new_user"), typed(pick("old", "user_id", "col_0"), "BigInt").alias("old_user"),
        typed(pick("old", "value", "col_1"), "Double").alias("old_value"), F.get(F.array_sort(F.map_keys(either)), 0).alias("first_name"),
    )


@query("""LOG select seq * 2 + 1 as seq, op, case when op = 'T' then null else 'user_id' end as first_name, case when op in ('I', 'U') then user_id end as new_user from cl""")
def s29_refreshed_names(spark, sf):
    """Where a table map's names do not fit, those of the live source do."""
    shape = "table_schema string, table_name string, column_name string, ordinal_position long"
    live = rows(spark, shape, ("shop", "events", "value", 2), ("shop", "events", "user_id", 1), ("shop", "other", "x", 1))
    e = mysql.row_events(_binlog(spark, sf), span=3000, columns=mysql.refreshed_names(live))
    first = F.get(F.array_sort(F.map_keys(F.coalesce("new", "old"))), 0)
    return e.select("seq", "op", first.alias("first_name"), typed(F.col("new")["user_id"], "BigInt").alias("new_user"))


@query("""with v as (select o_orderkey, o_orderkey % 9 as k from orders)
select o_orderkey, case when k in (0, 2) then 'Int' when k = 1 then 'Bool' when k = 3 then 'Float' when k = 5 then 'Date' when k = 6 then 'Timestamp' when k = 7 then 'Time' else 'Text' end as type,
case k when 1 then case when o_orderkey % 2 = 1 then 'true' else 'false' end when 3 then o_orderkey || '.5' when 4 then '1e5x' when 5 then '2024-01-31' when 6 then '2024-01-31 10:00:00'
when 7 then '-25:00:00' when 8 then '[json_diff]' else cast(o_orderkey as varchar) end as value from v""")
def s31_binlog_values(spark, sf):
    """Binary log values of nine kinds."""
    n = F.col("o_orderkey")
    k, text = (n % 9).cast("int"), n.cast("string")
    pick = lambda *xs: F.get(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs]), k)
    kind = pick("int", "int", "uint", "double", "bytes", "date", "date", "time", "json_diff")
    value = pick(text, (n % 2).cast("string"), text, F.concat(text, F.lit(".5")), "1e5x", "2024-01-31", "2024-01-31 10:00:00", "-25:00:00", text)
    c = mysql.binlog_cell(kind, value, F.when(k == 4, F.lit("double")), k == 1)
    return table(spark, sf, "orders").select("o_orderkey", c.alias("c")).select("o_orderkey", "c.type", "c.value")


@query("LOG select seq * 2 + 1 as seq, 'bin.000001:' || (seq * 2 + 1) as \"offset\" from cl where op = 'T'")
def s26_binlog_commits(spark, sf):
    return mysql.commits(_binlog(spark, sf))


# lake tables


_DELTA = "(select count(*) from t where part < 3 and user_id not in (select user_id from t where part >= 3 and op in ('D', 'U'))) + (select count(*) from t where part >= 3 and op in ('I', 'U'))"


@query(f"""LOG , t as (select *, seq // 2500 as part from cl where op <> 'T')
select 'append' as step, 4 as version, count(*) as n from t where part < 3 union all select 'older batch', 4, count(*) from t where part < 3
union all select 'time travel', 1, count(*) from t where part = 0 union all select 'delta', 5, {_DELTA}
union all select 'added records', 5, count(*) from t where part >= 3 and op in ('I', 'U') union all select 'equality deletes', 5, count(distinct user_id) from t where part >= 3 and op in ('D', 'U')
union all select 'compacted', 6, {_DELTA} union all select 'truncate', 7, 0 union all select 'evolved', 9, count(*) from t where part = 0
union all select 'old version', 5, {_DELTA} union all select 'expired', 9, count(*) from t where part = 0""")
def k11_lake_commits(spark, sf):
    """Appends, a row delta, a compaction, a truncate and an evolved schema as versions of one table (k09 to k16)."""
    log = change_log(spark, sf).where("op <> 'T'").withColumn("part", F.floor(F.col("seq") / 2500).cast("int"))
    plain = log.select("user_id", "value", "part", "op")
    t = LakeTable(spark, folder(spark, "lake"))
    data = lambda n: plain.where(n).select("user_id", "value")
    out = []
    note = lambda step, n: out.append((step, t.state()["version"], n))
    t.ensure(data("part = 0").schema, ["user_id"], replicated=True)
    t.ensure(data("part = 0").schema, ["other"])  # it is there already
    for part in (0, 1, 2):
        t.append(data(f"part = {part}"), f"log:{2000 + part}")
    t.append(data("part = -1"), "once")
    t.append(data("part = 0"), "once")  # a repeated batch changes nothing
    note("append", t.read().count())
    t.append(data("part = 0"), "log:7")  # nor does any before the last one
    note("older batch", t.read().count())
    out.append(("time travel", 1, t.read(1).count()))
    done = t.row_delta(data("part >= 3 and op in ('I', 'U')"), data("part >= 3 and op in ('D', 'U')"))
    note("delta", t.read().count())
    note("added records", done["summary"]["added-records"])
    note("equality deletes", done["summary"]["added-equality-deletes"])
    t.compact()
    note("compacted", t.read().count())
    t.truncate()
    note("truncate", t.read().count())
    t.append(data("part = 0"))
    t.evolve(t.schema().add("extra", "string"), 8)
    note("evolved", t.read().where("extra is null").count())
    out.append(("old version", 5, t.read(5).count()))
    t.expire()
    note("expired", t.read().count())
    return rows(spark, "step string, version int, n long", *out)


@query("select ceil(count(*) / 400.0)::bigint as files, count(*) as n from orders")
def k14_rolled_files(spark, sf):
    """Rows in files of 400 at most, all full but the last, whichever tasks write them."""
    t = LakeTable(spark, folder(spark, "lake"), file_rows=400)
    done = t.append(table(spark, sf, "orders"), order="o_orderkey")["summary"]
    return rows(spark, "files long, n long", (done["added-data-files"], done["added-records"]))


@query("select n_nationkey, 'cdc_' || n_name as target, 'http://c/v1/p/namespaces/' || n_regionkey || chr(31) || 'x/tables/' || n_name as url from nation")
def k17_target_names(spark, sf):
    """Target names and commit URLs (k17, k18)."""
    url = lambda r: names.commit_url("http://c/", [str(r.n_regionkey), "x"], r.n_name, "p")
    n = table(spark, sf, "nation")
    urls = rows(spark, "n_nationkey int, url string", *[(r.n_nationkey, url(r)) for r in n.collect()])
    return n.select("n_nationkey", names.target_name("cdc_", F.col("n_name")).alias("target")).join(urls, "n_nationkey")


# administration

_NOW = "(select max(ts) from events)"


def _now(spark, sf):
    return F.lit(table(spark, sf, "events").agg(F.max("ts")).first()[0])


def _workers(spark, sf):
    e = table(spark, sf, "events")
    state = F.element_at(F.create_map(*[F.lit(x) for x in ("signup", "registered", "view", "running", "click", "running", "error", "stopped", "purchase", "lost")]), F.col("event_type"))
    return e.groupBy(F.col("user_id").alias("id")).agg(F.max_by(state, "event_id").alias("status"), F.max("ts").alias("last_heartbeat"))


@query(f"""with w as (select user_id as id, max_by(case event_type when 'signup' then 'registered' when 'view' then 'running' when 'click' then 'running' when 'error' then 'stopped' else 'lost' end, event_id) as status,
max(ts) as last_heartbeat from events group by 1) select id, status from w where status in ('registered', 'running') and last_heartbeat < {_NOW} - interval 7200 second""")
def a09_lost_workers(spark, sf):
    return store.lost_workers(_workers(spark, sf), _now(spark, sf), 7200).select("id", "status")


def _metrics(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("worker_id"), F.col("ts").alias("timestamp"), F.col("value").alias("events_per_sec"))


@query("select user_id as worker_id, max(event_id) as id, max_by(value, event_id) as events_per_sec from events group by 1")
def a11_latest_metrics(spark, sf):
    return store.latest_metrics(_metrics(spark, sf), ["events_per_sec"])


@query("select id, worker_id, place from (select event_id as id, user_id as worker_id, row_number() over (partition by user_id order by event_id desc) as place from events) where place <= 5")
def a12_history_topk(spark, sf):
    return store.metrics_history(_metrics(spark, sf), 5).select("id", "worker_id", "place")


@query(f"select event_id as id from events where ts >= {_NOW} - interval 2 day")
def a13_prune(spark, sf):
    return store.kept_metrics(_metrics(spark, sf), _now(spark, sf), 2).select("id")


@query("select * from (values (0, 'jobs', 'b,a'), (1, 'renamed', 'c'), (2, 'workers', 'w2,w1'), (3, 'lost', '1'), (4, 'status', 'lost,running'), (5, 'history', '3,2'), (6, 'latest', '3'), (7, 'pruned', '2'), (8, 'deregistered', 'stopped'), (9, 'deleted', 'b')) t(step, what, result)")
def a01_admin_store(spark, sf):
    """Jobs, workers, heartbeats and metrics over time (a03 to a08, a10)."""
    at = [datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)]
    s, m, out = store.Store(clock=lambda: at[0]), Metrics(), []
    later = lambda seconds: at.__setitem__(0, at[0] + datetime.timedelta(seconds=seconds))
    s.create_job("a", "{}")
    later(1)
    b = s.create_job("b", "{}")
    out.append(("jobs", ",".join(j["name"] for j in s.jobs())))
    out.append(("renamed", s.update_job(b["id"], name="c")["name"]))
    for w in ("w1", "w2"):
        s.register(w, b["id"], "h:1", "h", 1)
        later(1)
    out.append(("workers", ",".join(w["id"] for w in s.workers())))
    later(60)
    s.heartbeat("w2")
    out.append(("lost", str(s.mark_lost(30))))
    out.append(("status", ",".join(s.worker(w)["status"] for w in ("w1", "w2"))))
    for _ in range(3):
        s.record("w2", m.snapshot(), "running")
        later(86_400)
    out.append(("history", ",".join(str(r["id"]) for r in s.history("w2", 2))))
    out.append(("latest", str(s.latest("w2")["id"])))
    out.append(("pruned", str(s.prune(1.5))))
    s.deregister("w2")
    out.append(("deregistered", s.worker("w2")["status"]))
    s.delete_job(s.job_by_name("a")["id"])
    s.update_job(b["id"], name="b")
    out.append(("deleted", ",".join(j["name"] for j in s.jobs())))
    return rows(spark, "step int, what string, result string", *[(i, *x) for i, x in enumerate(out)])

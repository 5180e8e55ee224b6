"""Queries: dataflow, folds, deltas, upserts and their policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..envelope import cell
from ..operators import fold, ordered
from ..operators.flatten import fixed, flatten, project
from ..sinks.out import json_lines, queue_records
from .base import COLUMNS, change_events, change_log, query, table

_BARRIER = "LOG , b as (select *, coalesce(max(case when op = 'T' then seq end) over (), -1) as barrier from cl)"


@query(_BARRIER + ", r as (select *, row_number() over (partition by user_id order by seq desc) as rn from b where seq > barrier and op <> 'T') select user_id, event_type, value from r where rn = 1 and op <> 'D'")
def d09_sequential_fold(spark, sf):
    return fold.sequential_fold(change_log(spark, sf), ["user_id"], ["event_type", "value"])


@query(_BARRIER + ", r as (select *, row_number() over (partition by user_id, event_type order by seq desc) as rn from b where seq > barrier and op <> 'T') select user_id, event_type, value, seq from r where rn = 1 and op <> 'D'")
def d09_composite_key(spark, sf):
    log = change_log(spark, sf).withColumn("at", F.col("seq"))
    out = fold.sequential_fold(log, ["user_id", "event_type"], ["value", "at"])
    return out.withColumnRenamed("at", "seq")


_TABLES = "LOG , t as (select *, 't' || (user_id % 5) as tab, user_id // 5 as id from cl), b as (select *, coalesce(max(case when op = 'T' then seq end) over (partition by tab), -1) as barrier from t)"


def _tables_log(spark, sf):
    log = change_log(spark, sf)
    return log.withColumn("tab", F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string"))).withColumn("id", F.floor(F.col("user_id") / 5).cast("long"))


@query(_TABLES + ", r as (select *, row_number() over (partition by tab, id order by seq desc) as rn from b where seq > barrier and op <> 'T') select tab, id, event_type, value from r where rn = 1 and op <> 'D'")
def d09_fold_of_tables(spark, sf):
    """Several tables in one log: equal keys of two tables are two rows, and each table has its own truncates."""
    return fold.sequential_fold(_tables_log(spark, sf), ["id"], ["event_type", "value"], tables=["tab"])


@query(_TABLES + """, live as (select * from b where seq > barrier and op <> 'T'),
del as (select tab, id, max(batch_id) as del_batch from live where op in ('D', 'U') group by 1, 2)
select l.tab, l.id, l.event_type, l.value from live l left join del using (tab, id)
where l.op in ('I', 'U', 'S') and (del.del_batch is null or del.del_batch <= l.batch_id)""")
def d10_delta_of_tables(spark, sf):
    return fold.delta_apply(_tables_log(spark, sf), ["id"], ["event_type", "value"], tables=["tab"])


@query(_BARRIER + """, live as (select * from b where seq > barrier and op <> 'T'),
del as (select user_id, max(batch_id) as del_batch from live where op in ('D', 'U') group by user_id)
select l.user_id, l.event_type, l.value from live l left join del on del.user_id = l.user_id
where l.op in ('I', 'U', 'S') and (del.del_batch is null or del.del_batch <= l.batch_id)""")
def d10_delta_apply(spark, sf):
    return fold.delta_apply(change_log(spark, sf), ["user_id"], ["event_type", "value"])


@query(_BARRIER + " select seq, op, user_id from b where seq > barrier and op <> 'T'")
def d08_truncate_barrier(spark, sf):
    return fold.after_truncate(change_log(spark, sf)).select("seq", "op", "user_id")


@query("""LOG , t as (select *, 't' || (user_id % 5) as tab from cl),
b as (select *, coalesce(max(case when op = 'T' then seq end) over (partition by tab), -1) as barrier from t)
select tab, count(*) as n, min(seq) as first_seq from b where seq > barrier and op <> 'T' group by tab""")
def d08_truncate_barrier_by_table(spark, sf):
    log = change_log(spark, sf).withColumn("tab", F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string")))
    return fold.after_truncate(log, ["tab"]).groupBy("tab").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@query("""LOG select xid, count(*) as events, min(seq) as first_seq, max(seq) as last_seq, count(*) filter (op = 'I') as inserts,
count(*) filter (op = 'U') as updates, count(*) filter (op = 'D') as deletes, count(*) filter (op = 'T') as truncates from cl group by xid""")
def d01_tx_summary(spark, sf):
    return ordered.transactions(change_log(spark, sf))


@query("""LOG , p as (select *, row_number() over (order by seq) - 1 as position from cl where op <> 'D')
select position // 1000 as batch, count(*) as n, min(seq) as first_seq, max(seq) as last_seq from p group by 1""")
def d02_batch_split(spark, sf):
    log = ordered.batches(change_log(spark, sf).where("op <> 'D'"), 1000, span=700)
    return log.groupBy("batch").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query("""LOG select xid, count(*) filter (op = 'D') = 0 as empty, cast(max(seq) + 1 as varchar) as "offset" from cl group by xid""")
def d03_empty_commits(spark, sf):
    """Every commit saves its offset, whether or not a table's filter left it any event."""
    log = change_log(spark, sf)
    return log.groupBy("xid").agg((F.count_if(F.col("op") == "D") == 0).alias("empty"), (F.max("seq") + 1).cast("string").alias("offset"))


@query("LOG select 'public' as schema, event_type as table, op, count(*) as n, min(seq) as first_seq from cl group by 1, 2, 3")
def d04_route_counts(spark, sf):
    log = change_log(spark, sf).select(F.lit("public").alias("schema"), F.col("event_type").alias("table"), "op", "seq")
    return log.groupBy("schema", "table", "op").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@query("LOG select case op when 'T' then 'barrier' when 'U' then 'data+delete' when 'D' then 'delete' else 'data' end as class, count(*) as n from cl group by 1")
def d05_op_class(spark, sf):
    return change_log(spark, sf).groupBy(fold.op_class(F.col("op")).alias("class")).agg(F.count("*").alias("n"))


@query("LOG select seq, op, user_id from cl where op in ('D', 'U')")
def d06_pk_projection(spark, sf):
    log = change_events(spark, sf).where(F.col("op").isin("D", "U"))
    return project(log, {"user_id": "BigInt"}, "old")


@query("""LOG select op as _cdc_op, xid * 256 as _cdc_lsn, epoch_us(ts) as _cdc_timestamp_us, false as _cdc_snapshot, 'public' as _cdc_schema,
'events' as _cdc_table, '["user_id"]' as _cdc_primary_key_columns,
case when op in ('I', 'U') then user_id end as user_id, case when op in ('I', 'U') then event_type end as event_type, case when op in ('I', 'U') then value end as value,
case when op in ('U', 'D') then user_id end as _old_user_id, cast(null as varchar) as _old_event_type, case when op in ('U', 'D') then old_value end as _old_value from cl""")
def d07_flatten_cdc(spark, sf):
    return flatten(change_events(spark, sf), COLUMNS)


@query("LOG select user_id from cl where op in ('D', 'U')")
def d11_delete_keys(spark, sf):
    log = change_log(spark, sf).withColumn("old_user", F.when(F.col("seq") % 3 == 0, F.col("user_id")))
    return fold.delete_keys(log, ["user_id"], ["old_user"])


@query("LOG select user_id, event_type, value from cl where op in ('I', 'U')")
def d12_replication_data(spark, sf):
    return project(change_events(spark, sf).where(F.col("op").isin("I", "U", "S")), COLUMNS).drop("seq", "op")


_NEW = """case when op in ('I', 'U') then '{"values":{"event_type":"' || event_type || '","user_id":' || user_id || ',"value":' || cast(value as varchar) || '},"types":{"event_type":"Text","user_id":"Int","value":"Float"}}' end"""
_OLD = """case when op in ('U', 'D') then '{"values":{"user_id":' || user_id || ',"value":' || coalesce(cast(old_value as varchar), 'null') || '},"types":{"user_id":"Int","value":"' || case when old_value is null then 'Null' else 'Float' end || '"}}' end"""


@query(f"""LOG select op, xid * 256 as lsn, epoch_us(ts) as timestamp_us, false as snapshot, {_NEW} as row_new,
{_OLD} as row_old, '["user_id"]' as primary_key_columns from cl""")
def d13_fixed_json(spark, sf):
    return fixed(change_events(spark, sf))


_ENVELOPE = f"""'{{"metadata":{{"op":"' || op || '","lsn":' || xid * 256 || ',"timestamp_us":' || epoch_us(ts) || ',"snapshot":false,"schema":"public","table":"events","primary_key_columns":["user_id"]}},"new":' || coalesce({_NEW}, 'null') || ',"old":' || coalesce({_OLD}, 'null') || '}}'"""


@query(f"LOG select {_ENVELOPE} as value from cl")
def k02_json_lines(spark, sf):
    return json_lines(change_events(spark, sf))


@query(f"LOG select 'cdc.public.events' as topic, 'public.events' as key, {_ENVELOPE} as value from cl")
def k03_topic_key(spark, sf):
    return queue_records(change_events(spark, sf), "cdc")


@query("""LOG , ch as (select *, row_number() over (partition by user_id order by seq desc) as rn from cl where op in ('I', 'U')),
l as (select user_id as c_custkey, event_type as c_name from ch where rn = 1)
select c_custkey, c_name from customer where c_custkey not in (select c_custkey from l) union all select c_custkey, c_name from l""")
def k06_upsert(spark, sf):
    changes = change_log(spark, sf).where(F.col("op").isin("I", "U")).select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("c_name"), "seq")
    return fold.upsert(table(spark, sf, "customer").select("c_custkey", "c_name"), changes, ["c_custkey"], "seq")


@query("LOG select c_custkey, c_name from customer where c_custkey not in (select user_id from cl where op = 'D')")
def k07_delete(spark, sf):
    gone = change_log(spark, sf).where("op = 'D'").select(F.col("user_id").alias("c_custkey"))
    return fold.delete_by_key(table(spark, sf, "customer").select("c_custkey", "c_name"), gone, ["c_custkey"])


@query("""LOG , k as (select o.o_custkey % 50 as k, count(*) as n from orders o group by 1)
select seq, user_id, n from cl left join k on k.k = user_id where op = 'I'""")
def d17_lookup(spark, sf):
    """Events with a cached attribute of their key: a left join that Spark sizes."""
    cache = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 50).alias("user_id")).agg(F.count("*").alias("n"))
    return change_log(spark, sf).where("op = 'I'").join(cache, "user_id", "left").select("seq", "user_id", "n")


@query("""LOG , d as (select user_id, max(case when op = 'D' then seq end) as died from cl group by 1),
a as (select cl.*, coalesce(died, -1) as died from cl join d using (user_id) where seq > coalesce(died, -1) and op <> 'T' and seq > coalesce((select max(seq) from cl where op = 'T'), -1)),
r as (select *, row_number() over (partition by user_id order by seq desc) as rn,
 row_number() over (partition by user_id, event_type = 'view' order by seq desc) as rv from a)
select user_id, max(case when rn = 1 then event_type end) as kind, max(case when event_type <> 'view' and rv = 1 then cast(seq as varchar) end) as body from r group by user_id""")
def q05_toast_carry(spark, sf):
    """View events leave the large column ``body`` unchanged; it keeps its last value."""
    return fold.fold_with_toast(_toast_log(spark, sf), ["user_id"], ["kind", "body"])


@query("""LOG , d as (select user_id, max(case when op = 'D' then seq end) as died from cl group by 1),
a as (select cl.* from cl join d using (user_id) where seq > coalesce(died, -1) and op <> 'T' and seq > coalesce((select max(seq) from cl where op = 'T'), -1)),
r as (select *, row_number() over (partition by user_id order by seq desc) as rn from a)
select user_id, event_type as kind, case when event_type <> 'view' then cast(seq as varchar) end as body from r where rn = 1""")
def q05_toast_null(spark, sf):
    return fold.fold_with_toast(_toast_log(spark, sf), ["user_id"], ["kind", "body"], policy="null")


def _toast_log(spark, sf):
    body = F.when(F.col("event_type") == "view", F.struct(F.lit("UnchangedToast").alias("type"), F.lit(None).cast("string").alias("value")))
    return change_log(spark, sf).select("seq", "op", "user_id", cell(F.col("event_type"), "Text").alias("kind"), body.otherwise(cell(F.col("seq"), "Text")).alias("body"))


_MOVED = "LOG , m as (select seq, op, user_id, case when op = 'U' and seq % 7 = 0 then user_id + 1000 else user_id end as key, value from cl where op <> 'T')"


@query(_MOVED + """, p as (select seq, 1 as part, op, key, value from m union all select seq, 0, 'D', user_id, value from m where op = 'U' and key <> user_id),
r as (select *, row_number() over (partition by key order by seq desc, part desc) as rn from p) select key, value from r where rn = 1 and op <> 'D'""")
def q06_pk_change_delete_old(spark, sf):
    return _moved(spark, sf, "delete_old")


@query(_MOVED + ", r as (select *, row_number() over (partition by key order by seq desc) as rn from m) select key, value from r where rn = 1 and op <> 'D'")
def q06_pk_change_upsert_only(spark, sf):
    return _moved(spark, sf, "upsert_only")


def _moved(spark, sf, policy):
    log = change_log(spark, sf).where("op <> 'T'")
    key = F.when((F.col("op") == "U") & (F.col("seq") % 7 == 0), F.col("user_id") + 1000).otherwise(F.col("user_id"))
    log = log.select("seq", "op", key.alias("key"), F.col("user_id").alias("old_key"), "value")
    parted = fold.with_key_changes(log, ["key"], ["old_key"], policy=policy)
    return fold.sequential_fold(parted.withColumn("seq", F.col("seq") * 2 + F.col("part")), ["key"], ["value"])

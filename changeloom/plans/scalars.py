"""Queries: scalar functions, types, names, statements and schema evolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..envelope import cell, image, is_snapshot, op_code
from ..functions import coerce, lsn, names, types, values
from ..operators import evolve
from ..sinks import out
from .base import change_events, change_log, query, rows, table


@query("select o_orderkey, printf('%X/%X', o_orderkey * 7919993 >> 32, o_orderkey * 7919993 & 4294967295) as lsn from orders")
def f01_lsn_format(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", lsn.lsn_format(F.col("o_orderkey") * 7919993).alias("lsn"))


@query("select o_orderkey, case when o_orderkey % 5 = 0 then null else o_orderkey * 7919993 end as lsn from orders")
def f02_lsn_parse(spark, sf):
    """Texts of every fifth order are broken and must give null."""
    text = lsn.lsn_format(F.col("o_orderkey") * 7919993)
    broken = F.when(F.col("o_orderkey") % 10 == 0, F.replace(text, F.lit("/"), F.lit(""))).otherwise(F.concat(F.lit("G"), text))
    return table(spark, sf, "orders").select("o_orderkey", lsn.lsn_parse(F.when(F.col("o_orderkey") % 5 == 0, broken).otherwise(text)).alias("lsn"))


@query("select event_type, case event_type when 'signup' then 'I' when 'error' then 'D' when 'view' then 'S' when 'click' then 'U' else 'T' end as op, event_type = 'view' as snapshot, count(*) as n from events group by 1, 2, 3")
def f03_op_code(spark, sf):
    kinds = {"signup": "insert", "error": "delete", "view": "snapshot", "click": "update", "purchase": "truncate"}
    name = F.element_at(F.create_map(*[F.lit(x) for p in kinds.items() for x in p]), F.col("event_type"))
    e = table(spark, sf, "events").select("event_type", op_code(name).alias("op"))
    return e.groupBy("event_type", "op", is_snapshot(F.col("op")).alias("snapshot")).agg(F.count("*").alias("n"))


@query("""select o_orderkey, case o_orderkey % 4 when 0 then cast(o_orderkey as varchar) when 1 then null when 2 then lower(hex(o_orderstatus)) else o_orderpriority end as text,
case o_orderkey % 4 when 0 then 'Int' when 1 then 'Null' when 2 then 'Bytes' else 'Text' end as kind,
case o_orderkey % 4 when 0 then 'BigInt' when 1 then 'Text' when 2 then 'Binary' else 'Text' end as canonical from orders""")
def f05_cell_text(spark, sf):
    c, key = _cell_of_order(), F.col("o_orderkey")
    return table(spark, sf, "orders").select(key, c.alias("c")).select(
        "o_orderkey", values.to_text(F.col("c")).alias("text"), F.col("c.type").alias("kind"), values.inferred_type(F.col("c")).alias("canonical")
    )


def _cell_of_order():
    k = F.col("o_orderkey") % 4
    return (
        F.when(k == 0, cell(F.col("o_orderkey"), "Int"))
        .when(k == 1, coerce.cell_null())
        .when(k == 2, cell(F.lower(F.hex("o_orderstatus")), "Bytes"))
        .otherwise(cell(F.col("o_orderpriority"), "Text"))
    )


@query("""select * from (values (1.0::double, '1'), (99.5, '99.5'), (1e20, '100000000000000000000'), (1.5e-7, '0.00000015'), (-12345678.9, '-12345678.9'), ('nan'::double, null), ('inf'::double, null), (0.0, '0'), (123456789012.25, '123456789012.25')) t(x, text) where text is not null
union all select 0.5, null union all select 0.25, null""")
def f05_float_text(spark, sf):
    shown = [1.0, 99.5, 1e20, 1.5e-7, -12345678.9, 0.0, 123456789012.25]
    out_ = rows(spark, "x double, y double", *[(x, x) for x in shown], (0.5, float("nan")), (0.25, float("inf")))
    return out_.select("x", values.to_text(cell(F.col("y"), "Float")).alias("text"))


@query("""select n_nationkey, '{"key":' || n_nationkey || ',"name":"' || n_name || '","none":null}' as json,
'{"values":{"key":' || n_nationkey || ',"name":"' || n_name || '","none":null},"types":{"key":"Int","name":"Text","none":"Null"}}' as typed from nation""")
def f09_typed_row(spark, sf):
    row = image({"name": cell(F.col("n_name"), "Text"), "key": cell(F.col("n_nationkey"), "Int"), "none": coerce.cell_null()})
    return table(spark, sf, "nation").select("n_nationkey", values.row_json(row).alias("json"), values.typed_row_json(row).alias("typed"))


@query("LOG select seq, op, false as snapshot, 1 as keys, case when op in ('I', 'U') then user_id end as user_id from cl")
def f10_envelope_json(spark, sf):
    """The envelope read back as JSON, field by field."""
    log = change_events(spark, sf).select("seq", values.event_json().alias("j"))
    get = lambda path: F.get_json_object("j", path)
    return log.select("seq", get("$.metadata.op").alias("op"), (get("$.metadata.snapshot") == "true").alias("snapshot"), F.json_array_length(get("$.metadata.primary_key_columns")).alias("keys"), get("$.new.values.user_id").cast("long").alias("user_id"))


@query("""select '["' || n_name || '","' || n_nationkey || '"]' as keys, n_nationkey from nation""")
def f12_key_names(spark, sf):
    n = table(spark, sf, "nation")
    return n.select(values.key_names_json(F.array("n_name", F.col("n_nationkey").cast("string"))).alias("keys"), "n_nationkey")


_TYPES = {
    "postgres": ["int4", "BIGINT", " integer ", "numeric(10,2)", "numeric", "character varying(255)", "varchar", "char(3)", "text", "timestamp without time zone", "timestamptz", "timestamp(3) without time zone", "time", "bytea", "uuid", "jsonb", "text[]", "interval", "real", "double precision", "bool", "name", "smallint"],
    "mysql": ["int(11)", "int unsigned", "int(11) unsigned", "tinyint(1)", "tinyint(4)", "decimal(10,2)", "decimal", "varchar(20)", "char", "datetime(6)", "timestamp", "year(4)", "longblob", "varbinary(16)", "enum('a','b')", "json", "double", "float", "mediumint", "set('x')", "geometry"],
}
_CANONICAL = {
    "postgres": ["Int", "BigInt", "Int", "Decimal(10,2)", "Decimal", "VarString(255)", "VarString", "FixedString(3)", "Text", "Timestamp", "TimestampTz", "Text", "Time", "Binary", "Uuid", "Json", "Text", "Text", "Float", "Double", "Boolean", "Text", "SmallInt"],
    "mysql": ["Int", "Text", "Int", "Boolean", "SmallInt", "Decimal(10,2)", "Decimal", "VarString(20)", "FixedString", "Timestamp", "Timestamp", "Year", "Binary", "Binary", "Text", "Json", "Double", "Float", "Int", "Text", "Text"],
}


def _sql_rows(pairs, names):
    text = lambda x: "null" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return f"select * from (values {', '.join('(' + ', '.join(map(text, p)) + ')' for p in pairs)}) t({names})"


@query(_sql_rows([(d, t, c) for d in _TYPES for t, c in zip(_TYPES[d], _CANONICAL[d], strict=True)], "dialect, raw, canonical"))
def f14_type_map(spark, sf):
    frame = rows(spark, "dialect string, raw string", *[(d, t) for d in _TYPES for t in _TYPES[d]])
    kind = F.when(F.col("dialect") == "mysql", types.canonical_column("mysql", F.col("raw"))).otherwise(types.canonical_column("postgres", F.col("raw")))
    return frame.select("dialect", "raw", kind.alias("canonical"))


_TARGETS = [("Decimal(10,2)", "numeric(10,2)", "decimal(10,2)"), ("Decimal(8)", "numeric(8)", "decimal(8,18)"), ("Decimal", "numeric", "decimal(38,18)"), ("VarString(7)", "character varying(7)", "string"), ("FixedString", "character(1)", "string"), ("FixedString(4)", "character(4)", "string"), ("SmallInt", "smallint", "int"), ("Year", "smallint", "int"), ("Json", "jsonb", "string"), ("Uuid", "uuid", "uuid"), ("Time", "time without time zone", "time"), ("TimestampTz", "timestamp with time zone", "timestamptz"), ("Binary", "bytea", "binary"), ("BigInt", "bigint", "long"), ("Text", "text", "string")]


@query(_sql_rows(_TARGETS, "canonical, ddl, lake"))
def f15_target_types(spark, sf):
    return rows(spark, "canonical string, ddl string, lake string", *[(c, types.pg_ddl(c), types.lake_type(c)) for c, _, _ in _TARGETS])


@query("""select o_orderkey, case o_orderkey % 4 when 0 then 'Bool' when 1 then 'Int' when 2 then 'Text' else 'Date' end as type,
case o_orderkey % 4 when 0 then 'true' when 1 then cast(o_orderkey as varchar) when 2 then 'x' || o_orderkey else '2024-01-31' end as value from orders""")
def f17_pg_values(spark, sf):
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, "t").when(k == 1, F.col("o_orderkey").cast("string")).when(k == 2, F.concat(F.lit("x"), F.col("o_orderkey").cast("string"))).otherwise("2024-01-31")
    oid = F.when(k == 0, 16).when(k == 1, 20).when(k == 2, 23).otherwise(1082)
    return table(spark, sf, "orders").select("o_orderkey", coerce.pg_cell(text, oid).alias("c")).select("o_orderkey", "c.type", "c.value")


@query("""select o_orderkey, case o_orderkey % 3 when 0 then 'Int' else 'Text' end as type, case o_orderkey % 3 when 2 then 'bad' else cast(o_orderkey as varchar) end as value from orders""")
def f18_mysql_values(spark, sf):
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.concat(F.lit(" "), F.col("o_orderkey").cast("string"))).when(k == 1, F.col("o_orderkey").cast("string")).otherwise("bad")
    kind = F.when(k == 0, "int(11) unsigned").when(k == 1, "decimal(10,2)").otherwise("bigint")
    return table(spark, sf, "orders").select("o_orderkey", coerce.mysql_cell(text, kind).alias("c")).select("o_orderkey", "c.type", "c.value")


@query("""select o_orderkey, case when o_orderkey % 3 = 0 then null else o_orderkey * 1000003 end as as_long,
case when o_orderkey % 3 = 0 then null when o_orderkey % 3 = 1 then cast(((o_orderkey * 1000003 + 2147483648) % 4294967296) - 2147483648 as integer) else try_cast(o_orderkey * 1000003 as integer) end as as_int from orders""")
def f19_int(spark, sf):
    """Int cells wrap to 32 bits, Text must parse without blanks and fit."""
    number = F.col("o_orderkey") * 1000003
    k = F.col("o_orderkey") % 3
    c = F.when(k == 0, cell(F.concat(F.lit(" "), number.cast("string")), "Text")).when(k == 1, cell(number, "Int")).otherwise(cell(number, "Text"))
    return table(spark, sf, "orders").select("o_orderkey", c.alias("c")).select("o_orderkey", coerce.to_long(F.col("c")).alias("as_long"), coerce.to_int(F.col("c")).alias("as_int"))


@query("select o_orderkey, case o_orderkey % 3 when 0 then o_totalprice when 1 then cast(o_orderkey as double) end as as_double from orders")
def f20_float(spark, sf):
    k = F.col("o_orderkey") % 3
    c = F.when(k == 0, cell(F.col("o_totalprice"), "Text")).when(k == 1, cell(F.col("o_orderkey"), "Int")).otherwise(cell(F.concat(F.col("o_orderkey").cast("string"), F.lit(" ")), "Text"))
    return table(spark, sf, "orders").select("o_orderkey", coerce.to_double(c).alias("as_double"))


@query("select o_orderkey, case o_orderkey % 6 when 0 then true when 1 then true when 2 then true when 3 then false when 4 then o_orderkey % 4 <> 0 end as as_bool from orders")
def f21_bool(spark, sf):
    k = F.col("o_orderkey") % 6
    text = F.when(k == 0, "t").when(k == 1, "true").when(k == 2, "1").otherwise("yes")
    c = F.when(k <= 3, cell(text, "Text")).when(k == 4, cell(F.col("o_orderkey") % 4, "Int")).otherwise(coerce.cell_null())
    return table(spark, sf, "orders").select("o_orderkey", coerce.to_boolean(c).alias("as_bool"))


@query("""select event_id, case event_id % 6 when 4 then null when 5 then null when 3 then epoch_us(date_trunc('second', ts)) - 19800000000 when 2 then epoch_us(date_trunc('second', ts)) else epoch_us(ts) end as us from events""")
def f22_timestamp(spark, sf):
    ts, k = F.col("ts"), F.col("event_id") % 6
    full, short = F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    text = F.when(k == 0, full).when(k == 1, F.concat(F.replace(full, F.lit(" "), F.lit("T")), F.lit("Z"))).when(k == 2, F.concat(short, F.lit("+00")))
    text = text.when(k == 3, F.concat(short, F.lit("+05:30"))).when(k == 4, F.date_format(ts, "yyyy-MM-dd")).otherwise("not-a-timestamp")
    return table(spark, sf, "events").select("event_id", coerce.to_timestamp_us(text).alias("us"))


@query("select o_orderkey, case when o_orderkey % 2 = 0 then date_diff('day', date '1970-01-01', cast(o_orderdate as date)) end as days from orders")
def f23_date(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderkey") % 2 == 0, day).otherwise(F.concat(day, F.lit(" ")))
    return table(spark, sf, "orders").select("o_orderkey", coerce.to_days(text).cast("long").alias("days"))


@query("select o_orderkey, cast(case o_orderkey % 4 when 0 then o_orderkey + 0.99 when 1 then o_orderkey when 2 then o_orderkey + 0.13 end as decimal(38, 2)) as d from orders")
def f24_decimal_trunc(spark, sf):
    """Text is cut to the scale, Float rounded, Int scaled, other text null."""
    k, key = F.col("o_orderkey") % 4, F.col("o_orderkey").cast("string")
    c = F.when(k == 0, cell(F.concat(key, F.lit(".999")), "Text")).when(k == 1, cell(F.col("o_orderkey"), "Int"))
    c = c.when(k == 2, cell(F.concat(key, F.lit(".126")), "Float")).otherwise(cell(F.concat(key, F.lit("e1")), "Text"))
    return table(spark, sf, "orders").select("o_orderkey", coerce.to_decimal(c, 2).cast("decimal(38,2)").alias("d"))


@query("select event_id, case when event_id % 3 < 2 then epoch_us(ts) % 86400000000 - case when event_id % 3 = 1 then epoch_us(ts) % 1000000 else 0 end end as us from events")
def f25_time_us(spark, sf):
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.date_format("ts", "H:mm:ss.SSSSSS")).when(k == 1, F.date_format("ts", "HH:mm:ss")).otherwise("24:00:00")
    return table(spark, sf, "events").select("event_id", coerce.to_time_us(text).alias("us"))


@query("select o_orderkey, case when o_orderkey % 3 < 2 then md5(cast(o_orderkey as varchar)) end as u from orders")
def f26_uuid(spark, sf):
    digits = F.md5(F.col("o_orderkey").cast("string").cast("binary"))
    dashed = F.concat_ws("-", F.substring(digits, 1, 8), F.substring(digits, 9, 4), F.substring(digits, 13, 4), F.substring(digits, 17, 4), F.upper(F.substring(digits, 21, 12)))
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, digits).when(k == 1, dashed).otherwise(F.substring(digits, 1, 31))
    return table(spark, sf, "orders").select("o_orderkey", F.lower(F.hex(coerce.to_uuid_bytes(text))).alias("u"))


@query("select n_nationkey, case when n_nationkey % 2 = 0 then hex(n_name) end as b from nation")
def f27_binary(spark, sf):
    c = F.when(F.col("n_nationkey") % 2 == 0, cell(F.lower(F.hex("n_name")), "Bytes")).otherwise(cell(F.col("n_name"), "Text"))
    return table(spark, sf, "nation").select("n_nationkey", F.hex(coerce.to_binary(c)).alias("b"))


@query("select * from (values (1, 'NaN'), (2, 'inf'), (3, '2.5'), (4, null), (5, '00ff')) t(k, text)")
def f28_string_fallback(spark, sf):
    f = rows(spark, "k int, type string, value string", (1, "Float", "NaN"), (2, "Float", "Infinity"), (3, "Float", "2.5"), (4, "UnchangedToast", None), (5, "Bytes", "00ff"))
    return f.select("k", values.fallback_text(F.struct("type", "value")).alias("text"))


@query("""select event_id, case when event_id % 3 = 0 then strftime(ts, '%Y-%m-%d') when event_id % 3 = 1 then strftime(ts, '%Y-%m-%d %H:%M:%S') else strftime(ts, '%Y-%m-%d %H:%M:%S.%f') end as d,
case when event_id % 2 = 0 then '-' else '' end || (event_id % 40 * 24 + hour(ts)) || strftime(ts, ':%M:%S') as t from events""")
def f29_mysql_date(spark, sf):
    """Date and time texts of MySQL (also f30)."""
    ts, k = F.col("ts"), F.col("event_id") % 3
    zero = F.lit(0)
    kind = F.when(k == 0, "date").when(k == 1, "datetime").otherwise("datetime(6)")
    us = F.when(k == 2, F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(1_000_000))).otherwise(0).cast("int")
    part = lambda f: F.when(k == 0, zero).otherwise(f(ts))
    day = coerce.mysql_date(F.year(ts), F.month(ts), F.dayofmonth(ts), part(F.hour), part(F.minute), part(F.second), us, kind)
    time = coerce.mysql_time(F.col("event_id") % 2 == 0, F.col("event_id") % 40, F.hour(ts), F.minute(ts), F.second(ts), zero)
    return table(spark, sf, "events").select("event_id", day.alias("d"), time.alias("t"))


_STATEMENTS = [
    ("TRUNCATE TABLE users", "db", "users"), ("truncate table `shop`.`orders`;", "shop", "orders"), ("TRUNCATE items", "db", "items"),
    ("/* app */ TRUNCATE /* x */ TABLE t1 ;", "db", "t1"), ("TrUnCaTe TaBlE a.b", "a", "b"), ("INSERT INTO t VALUES (1)", None, None),
    ("/* TRUNCATE TABLE t", None, None), ("  truncate   table  `z` ; ", "db", "z"),
]


@query(_sql_rows(_STATEMENTS, '"sql", "schema", "table"'))
def s28_truncate_sql(spark, sf):
    """TRUNCATE statements, comments stripped (also f31)."""
    f = rows(spark, "sql string", *[(s,) for s, _, _ in _STATEMENTS]).withColumn("t", names.truncated_table(F.col("sql"), F.lit("db")))
    return f.select("sql", "t.schema", "t.table")


@query("select o_orderkey, 'bin:log.' || lpad(cast(o_orderkey % 97 as varchar), 6, '0') as file, case when o_orderkey % 9 <> 0 then o_orderkey end as position, o_orderkey % 9 <> 0 as good from orders")
def f32_mysql_offset(spark, sf):
    file = F.concat(F.lit("bin:log."), F.lpad((F.col("o_orderkey") % 97).cast("string"), 6, "0"))
    text = F.when(F.col("o_orderkey") % 9 != 0, lsn.mysql_offset_format(file, F.col("o_orderkey"))).otherwise(F.concat(file, F.lit(":x")))
    o = table(spark, sf, "orders").select("o_orderkey", file.alias("file"), lsn.mysql_offset_parse(text).alias("p"))
    return o.select("o_orderkey", F.coalesce("p.file", "file").alias("file"), F.col("p.position").alias("position"), F.col("p").isNotNull().alias("good"))


@query("""select c_custkey, '"' || replace(c_name, 'r', '""') || '"' as q, 'cdc_' || c_name as target from customer""")
def f33_quote(spark, sf):
    name = F.replace("c_name", F.lit("r"), F.lit('"'))
    return table(spark, sf, "customer").select("c_custkey", names.quote_identifier(name).alias("q"), names.target_name("cdc_", F.col("c_name")).alias("target"))


@query("select event_id, epoch_us(ts) as us from events")
def f34_pg_epoch(spark, sf):
    us = F.unix_micros(F.col("ts").cast("timestamp")) - lsn.PG_EPOCH_US
    return table(spark, sf, "events").select("event_id", lsn.pg_time_us(us).alias("us"))


@query("""select n_name, '' || n_name || chr(9) || 'a' || chr(10) || 'b\\c' || chr(13) || '\\x' as text from nation""")
def s05_copy_unescape(spark, sf):
    escaped = F.concat(F.col("n_name"), F.lit("\\ta\\nb\\\\c\\r\\x"))
    return table(spark, sf, "nation").select("n_name", names.unescape_copy(escaped).alias("text"))


@query("select n_nationkey, range(0, n_nationkey::bigint).len()::integer as n, case when n_nationkey > 0 then 'col_' || (n_nationkey - 1) end as last from nation")
def s30_fallback_names(spark, sf):
    cols = names.fallback_names(F.col("n_nationkey"))
    return table(spark, sf, "nation").select("n_nationkey", F.size(cols).alias("n"), F.get(cols, F.col("n_nationkey").cast("int") - 1).alias("last"))


@query("select n_name, case when n_nationkey % 2 = 0 then 'sales' else 'public' end as schema, n_name as table from nation")
def s32_table_names(spark, sf):
    name = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("sales."), F.col("n_name"))).otherwise(F.col("n_name"))
    return table(spark, sf, "nation").select("n_name", names.table_parts(name, "public").alias("p")).select("n_name", "p.schema", "p.table")


@query(_sql_rows([("postgresql://u%40x:p%2F1@h:5432/db", "mysql://root@m:3306/shop", "http://c/v1/w/namespaces/a\u001fb/tables/t", "http://c/v1/namespaces/a/tables/t")], "pg, my, prefixed, plain"))
def s33_urls(spark, sf):
    row = (names.connection_url("postgresql", "h", 5432, "u@x", "p/1", "db"), names.connection_url("mysql", "m", 3306, "root", None, "shop"), names.commit_url("http://c/", ["a", "b"], "t", "w"), names.commit_url("http://c", ["a"], "t"))
    return rows(spark, "pg string, my string, prefixed string, plain string", row)


_ST = [
    ("upsert", 'INSERT INTO "s"."t" ("id", "name") VALUES ($1::bigint, $2::text) ON CONFLICT ("id") DO UPDATE SET "name" = $2::text'),
    ("upsert_keys", 'INSERT INTO "s"."t" ("id") VALUES ($1::bigint) ON CONFLICT ("id") DO NOTHING'),
    ("delete", 'DELETE FROM "s"."t" WHERE "id" = $1::bigint AND "name" = $2::text'),
    ("table", 'CREATE TABLE IF NOT EXISTS "s"."t" ("id" bigint, "name" text, PRIMARY KEY ("id"))'),
    ("add", 'ALTER TABLE "s"."t" ADD COLUMN IF NOT EXISTS "x" date, ADD COLUMN IF NOT EXISTS "y" text'),
    ("drop", 'ALTER TABLE "s"."t" DROP COLUMN IF EXISTS "x"'),
    ("log", 'CREATE TABLE IF NOT EXISTS "s"."t" ("_cdc_op" text NOT NULL, "_cdc_lsn" bigint NOT NULL, "_cdc_timestamp_us" bigint NOT NULL, "_cdc_snapshot" boolean NOT NULL, "_cdc_schema" text NOT NULL, "_cdc_table" text NOT NULL, "_cdc_primary_key_columns" text NOT NULL, "id" bigint, "_old_id" bigint)'),
    ("insert", 'INSERT INTO "s"."t" ("_cdc_op", "_cdc_lsn", "_cdc_timestamp_us", "_cdc_snapshot", "_cdc_schema", "_cdc_table", "_cdc_primary_key_columns", "id", "_old_id") VALUES ($1::text, $2::bigint, $3::bigint, $4::boolean, $5::text, $6::text, $7::text, $8::bigint, $9::bigint)'),
]


@query(_sql_rows(_ST, "kind, statement"))
def k08_statements(spark, sf):
    """Statements for PostgreSQL targets (k04 to k08, e05, e06)."""
    kinds, t = {"id": "bigint", "name": "text"}, '"s"."t"'
    made = {
        "upsert": out.upsert_sql(t, ["id", "name"], ["id"], kinds), "upsert_keys": out.upsert_sql(t, ["id"], ["id"], kinds), "delete": out.delete_sql(t, ["id", "name"], kinds),
        "table": out.replication_ddl("s", "t", kinds, ["id"]), "add": out.add_columns_ddl("s", "t", {"x": "date", "y": "text"}), "drop": out.drop_columns_ddl("s", "t", ["x"]),
        "log": out.flattened_ddl("s", "t", {"id": "bigint"}), "insert": out.insert_sql(t, ["id"], kinds),
    }
    return rows(spark, "kind string, statement string", *made.items())


# schema evolution


def _wide_log(spark, sf):
    """Events whose images have a column that depends on ``props``."""
    log = change_log(spark, sf)
    k = F.get_json_object("props", "$.k").cast("long")
    name = F.concat(F.lit("c"), (k % 7).cast("string"))
    cells = F.map_from_arrays(F.array(F.lit("user_id"), name), F.array(cell(F.col("user_id"), "Int"), cell(k, "Int")))
    return log.select("seq", "op", F.when(F.col("op").isin("I", "U"), cells).alias("new"), F.when(F.col("op").isin("U", "D"), cells).alias("old"))


_KEYS = "LOG , k as (select seq, op, unnest(['user_id', 'c' || (cast(json_extract(props, '$.k') as bigint) % 7)]) as \"column\" from cl where op <> 'T')"


@query(_KEYS + " select \"column\", min(seq) as first_seq from k where \"column\" not in ('user_id', 'c0', 'c1') group by 1")
def e01_new_columns(spark, sf):
    return evolve.new_columns(_wide_log(spark, sf), ["user_id", "c0", "c1"])


@query("select * from (values (0, 'b'), (1, 'd')) t(place, \"column\")")
def e02_dropped(spark, sf):
    return rows(spark, "place int, column string", *enumerate(evolve.dropped_columns(["a", "b", "c", "d"], ["c", "a", "x"])))


_TARGET = ["_cdc_op", "user_id", "c3", "c9", "_old_c9", "c8"]


@query(_KEYS + """, t as (select unnest(['_cdc_op', 'user_id', 'c3', 'c9', '_old_c9', 'c8']) as "column")
select "column" from t where "column" not like '\\_cdc\\_%' escape '\\' and "column" not like '\\_old\\_%' escape '\\' and "column" not in (select "column" from k where op in ('I', 'U'))""")
def e03_drop_candidates(spark, sf):
    target = rows(spark, "column string", *[(c,) for c in _TARGET])
    return evolve.drop_candidates(_wide_log(spark, sf), target, flattened=True)


@query("select 'c8' as \"column\"")
def e04_confirmed_drops(spark, sf):
    target = rows(spark, "column string", *[(c,) for c in _TARGET])
    live = rows(spark, "column string", ("user_id",), ("c9",))
    return evolve.confirmed_drops(evolve.drop_candidates(_wide_log(spark, sf), target, flattened=True), live)


def _fields(spark, *versions):
    data = [(v, i, f.name, f.dataType.simpleString(), f.metadata["field_id"], f.nullable) for v, schema in versions for i, f in enumerate(schema)]
    return rows(spark, "version string, place int, name string, type string, field_id int, optional boolean", *data)


@query("""select * from (values ('base', 0, 'id', 'bigint', 1, false), ('base', 1, 'name', 'string', 2, true),
('added', 0, 'id', 'bigint', 1, false), ('added', 1, 'name', 'string', 2, true), ('added', 2, 'at', 'timestamp_ntz', 3, true), ('added', 3, 'n', 'decimal(10,2)', 4, true),
('dropped', 0, 'id', 'bigint', 1, false), ('dropped', 1, 'at', 'timestamp_ntz', 3, true), ('dropped', 2, 'n', 'decimal(10,2)', 4, true)) t(version, place, name, type, field_id, optional)""")
def e07_evolved_schema(spark, sf):
    """Replication schemas as columns come and go (e07, e09, e12)."""
    base = evolve.replication_schema({"id": "BigInt", "name": "Text"}, ["id"])
    added = evolve.add_columns(base, {"at": "Timestamp", "n": "Decimal(10,2)"})
    return _fields(spark, ("base", base), ("added", added), ("dropped", evolve.without_columns(added, ["name"])))


@query("""select * from (values ('added', 7, 'id', 'bigint', 8, true), ('added', 8, 'x', 'date', 10, true), ('added', 9, 'y', 'string', 12, true), ('added', 10, '_old_id', 'bigint', 9, true),
('added', 11, '_old_x', 'date', 11, true), ('added', 12, '_old_y', 'string', 13, true), ('dropped', 7, 'id', 'bigint', 8, true), ('dropped', 8, 'y', 'string', 12, true), ('dropped', 9, '_old_id', 'bigint', 9, true),
('dropped', 10, '_old_y', 'string', 13, true)) t(version, place, name, type, field_id, optional)""")
def e08_evolved_flattened(spark, sf):
    base = evolve.flattened_schema({"id": "BigInt"})
    added = evolve.add_columns(base, {"x": "Date", "y": "Text"}, flattened=True)
    return _fields(spark, ("added", added), ("dropped", evolve.without_columns(added, ["x"], flattened=True))).where("place >= 7")


@query("select * from (values ('first', 0, 2), ('same', 0, 2), ('second', 1, 3), ('back', 0, 3), ('again', 1, 3)) t(step, schema_id, last_field_id)")
def e10_schema_commits(spark, sf):
    log, out_ = evolve.SchemaLog(), []
    one = evolve.replication_schema({"id": "BigInt", "name": "Text"}, ["id"])
    two = evolve.add_columns(one, {"x": "Date"})
    for step, schema in (("first", one), ("same", one), ("second", two), ("back", one), ("again", two)):
        out_.append((step, log.commit(schema, log.current), log.last_field_id))
    return rows(spark, "step string, schema_id int, last_field_id int", *out_)

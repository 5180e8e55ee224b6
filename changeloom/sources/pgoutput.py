"""The logical replication stream of PostgreSQL (pgoutput, protocol 1).

Frames and messages are decoded in Arrow batches; everything that relates
messages to each other (transactions, relations, keys) is DataFrame work.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ProtocolError
from ..functions.coerce import cell_null, pg_cell
from ..functions.lsn import pg_time_us
from ..operators.ordered import last_known
from ..scratch import ship

TUPLE = "array<struct<kind:string,value:string>>"
COLUMNS = "array<struct<name:string,oid:long,is_key:boolean>>"
MESSAGE = (
    "seq long, kind string, lsn long, end_lsn long, pg_time_us long, xid long, rel_id long, schema string, table string, "
    f"columns {COLUMNS}, new {TUPLE}, old {TUPLE}, old_kind string, rel_ids array<long>"
)
_FIELDS = [x.split(" ")[0] for x in MESSAGE.replace(TUPLE, "t").replace(COLUMNS, "c").split(", ")]
#: Messages that carry no row change and are skipped.
SKIPPED = b"YOM"


class Reader:
    """Big-endian fields of a message."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ProtocolError("message ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, code: str) -> int:
        return struct.unpack(">" + code, self.take(struct.calcsize(code)))[0]

    def text(self) -> str:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise ProtocolError("string without end")
        out = self.take(end - self.at).decode()
        self.at += 1
        return out

    def row(self) -> list[dict]:
        """A tuple: n null, u unchanged, t text."""
        out = []
        for _ in range(self.number("h")):
            kind = self.take(1)
            if kind not in (b"n", b"u", b"t"):
                raise ProtocolError(f"unknown tuple field {kind!r}")
            value = self.take(self.number("i")).decode() if kind == b"t" else None
            out.append({"kind": kind.decode(), "value": value})
        return out


def signed(number: int) -> int:
    """A u64 as the long with the same bits."""
    return number - (1 << 64) if number >= 1 << 63 else number


def decode(data: bytes) -> dict | None:
    """Fields of one message; None for messages without row changes."""
    r = Reader(data)
    kind = r.take(1)
    out: dict = {"kind": kind.decode("latin-1")}
    if kind == b"B":
        out |= {"lsn": signed(r.number("Q")), "pg_time_us": r.number("q"), "xid": r.number("I")}
    elif kind == b"C":
        r.take(1)
        out |= {"lsn": signed(r.number("Q")), "end_lsn": signed(r.number("Q")), "pg_time_us": r.number("q")}
    elif kind == b"R":
        out |= {"rel_id": r.number("I"), "schema": r.text(), "table": r.text()}
        r.take(1)
        columns = []
        for _ in range(r.number("h")):
            flags = r.number("B")
            columns.append({"is_key": bool(flags & 1), "name": r.text(), "oid": r.number("I")})
            r.number("i")
        out["columns"] = columns
    elif kind in (b"I", b"U", b"D"):
        out["rel_id"] = r.number("I")
        part = r.take(1)
        if kind != b"I" and part in (b"K", b"O"):
            out |= {"old_kind": part.decode(), "old": r.row()}
            part = r.take(1) if kind == b"U" else b""
        if kind != b"D":
            if part != b"N":
                raise ProtocolError(f"expected a new tuple, found {part!r}")
            out["new"] = r.row()
        elif "old" not in out:
            raise ProtocolError(f"expected an old tuple, found {part!r}")
    elif kind == b"T":
        n = r.number("I")
        r.take(1)
        out["rel_ids"] = [r.number("I") for _ in range(n)]
    elif kind in [bytes([x]) for x in SKIPPED]:
        return None
    else:
        raise ProtocolError(f"unknown message {kind!r}")
    return out


def frame(data: bytes) -> dict:
    """A replication frame: w (data), k (keepalive) or c (end)."""
    r = Reader(data)
    kind = r.take(1)
    if kind == b"w":
        return {"kind": "w", "start": signed(r.number("Q")), "end": signed(r.number("Q")), "time": r.number("q"), "data": r.data[r.at :]}
    if kind == b"k":
        return {"kind": "k", "end": signed(r.number("Q")), "time": r.number("q"), "reply": r.number("B") == 1}
    if kind == b"c":
        return {"kind": "c"}
    raise ProtocolError(f"unknown frame {kind!r}")


def status_update(lsn: int, pg_time_us: int, reply: bool = False) -> bytes:
    """Standby status: written, flushed and applied up to ``lsn``."""
    n = lsn % (1 << 64)
    return b"r" + struct.pack(">QQQqB", n, n, n, pg_time_us, reply)


def start_replication(slot: str, lsn: str, publications: list[str]) -> str:
    names = ",".join(publications).replace("'", "''")
    name = slot.replace('"', '""')
    return f"START_REPLICATION SLOT \"{name}\" LOGICAL {lsn} (proto_version '1', publication_names '{names}')"


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    field = pa.struct([("kind", pa.string()), ("value", pa.string())])
    column = pa.struct([("name", pa.string()), ("oid", pa.int64()), ("is_key", pa.bool_())])
    kinds = {"kind": pa.string(), "schema": pa.string(), "table": pa.string(), "old_kind": pa.string(), "columns": pa.list_(column), "new": pa.list_(field), "old": pa.list_(field), "rel_ids": pa.list_(pa.int64())}
    for batch in batches:
        rows = []
        for seq, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if (message := decode(data)) is not None:
                rows.append({"seq": seq} | message)
        arrays = [pa.array([r.get(f) for r in rows], kinds.get(f, pa.int64())) for f in _FIELDS]
        yield pa.RecordBatch.from_arrays(arrays, _FIELDS)


def messages(raw: DataFrame) -> DataFrame:
    """Decoded messages of (seq, data)."""
    ship(raw.sparkSession)
    return raw.select("seq", "data").mapInArrow(_messages, MESSAGE)


def _image(cells: str):
    """Named cells of a tuple, with the columns of its relation."""
    named = F.zip_with(F.col("rel.columns"), F.col(cells), lambda c, v: F.struct(c["name"].alias("key"), _cell(c, v).alias("value")))
    return F.when(F.col(cells).isNotNull(), F.map_from_entries(named))


def _cell(column, field):
    unchanged = F.struct(F.lit("UnchangedToast").alias("type"), F.lit(None).cast("string").alias("value"))
    return F.when(field["kind"] == "n", cell_null()).when(field["kind"] == "u", unchanged).otherwise(pg_cell(field["value"], column["oid"]))


def events(decoded: DataFrame, primary_keys: DataFrame | None = None, span: int = 100_000, flags: bool = False) -> DataFrame:
    """Change events of decoded messages, in the envelope's layout.

    The messages are read several times: give a written table (``scratch.written``)
    or they are decoded as often.  ``flags`` adds ``flag_pk``, the keys by the
    relation's flags, beside those of ``primary_keys``.

    Each change takes the transaction of the last Begin and the last definition
    of its relation before it.  ``primary_keys`` (rel_id, pk) overrides the key
    flags of relations.  A tuple whose width differs from its relation's, or a
    change outside a transaction, fails the query.
    """
    begin = F.when(F.col("kind") == "B", F.struct("lsn", "pg_time_us", "xid"))
    log = last_known(decoded, F.when(F.col("kind").isin("B", "C"), F.coalesce(begin, F.struct(*[F.lit(-1).cast("long").alias(x) for x in ("lsn", "pg_time_us", "xid")]))), "tx", span=span)
    each = log.where(F.col("kind").isin("I", "U", "D", "T", "R"))
    each = each.withColumn("target", F.explode(F.coalesce("rel_ids", F.array("rel_id"))))
    relation = F.when(F.col("kind") == "R", F.struct(F.col("schema"), F.col("table"), F.col("columns")))
    ordered = last_known(each, relation, "rel", by=["target"], span=span).where(F.col("kind") != "R")
    fail = lambda bad, text: F.when(bad, F.raise_error(F.lit(text)).cast("string"))
    wide = lambda side: F.col(side).isNotNull() & (F.size(side) != F.size("rel.columns"))
    checked = ordered.withColumn(
        "op",
        F.coalesce(
            fail(F.col("tx").isNull() | (F.col("tx.xid") < 0), "change outside a transaction"),
            fail(F.col("rel").isNull(), "change of an unknown relation"),
            fail(wide("new") | wide("old"), "tuple does not match its relation"),
            F.col("kind"),
        ),
    )
    flagged = F.transform(F.filter("rel.columns", lambda c: c["is_key"]), lambda c: c["name"])
    pk, more = flagged, [flagged.alias("flag_pk")] if flags else []
    if primary_keys is not None:
        known = primary_keys.select(F.col("rel_id").alias("target"), F.col("pk").alias("_pk"))
        checked = checked.join(known, "target", "left")
        pk = F.coalesce("_pk", flagged)
    return checked.select(
        "seq", F.col("tx.lsn").alias("lsn"), pg_time_us(F.col("tx.pg_time_us")).alias("timestamp_us"), F.col("tx.xid").alias("xid"),
        F.col("rel.schema").alias("schema"), F.col("rel.table").alias("table"), F.col("target").alias("oid"), "op",
        pk.alias("pk"), _image("new").alias("new"), _image("old").alias("old"), *more,
    )


def publication_difference(wanted: DataFrame, published: DataFrame) -> DataFrame:
    """(table, problem): what a publication misses and what it has beyond the wanted tables."""
    missing = wanted.select("table").exceptAll(published.select("table")).withColumn("problem", F.lit("missing"))
    return missing.unionByName(published.select("table").exceptAll(wanted.select("table")).withColumn("problem", F.lit("extra")))


# building messages, for tests and generated logs


def begin(lsn: int, pg_time_us: int, xid: int) -> bytes:
    return b"B" + struct.pack(">QqI", lsn, pg_time_us, xid)


def commit(lsn: int, end_lsn: int, pg_time_us: int) -> bytes:
    return b"C" + struct.pack(">BQQq", 0, lsn, end_lsn, pg_time_us)


def relation(rel_id: int, schema: str, table: str, columns: list[tuple[str, int, bool]]) -> bytes:
    body = b"".join(struct.pack(">B", key) + name.encode() + b"\0" + struct.pack(">Ii", oid, -1) for name, oid, key in columns)
    return b"R" + struct.pack(">I", rel_id) + schema.encode() + b"\0" + table.encode() + b"\0d" + struct.pack(">h", len(columns)) + body


UNCHANGED = object()


def row(values: list) -> bytes:
    out = struct.pack(">h", len(values))
    for v in values:
        if v is None or v is UNCHANGED:
            out += b"n" if v is None else b"u"
        else:
            raw = str(v).encode()
            out += b"t" + struct.pack(">i", len(raw)) + raw
    return out


def change(kind: str, rel_id: int, new: list | None = None, old: list | None = None, key_only: bool = False) -> bytes:
    head = kind.encode() + struct.pack(">I", rel_id)
    if old is not None:
        head += (b"K" if key_only else b"O") + row(old)
    return head + (b"N" + row(new) if new is not None else b"")


def truncate(rel_ids: list[int]) -> bytes:
    return b"T" + struct.pack(">IB", len(rel_ids), 0) + b"".join(struct.pack(">I", x) for x in rel_ids)

"""WARC archives: a writer with revisit records, and a reader that salvages.

Writing.  Each record is a gzip member of its own; a task writes archives of
about ``roll_bytes`` to a temporary name and renames them when complete.  Rows are
sorted inside partitions by all that a record holds, so a task that runs again, or
twice at once, rolls at the same rows and replaces whole files by the same bytes.
(In stores without atomic renames a reader should wait for the manifest.)  A payload of
``min_revisit`` bytes or more that several pages share is written once, with the
smallest page id; the other pages get revisit records that refer to it.

Reading.  A record must pass its checks: the version line, the header, the content
length, the blank lines after the block, and the payload's SHA-256.  After a
failed check the reader searches for the next version line from which a record
can be read, in the decoded bytes of the same gzip member or in a plain archive,
goes on from there, and logs the bytes in between as a quarantined gap.  A member
that is cut or damaged gives the records in front of the damage and a gap; if its
deflate data or CRC is bad, a stated SHA-256 or SHA-1 must confirm each payload,
and what has no payload, revisits, goes by its header alone (the gap with the same
offset marks such records).  Behind it the reader goes on at the next member or
version line that gives a record.  Archives are read through Spark's binary file source, which opens whatever stores Spark can;
an archive is one row there, so foreign archives must be smaller than 2 GB.

Defined results: a null payload counts as empty; null and repeated page ids are
written like others (of equal payloads the smallest id that is not null is the
response, and if its row is repeated, each of its rows is one); an empty table
gives an empty folder; a damaged archive never fails the read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, quoted, ship, whole_text

MIN_REVISIT = 100
ROLL_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"
VERSION = b"WARC/1."
HEADER_END = re.compile(rb"\r\n\r\n|\nWARC/1\.")
GZIP = b"\x1f\x8b\x08"
CUT = "truncated member"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = (
    "archive string, offset long, length long, kind string, reason string, record_type string, record_id string, page_id string, "
    "target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"
)


def record(page_id, url, payload: bytes, digest: str, first, size: int) -> bytes:
    """One WARC record, not compressed; ``first`` is the page a revisit refers to."""
    ident = "<urn:page:{}>".format
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if first is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: {ident(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if first is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {ident(first)}", f"X-Refers-To-Page: {first}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _written(folder: str, roll_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid
        import zlib

        from pyarrow import fs
        from pyspark import TaskContext

        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        part, done = TaskContext.get().partitionId(), []
        out, temp, size, count = None, "", 0, 0

        def close():
            nonlocal out
            out.close()
            final = f"{top}/part-{part:06d}-{len(done):05d}.warc.gz"
            store.move(temp, final)
            done.append((final, count, size))
            out = None

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page_id, url, payload, digest, first, n = row
                if out is None:
                    temp, size, count = f"{top}/_{part:06d}-{uuid.uuid4().hex}.tmp", 0, 0
                    out = store.open_output_stream(temp)
                member = zlib.compressobj(level, zlib.DEFLATED, 31)
                raw = member.compress(record(page_id, url, payload or b"", digest, first, n)) + member.flush()
                out.write(raw)
                size, count = size + len(raw), count + 1
                if size >= roll_bytes:
                    close()
        if out is not None:
            close()
        names, counts, sizes = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["archive", "records", "bytes"]
        )

    return run


def write_warc(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_revisit: int = MIN_REVISIT,
    roll_bytes: int = ROLL_BYTES,
    level: int = 6,
) -> DataFrame:
    """Write all pages as archives in ``folder``; the manifest: archive, records, bytes."""
    spark = pages.sparkSession
    ship(spark)
    scratch = Scratch(spark, "warc")
    payload = whole_text(payload_col).cast("binary")
    rows = pages.select(
        F.col(quoted(id_col)).alias("page_id"),
        F.col(quoted(url_col)).cast("string").alias("url"),
        F.unhex(F.sha2(payload, 256)).alias("digest"),
        F.octet_length(payload).cast("long").alias("n"),
        payload.alias("payload"),
    )
    # of shared payloads only, found by counts that are aggregated map-side
    shared = (
        rows.where(F.col("n") >= min_revisit)
        .groupBy("digest")
        .agg(F.count("*").alias("copies"), F.min("page_id").alias("first"))
        .where("copies > 1 and first is not null")
        .select("digest", "first")
    )
    shared = scratch.keep(shared, "shared")
    folder_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    folder_path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder_path)
    marked = rows.join(shared, "digest", "left")
    first = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).cast("string")
    marked = marked.select(
        F.col("page_id").cast("string").alias("page_id"),
        "url",
        F.when(first.isNull(), F.col("payload")).alias("payload"),
        F.lower(F.hex("digest")).alias("digest"),
        first.alias("first"),
        "n",
    )
    marked = marked.sortWithinPartitions("page_id", "digest", "first", "url", "n")
    manifest = marked.mapInArrow(_written(folder, roll_bytes, level), "archive string, records long, bytes long")
    return scratch.keep(manifest, "manifest")


class Damaged(ValueError):
    """A check of a record failed."""


class _Zeros:
    """The next zero byte of some data, found once for all places before it."""

    def __init__(self, data):
        self.data, self.asked, self.found = data, len(data) + 1, -1

    def after(self, at: int) -> int:
        if at < self.asked or 0 <= self.found < at:
            self.asked, self.found = at, self.data.find(b"\0", at)
        return self.found


def _has_header(data, at: int, zeros: _Zeros) -> bool:
    """Whether a gzip header at ``at`` ends inside the data, so that false marks cost no search through all of it."""
    flags = data[at + 3] if at + 10 <= len(data) else 0xE0
    if flags & 0xE0:
        return False
    at += 10
    if flags & 4:
        at += 2 + int.from_bytes(data[at : at + 2], "little")
    for named in (8, 16):
        if flags & named:
            if (zero := zeros.after(at)) < 0:
                return False
            at = zero + 1
    return at < len(data)


def _member(data, at: int) -> tuple[bytes, int, str | None]:
    """What decodes of the gzip member at ``at``, where it or its decoding ends, and its damage, if any."""
    import zlib

    unpack, parts, end = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof:
            if end >= len(data):
                return b"".join(parts), end, CUT
            chunk = bytes(data[end : end + 65536])
            parts.append(unpack.decompress(chunk))
            end += len(chunk) - len(unpack.unused_data)
    except zlib.error as e:
        return *_up_to_damage(data, at), f"bad member: {e}"
    return b"".join(parts), end, None


def _up_to_damage(data, at: int) -> tuple[bytes, int]:
    """What decodes of a member that does not decode in full, in ever smaller steps, and where that ends."""
    import zlib

    unpack, parts, step = zlib.decompressobj(31), [], 65536
    while step and at < len(data):
        trial = unpack.copy()
        try:
            parts.append(trial.decompress(bytes(data[at : at + step])))
            unpack, at = trial, at + step
        except zlib.error:
            step //= 16
    return b"".join(parts), at


def parse_record(raw: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """(headers, block, end) of the record at ``at``."""
    if raw[at : at + len(VERSION)] != VERSION or raw.find(b"\r\n", at, at + 16) < 0:
        raise Damaged("no version line")
    close = HEADER_END.search(raw, at)  # a header may be of any length, but ends before another version line
    if close is None or close[0] != b"\r\n\r\n":
        raise Damaged("header without end")
    head_end = close.start()
    headers = {}
    for line in raw[at:head_end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("bad header line")
        headers[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch("[0-9]{1,18}", headers.get("content-length", "")):
        raise Damaged("no content length")
    if not re.fullmatch("[0-9]{0,18}", headers.get("x-payload-length", "")):
        raise Damaged("bad payload length")
    start = head_end + 4
    end = start + int(headers["content-length"])
    if raw[end : end + 4] != b"\r\n\r\n":
        raise Damaged("block does not end at its length")
    return headers, raw[start:end], end + 4


def _checked(headers: dict, block: bytes) -> tuple[bytes | None, str | None]:
    """(payload, its digest) of a record whose payload matches its digest."""
    import hashlib

    stated = headers.get("warc-payload-digest", "").lower().removeprefix("sha256:") or None
    if headers.get("warc-type") == "revisit":
        return None, stated
    payload = block
    if headers.get("content-type", "").startswith("application/http"):
        if (cut := block.find(b"\r\n\r\n")) < 0:
            raise Damaged("HTTP header without end")
        payload = block[cut + 4 :]
    digest = hashlib.sha256(payload).hexdigest()
    if stated and re.fullmatch("[0-9a-f]{64}", stated) and stated != digest:
        raise Damaged("payload does not match its digest")
    return payload, digest


def _vouched(headers: dict, block: bytes, payload: bytes | None) -> bool:
    """Whether a stated digest confirms a record of a member that does not decode in full; a revisit has no payload."""
    import base64
    import hashlib

    if payload is None:
        return True
    for name, content in (("warc-payload-digest", payload), ("warc-block-digest", block)):
        kind, _, stated = headers.get(name, "").lower().rpartition(":")
        if (kind or "sha256") in ("sha1", "sha256"):
            digest = hashlib.new(kind or "sha256", content).digest()
            if stated in (digest.hex(), base64.b32encode(digest).decode().lower()):
                return True
    return False


def _inside(raw: bytes, damage: str | None) -> Iterator[tuple]:
    """(headers, payload, digest) of records in a member's decoded bytes, and (begin, reason) of what lies between."""

    def read(at: int) -> tuple[tuple, int]:
        headers, block, end = parse_record(raw, at)
        payload, digest = _checked(headers, block)
        if damage not in (None, CUT) and not _vouched(headers, block, payload):
            raise Damaged("no digest confirms the record")
        return (headers, payload, digest), end

    at, begin, reason = 0, 0, None
    while 0 <= at < len(raw):
        try:
            found, end = read(at)
        except Damaged as e:
            begin, reason = (at, str(e)) if reason is None else (begin, reason)
            at = raw.find(VERSION, at + 1)
            continue
        if reason is not None:
            yield begin, reason
        yield found
        at, reason = end, None
    if damage is not None:
        yield begin if reason is not None else len(raw), damage
    elif reason is not None:
        yield begin, reason


def _next_start(data, at: int, plain_from: int, zeros: _Zeros) -> int:
    """The next place at or after ``at`` (in plain text: ``plain_from``) where a record can be read, or the end."""
    packed = plain = -2
    while True:
        if packed != -1 and packed < at:
            packed = data.find(GZIP, at)
        if plain != -1 and plain < max(at, plain_from):
            plain = data.find(VERSION, max(at, plain_from))
        places = [x for x in (packed, plain) if x >= 0]
        if not places:
            return len(data)
        at = min(places)
        try:
            if at == packed:
                if _has_header(data, at, zeros):
                    raw, _, damage = _member(data, at)
                    if any(len(x) == 3 for x in _inside(raw, damage)):
                        return at
            else:
                headers, block, _ = parse_record(data, at)
                _checked(headers, block)
                return at
        except Damaged:
            pass
        at += 1


def salvage(data: bytes) -> Iterator[tuple]:
    """(offset, length, headers, payload, digest) of records and (offset, length, reason) of gaps.

    What is found inside a gzip member has the member's offset and length.
    """
    at, zeros = 0, _Zeros(data)
    while at < len(data):
        if data[at : at + 3] == GZIP:
            raw, end, damage = _member(data, at)
            if damage is not None:
                end = _next_start(data, at + 1, end, zeros)
            for found in _inside(raw, damage):
                if len(found) == 3:
                    yield at, end - at, *found
                else:
                    yield at, end - at, f"{found[1]}, from byte {found[0]} of the member"
        else:
            try:
                headers, block, end = parse_record(data, at)
                found = (headers, *_checked(headers, block))
            except Damaged as e:
                end = _next_start(data, at + 1, at + 1, zeros)
                found = (str(e),)
            yield at, end - at, *found
        at = end


def _records(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        types = [{"long": pa.int64(), "binary": pa.binary()}.get(x.split()[1], pa.string()) for x in RECORDS.split(", ")]

        def flush(rows):
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, size = [], 0
                for found in salvage(content.as_py()):
                    if len(found) == 3:
                        rows.append((path.as_py(), found[0], found[1], "gap", found[2], *[None] * 8))
                        continue
                    at, length, h, payload, digest = found
                    n = len(payload) if payload is not None else int(h.get("x-payload-length") or 0)
                    rows.append((path.as_py(), at, length, "record", None, h.get("warc-type"), h.get("warc-record-id"), h.get("x-page-id"), h.get("warc-target-uri"), h.get("x-refers-to-page"), n, digest, payload if with_payload else None))
                    size += n * with_payload + 1000
                    if size > 8 << 20:
                        yield flush(rows)
                        rows, size = [], 0
                yield flush(rows)

    return run


def read_warc(spark: SparkSession, folder: str, pattern: str = "*.warc*", with_payload: bool = True) -> DataFrame:
    """Records and quarantined gaps (``kind``) of all archives in ``folder``, with the columns of RECORDS.

    Revisit records give the length and digest of the payload they refer to.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "content").mapInArrow(_records(with_payload), RECORDS)

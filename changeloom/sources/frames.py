"""Recorded replication frames as a stream: the way a server's stream would come.

``FrameSource`` registers the format ``replication_frames``.  A recording is a
folder of files, named in order, each a run of frames with their length before
them (4 bytes, big-endian).  Rows are (seq, wal_end, data), one for each data
frame; keepalives move the position, an end frame ends the recording.  ``seq`` is
the frame's number over all files, so files are counted once, when they appear.
A task reads a run of files, so many small files are not as many tasks.

A stream starts behind the position ``start`` (``0/16B3748``): of a commit that
ends at or before it nothing is read again.  What a sink has taken is confirmed by
standby status messages that are appended to a file, where a connection would send
them: by ``Feedback`` as the offset store of a pipeline, right after each batch, or
by the option ``feedback`` when Spark commits a batch, which is as the next begins.

A recording is a path or a URI (``sources.files``) that all machines can open;
``feedback`` is a file of the driver's machine.
"""

from __future__ import annotations

import os
import struct
import uuid
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..errors import ProtocolError
from . import files, pgoutput

FIELDS = "seq long, wal_end long, data binary"
#: Fixed value: bytes of a standby status message.
STATUS = 34
#: Bytes of each kind of frame without its data, and where its position is.
HEADS, ENDS = {b"w": 25, b"k": 18, b"c": 1}, {b"w": 9, b"k": 1}
#: Bytes that are read at once; rows of a batch; bytes of a task: this many tasks, unless they get smaller or larger than that.
BLOCK, ROWS, TASKS, LEAST, MOST = 1 << 22, 4096, 64, 1 << 18, 1 << 24
_SIZE, _END = struct.Struct(">I"), struct.Struct(">Q")


def record(frames: list[bytes]) -> bytes:
    """The bytes of a recording's file."""
    return b"".join(struct.pack(">I", len(f)) + f for f in frames)


def data_frame(start: int, end: int, at: int, data: bytes) -> bytes:
    return b"w" + struct.pack(">QQq", start, end, at) + data


def keepalive(end: int, at: int, reply: bool = False) -> bytes:
    return b"k" + struct.pack(">QqB", end, at, reply)


def write_recording(stream, folder: str, per_file: int = 1000, first: int = 0) -> int:
    """Write the frames of a connection's stream (an iterator of bytes) to files; how many files there are then.

    A file gets its name when it is whole, so a reader never sees a part of one.
    """
    block, number = [], first

    def close():
        nonlocal block, number
        temporary = os.path.join(folder, f"_{number:010d}.tmp")
        with open(temporary, "wb") as f:
            f.write(record(block))
        os.replace(temporary, os.path.join(folder, f"{number:010d}.frames"))
        block, number = [], number + 1

    for one in stream:
        block.append(one)
        if len(block) >= per_file:
            close()
    if block:
        close()
    return number


def position(text: str) -> int:
    """The number of a position ``XX/YY``."""
    high, _, low = text.partition("/")
    try:
        return int(high, 16) << 32 | int(low, 16)
    except ValueError as e:
        raise ProtocolError(f"bad position {text!r}") from e


def write_groups(messages: DataFrame, folder: str, later: str, cut: int) -> int:
    """Write the recording of (part, seq, end, data): a file for each part, behind a keepalive; how many files there are.

    The tasks write the files, each under its name once it is whole: in ``folder``, those
    of parts after ``cut`` in ``later``.
    """

    def write(key, table):
        (part,) = (k.as_py() for k in key)
        rows = table.sort_by("seq")
        made = [data_frame(1, end or 1, 0, data) for end, data in zip(rows["end"].to_pylist(), rows["data"].to_pylist(), strict=True)]
        top = folder if part <= cut else later
        temporary = os.path.join(top, f"_{part:010d}-{uuid.uuid4().hex}.tmp")
        with open(temporary, "wb") as f:
            f.write(record([keepalive(1, 0), *made]))
        os.replace(temporary, os.path.join(top, f"{part:010d}.frames"))
        return pa.table({"part": pa.array([part], pa.int64())})

    return messages.select("part", "seq", "end", "data").groupBy("part").applyInArrow(write, "part long").count()


def _bodies(top: str, name: str):
    """The frames of one file as bytes, up to its end or an end frame."""
    with files.opened(top, name) as f:
        rest, missing = b"", 0
        while block := f.read(max(BLOCK, missing)):
            raw, at = rest + block if rest else block, 0
            while (has := len(raw) - at - 4) >= 0 and has >= (size := _SIZE.unpack_from(raw, at)[0]):
                body = raw[at + 4 : at + 4 + size]
                if len(body) < HEADS.get(body[:1], 1 << 32):
                    pgoutput.frame(body)  # says what is wrong
                if body[:1] == b"c":
                    return
                yield body
                at += 4 + size
            rest, missing = raw[at:], size - has if has >= 0 else 0
        if rest:
            raise ProtocolError(f"{name} ends inside a frame")


def frames_of(top: str, name: str):
    """Decoded frames of one file, up to its end or an end frame."""
    return map(pgoutput.frame, _bodies(top, name))


class _Files(InputPartition):
    """A run of files; ``first`` is the number of its first frame."""

    def __init__(self, top: str, names: list[str], first: int, start: int):
        self.top, self.names, self.first, self.start = top, names, first, start


class _Recording:
    def __init__(self, schema, options):
        self.top, self.start = options["path"], position(options.get("start", "0/0"))
        self.feedback = options.get("feedback")
        self.sizes: dict[str, tuple[int, int]] = {}

    def files(self) -> list[str]:
        return files.names(self.top, ".frames")

    def size(self, name: str) -> tuple[int, int]:
        """How many data frames a file has, and the position that it reaches."""
        if name not in self.sizes:
            n, end = 0, 0
            for body in _bodies(self.top, name):
                kind = body[:1]
                n, end = n + (kind == b"w"), max(end, _END.unpack_from(body, ENDS[kind])[0])
            self.sizes[name] = (n, end)
        return self.sizes[name]

    def parts(self, after: str = "", last: str | None = None) -> list[_Files]:
        """Tasks for the files behind ``after``, up to ``last``."""
        known = {n: size for n, size in files.sizes(self.top, ".frames").items() if last is None or n <= last}
        total = sum(size for n, size in known.items() if n > after)
        most = min(max(total // TASKS, LEAST), MOST)
        out, first, held = [], 0, 0
        for name, size in known.items():
            if name > after:
                if not out or held + size > most:
                    out.append(_Files(self.top, [], first, self.start))
                    held = 0
                out[-1].names.append(name)
                held += size
            first += self.size(name)[0]
        return out

    def read(self, part: _Files):
        every = (b for name in part.names for b in _bodies(part.top, name) if b[:1] == b"w")
        first = part.first
        while block := [*islice(every, ROWS)]:
            ends = [_END.unpack_from(b, ENDS[b"w"])[0] for b in block]
            taken = [i for i, end in enumerate(ends) if end > part.start]
            columns = [first + i for i in taken], [pgoutput.signed(ends[i]) for i in taken], [block[i][HEADS[b"w"] :] for i in taken]
            kinds = (pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["seq", "wal_end", "data"])
            first += len(block)


class _Batch(_Recording, DataSourceReader):
    def partitions(self):
        return self.parts()


class _Stream(_Recording, DataSourceStreamReader):
    def initialOffset(self):  # noqa: N802
        return {"file": ""}

    def latestOffset(self):  # noqa: N802
        return {"file": (self.files() or [""])[-1]}

    def partitions(self, start, end):
        return self.parts(start["file"], end["file"])

    def commit(self, end):
        """The sink has all up to ``end``: confirm the position that it reached."""
        if self.feedback and end["file"]:
            reached = max(self.size(n)[1] for n in self.files() if n <= end["file"])
            with open(self.feedback, "ab") as f:
                f.write(pgoutput.status_update(reached, 0))


class Feedback:
    """An offset store that confirms positions (WAL ends, as numbers) to a server."""

    def __init__(self, path: str):
        self.path = path

    def load(self) -> str | None:
        try:
            with open(self.path, "rb") as f:
                return str(int.from_bytes(f.read()[-STATUS:][1:9], "big"))
        except FileNotFoundError:
            return None

    def save(self, offset: str) -> None:
        with open(self.path, "ab") as f:
            f.write(pgoutput.status_update(int(offset), 0))
            f.flush()
            os.fsync(f.fileno())


class FrameSource(DataSource):
    @classmethod
    def name(cls):
        return "replication_frames"

    def schema(self):
        return FIELDS

    def reader(self, schema):
        return _Batch(schema, self.options)

    def streamReader(self, schema):  # noqa: N802
        return _Stream(schema, self.options)

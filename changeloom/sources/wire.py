"""The client side of PostgreSQL's protocol, version 3, as far as replication needs it.

Messages after the startup are a letter, a length that counts itself, and a body.
``Connection`` speaks over any object with ``sendall`` and ``recv``, logs in (trust,
cleartext, MD5, SCRAM-SHA-256), runs simple queries, and opens the replication
stream.  One connection serves one driver; reading the stream's frames into files
(``sources.frames``) makes them a Spark source.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import os
import socket
import struct
from collections.abc import Iterator

from ..errors import PostgresError
from .pgoutput import start_replication, status_update

#: Protocol version 3.0, and how a server asks for a login.
VERSION = 196608
TRUSTED, CLEARTEXT, MD5, SASL, SASL_CONTINUE, SASL_FINAL = 0, 3, 5, 10, 11, 12
MECHANISM = "SCRAM-SHA-256"


def message(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack(">I", len(body) + 4) + body


def startup(user: str, database: str, **options: str) -> bytes:
    pairs = {"user": user, "database": database, "replication": "database"} | options
    body = struct.pack(">I", VERSION) + b"".join(k.encode() + b"\0" + v.encode() + b"\0" for k, v in pairs.items()) + b"\0"
    return struct.pack(">I", len(body) + 4) + body


def error_text(body: bytes) -> str:
    """Severity, code and message of an error response."""
    fields = {f[:1]: f[1:].decode("utf-8", "replace") for f in body.split(b"\0") if f}
    return f"{fields.get(b'S', 'ERROR')} {fields.get(b'C', '')}: {fields.get(b'M', '')}"


def data_row(body: bytes) -> list[str | None]:
    """Text values of a row; a length of -1 is null."""
    n, at, out = struct.unpack_from(">h", body)[0], 2, []
    for _ in range(n):
        size = struct.unpack_from(">i", body, at)[0]
        at += 4
        out.append(None if size < 0 else body[at : at + size].decode())
        at += max(size, 0)
    return out


def sasl_mechanisms(body: bytes) -> list[str]:
    return [m.decode() for m in body.split(b"\0") if m]


def md5_password(user: str, password: str, salt: bytes) -> str:
    inner = hashlib.md5((password + user).encode()).hexdigest()
    return "md5" + hashlib.md5(inner.encode() + salt).hexdigest()


class Scram:
    """The client of SCRAM-SHA-256 without channel binding (RFC 5802, RFC 7677)."""

    def __init__(self, password: str, user: str = "", nonce: str | None = None):
        self.password, self.nonce = password, nonce or base64.b64encode(os.urandom(18)).decode()
        self.bare = f"n={user},r={self.nonce}"
        self.expected = b""

    def first(self) -> str:
        return f"n,,{self.bare}"

    def final(self, challenge: str) -> str:
        """The answer to the server's first message."""
        given = dict(part.split("=", 1) for part in challenge.split(","))
        if not given["r"].startswith(self.nonce):
            raise PostgresError("the server answered with another nonce")
        salted = hashlib.pbkdf2_hmac("sha256", self.password.encode(), base64.b64decode(given["s"]), int(given["i"]))
        sign = lambda key, text: hmac.new(key, text, "sha256").digest()
        key = sign(salted, b"Client Key")
        bare = f"c=biws,r={given['r']}"
        whole = f"{self.bare},{challenge},{bare}".encode()
        proof = bytes(a ^ b for a, b in zip(key, sign(hashlib.sha256(key).digest(), whole), strict=True))
        self.expected = sign(sign(salted, b"Server Key"), whole)
        return f"{bare},p={base64.b64encode(proof).decode()}"

    def verify(self, last: str) -> None:
        given = dict(part.split("=", 1) for part in last.split(","))
        if base64.b64decode(given.get("v", "")) != self.expected:
            raise PostgresError("the server's signature is wrong")


class Connection:
    def __init__(self, link, user: str, database: str, password: str | None = None):
        self.link, self.user, self.password = link, user, password or ""
        self.waiting = b""
        link.sendall(startup(user, database))
        self._log_in()

    @classmethod
    def open(cls, host: str, port: int, user: str, database: str, password: str | None = None, timeout: float = 30) -> Connection:
        return cls(socket.create_connection((host, port), timeout), user, database, password)

    def _take(self, n: int) -> bytes:
        while len(self.waiting) < n:
            more = self.link.recv(65536)
            if not more:
                raise PostgresError("the server closed the connection")
            self.waiting += more
        out, self.waiting = self.waiting[:n], self.waiting[n:]
        return out

    def receive(self) -> tuple[bytes, bytes]:
        """(kind, body) of the next message; errors raise, notices are passed over."""
        while True:
            kind, size = struct.unpack(">cI", self._take(5))
            body = self._take(size - 4)
            if kind == b"E":
                raise PostgresError(error_text(body))
            if kind != b"N":
                return kind, body

    def _log_in(self) -> None:
        scram = Scram(self.password)
        while True:
            kind, body = self.receive()
            if kind == b"Z":
                return
            if kind != b"R":
                continue  # parameters and the key for cancelling
            how, rest = struct.unpack_from(">I", body)[0], body[4:]
            if how == CLEARTEXT:
                self.link.sendall(message(b"p", self.password.encode() + b"\0"))
            elif how == MD5:
                self.link.sendall(message(b"p", md5_password(self.user, self.password, rest[:4]).encode() + b"\0"))
            elif how == SASL:
                if MECHANISM not in sasl_mechanisms(rest):
                    raise PostgresError("the server offers no login that is known here")
                first = scram.first().encode()
                self.link.sendall(message(b"p", MECHANISM.encode() + b"\0" + struct.pack(">I", len(first)) + first))
            elif how == SASL_CONTINUE:
                self.link.sendall(message(b"p", scram.final(rest.decode()).encode()))
            elif how == SASL_FINAL:
                scram.verify(rest.decode())
            elif how != TRUSTED:
                raise PostgresError(f"login of kind {how} is not known here")

    def query(self, sql: str) -> list[list[str | None]]:
        """Rows of a simple query."""
        self.link.sendall(message(b"Q", sql.encode() + b"\0"))
        rows = []
        while (found := self.receive())[0] != b"Z":
            if found[0] == b"D":
                rows.append(data_row(found[1]))
        return rows

    def replicate(self, slot: str, lsn: str, publications: list[str]) -> Iterator[bytes]:
        """Frames of the replication stream, until the server ends it."""
        self.link.sendall(message(b"Q", start_replication(slot, lsn, publications).encode() + b"\0"))
        while True:
            kind, body = self.receive()
            if kind == b"d":
                yield body
            elif kind in (b"c", b"Z"):
                return

    def confirm(self, lsn: int, pg_time_us: int = 0) -> None:
        """Tell the server that everything up to ``lsn`` is durable."""
        self.link.sendall(message(b"d", status_update(lsn, pg_time_us)))

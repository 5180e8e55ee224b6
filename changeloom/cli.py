"""Command line: run a job from a file or from an admin server, and manage jobs."""

from __future__ import annotations

import argparse
import json
import os
import signal
import socket
import subprocess
import sys
import threading
import time
import uuid
from pathlib import Path

from .config import Config, FileDatabaseSink, FileSource, FrameFolder, LakeSink, QueueSink, StdoutSink
from .errors import ChangeError, ConfigError


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="changeloom")
    areas = top.add_subparsers(dest="area", required=True)
    admin = areas.add_parser("admin").add_subparsers(dest="action", required=True)
    for name in ("serve", "start", "stop", "logs"):
        one = admin.add_parser(name, help={"serve": "in this process", "start": "in the background"}.get(name))
        if name in ("serve", "start"):
            one.add_argument("--port", type=int, default=8080)
            one.add_argument("--db", default="admin.db")
        if name != "serve":
            one.add_argument("--home", default=".changeloom", help="folder for the process id and the log")
        if name == "logs":
            one.add_argument("--lines", type=int, default=50)
    job = areas.add_parser("job").add_subparsers(dest="action", required=True)
    run = job.add_parser("run")
    run.add_argument("-c", "--config")
    run.add_argument("--admin-url")
    run.add_argument("--job")
    run.add_argument("--checkpoint", required=True)
    for name in ("create", "list", "get", "delete"):
        one = job.add_parser(name)
        one.add_argument("--admin-url", required=True)
        if name == "create":
            one.add_argument("--name", required=True)
            one.add_argument("-c", "--config", required=True)
        elif name != "list":
            one.add_argument("id")
    return top


def _source(spark, config: Config):
    """The stream of a job's source, in rows (seq, op, key, values) or in the envelope's layout."""
    from .sources import frames, pgoutput

    if isinstance(config.source, FileSource):
        schema = spark.read.format(config.source.format).load(config.source.path).schema
        return spark.readStream.format(config.source.format).schema(schema).option("maxFilesPerTrigger", 1).load(config.source.path)
    if isinstance(config.source, FrameFolder):
        spark.dataSource.register(frames.FrameSource)
        options = {"start": config.source.start} | ({"feedback": config.source.feedback} if config.source.feedback else {})
        return pgoutput.messages(spark.readStream.format("replication_frames").options(**options).load(config.source.path))
    raise ConfigError("database sources need a connection; record its stream (sources.wire, sources.frames) and point a source of type frames at it")


def _sink(spark, config: Config, columns: list[str], kinds: dict[str, str], name: str, metrics):
    """The sink of a job; changes have ``seq``, ``op``, ``key`` and values."""
    from .sinks import out
    from .sinks.lake import LakeTable
    from .streaming import runner

    values = [c for c in columns if c not in ("seq", "op", "key")]
    if isinstance(config.sink, StdoutSink):
        return lambda batch, number: batch.show(truncate=False)
    if isinstance(config.sink, QueueSink):
        return out.queue_sink(config.sink.topic_prefix, config.sink.brokers, **config.sink.properties)
    if isinstance(config.sink, LakeSink) and isinstance(config.source, FrameFolder):
        if config.mode != "cdc":
            raise ConfigError("a recorded stream is appended; fold its table of events")
        table = LakeTable(spark, config.sink.path)
        return runner.resolving(runner.evolving_append_sink(table, name, lambda names: {}, metrics), LakeTable(spark, f"{config.sink.path}_context"), name)
    if isinstance(config.sink, LakeSink):
        table = LakeTable(spark, config.sink.path)
        return runner.append_sink(table, name, metrics) if config.mode == "cdc" else runner.fold_sink(table, name, ["key"], values, metrics)
    mark = "?" if isinstance(config.sink, FileDatabaseSink) else "%s"
    target, table = out.DatabaseTarget(config.sink.connect, mark), f"{config.sink.table_prefix}events"
    if config.mode == "replication":
        return out.database_sink(target, table, kinds, ["key"], name)

    def append(batch, number):
        target.ensure(table, {c: kinds.get(c, "TEXT") for c in batch.columns})
        target.append(table, batch, name, number)

    return append


#: Column types of databases for the types of a stream.
_DDL = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE PRECISION", "float": "REAL", "boolean": "BOOLEAN"}


def run_job(config: Config, checkpoint: str, spark=None, metrics=None, stop: threading.Event | None = None):
    """Run a pipeline until what its source has is taken, or with ``stop`` until that is set."""
    from pyspark.sql import SparkSession

    from .streaming import runner

    spark = spark or SparkSession.builder.getOrCreate()
    stream = _source(spark, config)
    kinds = {f.name: _DDL.get(f.dataType.simpleString(), "TEXT") for f in stream.schema}
    sink = _sink(spark, config, stream.columns, kinds, os.path.basename(checkpoint.rstrip("/")), metrics)
    query = runner.run(stream, checkpoint, sink, metrics, available=stop is None)
    if stop is not None:
        while query.isActive and not stop.wait(0.5):
            pass
        query.processAllAvailable()  # drain what has come, then end
        query.stop()
    return query


def _start(home: Path, args) -> None:
    """An admin server in the background: its process id and its log are in ``home``."""
    home.mkdir(parents=True, exist_ok=True)
    if _pid(home):
        raise ConfigError(f"a server is running already: {_pid(home)}")
    with (home / "admin.log").open("ab") as log:
        command = [sys.executable, "-m", "changeloom.cli", "admin", "serve", "--port", str(args.port), "--db", args.db]
        server = subprocess.Popen(command, stdout=log, stderr=log, stdin=subprocess.DEVNULL, start_new_session=True)
    (home / "admin.pid").write_text(str(server.pid))


def _pid(home: Path) -> int | None:
    """The process id of the server that ``home`` names, if it runs."""
    try:
        pid = int((home / "admin.pid").read_text())
        os.kill(pid, 0)
    except (OSError, ValueError):
        return None
    return pid


def _stop(home: Path) -> None:
    pid = _pid(home)
    (home / "admin.pid").unlink(missing_ok=True)
    if pid is None:
        raise ConfigError("no server is running")
    os.kill(pid, signal.SIGTERM)


def _managed(args) -> None:
    from .admin.server import AdminClient, worker_server
    from .streaming.metrics import Metrics

    client, metrics, worker = AdminClient(args.admin_url), Metrics(), uuid.uuid4().hex
    job, text = client.config(args.job)
    done = threading.Event()
    server = worker_server(metrics, done.set)
    client.register(worker, job, f"127.0.0.1:{server.server_port}", socket.gethostname(), os.getpid())

    def beat():
        while not done.wait(10):
            client.heartbeat(worker, metrics)

    threading.Thread(target=beat, daemon=True).start()
    try:
        run_job(Config.parse(text), args.checkpoint, metrics=metrics, stop=done)
    finally:
        done.set()
        client.deregister(worker)


def main(argv: list[str] | None = None) -> int:
    from .admin.server import admin_server, call
    from .admin.store import Store

    args = parser().parse_args(argv)
    try:
        if args.area == "admin" and args.action != "serve":
            home = Path(args.home)
            if args.action == "start":
                _start(home, args)
            elif args.action == "stop":
                _stop(home)
            else:
                log = home / "admin.log"
                print("\n".join(log.read_text().splitlines()[-args.lines :]) if log.exists() else "no log yet")
            return 0
        if args.area == "admin":
            server = admin_server(Store(args.db), args.port)
            print(f"listening on {server.server_port}", flush=True)
            while True:
                time.sleep(3600)
        if args.action == "run":
            if args.admin_url:
                _managed(args)
            else:
                run_job(Config.parse(Path(args.config).read_text()), args.checkpoint)
            return 0
        jobs = f"{args.admin_url.rstrip('/')}/api/jobs"
        if args.action == "create":
            text = Path(args.config).read_text()
            Config.parse(text)
            out = call("POST", jobs, {"name": args.name, "config_json": text})
        elif args.action == "list":
            out = call("GET", jobs)
        else:
            out = call("GET" if args.action == "get" else "DELETE", f"{jobs}/{args.id}")
        print(json.dumps(out, indent=1))
        return 0
    except ChangeError as e:
        print(e, file=sys.stderr)
        return 1
    except KeyboardInterrupt:
        return 0


if __name__ == "__main__":
    sys.exit(main())

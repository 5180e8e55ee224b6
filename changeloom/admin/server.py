"""HTTP: the admin API over a store, and a worker's own endpoints."""

from __future__ import annotations

import json
import re
import threading
import time
import urllib.request
from dataclasses import asdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from ..errors import AdminError, HttpError
from ..streaming.metrics import Metrics
from .store import Store


def _serve(routes, port: int, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server for (method, path pattern, function(match, body, query)) routes, in a thread."""

    class Handler(BaseHTTPRequestHandler):
        def handle_any(self):
            url = urlparse(self.path)
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"null")
                for method, pattern, function in routes:
                    if method == self.command and (m := re.fullmatch(pattern, url.path)):
                        return self.reply(200, function(m, body, parse_qs(url.query)))
                self.reply(404, {"error": "no such path"})
            except AdminError as e:
                self.reply(404 if "not found" in str(e) else 400, {"error": str(e)})
            except (ValueError, KeyError, TypeError) as e:
                self.reply(400, {"error": str(e)})

        do_GET = do_POST = do_PUT = do_DELETE = handle_any

        def reply(self, code, value):
            raw = json.dumps(value).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


def call(method: str, url: str, body=None, timeout: float = 10):
    data = None if body is None else json.dumps(body).encode()
    request = urllib.request.Request(url, data, {"Content-Type": "application/json"}, method=method)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return json.loads(reply.read())
    except OSError as e:
        raise HttpError(str(e)) from e


def admin_server(store: Store, port: int = 0, worker_timeout: float = 30, keep_days: float = 7) -> ThreadingHTTPServer:
    """Jobs, workers and metrics; lost workers are marked every 10 s, old metrics pruned hourly."""
    lock = threading.Lock()

    def stop(m, body, query):
        worker = store.worker(m[1])
        return call("POST", f"http://{worker['address']}/control/stop", {})

    def registered(m, b, q):
        return store.register(b["id"], b["job_id"], b["address"], b.get("hostname", ""), int(b.get("pid", 0)))

    def beat(m, b, q):
        store.heartbeat(b["id"])
        if b.get("metrics"):
            from ..streaming.metrics import Snapshot

            store.record(b["id"], Snapshot(**b["metrics"]), b.get("status", "running"))
        return {"ok": True}

    routes = [
        ("GET", "/api/jobs", lambda m, b, q: store.jobs()),
        ("POST", "/api/jobs", lambda m, b, q: store.create_job(b["name"], b["config_json"], b.get("description", ""))),
        ("GET", "/api/jobs/([^/]+)", lambda m, b, q: store.job(m[1])),
        ("PUT", "/api/jobs/([^/]+)", lambda m, b, q: store.update_job(m[1], **b)),
        ("DELETE", "/api/jobs/([^/]+)", lambda m, b, q: store.delete_job(m[1]) or {"ok": True}),
        ("GET", "/api/jobs/([^/]+)/config", lambda m, b, q: json.loads(store.job(m[1])["config_json"])),
        ("GET", "/api/workers", lambda m, b, q: store.workers()),
        ("POST", "/api/workers/register", registered),
        ("POST", "/api/workers/heartbeat", beat),
        ("POST", "/api/workers/deregister", lambda m, b, q: store.deregister(b["id"]) or {"ok": True}),
        ("POST", "/api/workers/([^/]+)/stop", stop),
        ("GET", "/api/metrics/([^/]+)", lambda m, b, q: store.history(m[1], int(q.get("limit", ["100"])[0]))),
        ("GET", "/api/metrics/([^/]+)/latest", lambda m, b, q: store.latest(m[1])),
    ]
    locked = [(method, p, lambda *a, f=f: f(*a) if f is stop else _within(lock, f, a)) for method, p, f in routes]
    server = _serve(locked, port)

    def tend():
        turn = 0
        while getattr(server, "tended", True):
            time.sleep(10)
            turn += 1
            with lock:
                store.mark_lost(worker_timeout)
                if turn % 360 == 0:
                    store.prune(keep_days)

    threading.Thread(target=tend, daemon=True).start()
    return server


def _within(lock, function, arguments):
    with lock:
        return function(*arguments)


def worker_server(metrics: Metrics, stop, port: int = 0) -> ThreadingHTTPServer:
    """A worker's health, metrics and stop endpoints; ``stop`` ends its query."""
    return _serve(
        [
            ("GET", "/health", lambda m, b, q: {"status": "ok"}),
            ("GET", "/metrics", lambda m, b, q: asdict(metrics.snapshot())),
            ("POST", "/control/stop", lambda m, b, q: stop() or {"status": "stopping"}),
        ],
        port,
    )


class AdminClient:
    """A worker's side of the admin API."""

    def __init__(self, url: str):
        self.url = url.rstrip("/")

    def config(self, name: str) -> tuple[str, str]:
        """(job id, configuration) of a job by name."""
        for job in call("GET", f"{self.url}/api/jobs"):
            if job["name"] == name:
                return job["id"], job["config_json"]
        raise AdminError(f"job {name} not found")

    def register(self, worker: str, job: str, address: str, hostname: str, pid: int):
        return call("POST", f"{self.url}/api/workers/register", {"id": worker, "job_id": job, "address": address, "hostname": hostname, "pid": pid})

    def heartbeat(self, worker: str, metrics: Metrics | None = None):
        body = {"id": worker} | ({"metrics": asdict(metrics.snapshot())} if metrics else {})
        return call("POST", f"{self.url}/api/workers/heartbeat", body)

    def deregister(self, worker: str):
        return call("POST", f"{self.url}/api/workers/deregister", {"id": worker})

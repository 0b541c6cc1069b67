"""A small HTTP interface to one repository: health, report, summary, files, file, graph, tree, impact, train."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import functions as F

from riskspark.operators import graph, report
from riskspark.scan import Scan

MOST_FILES = 500


class Cache:
    """One scan at a time; all requests share the last one."""

    def __init__(self, make: Callable[[], Scan]):
        self.make, self.lock, self.held = make, threading.Lock(), None

    def get(self, again: bool = False) -> Scan:
        with self.lock:
            if again or self.held is None:
                self.held = self.make()
            return self.held


class Problem(Exception):
    def __init__(self, status: int, text: str):
        super().__init__(text)
        self.status = status


def one_file(scan: Scan, name: str) -> dict:
    found = report.lookup(scan.scored, name).limit(2).collect()
    if len(found) != 1:
        raise Problem(404 if not found else 409, "no such file" if not found else "several files match")
    return found[0].asDict(True)


def answer(cache: Cache, method: str, path: str, query: dict[str, str], body: dict, train: Callable[[], dict] | None = None):
    """What a request gets, as a value for JSON."""
    if path == "/api/health":
        return {"status": "ok", "scanned": cache.held is not None}
    scan = cache.get(again=query.get("refresh") in ("1", "true"))
    rows = lambda df: [r.asDict(True) for r in df.collect()]
    match method, path.removeprefix("/api/").split("/", 1):
        case "GET", ["report"]:
            return scan.document()
        case "GET", ["summary"]:
            return scan.about | report.summary(scan.scored).first().asDict() | {"bands": {r.band: r.files for r in report.bands(scan.scored).collect()}, "hotspots": rows(report.hotspots(scan.scored))}
        case "GET", ["files"]:
            some = report.filtered(scan.scored, float(query.get("min_score", 0)), query.get("band"), query.get("at_least"), query.get("q"))
            shown, more = report.listed(some, min(int(query.get("limit", 100)), MOST_FILES))
            return {"files": rows(shown), "more": more}
        case "GET", ["files", name]:
            return one_file(scan, unquote(name))
        case "GET", ["graph"]:
            risk = scan.scored.select(F.col("path").alias("node"), F.col("score").alias("own_risk"))
            return {"edges": rows(graph.payload(scan.edges.filter("kind = 'import'").select("src", "dst"), risk))}
        case "GET", ["tree"]:
            return report.tree(scan.scored)
        case "POST", ["impact"]:
            seeds = [one_file(scan, str(x))["path"] for x in body.get("files", [])]
            return {"seeds": seeds, "affected": rows(scan.impact(seeds, int(body.get("limit", MOST_FILES))).orderBy(F.desc("impact"), "node"))}
        case "GET", ["narrate", name]:
            return rows(report.narration(scan.scored.filter(F.col("path") == one_file(scan, unquote(name))["path"])))[0]
        case "POST", ["train"] if train is not None:
            return train()
    raise Problem(404, "no such address")


def serve(cache: Cache, port: int = 8710, host: str = "127.0.0.1", train: Callable[[], dict] | None = None) -> ThreadingHTTPServer:
    """A server that is bound and not started yet."""

    class Handler(BaseHTTPRequestHandler):
        def _do(self):
            url = urlsplit(self.path)
            try:
                size = int(self.headers.get("Content-Length") or 0)
                body = json.loads(self.rfile.read(size) or b"{}") if size else {}
                status, value = 200, answer(cache, self.command, url.path, {k: v[-1] for k, v in parse_qs(url.query).items()}, body if isinstance(body, dict) else {}, train)
            except Problem as e:
                status, value = e.status, {"error": str(e)}
            except ValueError as e:
                status, value = 400, {"error": str(e)}
            out = json.dumps(value, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        do_GET = do_POST = _do  # noqa: N815

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer((host, port), Handler)

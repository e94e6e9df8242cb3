"""Answers to the requests of a user interface: tree and dead code as JSON, over HTTP if wanted."""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions import scalars as S
from canopy.operators import deadcode, tree
from canopy.plans.analysis import analyze, dead_code
from canopy.sinks.reports import dead_json
from canopy.sources.files import NotADirectory, checked_root

Answer = tuple[int, str]


def tree_json(nodes: DataFrame) -> str:
    """Nodes as one nested object. The answer is one document, so this is the only place where a tree is held by the driver."""
    rows = nodes.select("path", "parent_id", "name", "type", "loc", "complexity", S.iso_timestamp(F.col("last_modified")).alias("at"))
    made: dict[tuple[str, str], dict] = {}
    below: dict[str, list[dict]] = {}
    for r in tree.flattened(rows).toLocalIterator():
        node = {"id": r["path"] or r["name"], "name": r["name"], "path": r["path"], "loc": r["loc"], "complexity": r["complexity"], "type": r["type"], "children": [], "lastModified": r["at"]}
        made[r["path"], r["type"]] = node
        if r["parent_id"] is not None:
            below.setdefault(r["parent_id"], []).append(node)
    for (path, kind), node in made.items():
        if kind == "directory":
            node["children"] = below.get(path, [])
    return json.dumps(made["", "directory"], ensure_ascii=False)


def answer(spark: SparkSession, method: str, route: str, body: str = "") -> Answer:
    """Status and JSON of POST /api/analyze {path}, POST /api/dead-code {path, minConfidence} and GET /api/health. 400 for a path that is none, 404 for other routes, 500 for all else."""
    try:
        if (method, route) == ("GET", "/api/health"):
            return 200, json.dumps({"status": "ok"})
        if method != "POST" or route not in ("/api/analyze", "/api/dead-code"):
            return 404, json.dumps({"error": f"no such route: {method} {route}"})
        asked = json.loads(body or "{}")
        path = asked.get("path") or ""
        if route == "/api/analyze":
            found = analyze(spark, path).metrics
            return 200, tree_json(tree.nodes(found.select(F.substring("path", len(checked_root(path)) + 2, 1 << 30).alias("path"), "loc", "last_modified")))
        found, least = dead_code(spark, path), int(asked.get("minConfidence", 80))
        return 200, "".join(dead_json(deadcode.confident(found.dead, least), deadcode.filtered_summary(found.dead, found.symbols, least)))
    except (FileNotFoundError, NotADirectory) as e:
        return 400, json.dumps({"error": f"invalid path: {e}"})
    except Exception as e:  # whatever it is, the caller gets an answer
        return (400 if str(e) == "empty path" else 500), json.dumps({"error": str(e)})


def server(spark: SparkSession, port: int = 0, host: str = "127.0.0.1", reply: Callable[..., Answer] = answer) -> ThreadingHTTPServer:
    """A server of these answers, not yet started; port 0 takes a free one."""

    class Handler(BaseHTTPRequestHandler):
        def do(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
            status, text = reply(spark, self.command, self.path, body)
            data = text.encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do  # noqa: N815

        def log_message(self, *_: object) -> None:
            return

    return ThreadingHTTPServer((host, port), Handler)

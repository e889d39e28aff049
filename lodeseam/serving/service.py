"""Answers over a store: plain calls, JSON-RPC tools, and a small HTTP server around them."""

from __future__ import annotations

import json
from datetime import datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodeseam.config import Settings
from lodeseam.functions.embed import embedder
from lodeseam.operators import crawl as C
from lodeseam.operators.jobs import Jobs
from lodeseam.operators.search import hybrid
from lodeseam.operators.store import Store
from lodeseam.serving import site
from lodeseam.session import released
from lodeseam.sources.pages import PageSource

#: Version, names and schemas of the tool protocol (fixed values).
PROTOCOL = "2024-11-05"
_TEXT = {"type": "string"}
TOOLS = [
    {"name": "search_docs", "description": "Search the indexed pages.", "inputSchema": {"type": "object", "properties": {"query": _TEXT, "top_k": {"type": "integer", "minimum": 1, "maximum": 25, "default": 5}}, "required": ["query"]}},
    {"name": "list_doc_pages", "description": "List the indexed pages.", "inputSchema": {"type": "object", "properties": {}}},
    {"name": "get_doc_page", "description": "Give the text of a page.", "inputSchema": {"type": "object", "properties": {"page_id": _TEXT}, "required": ["page_id"]}},
]


class Service:
    def __init__(self, spark: SparkSession, store: Store, source: PageSource, settings: Settings = Settings()):
        self.spark, self.store, self.source, self.settings = spark, store, source, settings
        self.jobs = Jobs(self._crawl)

    def _crawl(self, url: str, max_pages: int | None, max_depth: int | None, prune: bool | None) -> dict[str, int]:
        own = {k: v for k, v in (("max_pages", max_pages), ("max_depth", max_depth)) if v is not None}
        settings, now = Settings(**(self.settings.__dict__ | own)), datetime.now()
        with released():
            result = C.crawl(self.spark, self.source, url, self.store.pages, self.store.links, settings, now)
            return C.indexed(result, self.store, settings, now, prune)

    def search(self, query: str, top_k: int = 5) -> list[dict]:
        if not isinstance(top_k, int) or not 1 <= top_k <= 25:
            raise ValueError("top_k must be 1 to 25")
        q = self.spark.createDataFrame([(0, query, top_k)], "query_id bigint, query_text string, top_k int")
        with released():
            rows = hybrid(self.store.chunks, q, self.store.pages, by=embedder(self.settings.embedder, self.settings.embedding_dimensions)).orderBy("place").collect()
        return [{"url": r.page_url, "title": r.page_title, "score": r.score, "method": r.method, "text": r.text} for r in rows]

    def list_pages(self) -> list[dict]:
        return [r.asDict() for r in self.store.pages.orderBy("crawled_at", "id").select(F.col("id").alias("page_id"), "url", "title", "domain").collect()]

    def get_page(self, page_id: str) -> dict | None:
        row = self.store.pages.where(F.col("id") == page_id).select(F.col("id").alias("page_id"), "url", "title", "text").first()
        return row.asDict() if row else None

    def health(self) -> dict:
        return {"status": "ok", "service": "lodeseam", **self.store.counts().first().asDict()}

    def tool(self, name: str, args: dict[str, Any]) -> dict:
        """Result of a tool call; an unknown tool or page is an error within the result."""
        if name == "search_docs":
            given: Any = self.search(args["query"], args.get("top_k", 5))
        elif name == "list_doc_pages":
            given = [{k: p[k] for k in ("page_id", "url", "title")} for p in self.list_pages()]
        elif name == "get_doc_page":
            found = self.get_page(args["page_id"])
            given = found and (found["text"] or "")
        else:
            given = None
        if given is None:
            return {"content": [{"type": "text", "text": f"unknown: {name} {args.get('page_id', '')}".strip()}], "isError": True}
        return {"content": [{"type": "text", "text": given if isinstance(given, str) else json.dumps(given, indent=2)}], "isError": False}

    def rpc(self, call: Any) -> Any:
        """Answer to one JSON-RPC call or a batch; None for notifications, which a batch leaves out."""
        if isinstance(call, list):
            return [a for a in map(self.rpc, call) if a is not None]
        key = call.get("id") if isinstance(call, dict) else None
        if key is None:
            return None
        ok = lambda x: {"jsonrpc": "2.0", "id": key, "result": x}
        bad = lambda code, text: {"jsonrpc": "2.0", "id": key, "error": {"code": code, "message": text}}
        method, params = call.get("method"), call.get("params") or {}
        if method == "initialize":
            return ok({"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "lodeseam", "version": "1.0"}})
        if method == "ping":
            return ok({})
        if method == "tools/list":
            return ok({"tools": TOOLS})
        if method == "tools/call":
            try:
                return ok(self.tool(params["name"], params.get("arguments") or {}))
            except (KeyError, ValueError, TypeError) as e:
                return bad(-32602, f"bad argument: {e}")
        return bad(-32601, f"unknown method: {method}")

    def get(self, path: str) -> tuple[int, str, str]:
        """(status, content type, body) of a GET request."""
        at = urlsplit(path)
        q = {k: v[0] for k, v in parse_qs(at.query).items()}
        parts = [p for p in at.path.split("/") if p]
        html = lambda x: (200, "text/html", x) if x is not None else (404, "application/json", '{"detail": "not found"}')
        data = lambda x: (200, "application/json", json.dumps(x)) if x is not None else html(None)
        match parts:
            case ["health"]:
                return data(self.health())
            case ["job_progress"]:
                return data(self.jobs.progress(q.get("job_id")))
            case ["search_docs"]:
                try:
                    return data(self.search(q.get("query", ""), int(q.get("top_k", 5))))
                except ValueError as e:
                    return 422, "application/json", json.dumps({"detail": str(e)})
            case ["list_doc_pages"]:
                return data(self.list_pages())
            case ["get_doc_page"]:
                return data(self.get_page(q.get("page_id", "")))
            case ["map"]:
                return html(site.index(self.store.pages))
            case ["map", "site", key]:
                with released():
                    return html(site.site(self.store.pages, key))
            case ["map", "page", key]:
                with released():
                    return html(site.page(self.store.pages, key))
            case ["map", "page", key, "raw"]:
                found = self.get_page(key)
                return (200, "text/plain", found["text"] or "") if found else html(None)
        return html(None)

    def post(self, path: str, body: Any) -> tuple[int, str, str]:
        at = urlsplit(path)
        if at.path == "/mcp":
            answer = self.rpc(body)
            return (202, "application/json", "null") if answer is None else (200, "application/json", json.dumps(answer))
        if at.path == "/fetch_url":
            try:
                sync = parse_qs(at.query).get("sync", ["false"])[0].lower() in ("1", "true")
                return 200, "application/json", json.dumps(self.jobs.submit(body["url"], body.get("max_pages"), body.get("max_depth"), sync, body.get("prune")))
            except (KeyError, ValueError, TypeError) as e:
                return 422, "application/json", json.dumps({"detail": str(e)})
        return 404, "application/json", '{"detail": "not found"}'


def serve(service: Service, host: str = "127.0.0.1", port: int = 9111) -> ThreadingHTTPServer:
    """A server; call serve_forever() on it."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, kind: str, body: str) -> None:
            raw = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self):  # noqa: N802
            self._send(*service.get(self.path))

        def do_POST(self):  # noqa: N802
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"null")
            except ValueError:
                self._send(400, "application/json", '{"detail": "no JSON"}')
                return
            self._send(*service.post(self.path, body))

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)

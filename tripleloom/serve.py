"""HTTP surface of the engine on the standard library: the same routes as functions, and a server.

``App`` maps (method, path, query, body) to (status, data) and can be called without a socket. Work is
done by Spark; the server's threads only wait for it.
"""

from __future__ import annotations

import hmac
import json
import logging
import threading
import time
import uuid
from collections import defaultdict, deque
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, unquote, urlsplit

from pyspark.sql import functions as F

from tripleloom.engine import Engine
from tripleloom.operators.communities import community_stats, summaries
from tripleloom.operators.resolve import alias_stats
from tripleloom.operators.store import node_view

log = logging.getLogger("tripleloom.access")
#: Rows of a provenance answer, as an HTTP answer must end somewhere.
MOST_ROWS = 1000
_TRIPLE = ["triple_id", "subject", "predicate", "object", "confidence", "source_doc", "extraction_method", "layer", "timestamp", "evidence", "lineage"]


class Refused(Exception):
    def __init__(self, status: int, detail: str, headers: dict[str, str] | None = None):
        super().__init__(detail)
        self.status, self.detail, self.headers = status, detail, headers or {}


class RateLimit:
    """At most ``limit`` calls of a client within ``seconds``; 0 or None is no limit."""

    def __init__(self, limit: int | None, seconds: float = 60.0):
        self.limit, self.seconds = limit, seconds
        self.hits: dict[str, deque[float]] = defaultdict(deque)
        self.lock = threading.Lock()

    def check(self, client: str, now: float) -> None:
        if not self.limit or self.limit <= 0:
            return
        with self.lock:
            w = self.hits[client]
            while w and w[0] <= now - self.seconds:
                w.popleft()
            if len(w) >= self.limit:
                raise Refused(429, "Rate limit exceeded", {"Retry-After": str(max(1, int(self.seconds - (now - w[0]))))})
            w.append(now)


def _number(v, low: int, high: int, name: str) -> int:
    try:
        n = int(v)
    except (TypeError, ValueError):
        raise Refused(422, f"{name} is no number") from None
    if not low <= n <= high:
        raise Refused(422, f"{name} must be {low} to {high}")
    return n


class App:
    def __init__(self, engine: Engine, api_key: str | None = None, rate_limit: int | None = None):
        self.engine, self.api_key, self.rate = engine, api_key, RateLimit(rate_limit)

    def handle(
        self, method: str, url: str, body: dict | None = None, headers: dict[str, str] | None = None, client: str = "local",
    ) -> tuple[int, object, dict[str, str]]:
        """(status, data, headers) of one request, logged as one JSON line."""
        given = {k.lower(): v for k, v in (headers or {}).items()}
        rid, began = given.get("x-request-id") or str(uuid.uuid4()), time.perf_counter()
        parts = urlsplit(url)
        extra: dict[str, str] = {}
        try:
            if parts.path != "/health":
                self.rate.check(client, time.monotonic())
                if self.api_key and not hmac.compare_digest(given.get("x-api-key", "").encode(), self.api_key.encode()):
                    raise Refused(401, "Invalid or missing API key")
            status, data = 200, self.route(method, parts.path, dict(parse_qsl(parts.query)), body or {})
        except Refused as e:
            status, data, extra = e.status, {"detail": e.detail}, e.headers
        except ValueError as e:
            status, data = 400, {"detail": str(e)}
        log.info(json.dumps({"request_id": rid, "method": method, "path": parts.path, "status": status, "duration_ms": round((time.perf_counter() - began) * 1000, 2), "client": client}))
        return status, data, {"X-Request-ID": rid, **extra}

    def route(self, method: str, path: str, q: dict[str, str], body: dict):
        fixed = {("GET", "/health"): self.health, ("POST", "/ingest"): self.ingest, ("POST", "/query"): self.ask, ("POST", "/embed"): self.embed, ("GET", "/graph/stats"): self.stats, ("GET", "/graph/path"): self.path, ("POST", "/graph/community"): self.detect, ("GET", "/graph/community"): self.communities, ("POST", "/graph/resolve"): self.resolve}
        if (method, path) in fixed:
            return fixed[(method, path)](q, body)
        for prefix, f in (("/similar/", self.similar), ("/graph/node/", self.node), ("/graph/provenance/", self.provenance)):
            if method == "GET" and path.startswith(prefix):
                return f(unquote(path[len(prefix) :]), q)
        raise Refused(404, "Not found")

    def health(self, q, body):
        s = self.engine.stats()
        v = self.engine.vectors_table()
        return {"status": "ok", "entities": s["entities"], "triples": s["triples"], "embedded_entities": v.count() if v is not None else 0, "path": self.engine.path}

    def ingest(self, q, body):
        if body.get("adapter", "universal") not in ("universal", "vault"):
            raise Refused(400, f"Unknown adapter: {body['adapter']}")
        r = self.engine.ingest(
            body.get("source") or "", body.get("adapter", "universal"), bool(body.get("dry_run")),
            max_facts=_number(body.get("max_facts", 40), 1, 500, "max_facts"),
        )
        return {"adapter": r.adapter, "source": r.source, "documents_scanned": r.scanned, "documents_extracted": r.extracted, "triples_added": r.added, "triples_skipped": r.skipped, "errors": r.messages}

    def ask(self, q, body):
        mode = body.get("mode", "local")
        if mode not in ("local", "global", "drift") or not isinstance(body.get("question"), str):
            raise Refused(422, "question and mode local, global or drift are needed")
        r = self.engine.ask(body["question"], mode, _number(body.get("hops", 2), 1, 4, "hops"))
        return {"question": body["question"], "cited_triples": r["evidence"], "communities_used": 0} | {k: v for k, v in r.items() if k != "evidence"}

    def embed(self, q, body):
        return {"entities_embedded": self.engine.embed()["entities"]}

    def similar(self, entity, q):
        k, kind = _number(q.get("k", 10), 1, MOST_ROWS, "k"), q.get("kind")
        found = self.engine.search(entity, k, kind) if q.get("text", "").lower() in ("1", "true") else self.engine.similar(entity, k, kind)
        return {"entity": entity, "results": [{"entity_id": r["id"], "score": r["score"]} for r in found.orderBy("rank").collect()]}

    def stats(self, q, body):
        return self.engine.stats()

    def node(self, entity, q):
        e = self.engine.store.entities().filter(F.col("id") == entity).first()
        if e is None:
            raise Refused(404, f"Entity not found: {entity}")
        rows = node_view(self.engine.store.triples(), entity, _number(q.get("limit", 50), 1, MOST_ROWS, "limit")).select(*_TRIPLE)
        return {"entity_id": entity, "kind": e["kind"], "triples": [r.asDict() for r in rows.collect()]}

    def provenance(self, entity, q):
        rows = [r.asDict() for r in self.engine.provenance(entity).select(*_TRIPLE).limit(MOST_ROWS).collect()]
        if not rows:
            raise Refused(404, f"No provenance found for: {entity}")
        return {"entity": entity, "triples": rows}

    def path(self, q, body):
        if "from" not in q or "to" not in q:
            raise Refused(422, "from and to are needed")
        p = self.engine.path_between(q["from"], q["to"])
        return {"from_entity": q["from"], "to_entity": q["to"], "path": p or [], "found": p is not None}

    def detect(self, q, body):
        return self.engine.communities()

    def communities(self, q, body):
        c = self.engine.table("communities")
        if c is None:
            return {"summaries": [], "stats": {"communities": 0, "total_members": 0}}
        return {"summaries": [r.asDict() for r in summaries(c).limit(MOST_ROWS).collect()], "stats": community_stats(c).first().asDict()}

    def resolve(self, q, body):
        got = self.engine.resolve()
        a = self.engine.table("aliases")
        return got | {"aliases_by_phase": [] if a is None else [r.asDict() for r in alias_stats(a).collect()]}


def server(app: App, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _run(self):
            n = int(self.headers.get("Content-Length") or 0)
            try:
                body = json.loads(self.rfile.read(n)) if n else {}
                status, data, extra = app.handle(self.command, self.path, body, dict(self.headers), self.client_address[0])
            except json.JSONDecodeError:
                status, data, extra = 422, {"detail": "body is no JSON"}, {}
            out = json.dumps(data, default=str, ensure_ascii=False).encode()
            self.send_response(status)
            for k, v in {"Content-Type": "application/json", "Content-Length": str(len(out)), **extra}.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(out)

        do_GET = do_POST = _run

        def log_message(self, *args):
            """Access lines come from the app."""

    return ThreadingHTTPServer((host, port), Handler)

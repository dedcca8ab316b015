"""The catalogue over HTTP: health, search, refinement of ideas, and static files. answer() is plain, serve() puts it behind a socket."""

from __future__ import annotations

import json
import mimetypes
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from .api import Catalogue

Answer = tuple[int, dict[str, str], bytes]
#: Fields of a refined idea: texts, then lists of texts.
REFINED = (("refinedProblem",), ("methodModules", "experimentPlan", "noveltyAngles", "risks"))


@dataclass
class App:
    """encode: a query's vector, if there is an encoder; refine: a model's JSON for (draft, papers), if there is one; static: a folder of files below base."""

    catalogue: Catalogue
    encode: Callable[[str], list[float]] | None = None
    refine: Callable[[dict, list], dict | None] | None = None
    refine_model: str = "none"
    static: str | None = None
    base: str = "/"
    cors: dict[str, str] = field(default_factory=lambda: {"Access-Control-Allow-Origin": "*", "Access-Control-Allow-Methods": "GET,POST,OPTIONS", "Access-Control-Allow-Headers": "Content-Type"})

    def answer(self, method: str, target: str, body: bytes = b"") -> Answer:
        """(status, headers, body) of a request. Errors of a handler are 500 with a message."""
        url = urlsplit(target)
        if method == "OPTIONS":
            return 204, self.cors, b""
        route = {("GET", "/health"): self._health, ("GET", "/search"): self._search, ("GET", "/api/brainstorm/status"): self._status, ("POST", "/api/brainstorm/enhance"): self._enhance}.get((method, url.path))
        try:
            if route:
                return self._json(200, route({k: v[0] for k, v in parse_qs(url.query).items()}, body))
            return self._file(unquote(url.path)) if method == "GET" and self.static else (404, self.cors, b"")
        except Exception as error:
            return self._json(500, {"ok": False, "error": str(error)})

    def _json(self, status: int, value) -> Answer:
        return status, {**self.cors, "Content-Type": "application/json; charset=utf-8"}, json.dumps(value, ensure_ascii=False, default=str).encode()

    def _health(self, asked: dict, body: bytes) -> dict:
        return self.catalogue.health() | {"dimensions": self.catalogue.dimensions}

    def _search(self, asked: dict, body: bytes) -> dict:
        text = asked.get("q", "").strip()
        try:
            most = int(float(asked.get("top_k", 500))) or 500
        except ValueError:
            most = 500
        most = max(1, min(most, max(1, self.catalogue.rows)))
        if not text:
            return {"query": text, "results": []}
        hits = self.catalogue.semantic(self.encode(text), most) if self.encode else self.catalogue.lexical(text, most)
        return {"query": text, "results": [{"id": r["id"], "score": r["score"]} for r in hits.select("id", "score").collect()]}  # at most `most` rows

    def _status(self, asked: dict, body: bytes) -> dict:
        there = self.refine is not None
        return {"available": there, "model": self.refine_model, "message": f"Refinement is ready with {self.refine_model}." if there else "Refinement is offline here."}

    def _enhance(self, asked: dict, body: bytes) -> dict:
        status = self._status({}, b"")
        if not status["available"]:
            raise ValueError(status["message"])
        given = json.loads(body or b"{}")
        found = self.refine(given.get("draft") or {}, given.get("papers") or [])
        if not isinstance(found, dict):
            raise ValueError("the model gave no valid JSON")
        texts = {k: str(found.get(k) or "").strip() for k in REFINED[0]}
        items = lambda x: [str(v).strip() for v in x if str(v).strip()] if isinstance(x, list) else []
        return texts | {k: items(found.get(k)) for k in REFINED[1]} | {"model": self.refine_model}

    def _file(self, path: str) -> Answer:
        base = self.base.rstrip("/")
        if path == "/" and base:
            return 302, {"Location": f"{base}/"}, b""
        if base and path != base and not path.startswith(f"{base}/"):
            return 404, {}, b"Not found"
        root = os.path.realpath(self.static)
        wanted = os.path.realpath(os.path.join(root, path[len(base) :].lstrip("/") or "index.html"))
        if wanted != root and not wanted.startswith(root + os.sep):
            return 403, {}, b"Forbidden"
        kept = wanted if os.path.isfile(wanted) else os.path.join(root, "index.html")  # unknown paths are the application's own
        with open(kept, "rb") as file:
            content = file.read()
        kind = mimetypes.guess_type(kept)[0] or "application/octet-stream"
        fresh = kept.endswith(".html")
        return 200, {"Content-Type": f"{kind}; charset=utf-8" if kind.startswith("text/") else kind, "Cache-Control": "no-cache" if fresh else "public, max-age=31536000, immutable"}, content


def serve(app: App, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that is bound and ready; the caller runs serve_forever() and shutdown()."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            status, headers, body = app.answer(self.command, self.path, self.rfile.read(size) if size else b"")
            self.send_response(status)
            for name, value in {**headers, "Content-Length": str(len(body))}.items():
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(body)

        do_GET = do_POST = do_OPTIONS = _answer

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)

"""A thin local service: GET /health and POST /retrieve over one Spark session and one index.

Retrieval never fails a caller's turn: any error there answers with an empty context. Plans themselves raise.
"""

from __future__ import annotations

import json
import sys
import threading
import time
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

MAX_BODY = 64 << 10


class Runtime:
    """The settings in force and what was opened with them; a new generation follows each change of the file.

    Requests look at the file's time first, at most every DEBOUNCE seconds. Broken settings leave the old ones in
    force. An answer that was begun in an older generation is not given.
    """

    DEBOUNCE = 0.05

    def __init__(self, load: Callable[[], dict], opened: Callable[[dict], object], stamp: Callable[[], object]):
        self._load, self._opened, self._stamp = load, opened, stamp
        self._lock, self.generation, self._seen, self._looked = threading.Lock(), 0, None, 0.0
        self.config: dict = {}
        self.state: object = None
        self.refresh(force=True)

    def refresh(self, force: bool = False) -> int:
        """Take over changed settings; the generation in force."""
        with self._lock:
            now = time.monotonic()
            if not force and now - self._looked < self.DEBOUNCE:
                return self.generation
            self._looked, stamp = now, self._stamp()
            if force or stamp != self._seen:
                self._seen = stamp
                try:
                    config = self._load()
                    self.state = self._opened(config) if config["enabled"] else None
                    self.config, self.generation = config, self.generation + 1
                except ValueError as e:
                    if force:
                        raise
                    print(f"the settings stay as they were: {e}", file=sys.stderr)
            return self.generation


def answer(body: bytes, ready: Callable[[], bool], retrieve: Callable[[str, dict], str | dict], log: Callable[[dict], None] | None = None, generation: Callable[[], int] = lambda: 0) -> tuple[int, dict]:
    """Status and reply of POST /retrieve: the context of ``query``, with overrides clamped by retrieve.

    retrieve gives a context, or a reply with ``additionalContext``, ``selected`` and what is to be logged.
    """
    empty = {"additionalContext": "", "injected": False}
    if len(body) > MAX_BODY:
        return 413, empty
    began, started = time.time(), generation()
    try:
        request = json.loads(body)
        query = str(request.get("query") or "").strip()
        if not ready() or not query:
            return 200, empty | {"ready": ready()}
        found = retrieve(query, {k: request[k] for k in ("topK", "bm25TopK", "maxTotalTokens") if k in request})
        reply = found if isinstance(found, dict) else {"additionalContext": found}
        context, stages = reply["additionalContext"], reply.pop("stages", [])
        if generation() != started:
            return 200, empty
        if log is not None:
            try:
                log({"query": query, "injected": bool(context), "duration_ms": int((time.time() - began) * 1000), "stages": stages, "selected": reply.get("selected", [])})
            except OSError as e:
                print(f"the retrieval was not logged: {e}", file=sys.stderr)
        return 200, {**reply, "injected": bool(context)}
    except Exception as e:  # the edge of the service: a turn goes on without a context
        print(f"retrieve failed: {e}", file=sys.stderr)
        return 200, empty


def make_server(host: str, port: int, ready: Callable[[], bool], retrieve: Callable[[str, dict], str | dict], log: Callable[[dict], None] | None = None, generation: Callable[[], int] = lambda: 0) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, reply: dict) -> None:
            data = json.dumps(reply, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("content-type", "application/json")
            self.send_header("content-length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            known = self.path == "/health"
            self._send(200 if known else 404, {"ok": True, "ready": ready()} if known else {"error": "not found"})

        def do_POST(self) -> None:
            if self.path != "/retrieve":
                self._send(404, {"error": "not found"})
                return
            size = int(self.headers.get("content-length") or 0)
            self._send(*answer(self.rfile.read(min(size, MAX_BODY + 1)), ready, retrieve, log, generation))

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)

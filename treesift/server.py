"""Requests over a Unix socket: one JSON object a line in, one a line out.

A line that is no request is answered with an error, and the connection goes on.  Each connection has a
thread of its own, and all share one engine; Spark runs their jobs side by side.
"""

from __future__ import annotations

import json
import os
import socket
import socketserver
import threading

from .api import PROTOCOL, Engine

MAX_LINE = 1 << 20  # bytes of a request


def answer(engine: Engine, line: bytes, now: float | None = None) -> dict:
    """The response to one line."""
    try:
        request = json.loads(line)
        if not isinstance(request, dict):
            raise ValueError("a request is an object")
    except ValueError as e:
        return {"v": PROTOCOL, "requestId": None, "ok": False, "error": {"code": "bad_request", "msg": str(e)}, "total": 0, "truncated": False}
    return engine.tool(request, now) if "jsonrpc" in request else engine.handle(request, now)


class Server(socketserver.ThreadingMixIn, socketserver.UnixStreamServer):
    daemon_threads = True

    def __init__(self, engine: Engine, path: str, now: float | None = None):
        self.engine, self.now = engine, now
        if os.path.exists(path):
            os.unlink(path)
        super().__init__(path, _Connection)
        os.chmod(path, 0o600)  # its owner alone may ask

    def start(self) -> Server:
        threading.Thread(target=self.serve_forever, daemon=True).start()
        return self


class _Connection(socketserver.StreamRequestHandler):
    def handle(self) -> None:
        while line := self.rfile.readline(MAX_LINE + 1):
            whole = line.endswith(b"\n") or len(line) <= MAX_LINE
            reply = answer(self.server.engine, line, self.server.now) if whole else answer(self.server.engine, b"a request is too long")
            self.wfile.write(json.dumps(reply, ensure_ascii=False).encode() + b"\n")
            if not whole:
                return


def ask(path: str, request: dict, timeout: float | None = None) -> dict | None:
    """The answer of a server; None if there is none at that path."""
    with socket.socket(socket.AF_UNIX) as s:
        s.settimeout(timeout)
        try:
            s.connect(path)
        except OSError:
            return None
        s.sendall(json.dumps(request).encode() + b"\n")
        with s.makefile("rb") as f:
            line = f.readline()
    return json.loads(line) if line else None

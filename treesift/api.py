"""Requests as dictionaries: checked, run, and answered as dictionaries.

{"v": 1, "q": "report ext:pdf", "mode": "exact", "scope": "name", "sort": "size", "asc": false,
 "limit": 50, "scopeRoot": "/corpus", "fields": ["path", "size"], "countOnly": false,
 "foldersFirst": false, "hideHidden": false, "useFolderSizes": true, "wholeNameWildcards": true}
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .functions.text import nfc
from .operators.search import search
from .operators.tree import live
from .plans.query import DESCENDING, EXACT, FUZZY, NAME, PATH, REGEX, WILDCARD, SearchOptions

# The names, aliases, limits and error codes that clients of the protocol depend on.
PROTOCOL = 1
MODES = {"exact": EXACT, "fuzzy": FUZZY, "wildcard": WILDCARD, "glob": WILDCARD, "regex": REGEX}
SORTS = {
    "name": "name", "path": "path", "size": "size", "date": "modified", "dm": "modified", "datemodified": "modified", "created": "created",
    "datecreated": "created", "relevance": "relevance", "rel": "relevance", "runcount": "runcount", "run": "runcount", "frecency": "runcount",
}
MAX_RESULTS, DEFAULT_RESULTS = 10_000, 200
TOOL_MAX, TOOL_DEFAULT = 1_000, 50


class BadRequest(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass
class Engine:
    """The tables that requests are answered from."""

    entries: DataFrame
    history: DataFrame | None = None
    contents: DataFrame | None = None
    tags: DataFrame | None = None

    def exists(self, path: str) -> bool:
        return not live(self.entries).where(F.col("path") == path).isEmpty()

    def handle(self, request: dict, now: float | None = None) -> dict:
        """The response to a request; one that is not valid gets an error, never a guess."""
        base = {"v": PROTOCOL, "requestId": request.get("requestId")}
        try:
            return base | {"ok": True} | self._run(request, time.time() if now is None else now)
        except BadRequest as e:
            return base | {"ok": False, "error": {"code": e.code, "msg": str(e)}, "total": 0, "truncated": False}

    def _run(self, request: dict, now: float) -> dict:
        if request.get("v", PROTOCOL) != PROTOCOL:
            raise BadRequest("unsupported_version", f"protocol v{request['v']} not supported")
        mode, sort = MODES.get(str(request.get("mode") or "exact").lower()), SORTS.get(str(request.get("sort") or "name").lower())
        if mode is None:
            raise BadRequest("bad_request", "unknown mode")
        if sort is None:
            raise BadRequest("bad_request", "unknown sort")
        if not isinstance(request.get("q"), str):
            raise BadRequest("bad_request", "q must be a text")
        scope = PATH if str(request.get("scope") or "name").lower() == "path" else NAME
        ascending = request["asc"] if isinstance(request.get("asc"), bool) else sort not in DESCENDING
        limit = request.get("limit")
        limit = min(max(1, DEFAULT_RESULTS if limit is None else int(limit)), MAX_RESULTS)
        root = nfc(request.get("scopeRoot") or "") or None
        if root and not self.exists(root):  # never the whole table instead
            return {"total": 0, "truncated": False} | ({} if request.get("countOnly") else {"paths": []})
        options = SearchOptions(
            folders_first=bool(request.get("foldersFirst", False)),
            hide_hidden=bool(request.get("hideHidden", False)),
            folder_sizes=bool(request.get("useFolderSizes", True)),
            whole_name_wildcards=bool(request.get("wholeNameWildcards", True)),
        )
        began = time.perf_counter()
        result = search(self.entries, request["q"], mode, scope, sort, ascending, limit, now, root, options, self.history, self.contents, self.tags)
        if request.get("countOnly"):
            total, rows = result.total(), None
        else:
            total, rows = result.top("path", "name", "size", F.col("mtime_ns").alias("mtime"), F.col("is_dir").alias("isDir"))
        out = {"total": total, "truncated": total > limit, "contentIncomplete": result.content_incomplete()}
        if rows is not None:
            if any(f != "path" for f in request.get("fields") or ["path"]):
                out["results"] = [r.asDict() for r in rows]
            else:
                out["paths"] = [r.path for r in rows]
        return out | {"queryMillis": round((time.perf_counter() - began) * 1000, 3)}

    def tool(self, request: dict, now: float | None = None) -> dict:
        """A JSON-RPC request of a tool protocol: lists or calls the one tool, `search`."""
        reply = {"jsonrpc": "2.0", "id": request.get("id")}
        method, params = request.get("method"), request.get("params") or {}
        if method == "tools/list":
            return reply | {"result": {"tools": [TOOL]}}
        if method != "tools/call" or params.get("name") != "search":
            return reply | {"error": {"code": -32601, "message": "unknown method or tool"}}
        a = params.get("arguments") or {}
        asked = {"q": a.get("query"), "mode": a.get("mode"), "sort": a.get("sort"), "scope": a.get("scope"), "countOnly": a.get("count_only", False), "limit": min(max(1, int(a.get("limit", TOOL_DEFAULT))), TOOL_MAX)}
        answer = self.handle(asked, now)
        if not answer["ok"]:
            return reply | {"error": {"code": -32602, "message": answer["error"]["msg"]}}
        text = str(answer["total"]) if a.get("count_only") else "\n".join(answer["paths"])
        return reply | {"result": {"content": [{"type": "text", "text": text}], "total": answer["total"], "truncated": answer["truncated"]}}


TOOL = {
    "name": "search",
    "description": "Search files by name, path and attributes.",
    "inputSchema": {
        "type": "object",
        "required": ["query"],
        "properties": {
            "query": {"type": "string"}, "mode": {"type": "string", "enum": ["exact", "fuzzy", "wildcard", "regex"]}, "sort": {"type": "string"},
            "scope": {"type": "string", "enum": ["name", "path"]}, "limit": {"type": "integer", "maximum": TOOL_MAX}, "count_only": {"type": "boolean"},
        },
    },
}

"""The operations over HTTP (GET with query parameters or POST with a JSON object; `/tools` describes them), and as tools over standard input."""

from __future__ import annotations

import json
from collections.abc import Iterable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import TextIO
from urllib.parse import parse_qsl, urlsplit

from .plans import api
from .sources.vault import Vault

PORT = 8000
# Where each operation answers.
PATHS = {
    "/api/tasks": "tasks",
    "/api/tags": "tags",
    "/api/tags/list": "list-tags",
    "/api/tags/search": "search-tags",
    "/api/files": "list-files",
    "/api/files/read": "read-files",
    "/api/files/recent": "recent-files",
    "/api/daily-notes": "get-daily-note",
    "/api/daily-notes/search": "search-daily-notes",
    "/api/outline": "outline",
    "/api/outline/section": "section",
    "/api/outline/search": "search-headings",
    "/api/search/index": "index",
    "/api/search": "search",
}


# The names of the tools, and what they call.
TOOLS = {
    "search": "search",
    "build_search_index": "index",
    "search_tasks": "tasks",
    "extract_tags": "tags",
    "list_tags": "list-tags",
    "search_by_tags": "search-tags",
    "list_files": "list-files",
    "read_files": "read-files",
    "recent_files": "recent-files",
    "get_daily_note": "get-daily-note",
    "search_daily_notes": "search-daily-notes",
}
PROTOCOL = "2024-11-05"


def schema(name: str) -> dict:
    types = {str: "string", int: "integer", float: "number", bool: "boolean", list: "array"}
    own = api.fields(name)
    return {"type": "object", "properties": {f.name: {"type": types[f.kind]} for f in own}, "required": [f.name for f in own if f.required]}


def tools() -> dict:
    """Name, description and input schema of every operation."""
    return {"tools": [{"name": name, "description": call.__doc__ or name, "input_schema": schema(name)} for name, call in api.OPERATIONS.items()]}


def reply(vault: Vault, line: str) -> dict | None:
    """The answer to one line of JSON-RPC; none to a notification. An operation that fails is an answer marked as an error."""
    try:
        asked = json.loads(line)
        method, given, number = asked["method"], asked.get("params") or {}, asked.get("id")
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": f"cannot be read: {e}"}}
    if number is None:
        return None
    if method == "initialize":
        result = {"protocolVersion": given.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": "vaultspark", "version": "1"}}
    elif method == "ping":
        result = {}
    elif method == "tools/list":
        result = {"tools": [{"name": t, "description": api.OPERATIONS[name].__doc__ or name, "inputSchema": schema(name)} for t, name in TOOLS.items()]}
    elif method == "tools/call" and given.get("name") in TOOLS:
        try:
            result = {"content": [{"type": "text", "text": api.execute(vault, TOOLS[given["name"]], given.get("arguments") or {})}]}
        except Exception as e:  # whatever fails is told to the client
            result = {"content": [{"type": "text", "text": str(e)}], "isError": True}
    else:
        what = f"no such tool: {given.get('name')}" if method == "tools/call" else f"no such method: {method}"
        return {"jsonrpc": "2.0", "id": number, "error": {"code": -32602 if method == "tools/call" else -32601, "message": what}}
    return {"jsonrpc": "2.0", "id": number, "result": result}


def converse(vault: Vault, lines: Iterable[str], out: TextIO) -> None:
    """Answers each line of `lines` with a line of `out`, until they end."""
    for line in lines:
        if line.strip() and (answer := reply(vault, line)) is not None:
            print(json.dumps(answer, ensure_ascii=False), file=out, flush=True)


def serve(vault: Vault, port: int = PORT, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that is bound and not yet running. Any failure of an operation is a 500 that tells why."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            self._answer(lambda query: dict(parse_qsl(query)))

        def do_POST(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            self._answer(lambda query: json.loads(body or b"{}"))

        def _answer(self, request) -> None:
            at = urlsplit(self.path)
            if at.path == "/tools":
                return self._send(200, json.dumps(tools()))
            if at.path not in PATHS:
                return self._send(404, json.dumps({"error": "no such path"}))
            try:
                self._send(200, api.execute(vault, PATHS[at.path], request(at.query)))
            except Exception as e:  # whatever fails is told to the client
                self._send(500, json.dumps({"error": f"Operation failed: {e}"}))

        def _send(self, status: int, body: str) -> None:
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)

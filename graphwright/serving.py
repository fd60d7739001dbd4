"""The engine's verbs as a service: JSON over HTTP, and JSON-RPC messages of the Model Context Protocol.

A call names a verb and gives its arguments; the answer has the first rows of the result and says whether there are more.
Only verbs that take plain values are served.
"""

from __future__ import annotations

import inspect
import json
from collections.abc import Iterable, Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qsl, urlsplit

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from graphwright.engine import Engine

#: Rows in an answer.
ROWS = 200
#: Verbs that are served.
VERBS = [
    "definition", "callers", "callees", "neighbors", "search", "outline", "reachable", "status", "cypher", "impact", "endpoints", "clients", "serves", "who_calls", "api_impact", "drift", "group_links",
    "list_repos", "timeline", "topics", "effort", "similar_commits", "similar_repos", "repo_map",
]
PROTOCOL = "2024-11-05"


def verbs() -> list[dict]:
    """The verbs with their parameters: name, description, and which are required."""
    out = []
    for name in VERBS:
        f = getattr(Engine, name)
        given = [p for p in list(inspect.signature(f).parameters.values())[1:] if p.kind is not p.VAR_KEYWORD]
        schema = {"type": "object", "properties": {p.name: {} for p in given}, "required": [p.name for p in given if p.default is p.empty]}
        out.append({"name": name, "description": (f.__doc__ or name.replace("_", " ")).strip(), "inputSchema": schema})
    return out


class Service:
    def __init__(self, engine: Engine, rows: int = ROWS):
        self.engine, self.rows = engine, rows

    def call(self, verb: str, arguments: dict[str, Any]) -> dict:
        """The result's columns and first rows."""
        if verb not in VERBS:
            raise KeyError(verb)
        found = getattr(self.engine, verb)(**arguments)
        assert isinstance(found, DataFrame)
        rows = [json.loads(r) for r in found.limit(self.rows + 1).toJSON().collect()]
        return {"columns": found.columns, "rows": rows[: self.rows], "more": len(rows) > self.rows}

    def message(self, m: dict) -> dict | None:
        """The answer to a JSON-RPC message; none to a notification."""
        if "id" not in m:
            return None
        answer = {"jsonrpc": "2.0", "id": m["id"]}
        try:
            return answer | {"result": self._result(m.get("method"), m.get("params") or {})}
        except KeyError as e:
            return answer | {"error": {"code": -32601, "message": f"unknown: {e.args[0]}"}}

    def _result(self, method: str, params: dict) -> dict:
        if method == "initialize":
            return {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "graphwright", "version": "1"}}
        if method == "ping":
            return {}
        if method == "tools/list":
            return {"tools": verbs()}
        if method == "tools/call":
            try:
                text, failed = json.dumps(self.call(params["name"], params.get("arguments") or {})), False
            except (TypeError, ValueError, PySparkException) as e:
                text, failed = str(e), True
            return {"content": [{"type": "text", "text": text}], "isError": failed}
        raise KeyError(method)

    def lines(self, messages: Iterable[str]) -> Iterator[str]:
        """Answers to messages of one line each, as over standard input and output."""
        for line in messages:
            try:
                answer = self.message(json.loads(line))
            except ValueError:
                answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
            if answer is not None:
                yield json.dumps(answer)


def server(engine: Engine, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """GET /verb?argument=value and POST /verb with a JSON object; POST /rpc with a message.  The caller runs serve_forever()."""
    service = Service(engine)

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, status: int, body) -> None:
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _call(self, verb: str, arguments: dict) -> None:
            try:
                self._answer(200, {"verbs": verbs()} if not verb else service.call(verb, arguments))
            except KeyError:
                self._answer(404, {"error": f"no verb {verb!r}"})
            except (TypeError, ValueError, PySparkException) as e:
                self._answer(400, {"error": str(e)})

        def do_GET(self) -> None:  # noqa: N802
            at = urlsplit(self.path)
            self._call(at.path.strip("/"), {k: int(v) if v.lstrip("-").isdigit() else v for k, v in parse_qsl(at.query)})

        def do_POST(self) -> None:  # noqa: N802
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
            except ValueError:
                return self._answer(400, {"error": "not JSON"})
            verb = urlsplit(self.path).path.strip("/")
            if verb == "rpc":
                return self._answer(200, service.message(body) or {})
            return self._call(verb, body)

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)

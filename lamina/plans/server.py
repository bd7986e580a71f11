"""JSON-RPC 2.0 over lines: the tool surface for clients that speak frames on standard input and output."""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator
from typing import IO

from lamina.plans.tools import RESOURCES, Engine, InvalidArguments, NotFound, descriptors

#: Error codes of the protocol and the longest frame.
PARSE_ERROR, INVALID_REQUEST, NO_METHOD, INTERNAL = -32700, -32600, -32601, -32603
LONGEST = 16 << 20
SCHEME = "memory://"


def _plain(value):
    return value.isoformat() if isinstance(value, (datetime.datetime, datetime.date)) else str(value)


class Server:
    """Answers frames one after another."""

    def __init__(self, engine: Engine):
        self.engine = engine

    def _tool(self, params: dict) -> dict:
        answer = self.engine.call(params.get("name"), params.get("arguments"))
        return {"content": [{"type": "text", "text": json.dumps(answer, ensure_ascii=False, default=_plain)}]}

    def _resource(self, params: dict) -> dict:
        uri = params.get("uri") or ""
        name, _, argument = uri.removeprefix(SCHEME).partition("/")
        for end in "?#/":
            argument = argument.split(end)[0]
            name = name.split(end)[0]
        body = self.engine.resource(name, argument or None)
        return {"contents": [{"uri": uri, "mimeType": "application/json", "text": json.dumps(body, ensure_ascii=False, default=_plain)}]}

    def dispatch(self, method: str, params: dict) -> dict:
        if method == "initialize":
            return {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}, "resources": {}}, "serverInfo": {"name": "lamina", "version": "1"}}
        if method == "ping":
            return {}
        if method == "tools/list":
            return {"tools": descriptors()}
        if method == "resources/list":
            return {"resources": [{"uri": SCHEME + r, "name": r} for r in RESOURCES]}
        if method == "tools/call":
            return self._tool(params)
        if method == "resources/read":
            return self._resource(params)
        raise LookupError(method)

    def answer(self, frame: str | bytes) -> dict | None:
        """The response to one frame; None for notifications."""
        try:
            request = json.loads(frame)
        except ValueError:
            return {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": "parse error"}}
        if not isinstance(request, dict) or request.get("jsonrpc") != "2.0" or not isinstance(request.get("method"), str):
            return {"jsonrpc": "2.0", "id": request.get("id") if isinstance(request, dict) else None, "error": {"code": INVALID_REQUEST, "message": "invalid request"}}
        if "id" not in request:
            return None
        reply = {"jsonrpc": "2.0", "id": request["id"]}
        try:
            return reply | {"result": self.dispatch(request["method"], request.get("params") or {})}
        except (InvalidArguments, NotFound) as e:
            return reply | {"error": {"code": e.code, "message": str(e)}}
        except LookupError as e:
            return reply | {"error": {"code": NO_METHOD, "message": f"no method {e}"}}
        except Exception as e:  # noqa: BLE001  the loop goes on
            return reply | {"error": {"code": INTERNAL, "message": str(e)[:500]}}

    @staticmethod
    def _frames(source: IO[str]) -> Iterator[tuple[str, bool]]:
        """(line, whether it is whole); of a line beyond the cap only the cap's part is ever held."""
        while line := source.readline(LONGEST + 1):
            whole = len(line) <= LONGEST or line.endswith("\n")
            while not whole and (more := source.readline(1 << 20)) and not more.endswith("\n"):
                pass
            yield line, whole and len(line) <= LONGEST + 1

    def serve(self, source: IO[str], sink: IO[str]) -> None:
        """Read lines until the end; blanks are skipped, an oversized frame is answered with an error and dropped; however the loop ends, the engine is closed."""
        self.engine.open()
        try:
            for line, whole in self._frames(source):
                if not line.strip():
                    continue
                reply = self.answer(line) if whole else {"jsonrpc": "2.0", "id": None, "error": {"code": INVALID_REQUEST, "message": "frame too long"}}
                if reply is not None:
                    sink.write(json.dumps(reply, ensure_ascii=False) + "\n")
                    sink.flush()
        finally:  # also where the loop is interrupted: turns are saved, the session ends, the lock goes
            self.engine.close()

"""Questions over JSON lines, and an editor's requests, on streams."""

from __future__ import annotations

import json
import time
from typing import IO

from pyspark.sql import functions as F

from codeloom.operators import lookup
from codeloom.plans.api import TOOLS, Workbench, ask


class ToolServer:
    """JSON-RPC, a message a line. A refresh runs before a call, at most every so many seconds; its failure doesn't fail the call."""

    def __init__(self, bench: Workbench, refresh_seconds: float | None = 2.0):
        self.bench, self.every, self.last = bench, refresh_seconds, 0.0

    def _refresh(self) -> None:
        if self.every is None or not self.bench.root or time.monotonic() - self.last < self.every:
            return
        try:
            self.bench.sync()
        except Exception:  # noqa: BLE001  a stale answer is better than none
            pass
        self.last = time.monotonic()

    def dispatch(self, message: dict) -> dict | None:
        method, id_ = message.get("method"), message.get("id")
        if id_ is None:
            return None
        if method == "initialize":
            return self._ok(id_, {"serverInfo": {"name": "codeloom"}, "capabilities": {"tools": {}}})
        if method == "tools/list":
            return self._ok(id_, {"tools": [{"name": n, "inputSchema": {"type": "object", "properties": {a: {"type": "string"} for a in needed}, "required": list(needed)}} for n, (needed, _) in TOOLS.items()]})
        if method == "tools/call":
            p = message.get("params") or {}
            name = p.get("name")
            if name not in TOOLS:
                return self._error(id_, -32602, f"no tool {name}")
            self._refresh()
            try:
                text, bad = ask(self.bench, name, **(p.get("arguments") or {})), False
            except Exception as x:  # noqa: BLE001  one call's failure is its answer
                text, bad = f"{type(x).__name__}: {x}", True
            return self._ok(id_, {"content": [{"type": "text", "text": text}], "isError": bad})
        return self._ok(id_, {}) if method == "ping" else self._error(id_, -32601, f"no method {method}")

    @staticmethod
    def _ok(id_, result) -> dict:
        return {"jsonrpc": "2.0", "id": id_, "result": result}

    @staticmethod
    def _error(id_, code: int, text: str) -> dict:
        return {"jsonrpc": "2.0", "id": id_, "error": {"code": code, "message": text}}

    def run(self, source: IO[str], sink: IO[str]) -> None:
        for line in source:
            try:
                message = json.loads(line)
            except ValueError:
                reply = self._error(None, -32700, "not JSON")
            else:
                reply = self.dispatch(message) if isinstance(message, dict) else self._error(None, -32600, "not a request")
            if reply is not None:
                sink.write(json.dumps(reply) + "\n")
                sink.flush()


class EditorServer:
    """Definition, references, hover, document and workspace symbols, in messages with a length before them."""

    KINDS = {"file": 1, "package": 4, "class": 5, "method": 6, "field": 8, "function": 12, "constant": 14, "route": 24}

    def __init__(self, bench: Workbench):
        self.bench = bench

    def _file(self, params: dict) -> str:
        uri = params["textDocument"]["uri"].removeprefix("file://")
        root = (self.bench.root or "").removeprefix("file://").rstrip("/")
        return uri.removeprefix(root).lstrip("/")

    def _place(self, file: str, line: int | None) -> dict:
        at = {"line": max(0, (line or 1) - 1), "character": 0}
        return {"uri": f"file://{(self.bench.root or '').rstrip('/')}/{file}", "range": {"start": at, "end": at}}

    def dispatch(self, message: dict) -> dict | None:
        method, id_, p = message.get("method"), message.get("id"), message.get("params") or {}
        if id_ is None:
            return None
        found = {"initialize": self._initialize, "textDocument/definition": self._definition, "textDocument/references": self._references, "textDocument/hover": self._hover, "textDocument/documentSymbol": self._outline, "workspace/symbol": self._symbols, "shutdown": lambda p: None}.get(method)
        if found is None:
            return {"jsonrpc": "2.0", "id": id_, "error": {"code": -32601, "message": f"no method {method}"}}
        return {"jsonrpc": "2.0", "id": id_, "result": found(p)}

    def _initialize(self, p: dict) -> dict:
        return {"capabilities": {"definitionProvider": True, "referencesProvider": True, "hoverProvider": True, "documentSymbolProvider": True, "workspaceSymbolProvider": True}}

    def _at(self, p: dict) -> tuple[str, int]:
        return self._file(p), p["position"]["line"] + 1

    def _definition(self, p: dict) -> list:
        return [self._place(r.file_path, r.start_line) for r in lookup.definition_at(self.bench.graph, *self._at(p)).limit(50).collect()]

    def _references(self, p: dict) -> list:
        return [self._place(r.file, r.line) for r in lookup.references_at(self.bench.graph, *self._at(p)).limit(500).collect()]

    def _hover(self, p: dict) -> dict | None:
        r = lookup.symbol_at(self.bench.graph, *self._at(p)).first()
        return r and {"contents": {"kind": "markdown", "value": f"**{r.kind}** `{r.qualified_name}{r.signature or ''}`" + (f"\n\n{r.docstring}" if r.docstring else "")}}

    def _symbol(self, r) -> dict:
        return {"name": r.qualified_name or r.name or "", "kind": self.KINDS.get(r.kind, 13), "location": self._place(r.file_path or "", r.start_line)}

    def _outline(self, p: dict) -> list:
        found = lookup.nodes_in_file(self.bench.graph, self._file(p)).where("kind <> 'file'").orderBy("start_line", "id")
        return [self._symbol(r) for r in found.limit(2_000).collect()]

    def _symbols(self, p: dict) -> list:
        return [self._symbol(r) for r in lookup.symbols_like(self.bench.graph, p.get("query", "")).where(F.col("kind") != "file").collect()]

    def run(self, source: IO[bytes], sink: IO[bytes]) -> None:
        while True:
            size = 0
            while (line := source.readline()) and line.strip():
                name, _, value = line.decode("ascii", "replace").partition(":")
                if name.lower() == "content-length":
                    size = int(value)
            if not line:
                return
            message = json.loads(source.read(size) or b"{}")
            if message.get("method") == "exit":
                return
            reply = self.dispatch(message)
            if reply is not None:
                raw = json.dumps(reply).encode()
                sink.write(b"Content-Length: %d\r\n\r\n" % len(raw) + raw)
                sink.flush()

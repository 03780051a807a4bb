"""JSON-RPC 2.0 tool server over standard input and output, a request a line."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from symloom.engine import SYMBOL_COLUMNS, Engine
from symloom.plans.index import IndexNotFound

PARSE, INVALID, NO_METHOD, BAD_PARAMS, INTERNAL = -32700, -32600, -32601, -32602, -32603
PROTOCOL = "2024-11-05"


class RpcError(Exception):
    def __init__(self, code: int, message: str) -> None:
        super().__init__(message)
        self.code = code


def _schema(required: list[str], **kinds: str) -> dict:
    return {"type": "object", "properties": {k: {"type": t} for k, t in kinds.items()}, **({"required": required} if required else {})}


TOOLS = [
    ("search", "Full-text search over names, qualified names, paths and signatures.", _schema(["query"], query="string", limit="integer")),
    ("semantic_search", "Symbols whose vectors are most similar to that of a text.", _schema(["query"], query="string", limit="integer")),
    ("find_symbol", "Symbols whose name contains a text.", _schema(["needle"], needle="string", kind="string", lang="string", limit="integer")),
    ("get_symbol", "A symbol by its id.", _schema(["id"], id="string")),
    ("find_callers", "What refers to a symbol.", _schema(["id"], id="string")),
    ("find_callees", "What a symbol refers to.", _schema(["id"], id="string")),
    ("expand_neighborhood", "The graph around a symbol.", _schema(["id"], id="string", depth="integer", cap="integer")),
    ("index", "Build the index anew.", _schema([])),
    ("incremental_index", "Bring the index up to date.", _schema([])),
    ("index_status", "What is indexed.", _schema([])),
]


class Server:
    def __init__(self, engine: Engine) -> None:
        self.engine = engine

    def _id(self, args: dict) -> str:
        value = args.get("id")
        if not isinstance(value, str) or len(value) != 32 or any(c not in "0123456789abcdefABCDEF" for c in value):
            raise RpcError(BAD_PARAMS, "id must be 32 hex characters")
        return value.lower()

    def call(self, tool: str, args: dict):
        e = self.engine
        rows = lambda df: [r.asDict() for r in df.collect()]
        limit = lambda n: int(args.get("limit", n))
        try:
            match tool:
                case "search":
                    return rows(e.search(args.get("query", ""), limit(20)))
                case "semantic_search":
                    return rows(e.semantic_search(args.get("query", ""), limit(10)))
                case "find_symbol":
                    found = e.find(args.get("needle", ""), args.get("kind"), args.get("lang"), limit(20))
                    return rows(found.select(*SYMBOL_COLUMNS, "start_line", "end_line", "signature"))
                case "get_symbol":
                    found = rows(e.get(self._id(args)).select(*SYMBOL_COLUMNS, "fqname", "start_line", "end_line", "signature", "doc"))
                    if not found:
                        raise RpcError(BAD_PARAMS, "unknown symbol")
                    return found[0]
                case "find_callers" | "find_callees":
                    return rows(e.linked(self._id(args), tool == "find_callers"))
                case "expand_neighborhood":
                    around, text = e.neighborhood(self._id(args), int(args.get("depth", 2)), int(args.get("cap", 50)))
                    return {"text": text, "node_count": around.nodes.count(), "edge_count": around.edges.count()}
                case "index":
                    e.index()
                    now = e.status()
                    return {"symbols": now["symbols"], "edges": now["edges"], "status": "ok"}
                case "incremental_index":
                    done = e.index(incremental=True)
                    return (vars(done) if done else {}) | {"status": "ok"}
                case "index_status":
                    return e.status()
        except IndexNotFound:
            return [] if tool != "expand_neighborhood" else {"text": "", "node_count": 0, "edge_count": 0}
        except (RpcError, TypeError, ValueError) as err:
            raise err if isinstance(err, RpcError) else RpcError(BAD_PARAMS, str(err)) from err
        raise RpcError(NO_METHOD, f"unknown tool {tool}")

    def dispatch(self, request: dict):
        if request.get("jsonrpc") != "2.0":
            raise RpcError(INVALID, "jsonrpc must be 2.0")
        params = request.get("params") or {}
        match request.get("method"):
            case "initialize":
                return {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "symloom", "version": "0.1.0"}}
            case "tools/list":
                return {"tools": [{"name": n, "description": d, "inputSchema": s} for n, d, s in TOOLS]}
            case "tools/call":
                if not params.get("name"):
                    raise RpcError(BAD_PARAMS, "a tool's name is missing")
                result = self.call(params["name"], params.get("arguments") or {})
                return {"content": [{"type": "text", "text": json.dumps(result, default=str)}]}
        raise RpcError(NO_METHOD, f"unknown method {request.get('method')}")

    def answer(self, line: str) -> str | None:
        """The reply to one line; null for a blank one."""
        if not line.strip():
            return None
        number = None
        try:
            try:
                request = json.loads(line)
            except ValueError as e:
                raise RpcError(PARSE, str(e)) from e
            if not isinstance(request, dict):
                raise RpcError(INVALID, "a request is an object")
            number = request.get("id")
            return json.dumps({"jsonrpc": "2.0", "id": number, "result": self.dispatch(request)})
        except RpcError as e:
            return json.dumps({"jsonrpc": "2.0", "id": number, "error": {"code": e.code, "message": str(e)}})
        except Exception as e:  # noqa: BLE001  the server must go on
            return json.dumps({"jsonrpc": "2.0", "id": number, "error": {"code": INTERNAL, "message": str(e)[:500]}})


def serve(server: Server, lines=sys.stdin, write: Callable[[str], object] | None = None) -> None:
    for line in lines:
        reply = server.answer(line)
        if reply is not None:
            (write or (lambda s: print(s, flush=True)))(reply)


def main() -> None:
    from pyspark.sql import SparkSession

    p = argparse.ArgumentParser(prog="symloom.rpc")
    p.add_argument("--base", default=".")
    args = p.parse_args()
    spark = SparkSession.builder.appName("symloom-rpc").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    serve(Server(Engine(spark, args.base)))


if __name__ == "__main__":
    main()

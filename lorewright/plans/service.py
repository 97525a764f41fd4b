"""The engine's service surface: an OpenAI-style chat endpoint, MCP tools and agent-to-agent JSON-RPC."""

from __future__ import annotations

import json
import time
import uuid
from collections import deque
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from lorewright import __version__
from lorewright.plans.engine import Engine

MCP_PROTOCOL = "2024-11-05"
PARSE_ERROR, NO_METHOD, BAD_PARAMS, INTERNAL = -32700, -32601, -32602, -32603
CORS = {"Access-Control-Allow-Origin": "*", "Access-Control-Allow-Methods": "GET, POST, OPTIONS", "Access-Control-Allow-Headers": "Content-Type, Authorization"}


class RpcError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def authorised(key: str, path: str, method: str, header: str | None) -> bool:
    return not key or path == "/health" or method == "OPTIONS" or header == f"Bearer {key}"


def dispatch(body: str | bytes, methods: dict) -> dict:
    """One JSON-RPC call; errors come back as replies."""
    try:
        request = json.loads(body)
        assert isinstance(request, dict)
    except Exception:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": "the request is not JSON"}}
    head = {"jsonrpc": "2.0", "id": request.get("id")}
    method = methods.get(request.get("method"))
    if method is None:
        return head | {"error": {"code": NO_METHOD, "message": f"no method {request.get('method')!r}"}}
    try:
        return head | {"result": method(request.get("params") or {})}
    except RpcError as e:
        return head | {"error": {"code": e.code, "message": str(e)}}


def keep_alive(every: float = 30.0, sleep=time.sleep) -> Iterator[str]:
    """The event stream of the tools' endpoint: where to post, then a ping every 30 seconds until the client is gone."""
    yield "event: endpoint\ndata: /mcp\n\n"
    while True:
        sleep(every)
        yield ": ping\n\n"


class Service:
    """What the routes do, apart from HTTP."""

    def __init__(self, engine: Engine):
        self.engine = engine
        self.log: deque[dict] = deque(maxlen=10_000)  # the latest requests

    def tools(self) -> list[dict]:
        listed = ((self.engine.agent.get("mcp") or {}).get("tools")) or []
        query = {"query": {"type": "string", "description": "what to look for"}}
        limit = {"top_k": {"type": "integer", "description": "how many texts to return"}}
        if not listed:
            slug = self.engine.name.lower().replace(" ", "_")
            return [{"name": f"search_{slug}_knowledge", "description": f"Search the knowledge of {self.engine.name}.", "inputSchema": {"type": "object", "properties": query, "required": ["query"]}}]
        return [{"name": t["name"], "description": t.get("description", ""), "inputSchema": {"type": "object", "properties": query | limit, "required": ["query"]}} for t in listed]

    def _tool(self, params: dict) -> dict:
        given = params.get("arguments") if isinstance(params, dict) else None
        query = (given or {}).get("query") if isinstance(given, dict) else None
        if not isinstance(query, str) or not query.strip():
            raise RpcError(BAD_PARAMS, "a query is needed")
        k = given.get("top_k") or 0
        try:
            text = self.engine.context(query, k if isinstance(k, int) and k > 0 else 5)
        except Exception as e:
            raise RpcError(INTERNAL, str(e)) from e
        return {"content": [{"type": "text", "text": text}]}

    def mcp(self, body) -> dict:
        hello = {"protocolVersion": MCP_PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": self.engine.name, "version": __version__}}
        return dispatch(body, {"initialize": lambda p: hello, "tools/list": lambda p: {"tools": self.tools()}, "tools/call": self._tool})

    def _query(self, params: dict) -> str:
        query = params.get("query") if isinstance(params, dict) else None
        if not isinstance(query, str) or not query.strip():
            raise RpcError(BAD_PARAMS, "a query is needed")
        return query

    def _ask(self, params: dict) -> dict:
        query = self._query(params)
        try:
            return self.engine.ask(query, params.get("system_prompt") or "", params.get("history"))
        except Exception as e:
            raise RpcError(INTERNAL, str(e)) from e

    def _search(self, params: dict) -> dict:
        query = self._query(params)
        try:
            return self.engine.search(query, params.get("top_k") or 0)
        except Exception as e:
            raise RpcError(INTERNAL, str(e)) from e

    def _info(self, params: dict) -> dict:
        about = self.engine.agent.get("agent") or {}
        return {
            "name": self.engine.name, "description": about.get("description", ""), "version": about.get("version", ""), "tools": self.tools(), "stats": {"vectors": self.engine.vectors.count(), "triples": self.engine.facts.count()},
            "endpoints": {"chat": "/v1/chat/completions", "mcp": "/mcp", "agent": "/rpc/agent", "health": "/health"}, "capabilities": {"search": True, "chat": True, "streaming": True},
        }

    def agent(self, body) -> dict:
        return dispatch(body, {"agent.info": self._info, "agent.query": self._ask, "agent.search": self._search})

    def health(self) -> dict:
        return self.engine.stats() | {"time": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}

    def completion(self, request: dict) -> dict:
        text = self.engine.chat(request.get("messages") or [])
        choice = {"index": 0, "message": {"role": "assistant", "content": text}, "finish_reason": "stop"}
        return {"id": f"chatcmpl-{uuid.uuid4()}", "object": "chat.completion", "created": int(time.time()), "model": getattr(self.engine.models.chat, "model", ""), "choices": [choice]}

    def events(self, request: dict) -> Iterator[str]:
        """Server-sent events: a chunk per piece of text, an error if the model fails, then the end mark."""
        head = {"id": f"chatcmpl-{uuid.uuid4()}", "object": "chat.completion.chunk", "created": int(time.time()), "model": getattr(self.engine.models.chat, "model", "")}
        try:
            for piece in self.engine.stream(request):
                yield f"data: {json.dumps(head | {'choices': [{'index': 0, 'delta': {'content': piece}}]})}\n\n"
        except Exception as e:
            yield f"data: {json.dumps({'error': {'message': str(e)}})}\n\n"
        yield "data: [DONE]\n\n"

    def handle(self, method: str, path: str, body: bytes = b"", header: str | None = None) -> tuple[int, object]:
        """Status and reply: a dict, text, or an iterator of events."""
        if method == "OPTIONS":
            return 204, ""
        if not authorised(self.engine.api_key, path, method, header):
            return 401, {"error": "unauthorised"}
        if path == "/health":
            return 200, self.health()
        if path == "/mcp":
            if method == "GET":
                return 200, keep_alive()
            return (200, self.mcp(body)) if method == "POST" else (405, {"error": "method not allowed"})
        if path == "/rpc/agent":
            return (200, self.agent(body)) if method == "POST" else (405, {"error": "method not allowed"})
        if path == "/v1/chat/completions":
            if method != "POST":
                return 405, {"error": "method not allowed"}
            try:
                request = json.loads(body)
                assert isinstance(request, dict)
            except Exception:
                return 400, {"error": "the request is not JSON"}
            if request.get("stream"):
                return 200, self.events(request)
            try:
                return 200, self.completion(request)
            except Exception as e:
                return 502, {"error": str(e)}
        return 404, {"error": "not found"}


def serve(engine: Engine, port: int) -> ThreadingHTTPServer:
    """An HTTP server for an engine; call serve_forever() on it."""
    service = Service(engine)

    class Handler(BaseHTTPRequestHandler):
        def _any(self):
            began = time.time()
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, reply = service.handle(self.command, self.path, body, self.headers.get("Authorization"))
            self.send_response(status)
            for k, v in CORS.items():
                self.send_header(k, v)
            events = not isinstance(reply, (dict, str))
            self.send_header("Content-Type", "text/event-stream" if events else "application/json")
            self.end_headers()
            try:
                for part in reply if events else [reply if isinstance(reply, str) else json.dumps(reply)]:
                    self.wfile.write(part.encode())
                    self.wfile.flush()
            except (BrokenPipeError, ConnectionResetError):  # the client is gone
                pass
            service.log.append({"method": self.command, "path": self.path, "status": status, "seconds": time.time() - began, "remote": self.client_address[0]})

        do_GET = do_POST = do_OPTIONS = do_PUT = do_DELETE = _any

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer(("0.0.0.0", port), Handler)

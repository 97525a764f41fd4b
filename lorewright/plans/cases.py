"""Queries over stated cases, for parts of the engine that no table of rows describes: files, stores, replies of models
and of the service, configuration. Each gives (case, result) rows, beside the results they must have as SQL."""

from __future__ import annotations

import json
import threading
import uuid
import zlib
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright import __version__
from lorewright.functions.scratch import own
from lorewright.operators import chunk, rerank, triples
from lorewright.plans import cli
from lorewright.plans import config as cfg
from lorewright.plans.engine import Engine, Models, compile_documents
from lorewright.plans.service import Service, keep_alive
from lorewright.sources import files, models
from lorewright.sources.stores import GraphStore, VectorStore


def told(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(c, str(r)) for c, r in rows], "case string, result string")


def failing(call) -> str:
    """The kind of error that a call ends with."""
    try:
        call()
    except Exception as e:
        return type(e).__name__
    return "no error"


def expected(rows: list[tuple[str, str]]) -> str:
    quoted = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return 'SELECT * FROM (VALUES {}) AS t("case", result)'.format(", ".join(f"({quoted(c)}, {quoted(r)})" for c, r in rows))


# --- files ----------------------------------------------------------------------------------------------------


def deflated_pdf(text: str) -> bytes:
    body = zlib.compress(f"BT /F1 12 Tf ({text}) Tj ET".encode())
    return b"%%PDF-1.4\n1 0 obj\n<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(body) + body + b"\nendstream\nendobj\n"


def put(spark: SparkSession, folder: str, name: str, data: bytes) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data))
    out.close()


FILES = {
    "a.md": b"# Title\r\n\nText.", "B.TXT": b"plain", "c.Markdown": "é".encode(), "bad.txt": b"a\xff", "p.pdf": deflated_pdf("Pumps move water"), "broken.pdf": b"%PDF nothing", "x.docx": b"no", "noext": b"no", "sub/deep.md": b"deep",
}


def file_reads(spark, d):
    folder = f"{own(spark)}/files-{uuid.uuid4().hex}"
    for name, data in FILES.items():
        put(spark, folder, name, data)
    read = files.load_directory(spark, folder).select(F.concat(F.lit("folder: "), "name").alias("case"), F.col("content").alias("result"))
    one = files.load_file(spark, f"{folder}/p.pdf").select(F.lit("file: p.pdf").alias("case"), F.col("content").alias("result"))
    errors = [("file: x.docx", failing(lambda: files.load_file(spark, f"{folder}/x.docx"))), ("file: broken.pdf", failing(lambda: files.load_file(spark, f"{folder}/broken.pdf").collect()))]
    return read.unionByName(one).unionByName(told(spark, errors))


# --- stores and the build -------------------------------------------------------------------------------------


def store_steps(spark, d):
    """Rows in the stores after each step: vectors by id, facts by their three fields, a store opened again."""
    at = f"{own(spark)}/stores-{uuid.uuid4().hex}"
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    row = lambda df, text: df.select(F.col("vec_id").cast("string").alias("id"), F.lit(text).alias("content"), F.create_map(F.lit("source"), F.lit("s")).alias("metadata"), "embedding")
    v = VectorStore(spark, f"{at}/v")
    steps = [("vectors: none yet", v.count())]
    v.add(row(e.filter("label < 6"), "old"))
    steps.append(("vectors: first batch", v.count()))
    v.add(row(e.filter("vec_id % 3 = 0"), "new"))
    steps += [("vectors: second batch", v.count()), ("vectors: replaced", v.table().filter("content = 'new'").count()), ("vectors: opened again", VectorStore(spark, f"{at}/v").count())]
    v.add(row(e.filter("label < 2"), "all"), "overwrite")
    steps.append(("vectors: overwritten", v.count()))
    t = spark.read.parquet(f"{d}/triples.parquet").filter("triple_seq is not null").select("triple_seq", "subject", "predicate", "object")
    g = GraphStore(spark, f"{at}/g")
    for name in ("facts: first batch", "facts: same batch"):
        g.add(t)
        steps.append((name, g.count()))
    m = GraphStore(spark)
    m.add(t.limit(0))
    steps.append(("facts: in memory, none", m.count()))
    m.close()
    return spark.createDataFrame([(c, int(n)) for c, n in steps], "case string, n long")


def build_counts(spark, d):
    """The build over all source files with the offline models: chunks and vectors, and what it does without documents."""
    at = f"{own(spark)}/build-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{d}/source_files.parquet").filter("content is not null").dropDuplicates(["file_id"])
    # names of edited copies repeat, so files are named by their number too
    docs = docs.select(F.concat_ws("-", F.lpad(F.col("file_id").cast("string"), 12, "0"), "name").alias("name"), "content")
    v, g = VectorStore(spark, f"{at}/v"), GraphStore(spark, f"{at}/g")
    report = compile_documents(spark, docs, v, g, Models.offline(64), chunk.ChunkOptions(1000, 200))
    none = failing(lambda: compile_documents(spark, docs.limit(0), v, g, Models.offline(64), chunk.ChunkOptions(1000, 200)))
    return told(spark, [("chunks", report["chunks"]), ("vectors", v.count()), ("failed batches", report["failed_batches"]), ("without documents", none)])


# --- models ---------------------------------------------------------------------------------------------------


class Stand(BaseHTTPRequestHandler):
    """A model service on this machine: the first request for embeddings is refused as too many."""

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.server.seen.append((self.path, body, self.headers.get("Authorization")))
        status, reply = 200, {}
        if self.path == "/embeddings":
            if len(self.server.seen) == 1:
                status, reply = 429, {"error": "Too Many Requests"}
            else:
                reply = {"data": [{"index": i, "embedding": [float(len(t)), 1.0, 2.0]} for i, t in reversed(list(enumerate(body["input"])))]}
        elif self.path == "/chat/completions":
            asked = body["messages"][-1]["content"]
            reply = {"choices": [{"message": {"content": "" if asked == "nothing" else f"{len(body['messages'])} to {body.get('model')}"}}]}
        elif self.path == "/rerank":
            reply = {"results": [{"index": 1, "relevance_score": 0.9}, {"index": 0, "relevance_score": 0.1}]}
        data = json.dumps(reply).encode()
        if body.get("stream"):
            data = b'data: {"choices":[{"delta":{"content":"a"}}]}\n\ndata: {"choices":[{"delta":{}}]}\n\ndata: {"choices":[{"delta":{"content":"b"}}]}\n\ndata: [DONE]\n\n'
        self.send_response(status)
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *args):
        pass


def model_calls(spark, d):
    """Requests to a stand-in service over HTTP: placing by index, cutting, waiting after a refusal, empty replies."""
    server = HTTPServer(("127.0.0.1", 0), Stand)
    server.seen = []
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url, waits = f"http://127.0.0.1:{server.server_port}", []
    try:
        e, c = models.HttpEmbedder(url, "key", "", 2), models.HttpChat(url, "", "m")
        rows = [("embed after a refusal", models.retried(lambda: e.embed(["a", "bbb"]), sleep=waits.append)), ("waits", waits), ("key is sent", server.seen[0][2]), ("no model is sent", "model" in server.seen[0][1])]
        rows += [("complete", c.complete("hello", "be brief")), ("chat", c.chat([{"role": "user", "content": "x"}])), ("empty reply", failing(lambda: c.complete("nothing"))), ("stream", "".join(c.stream({"messages": [{"role": "user", "content": "x"}]})))]
        rows += [("rerank", models.HttpReranker(url + "/rerank", "", "m").scores("q", ["a", "b"])), ("describe", c.describe("agent", "text")), ("triples", c.triples("text"))]
        calls: list[int] = []

        def refused():
            calls.append(1)
            raise RuntimeError("status 429")

        rows += [("refused for good", failing(lambda: models.retried(refused, sleep=waits.append))), ("attempts", len(calls)), ("waits of all", waits), ("other errors", failing(lambda: models.retried(lambda: 1 / 0, sleep=waits.append)))]
    finally:
        server.shutdown()
        server.server_close()
    ends = [("no model", rerank.endpoint("http://h", "")), ("address", rerank.endpoint("http://h/", "m")), ("whole address", rerank.endpoint("http://h/v1/rerank", "m")), ("own address", rerank.endpoint("http://h", "m", "http://o"))]
    return told(spark, rows + [(f"rerank address: {c}", x) for c, x in ends])


MODEL_CALLS = [
    ("embed after a refusal", "[[1.0, 1.0], [3.0, 1.0]]"), ("waits", "[1.0, 1.0, 2.0, 4.0, 8.0]"), ("key is sent", "Bearer key"), ("no model is sent", "False"), ("complete", "2 to m"), ("chat", "1 to m"), ("empty reply", "EmptyResponse"), ("stream", "ab"),
    ("rerank", "[(1, 0.9), (0, 0.1)]"), ("describe", "1 to m"), ("triples", "1 to m"), ("refused for good", "RuntimeError"), ("attempts", "5"), ("waits of all", "[1.0, 1.0, 2.0, 4.0, 8.0]"), ("other errors", "ZeroDivisionError"),
    ("rerank address: no model", "None"), ("rerank address: address", "http://h/rerank"), ("rerank address: whole address", "http://h/v1/rerank"), ("rerank address: own address", "http://o"),
]


@dataclass
class Moody:
    """A model that finds triples after as many failures as the text names."""

    failures: dict = field(default_factory=dict)

    def start(self):
        return Moody()

    def triples(self, text: str) -> str:
        kind, _, n = text.partition(" ")
        self.failures[text] = self.failures.get(text, 0) + 1
        if kind == "fails" and self.failures[text] <= int(n):
            raise RuntimeError("no answer")
        fact = {"capitals": '{"Subject":"a","PREDICATE":"b","object":"c"}', "number": '{"subject":1,"predicate":"b","object":"c"}', "blank": '{"subject":"","predicate":"b","object":"c"}'}.get(kind, '{"subject":"a","predicate":"b","object":"c"}')
        return {"fenced": f"```json\n[{fact}]\n```", "prose": f"Here: [{fact}] as asked.", "none": "no facts", "cut": '[{"subject": "a"]'}.get(kind, f"[{fact}]")


def extract_retries(spark, d):
    """Batches sent to a model that fails or answers oddly: facts found, attempts made, what is kept of an error."""
    texts = ["plain", "fails 2", "fails 9", "fenced", "prose", "none", "cut", "capitals", "number", "blank"]
    df = spark.createDataFrame(list(enumerate(texts)), "batch_id long, text string")
    got = triples.extract(df, Moody()).select("batch_id", F.size("triples").alias("n"), F.coalesce("error", F.lit("")).alias("error"), "attempts")
    return got.join(df, "batch_id").select(F.col("text").alias("case"), F.col("n").cast("int").alias("n"), "error", "attempts")


def embed_sequential(spark, d):
    """The sequential mode of the embedder gives the vectors of the parallel one: the numbers that are not zero."""
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("text is not null").select("doc_id", "text")
    from lorewright.functions.text import embeddable

    docs = docs.filter(embeddable("text") != "")
    out = models.embed_column(docs, "text", models.HashEmbedder(64), parallel=False)
    return out.select("doc_id", F.posexplode("embedding").alias("dim", "w")).filter("w <> 0").select("doc_id", "dim")


# --- service --------------------------------------------------------------------------------------------------


def small_engine(spark) -> Engine:
    v, g = VectorStore(spark), GraphStore(spark)
    texts = [("a_0", "Ada Lovelace wrote notes.", "a.md"), ("b_0", "Pumps move water.", "b.md"), ("c_0", "Water cools engines.", "c.md")]
    m = Models.offline(64)
    rows = [(i, t, {"source": s, "index": "0"}, x) for (i, t, s), x in zip(texts, m.embedder.embed([t for _, t, _ in texts]))]
    v.add(spark.createDataFrame(rows, v.schema))
    g.add(spark.createDataFrame([(0, "Ada", "wrote", "notes"), (1, "Pumps", "move", "water")], g.schema))
    return Engine(spark, v, g, m, {"agent": {"name": "My Agent", "system_prompt": "Be brief.", "version": "2"}})


def service_replies(spark, d):
    """Requests to the routes: status, and the part of the reply that the case is about."""
    engine = small_engine(spark)
    s = Service(engine)

    def post(path, body):
        return s.handle("POST", path, body if isinstance(body, bytes) else json.dumps(body).encode())

    def rpc(path, method, params=None):
        reply = post(path, {"jsonrpc": "2.0", "id": 7, "method": method} | ({"params": params} if params is not None else {}))[1]
        assert reply["jsonrpc"] == "2.0" and reply["id"] == 7
        return reply.get("result", reply.get("error"))

    code = lambda path, method, params=None: rpc(path, method, params).get("code")
    health = s.handle("GET", "/health")[1]
    chat = post("/v1/chat/completions", {"messages": [{"role": "user", "content": "hi there"}]})[1]
    events = list(post("/v1/chat/completions", {"stream": True, "messages": [{"role": "user", "content": "hi"}]})[1])
    opened = keep_alive(sleep=lambda t: None)
    found = rpc("/rpc/agent", "agent.search", {"query": "ada water", "top_k": 1})
    info = rpc("/rpc/agent", "agent.info")
    sent = engine.messages([{"role": "system", "content": "drop"}, {"role": "user", "content": "water"}])
    rows = [
        ("health", [health[k] for k in ("status", "agent", "vectors", "triples", "dimensions", "reranker_enabled")]), ("chat", chat["choices"][0]["message"]), ("chat id", chat["id"].startswith("chatcmpl-") and len(chat["id"]) == 45), ("chat object", chat["object"]),
        ("chat without JSON", post("/v1/chat/completions", b"{")[0]), ("chat by GET", s.handle("GET", "/v1/chat/completions")[0]), ("stream", [json.loads(x[6:])["choices"][0]["delta"]["content"] for x in events[:-1]]), ("stream end", events[-1].strip()),
        ("mcp initialize", rpc("/mcp", "initialize")), ("mcp list", [t["name"] for t in rpc("/mcp", "tools/list")["tools"]]), ("mcp call", rpc("/mcp", "tools/call", {"name": "t", "arguments": {"query": "water", "top_k": 1}})["content"][0]["text"].count("**[")),
        ("mcp call without query", code("/mcp", "tools/call", {"arguments": {}})), ("mcp unknown", code("/mcp", "nope")), ("mcp without JSON", post("/mcp", b"x")[1]["error"]["code"]), ("mcp by PUT", s.handle("PUT", "/mcp")[0]), ("mcp stream", [next(opened), next(opened), next(opened)]),
        ("agent info", [info["name"], info["version"], info["stats"]]), ("agent query", rpc("/rpc/agent", "agent.query", {"query": "water"})["answer"]), ("agent query with history", rpc("/rpc/agent", "agent.query", {"query": "b", "history": [{"role": "user", "content": "a"}]})["answer"]),
        ("agent query without query", code("/rpc/agent", "agent.query", {})), ("agent search", [len(found["vector_results"]), len(found["graph_results"]), found["query"]]), ("agent unknown", code("/rpc/agent", "agent.nope")), ("agent without JSON", post("/rpc/agent", b"[")[1]["error"]["code"]), ("agent by GET", s.handle("GET", "/rpc/agent")[0]),
        ("any by OPTIONS", s.handle("OPTIONS", "/mcp")[0]), ("unknown path", s.handle("GET", "/zzz")[0]), ("messages", [m["role"] for m in sent]), ("own prompt first", sent[0]["content"]), ("context", "## Relevant Knowledge" in sent[1]["content"] and "- Pumps move water" in sent[1]["content"]),
    ]
    engine.api_key = "k"
    rows += [("without key", post("/mcp", {})[0]), ("with key", s.handle("POST", "/mcp", b"x", "Bearer k")[0]), ("health without key", s.handle("GET", "/health")[0])]
    return told(spark, rows)


SERVICE_REPLIES = [
    ("health", "['ok', 'My Agent', 3, 2, 64, False]"), ("chat", "{'role': 'assistant', 'content': 'echo: hi there'}"), ("chat id", "True"), ("chat object", "chat.completion"), ("chat without JSON", "400"), ("chat by GET", "405"), ("stream", "['echo:', 'hi']"), ("stream end", "data: [DONE]"),
    ("mcp initialize", "{'protocolVersion': '2024-11-05', 'capabilities': {'tools': {}}, 'serverInfo': {'name': 'My Agent', 'version': '" + __version__ + "'}}"), ("mcp list", "['search_my_agent_knowledge']"), ("mcp call", "1"), ("mcp call without query", "-32602"), ("mcp unknown", "-32601"), ("mcp without JSON", "-32700"),
    ("mcp by PUT", "405"), ("mcp stream", "['event: endpoint\\ndata: /mcp\\n\\n', ': ping\\n\\n', ': ping\\n\\n']"), ("agent info", "['My Agent', '2', {'vectors': 3, 'triples': 2}]"), ("agent query", "echo: water"), ("agent query with history", "echo: b"), ("agent query without query", "-32602"), ("agent search", "[1, 2, 'ada water']"),
    ("agent unknown", "-32601"), ("agent without JSON", "-32700"), ("agent by GET", "405"), ("any by OPTIONS", "204"), ("unknown path", "404"), ("messages", "['system', 'system', 'user']"), ("own prompt first", "Be brief."), ("context", "True"), ("without key", "401"), ("with key", "200"), ("health without key", "200"),
]


# --- configuration and command line ---------------------------------------------------------------------------

YAML = """\
# settings
llm: &model
  base_url: http://a   # where
  api_key: "k: 1"
  model: m
embedder: {base_url: http://e, dimensions: 5}
lists: [1, two, "3"]
prompt: |
  First line.

  # not a comment
    indented
folded: >-
  one
  two
port: 9
"""


def config_cases(spark, d):
    """Configuration files: what is read, what overrides it, what is missing, and the options of chunks and commands."""
    import tempfile
    from pathlib import Path

    y = cfg.read_yaml(YAML)
    with tempfile.TemporaryDirectory() as t:  # configuration is the driver's own, not data
        p = Path(t, "c.yaml")
        p.write_text(YAML)
        c = cfg.load(str(p), {"LLM_MODEL": "other", "EMBED_API_KEY": "z"})
        k = Path(t, "new", "k.yaml")
        made = [cfg.ensure_skeleton(str(k)), cfg.ensure_skeleton(str(k)), oct(k.stat().st_mode)[-3:]]
        new = [cli.main(["init", str(Path(t, "proj"))]), sorted(x.name for x in Path(t, "proj").iterdir() if x.suffix == ".yaml"), cli.main(["init", str(Path(t, "proj"))])]
    own_file = {"runtime": {"embedder": {"dimensions": 7, "max_tokens": "x", "parallel": True}}}
    parsed = cli.parser().parse_args(["serve", "-d", "x", "-p", "9"])
    rows = [
        ("prompt", y["prompt"]), ("folded", y["folded"]), ("lists", y["lists"]), ("flow mapping", y["embedder"]), ("quoted", y["llm"]["api_key"]), ("comment", y["llm"]["base_url"]), ("written and read", cfg.read_yaml(cfg.write_yaml(y)) == y),
        ("override", [c.llm.model, c.embedder.api_key, c.embedder.dimensions, c.port]), ("no file", cfg.load("/nowhere", {}).port), ("valid", cfg.problems(c)), ("missing", len(cfg.problems(cfg.Config()))), ("refused", failing(lambda: cfg.validate(cfg.Config()))),
        ("own settings", cfg.embedder_settings(own_file)), ("dimensions: own", cfg.dimensions(own_file, c)), ("dimensions: file", cfg.dimensions({}, c)), ("dimensions: default", cfg.dimensions({}, cfg.Config())), ("skeleton", made),
        ("chunk size 0", failing(lambda: chunk.ChunkOptions(0).checked())), ("serve", [parsed.dir, parsed.port, parsed.agent]), ("init", new), ("version", cli.main(["version"])),
    ]
    return told(spark, rows)


CONFIG_CASES = [
    ("prompt", "First line.\n\n# not a comment\n  indented\n"), ("folded", "one two"), ("lists", "[1, 'two', '3']"), ("flow mapping", "{'base_url': 'http://e', 'dimensions': 5}"), ("quoted", "k: 1"), ("comment", "http://a"), ("written and read", "True"), ("override", "['other', 'z', 5, 9]"), ("no file", "8000"),
    ("valid", "[]"), ("missing", "5"), ("refused", "ConfigError"), ("own settings", "(7, 0, True)"), ("dimensions: own", "7"), ("dimensions: file", "5"), ("dimensions: default", "1024"), ("skeleton", "[True, False, '600']"), ("chunk size 0", "InvalidChunkSize"), ("serve", "['x', 9, 'agent.yaml']"), ("init", "[0, ['agent.yaml'], 1]"),
    ("version", "0"),
]

FILE_READS = [
    ("folder: a.md", "# Title\r\n\nText."), ("folder: B.TXT", "plain"), ("folder: c.Markdown", "é"), ("folder: bad.txt", "a�"), ("folder: p.pdf", "Pumps move water"), ("file: p.pdf", "Pumps move water"), ("file: x.docx", "UnsupportedFormat"), ("file: broken.pdf", "PythonException"),
]


def queries() -> dict:
    return {"file_reads": file_reads, "store_steps": store_steps, "build_counts": build_counts, "model_calls": model_calls, "extract_retries": extract_retries, "embed_sequential": embed_sequential, "service_replies": service_replies, "config_cases": config_cases}


def oracle_sql(chunks: str, clean: str, embedded: str) -> dict[str, str]:
    """chunks: SQL that gives the chunks of all files; clean: the stored facts; embedded: (doc_id, dim, weight) of documents."""
    e = lambda where: f"(SELECT count(*) FROM embeddings WHERE {where})"
    steps = [("vectors: none yet", "0"), ("vectors: first batch", e("label < 6")), ("vectors: second batch", e("label < 6 OR vec_id % 3 = 0")), ("vectors: replaced", e("vec_id % 3 = 0")), ("vectors: opened again", e("label < 6 OR vec_id % 3 = 0")), ("vectors: overwritten", e("label < 2"))]
    steps += [(c, f"(SELECT count(*) FROM {clean})") for c in ("facts: first batch", "facts: same batch")] + [("facts: in memory, none", "0")]
    n = f"(SELECT CAST(count(*) AS VARCHAR) FROM ({chunks}))"
    return {
        "file_reads": expected(FILE_READS), "model_calls": expected(MODEL_CALLS), "service_replies": expected(SERVICE_REPLIES), "config_cases": expected(CONFIG_CASES),
        "store_steps": " UNION ALL ".join(f"SELECT '{c}' AS \"case\", CAST({x} AS BIGINT) AS n" for c, x in steps),
        "build_counts": f"SELECT 'chunks' AS \"case\", {n} AS result UNION ALL SELECT 'vectors', {n} UNION ALL SELECT 'failed batches', '0' UNION ALL SELECT 'without documents', 'ValueError'",
        "extract_retries": """SELECT * FROM (VALUES ('plain', 1, '', 1), ('fails 2', 1, '', 3), ('fails 9', 0, 'no answer', 3), ('fenced', 1, '', 1), ('prose', 1, '', 1), ('none', 0, '', 1), ('cut', 0, 'malformed reply', 3), ('capitals', 1, '', 1), ('number', 0, 'malformed reply', 3), ('blank', 0, '', 1)) AS t("case", n, error, attempts)""",
        "embed_sequential": f"SELECT doc_id, dim FROM ({embedded})",
    }

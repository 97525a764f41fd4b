import json
import threading
import zlib
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from lorewright.functions import text as tx
from lorewright.plans import cli
from lorewright.plans import config as cfg
from lorewright.plans.engine import Engine, Models, compile_folder
from lorewright.plans.service import Service, authorised
from lorewright.sources import files, models
from lorewright.sources.project import create_project
from lorewright.sources.stores import GraphStore, VectorStore
from lorewright.streaming.ingest import ingest


def test_yaml_round_trip():
    data = {"agent": {"name": "a b", "note": 'x: "y"\nz', "empty": None, "on": True}, "list": [{"name": "t", "n": 1, "sub": {"k": [1, 2]}}, "plain", "- dash"], "port": 8000, "f": 1.5, "none": []}
    assert cfg.read_yaml(cfg.write_yaml(data)) == data
    assert cfg.read_yaml("a:\n- b: 1\n  c: 'it''s'\n- d\ne: |\n  x\n  y\n# note\nf: 2 # two\n") == {"a": [{"b": 1, "c": "it's"}, "d"], "e": "x\ny\n", "f": 2}
    assert cfg.read_yaml("") == {}


def test_yaml_as_people_write_it():
    text = """\
---
base: &base
  a: 1
  b: [1, 'two', {c: 3, d: "x: y"}]   # flow
derived:
  <<: *base
  b: ~
same: *base
prompt: |-
  One.

  # still text
    deeper
  Two: three
folded: >
  one
  two

  three
kept: |+
  x

tabs: "a\\tb \\u00e9"
list:
- - 1
  - 2
- name: n
  sub:
    - k
-
  z: 1
url: http://a/#b
time: 10:30
long: one
  two
"quoted key": yes it is
empty:
multi: [
  1,
  2
]
"""
    y = cfg.read_yaml(text)
    assert y["base"] == y["same"] == {"a": 1, "b": [1, "two", {"c": 3, "d": "x: y"}]} and y["derived"] == {"a": 1, "b": None}
    assert y["prompt"] == "One.\n\n# still text\n  deeper\nTwo: three" and y["folded"] == "one two\nthree\n" and y["kept"] == "x\n\n" and y["tabs"] == "a\tb é"
    assert y["list"] == [[1, 2], {"name": "n", "sub": ["k"]}, {"z": 1}]
    assert (y["url"], y["time"], y["long"], y["quoted key"], y["empty"], y["multi"]) == ("http://a/#b", "10:30", "one two", "yes it is", None, [1, 2])
    assert cfg.read_yaml(cfg.write_yaml(y)) == y
    for bad in ("a: [1, 2", "a: 'x"):
        with pytest.raises(cfg.ConfigError):
            cfg.read_yaml(bad)


def test_config(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("llm:\n  base_url: http://a\n  api_key: k\n  model: m\nembedder:\n  base_url: http://e\n  dimensions: 5\nport: 9\n")
    c = cfg.load(str(p), {"LLM_MODEL": "other", "EMBED_API_KEY": "z"})
    assert (c.llm.model, c.embedder.api_key, c.embedder.dimensions, c.port) == ("other", "z", 5, 9)
    assert cfg.validate(c) is c
    assert cfg.load("/nowhere", {}).port == 8000
    with pytest.raises(cfg.ConfigError):
        cfg.validate(cfg.Config())
    assert cfg.dimensions({"runtime": {"embedder": {"dimensions": 7}}}, c) == 7 and cfg.dimensions({}, c) == 5 and cfg.dimensions({}, cfg.Config()) == 1024
    assert cfg.embedder_settings({"runtime": {"embedder": {"dimensions": "x", "parallel": True}}}) == (0, 0, True)
    k = tmp_path / "d" / "k.yaml"
    assert cfg.ensure_skeleton(str(k)) and not cfg.ensure_skeleton(str(k)) and oct(k.stat().st_mode)[-3:] == "600"


def pdf(text: str) -> bytes:
    body = zlib.compress(f"BT ({text}) Tj ET".encode())
    return b"%%PDF-1.4\n1 0 obj\n<< /Length %d >>\nstream\n" % len(body) + body + b"\nendstream\nendobj\n"


def real_pdf() -> bytes:
    """Two pages out of order in the file, with subset fonts, a table to Unicode, differences, hex strings, kerning."""
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0003> <0020> <0010> <00E9> endbfchar 2 beginbfrange <0024> <003D> <0041> <0040> <0042> [<0066> <00660069>] endbfrange"
    page1 = b"BT /F1 12 Tf 72 700 Td <0024002500030010> Tj 0 -14 Td <00400041> Tj ET"
    page2 = b"BT /F2 10 Tf 1 0 0 1 72 700 Tm [(W\\(o\\)) -250 (r\\344d) 20 (s)] TJ T* (\x01\x02\x03) ' ET q /X1 Do Q"
    form = b"BT /F3 9 Tf (stamped) Tj ET"
    deflate = lambda b: zlib.compress(b)
    packed = b"8 0 9 65 " + b"<</Type/Font/Subtype/Type0/Encoding/Identity-H/ToUnicode 10 0 R>>".ljust(65) + b"<</Type/Font/Subtype/Type1/Encoding<</BaseEncoding/WinAnsiEncoding/Differences[1/fi/eacute/uni20AC]>>>>"
    parts = [
        b"1 0 obj\n<</Type/Catalog/Pages 2 0 R>>\nendobj", b"4 0 obj\n<</Type/Page/Parent 2 0 R/Contents 6 0 R>>\nendobj", b"3 0 obj\n<</Type/Page/Parent 2 0 R/Contents[5 0 R]>>\nendobj",
        b"2 0 obj\n<</Type/Pages/Count 2/Kids[3 0 R 4 0 R]/Resources<</Font<</F1 8 0 R/F2 9 0 R>>/XObject<</X1 11 0 R>>>>>>\nendobj",
    ]
    stream = lambda n, b, more=b"": b"%d 0 obj\n<<%s/Filter/FlateDecode/Length %d>>\nstream\n" % (n, more, len(b)) + b + b"\nendstream\nendobj"
    parts += [stream(5, deflate(page1)), stream(6, deflate(page2)), stream(7, deflate(packed), b"/Type/ObjStm/N 2/First 9"), stream(10, deflate(cmap)), stream(11, deflate(form), b"/Type/XObject/Subtype/Form")]
    return b"%PDF-1.5\n" + b"\n".join(parts) + b"\ntrailer<</Root 1 0 R>>\n%%EOF"


def test_pdf_of_the_usual_making():
    assert files.pdf_text(real_pdf()) == "AB é\nffi\nW(o) räds\nfié€\nstamped"
    with pytest.raises(ValueError):
        files.pdf_text(b"%PDF-1.4 nothing")


@pytest.fixture()
def project(tmp_path):
    root = tmp_path / "proj"
    create_project(str(root), "My Agent")
    d = root / "data"
    (d / "b.md").write_text("Engines are machines.\n\nMill -- is part of -- engine\n\nAda -- wrote -- notes")
    (d / "A.TXT").write_text("Ada Lovelace wrote about engines.")
    (d / "c.pdf").write_bytes(pdf("Pumps move water"))
    (d / "bad.pdf").write_bytes(b"%PDF nothing")
    (d / "skip.docx").write_text("no")
    (d / "sub").mkdir()
    (d / "sub" / "deep.md").write_text("deep")
    return root


def test_files(spark, project):
    got = {r["name"]: r["content"] for r in files.load_directory(spark, f"{project}/data").collect()}
    assert set(got) == {"A.TXT", "b.md", "c.pdf"} and got["c.pdf"] == "Pumps move water"
    assert files.load_file(spark, f"{project}/data/b.md").first()["content"].startswith("Engines")
    with pytest.raises(files.UnsupportedFormat):
        files.load_file(spark, f"{project}/data/skip.docx")
    with pytest.raises(FileExistsError):
        create_project(str(project), "again")


def test_compile_and_serve(spark, project):
    told = compile_folder(spark, str(project), offline=True)
    assert told["chunks"] == 3 and told["triples"] == 2 and told["failed_batches"] == 0
    agent = cfg.read_yaml((project / "agent.yaml").read_text())
    assert [t["name"] for t in agent["mcp"]["tools"]] == ["search_my_agent_knowledge"]
    assert compile_folder(spark, str(project), offline=True)["chunks"] == 3  # again: upsert
    engine = Engine.open(spark, str(project), offline=True)
    engine.models = Models.offline(1024)
    assert engine.vectors.count() == 3 and engine.facts.count() == 2
    s = Service(engine)
    call = lambda **x: s.handle("POST", "/rpc/agent", json.dumps({"jsonrpc": "2.0", "id": 1} | x).encode())[1]
    found = call(method="agent.search", params={"query": "ada lovelace engines", "top_k": 2})["result"]
    assert found["vector_results"][0]["source"] == "A.TXT" and len(found["vector_results"]) == 2 and found["graph_results"][0]["subject"] == "Ada"
    assert call(method="agent.query", params={"query": "engines"})["result"]["answer"] == "echo: engines"
    assert call(method="agent.info")["result"]["stats"] == {"vectors": 3, "triples": 2}
    assert call(method="nope")["error"]["code"] == -32601 and call(method="agent.query", params={})["error"]["code"] == -32602
    assert s.handle("POST", "/rpc/agent", b"{")[1]["error"]["code"] == -32700 and s.handle("GET", "/rpc/agent")[0] == 405
    mcp = lambda **x: s.handle("POST", "/mcp", json.dumps({"jsonrpc": "2.0", "id": 2} | x).encode())[1]
    assert mcp(method="initialize")["result"]["protocolVersion"] == "2024-11-05"
    assert mcp(method="tools/list")["result"]["tools"][0]["inputSchema"]["required"] == ["query"]
    text = mcp(method="tools/call", params={"name": "x", "arguments": {"query": "mill engine", "top_k": 1}})["result"]["content"][0]["text"]
    assert text.count("**[") == 1 and "- Mill is part of engine" in text
    assert mcp(method="tools/call", params={"arguments": {}})["error"]["code"] == -32602
    status, reply = s.handle("POST", "/v1/chat/completions", json.dumps({"messages": [{"role": "user", "content": "hi there"}]}).encode())
    assert status == 200 and reply["choices"][0]["message"]["content"] == "echo: hi there"
    events = list(s.handle("POST", "/v1/chat/completions", json.dumps({"stream": True, "messages": [{"role": "user", "content": "hi"}]}).encode())[1])
    assert events[-1] == "data: [DONE]\n\n" and len(events) == 3
    assert s.handle("POST", "/v1/chat/completions", b"x")[0] == 400 and s.handle("GET", "/v1/chat/completions")[0] == 405 and s.handle("OPTIONS", "/mcp")[0] == 204 and s.handle("GET", "/zzz")[0] == 404
    assert s.handle("GET", "/health")[1]["vectors"] == 3
    engine.api_key = "k"
    assert s.handle("POST", "/mcp", b"{}")[0] == 401 and s.handle("GET", "/health")[0] == 200
    sent = engine.messages([{"role": "system", "content": "drop"}, {"role": "user", "content": "engines"}])
    assert [m["role"] for m in sent] == ["system", "system", "user"] and "## Relevant Knowledge" in sent[1]["content"]


def test_stores(spark, tmp_path):
    v = VectorStore(spark, f"{tmp_path}/v")
    assert v.count() == 0
    row = lambda i, c: (i, c, {"source": "s"}, [1.0, 0.0])
    v.add(spark.createDataFrame([row("a", "1"), row("b", "1")], v.schema))
    v.add(spark.createDataFrame([row("b", "2"), row("c", "1")], v.schema))
    assert {r["id"]: r["content"] for r in v.table().collect()} == {"a": "1", "b": "2", "c": "1"}
    assert VectorStore(spark, f"{tmp_path}/v").count() == 3
    g = GraphStore(spark, f"{tmp_path}/g")
    g.add(spark.createDataFrame([(0, "a", "b", "c"), (1, " a", "b", "c"), (2, "", "b", "c")], g.schema))
    g.add(spark.createDataFrame([(0, "a", "b", "c"), (1, "x", "y", "z")], g.schema))
    assert [tuple(r) for r in g.table().orderBy("triple_seq").collect()] == [(0, "a", "b", "c"), (2, "x", "y", "z")]
    m = GraphStore(spark)
    m.add(spark.createDataFrame([(0, "a", "b", "c")], g.schema))
    assert m.count() == 1
    m.close()


def test_authorised(spark):
    cases = [("", "/x", "POST", None), ("k", "/health", "GET", None), ("k", "/x", "OPTIONS", None), ("k", "/x", "POST", "Bearer k"), ("k", "/x", "POST", "Bearer j"), ("k", "/x", "POST", None)]
    assert [authorised(*c) for c in cases] == [True, True, True, True, False, False]
    df = spark.createDataFrame(cases, "k string, p string, m string, h string").select(tx.is_authorised("k", "p", "m", "h").alias("a"))
    assert [r["a"] for r in df.collect()] == [True, True, True, True, False, False]


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).first()["c"]
    assert one(tx.trim(F.lit("\u3000\u00a0 a b \n"))) == "a b"
    assert one(tx.short_count(F.lit(999))) == "999" and one(tx.short_count(F.lit(1500))) == "1500 (1.5K)" and one(tx.short_count(F.lit(2_000_000))) == "2000000 (2.0M)"
    assert one(tx.short_duration(F.lit(0.0000021))) == "2µs" and one(tx.short_duration(F.lit(0.25))) == "250ms" and one(tx.short_duration(F.lit(2.25))).endswith("s")
    assert one(tx.pad_right(F.lit("é"), 4)) == "é  " and one(tx.pad_right(F.lit("abcdef"), 4)) == "abcdef"
    assert one(tx.shown_url(F.lit(""))) == "(not set)" and one(tx.shown_url(F.lit("http://h/"))) == "http://h"
    assert one(tx.agent_slug(F.lit("My Agent"))) == "my_agent" and one(tx.agent_slug(F.lit(""))) == "agent"
    assert one(tx.is_rate_limited(F.lit("HTTP 429"))) and not one(tx.is_rate_limited(F.lit("Rate Limit")))


class Fake(BaseHTTPRequestHandler):
    seen: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Fake.seen.append((self.path, body, self.headers.get("Authorization")))
        status, reply = 200, {}
        if self.path == "/embeddings":
            if len([s for s in Fake.seen if s[0] == "/embeddings"]) == 1:
                status, reply = 429, {"error": "Too Many Requests"}
            else:
                reply = {"data": [{"index": i, "embedding": [float(len(t)), 1.0, 2.0]} for i, t in reversed(list(enumerate(body["input"])))]}
        elif self.path == "/chat/completions":
            reply = {"choices": [{"message": {"content": "" if body["messages"][-1]["content"] == "nothing" else "fine"}}]}
        elif self.path == "/rerank":
            reply = {"results": [{"index": 1, "relevance_score": 0.9}, {"index": 0, "relevance_score": 0.1}]}
        data = json.dumps(reply).encode()
        if self.path == "/chat/completions" and body.get("stream"):
            data = b'data: {"choices":[{"delta":{"content":"a"}}]}\n\ndata: {"choices":[{"delta":{}}]}\n\ndata: [DONE]\n\n'
        self.send_response(status)
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *a):
        pass


def test_http_models():
    server = HTTPServer(("127.0.0.1", 0), Fake)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    waits: list = []
    e = models.HttpEmbedder(url, "key", "", 2)
    assert models.retried(lambda: e.embed(["a", "bbb"]), sleep=waits.append) == [[1.0, 1.0], [3.0, 1.0]]
    assert waits == [1.0] and Fake.seen[0][2] == "Bearer key" and "model" not in Fake.seen[0][1]
    chat = models.HttpChat(url, "", "m")
    assert chat.complete("hello", "sys") == "fine" and [m["role"] for m in Fake.seen[-1][1]["messages"]] == ["system", "user"]
    with pytest.raises(models.EmptyResponse):
        chat.complete("nothing")
    assert list(chat.stream({"messages": [{"role": "user", "content": "x"}], "temperature": 0.1})) == ["a"] and Fake.seen[-1][1]["temperature"] == 0.1
    assert models.HttpReranker(url + "/rerank", "", "m").scores("q", ["a", "b"]) == [(1, 0.9), (0, 0.1)]
    with pytest.raises(RuntimeError):
        models.retried(lambda: (_ for _ in ()).throw(RuntimeError("other")), sleep=waits.append)
    server.shutdown()


def test_embed_column(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(45)], "id int, t string")
    for parallel in (True, False):
        assert models.embed_column(df, "t", models.HashEmbedder(8), parallel=parallel).filter("size(embedding) = 8").count() == 45
    with pytest.raises(Exception, match="empty text"):
        models.embed_column(spark.createDataFrame([(1, "  ")], "id int, t string"), "t", models.HashEmbedder(8)).collect()


def test_empty_texts_may_stay_without_embedding(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "  "), (3, None), (4, "c")], "id int, t string")
    got = {r["id"]: r["embedding"] for r in models.embed_column(df, "t", models.HashEmbedder(8), on_empty="null").collect()}
    assert got[2] is None and got[3] is None and len(got[1]) == len(got[4]) == 8


def test_scratch_needs_a_shared_folder_on_clusters(spark, monkeypatch):
    from types import SimpleNamespace

    from lorewright.functions import scratch

    named = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: "hdfs://x/y/"), sparkContext=SimpleNamespace(master="spark://a", applicationId="app-1"))
    assert scratch.own(named) == "hdfs://x/y/lorewright-scratch/app-1"
    with pytest.raises(RuntimeError):
        scratch.root(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d), sparkContext=SimpleNamespace(master="spark://a")))


def test_ties_go_to_the_smallest_keys(spark):
    from lorewright.operators import vector

    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(400, 0, -1)] + [(500, [0.0, 1.0])], "id bigint, embedding array<double>").coalesce(1)
    q = spark.createDataFrame([(1, [2.0, 0.0])], "query_id bigint, embedding array<double>")
    assert [r["id"] for r in vector.top_k_batch(df, q, 5).orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def test_late_events_are_left_out(spark, tmp_path):
    """Windows close once the watermark passes them; what comes later for a closed window is dropped."""
    import os

    from lorewright.streaming.ingest import late_counts

    parts = [["12:01", "12:07"], ["12:09", "13:00"], ["13:05"], ["12:03", "14:00"], ["14:01"], ["14:02"]]
    for i, times in enumerate(parts):
        spark.createDataFrame([(f"2024-01-01 {t}:00", "click") for t in times], "ts string, event_type string").select(F.to_timestamp("ts").alias("ts"), "event_type").coalesce(1).write.parquet(f"{tmp_path}/made/{i}")
        (tmp_path / "in").mkdir(exist_ok=True)
        made = next((tmp_path / "made" / str(i)).glob("part-*"))
        made.rename(tmp_path / "in" / f"{i}.parquet")
        os.utime(tmp_path / "in" / f"{i}.parquet", (1_000_000 + i, 1_000_000 + i))
    stream = spark.readStream.schema("ts timestamp, event_type string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    counts = late_counts(stream, "ts", "10 minutes", "30 minutes")
    counts.writeStream.format("memory").queryName("late_counts").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = {(str(r["begin_at"])[11:16], r["n"]) for r in spark.table("late_counts").collect()}
    # 12:09 came in time, 12:03 after its window was closed by 13:00 less half an hour
    assert got == {("12:00", 3), ("13:00", 2)}


def test_streaming_ingest(spark, tmp_path):
    d, store = tmp_path / "in", VectorStore(spark, f"{tmp_path}/v")
    d.mkdir()
    (d / "a.md").write_text("First text.")
    (d / "x.bin").write_text("no")
    run = lambda: ingest(spark, str(d), store, models.HashEmbedder(8), f"{tmp_path}/cp").awaitTermination()
    run()
    assert [r["id"] for r in store.table().collect()] == ["a_md_0"]
    (d / "b.md").write_text("Second text.")
    run()
    assert sorted(r["id"] for r in store.table().collect()) == ["a_md_0", "b_md_0"]


def test_display(capsys):
    from lorewright.plans import display

    display.say("step", "one")
    display.say("error", "two")
    display.pairs({"a": 1, "long": 2})
    display.banner("My Agent", {"port": 8000})
    told = capsys.readouterr()
    assert told.out.splitlines() == ["→ one", "  a     1", "  long  2", "┌────────────┐", "│ My Agent   │", "│            │", "│ port  8000 │", "└────────────┘"] and told.err == "✗ two\n"
    assert display.coloured("x", 31, True) == "\x1b[31mx\x1b[0m" and display.coloured("x", 31, False) == "x"


def test_command_line(tmp_path, capsys):
    assert cli.main(["version"]) == 0
    assert cli.main(["init", str(tmp_path / "new")]) == 0 and (tmp_path / "new" / "agent.yaml").exists()
    assert cli.main(["init", str(tmp_path / "new")]) == 1
    assert cli.parser().parse_args(["serve", "-d", "x", "-p", "9"]).port == 9

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewright.operators import graph, hybrid, rerank, triples, vector


def test_vector_top_k(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 8))
    df = spark.createDataFrame([(f"d{i:02}", [float(v) for v in r]) for i, r in enumerate(x)], "id string, embedding array<float>")
    got = vector.top_k(df, x[3].tolist(), 5).collect()
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.argsort(-(n @ n[3]))[:5]
    assert [r["id"] for r in got] == [f"d{i:02}" for i in want]
    assert len(vector.top_k(df, x[3].tolist(), 0).collect()) == 5
    assert len(vector.top_k(df, x[3].tolist(), 99).collect()) == 50
    with pytest.raises(ValueError):
        vector.top_k(df, x[3].tolist(), 99, strict_k=True)
    q = df.filter("id < 'd10'").select(F.col("id").alias("query_id"), "embedding")
    batch = vector.top_k_batch(df, q, 5)
    assert [r["id"] for r in batch.filter("query_id = 'd03'").orderBy("rank").collect()] == [r["id"] for r in got]
    assert vector.top_k_batch(df, q.limit(0), 5).count() == 0


def test_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector, "QUERY_BLOCK", 3)
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "id bigint, embedding array<float>")
    q = df.select(F.col("id").alias("query_id"), "embedding")
    assert vector.top_k_batch(df, q, 2).groupBy("query_id").count().filter("count = 2").count() == 10


def test_usable_and_truncated(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0]), (6, None), (7, [1.0, None]), (8, [])]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    assert [r["id"] for r in df.filter(vector.usable("v", 2)).collect()] == [1]
    assert [r["t"] for r in df.filter("id in (1, 5)").orderBy("id").select(vector.truncated("v", 1).alias("t")).collect()] == [[1.0], [1.0]]


def test_hash_embedding(spark):
    df = spark.createDataFrame([(1, "A b a\u00a0B c"), (2, " "), (3, "x" + chr(0))], "id int, text string")
    native = {r["id"]: r["e"] for r in df.select("id", vector.hash_embedding("text", 16).alias("e")).collect()}
    arrow = {r["id"]: r["embedding"] for r in vector.hash_vectors(df, "text", 16).collect()}
    for i in native:
        assert np.allclose(native[i], arrow[i])
    assert not any(native[2]) and abs(sum(v * v for v in native[1]) - 1) < 1e-9


TRIPLES = [(0, "Ada Lovelace", "wrote", "notes"), (1, "Notes", "describe", "an engine"), (2, "Engine", "has", "mill"), (3, "mill", "is part of", "the engine"), (4, "Ada", "knew", "Babbage"), (5, "engine engine", "is", "engine")]


def facts(spark):
    return spark.createDataFrame(TRIPLES, "triple_seq bigint, subject string, predicate string, object string")


def model(query, k, compat):
    terms = [w for w in query.lower().split() if len(w.encode()) >= 3]
    hits = [(sum(float(t in f"{s} {p} {o}".lower()) for t in terms), n) for n, s, p, o in TRIPLES]
    hits = [h for h in hits if h[0] > 0]
    return [n for _, n in sorted(hits[: 3 * k] if compat else hits, key=lambda h: (-h[0], h[1]))][:k]


@pytest.mark.parametrize("query", ["engine", "the ENGINE engine", "ada notes", "is", "zzz", "mill has engine"])
@pytest.mark.parametrize("mode", ["exact", "compat"])
def test_graph_search(spark, query, mode):
    k = 1 if mode == "compat" else 4
    assert [r["triple_seq"] for r in graph.search(facts(spark), query, k, mode).collect()] == model(query, k, mode == "compat")
    q = spark.createDataFrame([(7, query, k)], "query_id bigint, query string, top_k int")
    assert [r["triple_seq"] for r in graph.search_batch(facts(spark), q, mode).orderBy("rank").collect()] == model(query, k, mode == "compat")


def test_graph_edges(spark):
    with pytest.raises(ValueError):
        graph.search(facts(spark), "  ")
    q = spark.createDataFrame([(1, None, 0), (2, "ab", 5), (3, "engine", -1)], "query_id bigint, query string, top_k int")
    assert {r["query_id"] for r in graph.search_batch(facts(spark), q).collect()} == {3}
    assert graph.search_batch(facts(spark).limit(0), q).count() == 0
    assert graph.format_facts(facts(spark).limit(0), "triple_seq").first()["facts"] == ""
    assert graph.format_facts(facts(spark).filter("triple_seq = 4"), "triple_seq").first()["facts"] == "Knowledge Graph Facts:\n- Ada knew Babbage"
    start = spark.createDataFrame([("Ada",)], "name string")
    assert {r["triple_seq"] for r in graph.expand(facts(spark), start, 1).collect()} == {4}
    v = spark.createDataFrame([('"a "b""',), (None,)], "v string").select(graph.stored_value("v").alias("v")).collect()
    assert [r["v"] for r in v] == ['a "b"', ""]


REPLIES = [
    ('[{"subject":"a","predicate":"b","object":"c"}]', 1), ('```json\n[{"subject":"a","predicate":"b","object":"c"}]\n```', 1), ('Sure: [{"subject":"a","predicate":"b","object":"c"}] done', 1), ("nothing", 0), ("[]", 0), ("", 0),
    ('[{"subject":"a"', 0), ("[oops]", None), ('[{"subject":"","predicate":"b","object":"c"},{"subject":"x","predicate":"y","object":"z"}]', 1), ('[{"subject":"a","predicate":"b"}]', 0),
]


def test_reply_parsers(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(REPLIES)], "i int, raw string")
    for impl in ("native", "strict"):
        got = {r["i"]: None if r["malformed"] else len(r["triples"]) for r in triples.parse_replies(df, "raw", impl).collect()}
        assert got == {i: n for i, (_, n) in enumerate(REPLIES)}, impl
    # what the strict parser sees differently
    assert triples.parse_strictly('[{"subject":5,"predicate":"b","object":"c"}]') is None
    assert triples.parse_strictly('[{"Subject":"a","PREDICATE":"b","object":"c"}]') == [{"subject": "a", "predicate": "b", "object": "c"}]
    assert triples.parse_strictly('[{"subject":"a","predicate":"b","object":"c"}] and [1]') is None


def test_clean_triples(spark):
    rows = [(3, " a ", "b", "c"), (1, "a", "b", "c"), (2, "", "b", "c"), (4, None, "b", "c"), (5, " ", "b", "c")]
    got = triples.cleaned(spark.createDataFrame(rows, "triple_seq bigint, subject string, predicate string, object string")).orderBy("triple_seq").collect()
    assert [tuple(r) for r in got] == [(1, "a", "b", "c"), (5, "", "b", "c")]


def test_extract_retries(spark):
    class Flaky:
        def start(self):
            self.calls = 0
            return self

        def triples(self, text):
            self.calls += 1
            if "bad" in text:
                raise RuntimeError("down")
            if self.calls % 2:
                raise RuntimeError("once")
            return '[{"subject":"s","predicate":"p","object":"o"}]'

    df = spark.createDataFrame([(0, "good"), (1, "bad")], "batch_id bigint, text string").coalesce(1)
    got = {r["batch_id"]: r for r in triples.extract(df, Flaky()).collect()}
    assert got[0]["attempts"] == 2 and len(got[0]["triples"]) == 1 and got[0]["error"] is None
    assert got[1]["attempts"] == 3 and got[1]["triples"] == [] and got[1]["error"] == "down"


def test_running_total(spark):
    df = spark.range(100).select("id", F.lit(2).alias("n"))
    assert [r["running_total"] for r in triples.running_total(df, "id", "n").orderBy("id").collect()] == [2 * i + 2 for i in range(100)]


def test_rerank(spark):
    class Reverse:
        def start(self):
            return self

        def scores(self, query, documents):
            return [(i, float(i)) for i in range(len(documents))] + [(99, 5.0)]

    docs = spark.createDataFrame([(1, "q", i, f"d{i}") for i in range(3)], "query_id bigint, query string, index int, content string")
    assert [r["content"] for r in rerank.rerank(docs, Reverse()).orderBy("rank").collect()] == ["d2", "d1", "d0"]
    off = rerank.rerank(docs, None).orderBy("rank").collect()
    assert [r["content"] for r in off] == ["d0", "d1", "d2"] and {r["relevance_score"] for r in off} == {1.0}
    assert rerank.endpoint(None, "m") is None and rerank.endpoint("http://h", "") is None
    assert rerank.endpoint("http://h/", "m") == "http://h/rerank" and rerank.endpoint("http://h/v1/rerank", "m") == "http://h/v1/rerank" and rerank.endpoint("http://h", "m", "http://x") == "http://x"


def test_messages(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u1"), (1, 2, "assistant", "a"), (1, 3, "user", "u2"), (2, 0, "system", "only")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    assert {r["conv_id"]: r["query"] for r in hybrid.last_user_message(df).collect()} == {1: "u2", 2: ""}
    m = spark.createDataFrame([([("system", "x"), ("user", "hi")], "ctx")], "m array<struct<role:string,content:string>>, c string")
    out = m.select(hybrid.augmented("m", F.lit("me"), "c").alias("o")).first()["o"]
    assert [(x["role"], x["content"]) for x in out] == [("system", "me"), ("system", "ctx"), ("user", "hi")]
    assert len(m.select(hybrid.augmented("m", None, F.lit("")).alias("o")).first()["o"]) == 1


def test_context(spark):
    hits = spark.createDataFrame([(1, 1, "a.md", "text", 0.876), (1, 2, "b.md", "more", 0.5)], "query_id int, rank int, source string, content string, similarity double")
    got = hybrid.vector_section(hits, ["query_id"]).first()["vector_text"]
    assert got == "## Relevant Knowledge\n\n**[1] Source: a.md** (similarity: 0.88)\ntext\n\n**[2] Source: b.md** (similarity: 0.50)\nmore\n\n"
    assert "Source" not in hybrid.vector_section(hits, ["query_id"], True).first()["vector_text"]
    t = spark.createDataFrame([(None, "f")], "v string, f string").select(hybrid.context("v", "f").alias("c")).first()["c"]
    assert t == "\n## Knowledge Graph Context\n\nf"

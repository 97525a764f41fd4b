"""The engine: compile a folder of documents into two stores, then answer queries over them."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.functions.scratch import written
from lorewright.operators import chunk, graph, hybrid, rerank, triples, vector
from lorewright.plans import config as cfg
from lorewright.sources.files import load_directory
from lorewright.sources.models import EchoChat, HashEmbedder, HttpChat, HttpEmbedder, HttpReranker, embed_column
from lorewright.sources.stores import GraphStore, VectorStore

HYBRID_VECTOR_K, HYBRID_GRAPH_K = 5, 10


@dataclass
class Models:
    embedder: object
    chat: object
    reranker: object | None = None

    @staticmethod
    def offline(dimensions: int = 64) -> Models:
        return Models(HashEmbedder(dimensions), EchoChat())

    @staticmethod
    def of(c: cfg.Config, dims: int) -> Models:
        at = rerank.endpoint(c.reranker.base_url, c.reranker.model, os.environ.get("RERANK_ENDPOINT"))
        return Models(
            HttpEmbedder(c.embedder.base_url, c.embedder.api_key, c.embedder.model, dims),
            HttpChat(c.llm.base_url, c.llm.api_key, c.llm.model),
            HttpReranker(at, c.reranker.api_key, c.reranker.model) if at else None,
        )


def chunks_of(documents: DataFrame, options: chunk.ChunkOptions, impl: str = "native") -> DataFrame:
    """(chunk_seq, id, content, source, index): the documents in order of name, cut and numbered throughout."""
    named = documents.select(F.col("name").alias("source"), F.col("content").alias("text"))
    cut = chunk.split_by_sentence(named, "text", "source", options, impl=impl)
    return chunk.with_sequence(cut, ["source", "index"]).select("chunk_seq", "id", "content", "source", "index")


def compile_documents(spark: SparkSession, documents: DataFrame, vectors: VectorStore, facts: GraphStore, models: Models, options: chunk.ChunkOptions, parallel: bool = True, mode: str = "upsert") -> dict:
    """Chunk, embed and store; extract triples from runs of ten chunks and store those. A batch that fails is skipped
    and reported. Chunks are written once, since both branches read them."""
    if documents.isEmpty():
        raise ValueError("there are no documents")
    chunks = written(chunks_of(documents, options), "chunks")
    embedded = embed_column(chunks, "content", models.embedder, parallel=parallel)
    vectors.add(vector.vector_rows(embedded), mode)
    replies = written(triples.extract(chunk.batches_of(chunks), models.chat), "replies")
    flat = replies.select("batch_id", F.posexplode("triples").alias("pos", "t"))
    rows = chunk.with_sequence(flat, ["batch_id", "pos"], "triple_seq").select("triple_seq", "t.*")
    facts.add(rows, mode)
    failed = [r["error"] for r in replies.filter("error is not null").select("error").limit(20).collect()]
    counts = replies.agg(F.sum(F.size("triples")).alias("n"), F.sum(F.col("error").isNotNull().cast("int")).alias("bad")).first()
    sample = chunk.head_sample(chunks).first()["text"]
    return {"chunks": chunks.count(), "triples": counts["n"] or 0, "failed_batches": counts["bad"] or 0, "errors": failed, "sample": sample}


class Engine:
    """Opened stores and models with the agent's settings; every search runs as a Spark plan."""

    def __init__(self, spark: SparkSession, vectors: VectorStore, facts: GraphStore, models: Models, agent: dict | None = None, api_key: str = ""):
        self.spark, self.vectors, self.facts, self.models, self.agent, self.api_key = spark, vectors, facts, models, agent or {}, api_key

    @staticmethod
    def open(spark: SparkSession, folder: str, config: cfg.Config | None = None, agent_file: str = "agent.yaml", offline: bool = False) -> Engine:
        path = Path(folder) / agent_file
        agent = cfg.read_yaml(path.read_text()) if path.exists() else {}
        c = config or cfg.Config()
        dims = cfg.dimensions(agent, c)
        models = Models.offline(dims) if offline else Models.of(cfg.validate(c), dims)
        stores = VectorStore(spark, f"{folder}/data/vectors"), GraphStore(spark, f"{folder}/data/triples")
        return Engine(spark, *stores, models, agent, os.environ.get("AGENT_API_KEY", ""))

    @property
    def name(self) -> str:
        return ((self.agent.get("agent") or {}).get("name")) or "agent"

    @property
    def system_prompt(self) -> str:
        return ((self.agent.get("agent") or {}).get("system_prompt")) or ""

    def vector_hits(self, query: str, k: int = 0, metric: str = "cosine") -> DataFrame:
        if not query.strip():
            raise ValueError("the query is empty")
        q = self.models.embedder.start().embed([query])[0]
        hits = vector.top_k(self.vectors.table(), q, k, metric)
        return vector.with_source(hits).select("id", "content", "source", "similarity", "metadata")

    def graph_hits(self, query: str, k: int = 0, mode: str = "exact") -> DataFrame:
        return graph.search(self.facts.table(), query, k, mode)

    def context(self, query: str, k: int = HYBRID_VECTOR_K, graph_k: int = HYBRID_GRAPH_K) -> str:
        """The context text for a query. Graph search and reranking may fail without harm."""
        hits = self.vector_hits(query, k).collect()  # k rows
        reranked = False
        if self.models.reranker is not None and hits:
            try:
                order = sorted(self.models.reranker.start().scores(query, [h["content"] for h in hits]), key=lambda x: (-x[1], x[0]))
                hits, reranked = [hits[i] for i, _ in order if 0 <= i < len(hits)], True
            except Exception:
                reranked = False
        try:
            facts = self.graph_hits(query, graph_k).collect()  # graph_k rows
        except Exception:
            facts = []
        out = ""
        if hits:
            out = hybrid.VECTOR_TITLE + "\n\n"
            for n, h in enumerate(hits, 1):
                out += (f"**[{n}]**" if reranked else f"**[{n}] Source: {h['source']}** (similarity: {h['similarity']:.2f})") + f"\n{h['content']}\n\n"
        if facts:
            out += f"\n{hybrid.GRAPH_TITLE}\n\n{graph.FACTS_TITLE}\n" + "\n".join(f"- {f['subject']} {f['predicate']} {f['object']}" for f in facts)
        return out

    def search(self, query: str, k: int = 0) -> dict:
        """Both result lists without reranking; twice as many facts as texts."""
        k = k if k > 0 else HYBRID_VECTOR_K
        hits = [{"content": h["content"], "source": h["source"], "similarity": h["similarity"]} for h in self.vector_hits(query, k).collect()]
        try:
            facts = [f.asDict() for f in self.graph_hits(query, 2 * k).select("subject", "predicate", "object", "score").collect()]
        except Exception:
            facts = []
        return {"vector_results": hits, "graph_results": facts, "query": query}

    def messages(self, sent: list[dict]) -> list[dict]:
        """The messages for the model: own prompt, context for the last user message, then what was sent but for system messages."""
        query = next((m["content"] for m in reversed(sent) if m.get("role") == "user"), "")
        try:
            found = self.context(query)
        except Exception:
            found = ""
        own = [{"role": "system", "content": x} for x in (self.system_prompt, found) if x]
        return own + [m for m in sent if m.get("role") != "system"]

    def chat(self, sent: list[dict]) -> str:
        return self.models.chat.start().chat(self.messages(sent))

    def stream(self, request: dict):
        yield from self.models.chat.start().stream(request | {"messages": self.messages(request.get("messages", []))})

    def ask(self, query: str, system_prompt: str = "", history: list[dict] | None = None) -> dict:
        try:
            found = self.context(query)
        except Exception:
            found = ""
        own = [{"role": "system", "content": x} for x in (system_prompt or self.system_prompt, found) if x]
        answer = self.models.chat.start().chat([*own, *(history or []), {"role": "user", "content": query}])
        return {"answer": answer, "context": found, "agent": self.name}

    def stats(self) -> dict:
        return {
            "status": "ok", "agent": self.name, "vectors": self.vectors.count(), "triples": self.facts.count(), "dimensions": getattr(self.models.embedder, "dimensions", 0),
            "llm_model": getattr(self.models.chat, "model", ""), "embed_model": getattr(self.models.embedder, "model", ""), "reranker_enabled": self.models.reranker is not None,
        }


def compile_folder(spark: SparkSession, folder: str, config: cfg.Config | None = None, offline: bool = False, mode: str = "upsert") -> dict:
    """The whole build for a project folder: documents in data/, settings in agent.yaml, stores in data/."""
    path = Path(folder) / "agent.yaml"
    if not path.exists() or not (Path(folder) / "data").is_dir():
        raise FileNotFoundError("agent.yaml and data/ are needed")
    agent = cfg.read_yaml(path.read_text())
    c = config or cfg.Config()
    dims, limit, parallel = cfg.embedder_settings(agent)
    models = Models.offline(dims or 64) if offline else Models.of(cfg.validate(c), cfg.dimensions(agent, c))
    options = chunk.ChunkOptions.for_tokens(limit)
    told = compile_documents(spark, load_directory(spark, f"{folder}/data"), VectorStore(spark, f"{folder}/data/vectors"), GraphStore(spark, f"{folder}/data/triples"), models, options, parallel, mode)
    name = ((agent.get("agent") or {}).get("name")) or "agent"
    try:
        text = models.chat.start().describe(name, told["sample"])
    except Exception:
        text = f"Search the knowledge of {name}."
    slug = name.lower().replace(" ", "_")
    agent.setdefault("mcp", {})
    agent["mcp"] = (agent["mcp"] or {}) | {"tools": [{"name": f"search_{slug}_knowledge", "description": text}]}
    path.write_text(cfg.write_yaml(agent))
    return told

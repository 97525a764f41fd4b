"""Model clients: HTTP with retries, and deterministic stand-ins that need no network.

A client is a small picklable description; ``start()`` makes a working one inside a task, so a connection is made once
per partition. Tasks that call paid models should not run speculatively."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewright.functions.text import embeddable


class EmptyResponse(RuntimeError):
    pass


def rate_limited(error: str) -> bool:
    return any(s in error for s in ("429", "Too Many Requests", "rate limit"))


def retried(call, attempts: int = 5, wait: float = 1.0, sleep=time.sleep):
    """Call again after a rate limit, waiting 1, 2, 4, ... seconds; other errors are raised at once."""
    for n in range(attempts):
        try:
            return call()
        except Exception as e:
            if not rate_limited(str(e)) or n == attempts - 1:
                raise
            sleep(wait * 2**n)


@dataclass(frozen=True)
class Http:
    base_url: str
    api_key: str = ""
    model: str = ""
    dimensions: int = 0
    timeout: float = 120.0

    def start(self):
        return self

    def post(self, path: str, body: dict, stream: bool = False):
        request = urllib.request.Request(self.base_url.rstrip("/") + path if path else self.base_url, json.dumps(body).encode(), {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {}))
        try:
            reply = urllib.request.urlopen(request, timeout=self.timeout)
        except urllib.error.HTTPError as e:
            raise RuntimeError(f"status {e.code}: {e.read()[:300].decode(errors='replace')}") from e
        return reply if stream else json.loads(reply.read())


class HttpEmbedder(Http):
    def embed(self, texts: list[str]) -> list[list[float] | None]:
        """Vectors in the order of the texts, placed by the index the service gives; cut to the dimensions if longer."""
        reply = self.post("/embeddings", {"input": texts} | ({"model": self.model} if self.model else {}))
        if reply.get("error"):
            raise RuntimeError(str(reply["error"]))
        out: list[list[float] | None] = [None] * len(texts)
        for x in reply.get("data", []):
            if 0 <= x.get("index", 0) < len(out):
                v = x["embedding"]
                out[x.get("index", 0)] = v[: self.dimensions] if 0 < self.dimensions < len(v) else v
        if not any(out):
            raise EmptyResponse("no embedding in the reply")
        return out


class HttpChat(Http):
    def complete(self, user: str, system: str = "") -> str:
        return self.chat(([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": user}])

    def chat(self, messages: list[dict]) -> str:
        reply = self.post("/chat/completions", {"model": self.model, "messages": messages})
        text = ((reply.get("choices") or [{}])[0].get("message") or {}).get("content") or ""
        if not text:
            raise EmptyResponse("the model gave no text")
        return text

    def stream(self, request: dict) -> Iterator[str]:
        """Pieces of text as they come; the request goes on as it is, with this model."""
        with self.post("/chat/completions", request | {"model": self.model, "stream": True}, stream=True) as lines:
            for line in lines:
                data = line.decode().strip().removeprefix("data:").strip()
                if not data or data == "[DONE]":
                    continue
                delta = ((json.loads(data).get("choices") or [{}])[0].get("delta") or {}).get("content")
                if delta:
                    yield delta

    def triples(self, text: str) -> str:
        return self.complete(f"List the facts stated in the text below as a JSON array of objects with the fields subject, predicate and object, 5 to 20 of them, or [] if there are none. Reply with the array only.\n\n{text}")

    def describe(self, agent: str, sample: str) -> str:
        return self.complete(f"In one or two sentences, tell a language model when to search the knowledge of {agent!r}, judging by this extract:\n\n{sample}")


class HttpReranker(Http):
    def scores(self, query: str, documents: list[str]) -> list[tuple[int, float]]:
        reply = self.post("", {"model": self.model, "query": query, "documents": documents, "top_n": len(documents)})
        found = [(x["index"], x["relevance_score"]) for x in reply.get("results", [])]
        if not found:
            raise EmptyResponse("no ranking in the reply")
        return found


@dataclass(frozen=True)
class HashEmbedder:
    """Token counts in md5 buckets, scaled to length 1."""

    dimensions: int = 64

    def start(self):
        return self

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.dimensions)
            for w in t.lower().split():
                v[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % self.dimensions] += 1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


@dataclass(frozen=True)
class EchoChat:
    """Answers with what it was asked; finds triples in lines of the form ``a -- b -- c``."""

    model: str = "echo"

    def start(self):
        return self

    def complete(self, user: str, system: str = "") -> str:
        return user

    def chat(self, messages: list[dict]) -> str:
        last = [m["content"] for m in messages if m["role"] == "user"]
        return f"echo: {last[-1] if last else ''}"

    def stream(self, request: dict) -> Iterator[str]:
        yield from self.chat(request.get("messages", [])).split(" ")

    def triples(self, text: str) -> str:
        found = [line.split(" -- ") for line in text.splitlines()]
        return json.dumps([dict(zip(("subject", "predicate", "object"), f)) for f in found if len(f) == 3])

    def describe(self, agent: str, sample: str) -> str:
        return f"Searches the documents of {agent}."


@dataclass(frozen=True)
class OverlapReranker:
    """Scores a text by the share of the query's distinct tokens that it holds."""

    model: str = "overlap"

    def start(self):
        return self

    def scores(self, query: str, documents: list[str]) -> list[tuple[int, float]]:
        q = set(query.lower().split())
        return [(i, len(q & set(d.lower().split())) / len(q) if q else 0.0) for i, d in enumerate(documents)]


def embed_column(df: DataFrame, text: str, embedder, batch: int = 20, parallel: bool = True, out: str = "embedding", on_empty: str = "error") -> DataFrame:
    """``df`` with an embedding per row. Sequential mode is one task that sends batches and waits out rate limits;
    parallel mode runs on every core. Empty texts are an error, as nothing can be said about them, or are left without
    an embedding (null) with ``on_empty='null'``."""
    keep = [c for c in df.columns if c != out]
    schema = df.select(*keep).withColumn(out, F.lit(None).cast("array<float>")).schema
    sent = df.select(*keep, embeddable(text).alias("_sent"))
    sent = sent if parallel else sent.coalesce(1)

    def work(it):
        model = embedder.start()
        for b in it:
            texts = b["_sent"].to_pylist()
            said = [i for i, t in enumerate(texts) if t]
            if on_empty == "error" and len(said) < len(texts):
                raise ValueError("there is an empty text among those to embed")
            got: list = [None] * len(texts)
            for lo in range(0, len(said), batch):
                at = said[lo : lo + batch]
                for i, v in zip(at, retried(lambda at=at: model.embed([texts[i] for i in at]))):
                    got[i] = v
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(got, pa.list_(pa.float32()))], [*keep, out])

    return sent.mapInArrow(work, schema)

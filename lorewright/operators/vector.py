"""Embedding and exact similarity search."""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewright.functions.scratch import spread
from lorewright.functions.text import col, embeddable, query_terms

DEFAULT_K = 5
#: Queries that are broadcast at once; a larger set is searched block by block.
QUERY_BLOCK = 2048


def truncated(vector: Column | str, dims: int) -> Column:
    """Cut to ``dims`` numbers if longer; never padded or scaled."""
    return F.when(F.size(col(vector)) > dims, F.slice(col(vector), 1, dims)).otherwise(col(vector)) if dims > 0 else col(vector)


def usable(vector: Column | str, dims: int) -> Column:
    """Whether a vector has ``dims`` finite numbers that are not all zero."""
    v = col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) == dims) & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def hash_embedding(text: Column | str, dims: int = 64) -> Column:
    """A deterministic embedding without a model: token counts in md5 buckets, scaled to length 1 (blank texts: zeros)."""
    bucket = F.transform(query_terms(embeddable(text)), lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(dims)).cast("int"))
    counts = F.aggregate(bucket, F.array_repeat(F.lit(0.0), dims), lambda acc, b: F.transform(acc, lambda x, i: F.when(i == b, x + 1.0).otherwise(x)))
    length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(counts, lambda x: F.when(length == 0, F.lit(0.0)).otherwise(x / length))


def hash_vectors(df: DataFrame, text: str, dims: int = 64, out: str = "embedding") -> DataFrame:
    """hash_embedding for a whole table, in Arrow batches."""
    df = spread(df)
    keep = [c for c in df.columns if c != out]
    schema = df.select(*keep).withColumn(out, F.array().cast("array<double>")).schema

    def work(batches):
        import hashlib

        for b in batches:
            rows = []
            for terms in b["_terms"].to_pylist():
                v = np.zeros(dims)
                for t in terms or []:
                    v[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dims] += 1
                n = np.linalg.norm(v)
                rows.append((v / n if n else v).tolist())
            cols = [b.column(c) for c in keep] + [pa.array(rows, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, [*keep, out])

    return df.select(*keep, query_terms(embeddable(text)).alias("_terms")).mapInArrow(work, schema)


def top_k(df: DataFrame, query: list[float], k: int = 0, metric: str = "cosine", vector: str = "embedding", key: str = "id", strict_k: bool = False) -> DataFrame:
    """The k rows most similar to one vector, best first; k of 0 or less is 5. A k beyond the rows gives all rows, or
    an error with ``strict_k``."""
    k = k if k > 0 else DEFAULT_K
    if strict_k and df.count() < k:
        raise ValueError(f"k is {k}, but the store holds fewer rows")
    q = F.array(*[F.lit(float(x)) for x in query])
    sim = cosine(vector, q) if metric == "cosine" else dot(vector, q)
    return df.withColumn("similarity", sim).orderBy(F.desc("similarity"), key).limit(k)


def top_k_batch(rows: DataFrame, queries: DataFrame, k: int = 0, metric: str = "cosine", key: str = "id", query_key: str = "query_id", vector: str = "embedding", dims: int | None = None) -> DataFrame:
    """(query_key, key, similarity, rank) for a table of queries against all rows.

    Blocks of at most QUERY_BLOCK queries are broadcast; every task scores its rows against a block with a matrix
    product and passes on its own best k per query, so what is shuffled does not grow with the rows."""
    k = k if k > 0 else DEFAULT_K
    spark = rows.sparkSession
    q = queries.select(F.col(query_key).alias("qid"), F.col(vector).alias("v")).orderBy("qid")
    stream = q.toLocalIterator()
    src = rows.select(F.col(key).alias("k"), F.col(vector).alias("v"))
    kind = dict(rows.select(key).dtypes)[key]
    qkind = dict(queries.select(query_key).dtypes)[query_key]
    schema = f"qid {qkind}, k {kind}, similarity double"

    def scaled(x):
        n = np.linalg.norm(x, axis=1, keepdims=True) if metric == "cosine" else 1.0
        return x / np.where(n == 0, 1.0, n)

    parts = []
    while some := list(islice(stream, QUERY_BLOCK)):
        block = spark.sparkContext.broadcast(([r["qid"] for r in some], scaled(np.array([r["v"] for r in some], dtype=np.float64))))

        def work(batches, block=block):
            ids, m = block.value
            best_s = np.full((len(ids), 0), -np.inf)
            keys = np.empty((len(ids), 0), dtype=object if kind == "string" else np.int64)
            for b in batches:
                if not b.num_rows:
                    continue
                x = np.array(b["v"].to_pylist(), dtype=np.float64)
                # rows in order of key: among equal scores the first k are those of the smallest keys
                own = np.array(b["k"].to_pylist(), dtype=keys.dtype)
                by_key = np.argsort(own, kind="stable")
                s = np.round(m @ scaled(x[by_key]).T, 12)  # a product's last digits depend on where a row stands
                top = first_k(s, k)
                s = np.hstack([best_s, np.take_along_axis(s, top, 1)])
                all_k = np.hstack([keys, own[by_key][top]])
                order = np.stack([np.lexsort((ks, -sc))[:k] for ks, sc in zip(all_k, s)])
                best_s, keys = np.take_along_axis(s, order, 1), np.take_along_axis(all_k, order, 1)
            out = [(i, kk, ss) for i, ks, sc in zip(ids, keys.tolist(), best_s.tolist()) for ss, kk in zip(sc, ks)]
            cols = list(zip(*out)) if out else ([], [], [])
            yield pa.RecordBatch.from_pydict({"qid": list(cols[0]), "k": list(cols[1]), "similarity": list(cols[2])}, schema=pa.schema([("qid", _arrow(qkind)), ("k", _arrow(kind)), ("similarity", pa.float64())]))

        parts.append(src.mapInArrow(work, schema))
    if not parts:
        return spark.createDataFrame([], schema.replace("qid", query_key, 1).replace(" k ", f" {key} ", 1) + ", rank int")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    w = Window.partitionBy("qid").orderBy(F.desc("similarity"), "k")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(F.col("qid").alias(query_key), F.col("k").alias(key), "similarity", "rank")


def first_k(s: np.ndarray, k: int) -> np.ndarray:
    """For each row the places of its k greatest numbers; of equal ones those that stand first."""
    if s.shape[1] <= k:
        return np.tile(np.arange(s.shape[1]), (len(s), 1))
    bound = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
    # everything above the k-th number, then as many equal to it as are left, in order
    above, equal = s > bound, s == bound
    room = k - above.sum(1, keepdims=True)
    chosen = above | (equal & (np.cumsum(equal, axis=1) <= room))
    return np.nonzero(chosen)[1].reshape(len(s), k)


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def with_source(df: DataFrame) -> DataFrame:
    """The source of each hit, from its metadata."""
    return df.withColumn("source", F.col("metadata")["source"])


def vector_rows(chunks: DataFrame, embedding: str = "embedding") -> DataFrame:
    """(id, content, metadata, embedding) as the store holds it; the index is kept as text."""
    meta = F.map_from_arrays(F.array(F.lit("source"), F.lit("index")), F.array(F.coalesce("source", F.lit("")), F.col("index").cast("string")))
    return chunks.select("id", "content", meta.alias("metadata"), F.col(embedding).alias("embedding"))


def upserted(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New rows replace old ones of the same key; the last of repeated new keys must be made unique before."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)

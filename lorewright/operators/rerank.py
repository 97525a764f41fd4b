"""Reranking of retrieved texts by an outside model or a deterministic stand-in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewright.functions.text import col, query_terms


def endpoint(base: str | None, model: str | None, override: str | None = None) -> str | None:
    """Where to send requests; None (disabled) without a model or address."""
    if not base or not model:
        return None
    if override:
        return override
    return base if "/rerank" in base else base.rstrip("/") + "/rerank"


def lexical_overlap(query: Column | str, content: Column | str) -> Column:
    """The share of the query's distinct terms that the content holds as tokens: a model-free relevance score."""
    q = F.array_distinct(query_terms(query))
    c = F.array_distinct(query_terms(content))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, c)) / F.size(q))


def apply_ranking(docs: DataFrame, scores: DataFrame, by: list[str], index: str = "index", score: str = "relevance_score") -> DataFrame:
    """Documents joined with their scores by position, best first; positions without a document are dropped and equal
    scores keep the order of positions."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), index)
    return docs.join(scores, [*by, index]).withColumn("rank", F.row_number().over(w))


def unranked(docs: DataFrame, index: str = "index") -> DataFrame:
    """What a disabled reranker gives: the order as it is, every score 1."""
    return docs.withColumn("relevance_score", F.lit(1.0)).withColumn("rank", F.col(index) + 1)


def rerank(docs: DataFrame, reranker, by: str = "query_id", query: str = "query", content: str = "content", index: str = "index") -> DataFrame:
    """Scores by a model, one call per query (its hits are few), joined back by position."""
    if reranker is None:
        return unranked(docs, index)
    import pyarrow as pa

    lists = docs.groupBy(by, query).agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(content).alias("c")))).alias("d"))
    kind = dict(docs.dtypes)[by]

    def work(it):
        model = reranker.start()
        for b in it:
            rows = []
            for i, q, d in zip(b[by].to_pylist(), b[query].to_pylist(), b["d"].to_pylist()):
                for at, s in model.scores(q, [x["c"] for x in d]):
                    if 0 <= at < len(d):
                        rows.append((i, d[at]["i"], float(s)))
            cols = list(zip(*rows)) if rows else ([], [], [])
            yield pa.RecordBatch.from_pydict({by: list(cols[0]), index: list(cols[1]), "relevance_score": list(cols[2])}, schema=pa.schema([(by, b.schema.field(by).type), (index, pa.int32()), ("relevance_score", pa.float64())]))

    return apply_ranking(docs, lists.mapInArrow(work, f"{by} {kind}, {index} int, relevance_score double"), [by], index)


def collapse_scores(c: Column | str) -> Column:
    """A score that sorts like the given one, with missing and NaN scores last."""
    return F.when(col(c).isNull() | F.isnan(col(c)), F.lit(float("-inf"))).otherwise(col(c))

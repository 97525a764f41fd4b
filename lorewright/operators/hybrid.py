"""Hybrid retrieval: vector and graph hits in one context, chat messages around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewright.functions.text import col

VECTOR_TITLE = "## Relevant Knowledge"
GRAPH_TITLE = "## Knowledge Graph Context"
MESSAGES = "array<struct<role:string,content:string>>"


def merged(vector_hits: DataFrame, graph_hits: DataFrame) -> DataFrame:
    """Both ranked lists in one table: query_id, section, rank, content, score."""
    v = vector_hits.select("query_id", F.lit("vector").alias("section"), "rank", "content", F.col("similarity").alias("score"))
    g = graph_hits.select("query_id", F.lit("graph").alias("section"), "rank", F.concat_ws(" ", "subject", "predicate", "object").alias("content"), "score")
    return v.unionByName(g)


def vector_section(hits: DataFrame, by: list[str], reranked: bool = False) -> DataFrame:
    """(by..., vector_text): numbered hits; reranked hits show neither source nor similarity."""
    head = F.format_string("**[%d]**", "rank") if reranked else F.format_string("**[%d] Source: %s** (similarity: %.2f)", "rank", "source", "similarity")
    entry = F.concat(head, F.lit("\n"), F.col("content"), F.lit("\n\n"))
    lines = F.array_sort(F.collect_list(F.struct("rank", entry.alias("e"))))
    return hits.groupBy(*by).agg(F.concat(F.lit(VECTOR_TITLE + "\n\n"), F.array_join(lines["e"], "")).alias("vector_text"))


def context(vector_text: Column | str, facts: Column | str) -> Column:
    """The context text; a section without hits is left out."""
    v, f = F.coalesce(col(vector_text), F.lit("")), F.coalesce(col(facts), F.lit(""))
    return F.concat(v, F.when(f == "", "").otherwise(F.concat(F.lit(f"\n{GRAPH_TITLE}\n\n"), f)))


def last_user_message(df: DataFrame, by: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(by, query): the last message of the user, empty where there is none."""
    last = F.max_by(F.when(F.col(role) == "user", F.col(text)), F.when(F.col(role) == "user", F.col(turn)))
    return df.groupBy(by).agg(F.coalesce(last, F.lit("")).alias("query"))


def augmented(messages: Column | str, system_prompt: Column | str | None, context_text: Column | str | None) -> Column:
    """The messages for the model: own system prompt, context, then what the client sent without its system messages."""

    def optional(c):
        if c is None:
            return F.array().cast(MESSAGES)
        c = col(c)
        one = F.array(F.struct(F.lit("system").alias("role"), c.alias("content")))
        return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast(MESSAGES)).otherwise(one)

    return F.concat(optional(system_prompt), optional(context_text), F.filter(col(messages), lambda m: m["role"] != "system"))


def raw_search(vector_hits: DataFrame, graph_hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, result): both result lists of a query as JSON, best first, without reranking."""
    v = vector_hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "content", "source", F.round("similarity", 4).alias("similarity")))).alias("v"))
    g = graph_hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "subject", "predicate", "object", "score"))).alias("g"))
    both = queries.select("query_id", "query").join(v, "query_id", "left").join(g, "query_id", "left")
    vs = F.transform(F.coalesce("v", F.array().cast("array<struct<rank:int,content:string,source:string,similarity:double>>")), lambda x: F.struct(x["content"].alias("content"), x["source"].alias("source"), x["similarity"].alias("similarity")))
    gs = F.transform(F.coalesce("g", F.array().cast("array<struct<rank:int,subject:string,predicate:string,object:string,score:double>>")), lambda x: F.struct(x["subject"].alias("subject"), x["predicate"].alias("predicate"), x["object"].alias("object"), x["score"].alias("score")))
    return both.select("query_id", F.to_json(F.struct(vs.alias("vector_results"), gs.alias("graph_results"), F.col("query").alias("query"))).alias("result"))

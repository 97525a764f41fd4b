"""Keyword search over triples."""

from __future__ import annotations

from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewright.functions.text import col, query_terms, trim

DEFAULT_K = 10
#: Terms shorter than this many bytes do not count.
LEAST_BYTES = 3
FACTS_TITLE = "Knowledge Graph Facts:"
#: Distinct query terms that are looked for at once.
TERM_BLOCK = 100_000


def fact_text(s: Column | str = "subject", p: Column | str = "predicate", o: Column | str = "object") -> Column:
    return F.lower(F.concat_ws(" ", col(s), col(p), col(o)))


def match_score(terms: Column | str, fact: Column | str) -> Column:
    """1 for every counted term that the fact holds as a part of its text; repeated terms count again."""
    f = col(fact)
    return F.size(F.filter(col(terms), lambda t: (F.octet_length(t) >= LEAST_BYTES) & F.contains(f, t))).cast("double")


def search(triples: DataFrame, query: str, k: int = 0, mode: str = "exact", seq: str = "triple_seq") -> DataFrame:
    """The best k facts for one query. Mode ``compat`` ranks only the first 3 k matches in storage order."""
    if not query.strip():
        raise ValueError("the query is empty")
    k = k if k > 0 else DEFAULT_K
    hits = triples.withColumn("score", match_score(query_terms(F.lit(query)), fact_text())).filter("score > 0")
    if mode == "compat":
        hits = hits.orderBy(seq).limit(3 * k)
    return hits.orderBy(F.desc("score"), seq).limit(k)


def scored(triples: DataFrame, queries: DataFrame, seq: str = "triple_seq") -> DataFrame:
    """(query_id, seq, subject, predicate, object, score) for every match of a table of queries (query_id, query).

    The distinct terms of the queries become one automaton that passes once over each fact, so the work grows with the
    facts and their matches, not with facts x queries. Terms are taken in blocks of fixed size."""
    spark = triples.sparkSession
    terms = queries.select("query_id", F.explode(query_terms("query")).alias("term")).filter(F.octet_length("term") >= LEAST_BYTES).groupBy("query_id", "term").agg(F.count("*").cast("double").alias("times"))
    stream = terms.select("term").distinct().orderBy("term").toLocalIterator()
    facts = triples.select(seq, "subject", "predicate", "object")
    text = facts.withColumn("_f", fact_text())
    kind = dict(triples.dtypes)[seq]
    found = None
    while some := [r["term"] for r in islice(stream, TERM_BLOCK)]:
        held = spark.sparkContext.broadcast(some)

        def work(batches, held=held):
            import ahocorasick

            auto = ahocorasick.Automaton()
            for i, t in enumerate(held.value):
                auto.add_word(t, i)
            auto.make_automaton()
            for b in batches:
                at, hit = [], []
                for n, f in enumerate(b["_f"].to_pylist()):
                    got = {i for _, i in auto.iter(f or "")}
                    at += [n] * len(got)
                    hit += [held.value[i] for i in got]
                take = pa.array(at, pa.int64())
                cols = [b.column(c).take(take) for c in (seq, "subject", "predicate", "object")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(hit, pa.string())], [seq, "subject", "predicate", "object", "term"])

        part = text.mapInArrow(work, f"{seq} {kind}, subject string, predicate string, object string, term string")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"query_id long, {seq} {kind}, subject string, predicate string, object string, score double")
    return found.join(terms, "term").groupBy("query_id", seq, "subject", "predicate", "object").agg(F.sum("times").alias("score"))


def search_batch(triples: DataFrame, queries: DataFrame, mode: str = "exact", seq: str = "triple_seq", k: Column | str = "top_k") -> DataFrame:
    """The best facts of every query, with rank. k is a column of ``queries``; null, 0 and less are 10."""
    limit = queries.select("query_id", F.when(col(k) > 0, col(k)).otherwise(DEFAULT_K).alias("_k"))
    hits = scored(triples, queries, seq).join(limit, "query_id")
    if mode == "compat":
        first = Window.partitionBy("query_id").orderBy(seq)
        hits = hits.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= 3 * F.col("_k")).drop("_n")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), seq)
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= F.col("_k")).drop("_k")


def format_facts(facts: DataFrame, order: str = "rank", by: list[str] | None = None) -> DataFrame:
    """(by..., facts): a title and a line per fact in order; an empty text without facts (global form only)."""
    line = F.concat(F.lit("- "), F.concat_ws(" ", "subject", "predicate", "object"))
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("n"), line.alias("line"))))
    grouped = facts.groupBy(*by) if by else facts.groupBy()
    text = F.concat(F.lit(FACTS_TITLE + "\n"), F.array_join(F.col("l.line"), "\n"))
    return grouped.agg(lines.alias("l")).select(*(by or []), F.when(F.size("l") == 0, "").otherwise(text).alias("facts"))


def stored_value(c: Column | str) -> Column:
    """A value as read from a quoted store: one quote off either end, trimmed; null is empty."""
    return trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r'\A"|"\z', ""))


def expand(triples: DataFrame, start: DataFrame, hops: int = 1) -> DataFrame:
    """Facts within some hops of the names in ``start`` (name): an extension beyond keyword search.

    Every hop is one equi-join on subjects and one on objects."""
    seen, out = start.select("name").distinct(), None
    for n in range(1, hops + 1):
        near = triples.join(seen.withColumnRenamed("name", "subject"), "subject", "left_semi").unionByName(triples.join(seen.withColumnRenamed("name", "object"), "object", "left_semi")).distinct().withColumn("hop", F.lit(n))
        out = near if out is None else out.unionByName(near)
        seen = near.select(F.explode(F.array("subject", "object")).alias("name")).union(seen).distinct()
    fields = [c for c in out.columns if c != "hop"]
    return out.groupBy(*fields).agg(F.min("hop").alias("hop"))

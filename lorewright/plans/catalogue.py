"""The engine's queries by name, over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.functions import text as tx
from lorewright.operators import chunk, graph, hybrid, rerank, triples, vector
from lorewright.plans import cases
from lorewright.plans.oracles import oracle_sql  # noqa: F401
from lorewright.sources import files
from lorewright.sources.stores import VECTOR  # noqa: F401


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "source").filter("text is not null")


def source_files(spark, d) -> DataFrame:
    return table(spark, d, "source_files").select("file_id", "name", F.col("content").alias("text")).filter("text is not null").dropDuplicates(["file_id"])


# --- chunking -------------------------------------------------------------------------------------------------


def windows_of(size: int, overlap: int):
    def query(spark, d):
        out = chunk.chunk_text(documents(spark, d), "text", "source", chunk.ChunkOptions(size, overlap))
        return out.select("doc_id", "index", "content", "id")

    return query


def chunk_document(spark, d):
    return chunk.chunk_document(documents(spark, d).drop("source"), 500).select("doc_id", "index", "content", "id")


def split_sentences(spark, d):
    return documents(spark, d).select("doc_id", F.posexplode(chunk.sentences("text")).alias("pos", "sentence"))


def packed_documents(size: int, overlap: int, impl: str = "native"):
    def query(spark, d):
        out = chunk.split_by_sentence(documents(spark, d), "text", "source", chunk.ChunkOptions(size, overlap), impl=impl)
        return out.select("doc_id", "index", "content", "id")

    return query


def packed_files(size: int, overlap: int, impl: str = "native"):
    def query(spark, d):
        out = chunk.split_by_sentence(source_files(spark, d), "text", "name", chunk.ChunkOptions(size, overlap), impl=impl)
        return out.select("file_id", "index", "content", "id")

    return query


def chunk_ids(spark, d):
    return table(spark, d, "chunks").select("chunk_seq", tx.chunk_id("source", "chunk_index").alias("id")).filter("chunk_seq is not null").distinct()


def options_from_max_tokens(spark, d):
    limit = (F.col("p_size") * 173 - 400).cast("int")
    return table(spark, d, "part").select("p_partkey", tx.col(chunk.size_for_tokens(limit)).alias("size"), chunk.overlap_for_tokens(limit).alias("overlap"))


def file_chunks(spark, d) -> DataFrame:
    return chunk.split_by_sentence(source_files(spark, d), "text", "name", chunk.ChunkOptions(1000, 200))


def chunk_seq(spark, d):
    # only what the order needs is placed and numbered
    numbered = chunk.with_sequence(file_chunks(spark, d).select("name", "file_id", "index", "id"), ["name", "file_id", "index"])
    return numbered.select("chunk_seq", "file_id", "index", "id")


def batch10_concat(spark, d):
    return chunk.batches_of(chunk.with_sequence(file_chunks(spark, d), ["name", "file_id", "index"])).select("batch_id", F.length("text").alias("characters"), F.md5("text").alias("digest"))


def head_sample(spark, d):
    return chunk.head_sample(file_chunks(spark, d), order=["name", "file_id", "index"])


# --- triples --------------------------------------------------------------------------------------------------


def clean_triples(spark, d) -> DataFrame:
    return triples.cleaned(table(spark, d, "triples"))


def triples_clean(spark, d):
    return clean_triples(spark, d)


def triples_build(spark, d):
    """Facts of the star schema: customers and suppliers in nations, nations in regions, parts by brand and type."""
    t = lambda n: table(spark, d, n)
    nation = t("nation").withColumnsRenamed({"n_nationkey": "k"})
    located = F.lit("is located in").alias("predicate")
    parts = [
        t("customer").join(nation, F.col("c_nationkey") == F.col("k")).select(F.col("c_name").alias("subject"), located, F.col("n_name").alias("object")),
        t("supplier").join(nation, F.col("s_nationkey") == F.col("k")).select(F.col("s_name").alias("subject"), located, F.col("n_name").alias("object")),
        nation.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("subject"), located, F.col("r_name").alias("object")),
        t("part").select(F.col("p_name").alias("subject"), F.lit("has brand").alias("predicate"), F.col("p_brand").alias("object")),
        t("part").select(F.col("p_name").alias("subject"), F.lit("has type").alias("predicate"), F.col("p_type").alias("object")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return triples.cleaned(out.withColumn("triple_seq", F.lit(0))).drop("triple_seq")


def replies(spark, d) -> DataFrame:
    """Model replies made from the stored facts: plain, fenced, with prose around, without array, cut off, an empty
    array, names in capitals, a number for a text, an empty field."""
    t = table(spark, d, "triples").filter("triple_seq is not null and subject is not null and predicate is not null and object is not null").dropDuplicates(["triple_seq"])
    text = lambda c: F.regexp_replace(c, r'[\\"\p{Cc}]', " ")
    written = lambda s, p, subject: F.concat(F.lit(f'[{{"{s}":'), subject, F.lit(f',"{p}":"'), text("predicate"), F.lit('","object":"'), text("object"), F.lit('"}]'))
    quoted = F.concat(F.lit('"'), text("subject"), F.lit('"'))
    array = written("subject", "predicate", quoted)
    ways = [
        array, F.concat(F.lit("```json\n"), array, F.lit("\n```")), F.concat(F.lit("Here they are: "), array, F.lit(" as asked.")), F.lit("No facts."), F.lit('[{"subject": "cut off"'), F.lit("[]"),
        written("Subject", "PREDICATE", quoted), written("subject", "predicate", F.col("triple_seq").cast("string")), written("subject", "predicate", F.lit('""')),
    ]
    raw = F.element_at(F.array(*ways), (F.col("triple_seq") % 9 + 1).cast("int"))
    return t.select("triple_seq", raw.alias("raw"))


def parse_triples(impl: str):
    def query(spark, d):
        got = triples.parse_replies(replies(spark, d), "raw", impl).select("triple_seq", "malformed", F.coalesce(F.size("triples"), F.lit(0)).alias("_n"), "triples")
        first = F.get("triples", F.lit(0))
        return got.select("triple_seq", "malformed", F.greatest("_n", F.lit(0)).alias("n"), first["subject"].alias("subject"), first["predicate"].alias("predicate"), first["object"].alias("object"))

    return query


def running_triples(spark, d):
    n = table(spark, d, "triples").filter("triple_seq is not null").groupBy(F.floor(F.col("triple_seq") / 10).cast("long").alias("batch_id")).agg(F.count_distinct("triple_seq").alias("n"))
    return triples.running_total(n, "batch_id", "n").select("batch_id", "n", F.col("running_total").cast("long").alias("running_total"))


def stored_values(spark, d):
    return table(spark, d, "triples").filter("triple_seq is not null").select("triple_seq", graph.stored_value(F.concat(F.lit('"'), F.col("object"), F.lit('"'))).alias("value")).distinct()


# --- graph search ---------------------------------------------------------------------------------------------


def stated_queries(spark, d) -> DataFrame:
    """The stated query set of a search: every query whose id is divisible by 50, against all rows."""
    return table(spark, d, "search_queries").filter("query_id % 50 = 0").select("query_id", "query", "top_k").dropDuplicates(["query_id"])


def graph_terms(spark, d):
    q = table(spark, d, "search_queries").select("query_id", F.posexplode(tx.query_terms("query")).alias("pos", "term"))
    return q.distinct()


def graph_score(spark, d):
    return graph.scored(clean_triples(spark, d), stated_queries(spark, d)).select("query_id", "triple_seq", "score")


def graph_search(mode: str):
    def query(spark, d):
        return graph.search_batch(clean_triples(spark, d), stated_queries(spark, d), mode).select("query_id", "rank", "triple_seq", "subject", "predicate", "object", "score")

    return query


def graph_search_single(spark, d):
    hits = graph.search(clean_triples(spark, d), "Institute of Applied Typography", 10)
    return hits.select("triple_seq", "subject", "predicate", "object", "score")


def format_facts(spark, d):
    return graph.format_facts(graph_search("exact")(spark, d), "rank", ["query_id"])


def graph_expand(spark, d):
    start = table(spark, d, "entities").filter("kind = 'organisation'").select("name")
    return graph.expand(clean_triples(spark, d), start, 1).select("triple_seq", "hop")


# --- vector search --------------------------------------------------------------------------------------------


def embeddings(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "embedding")


def vector_topk(metric: str, dims: int = 0, k: int = 5):
    def query(spark, d):
        rows = embeddings(spark, d)
        rows = rows.withColumn("embedding", vector.truncated("embedding", dims)) if dims else rows
        q = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
        found = vector.top_k_batch(rows, q, k, metric, "vec_id")
        return found.select("query_id", "rank", "vec_id", F.round("similarity", 4).alias("similarity"))

    return query


def vector_topk_single(spark, d):
    rows = embeddings(spark, d)
    q = rows.orderBy("vec_id").first()["embedding"]
    return vector.top_k(rows, q, 5, "cosine", key="vec_id").select("vec_id", F.round("similarity", 4).alias("similarity"))


def usable_vectors(spark, d) -> DataFrame:
    return table(spark, d, "vectors").filter(F.col("chunk_seq").isNotNull() & vector.usable("embedding", 96)).dropDuplicates(["chunk_seq"])


def vectors_topk(spark, d):
    rows = usable_vectors(spark, d)
    q = rows.filter("chunk_seq % 50 = 0").select(F.col("chunk_seq").alias("query_id"), "embedding")
    found = vector.top_k_batch(rows, q, 5, "cosine", "chunk_seq")
    return found.select("query_id", "rank", "chunk_seq", F.round("similarity", 4).alias("similarity"))


def vector_sources(spark, d):
    return vector.with_source(table(spark, d, "vectors")).filter("chunk_seq is not null").select("chunk_seq", "source").distinct()


def vector_count(spark, d):
    return usable_vectors(spark, d).agg(F.count("*").alias("n"))


def triple_count(spark, d):
    return clean_triples(spark, d).agg(F.count("*").alias("n"))


def health_stats(spark, d):
    return vector_count(spark, d).withColumnRenamed("n", "vectors").crossJoin(triple_count(spark, d).withColumnRenamed("n", "triples"))  # one row each


def embed_sanitised(spark, d):
    t = tx.embeddable("text")
    return documents(spark, d).select("doc_id", F.length(t).alias("characters"), F.md5(t).alias("digest"))


def hash_embed_documents(spark, d):
    rows = vector.hash_vectors(documents(spark, d).select("doc_id", "text"), "text", 64).select("doc_id", F.posexplode("embedding").alias("dim", "weight"))
    return rows.filter("weight <> 0").select("doc_id", "dim", F.round("weight", 6).alias("weight"))


def upsert_vectors(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("label"), "vec_id")
    old, new = rows.filter("label < 6").select("id", "label"), rows.filter("vec_id % 3 = 0").select("id", (F.col("label") + 100).cast("int").alias("label"))
    return vector.upserted(old, new)


# --- reranking and hybrid -------------------------------------------------------------------------------------


def ranked_hits(spark, d, k: int = 5) -> DataFrame:
    """The best stored hits of every query by similarity, with their texts: query_id, index, content, source, similarity."""
    from pyspark.sql import Window

    hits = table(spark, d, "search_hits").filter("hit_id is not null and query_id is not null and similarity is not null and not isnan(similarity)").dropDuplicates(["hit_id"])
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "hit_id")
    top = hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    texts = table(spark, d, "chunks").filter("chunk_seq is not null").groupBy("id").agg(F.min_by(F.struct("content", "source"), "chunk_seq").alias("c"))
    out = top.join(texts, top["chunk_id"] == texts["id"]).select("query_id", "rank", "hit_id", F.coalesce("c.content", F.lit("")).alias("content"), F.coalesce("c.source", F.lit("")).alias("source"), F.col("similarity").cast("double").alias("similarity"))
    return out.withColumn("index", (F.col("rank") - 1).cast("int"))


def rerank_join(spark, d):
    docs = ranked_hits(spark, d)
    q = table(spark, d, "search_queries").select("query_id", "query").dropDuplicates(["query_id"])
    scores = docs.join(q, "query_id").select("query_id", "index", rerank.lexical_overlap(F.coalesce("query", F.lit("")), "content").alias("relevance_score"))
    out = rerank.apply_ranking(docs.drop("rank"), scores, ["query_id"])
    return out.select("query_id", "rank", "index", "hit_id", F.round("relevance_score", 6).alias("relevance_score"))


def format_context(reranked: bool):
    def query(spark, d):
        hits = ranked_hits(spark, d).join(stated_queries(spark, d).select("query_id"), "query_id", "left_semi")
        facts = graph.format_facts(graph_search("exact")(spark, d), "rank", ["query_id"])
        v = hybrid.vector_section(hits, ["query_id"], reranked)
        both = stated_queries(spark, d).select("query_id").join(v, "query_id", "left").join(facts, "query_id", "left")
        return both.select("query_id", hybrid.context("vector_text", "facts").alias("context"))

    return query


def hybrid_merge(spark, d):
    hits = ranked_hits(spark, d).join(stated_queries(spark, d).select("query_id"), "query_id", "left_semi")
    return hybrid.merged(hits, graph_search("exact")(spark, d)).select("query_id", "section", "rank", "content", F.round("score", 4).alias("score"))


def agent_search(spark, d):
    q = stated_queries(spark, d)
    hits = ranked_hits(spark, d).join(q.select("query_id"), "query_id", "left_semi")
    return hybrid.raw_search(hits, graph_search("exact")(spark, d), q)


def conversations(spark, d) -> DataFrame:
    """The asked queries as the turns of conversations: four queries each, roles by turn."""
    q = table(spark, d, "search_queries").filter("query_id is not null").dropDuplicates(["query_id"])
    turn = (F.col("query_id") % 4).cast("int")
    role = F.when(turn == 0, "system").when(turn == 2, "assistant").otherwise("user")
    return q.select(F.floor(F.col("query_id") / 4).cast("long").alias("conv_id"), turn.alias("turn"), role.alias("role"), F.coalesce("query", F.lit("")).alias("text"))


def last_user_message(spark, d):
    return hybrid.last_user_message(conversations(spark, d))


def augment_messages(spark, d):
    m = conversations(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    sent = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    found = F.when(F.col("conv_id") % 2 == 0, F.lit("Context.")).otherwise(F.lit(""))
    out = m.select("conv_id", F.posexplode(hybrid.augmented(sent, F.lit("Be brief."), found)).alias("pos", "x"))
    return out.select("conv_id", "pos", F.col("x.role").alias("role"), F.col("x.content").alias("content"))


# --- sources, service and display helpers ---------------------------------------------------------------------


def supported_files(spark, d):
    p = F.col("path")
    return table(spark, d, "source_files").filter("file_id is not null and path is not null").select("file_id", files.base_name(p).alias("name"), files.extension(p).alias("extension"), files.is_supported(p).alias("supported")).distinct()


def rate_limit_predicate(spark, d):
    m = F.concat(F.lit("status "), (F.col("event_id") % 7 + 425).cast("string"), F.when(F.col("event_id") % 5 == 0, F.lit(": rate limit")).when(F.col("event_id") % 5 == 1, F.lit(": RATE LIMIT")).otherwise(F.lit("")))
    return table(spark, d, "events").select("event_id", tx.is_rate_limited(m).alias("limited"))


def auth_filter(spark, d):
    i = F.col("event_id")
    key = F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("k"), (i % 3).cast("string")))
    path = F.when(i % 5 == 0, "/health").otherwise("/mcp")
    method = F.when(i % 6 == 0, "OPTIONS").otherwise("POST")
    header = F.when(i % 7 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("Bearer k"), (i % 2).cast("string")))
    return table(spark, d, "events").select("event_id", tx.is_authorised(key, path, method, header).alias("allowed"))


def display_helpers(spark, d):
    n = F.col("o_orderkey") * 37
    s = F.col("o_totalprice") / 10
    return table(spark, d, "orders").select("o_orderkey", tx.short_count(n).alias("count"), tx.pad_right("o_orderstatus", 5).alias("padded"), tx.status_class((F.col("o_orderkey") % 500 + 100).cast("int")).alias("status"), tx.method_class(F.when(F.col("o_orderkey") % 2 == 0, "GET").otherwise("POST")).alias("method"), tx.shown_url(F.concat(F.lit("http://h/"), F.when(s > 1000, "").otherwise("x//"))).alias("url"))


def agent_slugs(spark, d):
    return table(spark, d, "entities").filter("entity_id is not null").select("entity_id", tx.agent_slug("name").alias("slug")).distinct()


def stream_event_counts(spark, d):
    """Event-time counts by Structured Streaming, run to its end over the stored events."""
    import uuid

    from lorewright.functions.scratch import own
    from lorewright.streaming.ingest import late_counts

    one = table(spark, d, "events")
    stream = spark.readStream.schema(one.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    name = "events_" + uuid.uuid4().hex
    out = f"{own(spark)}/{name}"

    def keep(df, number):
        df.write.mode("overwrite").parquet(out)

    q = late_counts(stream, "ts", "1 hour", "3650 days").writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).select("begin_at", "event_type", "n")


def queries() -> dict:
    return cases.queries() | {
        "chunk_text_1000_200": windows_of(1000, 200), "chunk_text_100_20": windows_of(100, 20), "chunk_document": chunk_document, "split_sentences": split_sentences,
        "split_by_sentence_1000": packed_documents(1000, 200), "split_by_sentence_300": packed_documents(300, 60), "split_by_sentence_arrow": packed_documents(1000, 200, "arrow"), "split_files": packed_files(1000, 200), "split_files_arrow": packed_files(1000, 200, "arrow"),
        "chunk_ids": chunk_ids, "options_from_max_tokens": options_from_max_tokens, "chunk_seq": chunk_seq, "batch10_concat": batch10_concat, "head_sample": head_sample,
        "triples_clean": triples_clean, "triples_build": triples_build, "parse_triples": parse_triples("native"), "parse_triples_strict": parse_triples("strict"), "running_triples": running_triples, "stored_values": stored_values,
        "graph_terms": graph_terms, "graph_score": graph_score, "graph_search_exact": graph_search("exact"), "graph_search_compat": graph_search("compat"), "graph_search_single": graph_search_single, "format_facts": format_facts, "graph_expand": graph_expand,
        "vector_topk_cosine": vector_topk("cosine"), "vector_topk_dot": vector_topk("dot"), "vector_topk_default": vector_topk("cosine", k=0), "vector_truncated_dims": vector_topk("cosine", dims=32), "vector_topk_single": vector_topk_single, "vectors_topk": vectors_topk,
        "vector_sources": vector_sources, "vector_count": vector_count, "triple_count": triple_count, "health_stats": health_stats, "embed_sanitised": embed_sanitised, "hash_embed_documents": hash_embed_documents, "upsert_vectors": upsert_vectors,
        "rerank_join": rerank_join, "format_context": format_context(False), "format_context_reranked": format_context(True), "hybrid_merge": hybrid_merge, "agent_search": agent_search, "last_user_message": last_user_message, "augment_messages": augment_messages,
        "supported_files": supported_files, "rate_limit_predicate": rate_limit_predicate, "auth_filter": auth_filter, "display_helpers": display_helpers, "agent_slugs": agent_slugs, "stream_event_counts": stream_event_counts,
    }


def flagship(spark, d) -> DataFrame:
    """Files to chunks, chunks to embeddings, and the chunks most similar to the first asked query."""
    from lorewright.sources.models import HashEmbedder

    asked = table(spark, d, "search_queries").filter("query is not null and trim(query) <> ''").orderBy("query_id").first()["query"]
    chunks = chunk.split_by_sentence(source_files(spark, d), "text", "name", chunk.ChunkOptions(1000, 200))
    held = vector.hash_vectors(chunks.select("file_id", "id", "name", "content"), "content", 64)
    hits = vector.top_k(held, HashEmbedder(64).embed([asked])[0], 5, key="id")
    return hits.select("id", F.col("name").alias("source"), "content", F.round("similarity", 4).alias("similarity"))

"""The same results as SQL for DuckDB."""

from __future__ import annotations

WS = r"[\s\v\x{85}\p{Z}]"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '\\A{WS}+|{WS}+\\z', '', 'g')".replace(r"\\A", r"\A").replace(r"\\z", r"\z")


def lf(x: str) -> str:
    return f"replace({x}, chr(13) || chr(10), chr(10))"


def cid(source: str, i: str) -> str:
    return f"CASE WHEN {source} IS NULL OR {source} = '' THEN 'chunk_' || {i} ELSE translate({source}, '/\\. ', '____') || '_' || {i} END".replace("\\\\", "\\")


def terms(q: str) -> str:
    return f"list_filter(string_split_regex(lower({q}), '{WS}+'), lambda w: w <> '')"


DOCS = "(SELECT doc_id, text, source FROM documents WHERE text IS NOT NULL)"
FILES = "(SELECT DISTINCT ON (file_id) file_id, name, content AS text FROM source_files WHERE content IS NOT NULL ORDER BY file_id)"
CLEAN = f"""(SELECT subject, predicate, object, min(triple_seq) AS triple_seq FROM (
  SELECT triple_seq, {trim("subject")} AS subject, {trim("predicate")} AS predicate, {trim("object")} AS object FROM triples
  WHERE subject <> '' AND predicate <> '' AND object <> '') GROUP BY subject, predicate, object)"""
ASKED = "(SELECT DISTINCT ON (query_id) query_id, query, top_k FROM search_queries WHERE query_id % 50 = 0 ORDER BY query_id)"
USABLE = "(SELECT DISTINCT ON (chunk_seq) chunk_seq, embedding::DOUBLE[] AS e FROM vectors WHERE chunk_seq IS NOT NULL AND len(embedding) = 96 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 96 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 ORDER BY chunk_seq)"


def windows(size: int, overlap: int, source: str = "source") -> str:
    step = size - overlap
    return f"""SELECT doc_id, CAST(i AS INTEGER) AS "index", content, {cid(source, "i")} AS id FROM (
      SELECT doc_id, source, i, {trim(f"substring(t, CAST(i * {step} + 1 AS BIGINT), {size})")} AS content FROM (
        SELECT doc_id, source, t, unnest(range(0, CAST(greatest(0, ceil((length(t) - {size}) / {step}.0)) AS BIGINT) + 1)) AS i
        FROM (SELECT doc_id, source, {lf("text")} AS t FROM {DOCS}))) WHERE content <> ''"""


def packed(src: str, key: str, source: str, size: int, overlap: int, extra: str = "") -> str:
    """CTEs ending in ``chunks``: key, source, index (from 0), content."""
    step = size - overlap
    emit = "CASE WHEN a.cur = '' THEN a.o ELSE list_append(a.o, a.cur) END"
    blank = "false AS fl, false AS hard, '' AS s, CAST([] AS VARCHAR[]) AS pcs"
    none = "fl := false, hard := false, s := '', pcs := CAST([] AS VARCHAR[])"
    del blank
    cut = f"list_filter(list_transform(range(0, CAST(greatest(0, ceil((length(s) - {size}) / {step}.0)) AS BIGINT) + 1), lambda i: {trim(f'substring(s, CAST(i * {step} + 1 AS BIGINT), {size})')}), lambda w: w <> '')"
    return f"""d AS (SELECT {key} AS k, {source} AS src, string_split({lf("text")}, chr(10) || chr(10)) AS ps FROM {src}),
    p AS (SELECT k, src, pi, {trim("p")} AS p FROM (SELECT k, src, unnest(ps) AS p, generate_subscripts(ps, 1) AS pi FROM d)),
    q AS (SELECT k, src, pi, strlen(p) > {size} AS long, CASE WHEN strlen(p) > {size} THEN string_split(regexp_replace(p, '([.!?])([ \\n\\t])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) ELSE [p] END AS ss FROM p WHERE p <> ''),
    r AS (SELECT k, src, pi, long, si, {trim("s")} AS s FROM (SELECT k, src, pi, long, unnest(ss) AS s, generate_subscripts(ss, 1) AS si FROM q)),
    f AS (SELECT k, src, pi, si, s, long AND row_number() OVER (PARTITION BY k, pi ORDER BY si) = 1 AS fl, strlen(s) > {size} AS hard FROM r WHERE s <> ''),
    g AS (SELECT k, src, list(struct_pack(fl := fl, hard := hard, s := s, pcs := CASE WHEN hard THEN {cut} ELSE CAST([] AS VARCHAR[]) END, o := CAST([] AS VARCHAR[]), cur := '') ORDER BY pi, si) AS fs FROM f GROUP BY k, src),
    h AS (SELECT k, src, list_reduce(list_prepend(struct_pack({none}, o := CAST([] AS VARCHAR[]), cur := ''), fs), lambda a, x:
        CASE WHEN x.hard THEN struct_pack({none}, o := list_concat({emit}, x.pcs), cur := '')
             WHEN x.fl OR (strlen(a.cur) + strlen(x.s) + 2 > {size} AND a.cur <> '') THEN struct_pack({none}, o := {emit}, cur := x.s)
             ELSE struct_pack({none}, o := a.o, cur := CASE WHEN a.cur = '' THEN x.s ELSE a.cur || chr(10) || chr(10) || x.s END) END) AS a FROM g),
    e AS (SELECT k, src, {emit} AS cs FROM h),
    chunks_ AS (SELECT k, src, unnest(cs) AS content, generate_subscripts(cs, 1) - 1 AS i FROM e){extra}"""


def packed_query(src: str, key: str, source: str, size: int, overlap: int) -> str:
    return f"""WITH {packed(src, key, source, size, overlap)} SELECT k AS {key}, CAST(i AS INTEGER) AS "index", content, {cid("src", "i")} AS id FROM chunks_"""


SEQ = f"""WITH {packed(FILES, "file_id", "name", 1000, 200)},
    n AS (SELECT row_number() OVER (ORDER BY src, k, i) - 1 AS chunk_seq, k AS file_id, CAST(i AS INTEGER) AS "index", {cid("src", "i")} AS id, content FROM chunks_)"""

SCORED = f"""q AS (SELECT query_id, top_k, list_filter({terms("query")}, lambda w: strlen(w) >= 3) AS ts FROM {ASKED}),
    t AS (SELECT *, lower(subject || ' ' || predicate || ' ' || object) AS f FROM {CLEAN}),
    m AS (SELECT query_id, CASE WHEN top_k > 0 THEN top_k ELSE 10 END AS k, triple_seq, subject, predicate, object, CAST(len(list_filter(ts, lambda w: contains(f, w))) AS DOUBLE) AS score FROM q, t),
    s AS (SELECT * FROM m WHERE score > 0)"""
BEST = f"""{SCORED}, b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, triple_seq) AS rank FROM s), best AS (SELECT * FROM b WHERE rank <= k)"""
HITS = """hits AS (SELECT query_id, rank, hit_id, coalesce(content, '') AS content, coalesce(source, '') AS source, similarity FROM (
      SELECT query_id, hit_id, chunk_id, CAST(similarity AS DOUBLE) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, hit_id) AS rank
      FROM (SELECT DISTINCT ON (hit_id) * FROM search_hits WHERE hit_id IS NOT NULL AND query_id IS NOT NULL AND similarity IS NOT NULL AND NOT isnan(similarity) ORDER BY hit_id)) h
    JOIN (SELECT DISTINCT ON (id) id, content, source FROM chunks WHERE chunk_seq IS NOT NULL ORDER BY id, chunk_seq) c ON h.chunk_id = c.id WHERE rank <= 5)"""
FACTS = "facts AS (SELECT query_id, 'Knowledge Graph Facts:' || chr(10) || string_agg('- ' || subject || ' ' || predicate || ' ' || object, chr(10) ORDER BY rank) AS facts FROM best GROUP BY query_id)"


def context(head: str) -> str:
    return f"""WITH {BEST}, {HITS}, {FACTS}, v AS (SELECT query_id, '## Relevant Knowledge' || chr(10) || chr(10) || string_agg({head} || chr(10) || content || chr(10) || chr(10), '' ORDER BY rank) AS vt FROM hits GROUP BY query_id)
      SELECT a.query_id, coalesce(vt, '') || CASE WHEN facts IS NULL THEN '' ELSE chr(10) || '## Knowledge Graph Context' || chr(10) || chr(10) || facts END AS context
      FROM {ASKED} a LEFT JOIN v USING (query_id) LEFT JOIN facts USING (query_id)"""


def topk(metric: str, dims: int = 64, k: int = 5) -> str:
    f = "list_cosine_similarity" if metric == "cosine" else "list_dot_product"
    e = f"CAST(embedding[1:{dims}] AS DOUBLE[])"
    return f"""SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(s, 4) AS similarity FROM (SELECT q.vec_id AS query_id, v.vec_id, {f}(q.e, v.e) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({f}(q.e, v.e), 12) DESC, v.vec_id) AS rank
      FROM (SELECT vec_id, {e} AS e FROM embeddings WHERE vec_id % 50 = 0) q, (SELECT vec_id, {e} AS e FROM embeddings) v) WHERE rank <= {k}"""


REPLY = "regexp_replace({}, '[\\\\\"\\p{{Cc}}]', ' ', 'g')"


def parse_sql() -> str:
    c = lambda x: REPLY.format(x).replace("\\\\\\\\", "\\\\")
    clean = {f: c(f) for f in ("subject", "predicate", "object")}
    full = " AND ".join(f"{v} <> ''" for v in clean.values())
    found = f"triple_seq % 9 IN (0, 1, 2, 6) AND {full}"
    pick = lambda f: f"CASE WHEN {found} THEN {clean[f]} END AS {f}"
    return f"""SELECT triple_seq, triple_seq % 9 = 7 AS malformed, CAST(CASE WHEN {found} THEN 1 ELSE 0 END AS INTEGER) AS n, {pick("subject")}, {pick("predicate")}, {pick("object")}
      FROM (SELECT DISTINCT ON (triple_seq) * FROM triples WHERE triple_seq IS NOT NULL AND subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL ORDER BY triple_seq)"""


CONV = "(SELECT query_id // 4 AS conv_id, CAST(query_id % 4 AS INTEGER) AS turn, CASE query_id % 4 WHEN 0 THEN 'system' WHEN 2 THEN 'assistant' ELSE 'user' END AS role, coalesce(query, '') AS text FROM (SELECT DISTINCT ON (query_id) * FROM search_queries WHERE query_id IS NOT NULL ORDER BY query_id))"
EXT = "lower(regexp_extract(path, '(\\.[^./\\\\]*)$', 1))"


def oracle_sql() -> dict[str, str]:
    located = "SELECT {} AS subject, 'is located in' AS predicate, {} AS object FROM {}"
    star = " UNION ALL ".join([
        located.format("c_name", "n_name", "customer JOIN nation ON c_nationkey = n_nationkey"), located.format("s_name", "n_name", "supplier JOIN nation ON s_nationkey = n_nationkey"),
        located.format("n_name", "r_name", "nation JOIN region ON n_regionkey = r_regionkey"), "SELECT p_name, 'has brand', p_brand FROM part", "SELECT p_name, 'has type', p_type FROM part",
    ])
    by_sentence = packed_query(DOCS, "doc_id", "source", 1000, 200)
    by_file = packed_query(FILES, "file_id", "name", 1000, 200)
    limit = "(p_size * 173 - 400)"
    overlap = lambda q, c: f"len(list_intersect(list_distinct({terms(q)}), list_distinct({terms(c)}))) / CAST(greatest(1, len(list_distinct({terms(q)}))) AS DOUBLE)"
    msg = "'status ' || CAST(event_id % 7 + 425 AS VARCHAR) || CASE event_id % 5 WHEN 0 THEN ': rate limit' WHEN 1 THEN ': RATE LIMIT' ELSE '' END"
    known = {
        "chunk_text_1000_200": windows(1000, 200), "chunk_text_100_20": windows(100, 20),
        "chunk_document": windows(500, 100, "NULL"),
        "split_sentences": f"SELECT doc_id, CAST(generate_subscripts(ss, 1) - 1 AS INTEGER) AS pos, unnest(ss) AS sentence FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])([ \\n\\t])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS ss FROM {DOCS})",
        "split_by_sentence_1000": by_sentence, "split_by_sentence_arrow": by_sentence, "split_by_sentence_300": packed_query(DOCS, "doc_id", "source", 300, 60), "split_files": by_file, "split_files_arrow": by_file,
        "chunk_ids": f"SELECT DISTINCT chunk_seq, {cid('source', 'chunk_index')} AS id FROM chunks WHERE chunk_seq IS NOT NULL",
        "options_from_max_tokens": f"SELECT p_partkey, CASE WHEN {limit} <= 0 THEN 1000 ELSE greatest(200, CAST(floor({limit} * 4 * 0.9::DOUBLE) AS INTEGER)) END AS size, CASE WHEN {limit} <= 0 THEN 200 ELSE greatest(200, CAST(floor({limit} * 4 * 0.9::DOUBLE) AS INTEGER)) // 5 END AS overlap FROM part",
        "chunk_seq": f'{SEQ} SELECT chunk_seq, file_id, "index", id FROM n',
        "batch10_concat": f"{SEQ} SELECT chunk_seq // 10 AS batch_id, length(string_agg(content || chr(10) || chr(10), '' ORDER BY chunk_seq)) AS characters, md5(string_agg(content || chr(10) || chr(10), '' ORDER BY chunk_seq)) AS digest FROM n GROUP BY 1",
        "head_sample": f"{SEQ} SELECT string_agg(content || chr(10) || chr(10), '' ORDER BY chunk_seq) AS text FROM n WHERE chunk_seq < 3",
        "triples_clean": f"SELECT triple_seq, subject, predicate, object FROM {CLEAN}",
        "triples_build": f"SELECT DISTINCT {trim('subject')} AS subject, {trim('predicate')} AS predicate, {trim('object')} AS object FROM ({star}) WHERE subject <> '' AND predicate <> '' AND object <> ''",
        "parse_triples": parse_sql(), "parse_triples_strict": parse_sql(),
        "running_triples": "SELECT batch_id, n, CAST(sum(n) OVER (ORDER BY batch_id) AS BIGINT) AS running_total FROM (SELECT triple_seq // 10 AS batch_id, count(DISTINCT triple_seq) AS n FROM triples WHERE triple_seq IS NOT NULL GROUP BY 1)",
        "stored_values": f"SELECT DISTINCT triple_seq, {trim('coalesce(object, chr(0))').replace('chr(0)', chr(39) * 2)} AS value FROM triples WHERE triple_seq IS NOT NULL",
        "graph_terms": f"SELECT DISTINCT query_id, CAST(pos AS INTEGER) AS pos, term FROM (SELECT query_id, unnest(ts) AS term, generate_subscripts(ts, 1) - 1 AS pos FROM (SELECT query_id, {terms('query')} AS ts FROM search_queries))",
        "graph_score": f"WITH {SCORED} SELECT query_id, triple_seq, score FROM s",
        "graph_search_exact": f"WITH {BEST} SELECT query_id, CAST(rank AS INTEGER) AS rank, triple_seq, subject, predicate, object, score FROM best",
        "graph_search_compat": f"WITH {SCORED}, e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY triple_seq) AS n FROM s) WHERE n <= 3 * k), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, triple_seq) AS rank FROM e) SELECT query_id, CAST(rank AS INTEGER) AS rank, triple_seq, subject, predicate, object, score FROM b WHERE rank <= k",
        "graph_search_single": f"WITH t AS (SELECT *, lower(subject || ' ' || predicate || ' ' || object) AS f FROM {CLEAN}), s AS (SELECT triple_seq, subject, predicate, object, CAST(len(list_filter(['institute', 'applied', 'typography'], lambda w: contains(f, w))) AS DOUBLE) AS score FROM t) SELECT * FROM s WHERE score > 0 ORDER BY score DESC, triple_seq LIMIT 10",
        "format_facts": f"WITH {BEST}, {FACTS} SELECT query_id, facts FROM facts",
        "graph_expand": f"SELECT triple_seq, 1 AS hop FROM {CLEAN} WHERE subject IN (SELECT name FROM entities WHERE kind = 'organisation') OR object IN (SELECT name FROM entities WHERE kind = 'organisation')",
        "vector_topk_cosine": topk("cosine"), "vector_topk_dot": topk("dot"), "vector_topk_default": topk("cosine"), "vector_truncated_dims": topk("cosine", 32),
        "vector_topk_single": "SELECT v.vec_id, round(list_cosine_similarity(q.e, v.e), 4) AS similarity FROM (SELECT embedding::DOUBLE[] AS e FROM embeddings ORDER BY vec_id LIMIT 1) q, (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) v ORDER BY list_cosine_similarity(q.e, v.e) DESC, v.vec_id LIMIT 5",
        "vectors_topk": f"SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_seq, round(s, 4) AS similarity FROM (SELECT q.chunk_seq AS query_id, v.chunk_seq, list_cosine_similarity(q.e, v.e) AS s, row_number() OVER (PARTITION BY q.chunk_seq ORDER BY round(list_cosine_similarity(q.e, v.e), 12) DESC, v.chunk_seq) AS rank FROM (SELECT * FROM {USABLE} WHERE chunk_seq % 50 = 0) q, {USABLE} v) WHERE rank <= 5",
        "vector_sources": "SELECT DISTINCT chunk_seq, metadata['source'] AS source FROM vectors WHERE chunk_seq IS NOT NULL",
        "vector_count": f"SELECT count(*) AS n FROM {USABLE}", "triple_count": f"SELECT count(*) AS n FROM {CLEAN}", "health_stats": f"SELECT (SELECT count(*) FROM {USABLE}) AS vectors, (SELECT count(*) FROM {CLEAN}) AS triples",
        "embed_sanitised": f"SELECT doc_id, CAST(length(t) AS INTEGER) AS characters, md5(t) AS digest FROM (SELECT doc_id, replace({trim('text')}, chr(0), '') AS t FROM {DOCS})",
        "hash_embed_documents": f"""WITH w AS (SELECT doc_id, unnest({terms(f"{trim('text')}")}) AS w FROM {DOCS}), b AS (SELECT doc_id, CAST(('0x' || substring(md5(w), 1, 8))::BIGINT % 64 AS INTEGER) AS dim, count(*) AS n FROM w GROUP BY ALL)
          SELECT doc_id, dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM b""",
        "upsert_vectors": "SELECT CAST(vec_id AS VARCHAR) AS id, label FROM embeddings WHERE label < 6 AND vec_id % 3 <> 0 UNION ALL SELECT CAST(vec_id AS VARCHAR), CAST(label + 100 AS INTEGER) FROM embeddings WHERE vec_id % 3 = 0",
        "rerank_join": f"""WITH {HITS}, q AS (SELECT DISTINCT ON (query_id) query_id, coalesce(query, '') AS query FROM search_queries ORDER BY query_id), s AS (SELECT query_id, CAST(rank - 1 AS INTEGER) AS "index", hit_id, {overlap("query", "content")} AS relevance_score FROM hits JOIN q USING (query_id))
          SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC, "index") AS INTEGER) AS rank, "index", hit_id, round(relevance_score, 6) AS relevance_score FROM s""",
        "format_context": context("'**[' || rank || '] Source: ' || source || '** (similarity: ' || format('{:.2f}', similarity) || ')'"), "format_context_reranked": context("'**[' || rank || ']**'"),
        "hybrid_merge": f"""WITH {BEST}, {HITS} SELECT query_id, 'vector' AS section, CAST(rank AS INTEGER) AS rank, content, round(similarity, 4) AS score FROM hits WHERE query_id % 50 = 0
          UNION ALL SELECT query_id, 'graph', CAST(rank AS INTEGER), subject || ' ' || predicate || ' ' || object, round(score, 4) FROM best""",
        "agent_search": f"""WITH {BEST}, {HITS}, v AS (SELECT query_id, list(struct_pack(content := content, source := source, similarity := round(similarity, 4)) ORDER BY rank) AS l FROM hits GROUP BY query_id), g AS (SELECT query_id, list(struct_pack(subject := subject, predicate := predicate, object := object, score := score) ORDER BY rank) AS l FROM best GROUP BY query_id)
          SELECT a.query_id, CAST(to_json(struct_pack(vector_results := coalesce(v.l, []), graph_results := coalesce(g.l, []), query := a.query)) AS VARCHAR) AS result FROM {ASKED} a LEFT JOIN v USING (query_id) LEFT JOIN g USING (query_id)""",
        "last_user_message": f"SELECT conv_id, coalesce(arg_max(text, turn) FILTER (WHERE role = 'user'), '') AS query FROM {CONV} GROUP BY conv_id",
        "augment_messages": f"""WITH m AS (SELECT conv_id, 2 + turn AS o, role, text AS content FROM {CONV} WHERE role <> 'system' UNION ALL SELECT DISTINCT conv_id, 0, 'system', 'Be brief.' FROM {CONV} UNION ALL SELECT DISTINCT conv_id, 1, 'system', 'Context.' FROM {CONV} WHERE conv_id % 2 = 0)
          SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY o) - 1 AS INTEGER) AS pos, role, content FROM m""",
        "supported_files": f"SELECT DISTINCT file_id, regexp_extract(path, '([^/\\\\]*)$', 1) AS name, {EXT} AS extension, {EXT} IN ('.md', '.txt', '.markdown', '.pdf') AS supported FROM source_files WHERE file_id IS NOT NULL AND path IS NOT NULL",
        "rate_limit_predicate": f"SELECT event_id, contains({msg}, '429') OR contains({msg}, 'Too Many Requests') OR contains({msg}, 'rate limit') AS limited FROM events",
        "auth_filter": "SELECT event_id, key = '' OR path = '/health' OR method = 'OPTIONS' OR coalesce(header = 'Bearer ' || key, false) AS allowed FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'k' || (event_id % 3) END AS key, CASE WHEN event_id % 5 = 0 THEN '/health' ELSE '/mcp' END AS path, CASE WHEN event_id % 6 = 0 THEN 'OPTIONS' ELSE 'POST' END AS method, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'Bearer k' || (event_id % 2) END AS header FROM events)",
        "display_helpers": """SELECT o_orderkey, CASE WHEN n >= 1000000 THEN n || ' (' || ((n + 50000) // 1000000) || '.' || ((n + 50000) // 100000 % 10) || 'M)' WHEN n >= 1000 THEN n || ' (' || ((n + 50) // 1000) || '.' || ((n + 50) // 100 % 10) || 'K)' ELSE CAST(n AS VARCHAR) END AS count, o_orderstatus || repeat(' ', greatest(0, 5 - strlen(o_orderstatus))) AS padded,
          CASE WHEN st >= 500 THEN 'server error' WHEN st >= 400 THEN 'client error' WHEN st >= 300 THEN 'redirect' WHEN st >= 200 THEN 'ok' ELSE 'other' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'read' ELSE 'write' END AS method, CASE WHEN o_totalprice / 10 > 1000 THEN 'http://h' ELSE 'http://h/x' END AS url
          FROM (SELECT *, o_orderkey * 37 AS n, o_orderkey % 500 + 100 AS st FROM orders)""",
        "agent_slugs": "SELECT DISTINCT entity_id, CASE WHEN name IS NULL OR name = '' THEN 'agent' ELSE lower(replace(name, ' ', '_')) END AS slug FROM entities WHERE entity_id IS NOT NULL",
        "stream_event_counts": "SELECT date_trunc('hour', ts) AS begin_at, event_type, count(*) AS n FROM events GROUP BY ALL",
    }
    from lorewright.plans import cases

    return known | cases.oracle_sql(f"{SEQ} SELECT * FROM n", CLEAN, known["hash_embed_documents"])

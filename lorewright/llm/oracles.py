"""SQL counterparts of the training-data queries, where SQL can express them over whole tables."""

from __future__ import annotations

USABLE = "(SELECT DISTINCT ON (chunk_seq) chunk_seq, embedding::DOUBLE[] AS e FROM vectors WHERE chunk_seq IS NOT NULL AND len(embedding) = 96 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 96 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 ORDER BY chunk_seq)"
SCORES = "(SELECT DISTINCT ON (hit_id) hit_id, query_id, similarity::DOUBLE AS a, score AS b, relevance_score AS c FROM search_hits WHERE hit_id IS NOT NULL AND query_id IS NOT NULL ORDER BY hit_id)"


def mean_rank(x: str) -> str:
    v = f"CASE WHEN {x} IS NULL OR isnan({x}) THEN '-inf'::DOUBLE ELSE {x} END"
    return f"(rank() OVER (PARTITION BY query_id ORDER BY {v}) + (count(*) OVER (PARTITION BY query_id, {v}) - 1) / 2.0)"


def field(name: str) -> str:
    key = f"list_filter(json_keys(raw), lambda k: lower(k) = '{name}')[1]"
    return f"CASE WHEN subject IS NULL AND predicate IS NULL AND object IS NULL AND raw IS NOT NULL THEN CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.\"' || {key} || '\"') END ELSE {name} END AS {name}_"


def normal(name: str) -> str:
    return f"regexp_replace(lower({name}_), '[^\\p{{L}}\\p{{Nd}}]+', '', 'g')"


def blank(name: str) -> str:
    return f"({name}_ IS NULL OR regexp_full_match({name}_, '[\\s\\v\\p{{Z}}\\p{{Cc}}\\p{{Cf}}]*'))"


FIELDS = ("subject", "predicate", "object")
FACTS = f"""f AS (SELECT DISTINCT ON (triple_seq) triple_seq, {", ".join(field(x) for x in FIELDS)} FROM triples WHERE triple_seq IS NOT NULL ORDER BY triple_seq),
  n AS (SELECT triple_seq, min(triple_seq) OVER (PARTITION BY {", ".join(normal(x) for x in FIELDS)}) AS first_seq FROM f WHERE NOT ({" OR ".join(blank(x) for x in FIELDS)}))"""

SHINGLES = """w AS (SELECT DISTINCT ON (kind, id) kind, id, regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+') AS ws FROM (SELECT 'file' AS kind, file_id AS id, content FROM source_files WHERE content IS NOT NULL AND file_id IS NOT NULL UNION ALL SELECT 'chunk', chunk_seq, content FROM chunks WHERE content IS NOT NULL AND chunk_seq IS NOT NULL) ORDER BY kind, id),
  s AS (SELECT DISTINCT kind, id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT kind, id, ws, unnest(range(1, CAST(len(ws) AS BIGINT) - 1)) AS i FROM w WHERE len(ws) >= 3)),
  c AS (SELECT kind, id, count(*) AS n FROM s GROUP BY ALL),
  j AS (SELECT x.kind, x.id AS a_id, y.id AS b_id, count(*) AS both_ FROM s x JOIN s y ON x.kind = y.kind AND x.g = y.g AND x.id < y.id GROUP BY ALL)"""

#: Classes of texts with the same words, and the similar pairs of their first members.
CLASSES = f"""{SHINGLES},
  k AS (SELECT kind, id, min(id) OVER q AS rep, count(*) OVER q AS members FROM w WHERE len(ws) >= 3 WINDOW q AS (PARTITION BY kind, array_to_string(ws, ' '))),
  p AS (SELECT j.kind, a_id, b_id, both_ / (x.n + y.n - both_) AS jaccard FROM j JOIN c x ON x.kind = j.kind AND x.id = a_id JOIN c y ON y.kind = j.kind AND y.id = b_id JOIN k ka ON ka.kind = j.kind AND ka.id = a_id AND ka.rep = a_id JOIN k kb ON kb.kind = j.kind AND kb.id = b_id AND kb.rep = b_id WHERE 2 * both_ >= x.n + y.n - both_)"""

#: White space, and places of units: a line end of two characters becomes \x01\n, which keeps the places.
WS = "[\\s\\x{b}\\x{85}\\p{Z}\\x{1c}-\\x{1f}]"
LINE = "(?:\\x{1}\\n|\\n|\\r)"
BLANK_LINES = f"{LINE}(?:[\\t\\f\\x{{b}}\\x{{85}}\\p{{Z}}\\x{{1c}}-\\x{{1f}} ]*{LINE})+"
OUTER = f"[\\x{{1}}\\s\\x{{b}}\\x{{85}}\\p{{Z}}\\x{{1c}}-\\x{{1f}}]"


def stretches(name: str, source: str, key: str, gap: str, kept: int) -> str:
    """The stretches of ``source`` (key columns, text t, place o) between gaps: key, b (begin), e (end), without outer
    white space. kept: how many characters of the gap belong to the stretch before it."""
    return f"""{name}_p AS (SELECT {key}, o, string_split_regex(t, '{gap}') AS p, regexp_extract_all(t, '{gap}') AS g FROM {source}),
  {name}_u AS (SELECT {key}, i, p[i] || CASE WHEN i <= len(g) THEN left(g[i], {kept}) ELSE '' END AS s, o + list_sum(list_transform(p[1:i - 1], lambda x: length(x)) || [0]) + list_sum(list_transform(g[1:i - 1], lambda x: length(x)) || [0]) AS b0 FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM {name}_p)),
  {name} AS (SELECT {key}, b0 + length(s) - length(regexp_replace(s, '^{OUTER}+', '')) AS b, b0 + length(regexp_replace(s, '{OUTER}+$', '')) AS e, regexp_replace(s, '^{OUTER}+|{OUTER}+$', '', 'g') AS t FROM {name}_u WHERE regexp_replace(s, '{OUTER}+', '', 'g') <> '')"""


UNITS = f"""src AS (SELECT DISTINCT kind, id, replace(content, chr(13) || chr(10), chr(1) || chr(10)) AS t, 0 AS o FROM (SELECT 'file' AS kind, file_id AS id, content FROM source_files UNION ALL SELECT 'chunk', chunk_seq, content FROM chunks) WHERE content IS NOT NULL AND id IS NOT NULL),
  {stretches("par", "src", "kind, id", BLANK_LINES, 0)},
  long_ AS (SELECT kind, id, b AS par, b AS o, t FROM par WHERE e - b > 1000),
  {stretches("sen", "long_", "kind, id, par", f"[.!?]{OUTER}+", 1)},
  both_ AS (SELECT kind, id, -1 AS par, b, e FROM par UNION ALL SELECT kind, id, par, b, e FROM sen),
  prev AS (SELECT kind, id, b, e, lag(b) OVER q AS pb, lag(e) OVER q AS pe FROM both_ WINDOW q AS (PARTITION BY kind, id, par ORDER BY b))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""WITH u AS {USABLE}, s AS (SELECT a.chunk_seq AS a, b.chunk_seq AS b, list_cosine_similarity(a.e, b.e) AS sim FROM u a JOIN u b ON a.chunk_seq <> b.chunk_seq),
          r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS r FROM s WHERE sim >= 0.8) SELECT DISTINCT least(a, b) AS a_seq, greatest(a, b) AS b_seq FROM r WHERE r <= 10""",
        "p2_found": f"WITH h AS {SCORES}, r AS (SELECT query_id, hit_id, {mean_rank('a')} + {mean_rank('b')} + {mean_rank('c')} AS t FROM h) SELECT query_id, hit_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY t DESC, hit_id) AS n FROM r) WHERE n <= 3",
        "p2_ranking": f"""WITH RECURSIVE h AS {SCORES},
          r AS (SELECT query_id, hit_id, ({mean_rank('a')} - 0.5) / count(*) OVER q AS x, ({mean_rank('b')} - 0.5) / count(*) OVER q AS y, ({mean_rank('c')} - 0.5) / count(*) OVER q AS z FROM h WINDOW q AS (PARTITION BY query_id)),
          m AS (SELECT corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM r),
          w(i, a, b, c) AS (SELECT 0, 1::DOUBLE, 1::DOUBLE, 1::DOUBLE UNION ALL SELECT i + 1, (a + b * xy + c * xz) / n, (a * xy + b + c * yz) / n, (a * xz + b * yz + c) / n FROM (SELECT *, sqrt((a + b * xy + c * xz) ** 2 + (a * xy + b + c * yz) ** 2 + (a * xz + b * yz + c) ** 2) AS n FROM w, m WHERE i < 500)),
          l AS (SELECT abs(a) AS a, abs(b) AS b, abs(c) AS c FROM w WHERE i = 500)
          SELECT query_id, hit_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(l.a * (x - 0.5) + l.b * (y - 0.5) + l.c * (z - 0.5), 9) DESC, hit_id) AS INTEGER) AS place FROM r, l""",
        "p5_found": f"WITH {FACTS} SELECT first_seq, triple_seq AS copy_seq FROM n WHERE triple_seq <> first_seq",
        "p5_facts": f"WITH {FACTS} SELECT first_seq, count(*) AS copies FROM n GROUP BY first_seq",
        "p7_found": f"WITH {SHINGLES} SELECT j.kind AS item_kind, a_id, b_id FROM j JOIN c x ON x.kind = j.kind AND x.id = a_id JOIN c y ON y.kind = j.kind AND y.id = b_id WHERE 2 * both_ >= x.n + y.n - both_",
        "p4_found": f"WITH {UNITS} SELECT DISTINCT kind AS item_kind, id AS item_id, CAST(b AS BIGINT) AS cut_at FROM prev WHERE pe - pb <= 800 AND e - b <= 800 AND e - pb > 1000",
        "p7_pairs": f"WITH {CLASSES} SELECT kind AS item_kind, a_id, b_id, round(jaccard, 6) AS jaccard FROM p",
        "p7_members": f"WITH {CLASSES} SELECT kind AS item_kind, id AS item_id, rep AS rep_id FROM k WHERE members > 1",
        "p7_groups": f"""WITH RECURSIVE {CLASSES}, e AS (SELECT kind, a_id AS a, b_id AS b FROM p UNION SELECT kind, b_id, a_id FROM p),
          r AS (SELECT kind, a AS id, a AS top FROM e UNION SELECT r.kind, r.id, e.b FROM r JOIN e ON e.kind = r.kind AND e.a = r.top),
          t AS (SELECT kind, id, min(top) AS top FROM r GROUP BY ALL),
          i AS (SELECT DISTINCT 'file' AS kind, file_id AS id FROM source_files WHERE file_id IS NOT NULL UNION SELECT DISTINCT 'chunk', chunk_seq FROM chunks WHERE chunk_seq IS NOT NULL)
          SELECT i.kind AS item_kind, i.id AS item_id, coalesce(t.top, k.rep, i.id) AS group_id FROM i LEFT JOIN k ON k.kind = i.kind AND k.id = i.id LEFT JOIN t ON t.kind = i.kind AND t.id = coalesce(k.rep, i.id)""",
        "p9_checks": "SELECT DISTINCT source, true AS within_repeats, true AS within_share FROM mix_targets WHERE source IS NOT NULL",
        "p10_rebuilt": "SELECT DISTINCT doc_id, text, true AS found FROM documents WHERE doc_id IS NOT NULL",
        "p8_decoded": "SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL",
    }

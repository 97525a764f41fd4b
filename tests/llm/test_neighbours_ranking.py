import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewright.llm import neighbours, ranking
from lorewright.llm.neighbours import CentroidGraph, balanced_centroids, similar_pairs


def brute(vectors: dict, k=10, floor=0.8):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    out = set()
    for r, i in enumerate(ids):
        for c in sorted(range(len(ids)), key=lambda c: (-s[r, c], ids[c]))[:k]:
            if s[r, c] >= floor:
                out.add((min(i, ids[c]), max(i, ids[c])))
    return out


def clustered(n, dim, seed=0, size=30):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // size + 1, dim))
    return {i: (centres[i // size] + 0.25 * rng.normal(size=dim)).tolist() for i in range(n)}


def table(spark, vectors):
    return spark.createDataFrame([(int(i), [float(v) for v in x] if x is not None else None, "clash") for i, x in vectors], "chunk_seq bigint, embedding array<float>, id string")


def test_pairs_against_brute_force(spark):
    v = clustered(600, 24)
    got = {tuple(r) for r in similar_pairs(table(spark, v.items()), "chunk_seq", "embedding", dim=24, list_rows=40).collect()}
    want = brute(v)
    assert len(want & got) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(got)


def test_blocks_of_long_lists(spark):
    v = clustered(400, 16, seed=3, size=200)
    plain = {tuple(r) for r in similar_pairs(table(spark, v.items()), "chunk_seq", "embedding", dim=16, list_rows=1000).collect()}
    cut = {tuple(r) for r in similar_pairs(table(spark, v.items()), "chunk_seq", "embedding", dim=16, list_rows=1000, block=64).collect()}
    # ranks that differ by less than the quantisation error may swap
    assert plain == cut and len(plain ^ brute(v)) <= 4


def test_unusable_repeated_and_equal_vectors(spark):
    nan, inf = float("nan"), float("inf")
    a = [1.0, 0.0, 0.0, 0.0]
    rows = [(1, a), (1, a), (2, a), (3, None), (4, [0.0] * 4), (5, [nan, 1, 1, 1]), (6, [inf, 1, 1, 1]), (7, [1.0]), (8, [1.0, 0.1, 0.0, 0.0]), (9, [2.0, 0.0, 0.0, 0.0]), (10, [0.0, 0.0, 0.0, 1.0]), (11, [])]
    got = {tuple(r) for r in similar_pairs(table(spark, rows), "chunk_seq", "embedding", dim=4).collect()}
    assert got == {(1, 2), (1, 8), (2, 8), (1, 9), (2, 9), (8, 9)}
    assert similar_pairs(table(spark, []).limit(0), "chunk_seq", "embedding", dim=4).count() == 0


def test_many_equal_vectors_stay_linear(spark):
    rows = [(i, [1.0, 0.0]) for i in range(100)] + [(200, [1.0, 0.01])]
    got = {tuple(r) for r in similar_pairs(table(spark, rows), "chunk_seq", "embedding", dim=2, k=3).collect()}
    # each copy names its 3 smallest fellows; the odd vector names 3 copies
    assert all(a < b and a <= 3 for a, b in got) and len(got) == 6 + 96 * 3 + 3


def test_centroid_graph_recall():
    v = np.array(list(clustered(4000, 24, seed=1).values()), np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    c = balanced_centroids(v, 8)
    g = CentroidGraph(c)
    assert len(g.entries) < len(c) / 2
    near, sim = g.nearest(v[:400], 3)
    best = (v[:400] @ c.T).argmax(1)
    assert np.mean([b in n for b, n in zip(best, near)]) > 0.95 and (np.diff(sim, axis=1) <= 1e-6).all()


def test_quantisation_error():
    x = np.random.default_rng(0).normal(size=(50, 96))
    q, _ = neighbours.quantise(x)
    y = neighbours.unpack([r.tobytes() for r in q], 96)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert np.abs(x @ x.T - y @ y.T).max() < 2e-5


HITS = "hit_id bigint, query_id bigint, similarity float, score double, relevance_score double, rank int"


def test_ranks_with_ties_and_missing(spark):
    nan = float("nan")
    rows = [(1, 1, 0.1, 100.0, None, 0), (2, 1, 0.5, 5.0, 0.2, 0), (3, 1, nan, 5.0, 0.2, 0), (4, 1, None, -3.0, 0.9, 0), (4, 1, None, -3.0, 0.9, 0), (5, 2, None, None, None, 0), (6, None, 1.0, 1.0, 1.0, 0)]
    df = spark.createDataFrame(rows, HITS)
    r = {x["hit_id"]: x for x in ranking.rank_positions(df.dropDuplicates(["hit_id"]).filter("query_id is not null"), "query_id", "hit_id", {"similarity": 1, "score": 1, "relevance_score": 1}).collect()}
    assert [r[i]["similarity"] for i in (1, 2, 3, 4)] == pytest.approx([2.5 / 4, 3.5 / 4, 1 / 4, 1 / 4])
    assert [r[i]["score"] for i in (1, 2, 3, 4)] == pytest.approx([3.5 / 4, 2 / 4, 2 / 4, 0.5 / 4])
    assert r[5]["score"] == 0.5
    out = ranking.combined_ranking(df, "query_id", "hit_id", {"similarity": 1, "score": 1, "relevance_score": 1})
    assert out.count() == 5
    first = ranking.first_in_group(out, "query_id", "hit_id", 1).filter("query_id = 1").first()["hit_id"]
    assert first == 2
    assert ranking.combined_ranking(df.limit(0), "query_id", "hit_id", {"similarity": 1, "score": 1}).count() == 0


def test_hot_group_is_spread(spark):
    rng = np.random.default_rng(2)
    rows = [(i, 1 if i < 800 else i, float(rng.integers(50)), float(rng.normal()), float(rng.normal()), 0) for i in range(1200)]
    df = spark.createDataFrame(rows, HITS)
    got = {r["hit_id"]: r["similarity"] for r in ranking.rank_positions(df, "query_id", "hit_id", {"similarity": 1}).collect()}
    hot = [r for r in rows if r[1] == 1]
    for h in hot[:60]:
        below, same = sum(x[2] < h[2] for x in hot), sum(x[2] == h[2] for x in hot)
        assert got[h[0]] == pytest.approx((below + (same + 1) / 2 - 0.5) / 800)


def test_hot_value_is_ranked_once(spark, monkeypatch):
    rows = [(i, 1 if i < 900 else i, None if i % 3 else float(i), 7.0, float("nan"), 0) for i in range(1000)]
    df = spark.createDataFrame(rows, HITS)
    joined = ranking.join_hot
    monkeypatch.setattr(ranking, "join_hot", lambda *a: joined(*a, parts=10, least=20))  # such values are hot here
    got = {r["hit_id"]: r for r in ranking.rank_positions(df, "query_id", "hit_id", {"similarity": 1, "score": 1, "relevance_score": 1}).collect()}
    assert len(got) == 1000 and got[5]["score"] == got[5]["relevance_score"] == pytest.approx(0.5)
    assert got[5]["similarity"] == pytest.approx((600 + 1) / 2 / 900 - 0.5 / 900) and got[897]["similarity"] == pytest.approx(899.5 / 900)


def test_loadings_follow_the_data(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=2000)
    rows = [(i, 1, float(b), float(b + 0.1 * rng.normal()), float(rng.normal()), 0) for i, b in enumerate(base)]
    r = ranking.rank_positions(spark.createDataFrame(rows, HITS), "query_id", "hit_id", {"similarity": 1, "score": 1, "relevance_score": 1})
    w = ranking.loadings(r, ["similarity", "score", "relevance_score"], False)
    assert min(w[:2]) > 0.6 and w[2] < 0.2  # a score of its own hardly counts
    assert ranking.loadings(r, ["similarity", "score", "relevance_score"], True) == pytest.approx([3**-0.5] * 3)


def test_directions_and_loadings(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=300)
    rows = [(i, 1, float(b), float(-b * 1000 + rng.normal()), float(np.exp(b)), 0) for i, b in enumerate(base)]
    df = spark.createDataFrame(rows, HITS)
    for equal in (True, False):
        out = ranking.combined_ranking(df, "query_id", "hit_id", {"similarity": 1, "score": -1, "relevance_score": 1}, equal)
        assert out.orderBy(F.desc("combined")).first()["hit_id"] == int(base.argmax())

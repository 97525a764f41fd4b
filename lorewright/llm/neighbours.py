"""Most similar vectors for every vector, by balanced posting lists.

A bounded sample is bisected into equally filled cells, whose means (after a few Lloyd rounds) are the
centroids: dense regions get many, so lists stay balanced. The centroids form a neighbour graph held in memory;
each vector walks it to its nearest centroids and is put into every list whose distance is within ``ratio`` of the
nearest one (boundary vectors are replicated, at most ``copies`` times). Lists are searched one by one with
matrix products; lists over ``block`` rows are cut into blocks that meet pairwise, so no task holds an unbounded list.

Defined cases: null, short, zero and non-finite embeddings are not usable and take no part; repeated rows count
once; vectors equal after 16-bit quantisation are one group whose members are each other's nearest (ties go to the
smaller id); an empty table gives an empty result; columns other than id and embedding are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewright.llm.common import hot_size, join_hot, materialize

SCALE = 32767.0


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows as int16 codes with each row's own step (an error of about 3e-6 in a cosine), and the steps."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    step = np.abs(x).max(axis=1, keepdims=True) / SCALE
    return np.rint(x / step).astype("<i2"), step


def unpack(codes, dim: int) -> np.ndarray:
    """Unit float rows from a column of packed codes."""
    q = np.frombuffer(b"".join(codes), dtype="<i2").reshape(-1, dim).astype(np.float32)
    return q / np.linalg.norm(q, axis=1, keepdims=True)


def usable(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id, q): the usable vectors, normalised and packed; repeated rows may still be in."""

    def pack(batches):
        for b in batches:
            col = b.column("v")
            lengths = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
            sound = np.flatnonzero(lengths == dim)
            if not len(sound):
                continue
            flat = pc.list_flatten(col.take(pa.array(sound))).to_numpy(zero_copy_only=False).astype(np.float64)
            x, ids = flat.reshape(-1, dim), b.column("id").to_numpy()[sound]
            fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            x, ids = x[fine], ids[fine]
            if len(x):
                q, _ = quantise(x / np.abs(x).max(axis=1, keepdims=True))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([r.tobytes() for r in q], pa.binary())], ["id", "q"])

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    return src.filter("id is not null and v is not null").mapInArrow(pack, "id long, q binary")


def balanced_centroids(x: np.ndarray, leaf: float, rounds: int = 3, seed: int = 7) -> np.ndarray:
    """Means of equally filled cells from repeated median bisection, moved by a few Lloyd rounds."""
    rng, cells, todo = np.random.default_rng(seed), [], [np.arange(len(x))]
    while todo:
        ix = todo.pop()
        if len(ix) <= max(leaf, 1):
            cells.append(ix)
            continue
        q = x[ix]
        a, b = q[rng.integers(len(q))], q[rng.integers(len(q))]
        half = len(ix) // 2
        for _ in range(5):
            order = np.argsort(q @ (a - b), kind="stable")
            b, a = q[order[:half]].mean(0), q[order[half:]].mean(0)
        order = np.argsort(q @ (a - b), kind="stable")
        todo += [ix[order[:half]], ix[order[half:]]]
    c = np.stack([x[i].mean(0) for i in cells]).astype(np.float32)
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        full = np.linalg.norm(sums, axis=1) > 1e-9
        c[full] = sums[full] / np.linalg.norm(sums[full], axis=1, keepdims=True)
    return c


class CentroidGraph:
    """An in-memory neighbour graph over the centroids, walked best-first for a batch of vectors at once.

    It is built once and broadcast; its size depends on the number of lists alone (about 500 bytes a list)."""

    def __init__(self, c: np.ndarray, links: np.ndarray | None = None, entry: np.ndarray | None = None, degree: int = 32, seed: int = 3):
        self.c, n = c, len(c)
        self.links, self.entries = links, entry
        if links is not None:
            return
        degree = min(degree, n - 1)
        links = np.empty((n, degree), dtype=np.int32)
        for i in range(0, n, 1024):
            s = c[i : i + 1024] @ c.T
            links[i : i + 1024] = np.argpartition(-s, degree, axis=1)[:, :degree]
        self.links = links
        pick = np.random.default_rng(seed).permutation(n)[: max(16, int(8 * n**0.5))]
        self.entries = np.sort(pick).astype(np.int32)

    def nearest(self, x: np.ndarray, k: int, beam: int = 8, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """Indexes and cosines of about the k nearest centroids of each row, nearest first."""
        k = min(k, len(self.c))
        beam = min(max(beam, k), len(self.entries))
        s = x @ self.c[self.entries].T
        best = self.entries[np.argpartition(-s, beam - 1, axis=1)[:, :beam]]
        for _ in range(rounds):
            cand = np.sort(np.concatenate([best, self.links[best].reshape(len(x), -1)], axis=1), axis=1)
            sim = np.einsum("ij,ikj->ik", x, self.c[cand], optimize=True)
            sim[:, 1:][cand[:, 1:] == cand[:, :-1]] = -9
            top = np.argpartition(-sim, beam - 1, axis=1)[:, :beam]
            fresh = np.take_along_axis(cand, top, axis=1)
            done = np.array_equal(np.sort(fresh, 1), np.sort(best, 1))
            best = fresh
            if done:
                break
        sim = np.einsum("ij,ikj->ik", x, self.c[best], optimize=True)
        top, s = self._sorted(sim, np.tile(np.arange(beam), (len(x), 1)))
        return np.take_along_axis(best, top, axis=1)[:, :k], s[:, :k]

    @staticmethod
    def _sorted(s, top):
        val = np.take_along_axis(s, top, axis=1)
        order = np.argsort(-val, axis=1, kind="stable")
        return np.take_along_axis(top, order, axis=1), np.take_along_axis(val, order, axis=1)


def search_list(x, ids, n, lists, own, k, floor, rows_at=512):
    """Best partners within one list. lists: the sorted list numbers of each row; a pair is told only in its smallest common list."""
    out = []
    for i in range(0, len(x), rows_at):
        s = x[i : i + rows_at] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -9
        s[s < floor] = -9
        kk = min(k, s.shape[1])
        top = np.argpartition(-s, kk - 1, axis=1)[:, :kk]
        val = np.take_along_axis(s, top, axis=1)
        r, c = np.nonzero(val > -9)
        a, b, v = r + i, top[r, c], val[r, c]
        out.append((a, b, v))
    a, b, v = (np.concatenate(z) for z in zip(*out))
    if len(a):
        la, lb = lists[a], lists[b]
        common = (la[:, :, None] == lb[:, None, :]) & (la[:, :, None] >= 0)
        least = np.where(common.any(2), la, np.iinfo(np.int32).max).min(1)
        here = least == own
        a, b, v = a[here], b[here], v[here]
    return pd.DataFrame({"a": ids[a], "b": ids[b], "sim": v.astype(np.float32), "n_b": n[b]})


def similar_pairs(df: DataFrame, id_col: str, vec_col: str, dim: int = 96, k: int = 10, floor: float = 0.8, list_rows: int = 200, sample_rows: int = 40_000, copies: int = 3, ratio: float = 1.6, block: int = 4096) -> DataFrame:
    """(a_seq, b_seq): pairs with cosine of at least ``floor`` of which one is among the other's k most similar.

    ``sample_rows`` bounds the rows the centroids are fitted on; every usable row is indexed and is a query.
    """
    spark = df.sparkSession
    rows = usable(df, id_col, vec_col, dim)
    # one shuffle counts repeated rows once and joins equal vectors to a group
    groups = materialize(rows.groupBy("q").agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.count("*").alias("rows")), "vectors-groups")
    total = groups.count()
    shape = "a_seq long, b_seq long"
    if total == 0:
        return spark.createDataFrame([], shape)
    # members of groups of equal vectors: only rows whose vector occurs under several ids are shuffled again
    many = groups.filter("rep <> last").select(F.xxhash64("q").alias("h"), F.col("q").alias("q2"), "rep", "rows")
    every_row = groups.agg(F.sum("rows")).first()[0]
    hashed = rows.select("id", "q", F.xxhash64("q").alias("h"))
    members = materialize(join_hot(hashed, many, ["h"], "rows", every_row).filter("q = q2").select("id", "rep").distinct(), "vectors-members")
    sizes = materialize(members.groupBy("rep").agg(F.count("*").cast("int").alias("n")), "vectors-sizes")
    copied = members.count()
    any_hot = not sizes.filter(F.col("n") > hot_size(copied)).isEmpty()
    # a bounded sample, chosen by hash so that it does not depend on row order
    every = max(1, -(-total // sample_rows))
    sample = groups.filter(F.pmod(F.xxhash64("rep"), F.lit(every)) == 0).select("q").toPandas()["q"]
    if len(sample) == 0:
        sample = groups.select("q").limit(1).toPandas()["q"]
    x = unpack(list(sample), dim)
    n_lists = max(1, total // list_rows)
    c = balanced_centroids(x, len(x) / n_lists)
    built = CentroidGraph(c)
    held = spark.sparkContext.broadcast((c, built.links, built.entries))

    def assign(batches):
        graph = CentroidGraph(*held.value)
        for b in batches:
            if not len(b):
                continue
            v = unpack(list(b["q"]), dim)
            # small steps: the walk holds beam * degree centroids for each row
            near, sim = (np.concatenate(z) for z in zip(*(graph.nearest(v[i : i + 256], copies) for i in range(0, len(v), 256))))
            dist = np.sqrt(np.maximum(2 - 2 * sim, 0))
            keep = dist <= ratio * dist[:, :1] + 1e-6
            lists = [sorted(r[m].tolist()) for r, m in zip(near, keep)]
            yield pd.DataFrame({"id": b["rep"], "n": b["n"], "lists": lists, "q": b["q"]})

    counted = groups.join(sizes, "rep", "left").select("rep", "q", F.coalesce("n", F.lit(1)).alias("n"))
    # walked once: the lengths of lists and the search read what is written
    routed = materialize(counted.mapInPandas(assign, "id long, n int, lists array<int>, q binary"), "vectors-routes")
    posted = routed.select(F.explode("lists").alias("list"), "id", "n", "lists", "q")

    # lists longer than a block: each row gets one of the list's blocks and meets every block once
    lengths = routed.select(F.explode("lists").alias("list")).groupBy("list").count()
    heavy = materialize(lengths.filter(F.col("count") > block).select("list", F.ceil(F.col("count") / block).cast("int").alias("parts")), "vectors-long-lists")
    crowded = not heavy.isEmpty()
    if crowded:
        posted = posted.join(heavy, "list", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        own = F.pmod(F.xxhash64("id"), "parts").cast("int")
        posted = posted.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        keyed = posted.select("list", "id", "n", "lists", "q", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    else:
        keyed = posted.withColumns({"lo": F.lit(0), "hi": F.lit(0)})

    def search(key, b):
        v = unpack(list(b["q"]), dim)
        lists = np.full((len(b), copies), -1, np.int32)
        for i, own in enumerate(b["lists"]):
            lists[i, : len(own)] = own
        return search_list(v, b["id"].to_numpy(), b["n"].to_numpy(), lists, key[0], k, floor)

    found = keyed.groupBy("list", "lo", "hi").applyInPandas(search, "a long, b long, sim float, n_b int")
    # a pair met in several blocks of a list counts once; then ranks with the sizes of groups of equal vectors
    if crowded:
        found = found.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.max("n_b").alias("n_b"))
    w = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    ranked = found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    before = F.coalesce(F.sum("n_b").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ranked.select("a", "b", before.alias("before")).join(sizes.withColumnRenamed("rep", "a"), "a", "left")
    slots = F.lit(k) - (F.coalesce("n", F.lit(1)) - 1) - F.col("before")
    edges = ranked.withColumn("slots", slots.cast("int")).filter("slots > 0").select("a", "b", "slots")
    # equal vectors: the first k + 1 members of a group stand for it, so the result stays linear in its size
    first = members.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).filter(F.col("r") <= k + 1)
    edges = materialize(edges, "vectors-edges")
    # an edge from a group goes out from each of its members
    twins = edges.join(sizes.withColumnRenamed("rep", "a"), "a")
    lone = edges.join(sizes.select(F.col("rep").alias("a")), "a", "left_anti").withColumn("a_id", F.col("a"))
    spread_out = join_hot(members.select(F.col("rep").alias("a"), F.col("id").alias("a_id")), twins, ["a"], "n", copied, any_hot=any_hot)
    edges = lone.select("a_id", "b", "slots").unionByName(spread_out.select("a_id", "b", "slots"))
    edges = edges.join(first.select(F.col("rep").alias("b"), F.col("id").alias("b_id"), "r"), "b", "left")
    edges = edges.filter("r is null or r <= slots").select(F.col("a_id").alias("x"), F.coalesce("b_id", "b").alias("y"))
    within = join_hot(members, first.select("rep", F.col("id").alias("y")).join(sizes, "rep"), ["rep"], "n", copied, any_hot=any_hot).filter("id <> y")
    top = within.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("y"))).filter(F.col("r") <= k)
    both = edges.unionByName(top.select(F.col("id").alias("x"), "y"))
    return both.select(F.least("x", "y").alias("a_seq"), F.greatest("x", "y").alias("b_seq")).distinct()

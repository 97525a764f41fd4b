"""Near-duplicate texts by bottom-k sketches.

One 64-bit hash function orders the distinct word n-grams of a text; the k smallest are its sketch. Inverted lists of
retained values generate overlaps. Similar texts share many retained values, so each text is listed under its rarest
ones only: if two texts must share ``t`` values, the rarest shared one stands among all but the last ``t - 1`` of either
(prefix filter). A list member brings the rest of its values along as 16-bit marks, so the overlap of two sketches is
known where they meet, and pairs with less than the overlap that their sizes ask for go no further. What remains is
filtered by the similarity estimated on the union of both sketches and verified on the exact n-gram sets. Texts with the
same word sequence form a class, of which one member is compared.

Whether a pair is found does not depend on how many other texts share its values: common values are neither dropped nor
refined, they only come last in the order. A list over ``block`` rows is cut into blocks that meet pairwise in tasks of
their own. ``need`` states the overlap asked for; a pair at exactly the threshold falls below it once in a thousand.

Defined cases: null texts and texts with fewer words than an n-gram take no part; repeated rows count once; very
long texts are used whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewright.llm.common import join_hot, materialize, spread

WORD = re.compile(r"[^\W_]+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in that order."""
    with np.errstate(over="ignore"):
        z = a * MIX + b
        z ^= z >> np.uint64(29)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        return z ^ (z >> np.uint64(32))


def shingles(w: list[str], size: int, memo: dict[str, int]) -> np.ndarray:
    """The distinct hashes of the n-grams of a word list, ascending. memo: word hashes, kept by the caller."""
    if len(w) < size:
        return np.empty(0, np.uint64)
    if len(memo) > 200_000:
        memo.clear()
    for x in set(w).difference(memo):
        memo[x] = xxhash.xxh3_64_intdigest(x)
    one = np.fromiter(map(memo.__getitem__, w), np.uint64, len(w))
    h = one[: len(w) - size + 1].copy()
    for j in range(1, size):
        h = mix(h, one[j : len(w) - size + 1 + j])
    return np.unique(h)


def pack(h: np.ndarray) -> bytes:
    """The upper five bytes of ascending hashes: two n-grams of a pair of texts fall together once in 10^12."""
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, 3:]).tobytes()


def unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, 3:] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).ravel()


def digest(w: list[str]) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(w))


def sketches(df: DataFrame, size: int, k: int) -> DataFrame:
    """(kind, id, whole, n, sketch): a hash of the word sequence, the number of n-grams and the k smallest hashes, packed."""

    def work(batches):
        memo: dict[str, int] = {}
        for b in batches:
            out = ([], [], [], [])
            for at, text in enumerate(b["text"].to_pylist()):
                w = words(text)
                h = shingles(w, size, memo)
                if len(h):
                    for col, v in zip(out, (at, digest(w), len(h), pack(h[:k]))):
                        col.append(v)
            keep = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([b["kind"].take(keep), b["id"].take(keep), *[pa.array(x, t) for x, t in zip(out[1:], (pa.binary(), pa.int32(), pa.binary()))]], ["kind", "id", "whole", "n", "sketch"])

    return df.select("kind", "id", "text").mapInArrow(work, "kind string, id long, whole binary, n int, sketch binary")


def need(na: np.ndarray, nb: np.ndarray, k: int, threshold: float, z: float = 3.1) -> np.ndarray:
    """How many retained values two texts of na and nb n-grams share at least, if they are similar enough: exact where
    both sketches hold the whole set, else the number that a pair at the threshold falls below once in a thousand."""
    hi = np.maximum(na, nb)
    both = np.ceil(threshold / (1 + threshold) * (na.astype(np.float64) + nb) - 1e-9)
    p = np.minimum(both / np.maximum(hi, 1), 1.0)
    drawn = np.floor(k * p - z * np.sqrt(k * p * (1 - p)))
    return np.where(hi <= k, both, np.clip(drawn, 1, both)).astype(np.int64)


def least_need(n: np.ndarray, k: int, threshold: float, z: float = 3.1) -> np.ndarray:
    """The least of ``need`` over all sizes that a similar text may have."""
    own = np.ceil(threshold * n - 1e-9)
    drawn = np.floor(k * threshold - z * np.sqrt(k * threshold * (1 - threshold)))
    return np.maximum(np.where(np.floor(n / threshold + 1e-9) <= k, own, np.minimum(own, drawn)), 1).astype(np.int64)


def estimate(sa: np.ndarray, sb: np.ndarray, k: int) -> float:
    """Share of the k smallest values of the union that both sketches hold."""
    u = np.union1d(sa, sb)[:k]
    return np.isin(u, np.intersect1d(sa, sb), assume_unique=True).mean()


def values_of(b) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a batch of sketches (kind, sketch), 40 bits of each retained value with its kind, and their rows."""
    held = b["sketch"].to_pylist()
    count = np.array([len(x) for x in held], np.int64) // 5
    row = np.repeat(np.arange(len(held)), count)
    seed = {x: xxhash.xxh3_64_intdigest(x) for x in set(b["kind"].to_pylist())}
    kind = np.array([seed[x] for x in b["kind"].to_pylist()], np.uint64)
    return (mix(kind[row], unpack(b"".join(held))) >> np.uint64(24)).astype(np.int64), row


def heavy_values(plain: DataFrame, share: int = 1000, least: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys that more than a ``share``-th of all texts hold, with a count for each (at least half of the true one).

    Every stretch of texts tells the keys that a (2 * share)-th of it holds, so no key of that many texts is missed and
    at most 2 * share * k keys are kept, whatever the input."""

    def count(batches):
        some, rows = [], 0

        def told():
            key, n = np.unique(np.concatenate(some), return_counts=True)
            use = n >= max(rows / (2 * share), 2)
            return pa.RecordBatch.from_arrays([pa.array(key[use]), pa.array(n[use].astype(np.int64))], ["key", "n"])

        for b in batches:
            some.append(values_of(b)[0])
            rows += b.num_rows
            if rows >= 50_000:
                yield told()
                some, rows = [], 0
        if rows:
            yield told()

    total = plain.count()
    counts = plain.select("kind", "sketch").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    rows = counts.filter(F.col("n") >= max(least, total / (2 * share))).toPandas().sort_values("key")
    return rows["key"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys begins and how long it is."""
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    return starts, np.diff(np.append(starts, len(key)))


def counted(plain: DataFrame, heavy) -> DataFrame:
    """(num, key, df): the retained values of each text that other texts hold too, with the number of texts that do.

    Rows are spread by key; rows of heavy keys, whose count is known, by text."""

    def post(batches):
        for b in batches:
            key, row = values_of(b)
            num = b["num"].to_numpy()[row]
            at = np.searchsorted(heavy.value[0], key).clip(0, max(len(heavy.value[0]) - 1, 0))
            known = heavy.value[0][at] == key if len(heavy.value[0]) else np.zeros(len(key), bool)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(num), pa.array(np.where(known, heavy.value[1][at] if len(heavy.value[1]) else 0, 0))], ["key", "num", "df"])

    def told(key, num, df):
        return pa.RecordBatch.from_arrays([pa.array(num), pa.array(key), pa.array(df)], ["num", "key", "df"])

    def count(batches):
        key, num = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            k, m, d = (b[c].to_numpy() for c in ("key", "num", "df"))
            yield told(k[d > 0], m[d > 0], d[d > 0])
            key, num = np.concatenate([key, k[d == 0]]), np.concatenate([num, m[d == 0]])
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            yield from lists(key[:cut], num[:cut])
            key, num = key[cut:], num[cut:]
        yield from lists(key, num)

    def lists(key, num):
        if len(key):
            _, n = runs(key)
            n = np.repeat(n, n)
            yield told(key[n > 1], num[n > 1], n[n > 1])

    rows = plain.select("num", "kind", "sketch").mapInArrow(post, "key long, num long, df long")
    placed = rows.repartition(F.when(F.col("df") > 0, F.xxhash64("num")).otherwise(F.col("key"))).sortWithinPartitions("key")
    return placed.mapInArrow(count, "num long, key long, df long")


def candidates(plain: DataFrame, k: int, threshold: float, block: int = 2000, clusters: DataFrame | None = None) -> DataFrame:
    """(a, b): the pairs of texts (num, kind, n, sketch) whose sketches overlap as much as ``need`` asks for; may repeat.

    clusters: (num, cluster) of texts that are linked already; two texts of one cluster are not paired."""
    spark = plain.sparkSession
    held = spark.sparkContext.broadcast(heavy_values(plain))  # bounded, see there
    sized = counted(plain, held).join(plain.select("num", "n").hint("shuffle_merge"), "num").select("num", "n", "key", "df").sortWithinPartitions("num")

    def prefixes(batches):
        rest = None
        for b in batches:
            rows = np.stack([b[c].to_numpy().astype(np.int64) for c in ("num", "n", "key", "df")])
            rest = rows if rest is None else np.concatenate([rest, rows], axis=1)
            cut = int(np.searchsorted(rest[0], rest[0, -1])) if rest.shape[1] else 0
            yield from posted(rest[:, :cut])
            rest = rest[:, cut:]
        if rest is not None:
            yield from posted(rest)

    def posted(rows):
        rows = rows[:, np.lexsort((rows[2], rows[3], rows[0]))]
        num, n, key, df = rows
        starts, s = runs(num)
        if not len(starts):
            return
        left = np.repeat(s + starts, s) - np.arange(len(num))
        use = np.flatnonzero(left >= least_need(n, k, threshold))
        mark = ((key >> 8) % 65534 + 1).astype("<u2").tobytes()
        fp = [mark[2 * i : 2 * (i + m)] for i, m in zip(use.tolist(), left[use].tolist())]
        cols = [pa.array(key[use]), pa.array(num[use]), pa.array(n[use].astype(np.int32)), pa.array(-(-df[use] // block)), pa.array(fp, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["key", "num", "n", "blocks", "marks"])

    rows = sized.mapInArrow(prefixes, "key long, num long, n int, blocks long, marks binary")
    own = F.pmod(F.xxhash64("num"), "blocks")
    # rows of one block have side 0, those of two blocks sides 1 and 2
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("tinyint").alias("side")
    cell = F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).alias("key")
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    if clusters is None:
        rows = rows.withColumn("own", own).withColumn("other", everywhere)
        lists = rows.select(cell, "num", "n", side, "marks")
    else:
        rows = materialize(rows.join(clusters, "num", "left").withColumn("cluster", F.coalesce("cluster", -1 - F.col("num"))).withColumn("own", own), "clustered-lists")
        # of a long list that one cluster makes up mostly, its rows stand in their own block only and the few others in all
        per = rows.filter("blocks > 1").groupBy("key", "cluster").agg(F.count("*").alias("c"))
        per = per.groupBy("key").agg(F.max_by("cluster", "c").alias("most"), F.max("c").alias("c"), F.sum("c").alias("all")).filter(F.col("all") - F.col("c") <= block)
        long_lists = materialize(per.select("key", "most", "all"), "long-lists")
        mostly = join_hot(rows.filter("blocks > 1"), long_lists, ["key"], "all", long_lists.agg(F.sum("all")).first()[0] or 0)
        stays = F.col("cluster") == F.col("most")
        mostly = mostly.withColumn("other", F.explode(F.when(stays, F.array("own")).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))))
        mostly = mostly.select(F.xxhash64("key", F.col("other"), F.lit("mostly")).alias("key"), "num", "n", F.lit(0).cast("tinyint").alias("side"), "marks", "cluster")
        rest = rows.join(long_lists.select("key"), "key", "left_anti").withColumn("other", everywhere)
        lists = rest.select(cell, "num", "n", side, "marks", "cluster").unionByName(mostly)
    lists = lists.repartition(F.col("key")).sortWithinPartitions("key")
    names = [c for c in ("key", "num", "n", "side", "cluster") if c in lists.columns]
    apart = clusters is not None

    def meet(batches):
        rest = None
        for b in batches:
            rows = np.stack([b[c].to_numpy().astype(np.int64) for c in names]), b["marks"].to_pylist()
            rest = rows if rest is None else (np.concatenate([rest[0], rows[0]], axis=1), rest[1] + rows[1])
            cut = int(np.searchsorted(rest[0][0], rest[0][0, -1])) if rest[0].shape[1] else 0
            if cut:
                yield from overlaps(rest[0][:, :cut], rest[1][:cut])
                rest = rest[0][:, cut:], rest[1][cut:]
        if rest is not None and rest[0].shape[1]:
            yield from overlaps(*rest)

    def overlaps(rows, marks, step=500_000):
        starts, length = runs(rows[0])
        if apart:  # a list of one cluster has nothing to tell
            _, key_at = np.unique(np.repeat(np.arange(len(starts)), length), return_index=True)
            mixed = np.minimum.reduceat(rows[4], key_at) != np.maximum.reduceat(rows[4], key_at)
            keep = np.repeat(mixed, length)
            rows, marks = rows[:, keep], [x for x, y in zip(marks, keep.tolist()) if y]
            starts, length = runs(rows[0])
        if not (length > 1).any():
            return
        size = np.array([len(x) for x in marks], np.int64) // 2
        flat = np.frombuffer(b"".join(marks), "<u2")
        row = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        padded = np.zeros((len(size), int(size.max())), np.uint16)
        padded[row, place] = flat
        bits = np.zeros((len(size), 256), bool)
        bits[row, flat & 255] = True
        bits = np.packbits(bits, axis=1).view(np.uint64)
        lost = size - np.bitwise_count(bits).sum(1)  # marks that share a bit with another one of the text
        num, n, side = rows[1:4]
        cluster = rows[4] if apart else rows[1]
        for m in np.unique(length[length > 1]):
            at = starts[length == m]
            few = max(1, min(m, step // m))
            many = max(1, step // (few * m))
            for lo in range(0, len(at), many):
                for x in range(0, m, few):  # a long list meets itself part by part
                    i, j = (v.ravel() for v in np.meshgrid(np.arange(x, min(x + few, m)), np.arange(m), indexing="ij"))
                    i, j = i[i < j], j[i < j]
                    a, b = (at[lo : lo + many, None] + i).ravel(), (at[lo : lo + many, None] + j).ravel()
                    na, nb = n[a], n[b]
                    ok = (cluster[a] != cluster[b]) & ((side[a] != side[b]) | (side[a] == 0)) & (np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9)
                    a, b, na, nb = a[ok], b[ok], na[ok], nb[ok]
                    least = need(na, nb, k, threshold)
                    ok = np.minimum(size[a], size[b]) >= least
                    a, b, least = a[ok], b[ok], least[ok]
                    ok = np.bitwise_count(bits[a] & bits[b]).sum(1) + np.minimum(lost[a], lost[b]) >= least
                    a, b, least = a[ok], b[ok], least[ok]
                    for y in range(0, len(a), 20_000):
                        p, q = a[y : y + 20_000], b[y : y + 20_000]
                        same = ((padded[p][:, :, None] == padded[q][:, None, :]) & (padded[p] > 0)[:, :, None]).any(2).sum(1)
                        p, q = p[same >= least[y : y + 20_000]], q[same >= least[y : y + 20_000]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(num[p], num[q])), pa.array(np.maximum(num[p], num[q]))], ["a", "b"])

    return lists.mapInArrow(meet, "a long, b long")


def id_filter(ids: DataFrame, bits: int = 22) -> np.ndarray:
    """A bitset of fixed size over the hashes of (kind, id): saves shuffling most texts that are not needed; never decides."""
    bucket = F.pmod(F.xxhash64("kind", "id"), F.lit(1 << bits))
    rows = ids.select(bucket.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("m"))
    out = np.zeros(1 << (bits - 6), np.uint64)
    for r in rows.collect():  # at most 2^bits / 64 rows
        out[r["w"]] = np.uint64(r["m"] & 0xFFFFFFFFFFFFFFFF)
    return out


def in_filter(df: DataFrame, held, bits: int = 22) -> DataFrame:
    """The rows (kind, id, text) whose id may be in a broadcast bitset of ``id_filter``."""

    def wanted(batches):
        for b in batches:
            at = b["bucket"].to_numpy()
            yield b.filter(pa.array((held.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1)).select(["kind", "id", "text"])

    return df.withColumn("bucket", F.pmod(F.xxhash64("kind", "id"), F.lit(1 << bits))).mapInArrow(wanted, "kind string, id long, text string")


def prepared(df: DataFrame, size: int, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, drawn, reps): the usable rows (kind, id, text), their sketches, and the classes of equal word sequences,
    numbered as they are written (num, kind, whole, rep, last, members, n, sketch)."""
    df = df.select("kind", F.col("id").cast("long").alias("id"), "text").filter("kind is not null and id is not null and text is not null")
    drawn = materialize(sketches(spread(df), size, k), "sketches")
    classes = drawn.groupBy("kind", "whole").agg(F.min_by(F.struct("n", "sketch"), "id").alias("s"), F.min("id").alias("rep"), F.max("id").alias("last"), F.count("*").alias("members"))
    reps = materialize(classes.select(F.monotonically_increasing_id().alias("num"), "kind", "whole", "rep", "last", "members", "s.n", "s.sketch"), "sketch-classes")
    return df, drawn, reps


def verified(df: DataFrame, reps: DataFrame, met: DataFrame, size: int, threshold: float, k: int) -> DataFrame:
    """(kind, a, b, jaccard, num_a, num_b): the pairs of classes (a, b: numbers) that are similar enough, by their sets."""
    spark = df.sparkSession
    named = reps.select("num", "kind", F.col("rep").alias("id"), "whole")
    side = lambda c: named.select(F.col("num").alias(c), "kind", F.col("id").alias(f"i{c}"), F.col("whole").alias(f"w{c}"))
    met = materialize(met.join(side("a"), "a").join(side("b").drop("kind"), "b").select("a", "b", "kind", "ia", "wa", "ib", "wb"), "met-texts")
    held = spark.sparkContext.broadcast(id_filter(met.select("kind", F.explode(F.array("ia", "ib")).alias("id"))))

    def sets(batches):
        memo: dict[str, int] = {}
        for b in batches:
            w = [words(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["kind"], b["id"], pa.array([digest(x) for x in w], pa.binary()), pa.array([pack(shingles(x, size, memo)) for x in w], pa.binary())], ["kind", "id", "whole", "h"])

    full = in_filter(df, held).mapInArrow(sets, "kind string, id long, whole binary, h binary")
    # both joins use one shuffle of the sets
    one = met.join(full.toDF("kind", "ia", "wa", "ha"), ["kind", "ia", "wa"]).join(full.toDF("kind", "ib", "wb", "hb"), ["kind", "ib", "wb"])

    def verify(batches):
        for b in batches:
            out = ([], [])
            for at, (x, y) in enumerate(zip(b["ha"].to_pylist(), b["hb"].to_pylist())):
                x, y = unpack(x), unpack(y)
                if min(len(x), len(y)) < threshold * max(len(x), len(y)) or estimate(x[:k], y[:k], k) < floor:
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= threshold * (len(x) + len(y) - both):
                    out[0].append(at)
                    out[1].append(both / (len(x) + len(y) - both))
            keep = pa.array(out[0], pa.int64())
            cols = [b[c].take(keep) for c in ("kind", "ia", "ib")] + [pa.array(out[1], pa.float64())] + [b[c].take(keep) for c in ("a", "b")]
            yield pa.RecordBatch.from_arrays(cols, ["kind", "a", "b", "jaccard", "num_a", "num_b"])

    floor = threshold - 4 * (threshold * (1 - threshold) / k) ** 0.5
    return one.select("kind", "ia", "ib", "ha", "hb", "a", "b").mapInArrow(verify, "kind string, a long, b long, jaccard double, num_a long, num_b long")


def copies_of(drawn: DataFrame, reps: DataFrame) -> DataFrame:
    """(kind, id, rep): the texts of classes of several."""
    many = reps.filter("rep <> last").select("kind", "whole", "rep", "members")
    return join_hot(drawn.select("kind", "id", "whole"), many, ["kind", "whole"], "members", drawn.count()).select("kind", "id", "rep").distinct()


def near_duplicates(df: DataFrame, size: int = 5, threshold: float = 0.8, k: int = 32, block: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(pairs, copies) for a table (kind, id, text): pairs (kind, a, b, jaccard) of class representatives that are at
    least ``threshold`` similar, and copies (kind, id, rep) with one row per text of a class of several; a text without
    such a row is its own class."""
    df, drawn, reps = prepared(df, size, k)
    met = materialize(candidates(reps.select("num", "kind", "n", "sketch"), k, threshold, block).distinct(), "met-pairs")
    # repeated rows of a text must not repeat its pairs
    sure = verified(df, reps, met, size, threshold, k)
    pairs = sure.select("kind", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard").distinct()
    return pairs, copies_of(drawn, reps)


def stars(plain: DataFrame, crowd: int, rounds: int = 3) -> DataFrame:
    """(a, b): texts of long lists with the first text of the list, for each of the ``rounds`` smallest retained values:
    as many rows as there are texts and rounds, however alike the texts are."""

    def post(batches):
        for b in batches:
            key, row = values_of(b)
            starts, length = runs(row)
            first = np.arange(len(row)) - np.repeat(starts, length) < rounds
            yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(b["num"].to_numpy()[row[first]])], ["key", "num"])

    rows = materialize(plain.select("num", "kind", "sketch").mapInArrow(post, "key long, num long"), "star-values")
    lists = materialize(rows.groupBy("key").agg(F.min("num").alias("first"), F.count("*").alias("c")).filter(F.col("c") > crowd), "star-lists")
    joined = join_hot(rows, lists, ["key"], "c", lists.agg(F.sum("c")).first()[0] or 0).filter("num <> first")
    return joined.select(F.col("first").alias("a"), F.col("num").alias("b")).distinct()


def expanded(pairs: DataFrame, copies: DataFrame) -> DataFrame:
    """(kind, a, b): the pairs of representatives written out for the members of their classes, and the pairs within
    classes: one row per pair of items, so as many as the square of a class has. ``near_duplicates`` itself stays linear in the size of a class, ``near_groups`` also in that of
    a group of near-copies."""
    out = pairs.select("kind", "a", "b")
    for c in ("a", "b"):
        m = copies.select("kind", F.col("rep").alias(c), F.col("id").alias("m"))
        out = out.join(m, ["kind", c], "left").withColumn(c, F.coalesce("m", c)).drop("m")
    x, y = copies.alias("x"), copies.alias("y")
    within = x.join(y, (F.col("x.kind") == F.col("y.kind")) & (F.col("x.rep") == F.col("y.rep")) & (F.col("x.id") < F.col("y.id"))).select("x.kind", F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    return out.unionByName(within).select("kind", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(kind, id, top) for links (kind, a, b): the smallest id that each linked item can reach, by alternating large and
    small stars, each round written before the next."""
    links = materialize(edges.select("kind", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    while True:
        both = links.unionByName(links.select("kind", F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("kind", "a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.filter("b > a").join(low, ["kind", "a"]).select("kind", F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("kind", "a").agg(F.min("b").alias("low"))
        small = large.join(low, ["kind", "a"]).select("kind", F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
        new = materialize(small.filter("a <> b").distinct(), "links")
        if new.exceptAll(links).isEmpty() and links.exceptAll(new).isEmpty():
            return new.select("kind", F.col("a").alias("id"), F.col("b").alias("top"))
        links = new


def near_groups(df: DataFrame, size: int = 5, threshold: float = 0.8, k: int = 32, block: int = 2000, crowd: int = 200) -> DataFrame:
    """(kind, id, group): one row per item of a table (kind, id, text) with the smallest id that similar texts lead to
    from it. Items without a similar text are their own group.

    Texts of crowded lists are linked with the first text of the list where they are similar to it; texts so linked
    need not be paired with each other any more, so a group of near-copies costs as many rows as it has texts. All
    other pairs are compared as by ``near_duplicates``, so no two groups stay apart that a pair would join."""
    spark = df.sparkSession
    items = df.select("kind", F.col("id").cast("long").alias("id")).filter("kind is not null and id is not null").distinct()
    df, drawn, reps = prepared(df, size, k)
    plain = reps.select("num", "kind", "n", "sketch")
    met = materialize(stars(plain, crowd), "met-stars")
    linked = spark.createDataFrame([], "kind string, a long, b long, jaccard double, num_a long, num_b long")
    clusters = None
    if not met.isEmpty():
        linked = materialize(verified(df, reps, met, size, threshold, k), "star-links")
        top = components(linked.select(F.lit("").alias("kind"), F.col("num_a").alias("a"), F.col("num_b").alias("b")))
        known = top.select(F.col("id").alias("num"), F.col("top").alias("cluster"))
        clusters = materialize(known.unionByName(known.select(F.col("cluster").alias("num"), "cluster")).distinct(), "clusters")
    met = materialize(candidates(plain, k, threshold, block, clusters).distinct(), "met-pairs")
    pairs = verified(df, reps, met, size, threshold, k).unionByName(linked)
    top = components(pairs.select("kind", "a", "b"))
    known = items.join(copies_of(drawn, reps), ["kind", "id"], "left").withColumn("rep", F.coalesce("rep", "id"))
    known = known.join(top.withColumnRenamed("id", "rep"), ["kind", "rep"], "left")
    return known.select("kind", "id", F.coalesce("top", "rep").alias("group"))

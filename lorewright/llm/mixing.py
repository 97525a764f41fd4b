"""Mixing sources to target shares of the total, counted in tokens of a public tokenizer.

Each document belongs to the domains (sources) softly: a naive Bayes classifier, fitted on the labelled table, gives
every document a posterior over the domains. Nonnegative document rates are fitted by projected-gradient least squares,
so that the expected tokens per domain come as near as possible to their targets while no rate exceeds the repeats of
the document's source. What a label says counts as a membership of its own beside the posterior, so the fit has two
totals per domain, by label (an unlabelled document counts by its posterior there too) and by posterior; its last steps
are for the labels alone, whose shares are what is asked for. A rate follows from the document's memberships and the
history of residuals, so an iteration is one narrow pass and an aggregate of as many rows as there are domains. The
total is the largest at which every domain that has documents meets its target by label.

Rates become whole copies: the whole part for every document, one more for those whose hash, divided by the rest of
their rate, lies below a threshold that is searched per domain on a histogram, so the tokens come out right to about
one document.

Defined cases: null and empty texts have no tokens and are taken no time; a domain without documents has an actual
share of zero and the others keep their proportions; domains not in the targets are not used; a null share counts as 0
and a null or negative number of repeats as 0; unlabelled documents may be repeated as often as their posterior allows;
repeated rows count once; an empty table gives no documents and shares of zero; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewright.llm.common import materialize, spread
from lorewright.llm.neardup import words
from lorewright.llm.tokens import TOKENIZERS, token_numbers

BUCKETS = 4096
#: The range of the hashes that draw copies.
SPAN = 256**3


def token_counts(df: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, n_tokens): the tokens of each text, from the table of distinct words."""
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text").filter("doc_id is not null")
    ids = rows.groupBy("doc_id").agg(F.min("source").alias("source"))
    return ids.join(token_numbers(rows, name, folder), "doc_id", "left").select("doc_id", "source", F.coalesce("n_tokens", F.lit(0).cast("long")).alias("n_tokens"))


def bucket_counts(text: str, memo: dict[str, int]) -> np.ndarray:
    """How often words of each hash bucket occur. memo: buckets of words, kept by the caller."""
    w = words(text)
    if len(memo) > 200_000:
        memo.clear()
    for x in set(w).difference(memo):
        memo[x] = xxhash.xxh3_64_intdigest(x) % BUCKETS
    return np.bincount(np.fromiter(map(memo.__getitem__, w), np.int64, len(w)), minlength=BUCKETS)


def fit_domains(df: DataFrame, domains: list[str], sample_rows: int = 50_000) -> np.ndarray:
    """Log probabilities of hashed words by domain, from at most about ``sample_rows`` labelled rows (the prior is the
    last column)."""
    labelled = df.select("doc_id", "source", "text").filter(F.col("source").isin(domains) & F.col("text").isNotNull())
    every = max(1, -(-labelled.count() // sample_rows))
    sample = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    at = {s: i for i, s in enumerate(domains)}

    def count(batches):
        seen, memo = np.zeros((len(domains), BUCKETS + 1), np.int64), {}
        for b in batches:
            for s, text in zip(b["source"].to_pylist(), b["text"].to_pylist()):
                seen[at[s], :BUCKETS] += bucket_counts(text, memo)
                seen[at[s], BUCKETS] += 1
        i, j = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(seen[i, j])], ["i", "j", "n"])

    seen = np.ones((len(domains), BUCKETS + 1))
    for r in sample.mapInArrow(count, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():  # domains x buckets rows at most
        seen[r["i"], r["j"]] += r["n"]
    logs = np.log(seen[:, :BUCKETS] / seen[:, :BUCKETS].sum(1, keepdims=True))
    return np.hstack([logs, np.log(seen[:, BUCKETS:] / seen[:, BUCKETS:].sum())])


def posteriors(df: DataFrame, model: np.ndarray, sharpness: float = 0.1) -> DataFrame:
    """(doc_id, p): the domain posterior of each text. sharpness tempers the independence assumption."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        memo: dict[str, int] = {}
        for b in batches:
            out = []
            for text in b["text"].to_pylist():
                n = bucket_counts(text, memo)
                on = np.flatnonzero(n)
                s = held.value[:, -1] + sharpness * (held.value[:, on] @ n[on])
                s = np.exp(s - s.max())
                out.append(s / s.sum())
            p = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * held.value.shape[0], pa.int32()), pa.array(np.concatenate(out) if out else np.empty(0)))
            yield pa.RecordBatch.from_arrays([b["doc_id"], p], ["doc_id", "p"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null").mapInArrow(work, "doc_id long, p array<double>")


def replay(own: np.ndarray, p: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]], caps: np.ndarray) -> np.ndarray:
    """The rates of documents after the given steps. own: memberships by label, p: by posterior, a row per document."""
    r, top = np.zeros(len(p)), own @ caps
    for by_label, by_posterior in steps:
        r = np.clip(r + own @ by_label + p @ by_posterior, 0, top)
    return r


def memberships(b, width: int) -> tuple[np.ndarray, np.ndarray]:
    """By label and by posterior, of a batch (label, p); the label of an unlabelled document is negative."""
    p = b["p"].values.to_numpy().reshape(-1, width) if b.num_rows else np.empty((0, width))
    label = b["label"].to_numpy()
    own = np.eye(width)[np.maximum(label, 0)]
    return np.where((label >= 0)[:, None], own, p), p


def totals(docs: DataFrame, steps: list, caps: np.ndarray) -> np.ndarray:
    """For each domain at the rates after the given steps: the expected tokens by label and by posterior, the tokens by
    posterior at rates of one, and the tokens by label of documents whose rate can still rise and still fall (rows)."""

    def work(batches):
        sums = np.zeros((5, len(caps)))
        for b in batches:
            own, p = memberships(b, len(caps))
            n = b["n_tokens"].to_numpy()
            r = replay(own, p, steps, caps)
            sums += np.stack([(r * n) @ own, (r * n) @ p, n @ p, (n * (r < own @ caps - 1e-12)) @ own, (n * (r > 1e-12)) @ own])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size, dtype=np.int32)), pa.array(sums.ravel())], ["i", "t"])

    out = np.zeros(5 * len(caps))
    for r in docs.select("n_tokens", "label", "p").mapInArrow(work, "i int, t double").groupBy("i").agg(F.sum("t").alias("t")).collect():  # five rows per domain
        out[r["i"]] = r["t"]
    return out.reshape(5, -1)


def fit_rates(docs: DataFrame, hard: np.ndarray, goal: np.ndarray, caps: np.ndarray, rounds: int = 6, last: int = 6, tolerance: float = 1e-4) -> list[tuple[np.ndarray, np.ndarray]]:
    """The steps from which the rates of documents (n_tokens, label, p) follow.

    Minimises the squared distances of expected domain tokens, by label and by posterior, to ``goal``; a step is scaled
    by the tokens that a domain has. hard: tokens by label. The ``last`` rounds look at labels only, scaled by the tokens
    whose rate can still move, which ends in a few of them."""
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    if not len(hard) or not goal.sum():
        return steps
    for turn in range(rounds + last):
        by_label, by_posterior, there, up, down = totals(docs, steps, caps)
        to_label = (goal - by_label) / np.where(hard > 0, hard, np.inf)
        to_posterior = (goal - by_posterior) / np.where(there > 0, there, np.inf)
        if turn >= rounds:
            if np.abs(goal - by_label).max() <= tolerance * goal.sum():
                break
            free = np.where(goal > by_label, up, down)
            steps.append(((goal - by_label) / np.where(free > 0, free, np.inf), np.zeros_like(to_label)))
        else:
            steps.append((to_label / 2, to_posterior / 2))
    return steps


def thresholds(rows: DataFrame, want: dict[int, float], levels: int = 3, width: int = 256) -> dict[int, int]:
    """Per label the place v below which documents (label, v, n_tokens) hold about the wanted tokens: a search on
    histograms, level by level. v lies between 0 and width ** levels."""
    low = dict.fromkeys(want, 0)
    rest = dict(want)
    for level in range(levels):
        step = width ** (levels - 1 - level)
        bounds = F.create_map([F.lit(x) for kv in low.items() for x in kv]) if low else F.create_map(F.lit(0), F.lit(0))
        inside = rows.withColumn("lo", bounds[F.col("label")]).filter((F.col("v") >= F.col("lo")) & (F.col("v") < F.col("lo") + step * width))
        got = inside.groupBy("label", F.floor(F.col("v") / step).cast("long").alias("b")).agg(F.sum("n_tokens").alias("t")).collect()  # labels x width rows at most
        for s in low:
            mine = sorted((r["b"], r["t"]) for r in got if r["label"] == s)
            for b, t in mine:
                if t > rest[s]:
                    low[s] = b * step
                    break
                rest[s] -= t
                low[s] = (b + 1) * step
            else:
                low[s] = max(low[s], (mine[-1][0] + 1) * step if mine else low[s])
                continue
            if level == levels - 1 and mine:  # the nearer side of the last document
                t = dict(mine).get(low[s], 0)
                if t and t - rest[s] < rest[s]:
                    low[s] += 1
    return low


def mixed(df: DataFrame, targets: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, total_tokens: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(copies, shares): copies (doc_id, source, n_tokens, rate, copies) with a row per document, and shares (source,
    target_share, max_repeats, documents, available_tokens, used_tokens, actual_share, expected_share, most_copies) with
    a row per target: actual shares by label, expected ones by posterior."""
    spark = df.sparkSession
    plan = targets.select("source", F.coalesce("target_share", F.lit(0.0)).alias("share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("cap")).filter("source is not null").dropDuplicates(["source"])
    plan = plan.orderBy("source").collect()  # one row per source
    domains = [r["source"] for r in plan]
    share, caps = np.array([r["share"] for r in plan]), np.array([r["cap"] for r in plan], float)
    sized = materialize(token_counts(df, name, folder), "mix-tokens")
    at = {s: i for i, s in enumerate(domains)}
    hard = np.zeros(len(domains))
    for r in sized.filter(F.col("source").isin(domains)).groupBy("source").agg(F.sum("n_tokens").alias("t")).collect():
        hard[at[r["source"]]] = r["t"] or 0
    zero = lambda c: F.coalesce(c, F.lit(0))
    named = spark.createDataFrame([(r["source"], float(r["share"]), int(r["cap"]), at[r["source"]]) for r in plan], "source string, target_share double, max_repeats int, label int")
    if not domains or not hard.sum():
        copies = sized.withColumns({"rate": F.lit(0.0), "copies": F.lit(0)})
        docs = None
    else:
        model = fit_domains(df, domains)
        marked = sized.join(F.broadcast(named.select("source", "label")), "source", "left").filter("n_tokens > 0 and (source is null or label is not null)")  # one row per source is broadcast
        p = posteriors(spread(df.select("doc_id", "text")), model).dropDuplicates(["doc_id"])
        docs = materialize(marked.select("doc_id", "n_tokens", F.coalesce("label", F.lit(-1)).alias("label")).join(p, "doc_id"), "mix-posteriors")
        there = (hard > 0) & (caps > 0)
        if total_tokens is None:
            total_tokens = min((caps[i] * hard[i] / share[i] for i in np.flatnonzero(there & (share > 0))), default=0.0)
        steps = fit_rates(docs, hard, np.where(there, share * total_tokens, 0.0), caps)

        def rate(batches):
            for b in batches:
                r = replay(*memberships(b, len(domains)), steps, caps)
                yield pa.RecordBatch.from_arrays([b["doc_id"], b["label"], b["n_tokens"], pa.array(r)], ["doc_id", "label", "n_tokens", "rate"])

        rated = docs.mapInArrow(rate, "doc_id long, label int, n_tokens long, rate double")
        whole = F.floor(F.col("rate") + 1e-9)
        rest = F.greatest(F.col("rate") - whole, F.lit(0.0))
        x = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(SPAN)) / SPAN / rest
        place = F.when(rest > 1e-9, F.floor(x / (1 + x) * SPAN)).otherwise(SPAN).cast("long")
        rated = materialize(rated.withColumns({"whole": whole.cast("int"), "rest": rest, "v": place}), "mix-rates")
        parts = rated.filter(F.col("v") < SPAN)
        want = {r["label"]: r["t"] for r in parts.groupBy("label").agg(F.sum(F.col("n_tokens") * F.col("rest")).alias("t")).collect()}  # a row per domain
        low = thresholds(parts, want)
        below = F.create_map([F.lit(x) for kv in low.items() for x in kv])[F.col("label")] if low else F.lit(0)
        drawn = rated.select("doc_id", "rate", (F.col("whole") + (F.col("v") < F.coalesce(below, F.lit(0))).cast("int")).alias("copies"))
        copies = materialize(sized.join(drawn, "doc_id", "left").select("doc_id", "source", "n_tokens", F.coalesce("rate", F.lit(0.0)).alias("rate"), zero("copies").alias("copies")), "mix-copies")
    used = copies.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("available_tokens"), F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("most_copies"))
    whole_sum = copies.agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t")).first()["t"] or 0
    expected = np.zeros(len(domains))
    if docs is not None and whole_sum:
        got = docs.join(copies.select("doc_id", "copies"), "doc_id").agg(*[F.sum(F.col("p")[i] * F.col("n_tokens") * F.col("copies")).alias(f"t{i}") for i in range(len(domains))]).first()
        expected = np.array([x or 0.0 for x in got]) / whole_sum
    by_posterior = F.create_map([F.lit(x) for i, e in enumerate(expected.tolist()) for x in (i, e)])[F.col("label")] if domains else F.lit(0.0)
    shares = named.join(used, "source", "left").select("source", "target_share", "max_repeats", *[zero(c).alias(c) for c in ("documents", "available_tokens", "used_tokens", "most_copies")], by_posterior.alias("expected_share"))
    return copies, shares.withColumn("actual_share", F.col("used_tokens") / float(whole_sum) if whole_sum else F.lit(0.0))

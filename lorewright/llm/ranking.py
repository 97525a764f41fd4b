"""One ranking from several scores on unlike scales.

Scores are replaced by their ranks within the group, so no range or distribution can dominate. Equal values are counted
first, so a value that repeats, however often, is ranked once; ranks are counted on a range partitioning of (group,
score, value), so a group of any size is spread over partitions and only the few groups that straddle partitions need
offsets. The correlation matrix of the ranks is one distributed aggregate; items are sorted by their projection on its
first principal component, whose loadings take the signs of the declared directions. With ``equal_weights`` the
correlations are pooled to their mean before, which makes the loadings of all scores equal.

Defined cases: a null or NaN score ranks lowest in its direction, tied with the other missing ones; equal scores
share their mean rank; repeated rows count once; equal projections are ordered by item id; groups or items without
id take no part; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewright.llm.common import join_hot, materialize, once


def rank_positions(df: DataFrame, group: str, item: str, scores: dict[str, int]) -> DataFrame:
    """(group, item, one column per score): the mean rank of the score within the group, scaled to (0, 1)."""
    missing = lambda c: F.col(c).isNull() | F.isnan(c)
    value = {s: F.when(missing(s), F.lit(float("-inf"))).otherwise(F.col(s).cast("double") * d) for s, d in scores.items()}
    long = df.select(group, item, F.explode(F.array(*[F.struct(F.lit(i).alias("which"), v.alias("v")) for i, v in enumerate(value.values())])).alias("e"))
    long = long.select(group, item, "e.which", (F.col("e.v") + 0.0).alias("v"))
    keys = [group, "which"]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = long.groupBy(*keys, "v").agg(F.count("*").alias("ties"))
    placed = materialize(values.repartitionByRange(parts, *keys, "v").withColumn("part", F.spark_partition_id()), "rank-values")
    within = Window.partitionBy("part", *keys)
    upto = F.sum("ties").over(within.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    # groups that lie in several partitions: at most one per partition boundary
    per = placed.groupBy("part", *keys).agg(F.sum("ties").alias("n"))
    spans = per.groupBy(*keys).agg(F.sum("n").alias("total"), F.count("*").alias("parts"), F.collect_list(F.struct("part", "n")).alias("each"))
    wide = spans.filter("parts > 1").select(*keys, "total", F.explode("each").alias("at"), "each")
    wide = wide.select(*keys, F.col("total").alias("w_total"), F.col("at.part").alias("part"), F.expr("aggregate(filter(each, e -> e.part < at.part), 0L, (s, e) -> s + e.n)").alias("w_before"))
    # one row per (part, straddling group): at most 2 x number of partitions, whatever the input
    ranked = placed.withColumns({"upto": upto, "here": F.sum("ties").over(within)}).join(F.broadcast(wide), ["part", *keys], "left")
    mean = (F.coalesce("w_before", F.lit(0)) + F.col("upto") - F.col("ties") + (F.col("ties") + 1) / 2 - 0.5) / F.coalesce("w_total", "here")
    ranked = materialize(ranked.select(*keys, "v", "ties", mean.alias("r")), "rank-positions")
    out = join_hot(long, ranked, [*keys, "v"], "ties", ranked.agg(F.sum("ties")).first()[0] or 0)
    return out.groupBy(group, item).agg(*[F.max(F.when(F.col("which") == i, F.col("r"))).alias(s) for i, s in enumerate(scores)])


def loadings(ranks: DataFrame, scores: list[str], equal_weights: bool) -> np.ndarray:
    """First principal component of the correlation matrix of the ranks; scores come in their declared directions, so
    every loading is taken as positive: more is never worse."""
    n = len(scores)
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    row = ranks.agg(*[F.corr(scores[i], scores[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    m = np.eye(n)
    for i, j in pairs:
        c = row[f"c{i}_{j}"]
        m[i, j] = m[j, i] = 0.0 if c is None or np.isnan(c) else c
    if equal_weights and n > 1:
        mean = abs((m.sum() - n) / (n * (n - 1)))
        m = np.full((n, n), max(mean, 1e-6)) + np.eye(n) * (1 - max(mean, 1e-6))
    return np.abs(np.linalg.eigh(m)[1][:, -1])


def combined_ranking(df: DataFrame, group: str, item: str, scores: dict[str, int], equal_weights: bool = False) -> DataFrame:
    """(group, item, combined): the projection of each item; sort by it, descending. scores: name -> +1 (more is better) or -1."""
    src = once(df.select(group, item, *scores), item).filter(F.col(group).isNotNull())
    ranks = materialize(rank_positions(src, group, item, scores), "rank-table")
    w = loadings(ranks, list(scores), equal_weights)
    total = sum((F.lit(float(x)) * (F.col(s) - 0.5) for x, s in zip(w, scores)), F.lit(0.0))
    return ranks.select(group, item, F.round(total, 9).alias("combined"))


def places(ranking: DataFrame, group: str, item: str) -> DataFrame:
    """The ranking with the place of each item in its group."""
    return ranking.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("combined"), item)))


def first_in_group(ranking: DataFrame, group: str, item: str, k: int) -> DataFrame:
    """The k items that stand first in each group's ranking."""
    return places(ranking, group, item).filter(F.col("place") <= k)

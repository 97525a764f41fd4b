"""The queries of the training-data operators, as the entry file registers them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorewright.llm.common import table


def p1_found(spark, d):
    from lorewright.llm.neighbours import similar_pairs

    return similar_pairs(table(spark, d, "vectors"), "chunk_seq", "embedding", dim=96, k=10, floor=0.8)


def p6_found(spark, d):
    from lorewright.llm.facts import read_fields
    from lorewright.llm.names import variant_links

    triples = read_fields(table(spark, d, "triples"), ["subject", "predicate", "object"], "raw")
    return variant_links(triples, "triple_seq", ["subject", "object"], table(spark, d, "entities")).withColumnRenamed("id", "triple_seq")


def p7_items(spark, d):
    files = table(spark, d, "source_files").select(F.lit("file").alias("kind"), F.col("file_id").alias("id"), F.col("content").alias("text"))
    chunks = table(spark, d, "chunks").select(F.lit("chunk").alias("kind"), F.col("chunk_seq").alias("id"), F.col("content").alias("text"))
    return files.unionByName(chunks)


def p7_found(spark, d):
    from lorewright.llm.neardup import expanded, near_duplicates

    pairs, copies = near_duplicates(p7_items(spark, d), size=3, threshold=0.5)
    return expanded(pairs, copies).select(F.col("kind").alias("item_kind"), F.col("a").alias("a_id"), F.col("b").alias("b_id"))


def p7_pairs(spark, d):
    from lorewright.llm.neardup import near_duplicates

    pairs = near_duplicates(p7_items(spark, d), size=3, threshold=0.5)[0]
    return pairs.select(F.col("kind").alias("item_kind"), F.col("a").alias("a_id"), F.col("b").alias("b_id"), F.round("jaccard", 6).alias("jaccard"))


def p7_members(spark, d):
    from lorewright.llm.neardup import near_duplicates

    copies = near_duplicates(p7_items(spark, d), size=3, threshold=0.5)[1]
    return copies.select(F.col("kind").alias("item_kind"), F.col("id").alias("item_id"), F.col("rep").alias("rep_id"))


def p7_groups(spark, d):
    from lorewright.llm.neardup import near_groups

    got = near_groups(p7_items(spark, d), size=3, threshold=0.5)
    return got.select(F.col("kind").alias("item_kind"), F.col("id").alias("item_id"), F.col("group").alias("group_id"))


SCORES = {"similarity": 1, "score": 1, "relevance_score": 1}


def p2_found(spark, d):
    from lorewright.llm.ranking import combined_ranking, first_in_group

    ranking = combined_ranking(table(spark, d, "search_hits"), "query_id", "hit_id", SCORES, equal_weights=True)
    return first_in_group(ranking, "query_id", "hit_id", 3).select("query_id", "hit_id")


def p2_ranking(spark, d):
    from lorewright.llm.ranking import combined_ranking, places

    return places(combined_ranking(table(spark, d, "search_hits"), "query_id", "hit_id", SCORES), "query_id", "hit_id").select("query_id", "hit_id", "place")


def p3_found(spark, d):
    from lorewright.llm.markup import fit_on, parts

    files = table(spark, d, "source_files")
    return parts(files, "file_id", "content", fit_on(files, "file_id", "content")).withColumnRenamed("id", "file_id")


def p3_clean(spark, d):
    from lorewright.llm.markup import cleaned, fit_on

    files = table(spark, d, "source_files")
    return cleaned(files, "file_id", "content", fit_on(files, "file_id", "content")).withColumnRenamed("id", "file_id")


def p4_found(spark, d):
    from lorewright.llm.pieces import forced_cuts, split_pieces

    return forced_cuts(split_pieces(p7_items(spark, d))).select(F.col("kind").alias("item_kind"), F.col("id").alias("item_id"), "cut_at")


def p4_pieces(spark, d):
    from lorewright.llm.pieces import split_pieces

    return split_pieces(p7_items(spark, d)).select(F.col("kind").alias("item_kind"), F.col("id").alias("item_id"), "piece", "begin_at", "cut_at", "end_at", "content").dropDuplicates(["item_kind", "item_id", "piece"])


def p5_found(spark, d):
    from lorewright.llm.facts import fact_copies

    return fact_copies(table(spark, d, "triples")).filter("id <> first_id").select(F.col("first_id").alias("first_seq"), F.col("id").alias("copy_seq"))


def p5_facts(spark, d):
    from lorewright.llm.facts import collapsed

    return collapsed(table(spark, d, "triples")).withColumnRenamed("first_id", "first_seq")


def p8_ids(spark, d):
    from lorewright.llm.tokens import token_ids

    return token_ids(table(spark, d, "documents"))


def p8_decoded(spark, d):
    from lorewright.llm.tokens import decoded, pieces, token_ids

    return decoded(token_ids(table(spark, d, "documents")), pieces(spark))


def p9_mix(spark, d):
    from lorewright.llm.mixing import mixed

    return mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark, d):
    from lorewright.llm.mixing import mixed

    return mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_found(spark, d):
    from lorewright.llm.personal import given_names, personal_spans

    spans = personal_spans(table(spark, d, "documents"), "doc_id", "text", given_names(table(spark, d, "entities")))
    return spans.select(F.col("id").alias("doc_id"), "kind", "begin_at")


def p10_masked(spark, d):
    from lorewright.llm.personal import given_names, masked

    return masked(table(spark, d, "documents"), "doc_id", "text", given_names(table(spark, d, "entities"))).withColumnRenamed("id", "doc_id")


def p10_rebuilt(spark, d):
    """The masked texts with what was found put back in: the texts as they were."""
    from lorewright.llm.personal import given_names, masked, personal_spans, rebuilt

    docs, given = table(spark, d, "documents"), given_names(table(spark, d, "entities"))
    back = rebuilt(masked(docs, "doc_id", "text", given), personal_spans(docs, "doc_id", "text", given), docs, "doc_id", "text")
    return back.select(F.col("id").alias("doc_id"), "text", "found")


def p9_checks(spark, d):
    """Whether every source keeps to its repeats and, to one of its documents and half a hundredth of the total, to its
    share, the shares of sources without documents going to the others in proportion."""
    from lorewright.llm.mixing import mixed

    copies, shares = mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    shares = shares.join(copies.groupBy("source").agg(F.max("n_tokens").alias("one")), "source", "left")
    total = F.sum("used_tokens").over(Window.partitionBy(F.lit(0)))
    there = F.sum(F.when(F.col("available_tokens") > 0, F.col("target_share")).otherwise(0.0)).over(Window.partitionBy(F.lit(0)))  # a row per source
    want = F.when(F.col("available_tokens") > 0, F.col("target_share") / there).otherwise(0.0)
    return shares.select("source", (F.col("most_copies") <= F.col("max_repeats")).alias("within_repeats"), (F.abs(F.col("actual_share") - want) <= 0.005 + F.coalesce("one", F.lit(0)) / total).alias("within_share"))


def queries():
    return {name: f for name, f in globals().items() if name.startswith("p") and name[1].isdigit() and callable(f) and not name.endswith("_items")}

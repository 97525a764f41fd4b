"""Duplicates hidden by formatting: one row per fact and its copies, across any number of records.

Every (field name, normalised value) pair is hashed and the hashes are added up, so the order of fields does not
matter (a commutative multiset hash, two independent sums of 62 bits each). Records are grouped by that fingerprint
with map-side combining, numbers only, in hash tables; the records of groups of several are then compared field by
field with the first record of their group through hash joins, so nothing is sorted. Records that differ from it in
spite of an equal fingerprint are grouped by their very fields.

Defined cases: values keep letters and digits only, lower-cased (accents count); records with a null, empty or blank
field take no part; a record whose fields are all null is read from its raw JSON object, names in any order and
letter case; unreadable JSON takes no part; repeated rows count once; an id whose rows state different facts counts
for each of them; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewright.llm.common import hot_size, join_hot, materialize

BLANK = r"^[\s\p{Z}\p{Cc}\p{Cf}]*$"


def normal(c: Column | str) -> Column:
    """The letters and digits of a value, lower-cased."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{Nd}]+", "")


def read_fields(df: DataFrame, fields: list[str], raw: str) -> DataFrame:
    """Fill the fields of records that are only held as JSON in ``raw``."""
    m = F.from_json(F.col(raw), "map<string,string>")
    entries = F.map_entries(m)

    def pick(name):
        return F.get(F.filter(entries, lambda e: F.lower(F.trim(e["key"])) == name), F.lit(0))["value"]

    unsplit = reduce(lambda a, b: a & b, [F.col(f).isNull() for f in fields]) & F.col(raw).isNotNull()
    return df.withColumns({f: F.when(unsplit, pick(f)).otherwise(F.col(f)) for f in fields})


def fingerprint(values: dict[str, Column], seed: str) -> Column:
    """A sum of hashes of (name, value): the same for any order of the fields."""
    return reduce(lambda a, b: a + b, [F.shiftright(F.xxhash64(F.lit(seed), F.lit(k), v), 2) for k, v in sorted(values.items())])


def _grouped(df: DataFrame, id_col: str, fields: list[str], raw: str | None) -> DataFrame:
    df = df.select(id_col, *fields, *([raw] if raw else [])).filter(F.col(id_col).isNotNull())
    df = read_fields(df, fields, raw) if raw else df
    sound = reduce(lambda a, b: a & b, [F.col(f).isNotNull() & ~F.col(f).rlike(BLANK) for f in fields])
    rows = df.filter(sound).select(F.col(id_col).alias("id"), *[normal(f).alias(f) for f in fields])
    v = {f: F.col(f) for f in fields}
    rows = materialize(rows.withColumns({"h1": fingerprint(v, "a"), "h2": fingerprint(v, "b")}), "fact-rows")
    once_each = rows.select("id", "h1", "h2").distinct()
    found = materialize(once_each.groupBy("h1", "h2").agg(F.min("id").alias("first_id"), F.count("*").alias("n")), "fact-groups")
    lone = found.filter("n = 1").select(F.col("first_id").alias("id"), "first_id")
    many = found.filter("n > 1")
    total = many.agg(F.sum("n")).first()[0] or 0
    any_hot = not many.filter(F.col("n") > hot_size(total)).isEmpty()
    members = join_hot(rows, many, ["h1", "h2"], "n", total, any_hot=any_hot, hint="shuffle_hash")
    firsts = members.filter("id = first_id").select("h1", "h2", "n", *[F.col(f).alias(f"first_{f}") for f in fields])
    same = reduce(lambda a, b: a & b, [F.col(f) == F.col(f"first_{f}") for f in fields])
    joined = join_hot(members.drop("n"), firsts, ["h1", "h2"], "n", total, any_hot=any_hot, hint="shuffle_hash").withColumn("same", same)
    # only fields that differ are kept
    held = materialize(joined.select("id", "first_id", "same", *[F.when(~F.col("same"), F.col(f)).alias(f) for f in fields]), "facts")
    good = held.filter("same").select("id", "first_id").distinct().unionByName(lone)
    odd = held.filter("not same")
    if odd.isEmpty():
        return good
    # equal fingerprints of unequal records: group those by the fields themselves
    rest = odd.join(odd.groupBy(*fields).agg(F.min("id").alias("f")), fields).select("id", F.col("f").alias("first_id")).distinct()
    return good.unionByName(rest)


def fact_copies(df: DataFrame, id_col: str = "triple_seq", fields: tuple[str, ...] = ("subject", "predicate", "object"), raw: str | None = "raw") -> DataFrame:
    """(id, first_id): every usable record with the first record that states the same."""
    return _grouped(df, id_col, list(fields), raw)


def collapsed(df: DataFrame, id_col: str = "triple_seq", fields: tuple[str, ...] = ("subject", "predicate", "object"), raw: str | None = "raw") -> DataFrame:
    """(first_id, copies): one row per fact and how many records state it."""
    return fact_copies(df, id_col, fields, raw).groupBy("first_id").agg(F.count("*").alias("copies"))

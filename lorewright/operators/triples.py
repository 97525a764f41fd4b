"""Triples from model replies: prompts and batches, two reply parsers, cleaning before the store."""

from __future__ import annotations

import json
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewright.functions.scratch import written
from lorewright.functions.text import col, trim

FIELDS = ("subject", "predicate", "object")
TRIPLES = "array<struct<subject:string,predicate:string,object:string>>"


def reply_array(raw: Column | str) -> Column:
    """The JSON array in a model's reply: without a code fence, from the first [ to the last ]; null if there is none."""
    t = trim(raw)
    t = F.when(t.startswith("```"), F.regexp_replace(F.regexp_replace(t, r"\A```[^\n]*\n?", ""), r"```[\s]*\z", "")).otherwise(t)
    first = F.instr(t, "[")
    last = F.length(t) - F.instr(F.reverse(t), "]") + 1
    return F.when((first > 0) & (F.instr(t, "]") > 0) & (last > first), F.substring(t, first, last - first + 1))


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that later expressions refer to without its being computed again for each of them."""
    return df.withColumn(name, F.explode(F.array(value)))


def parsed(df: DataFrame, raw: str, out: str = "triples") -> DataFrame:
    """The triples of a reply: none without an array, null if the array is malformed or a field is no text; names may
    be in any letter case; triples with an empty field are dropped."""
    df = held(df, "_array", reply_array(raw))
    df = held(df, "_got", F.from_json("_array", "array<map<string,variant>>"))
    # of a name that is given twice, the last counts
    last = lambda m, f: F.get(F.reverse(F.filter(F.map_entries(m), lambda e: F.lower(e["key"]) == f)), F.lit(0))["value"]
    df = held(df, "_low", F.transform("_got", lambda m: F.struct(*[last(m, f).alias(f) for f in FIELDS])))
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    odd = F.exists("_low", lambda t: reduce(lambda a, b: a | b, [~kind(t[f]).isin("STRING", "VOID") for f in FIELDS]))
    flat = F.transform("_low", lambda t: F.struct(*[F.coalesce(F.variant_get(t[f], "$", "string"), F.lit("")).alias(f) for f in FIELDS]))
    full = lambda t: (t["subject"] != "") & (t["predicate"] != "") & (t["object"] != "")
    value = F.when(F.col("_array").isNull(), F.array().cast(TRIPLES)).when(F.col("_got").isNull() | odd, F.lit(None).cast(TRIPLES)).otherwise(F.filter(flat, full))
    return held(df, out, value).drop("_array", "_got", "_low")


def parse_strictly(raw: str | None) -> list[dict] | None:
    """The same with typed fields and names in any letter case: a field of another type spoils the array (None)."""
    t = (raw or "").strip()
    if t.startswith("```"):
        t = t.partition("\n")[2]
        t = t.rstrip().removesuffix("```")
    first, last = t.find("["), t.rfind("]")
    if first < 0 or last < first:
        return []
    try:
        items = json.loads(t[first : last + 1])
    except ValueError:
        return None
    out = []
    for item in items if isinstance(items, list) else [None]:
        if item is None:
            continue
        if not isinstance(item, dict):
            return None
        low = {str(k).lower(): v for k, v in item.items()}
        got = {f: low.get(f, "") for f in FIELDS}
        if any(v is not None and not isinstance(v, str) for v in got.values()):
            return None
        if all(got.values()):
            out.append(got)
    return out


def parse_replies(df: DataFrame, raw: str = "raw", impl: str = "native") -> DataFrame:
    """``df`` with ``triples`` and ``malformed``."""
    if impl == "native":
        out = parsed(df, raw)
    else:
        strict = F.udf(parse_strictly, TRIPLES, useArrow=True)
        out = df.withColumn("triples", strict(F.col(raw)))
    return out.withColumn("malformed", F.col("triples").isNull())


def exploded(df: DataFrame, order: str) -> DataFrame:
    """One row per triple with a number that keeps the order of replies and of triples within them."""
    rows = df.filter(~F.col("malformed")).select(order, F.posexplode("triples").alias("pos", "t"))
    return rows.select(order, "pos", *[F.col("t")[f].alias(f) for f in FIELDS])


def cleaned(df: DataFrame, seq: str = "triple_seq") -> DataFrame:
    """What the store keeps: rows without an empty field, trimmed, the first of equal triples."""
    for_store = df.filter(" and ".join(f"{f} is not null and {f} <> ''" for f in FIELDS)).select(seq, *[trim(f).alias(f) for f in FIELDS])
    return for_store.groupBy(*FIELDS).agg(F.min(seq).alias(seq)).select(seq, *FIELDS)


def extract(batches: DataFrame, extractor, attempts: int = 3) -> DataFrame:
    """(batch_id, triples, error, attempts): each batch text sent to a model, retried at once; a batch that fails is
    kept with its error and no triples, so a run never stops for it."""

    def work(it):
        model = extractor.start()
        for b in it:
            out = ([], [], [], [])
            for i, text in zip(b["batch_id"].to_pylist(), b["text"].to_pylist()):
                got, error, n = None, None, 0
                while got is None and n < attempts:
                    n += 1
                    try:
                        got = parse_strictly(model.triples(text))
                        error = None if got is not None else "malformed reply"
                    except Exception as e:
                        error = str(e)[:500]
                for c, v in zip(out, (i, got or [], error, n)):
                    c.append(v)
            kind = pa.list_(pa.struct([(f, pa.string()) for f in FIELDS]))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), kind, pa.string(), pa.int32()))], ["batch_id", "triples", "error", "attempts"])

    return batches.select("batch_id", "text").mapInArrow(work, f"batch_id long, triples {TRIPLES}, error string, attempts int")


def running_total(df: DataFrame, order: str, amount: str, name: str = "running_total") -> DataFrame:
    """A running sum over all rows in order, in two steps: within range partitions, then from the partitions before."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = written(df.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()), "running")
    w = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums = {r["_part"]: r["s"] for r in placed.groupBy("_part").agg(F.sum(amount).alias("s")).collect()}  # one row per partition
    rows, before = [], 0
    for p in sorted(sizes := sums):
        rows.append((p, before))
        before += sizes[p] or 0
    offsets = spark.createDataFrame(rows or [(0, 0)], "_part int, _before long")
    return placed.withColumn("_s", F.sum(amount).over(w)).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_s")).drop("_part", "_s", "_before")


def to_reply(subject: Column | str, predicate: Column | str, object_: Column | str) -> Column:
    return F.to_json(F.array(F.struct(col(subject).alias("subject"), col(predicate).alias("predicate"), col(object_).alias("object"))))

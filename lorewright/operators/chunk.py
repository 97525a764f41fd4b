"""Text splitting: fixed windows and sentence-aware packing, as expressions within a row (no shuffle)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewright.functions.scratch import written
from lorewright.functions.text import chunk_id, col, trim, unix_lines

SENTENCE_GAP = r"(?<=[.!?])(?=[ \n\t])"


class InvalidChunkSize(ValueError):
    pass


@dataclass(frozen=True)
class ChunkOptions:
    """Size and overlap in characters; an overlap out of range is mended, a size that is not positive is an error."""

    size: int = 1000
    overlap: int = 200

    def checked(self) -> ChunkOptions:
        if self.size <= 0:
            raise InvalidChunkSize(f"chunk size must be positive, not {self.size}")
        overlap = max(self.overlap, 0)
        return ChunkOptions(self.size, self.size // 4 if overlap >= self.size else overlap)

    @staticmethod
    def for_tokens(limit: int | None) -> ChunkOptions:
        """Options for an embedder's token limit: about four characters a token, a tenth kept free."""
        if not limit or limit <= 0:
            return ChunkOptions()
        size = max(200, int(limit * 4 * 0.9))
        return ChunkOptions(size, size // 5)


def size_for_tokens(limit: Column | str) -> Column:
    limit = col(limit)
    return F.when(limit.isNull() | (limit <= 0), F.lit(1000)).otherwise(F.greatest(F.lit(200), (limit * F.lit(4.0) * F.lit(0.9)).cast("int")))


def overlap_for_tokens(limit: Column | str) -> Column:
    limit = col(limit)
    return F.when(limit.isNull() | (limit <= 0), F.lit(200)).otherwise(F.floor(size_for_tokens(limit) / 5).cast("int"))


def windows(text: Column, o: ChunkOptions) -> Column:
    """Array of struct(index, content): windows of a text, trimmed; blank ones are left out but use up an index."""
    step = o.size - o.overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - o.size) / F.lit(step))).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("index"), trim(F.substring(text, i * step + 1, F.lit(o.size))).alias("content")))
    return F.filter(cut, lambda w: w["content"] != "")


def _named(df: DataFrame, source: str) -> DataFrame:
    return df.withColumn("id", chunk_id(F.col(source), F.col("index")))


def chunk_text(df: DataFrame, text: str = "text", source: str = "source", options: ChunkOptions | None = None) -> DataFrame:
    """One row per window: the columns of ``df`` without the text, then index, content and id."""
    o = (options or ChunkOptions()).checked()
    keep = [c for c in df.columns if c != text]
    out = df.select(*keep, F.inline(windows(unix_lines(text), o)))
    return _named(out, source)


def chunk_document(df: DataFrame, size: int, text: str = "text") -> DataFrame:
    """Windows with a fifth of overlap and ids without a source."""
    return chunk_text(df.withColumn("source", F.lit("")), text, "source", ChunkOptions(size, size // 5))


def sentences(text: Column | str) -> Column:
    """A break after a full stop, exclamation or question mark that white space follows; every character is kept."""
    return F.split(col(text), SENTENCE_GAP, -1)


def packed(text: Column, o: ChunkOptions) -> Column:
    """Array of chunk contents: paragraphs and sentences packed up to ``size`` bytes, longer sentences cut in windows."""
    paragraphs = F.filter(F.transform(F.split(text, "\n\n", -1), trim), lambda p: p != "")

    def fragments(p):
        whole = F.array(F.struct(F.lit(False).alias("flush"), F.lit(False).alias("hard"), p.alias("s")))
        cut = F.filter(F.transform(sentences(p), trim), lambda s: s != "")
        parts = F.transform(cut, lambda s, i: F.struct((i == 0).alias("flush"), (F.octet_length(s) > o.size).alias("hard"), s.alias("s")))
        return F.when(F.octet_length(p) <= o.size, whole).otherwise(parts)

    def emit(out, cur):
        return F.when(cur == "", out).otherwise(F.array_append(out, cur))

    def step(acc, f):
        out, cur, s = acc["out"], acc["cur"], f["s"]
        full = f["flush"] | ((F.octet_length(cur) + F.octet_length(s) + 2 > o.size) & (cur != ""))
        hard = F.struct(F.concat(emit(out, cur), windows(s, o)["content"]).alias("out"), F.lit("").alias("cur"))
        fresh = F.struct(emit(out, cur).alias("out"), s.alias("cur"))
        joined = F.struct(out.alias("out"), F.when(cur == "", s).otherwise(F.concat(cur, F.lit("\n\n"), s)).alias("cur"))
        return F.when(f["hard"], hard).when(full, fresh).otherwise(joined)

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))
    return F.aggregate(F.flatten(F.transform(paragraphs, fragments)), start, step, lambda a: emit(a["out"], a["cur"]))


def pack_text(text: str, o: ChunkOptions) -> list[str]:
    """The same packing in Python, for the Arrow path."""
    out: list[str] = []
    cur = ""
    step = o.size - o.overlap
    for p in filter(None, (x.strip() for x in text.replace("\r\n", "\n").split("\n\n"))):
        if len(p.encode()) <= o.size:
            parts = [(False, p)]
        else:
            parts = [(i == 0, s) for i, s in enumerate(filter(None, (x.strip() for x in re.split(SENTENCE_GAP, p))))]
        for flush, s in parts:
            n = len(s.encode())
            if flush or (cur and len(cur.encode()) + n + 2 > o.size):
                out += [cur] * bool(cur)
                cur = ""
            if n > o.size:
                out += [cur] * bool(cur)
                cur = ""
                count = max(0, -(-(len(s) - o.size) // step)) + 1
                out += [w for w in (s[i * step : i * step + o.size].strip() for i in range(count)) if w]
            else:
                cur = f"{cur}\n\n{s}" if cur else s
    return out + [cur] * bool(cur)


def split_by_sentence(df: DataFrame, text: str = "text", source: str = "source", options: ChunkOptions | None = None, impl: str = "native", on_invalid: str = "error") -> DataFrame:
    """One row per packed chunk: the columns of ``df`` without the text, then index, content and id.

    Text that is not valid UTF-8 is an error, or left out with ``on_invalid='skip'``."""
    o = (options or ChunkOptions()).checked()
    sound = F.is_valid_utf8(F.col(text))
    if on_invalid == "error":
        df = df.withColumn(text, F.when(F.col(text).isNull() | sound, F.col(text)).otherwise(F.raise_error(F.lit("text is not valid UTF-8")).cast("string")))
    else:
        df = df.filter(F.col(text).isNull() | sound)
    keep = [c for c in df.columns if c != text]
    if impl == "native":
        chunks = packed(unix_lines(text), o)
    else:
        split = F.udf(lambda s: None if s is None else pack_text(s, o), "array<string>", useArrow=True)
        chunks = split(F.col(text))
    out = df.select(*keep, F.posexplode(chunks).alias("index", "content"))
    return _named(out, source)


def with_sequence(df: DataFrame, order: list[str], name: str = "chunk_seq") -> DataFrame:
    """A dense number from 0 in the given order, without bringing all rows to one task: rows are range-partitioned,
    numbered within their partition, and shifted by the sizes of the partitions before (one small row each)."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = written(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "sequence")
    local = placed.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = {r["_part"]: r["count"] for r in placed.groupBy("_part").count().collect()}  # one row per partition
    before, rows = 0, []
    for p in sorted(sizes):
        rows.append((p, before))
        before += sizes[p]
    offsets = spark.createDataFrame(rows or [(0, 0)], "_part int, _before long")
    return local.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_n") - 1).drop("_part", "_n", "_before")


def batches_of(df: DataFrame, size: int = 10, seq: str = "chunk_seq", content: str = "content") -> DataFrame:
    """(batch_id, text): runs of consecutive chunks, each content followed by a blank line."""
    grouped = df.groupBy(F.floor(F.col(seq) / size).cast("long").alias("batch_id")).agg(F.array_sort(F.collect_list(F.struct(seq, content))).alias("c"))
    return grouped.select("batch_id", F.array_join(F.transform("c", lambda x: F.concat(x[content], F.lit("\n\n"))), "").alias("text"))


def head_sample(df: DataFrame, n: int = 3, content: str = "content", order: list[str] | None = None) -> DataFrame:
    """(text): the first chunks in the given order (that of their number), each followed by a blank line."""
    by = order or ["chunk_seq"]
    top = df.orderBy(*by).limit(n).agg(F.array_sort(F.collect_list(F.struct(*by, content))).alias("c"))
    return top.select(F.array_join(F.transform("c", lambda x: F.concat(x[content], F.lit("\n\n"))), "").alias("text"))

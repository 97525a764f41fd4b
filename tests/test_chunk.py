import random

import pytest
from pyspark.sql import functions as F

from lorewright.operators import chunk
from lorewright.operators.chunk import ChunkOptions, InvalidChunkSize


def cut(spark, text, size, overlap, impl="native", source="a.b c"):
    df = spark.createDataFrame([(text, source)], "text string, source string")
    return [r["content"] for r in chunk.split_by_sentence(df, options=ChunkOptions(size, overlap), impl=impl).orderBy("index").collect()]


def test_options():
    assert ChunkOptions.for_tokens(8192) == ChunkOptions(29491, 5898)
    assert ChunkOptions.for_tokens(0) == ChunkOptions.for_tokens(-1) == ChunkOptions(1000, 200)
    assert ChunkOptions.for_tokens(512) == ChunkOptions(1843, 368)
    assert ChunkOptions.for_tokens(10).size == 200
    assert ChunkOptions(100, 100).checked().overlap == 25
    assert ChunkOptions(100, -5).checked().overlap == 0
    with pytest.raises(InvalidChunkSize):
        ChunkOptions(0, 0).checked()


def test_option_columns(spark):
    df = spark.createDataFrame([(8192,), (0,), (-1,), (512,), (None,)], "n int").select(chunk.size_for_tokens("n").alias("s"), chunk.overlap_for_tokens("n").alias("o"))
    assert [tuple(r) for r in df.collect()] == [(29491, 5898), (1000, 200), (1000, 200), (1843, 368), (1000, 200)]


def windows(text, size, overlap):
    text = text.replace("\r\n", "\n")
    out, step, i = [], size - overlap, 0
    while text:
        w = text[i * step : i * step + size].strip()
        if w:
            out.append((i, w))
        if i * step + size >= len(text):
            break
        i += 1
    return out


@pytest.mark.parametrize("text", ["This is a simple test text", "", "Short", "x" * 95 + " " * 300 + "tail", "a\r\nb " * 40, "é" * 250, "   "])
def test_windows(spark, text):
    df = spark.createDataFrame([(text, "f.md")], "text string, source string")
    got = [(r["index"], r["content"]) for r in chunk.chunk_text(df, options=ChunkOptions(100, 20)).orderBy("index").collect()]
    assert got == windows(text, 100, 20)


def test_ids(spark):
    df = spark.createDataFrame([("one two", "a.b/c d\\e"), ("x", ""), ("y", None)], "text string, source string")
    assert sorted(r["id"] for r in chunk.chunk_text(df).collect()) == ["a_b_c_d_e_0", "chunk_0", "chunk_0"]


def test_oversized_paragraph(spark):
    got = cut(spark, "This is a sentence that will be repeated ok. " * 100, 500, 100)
    assert len(got) > 1 and all(len(c.encode()) <= 600 for c in got)


def test_line_ends(spark):
    got = cut(spark, "First paragraph.\r\n\r\nSecond paragraph.\r\n\r\nThird.", 100, 20)
    assert got == ["First paragraph.\n\nSecond paragraph.\n\nThird."]


def test_oversized_sentence(spark):
    got = cut(spark, "word " * 500, 300, 50)
    assert len(got) > 1 and all(len(c.encode()) <= 350 for c in got)


def test_mixed_sizes(spark):
    got = cut(spark, "Small.\n\n" + "This sentence has about forty characters. " * 50 + "\n\nAnother small one.", 500, 100)
    assert len(got) > 1 and all(len(c.encode()) <= 600 for c in got)
    assert got[0] == "Small."  # an oversized paragraph starts a chunk of its own
    assert got[-1].endswith("\n\nAnother small one.")  # but what follows may join its last sentences


def test_native_equals_arrow(spark):
    rnd = random.Random(5)
    parts = ["One.", "Two two! ", "Is it? ", "é" * 30, "\n\n", "\r\n\r\n", " ", "word " * 30, "...", "?! ", "a.b ", "\u3000", "\n", "x" * 90]
    texts = ["".join(rnd.choices(parts, k=rnd.randrange(40))) for _ in range(120)] + ["", " ", None]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "i int, text string, source string")
    rows = lambda impl: sorted(map(tuple, chunk.split_by_sentence(df, options=ChunkOptions(80, 15), impl=impl).select("i", "index", "content", "id").collect()))
    assert rows("native") == rows("arrow")


def test_invalid_utf8(spark):
    df = spark.sql("select cast(X'61FF' as string) as text, 's' as source")
    with pytest.raises(Exception, match="UTF-8"):
        chunk.split_by_sentence(df).collect()
    assert chunk.split_by_sentence(df, on_invalid="skip").count() == 0


def test_sequence_and_batches(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("content"))
    out = chunk.with_sequence(df, ["k"])
    rows = out.orderBy("k").collect()
    assert [r["chunk_seq"] for r in rows] == list(range(1000))
    b = {r["batch_id"]: r["text"] for r in chunk.batches_of(out).collect()}
    assert len(b) == 100 and b[3] == "".join(f"{r['content']}\n\n" for r in rows[30:40])
    assert chunk.head_sample(out).first()["text"] == "".join(f"{r['content']}\n\n" for r in rows[:3])
    assert chunk.with_sequence(df.limit(0), ["k"]).count() == 0

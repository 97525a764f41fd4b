"""Token ids of a whole corpus by a public byte-level BPE tokenizer, through a table of its distinct words.

Texts are split into words by the tokenizer's own pattern in Spark, once. Each distinct word is encoded once. The ids
come back by a join on the word: the most frequent words (a number with a fixed bound) are joined by broadcast, the
rest by shuffle, so a word that makes up a tenth of all text never lands in one task. Each token is one number (position
of the word, part within the word, id), so putting a text together is a sort of numbers; the fields are as wide as the
longest word and the largest id need, and a text with more words than the rest can count raises an error.

Defined cases: null and empty texts have an empty list of ids; strings that look like special tokens are ordinary
text; repeated rows give one row; very long texts are used whole; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.llm.common import materialize

TOKENIZERS = os.environ.get("LOREWRIGHT_TOKENIZERS", "/opt/tokenizers")
#: The split pattern of the byte-level vocabulary, as its publishers state it.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load(name: str, folder: str = TOKENIZERS):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{folder}/{name}.json")
    t.encode_special_tokens = True
    return t


def words_of(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, word): one row per word of a text."""
    pieces = F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))
    return docs.select("doc_id", F.posexplode(pieces).alias("pos", "word"))


def encoded(words: DataFrame, name: str, folder: str) -> DataFrame:
    """(word, n, ids): each distinct word encoded once."""

    def work(batches):
        t = load(name, folder)
        for b in batches:
            ids = [e.ids for e in t.encode_batch_fast(b["word"].to_pylist(), add_special_tokens=False)]  # without places
            yield pa.RecordBatch.from_arrays([b["word"], b["n"], pa.array(ids, pa.list_(pa.int32()))], ["word", "n", "ids"])

    return words.select("word", "n").mapInArrow(work, "word string, n long, ids array<int>")


def word_tables(df: DataFrame, name: str, folder: str, hot_words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(flat, table, hot) for a table (doc_id, text): the words of all texts (doc_id, pos, word), the distinct words
    (word, n, ids), and at most ``hot_words`` most frequent of them."""
    docs = df.select("doc_id", "text").filter("doc_id is not null and text is not null and text <> ''").dropDuplicates(["doc_id"])
    flat = materialize(words_of(docs), "token-words")
    table = materialize(encoded(flat.groupBy("word").agg(F.count("*").alias("n")), name, folder), "words")
    hot = materialize(table.orderBy(F.desc("n"), "word").limit(hot_words).select("word", "ids"), "hot-words")
    return flat, table, hot


def joined(flat: DataFrame, table: DataFrame, hot: DataFrame, *columns) -> tuple[DataFrame, DataFrame]:
    """The words of all texts with the ids of each, as the given columns: (those of hot words, the others)."""
    near = flat.join(F.broadcast(hot), "word", "left")
    rest = near.filter("ids is null").drop("ids")
    others = table.join(F.broadcast(hot.select("word")), "word", "left_anti").select("word", "ids")
    return near.filter("ids is not null").select(*columns), rest.join(others, "word").select(*columns)


def token_ids(df: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, hot_words: int = 50_000) -> DataFrame:
    """(doc_id, ids) for a table (doc_id, text). At most ``hot_words`` words are broadcast."""
    flat, table, hot = word_tables(df, name, folder, hot_words)
    widest = table.agg(F.max(F.size("ids")), F.max(F.array_max("ids"))).first()
    part, each = (max(int(x or 0), 1).bit_length() for x in widest)
    fits = F.when(F.col("pos") < 1 << min(62 - part - each, 31), F.col("pos").cast("long")).otherwise(F.raise_error(F.lit("a text has too many words for its longest word")).cast("long"))
    # part and id are packed once for each distinct word, most of which are one token
    codes = F.transform("ids", lambda t, i: F.shiftleft(i.cast("long"), each) + t).alias("ids")
    table, hot = table.select("word", "n", codes), materialize(hot.select("word", codes), "hot-codes")
    first = F.shiftleft("at", part + each)
    packed = F.when(F.size("ids") == 1, F.array(first + F.col("ids")[0])).otherwise(F.transform("ids", lambda t: first + t)).alias("t")
    # most words are hot: their rows are put together by text before anything is shuffled
    here, rare = joined(flat.select("doc_id", "word", fits.alias("at")), table, hot, "doc_id", packed)
    ids = here.unionByName(rare).groupBy("doc_id").agg(F.flatten(F.collect_list("t")).alias("t"))
    ids = ids.select("doc_id", F.transform(F.sort_array("t"), lambda x: x.bitwiseAND((1 << each) - 1).cast("int")).alias("ids"))
    nothing = df.filter("doc_id is not null and (text is null or text = '')").select("doc_id", F.array().cast("array<int>").alias("ids")).distinct()
    return ids.unionByName(nothing)


def token_numbers(df: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, hot_words: int = 50_000) -> DataFrame:
    """(doc_id, n_tokens) for a table (doc_id, text), from the table of distinct words; empty and null texts are left out."""
    flat, table, hot = word_tables(df, name, folder, hot_words)
    here, rare = joined(flat.select("doc_id", "word"), table, hot, "doc_id", F.size("ids").alias("m"))
    return here.unionByName(rare).groupBy("doc_id").agg(F.sum("m").alias("n_tokens"))


def pieces(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, piece): the vocabulary, each piece as its bytes; its size is that of the tokenizer."""
    vocabulary = load(name, folder).get_vocab(with_added_tokens=True)
    # byte-level vocabularies write each byte as a printable character: bytes that print stand for themselves
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    to_byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
    rows = [(i, bytearray(to_byte[c] for c in p)) for p, i in vocabulary.items() if all(c in to_byte for c in p)]
    return spark.createDataFrame(rows, "id int, piece binary")


def decoded(ids: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc_id, text) from (doc_id, ids), through the table of pieces; the vocabulary is a table of fixed size."""
    flat = ids.select("doc_id", F.posexplode("ids").alias("pos", "id")).join(F.broadcast(vocabulary), "id")
    parts = flat.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.hex("piece").alias("piece")))).alias("p"))
    joined = parts.select("doc_id", F.decode(F.unhex(F.array_join("p.piece", "")), "UTF-8").alias("text"))
    return ids.select("doc_id").join(joined, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

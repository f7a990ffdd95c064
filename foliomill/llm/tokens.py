"""Encoding of a corpus with a public byte-level BPE tokenizer by a table of distinct words.

Texts are split into words by the tokenizer's own pattern in the JVM. Each distinct word is encoded once, in Arrow batches; the
ids are joined back by word and put in order by position. Decoding joins ids with their pieces.

Skew. Words that make up at least HOT_SHARE of all occurrences number at most 1/HOT_SHARE, so their table has a proven bound and
is broadcast (words longer than HOT_CHARS never count as hot); it serves most occurrences without a shuffle. The other words
are joined by a shuffle in which no key can hold more than HOT_SHARE of the rows.

Defined cases. One row per doc_id, a null doc_id included; of several rows with one doc_id the greatest text counts (null last).
Null and empty texts have the empty list of ids, blank ones the ids of their white space. Special tokens in a text are ordinary text.
Only doc_id and text are read, so extra columns can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

HOT_SHARE = 1 / 20_000
HOT_CHARS = 64
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def _x(*ranges: str) -> str:
    return "".join("-".join(f"\\x{{{p}}}" for p in r.split("-")) for r in ranges)


# The White_Space property, which Java's own class lacks, and the published pattern of this vocabulary.
SPACE = _x("9-D", "20", "85", "A0", "1680", "2000-200A", "2028", "2029", "202F", "205F", "3000")
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)


def split_words(text: Column) -> Column:
    """The words of the tokenizer's pattern; together they are the text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN), F.lit(0))


def one_text_per_doc(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """key (never null), doc_id, text and the columns to keep; hash-partitioned by key for all that follows."""
    key = F.concat(F.when(F.col("doc_id").isNull(), F.lit("n")).otherwise(F.lit("v")), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    top = F.max(F.struct("text", *keep)).alias("top")
    return df.select(key.alias("key"), "doc_id", "text", *keep).groupBy("key").agg(F.first("doc_id").alias("doc_id"), top).select("key", "doc_id", "top.*")


def distinct_words(df: DataFrame) -> DataFrame:
    """word, n: every distinct word and how often it occurs."""
    return df.select(F.explode(split_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _encoder(tokenizer_json):
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(tokenizer_json.value)
        tok.encode_special_tokens = True
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                ids = [e.ids for e in tok.encode_batch(part["word"].tolist(), add_special_tokens=False)]
                yield pd.DataFrame({"word": part["word"], "n": part["n"], "ids": ids})

    return encode


def word_table(df: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """word, n, ids: each distinct word of the corpus encoded once, written to the shared folder."""
    spark = df.sparkSession
    text = spark.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))  # a vocabulary file, 1.5 MB
    words = distinct_words(df).repartition("word")  # of all rows, also those of a doc_id that another replaces: no text is shuffled for it
    return materialize(words.mapInPandas(_encoder(text), "word string, n long, ids array<int>"), "words")


def _hot_and_tail(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = (F.col("n") >= max(1.0, total * HOT_SHARE)) & (F.char_length("word") <= HOT_CHARS)
    return words.where(hot).drop("n"), words.where(~hot).drop("n")


def encode(df: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, ids."""
    docs = one_text_per_doc(df)
    hot, tail = _hot_and_tail(word_table(df, tokenizer))
    spread = docs.select("key", "doc_id", F.posexplode_outer(split_words(F.col("text"))).alias("pos", "word"))
    near = spread.join(F.broadcast(hot), "word", "left")
    placed = F.collect_list(F.when(F.col("ids").isNotNull(), F.struct("pos", "ids")))
    by_doc = near.groupBy("key").agg(F.first("doc_id").alias("doc_id"), placed.alias("near"))
    far = spread.join(F.broadcast(hot), "word", "left_anti").join(tail, "word").groupBy("key").agg(placed.alias("far"))
    both = by_doc.join(far, "key", "left")
    everything = F.concat("near", F.coalesce("far", F.array().cast("array<struct<pos:int,ids:array<int>>>")))
    return both.select("doc_id", F.flatten(F.transform(F.array_sort(everything), lambda x: x["ids"])).alias("ids"))


def count_tokens(df: DataFrame, tokenizer: str = TOKENIZER, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, tokens and the columns to keep: as many tokens as encode gives, without making the ids."""
    docs = one_text_per_doc(df, keep)
    words = word_table(df, tokenizer).select("word", "n", F.size("ids").alias("tokens"))
    hot, tail = _hot_and_tail(words)
    spread = docs.select("key", "doc_id", *keep, F.explode_outer(split_words(F.col("text"))).alias("word"))
    near = spread.join(F.broadcast(hot), "word", "left").groupBy("key").agg(*(F.first(c).alias(c) for c in ("doc_id", *keep)), F.sum("tokens").alias("near"))
    far = spread.join(F.broadcast(hot), "word", "left_anti").join(tail, "word").groupBy("key").agg(F.sum("tokens").alias("far"))
    none = F.lit(0).cast("long")
    return near.join(far, "key", "left").select("doc_id", *keep, (F.coalesce("near", none) + F.coalesce("far", none)).alias("tokens"))


def pieces(spark, tokenizer: str = TOKENIZER) -> DataFrame:
    """id, piece (hexadecimal bytes): the vocabulary, a table of fixed size."""
    import json

    vocab = json.loads(Path(tokenizer).read_text(encoding="utf-8"))["model"]["vocab"]
    # byte-level vocabularies write each byte as a printable character: the printable ones as themselves, the rest from 256 on
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    rows = [(i, bytes(byte_of[c] for c in piece).hex()) for piece, i in vocab.items() if all(c in byte_of for c in piece)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["id", "piece"]), "id int, piece string")


def decode(encoded: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, text from doc_id, ids: joins ids with pieces. One row per doc_id of the input, which must not repeat."""
    key = F.concat_ws(":", F.col("doc_id").isNull().cast("string"), F.col("doc_id").cast("string"))
    spread = encoded.select(key.alias("key"), "doc_id", F.posexplode_outer("ids").alias("pos", "id"))
    named = spread.join(F.broadcast(pieces(encoded.sparkSession, tokenizer)), "id", "left")  # bounded by the vocabulary
    parts = F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("pos", "piece")))
    rows = named.groupBy("key").agg(F.first("doc_id").alias("doc_id"), parts.alias("parts"))
    whole = F.array_join(F.transform(F.array_sort("parts"), lambda x: x["piece"]), "")
    return rows.select("doc_id", F.decode(F.unhex(whole), "UTF-8").alias("text"))

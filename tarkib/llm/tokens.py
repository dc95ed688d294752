"""Problem 7: token ids of a whole corpus by a public tokenizer.

Method: texts are split into words in Spark by the tokenizer's own pattern, each distinct word is encoded once,
and the ids come back to the texts by a join and the words' positions.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

TOKENIZERS = os.environ.get("TARKIB_TOKENIZERS", "/opt/tokenizers")
#: The pattern of the byte-level tokenizers, with Unicode white space for Java.
WORD = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Most distinct words that are broadcast, the commonest ones, with at most WORD_IDS ids each (some 40 MB); all others are
#: joined by a shuffle. The results are the same.
HEAD_WORDS = 200_000
WORD_IDS = 32


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


def vocabulary_path(name: str, folder: str = TOKENIZERS) -> str:
    return os.path.join(folder, f"{name}.tiktoken")


def keyed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, h, text) with one row for each id and text, placed by both."""
    return (
        df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
        .withColumn("h", F.xxhash64("text"))
        .dropDuplicates(["doc_id", "h"])
    )


def word_key(word: Column) -> list[Column]:
    """Two hashes that stand for a word in joins, however long it is."""
    return [F.xxhash64(word).alias("k1"), F.xxhash64(F.lit("again"), word).alias("k2")]


def word_table(words: DataFrame, path: str) -> DataFrame:
    """(k1, k2, n, ids): the key of each distinct word with its count and ids; ``words`` has a column ``word``."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = encoder(path).encode_ordinary
        for b in batches:
            yield b.assign(ids=[code(w) for w in b["word"]])

    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    return cut(counted.mapInPandas(encode, "word string, n long, ids array<int>").select(*word_key(F.col("word")), "n", "ids"))


def with_ids(words: DataFrame, known: DataFrame, head_words: int = HEAD_WORDS) -> list[DataFrame]:
    """``words`` (with k1, k2; NULL for no word) joined to its ids, in parts that make up the whole. The commonest words
    meet a broadcast table of bounded size; the rest is shuffled."""
    small = F.size("ids") <= WORD_IDS
    every = known.count()
    short = known.where(small)
    head = short if every <= head_words else short.orderBy(F.desc("n"), "k1", "k2").limit(head_words)
    head = cut(head.select("k1", "k2", "ids"))
    hit = words.join(F.broadcast(head), ["k1", "k2"], "left")
    if head.count() == every:
        return [hit]
    missing = hit.where("ids IS NULL AND k1 IS NOT NULL").drop("ids")
    tail = known.select("k1", "k2", "ids").join(F.broadcast(head.select("k1", "k2")), ["k1", "k2"], "left_anti")
    return [hit.where("ids IS NOT NULL OR k1 IS NULL"), missing.join(tail, ["k1", "k2"], "left").select(*hit.columns)]


def _split(docs: DataFrame) -> DataFrame:
    """(doc_id, h, pos, k1, k2) of the words of texts; one row without a word for a text that has none."""
    found = docs.select("doc_id", "h", F.posexplode_outer(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("pos", "word"))
    key = [F.when(F.col("word").isNotNull(), k).alias(n) for k, n in zip(word_key(F.col("word")), ("k1", "k2"), strict=True)]
    return found.select("doc_id", "h", "pos", *key)


def encode_corpus(df: DataFrame, doc_id: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS, head_words: int = HEAD_WORDS) -> DataFrame:
    """(doc_id, ids): token ids of every text without special tokens; strings that spell a special token are
    ordinary text. Empty and NULL texts get an empty list. One row for each id and text (repeated rows are one
    row; rows that share an id but not the text stay apart; a NULL id stays NULL). Other columns are left out."""
    docs = keyed(df, doc_id, text)
    every = df.select(F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(WORD), F.lit(0))).alias("word"))
    known = word_table(every, vocabulary_path(name, folder))
    words = _split(docs)
    parts = with_ids(words, known, head_words)
    placed = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    ids = placed.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("w"))
    return ids.select("doc_id", F.flatten(F.transform("w", lambda x: F.coalesce(x["ids"], F.array().cast("array<int>")))).alias("ids"))


def token_counts(df: DataFrame, doc_id: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, h, tokens) by the same word table, summed map-side."""
    docs = keyed(df, doc_id, text)
    every = docs.select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("word"))
    known = word_table(every, vocabulary_path(name, folder))
    out = None
    for part in with_ids(_split(docs), known):
        got = part.groupBy("doc_id", "h").agg(F.sum(F.when(F.col("ids").isNotNull(), F.size("ids")).otherwise(0)).alias("tokens"))
        out = got if out is None else out.unionByName(got).groupBy("doc_id", "h").agg(F.sum("tokens").alias("tokens"))
    return out


def piece_table(spark, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, piece): the tokenizer's pieces in hex; as many rows as the vocabulary has."""
    return spark.createDataFrame(pd.DataFrame([(i, b.hex()) for b, i in ranks(vocabulary_path(name, folder)).items()], columns=["id", "piece"]), "id int, piece string")


def decode_corpus(encoded: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, h, text) of (doc_id, h, ids) by an id-to-piece join; an empty list gives ''."""
    spark = encoded.sparkSession
    flat = encoded.select("doc_id", "h", F.posexplode_outer("ids").alias("pos", "id"))
    flat = flat.join(F.broadcast(piece_table(spark, name, folder)), "id", "left")
    got = flat.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("w"))
    return got.select("doc_id", "h", F.unhex(F.concat_ws("", F.transform("w", lambda x: F.coalesce(x["piece"], F.lit(""))))).cast("string").alias("text"))

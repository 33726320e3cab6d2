"""Token counts of whole texts with a digest cache.

The cache is a table of (content, tokenizer, n_tokens): content is the SHA-256 of a text (null as the empty text),
tokenizer that of the vocabulary file's version. Texts are joined with it by both digests; only distinct texts that it
lacks are encoded, and their counts are appended. Copies of a text are encoded once.

Inside a task the library sees each distinct piece of the texts once (see pieces.py).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path
from .pieces import Memory

_LOADED: dict[str, tuple] = {}


def tokenizer_digest(path: str) -> str:
    """SHA-256 of the vocabulary file: another version is another key."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _load(path: str) -> tuple:
    """(what counts the tokens of a list of texts, memory of pieces or None where pieces don't add up)."""
    if path not in _LOADED:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[path] = (lambda texts: list(map(len, model.encode(texts, num_threads=1))), None)
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer, pre_tokenizers

            model = Tokenizer.from_file(path)
            model.no_padding()
            model.no_truncation()
            count = lambda texts: list(map(len, model.encode_batch_fast(texts, add_special_tokens=False)))
            special = model.get_added_tokens_decoder().values()
            adds_up = isinstance(model.pre_tokenizer, pre_tokenizers.ByteLevel) and model.normalizer is None and not any(" " in t.content or t.lstrip or t.rstrip for t in special)
            _LOADED[path] = (count, Memory(count, sum) if adds_up else None)
    return _LOADED[path]


def count_tokens(texts: list[str], path: str) -> list[int]:
    count, memory = _load(path)
    return memory.values(texts) if memory else count(texts)


def cached_counts(docs: DataFrame, path: str, cache: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row of docs; counts that the Parquet table at cache lacked are appended to it.

    Null texts count as empty: 0 bytes, 0 tokens. Null ids and repeated rows are kept. Other columns are not read.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    content = F.unhex(F.sha2(text, 256))
    schema = "content binary, tokenizer string, n_tokens long"
    spark.createDataFrame([], schema).write.mode("append").parquet(cache)  # the table exists from now on
    stored = spark.read.schema(schema).parquet(cache).where(F.col("tokenizer") == version).dropDuplicates(["content"]).select("content", "n_tokens")
    misses = docs.select(content.alias("content"), text.alias("text")).groupBy("content").agg(F.first("text").alias("text")).join(stored.select("content"), "content", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                n = pa.array(count_tokens(part["text"].to_pylist(), path), pa.int64())
                yield pa.RecordBatch.from_arrays([part["content"], pa.array([version] * part.num_rows), n], ["content", "tokenizer", "n_tokens"])

    misses.mapInArrow(encode, schema).write.mode("append").parquet(cache)
    counts = spark.read.schema(schema).parquet(cache).where(F.col("tokenizer") == version).dropDuplicates(["content"])
    keys = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), content.alias("__content"))
    return keys.join(counts.select(F.col("content").alias("__content"), "n_tokens"), "__content").select(id_col, "n_bytes", "n_tokens")


def new_cache(spark: SparkSession) -> str:
    return fresh_path(spark, "token-cache")

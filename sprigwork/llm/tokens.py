"""Token counts with a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sprigwork.session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary splits a text before its merges.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def shipped(spark: SparkSession, vocabulary: str) -> str:
    """Send the vocabulary file of the driver to all workers; returns the name under which counter() finds it there."""
    spark.sparkContext.addFile(vocabulary)
    return os.path.basename(vocabulary)


@lru_cache(maxsize=2)
def counter(name: str) -> Callable[[str], int]:
    """Number of tokens of a text, by a vocabulary that was shipped."""
    import tiktoken

    with open(SparkFiles.get(name), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
    encoding = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def count_tokens(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, n_tokens); null and empty texts have 0."""

    name = shipped(documents.sparkSession, vocabulary)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(name)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([count(t) if t else 0 for t in batch.column(1).to_pylist()], pa.int64())], names=["doc_id", "n_tokens"])

    return spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(apply, "doc_id bigint, n_tokens bigint")

"""Sizes of texts in tokens of a public tokenizer.

The vocabulary file is a parameter; nothing is downloaded. Each Python worker reads it once.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

VOCABULARY = os.environ.get("GLEANERY_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: how the byte-level vocabulary's tokenizer splits a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(documents: DataFrame, key: str, text: str, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """key, the columns of `keep`, and `tokens` (0 for a null or empty text)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = encoding(vocabulary)
        for pdf in batches:
            yield pdf[[key, *keep]].assign(tokens=[len(codec.encode_ordinary(t)) if isinstance(t, str) else 0 for t in pdf["_text"]])

    narrow = documents.select(key, *keep, F.col(text).alias("_text"))
    schema = narrow.drop("_text").withColumn("tokens", F.lit(0).cast("long")).schema
    return narrow.mapInPandas(count, schema)

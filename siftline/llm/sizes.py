"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Byte-level BPE ranks; a parameter, read on the driver and sent along (the vocabulary has a fixed 50,256 entries).
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how byte-level BPE of this vocabulary parts a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def with_sizes(df: DataFrame, text: str, out: str = "n_tokens", tokenizer: str = TOKENIZER) -> DataFrame:
    """Adds `out`, the tokens of the whole text; null and empty texts have none."""
    shared = df.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        coder = tiktoken.Encoding("sizes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            yield pd.Series([len(coder.encode_ordinary(t)) if isinstance(t, str) and t else 0 for t in batch], dtype="int64")

    return df.withColumn(out, count(F.col(f"`{text}`")))

"""Sizes of texts in tokens of a public tokenizer; its file is a parameter and is never copied."""

from __future__ import annotations

import base64
import os

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_FOLDER = "/opt/tokenizers"
DEFAULT_FILE = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that splits text ahead of the merges of rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load(path: str):
    """An encoder with ``encode_ordinary`` for a rank file."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    return tiktoken.Encoding("quire", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str | None = None) -> Column:
    """Tokens of a text as int; null counts as 0. A narrow Arrow UDF; each worker loads the file once."""
    where = path or os.path.join(DEFAULT_FOLDER, DEFAULT_FILE)
    made: list = []

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(load(where))
        return pd.Series([len(made[0].encode_ordinary(t)) if t else 0 for t in texts], dtype="int32")

    # not deterministic for the optimizer only: else a generator over the result makes it run the function again in filters
    return count.asNondeterministic()(text)

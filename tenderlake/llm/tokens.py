"""Sizes of texts in tokens of a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Setting of a session that names the vocabulary file, and the path without it; the file is present there on every executor.
SETTING = "tenderlake.vocabulary"
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str = VOCABULARY) -> int:
    return len(encoder(path).encode_ordinary(text)) if text else 0


def n_tokens(text: Column, path: str | None = None) -> Column:
    """Tokens of a text by the vocabulary at ``path`` (else that of SETTING); 0 for null and empty texts."""
    session = SparkSession.getActiveSession()
    path = path or (session.conf.get(SETTING, None) if session else None) or VOCABULARY

    @F.pandas_udf("bigint")
    def sizes(texts: pd.Series) -> pd.Series:
        encode = encoder(path).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return sizes(text)

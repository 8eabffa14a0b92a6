"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import os
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_rows

#: The vocabulary: base64 tokens and ranks, one a line. Any file of this form serves.
VOCABULARY = os.environ.get("PALIMPSEST_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the pattern that cuts a text before the vocabulary's merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    import base64

    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("palimpsest", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, text: str, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """The kept columns with `tokens`, the length of the text in tokens; 0 for null and empty texts."""
    types = dict(documents.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in keep) + ", tokens int"

    def one(value, *rest):
        yield (*rest, len(encoder(vocabulary).encode_ordinary(value)) if value else 0)

    return map_rows(documents.select(F.col(text).alias("__text"), *keep), schema, one)

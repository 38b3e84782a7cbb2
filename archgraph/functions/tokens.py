"""Token counts of texts."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_count(text: Column, vocabulary: str) -> Column:
    """The number of tokens by a vocabulary file that every executor can read; null stays null, special tokens are not added."""

    @F.pandas_udf("long")
    def count(s: pd.Series) -> pd.Series:
        said = s.notna()
        sizes = [len(e.ids) for e in _tokenizer(vocabulary).encode_batch(s[said].tolist(), add_special_tokens=False)]
        return pd.Series(sizes, index=s.index[said], dtype="Int64").reindex(s.index)

    return count(text)

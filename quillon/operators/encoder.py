"""Text embeddings as the mean of token vectors.

The default token vector is made of the 16 bytes of the token's md5, scaled to [-1, 1]. A model can
be plugged in instead (``encode_with``).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.scalars import word_tokens

DIMENSIONS = 16
_WORDS = [(1, 12, 6), (13, 12, 6), (25, 8, 4)]  # first hex digit, hex digits, bytes


def _token_words(token: Column) -> list[Column]:
    """The md5 of a token as three whole numbers of six, six and four bytes."""
    digest = F.md5(token)
    return [F.conv(F.substring(digest, first, length), 16, 10).cast("bigint")
            for first, length, _ in _WORDS]


def token_bytes(token: Column) -> list[Column]:
    """The md5 bytes of a token as 16 whole numbers, from three conversions."""
    out = []
    for word, (_, _, count) in zip(_token_words(token), _WORDS):
        out += [F.shiftright(word, 8 * (count - 1 - i)).bitwiseAND(255) for i in range(count)]
    return out


def _scaled(mean_byte: Column) -> Column:
    return F.coalesce((mean_byte - 127.5) / 127.5, F.lit(0.0))


def embed_texts(df: DataFrame, key: str, text: str, max_tokens: int | None = None) -> DataFrame:
    """``(key, embedding)`` for a table of texts of any length.

    Tokens are summed where the text lies; one row of 16 sums per text is shuffled. ``max_tokens``
    gives the cut of an encoder with a bounded input; without it the whole text counts.
    """
    tokens = word_tokens(F.col(text))
    if max_tokens is not None:
        tokens = F.slice(tokens, 1, max_tokens)
    numbers = (df.select(key, F.explode_outer(tokens).alias("token"))
               .select(key, *[b.alias(f"b{i}") for i, b in enumerate(token_bytes(F.col("token")))]))
    means = numbers.groupBy(key).agg(*[F.avg(f"b{i}").alias(f"b{i}") for i in range(DIMENSIONS)])
    return means.select(key, F.array(*[_scaled(F.col(f"b{i}")) for i in range(DIMENSIONS)])
                        .alias("embedding"))


def embed_column(text: Column) -> Column:
    """The same embedding within the row, for short texts and streams.

    A token becomes three whole numbers of its digest's bytes once; the bytes' sums and the count then
    grow along the tokens in one pass, so a text is split once.
    """
    words = F.transform(word_tokens(text), lambda t: F.array(*_token_words(t)))
    zeros = F.array(*[F.lit(0).cast("bigint")] * (DIMENSIONS + 1))

    def add(sums: Column, word: Column) -> Column:
        places = [(w, 8 * (count - 1 - i)) for w, (_, _, count) in enumerate(_WORDS)
                  for i in range(count)]
        return F.array(*[sums[i] + F.shiftright(word[w], shift).bitwiseAND(255)
                         for i, (w, shift) in enumerate(places)], sums[DIMENSIONS] + 1)

    def means(state: Column) -> Column:
        count = state[DIMENSIONS]
        return F.transform(F.slice(state, 1, DIMENSIONS),
                           lambda s: _scaled(F.when(count > 0, s / count)))

    return F.aggregate(words, zeros, add, means)


def encode_with(encode: Callable[[list[str]], np.ndarray]):
    """An Arrow-batched column function around any encoder ``texts -> rows x dimensions``."""

    @F.pandas_udf("array<float>")
    def encoded(texts: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(encode(texts.tolist()), dtype=np.float32)))

    return encoded

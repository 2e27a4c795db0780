"""Sizes of texts in tokens of a public tokenizer; the vocabulary's path is a parameter."""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the public vocabularies lie: the package that brings them if it is installed, else the documented folder.
_spec = importlib.util.find_spec("public_tokenizers")
DEFAULT_VOCABULARY = os.path.join(
    _spec.submodule_search_locations[0] if _spec and _spec.submodule_search_locations else "/opt/tokenizers", "byte_bpe_50k.tiktoken",
)
#: Fixed value: the published pattern that cuts text into words for this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that are encoded at once. A longer text is cut where a blank follows a letter or digit, where the pattern cuts as well.
PIECE = 1 << 16


@lru_cache(maxsize=2)
def encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("tripleloom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE:
        cut = text.rfind(" ", at + 1, at + PIECE)
        while cut > at and not (text[cut - 1].isalnum() and cut + 1 < len(text) and text[cut + 1].isalnum()):
            cut = text.rfind(" ", at + 1, cut)
        if cut <= at:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def count_tokens(text: str, vocabulary: str) -> int:
    e = encoding(vocabulary)
    return sum(len(e.encode_ordinary(p)) for p in _pieces(text))


def with_tokens(df: DataFrame, text: str, keep: list[str], vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``keep`` and n_tokens (int), the tokens of the whole text; null and empty texts have 0."""

    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("n_tokens", T.IntegerType())])

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["n_tokens"] = [count_tokens(t, vocabulary) if t else 0 for t in f.pop("_text")]
            yield f

    return df.select(*keep, F.col(text).alias("_text")).mapInPandas(scan, schema)

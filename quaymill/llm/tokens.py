"""Sizes of texts in tokens of a public byte-pair vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymill.llm.quality import letter_tokens, prose_weight

#: A file of ranks: base64 token and rank per line.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Splits a text before the merges of the vocabulary. A fixed value of these rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoding(path: str):
    """The tokenizer of ``path``, kept in the library's registry: loaded once in a Python worker, which outlives its tasks."""
    import tiktoken
    from tiktoken.registry import ENCODINGS

    name = f"ranks:{path}"
    if name not in ENCODINGS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        ENCODINGS[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return ENCODINGS[name]


_letters: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def with_tokens(df: DataFrame, text: str, keep: list, vocabulary: str = VOCABULARY, weight: bool = False) -> DataFrame:
    """``keep`` and ``tokens`` (int), the size of the whole ``text``; null and empty texts have 0. ``weight`` adds how much prose it holds, from
    the same tokens."""

    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        e = encoding(vocabulary)
        if weight and vocabulary not in _letters:
            _letters[vocabulary] = letter_tokens([e.decode_single_token_bytes(i) for i in range(e.n_vocab)])
        for b in batches:
            sizes, weights = [], []
            for t in b:
                ids = e.encode_ordinary(t) if t else []
                sizes.append(len(ids))
                if weight:
                    weights.append(prose_weight(np.array(ids, np.int64), t or "", *_letters[vocabulary]))
            yield pd.DataFrame({"tokens": np.array(sizes, np.int32)} | ({"weight": weights} if weight else {}))

    found = F.pandas_udf(counted, "tokens int" + (", weight double" if weight else ""))(F.col(text)).alias("found")
    return df.select(*keep, found).select("*", "found.*").drop("found")

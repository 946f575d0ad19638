"""Token counts by a public tokenizer whose file is named by the caller."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.storage import spread

#: Where the vocabulary files lie unless the caller says otherwise; every executor must see the folder.
TOKENIZER_DIR = os.environ.get("FLUXLOOM_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = "byte_bpe_50k.json"

_loaded: dict = {}


def tokenizer(path: str):
    """The tokenizer of a ``tokenizers`` file, loaded once a worker; special strings in a text are ordinary text."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
        _loaded[path].encode_special_tokens = True
    return _loaded[path]


def with_token_counts(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(``key``, ``n_tokens``) of every row with a text; an empty text has 0 tokens, a null text no row."""
    at = path or f"{TOKENIZER_DIR}/{TOKENIZER}"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer(at)
        for batch in batches:
            texts = batch["_t"].tolist()
            sizes = [len(e.ids) for i in range(0, len(texts), 256) for e in t.encode_batch_fast(texts[i : i + 256], add_special_tokens=False)]
            yield pd.DataFrame({key: batch["_k"], "n_tokens": sizes})

    rows = spread(df.where(F.col(text).isNotNull()).select(F.col(key).alias("_k"), F.col(text).alias("_t")))
    return rows.mapInPandas(count, f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens int")

"""Text to vector, behind a registry of embedders.

The hashed bag of words shipped as the default needs no model and no Python
worker. It is a stand-in, not an encoder: its scores say nothing about those of
a trained model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.columns import with_evaluated
from newsloom.functions.text import terms
from newsloom.session import ship_package

DEFAULT_DIM = 64


@dataclass(frozen=True)
class Embedder:
    """``embed(rows, text_column, vector_column)`` adds an ``array<float>`` of length ``dim``."""

    name: str
    dim: int
    embed: Callable[[DataFrame, str, str], DataFrame]


def term_buckets(text: Column, dim: int, seed: str = "") -> Column:
    """The bucket of each term: the first 32 bits of its md5, modulo ``dim``."""

    def bucket(term: Column) -> Column:
        digest = F.md5(F.concat(F.lit(seed), term).cast("binary"))
        return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(dim))

    return F.transform(terms(text), bucket)


def hashed_embedder(dim: int = DEFAULT_DIM, seed: str = "", name: str = "hashed") -> Embedder:
    """Term counts per bucket, counted by Spark's own vocabulary counter."""

    def embed(rows: DataFrame, text: str, vector: str) -> DataFrame:
        counter = CountVectorizerModel.from_vocabulary(
            [str(b) for b in range(dim)], inputCol="_buckets", outputCol="_counts"
        )
        buckets = term_buckets(F.col(text), dim, seed).cast("array<string>")
        counted = counter.transform(rows.withColumn("_buckets", F.coalesce(buckets, F.array().cast("array<string>"))))
        return with_evaluated(counted, vector, vector_to_array("_counts", "float32")).drop("_buckets", "_counts")

    return Embedder(name, dim, embed)


# One entry per Python worker process, so that a model outlives the task that loaded it.
_loaded: dict[str, Any] = {}


def once_per_worker(name: str, load: Callable[[], Any]) -> Any:
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def model_embedder(name: str, dim: int, load: Callable[[], Callable[[list[str]], Any]]) -> Embedder:
    """Host a user's encoder: ``load()`` returns a function from texts to vectors.

    It is loaded once per Python worker under its name and called once per Arrow
    batch. Null texts get null vectors.
    """

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = once_per_worker(f"embedder:{name}", load)
        for texts in batches:
            given = texts.notna()
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            if given.any():
                vectors = encoder(texts[given].tolist())
                for position, v in zip(texts.index[given], vectors):
                    out[position] = [float(x) for x in v]
            yield out

    def embed(rows: DataFrame, text: str, vector: str) -> DataFrame:
        ship_package(rows.sparkSession)
        return rows.withColumn(vector, encode(F.col(text)))

    return Embedder(name, dim, embed)


_embedders: dict[str, Embedder] = {}


def register_embedder(embedder: Embedder) -> None:
    _embedders[embedder.name] = embedder


def get_embedder(name: str = "hashed") -> Embedder:
    if name not in _embedders:
        raise KeyError(f"no embedder named {name!r}; known: {sorted(_embedders)}")
    return _embedders[name]


register_embedder(hashed_embedder())
register_embedder(hashed_embedder(dim=96, seed="b:", name="hashed-b"))

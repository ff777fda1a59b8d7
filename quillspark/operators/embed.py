"""Embedders and the stored vector index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EMBEDDING_MODELS
from ..functions.vectors import dot

Embedder = Callable[[list[str]], np.ndarray]
_loaders: dict[str, Callable[[], Embedder]] = {}
_loaded: dict[str, Embedder] = {}


def model_id(name: str = "bge-base") -> str:
    """The model behind a short name; other names stand for themselves."""
    return EMBEDDING_MODELS.get(name, name)


def register(name: str, load: Callable[[], Embedder]) -> None:
    _loaders[model_id(name)] = load


def hashing_embedder(dim: int = 64) -> Embedder:
    """Deterministic unit vectors of hashed words: the stand-in where no model is at hand."""
    import xxhash

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, t in zip(out, texts, strict=True):
            for w in (t or "").lower().split():
                h = xxhash.xxh3_64_intdigest(w)
                row[h % dim] += 1.0 if h >> 63 else -1.0
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size > 0, size, 1.0)

    return embed


def embedder(name: str, load: Callable[[], Embedder] | None = None) -> Embedder:
    """Loaded once per Python worker."""
    key = model_id(name)
    if key not in _loaded:
        _loaded[key] = (load or _loaders.get(key) or hashing_embedder)()
    return _loaded[key]


def embed(df: DataFrame, text_col: str = "text", model: str = "bge-base", out_col: str = "embedding") -> DataFrame:
    """Adds a vector column; an iterator function, so that each worker loads the model once."""
    load = _loaders.get(model_id(model))

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = embedder(model, load)
        for texts in batches:
            yield pd.Series(list(own(texts.fillna("").tolist()).astype("float32")))

    return df.withColumn(out_col, vectors(F.col(text_col)))


def build_index(df: DataFrame, path: str | None = None, vector_col: str = "embedding", model: str = "bge-base") -> DataFrame:
    """The exact index: rows with vectors of one dimension, stored if a path is given. Mixed dimensions are an error."""
    sizes = df.select(F.size(vector_col).alias("d")).agg(F.min("d"), F.max("d")).first()
    if sizes[0] != sizes[1]:
        raise ValueError(f"vectors of different dimensions: {sizes[0]} to {sizes[1]}")
    if path is None:
        return df
    df.write.mode("overwrite").parquet(path)
    df.sparkSession.createDataFrame([(vector_col, sizes[0], model_id(model))], "vector_col string, dim int, model string").coalesce(1).write.mode("overwrite").json(manifest_of(path))
    return load_index(df.sparkSession, path, model)


def manifest_of(path: str) -> str:
    return f"{path.rstrip('/')}-manifest"


def load_index(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """A stored index. One that was built for another model than the given one, or lacks its vectors, is an error."""
    told = spark.read.schema("vector_col string, dim int, model string").json(manifest_of(path)).first()
    if model is not None and told.model != model_id(model):
        raise ValueError(f"{path} holds vectors of {told.model}, not of {model_id(model)}")
    df = spark.read.parquet(path)
    if told.vector_col not in df.columns:
        raise ValueError(f"no vectors in {path}")
    return df


def inner_product(df: DataFrame, a: str, b: str, name: str = "score") -> DataFrame:
    return df.withColumn(name, dot(F.col(a), F.col(b)))

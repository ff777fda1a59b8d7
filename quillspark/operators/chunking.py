"""Chunking by tokens and sentences.

Tokens are the words between white space: a deterministic stand-in for a model's tokeniser.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ChunkConfig
from ..functions.text import words


def fixed_chunks(text: Column, size: int = 512, overlap: int = 64) -> Column:
    """Windows of `size` words, each `overlap` words into the one before; the last one reaches the end."""

    def cut(all_: Column) -> Column:  # a lambda's argument: the words are split once and not once a chunk
        n = F.size(all_)
        starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))
        return F.when(n > 0, F.transform(starts, lambda i: F.array_join(F.slice(all_, i + 1, F.lit(size)), " "))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(F.array(words(text)), cut))


def sentence_chunks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 512, overlap: int = 64) -> DataFrame:
    """Chunks of whole sentences of up to `size` words; the next chunk repeats the last sentences of up to `overlap`
    words; a longer sentence is cut into windows."""
    import re

    boundary = re.compile(r"(?<=[.!?])\s+")

    def pieces(text: str) -> list[str]:
        parts: list[list[str]] = []
        for s in boundary.split(text):
            w = s.split()
            parts += [w[i : i + size] for i in range(0, len(w), size)]
        out, now = [], []
        for p in parts:
            if now and sum(map(len, now)) + len(p) > size:
                out.append(now)
                keep: list[list[str]] = []
                for q in reversed(now):
                    if sum(map(len, keep)) + len(q) > overlap or sum(map(len, keep)) + len(q) + len(p) > size:
                        break
                    keep.insert(0, q)
                now = keep
            now = [*now, p]
        return [" ".join(" ".join(p) for p in c) for c in ([*out, now] if now else out)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(i, k, c) for i, t in zip(pdf["id"], pdf["text"], strict=True) for k, c in enumerate(pieces(t or ""))]
            yield pd.DataFrame(got, columns=[id_col, "chunk_idx", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"{id_col} {kind}, chunk_idx int, text string")


def build_chunks(df: DataFrame, config: ChunkConfig = ChunkConfig(), id_col: str = "doc_id") -> DataFrame:
    """Chunk rows by the configured strategy; any other than `fixed` and `sentence` is an error."""
    if config.strategy == "fixed":
        return df.select(id_col, F.posexplode(fixed_chunks(F.col("text"), config.chunk_size, config.chunk_overlap)).alias("chunk_idx", "text"))
    if config.strategy == "sentence":
        return sentence_chunks(df, id_col, "text", config.chunk_size, config.chunk_overlap)
    raise ValueError(f"unknown chunking strategy: {config.strategy}")


def zip_metadata(texts: Column, metadata: Column) -> Column:
    """Texts with their metadata by position. Fewer metadata cut the texts off; none at all means no metadata."""
    n = F.size(metadata)
    some = F.slice(texts, 1, F.least(F.size(texts), F.greatest(n, F.lit(1))))
    with_ = F.zip_with(some, F.slice(metadata, 1, F.greatest(F.size(some), F.lit(1))), lambda t, m: F.struct(t.alias("text"), m.alias("meta")))
    without = F.transform(texts, lambda t: F.struct(t.alias("text"), F.lit(None).cast("string").alias("meta")))
    return F.when(n > 0, with_).otherwise(without)

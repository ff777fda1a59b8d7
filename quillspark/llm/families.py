"""All labelled texts that may be learnt from, one of each family of near copies.

Nothing is sampled: every text of a label that is not held out takes part, whatever its length and number. Equal texts
of a class count once. Each hash in the sketch of a text (its smallest shingle hashes) belongs to the first text of the
class, by a hash of the text, that has it; a text that has `common` hashes of one other text is that text's copy and is
left out, since a family's chance words would else look like marks of its label. Work is linear in the texts: a text
is held against the owners of its own hashes only.

Edge cases: null ids and null texts take no part; the empty text is a text; an id with both labels counts in both.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Workspace, broadcast_below, combine, map_texts, run_hashes, runs
from .samples import held_out


def sketches(data: np.ndarray, off: np.ndarray, width: int = 5, keep: int = 16) -> list[np.ndarray]:
    """Of each text the smallest `keep` hashes of its shingles; a shorter text is one shingle."""
    starts, ends, text = runs(data, off, SPACES)
    words = run_hashes(data, starts, ends, fold=True)
    windows, edge = combine(words, width), np.searchsorted(text, np.arange(len(off))).tolist()
    return [np.unique(windows[a : b - width + 1] if b - a >= width else combine(words[a:b], b - a))[:keep] for a, b in zip(edge[:-1], edge[1:], strict=True)]


def labelled_families(space: Workspace, docs: DataFrame, labels: DataFrame, label: str, common: int = 4, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Texts of label 0 and of label 1, in a column `text`; the tables lie in the given workspace."""
    known = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label).alias("label")).where(~held_out("id") & F.col("label").isin(0, 1)).distinct()
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where(F.col("text").isNotNull())
    texts = rows.join(broadcast_below(known, known.count()), "id").select("label", "text").distinct()
    # a hash of the text whose last bit is the label
    key = F.xxhash64("text").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("label").cast("bigint"))
    texts = space.put(texts.withColumn("key", key), "texts")

    def fn() -> Callable:
        def work(data: np.ndarray, off: np.ndarray, batch: pa.RecordBatch) -> dict:
            own = sketches(data, off)
            sizes = np.array([len(x) for x in own])
            return {"id": np.repeat(batch.column(0).to_numpy(), sizes), "need": np.repeat(np.minimum(sizes, common), sizes), "hash": np.concatenate(own).view(np.int64)}

        return work

    marks = space.put(map_texts(texts, fn, "id bigint, need bigint, hash bigint", "key", "text").withColumn("label", F.col("id").bitwiseAND(F.lit(1))), "marks")
    owners = marks.groupBy("label", "hash").agg(F.min("id").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = marks.join(owners, ["label", "hash"]).where("id <> owner").groupBy("id", "owner").agg(F.count("*").alias("n"), F.max("need").alias("need")).where("n >= need")
    kept = space.put(texts.join(copies.select(F.col("id").alias("key")).distinct(), "key", "left_anti"), "kept")
    space.drop("texts", "marks")
    return tuple(kept.where(F.col("label") == k).select("text") for k in (0, 1))

"""Bounded, reproducible samples of labelled texts for fitting classifiers."""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str = "doc_id"):
    """True for the fifth of the ids whose labels are never learnt from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def share_of(labels: DataFrame, label: str, id_col: str = "doc_id") -> float:
    """The share of label 1 among all labels that are not held out, half a row added to either class."""
    n0, n1 = labels.where(~held_out(id_col)).agg(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).first()
    return (n1 + 0.5) / (n0 + n1 + 1)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_bytes: int = 1 << 16, total_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[list[str], list[str]]:
    """Texts of label 0 and of label 1: of each at most `per_class` ids and `total_bytes` bytes, the first by a hash of the
    id, from rows that are not held out. Texts of over `max_bytes` are left out of the sample, as is an id whose texts
    together are over a sixteenth of the whole; equal texts of a class count once."""
    order = F.xxhash64(F.lit(17), F.col(id_col)).alias("order")
    known = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label).alias("label"), order).where(~held_out("id") & F.col("label").isin(0, 1)).distinct()
    some = [known.where(F.col("label") == k).orderBy("order", "id").limit(per_class) for k in (0, 1)]
    ids = F.broadcast(some[0].unionByName(some[1]))
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"), F.octet_length(F.col(f"`{text_col}`")).alias("size")).where(F.col("size") <= max_bytes)
    sizes = texts.drop("text").join(ids, "id").groupBy("label", "order", "id").agg(F.sum("size").alias("size")).where(F.col("size") <= total_bytes // 16).collect()
    chosen, sums = [], {0: 0, 1: 0}
    for r in sorted(sizes):
        sums[r.label] += r.size
        if sums[r.label] <= total_bytes:
            chosen.append((r.id, int(r.label)))
    if not chosen:
        return [], []
    rows = texts.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, "id bigint, label int")), "id").select("label", "text").collect()
    return tuple(one_per_family(sorted({r.text for r in rows if r.label == k})) for k in (0, 1))


_WORD = re.compile(r"\S+")


def one_per_family(texts: list[str], width: int = 5, keep: int = 16, common: int = 4) -> list[str]:
    """The first of each family of near copies in a bounded sample: texts of which `common` of the `keep` smallest
    shingle hashes are equal. A family's chance words would else look like marks of its label."""
    seen: dict[int, list[int]] = {}
    out: list[str] = []
    for t in texts:
        words = _WORD.findall(t.lower())
        own = sorted({zlib.crc32(" ".join(words[i : i + width]).encode("utf-8", "replace")) for i in range(max(1, len(words) - width + 1))})[:keep]
        hits: dict[int, int] = {}
        for h in own:
            for k in seen.get(h, ()):
                hits[k] = hits.get(k, 0) + 1
        if max(hits.values(), default=0) >= min(common, len(own)):
            continue
        for h in own:
            seen.setdefault(h, []).append(len(out))
        out.append(t)
    return out


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method; the classes count by their number."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * len(x) * np.eye(len(w)), x.T @ (y - p) - ridge * len(x) * w)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    return w

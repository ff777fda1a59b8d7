"""Quality by compression.

Two zstandard dictionaries are built from a bounded sample of good and of bad labelled text. A text is cut into
blocks, each block is compressed under either dictionary, and the difference of the summed sizes over the text's
bytes says which it resembles. A logistic curve fitted on other labelled rows turns that difference, and the
compressed size itself, into a calibrated score.

Edge cases: null and empty texts have no difference and score as such on the curve; a null id stays null; repeated
rows are scored one by one; a sample without a class gives a constant score; extra columns are ignored. Whole texts
are compressed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import map_texts
from .samples import labelled_sample, logistic, share_of


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    level: int
    block: int
    weights: tuple[float, ...]
    centre: tuple[float, ...]
    spread: tuple[float, ...]


def blocks(raw: bytes, size: int) -> list[bytes]:
    return [raw[i : i + size] for i in range(0, len(raw), size)]


class Measurer:
    """Features of texts under the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes, level: int, block: int):
        self.block, self.made = block, []
        for raw in (good, bad, b""):
            if raw:
                d = zstandard.ZstdCompressionDict(raw)
                d.precompute_compress(level=level)
                self.made.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False))
            else:
                self.made.append(zstandard.ZstdCompressor(level=level, write_content_size=False))

    def features(self, raw: bytes) -> tuple[float, float, float, float]:
        if not raw:
            return 0.0, 0.0, 0.0, 0.0
        parts = blocks(raw, self.block)
        good, bad = (sum(len(c.compress(p)) for p in parts) for c in self.made[:2])
        n = len(raw)
        gap = (bad - good) / n
        return gap, gap * min(1.0, n / self.block), good / n, min(good, bad) / (n + 64)


def _dictionary(texts: list[bytes], size: int, block: int) -> bytes:
    parts = [p for t in texts for p in blocks(t, block)]
    size = min(size, sum(map(len, parts)) // 4)
    if size < 512 or len(parts) < 8:
        return b"".join(parts)[:size] or b" "
    return zstandard.train_dictionary(size, parts, k=400, d=8, steps=1, threads=1).as_bytes()


def fit(bad: list[str], good: list[str], good_share: float = 0.87, dict_bytes: int = 1 << 16, block: int = 4_096, level: int = 3) -> CompressionModel:
    """Dictionaries from one half of each class, the curve from the other half, weighted to `good_share`."""
    raw = [[t.encode("utf-8", "replace") for t in x] for x in (bad, good)]
    if not all(raw):
        return CompressionModel(b" ", b" ", level, block, (2.0 if raw[1] else -2.0, 0, 0, 0, 0), (0.0,) * 4, (1.0,) * 4)
    rng = np.random.default_rng(5)
    halves = []
    for x in raw:
        order = rng.permutation(len(x)).tolist()
        halves.append(([x[i] for i in order[::2]], [x[i] for i in order[1::2]] or x))
    dicts = [_dictionary(h[0], dict_bytes, block) for h in halves]
    measure = Measurer(dicts[1], dicts[0], level, block)
    x = np.array([measure.features(t) for h in halves for t in h[1]])
    y = np.repeat([0.0, 1.0], [len(halves[0][1]), len(halves[1][1])])
    centre, spread = x.mean(0), x.std(0) + 1e-9
    w = logistic(np.column_stack([np.ones(len(x)), (x - centre) / spread]), y)
    w[0] += np.log(good_share / (1 - good_share)) - np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3))
    return CompressionModel(dicts[1], dicts[0], level, block, tuple(w.tolist()), tuple(centre.tolist()), tuple(spread.tolist()))


def fit_from(docs: DataFrame, labels: DataFrame, per_class: int = 3_000, id_col: str = "doc_id", text_col: str = "text") -> CompressionModel:
    """The model of a sample of at most `per_class` texts a class, and of the share of label 1, none of them held out."""
    return fit(*labelled_sample(docs, labels, "quality", per_class, id_col=id_col, text_col=text_col), good_share=share_of(labels, "quality", id_col))


def score(df: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df`: the compressed sizes' difference a byte, and the chance of label 1."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def fn() -> Callable:
        m = shared.value
        measure = Measurer(m.good, m.bad, m.level, m.block)
        w, centre, spread = np.array(m.weights), np.array(m.centre), np.array(m.spread)

        def work(data: np.ndarray, off: np.ndarray, batch: pa.RecordBatch) -> dict:
            raw, at = data.tobytes(), off.tolist()
            x = np.array([measure.features(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]).reshape(-1, 4)
            z = w[0] + ((x - centre) / spread) @ w[1:]
            return {"id": batch.column(0), "gap": x[:, 0], "score": 1 / (1 + np.exp(-np.clip(z, -30, 30)))}

        return work

    return map_texts(df, fn, "id bigint, gap double, score double", id_col, text_col).withColumnRenamed("id", id_col)

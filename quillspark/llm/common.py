"""Shared helpers: shared-folder tables, Arrow text batches and vectorised word hashing."""

from __future__ import annotations

import ctypes
import os
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP_BYTES = 1 << 20
#: Longer runs of bytes are hashed and compared one by one.
LONG_RUN = 64
_MULT = np.uint64(0x9E3779B97F4A7C15)


# --- tables in the folder that the cluster shares -------------------------------------------------


class Workspace:
    """A folder of intermediate Parquet tables below spark.checkpoint.dir.

    A written table cuts lineage and outlives a lost executor. Where the setting is absent, a temporary folder is used
    on a single machine; on a cluster its absence is an error.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.match(r"local($|\[)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir is not set; on a cluster it must name a folder that all executors share")
            base = "file://" + os.path.join(tempfile.gettempdir(), "quillspark-checkpoints")
        self.spark = spark
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def slim(df: DataFrame) -> DataFrame:
    """Fewer partitions, without a shuffle, for tables that are small beside the input."""
    return df.coalesce(max(12, parts(df) // 8))


def broadcast_below(df: DataFrame, rows: int, limit: int = 1_000_000) -> DataFrame:
    """Broadcast hint for a counted table of at most `limit` rows; beyond that Spark shuffles both sides."""
    return F.broadcast(df) if rows <= limit else df


# --- Arrow batches --------------------------------------------------------------------------------


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


def give_back() -> None:
    """Return freed memory to the system; a worker that is used again would else keep it through later stages."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def tidily(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches that gives memory back after each of them."""

    def feed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            del batch
            give_back()

    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(feed(batches))
        give_back()

    return wrapped


def string_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column as strings without nulls (null counts as empty)."""
    col = batch.column(batch.schema.get_field_index(name))
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.string())
    return pc.fill_null(col, "") if col.null_count else col


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values, and the n + 1 byte offsets of the values, without making Python strings."""
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    if len(col) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def row_groups(offsets: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer single text is a range of its own."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def map_texts(
    df: DataFrame,
    fn: Callable[[], Callable[[np.ndarray, np.ndarray, pa.RecordBatch], dict]],
    schema: str,
    id_col: str,
    text_col: str,
) -> DataFrame:
    """Run a batch function over texts. `fn()` is called once a task and gives the function of
    (bytes, offsets, batch) -> columns; the batch holds id and text only."""
    names = [x.split()[0] for x in schema.split(",")]
    want = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = fn()
        for batch in batches:
            raw, off = text_buffer(string_column(batch, "text"))
            for lo, hi in row_groups(off):
                out = work(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], batch.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (out[k] for k in names)], names=names)

    return want.mapInArrow(tidily(run), schema)


def filter_rows(df: DataFrame, keep: Callable[[], Callable[[np.ndarray, np.ndarray, pa.RecordBatch], np.ndarray]], text_col: str) -> DataFrame:
    """Rows whose text passes a batch predicate, with all their columns; one pass without a shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = keep()
        for batch in batches:
            raw, off = text_buffer(string_column(batch, text_col))
            for lo, hi in row_groups(off):
                part = batch.slice(lo, hi - lo)
                yield part.filter(pa.array(work(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], part), pa.bool_()))

    return df.mapInArrow(tidily(run), df.schema)


# --- hashing --------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] = _FOLD[97:123]
_KEEP = np.array([0, *((1 << 8 * k) - 1 for k in range(1, 9))], np.uint64)


def _delimiters(codes: Iterable[int]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(codes)] = True
    return table


SPACES = _delimiters([0x20, *range(0x09, 0x0E)])
NEWLINE = _delimiters([0x0A])


def runs(data: np.ndarray, offsets: np.ndarray, delimiter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes that are no delimiters and lie in one text: first byte, end, number of the text."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~delimiter[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < n]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts[cuts > 0] - 1] = inside[cuts[cuts > 0] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; zeros follow the end."""
    return np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hashes of byte runs: a chain of mixed steps of eight bytes side by side for short runs, xxh3 for long ones.

    Equal bytes give equal hashes on every machine; `fold` makes A-Z equal to a-z. No step is linear in the bytes, so
    that no simple pattern of letters makes two runs collide; chance collisions have odds of 2**-64 a pair.
    """
    if fold:
        data = _FOLD[data]
    lens = ends - starts
    out = lens.astype(np.uint64) * _MULT
    long = np.flatnonzero(lens > LONG_RUN)
    todo = np.flatnonzero(lens <= LONG_RUN) if len(long) else np.arange(len(lens))
    at, left, eights = starts[todo], lens[todo], _eights(data)
    while len(todo):
        out[todo] = mix(out[todo] ^ (eights[at] & _KEEP[np.minimum(left, 8)]))
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    for k in long.tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes())
    return out


def same_runs(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, other: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether runs of one buffer have the bytes of runs of another, pair by pair."""
    same = lens == sizes
    long = np.flatnonzero(same & (lens > LONG_RUN))
    todo = np.flatnonzero(same & (lens <= LONG_RUN))
    x, y, left = starts[todo], places[todo], lens[todo]
    a, b = _eights(data), _eights(other)
    while len(todo):
        differ = ((a[x] ^ b[y]) & _KEEP[np.minimum(left, 8)]) != 0
        same[todo[differ]] = False
        more = ~differ & (left > 8)
        todo, x, y, left = todo[more], x[more] + 8, y[more] + 8, left[more] - 8
    for k in long.tolist():
        same[k] = np.array_equal(data[starts[k] : starts[k] + lens[k]], other[places[k] : places[k] + sizes[k]])
    return same


def combine(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each `width` neighbours, in order."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = (out ^ (out >> np.uint64(29))) * _MULT + hashes[k : k + n]
    return mix(out)


class WordCache:
    """Results per distinct word in flat arrays, kept between batches of a task and emptied beyond `limit` words.

    `compute(words)` gives columns of one value a word; the column named "flat", if any, holds sequences that are
    joined, with their lengths in the column "lens" and their places in "base". Hashes only find a word's row: its bytes
    are then compared with the word the row was made for, and a word that shares its hash with another has a row apart.
    """

    def __init__(self, compute: Callable[[list[bytes]], dict], limit: int = 500_000):
        self.compute, self.limit = compute, limit
        self.clear()

    def clear(self) -> None:
        self.keys, self.rows, self.columns = np.zeros(0, np.uint64), np.zeros(0, np.int64), {}
        self.bytes, self.places, self.sizes = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.apart: dict[bytes, int] = {}

    def _add(self, words: list[bytes]) -> np.ndarray:
        got, n = self.compute(words), len(self.sizes)
        if "flat" in got:
            got["base"] = np.cumsum(got["lens"]) - got["lens"] + len(self.columns.get("flat", ()))
        self.columns = {k: np.concatenate([self.columns[k], v]) if self.columns else v for k, v in got.items()}
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.places = np.concatenate([self.places, len(self.bytes) + np.cumsum(sizes) - sizes])
        self.sizes, self.bytes = np.concatenate([self.sizes, sizes]), np.concatenate([self.bytes, np.frombuffer(b"".join(words), np.uint8)])
        return n + np.arange(len(words))

    def look(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The row of each word in the arrays of `columns`."""
        keys, first, where = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.sizes) + len(keys) > self.limit:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inner = at < len(self.keys)
        known[inner] = self.keys[at[inner]] == keys[inner]
        rows = np.zeros(len(keys), np.int64)
        rows[known] = self.rows[at[known]]
        new = np.flatnonzero(~known)
        if len(new) or not self.columns:
            rows[new] = self._add([data[a:b].tobytes() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            self.keys = np.insert(self.keys, at[new], keys[new])
            self.rows = np.insert(self.rows, at[new], rows[new])
        rows = rows[where]
        odd = np.flatnonzero(~same_runs(data, starts, ends - starts, self.bytes, self.places[rows], self.sizes[rows]))
        if len(odd):
            words = [data[starts[k] : ends[k]].tobytes() for k in odd.tolist()]
            if fresh := [w for w in dict.fromkeys(words) if w not in self.apart]:
                self.apart.update(zip(fresh, self._add(fresh).tolist(), strict=True))
            rows[odd] = [self.apart[w] for w in words]
        return rows


def count_in(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many marked bytes each text has, where few are marked."""
    at = np.flatnonzero(mask)
    edge = np.searchsorted(at, offsets)
    return edge[1:] - edge[:-1]

"""N-gram Jaccard join.

A document is the set of its distinct word n-grams. Equal sets are one class, and classes are the nodes of all that
follows; a table of ids by class brings the documents back at the end. Within each class's set the n-grams stand rare
first, by their counts over all documents (a sketch that grows with the text holds the counts; any counts give exact
results, good ones give few candidates). Two sets that reach the threshold share an n-gram of their prefixes, so
classes meet on prefix n-grams only. Length and positional filters work on the meeting rows, the suffix filter on
profiles of the sets' hash ranges; what remains is verified on the whole sets, once per pair.

Groups of copies: pairs of one component need no further link. In each prefix n-gram's bucket all classes are first
held against two of them, one being the class with the commonest prefix (of near copies the one that the others
were made from). Components are formed, and only buckets that still hold several components are looked at again, by
all pairs of different components: small buckets by a self-join, large ones cut by set size, so that only sizes that
may link meet, and then in blocks that filter within a task and give out only pairs that pass every filter, in the
bucket of the pair's first common n-gram alone. No link that could join two components is left out, so the components
are exact.

Edge cases: null, empty and blank texts have empty sets and link with nothing; texts of fewer words than n have one
n-gram, their whole sequence; rows without id keep their counts, with a null component; rows of one id belong to one
document and one component, whatever their texts, and each row shows its own set's size; an empty table gives an empty
result; extra columns are ignored. Sets hold 64-bit hashes of n-grams.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Workspace, broadcast_below, combine, map_texts, parts, row_groups, run_hashes, runs, slim, string_column, text_buffer, tidily
from .components import connected_components

#: Least and greatest size of the sketch of counts, size of the parts it is summed in and of a set's profile, as powers
#: of two. Between its bounds the sketch has a slot for every 64 bytes of text.
SKETCH_BITS = (14, 26)
CHUNK_BITS = 14
PROFILE_BITS = 6
#: Buckets of more rows are compared in blocks of so many rows.
SMALL_BUCKET = 64
BLOCK_ROWS = 256


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> list[np.ndarray]:
    """The ordered distinct n-gram hashes of each text."""
    starts, ends, text = runs(data, off, SPACES)
    words = run_hashes(data, starts, ends, fold=True)
    edge = np.searchsorted(text, np.arange(len(off))).tolist()
    grams = combine(words, n)
    out = []
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        if b - a >= n:
            own = np.sort(grams[a : b - n + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            out.append(combine(words[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def needed(total: int, percent: int) -> int:
    """Least intersection of two sets of `total` elements together that reaches the threshold."""
    return -(-percent * total // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    """Two linked sets share an n-gram among so many of the first in any common order."""
    return n - -(-percent * n // 100) + 1


def profile(own: np.ndarray) -> bytes:
    """Sizes of the set's parts by hash range."""
    return np.bincount((own >> np.uint64(64 - PROFILE_BITS)).astype(np.int64), minlength=1 << PROFILE_BITS).astype("<u4").tobytes()


def _profiles(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<u4").reshape(len(raw), -1).astype(np.int64)


def _slot(grams: np.ndarray, bits: int) -> np.ndarray:
    return (grams >> np.uint64(64 - bits)).astype(np.int64)


def sketch_bits(size: int) -> int:
    """The sketch for so many bytes of text."""
    return min(max((size // 64).bit_length(), SKETCH_BITS[0]), SKETCH_BITS[1])


def set_key(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def signatures(df: DataFrame, id_col: str, text_col: str, n: int, bits: int) -> DataFrame:
    """Per row id, set size and a 128-bit key of the set; and per task the counts of the n-grams, in packed chunks."""
    want = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n", "key", "chunk", "counts"]
        counts, size, pack = np.zeros(1 << bits, np.uint16), 1 << CHUNK_BITS, zstandard.ZstdCompressor(level=1)
        for batch in batches:
            raw, off = text_buffer(string_column(batch, "text"))
            for lo, hi in row_groups(off):
                sets = shingle_sets(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], n)
                slots = np.sort(_slot(np.concatenate([*sets, np.zeros(0, np.uint64)]), bits))
                at = np.flatnonzero(np.diff(slots, prepend=-1))
                counts[slots[at]] = np.minimum(counts[slots[at]] + np.diff(at, append=len(slots)), 65_535)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.binary()), pa.nulls(hi - lo, pa.int32()), pa.nulls(hi - lo, pa.binary())], names=names
                )
        chunks = [k for k in range(len(counts) // size) if counts[k * size : (k + 1) * size].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(chunks), pa.int64()), pa.nulls(len(chunks), pa.int64()), pa.nulls(len(chunks), pa.binary()), pa.array(chunks, pa.int32()), pa.array([pack.compress(counts[k * size : (k + 1) * size].tobytes()) for k in chunks], pa.binary())], names=names
        )

    return want.mapInArrow(tidily(run), "id bigint, n bigint, key binary, chunk int, counts binary")


def sketch(rows: DataFrame, bits: int) -> np.ndarray:
    """Ranks of the summed counts, one byte for each slot of the sketch."""
    size = 1 << CHUNK_BITS

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(unpack.decompress(raw), np.uint16).astype(np.int64)
        ranks = [np.minimum(np.rint(8 * np.log2(1 + v)), 255).astype(np.uint8).tobytes() for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(ranks, pa.binary())], names=["chunk", "ranks"])

    out = np.zeros(1 << bits, np.uint8)
    for r in rows.where("chunk is not null").select("chunk", "counts").repartition(parts(rows), "chunk").mapInArrow(add, "chunk int, ranks binary").collect():
        out[r.chunk * size : (r.chunk + 1) * size] = np.frombuffer(r.ranks, np.uint8)
    return out


def prefixes(df: DataFrame, id_col: str, text_col: str, n: int, percent: int, ranks: np.ndarray) -> DataFrame:
    """Per row id, set size and key, the prefix n-grams rare first, their mean rank, and the set's profile."""
    shared, bits = df.sparkSession.sparkContext.broadcast(ranks), len(ranks).bit_length() - 1

    def fn() -> Callable:
        rank = shared.value

        def work(data: np.ndarray, off: np.ndarray, batch: pa.RecordBatch) -> dict:
            first, weight, sets = [], [], shingle_sets(data, off, n)
            for own in sets:
                k = prefix_length(len(own), percent) if len(own) else 0
                of = rank[_slot(own, bits)]
                at = np.argsort(of, kind="stable")[:k]
                first.append(own[at])
                weight.append(float(of[at].mean()) if k else 0.0)
            upto = np.concatenate([[0], np.cumsum([len(p) for p in first])]).astype(np.int32)
            flat = np.concatenate([*first, np.zeros(0, np.uint64)]).view(np.int64)
            return {
                "id": batch.column(0), "n": np.array([len(s) for s in sets], np.int64), "key": pa.array([set_key(s) for s in sets], pa.binary()), "prefix": pa.ListArray.from_arrays(pa.array(upto), pa.array(flat)),
                "weight": np.array(weight, float), "profile": pa.array([profile(s) for s in sets], pa.binary()),
            }

        return work

    return map_texts(df, fn, "id bigint, n bigint, key binary, prefix array<bigint>, weight double, profile binary", id_col, text_col)


def block_pairs(ids: np.ndarray, comps: np.ndarray, sizes: np.ndarray, profiles: np.ndarray, prefix: list, gram: int, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs between two blocks of one bucket (or within one) that lie in different components, pass the length and
    suffix filters, and have the bucket's n-gram as the first that their prefixes share, by which the positional filter
    holds as well."""
    total = sizes[left][:, None] + sizes[right][None, :]
    fit = (comps[left][:, None] != comps[right][None, :]) & (ids[left][:, None] != ids[right][None, :])
    fit &= 100 * np.minimum(sizes[left][:, None], sizes[right][None, :]) >= percent * np.maximum(sizes[left][:, None], sizes[right][None, :])
    if left is right:
        fit &= ids[left][:, None] < ids[right][None, :]
    x, y = np.nonzero(fit)
    apart = np.zeros(len(x), np.int64)
    for lo in range(0, len(x), 1 << 14):
        apart[lo : lo + (1 << 14)] = np.abs(profiles[left[x[lo : lo + (1 << 14)]]] - profiles[right[y[lo : lo + (1 << 14)]]]).sum(1)
    some = total[x, y] - apart >= 2 * -(-percent * total[x, y] // (100 + percent))
    out = []
    sets: dict[int, dict] = {}
    for i, j in zip(left[x[some]].tolist(), right[y[some]].tolist(), strict=True):
        own = sets.get(j)
        if own is None:
            own = sets[j] = {g: k for k, g in enumerate(prefix[j])}
        at, g = next((k, g) for k, g in enumerate(prefix[i]) if g in own)
        if g == gram and (100 + percent) * (1 + min(sizes[i] - at - 1, sizes[j] - own[g] - 1)) >= percent * (sizes[i] + sizes[j]):
            out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def _filter_profiles(pairs: DataFrame, percent: int) -> DataFrame:
    """Suffix filter: parts of different sizes bound the symmetric difference of two sets from below."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, left, right = (batch.column(k) for k in range(6))
            if len(a):
                apart = np.abs(_profiles(left.to_pylist()) - _profiles(right.to_pylist())).sum(1)
                total = na.to_numpy() + nb.to_numpy()
                yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(total - apart >= 2 * -(-percent * total // (100 + percent))))

    return pairs.mapInArrow(tidily(run), "a bigint, b bigint")


def _verify(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets reach the threshold."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(both >= needed(len(x) + len(y), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(tidily(run), "a bigint, b bigint")


class JaccardJoin:
    """One run over one table; `components` (node, root) and the verified `links` (a, b) are its results, all by the node
    numbers of the table `classes` (key, rep, node), in which `rep` is the smallest id of a class."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, n: int, percent: int):
        self.spark, self.n, self.percent = df.sparkSession, n, percent
        self.space = Workspace(self.spark, "jaccard")
        self.docs = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
        self._run()

    def _sets_of(self, nodes: DataFrame, count: int) -> DataFrame:
        """Whole sets of some classes, as bytes, from the texts of their representatives."""

        def fn() -> Callable:
            def work(data: np.ndarray, off: np.ndarray, batch: pa.RecordBatch) -> dict:
                sets = shingle_sets(data, off, n)
                return {"id": batch.column(0), "key": pa.array([set_key(s) for s in sets], pa.binary()), "grams": pa.array([s.tobytes() for s in sets], pa.binary())}

            return work

        n = self.n
        some = self.space.get("classes").join(broadcast_below(nodes, count), "node", "left_semi").select(F.col("rep").alias("id"), "key", "node")
        texts = self.docs.join(broadcast_below(some.select("id"), count), "id", "left_semi")
        found = map_texts(texts, fn, "id bigint, key binary, grams binary", "id", "text")
        return found.join(broadcast_below(some, count), ["id", "key"]).dropDuplicates(["id", "key"]).select("node", "grams")

    def _links(self, pairs: DataFrame, name: str) -> DataFrame:
        """Verified links among distinct candidate pairs (a, b)."""
        space = self.space
        info = space.get("info")
        left, right = info.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("profile").alias("pa")), info.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("profile").alias("pb"))
        full = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "pa", "pb")
        rest = space.put(slim(_filter_profiles(full, self.percent)), f"pairs-{name}")
        nodes = space.put(slim(rest.select(F.explode(F.array("a", "b")).alias("node")).distinct()), f"nodes-{name}")
        sets = space.put(self._sets_of(nodes, nodes.count()), f"sets-{name}")
        full = rest.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")
        out = space.put(slim(_verify(full.select("a", "b", "ga", "gb"), self.percent)), f"links-{name}")
        space.drop(f"sets-{name}", f"pairs-{name}", f"nodes-{name}")
        return out

    def _candidates(self, meeting: DataFrame) -> DataFrame:
        """Distinct pairs of meeting rows (a, na, i, b, nb, j) that pass the length and positional filters. Of all the
        n-grams on which a pair meets the first in the common order bounds the intersection."""
        p = self.percent
        long = F.greatest("na", "nb")
        first = meeting.where((F.col("a") != F.col("b")) & (100 * F.least("na", "nb") >= p * long))
        turned = F.struct(F.col("nb").alias("na"), F.col("j").alias("i"), F.col("na").alias("nb"), F.col("i").alias("j"))
        first = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.struct("na", "i", "nb", "j")).otherwise(turned).alias("s"))
        pairs = first.groupBy("a", "b").agg(F.min("s.na").alias("na"), F.min("s.nb").alias("nb"), F.min("s.i").alias("i"), F.min("s.j").alias("j"))
        most = 1 + F.least(F.col("na") - F.col("i") - 1, F.col("nb") - F.col("j") - 1)
        return pairs.where((100 + p) * most >= p * (F.col("na") + F.col("nb"))).select("a", "b")

    def _run(self) -> None:
        space, percent = self.space, self.percent
        bits = sketch_bits(self.docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
        signs = space.put(signatures(self.docs, "id", "text", self.n, bits), "signatures")
        self.rows = signs.where("chunk is null").select("id", "n", "key")
        ranks = sketch(signs, bits)
        named = self.rows.where("n > 0 and id is not null")
        classes = slim(named.groupBy("key").agg(F.min("id").alias("rep"))).withColumn("node", F.monotonically_increasing_id())
        classes = space.put(classes, "classes")
        before = prefixes(self.docs, "id", "text", self.n, percent, ranks).where("n > 0")
        info = before.join(classes.withColumnRenamed("rep", "id"), ["id", "key"]).dropDuplicates(["id", "key"]).drop("id", "key")
        info = space.put(info, "info")
        # Rows whose n-gram is in another prefix too, and all classes of a bucket against two of them.
        grams = info.select("node", F.col("n").cast("int").alias("n"), F.col("weight").cast("float").alias("weight"), F.posexplode("prefix").alias("i", "gram"))
        shared = grams.groupBy("gram").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("gram").repartition(parts(info))
        meets = space.put(grams.join(shared, "gram"), "meets")
        who, order = F.struct("node", "n", "i"), F.xxhash64("node")
        hubs = meets.groupBy("gram").agg(F.max(F.struct("weight", order.alias("h"), who.alias("w"))).alias("x"), F.min(F.struct(order.alias("h"), who.alias("w"))).alias("y"))
        hubs = hubs.select("gram", F.array_distinct(F.array("x.w", "y.w")).alias("hubs")).repartition(parts(info))
        near = meets.join(hubs, "gram").select(F.col("node").alias("a"), F.col("n").alias("na"), "i", F.explode("hubs").alias("hub")).select("a", "na", "i", F.col("hub.node").alias("b"), F.col("hub.n").alias("nb"), F.col("hub.i").alias("j"))
        links = self._links(self._candidates(near), "hubs")
        roots = space.put(slim(connected_components(links, space, "components-1")), "roots-1")
        # Buckets that still hold several components: all pairs of different ones.
        own = meets.select("gram", "node", "n", "i").join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
        mixed = own.groupBy("gram").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("size")).where("x < y").select("gram", "size").repartition(parts(info))
        open_ = space.put(own.join(mixed, "gram"), "open")
        few = open_.where(F.col("size") <= SMALL_BUCKET)
        x = few.select("gram", F.col("node").alias("a"), F.col("n").alias("na"), "i", F.col("comp").alias("ca"))
        y = few.select("gram", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("i").alias("j"), F.col("comp").alias("cb"))
        close = (100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na"))
        near = x.join(y, "gram").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & close).select("a", "na", "i", "b", "nb", "j")
        pairs = self._candidates(near).unionByName(self._blocks(open_.where(F.col("size") > SMALL_BUCKET))).distinct()
        more = self._links(pairs, "rest")
        # Links between components, classes that share an id among them, and the components' components.
        of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        joined = more.unionByName(self._twins(named, classes))
        between = joined.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        upper = space.put(slim(connected_components(between, space, "components-2")), "roots-2").select(F.col("node").alias("mid"), F.col("root").alias("top"))
        alone = upper.select(F.col("mid").alias("node"), F.col("mid").alias("root")).join(roots.select("node"), "node", "left_anti")
        joined = roots.unionByName(alone).join(upper, F.col("root") == F.col("mid"), "left").select("node", F.coalesce("top", "root").alias("root"))
        self.components, self.links = space.put(slim(joined), "components"), links.unionByName(more)
        space.drop("meets", "open", "info", "roots-1", "roots-2")

    def _twins(self, named: DataFrame, classes: DataFrame) -> DataFrame:
        """Pairs (a, b) of classes that hold rows of one id: each of an id's classes with the least of them."""
        several = named.groupBy("id").agg(F.min("key").alias("x"), F.max("key").alias("y")).where("x < y").select("id")
        own = named.join(several, "id", "left_semi").select("id", "key").distinct().join(classes.select("key", "node"), "key").select("id", "node")
        least = own.groupBy("id").agg(F.min("node").alias("a"))
        return own.join(least, "id").select("a", F.col("node").alias("b")).where("a < b")

    def _blocks(self, rows: DataFrame) -> DataFrame:
        """Candidate pairs (a, b) of large buckets, block by block; a group holds two blocks of rows at most. Blocks are
        cut within ranges of set sizes so wide that linked sets lie in one range or in neighbouring ones."""
        percent = self.percent
        info = self.space.get("info").select("node", "prefix", "profile")
        width = math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1e-9
        ranged = rows.withColumn("c", F.floor(F.log(F.col("n").cast("double")) / F.lit(width)).cast("bigint"))
        shape = ranged.groupBy("gram", "c").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
        shape = shape.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("c", "blocks"))).alias("shape"))
        at = lambda k: F.coalesce(F.try_element_at("shape", F.col("c") + F.lit(k)), F.lit(0))
        dealt = ranged.join(shape, "gram").withColumn("block", F.pmod(F.xxhash64(F.lit(3), "node"), at(0)).cast("int"))
        upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        within = F.transform(upto(at(0)), lambda o: F.struct(F.col("c").alias("c"), F.least("block", o).alias("p"), F.lit(0).alias("step"), F.greatest("block", o).alias("q")))
        above = F.transform(upto(at(1)), lambda o: F.struct(F.col("c").alias("c"), F.col("block").alias("p"), F.lit(1).alias("step"), o.alias("q")))
        below = F.transform(upto(at(-1)), lambda o: F.struct((F.col("c") - 1).alias("c"), o.alias("p"), F.lit(1).alias("step"), F.col("block").alias("q")))
        spread = dealt.select("gram", "node", "n", "comp", F.col("c").alias("own"), "block", F.explode(F.concat(within, above, below)).alias("k")).select("gram", "node", "n", "comp", "own", "block", "k.*")
        keyed = spread.join(info, "node")

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            block, own = pdf["block"].to_numpy(), pdf["own"].to_numpy()
            c, p, step, q = (int(pdf[k].iloc[0]) for k in ("c", "p", "step", "q"))
            left = np.flatnonzero((block == p) & (own == c))
            right = left if not step and p == q else np.flatnonzero((block == q) & (own == c + step))
            got = block_pairs(pdf["node"].to_numpy(), pdf["comp"].to_numpy(), pdf["n"].to_numpy(), _profiles(pdf["profile"].tolist()), [x.tolist() for x in pdf["prefix"]], int(pdf["gram"].iloc[0]), left, right, percent)
            return pd.DataFrame(got, columns=["a", "b"], dtype="int64")

        return keyed.groupBy("gram", "c", "p", "step", "q").applyInPandas(run, "a bigint, b bigint")

    def result(self) -> DataFrame:
        """Per row of the input: id, set size, component."""
        classes = self.space.get("classes").join(self.components, "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = classes.groupBy("root").agg(F.min("rep").alias("component_id")).repartition(parts(classes))
        of_class = classes.join(least, "root").select("key", "component_id")
        out = self.rows.join(of_class, "key", "left")
        return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component_id"))).otherwise(F.col("id")).alias("component_id"))


def join_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of `df`: id, n_shingles and component_id, the smallest id reachable by links."""
    return JaccardJoin(df, id_col, text_col, n, percent).result().withColumnRenamed("id", id_col)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `df` whose id is the smallest of their component; rows of one id stay or go together, rows without id stay."""
    found = JaccardJoin(df, id_col, text_col, n, percent)
    mark = next(f"__gone{k}" for k in range(len(df.columns) + 1) if f"__gone{k}" not in {c.lower() for c in df.columns})
    gone = found.result().where("id != component_id").select(F.col("id").alias(mark)).distinct()
    gone = found.space.put(slim(gone), "gone")
    found.space.drop("signatures", "classes", "components", "links-hubs", "links-rest")
    return df.join(broadcast_below(gone, gone.count(), 100_000), df[f"`{id_col}`"].cast("bigint") == F.col(mark), "left_anti")

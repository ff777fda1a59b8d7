"""Routing and ranking: resolve the document and section of a question, filter, then score and rank.

Routing tables of a few rows are broadcast, larger ones joined whole without; chunks are never broadcast. Documents are filtered by
an equi-join where a question names one, so only questions without a document meet all chunks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DOCUMENTS, SECTION_ROUTES

#: Routing tables above this size are joined without a broadcast.
ROUTE_ROWS = 10_000


def is_small(df: DataFrame, rows: int = ROUTE_ROWS) -> bool:
    """Whether a table has at most so many rows; no more than one further row is counted."""
    return df.limit(rows + 1).count() <= rows


def section_routes(spark: SparkSession, routes: tuple = SECTION_ROUTES) -> DataFrame:
    return spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(routes)], "priority int, phrase string, pattern string")


def document_routes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, b, s) for i, (b, s) in enumerate(DOCUMENTS)], "priority int, brand string, stem string")


def resolve(questions: DataFrame, routes: DataFrame, phrase: str, target: str, out: str, id_col: str = "question_id") -> DataFrame:
    """The target of the first route, by priority, whose phrase lies in the question, or null."""
    few = routes.select("priority", F.col(phrase).alias("__phrase"), F.col(target).alias("__target"))
    hit = F.lower("question").contains(F.lower("__phrase"))
    if is_small(few):
        joined = questions.join(F.broadcast(few), hit, "left")
    else:  # a left join without equal keys would be broadcast all the same
        joined = questions.join(few.hint("shuffle_replicate_nl"), hit).unionByName(questions, allowMissingColumns=True)
    return joined.groupBy(*questions.columns).agg(F.min(F.when(F.col("priority").isNotNull(), F.struct("priority", "__target"))).getField("__target").alias(out))


def resolve_section(questions: DataFrame, routes: DataFrame) -> DataFrame:
    return resolve(questions, routes, "phrase", "pattern", "section_pattern")


def resolve_document(questions: DataFrame, routes: DataFrame, target: str = "brand") -> DataFrame:
    return resolve(questions, routes, "brand", target, "document_filter")


def section_matches(pattern: Column, section: Column) -> Column:
    """Whether a section begins with a match of a pattern. A literal prefix needs no regular expression."""
    prefix = pattern.rlike(r"^\^?[A-Za-z0-9 :,/&-]+$")
    text = F.regexp_replace(pattern, r"^\^", "")
    return F.coalesce(F.when(prefix, F.startswith(section, text)).otherwise(F.regexp_like(section, F.concat(F.lit("(?d)^(?:"), pattern, F.lit(")")))), F.lit(False))


def wanted_places(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """The documents and sections that each question looks into (question_id, __document, __section, fallback): the document
    filter never falls back, the section filter does, to all of the question's chunks where none matches."""
    asked = questions.select("question_id", "section_pattern", "document_filter")
    places = chunks.select("document", "section").distinct()
    named = F.col("document_filter").isNotNull()
    met = asked.where(named).join(places, F.col("document_filter") == F.col("document")).unionByName(asked.where(~named).join(places, F.lit(True)))
    met = met.select("question_id", "document", "section", "section_pattern", section_matches(F.col("section_pattern"), F.col("section")).alias("hit"))
    any_ = met.groupBy("question_id").agg(F.max("hit").alias("any"))
    wanted = met.join(any_, "question_id").where(F.col("hit") | ~F.col("any"))
    return wanted.select("question_id", F.col("document").alias("__document"), F.col("section").alias("__section"), (F.col("section_pattern").isNotNull() & ~F.col("any")).alias("fallback"))


def candidates(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Question and chunk pairs after the document and section filters. `fallback` tells whether no section matched.

    What each question wants is settled on the distinct documents and sections; chunks then meet questions by equal
    document and section, so that a hot document is dealt by its sections and the engine may split what is still hot."""
    wanted = wanted_places(questions, chunks)
    pairs = wanted.join(chunks, F.col("__document").eqNullSafe(F.col("document")) & F.col("__section").eqNullSafe(F.col("section"))).drop("__document", "__section")
    return questions.join(pairs, "question_id")


def _dealt(questions: DataFrame, chunks: DataFrame, n_q: int, n_d: int) -> tuple[DataFrame, DataFrame]:
    """Both with block numbers `q` and `d`; each question in every block of chunks, each chunk in every block of questions."""
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = questions.withColumn("q", F.pmod(F.xxhash64("question_id"), F.lit(n_q)).cast("int")).withColumn("d", spread(n_d))
    return left, chunks.withColumn("d", F.pmod(F.xxhash64("chunk_idx"), F.lit(n_d)).cast("int")).withColumn("q", spread(n_q))


def _blocks(df: DataFrame, rows: int) -> int:
    return max(1, -(-df.count() // rows))


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Vectors of one length as rows, null ones as no numbers."""
    dim = next((len(x) for x in vectors if x is not None), 0)
    return np.stack([np.full(dim, np.nan) if x is None else np.asarray(x, float) for x in vectors])


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All cosines, summed in the order of `vectors.cosine`; no number for a zero vector."""

    def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        total = np.zeros(np.broadcast_shapes(x.shape[1:], y.shape[1:]))
        for u, v in zip(x, y, strict=True):
            total += u * v
        return total

    left, right = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    with np.errstate(divide="ignore", invalid="ignore"):
        return dots(left[:, :, None], right[:, None, :]) / (np.sqrt(dots(left, left))[:, None] * np.sqrt(dots(right, right))[None, :])


def cosine_pairs(questions: DataFrame, chunks: DataFrame, on: tuple[str, str], question_rows: int = 512, chunk_rows: int = 2_048) -> DataFrame:
    """The cosine of every question (question_id, q_embedding) and chunk (chunk_idx, embedding) whose columns `on` are equal,
    null for a zero vector. Blocks meet blocks as products: rows grow with the pairs asked for, a group's memory does not."""
    asked = questions.select("question_id", "q_embedding", F.col(on[0]).alias("__on")).where("__on is not null")
    held = chunks.select("chunk_idx", "embedding", F.col(on[1]).alias("__on")).where("__on is not null")
    left, right = _dealt(asked, held, _blocks(asked, question_rows), _blocks(held, chunk_rows))

    def score(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"question_id": [], "chunk_idx": [], "cosine": []})
        cosine = _cosines(_matrix(x["q_embedding"]), _matrix(y["embedding"]))
        return pd.DataFrame({"question_id": np.repeat(x["question_id"].to_numpy(), len(y)), "chunk_idx": np.tile(y["chunk_idx"].to_numpy(), len(x)), "cosine": cosine.ravel()})

    kinds = f"question_id {questions.schema['question_id'].dataType.simpleString()}, chunk_idx {chunks.schema['chunk_idx'].dataType.simpleString()}, cosine double"
    out = left.groupBy("__on", "q", "d").cogroup(right.groupBy("__on", "q", "d")).applyInPandas(score, kinds)
    return out.withColumn("cosine", F.nanvl("cosine", F.lit(None).cast("double")))


def _products(a: np.ndarray, b: np.ndarray, by_angle: bool) -> np.ndarray:
    # Not a library product: equal vectors must get equal scores wherever they stand.
    score = np.einsum("ij,kj->ik", a, b, optimize=False)
    if by_angle:
        with np.errstate(divide="ignore", invalid="ignore"):
            score /= np.sqrt(np.einsum("ij,ij->i", a, a))[:, None] * np.sqrt(np.einsum("ij,ij->i", b, b))[None, :]
    return score


def _best(a: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int, sign: int, scores: Callable, own: np.ndarray | None = None, tile: tuple[int, int] = (128, 2_048)) -> tuple[np.ndarray, ...]:
    """Rows of `a` and of `b` and scores of the k best for each row of `a`, tile by tile. With `own`, pairs without a score
    and a question's own chunk go; else pairs without a score come last."""
    kept = []
    for lo in range(0, len(a), tile[0]):
        parts = []
        for at in range(0, len(b), tile[1]):
            score = scores(a[lo : lo + tile[0]], b[at : at + tile[1]])
            score[np.isnan(score)] = -np.inf
            if own is not None:
                score[own[lo : lo + tile[0], None] == ids[None, at : at + tile[1]]] = -np.inf
            place = min(k, score.shape[1]) - 1
            least = -np.partition(-score, place, axis=1)[:, place]
            row, col = np.nonzero((score >= least[:, None]) & ((score > -np.inf) | (own is None)))
            parts.append((row, col + at, score[row, col]))
        row, col, score = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((sign * ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        kept.append((row[first] + lo, col[first], score[first]))
    return tuple(np.concatenate(x) for x in zip(*kept, strict=True))


def nearest(questions: DataFrame, chunks: DataFrame, k: int, by_angle: bool = True, tie_break: str = "first", question_rows: int = 4_096, chunk_rows: int = 16_384) -> DataFrame:
    """The k best chunks of each question (question_id, q_embedding) but the chunk of its own number, by cosine or inner
    product: rows (question_id, rank, chunk_idx, score). Blocks of questions meet blocks of chunks as matrix products, a
    tile at a time, and only each pair of blocks' k best are shuffled; vectors of one length, a zero vector has no cosine."""
    asked, held = questions.select("question_id", "q_embedding"), chunks.select("chunk_idx", "embedding")
    left, right = _dealt(asked, held, _blocks(asked, question_rows), _blocks(held, chunk_rows))
    sign = 1 if tie_break == "first" else -1

    def search(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"question_id": [], "chunk_idx": [], "score": []})
        own, ids = x["question_id"].to_numpy(), y["chunk_idx"].to_numpy()
        a, b = np.stack(x.pop("q_embedding").to_numpy()).astype(float), np.stack(y.pop("embedding").to_numpy()).astype(float)
        row, col, score = _best(a, b, ids, k, sign, lambda u, v: _products(u, v, by_angle), own)
        return pd.DataFrame({"question_id": own[row], "chunk_idx": ids[col], "score": score})

    kinds = f"question_id {questions.schema['question_id'].dataType.simpleString()}, chunk_idx {chunks.schema['chunk_idx'].dataType.simpleString()}, score double"
    return rank(left.groupBy("q", "d").cogroup(right.groupBy("q", "d")).applyInPandas(search, kinds), k, tie_break)


def _best_in_places(questions: DataFrame, chunks: DataFrame, k: int, tie_break: str, question_rows: int = 4_096, chunk_rows: int = 16_384) -> DataFrame:
    """Of `candidates`, with their cosines: at least the k best of each question. Blocks of one place's questions and chunks
    meet as products, so that a hot place is dealt over many tasks and no pair but the best leaves its block."""
    wanted = questions.join(wanted_places(questions, chunks), "question_id")
    left, right = _dealt(wanted, chunks, _blocks(questions, question_rows), _blocks(chunks, chunk_rows))
    asked, held = [c for c in wanted.columns if not c.startswith("__")], chunks.columns
    sign = 1 if tie_break == "first" else -1

    def search(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({c: pd.Series(dtype=object) for c in (*asked, *held, "score")})
        row, col, score = _best(_matrix(x["q_embedding"]), _matrix(y["embedding"]), y["chunk_idx"].to_numpy(), k, sign, _cosines)
        found = pd.concat([x[asked].iloc[row].reset_index(drop=True), y[held].iloc[col].reset_index(drop=True)], axis=1)
        return found.assign(score=score)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for df, names in ((wanted, asked), (chunks, held)) for f in df.select(*names).schema]
    met = left.groupBy("__document", "__section", "q", "d").cogroup(right.groupBy("document", "section", "q", "d"))
    return met.applyInPandas(search, ", ".join([*kinds, "score double"])).withColumn("score", F.when(F.col("score") > float("-inf"), F.col("score")))


def rank(scored: DataFrame, k: int, tie_break: str = "first", group: str = "question_id", order: str = "chunk_idx") -> DataFrame:
    """The k best per question; of equal scores the lower ordinal is `first`, the higher `last`."""
    second = F.asc(order) if tie_break == "first" else F.desc(order)
    window = Window.partitionBy(group).orderBy(F.desc("score"), second)
    return scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def threshold(ranked: DataFrame, least: float) -> DataFrame:
    """After top-k, never before: rows without a score or below the limit go."""
    return ranked.where(F.col("score").isNotNull() & (F.col("score") >= least))


def routed_retrieve(questions: DataFrame, chunks: DataFrame, sections: DataFrame, documents: DataFrame | None = None, k: int = 3, tie_break: str = "first") -> DataFrame:
    """Questions (question_id, question, q_embedding) against chunks (chunk_idx, document, section, embedding)."""
    asked = resolve_section(questions, sections)
    asked = resolve_document(asked, documents) if documents is not None else asked.withColumn("document_filter", F.lit(None).cast("string"))
    return rank(_best_in_places(asked, chunks, k, tie_break), k, tie_break)


def query_result(ranked: DataFrame, answer: Column) -> DataFrame:
    """One row per question: answer, sources and scores in rank order, and the top score, 0 without sources."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "chunk_idx", F.coalesce("score", F.lit(0.0)).alias("score"))))
    out = ranked.groupBy("question_id").agg(listed.alias("s"), F.first(answer).alias("answer"))
    scores = F.transform("s", lambda x: x["score"])
    return out.select("question_id", "answer", F.transform("s", lambda x: x["chunk_idx"]).alias("sources"), scores.alias("scores"), F.coalesce(F.array_max(scores), F.lit(0.0)).alias("top_score"))

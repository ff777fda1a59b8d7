"""Plans whose shuffles grow with the input alone, and the same results on odd tables."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from quillspark.functions import fuzzy, vectors
from quillspark.operators import ocr, retrieve
from quillspark.plans import views
from quillspark.plans.catalogue import QUERIES

#: Queries whose words reach their page without a shuffle.
BY_DOCUMENT = ("ocr_summary", "ocr_score_exact", "ensemble_subset", "ocr_rollup", "ensemble_concat", "ocr_page_text", "ocr_score_fuzzy")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    long = " ".join(f"w{i}" for i in range(50))
    texts = [(1, long), (2, f"{long} "), (3, f"{long} x"), (4, ""), (5, None), (6, " \n  \t"), (7, f"{long}\n{long} é \U0001f600 z"), (8, "a b c"), (8, "a b c"), (8, "a b c d " + long), (None, "n m"), (9, "a\n\nb ")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(path / "documents.parquet"))
    return str(path)


@pytest.mark.parametrize("name", BY_DOCUMENT)
def test_words_are_not_shuffled_to_their_pages(spark, sf_dir, name):
    assert not re.search(r"hashpartitioning\([^)]*page_num", plan(QUERIES[name](spark, sf_dir)))


def test_listed_pages_equal_the_words_one_by_one(spark, odd):
    rows = lambda df: sorted((str(r.doc_id), r.page_num, r.engine, r.text, round(r.avg_confidence, 9)) for r in df.collect())
    assert rows(ocr.listed_results(views.ocr_pages(spark, odd))) == rows(ocr.page_results(views.ocr_words(spark, odd)))


def test_a_text_serves_all_its_needles():
    text = "The quick brown fox, the Quick red fox saw WARNING: Y near 1998 quick"
    needles = ["quick", "WARNING: X", None, "quack", "1999", "", "fox the", "quack", text + " more"]
    one = lambda n: max(fuzzy.similarity(n, " ".join(text.split()[i : i + len(n.split())])) for i in range(max(1, len(text.split()) - len(n.split()) + 1)))
    assert fuzzy.best_windows(needles, text) == [None if n is None else one(n) if n else 0.0 for n in needles]


def test_cosine_pairs_by_blocks_equal_the_expression(spark):
    rows = [(i, i % 3 if i % 7 else None, None if i == 4 else [0.0, 0.0] if i == 9 else [i / 3, 1.0 - i]) for i in range(40)]
    q = spark.createDataFrame(rows[::2], "question_id long, q_label long, q_embedding array<double>")
    c = spark.createDataFrame(rows, "chunk_idx long, label long, embedding array<double>")
    want = q.join(c, F.col("label") == F.col("q_label")).select("question_id", "chunk_idx", vectors.cosine(F.col("q_embedding"), F.col("embedding")).alias("cosine"))
    assert sorted(map(str, retrieve.cosine_pairs(q, c, ("q_label", "label"), 4, 8).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("tie", ["first", "last"])
def test_routed_ranking_by_blocks_equals_all_candidates(spark, tie):
    held = [(i, "A" if i % 3 else None, ("S", "T", None)[i % 4 % 3], [0.0, 0.0] if i in (5, 8) else [1.0 + i % 5, i % 4 - 1.0]) for i in range(30)]
    c = spark.createDataFrame(held, "chunk_idx long, document string, section string, embedding array<double>")
    q = spark.createDataFrame([(1, "S", "A", [1.0, 2.0]), (2, None, None, [1.0, 0.0]), (3, "X", "A", [0.5, -1.0]), (4, "T", None, [0.0, 0.0])], "question_id long, section_pattern string, document_filter string, q_embedding array<double>")
    scored = retrieve.candidates(q, c).withColumn("score", vectors.cosine(F.col("q_embedding"), F.col("embedding")))
    blocks = retrieve._best_in_places(q, c, 9, tie, 2, 4)
    assert blocks.columns == scored.columns and "FlatMapCoGroupsInPandas" in plan(retrieve.rank(blocks, 9, tie))
    got, want = (sorted(map(str, retrieve.rank(df, 9, tie).collect())) for df in (blocks, scored))
    assert got == want and got


def test_a_search_holds_one_tile_of_scores():
    r, seen = np.random.default_rng(1), []
    a, b, ids = r.integers(-2, 3, (11, 3)).astype(float), r.integers(-2, 3, (90, 3)).astype(float), np.arange(90)

    def scores(x, y):
        seen.append((len(x), len(y)))
        return x @ y.T

    row, col, _ = retrieve._best(a, b, ids, 5, 1, scores, np.arange(11), (4, 16))
    want = [sorted((c for c in range(90) if c != i), key=lambda c: (-(a[i] @ b[c]), c))[:5] for i in range(11)]
    assert col.reshape(11, 5).tolist() == want and row.tolist() == np.repeat(np.arange(11), 5).tolist()
    assert max(seen) <= (4, 16) and max(y for _, y in seen) == 16

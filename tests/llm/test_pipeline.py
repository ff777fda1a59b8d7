import random
import zlib

import __spark_entry__ as entry
import corpus_pipeline
import pytest
from quillspark.llm import queries, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars int, id int, label int, shard long, n long, key string, __gone0 string"
WORDS = "the river runs past a quiet mill and a field of barley where two men talk of rain and wind"


def odd_rows():
    """Nulls in every column, empty and very long texts, repeated rows, an id with two texts, a hot group of copies."""
    rest = ("en", "s", 1, 2, 3, 4, 5, "k", "g")
    rows = [(1, WORDS, *rest), (1, WORDS, *rest), (1, WORDS + " again", *rest), (2, "", *rest), (3, " \n", *rest), (4, "x" * 300_000, *rest), (5, f"{WORDS}. " * 3_000, *rest), (6, "token=abcdef123456 " + WORDS, *rest)]
    rows += [(None, WORDS, *rest), (7, None, *rest), (8, WORDS, *[None] * 9), (None, None, *[None] * 9)]
    return rows + [(100 + i, f"{WORDS} and more of it", *rest) for i in range(30)]


@pytest.fixture(scope="module", params=["odd", "empty"])
def odd_dir(spark, tmp_path_factory, request):
    path = str(tmp_path_factory.mktemp(request.param))
    keep = slice(None) if request.param == "odd" else slice(0, 0)
    write = lambda name, rows, kind: spark.createDataFrame(rows[keep], kind).write.parquet(f"{path}/{name}.parquet")
    write("documents", odd_rows(), DOCS)
    write("labels", [(1, 1, 0), (2, 0, 1), (2, 0, 1), (None, 1, 1), (8, None, None), (100, 1, 0), (101, 0, 1)], "doc_id long, quality int, toxic int")
    write("pages", [(1, "u", "<p>One line.</p>", "t"), (1, "u", "<p>One line.</p>", "t"), (None, None, None, None), (2, "", "", "")], "page_id long, url string, html string, text string")
    write("embeddings", [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (50, None, 2), (3, [0.5, None], 1), (4, [0.5, 0.5], None), (None, [1.0, 1.0], 1), (5, [], 1)], "vec_id long, embedding array<float>, rank int")
    return path


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_take_odd_and_empty_tables(spark, odd_dir, name):
    got = entry.queries()[name](spark, odd_dir).collect()
    n = len(odd_rows()) if "odd" in odd_dir else 0
    if name == "op3_html":
        assert sorted(r.text for r in got) == (["", "", "One line.", "One line."] if n else [])
    elif name == "op5_topk":
        # A row may be repeated: an id other than the query's own counts once a row, its own never.
        assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == ([(0, 1, 4, 256 * 128)] if n else [])
    elif name == "op4_packing":
        assert len({(r.doc_id, r.piece, r.bin_id, r.position) for r in got}) <= len(got) and len(got) >= n and sum(r["size"] for r in got) == sum(len((r[1] or "").encode()) for r in odd_rows()[: n or 0])
    else:
        assert len(got) == n and sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in odd_rows()[: n or 0])


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_stages_take_odd_and_empty_tables(spark, odd_dir, stage):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    out = stage[1](spark, docs, odd_dir)
    assert out.columns == docs.columns
    rows, had = out.collect(), [tuple(r) for r in docs.collect()]
    if stage[0] == "secret_scan":
        assert len(rows) == len(had) and not any("abcdef123456" in (r.text or "") for r in rows)
    else:
        assert all(tuple(r) in had for r in rows)
    if stage[0] == "ngram_jaccard" and had:
        assert sum(r.doc_id is not None and r.doc_id >= 100 for r in rows) <= 1 and sum(r.doc_id is None for r in rows) == 2


def test_the_toxicity_stage_learns_from_every_labelled_text(spark, tmp_path):
    # The only texts with the mark are longer than 64 KB, which a bounded sample left out.
    r = random.Random(8)
    words = ["".join(r.choice("aeioulmnrst") for _ in range(6)) for _ in range(400)]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    ids = [i for i in range(9_999) if zlib.crc32(str(i).encode()) % 5]
    rows = [*((line(12), 0) for _ in range(4_500)), *((line(12) + " snorlet", 1) for _ in range(600)), *((line(10_000) + " grobnik", 1) for _ in range(20))]
    docs = [(i, t) for i, (t, _) in zip(ids, rows, strict=False)] + [(20_000, "you grobnik"), (20_001, "you gr0bn1k"), (20_002, line(12))]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    spark.createDataFrame([(i, k) for i, (_, k) in zip(ids, rows, strict=False)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = dict(corpus_pipeline.STAGES)["toxicity"](spark, docs.where("doc_id >= 20000").unionByName(docs.where("doc_id < 20000")), str(tmp_path))
    model = toxicity.fit_from(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert {"grobnik", "snorlet"} <= set(model.words)
    assert not {20_000, 20_001} & {x.doc_id for x in kept.collect()}


def test_the_near_duplicate_stage_equals_brute_force(spark, sf_dir):
    from test_jaccard import brute

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 120")
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["ngram_jaccard"](spark, docs, sf_dir).collect()}
    assert kept == {i for i, n, c in brute([(r.doc_id, r.text) for r in docs.collect()], 5, 80) if i == c}


def test_stages_and_results(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    now, counts = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf_dir)
        assert now.schema == docs.schema, name
        now = spark.createDataFrame(now.collect(), docs.schema)
        counts.append(now.count())
    assert counts == sorted(counts, reverse=True) and 0 < counts[-1] < counts[0]
    kept = {r.doc_id for r in now.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == kept


def test_each_query_is_registered():
    names = entry.queries()
    assert "pipeline" in names and set(queries.QUERIES) <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_result_columns(spark, sf_dir):
    want = {
        "op1_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op2_jaccard": "doc_id n_shingles component_id", "op3_html": "page_id url text n_chars",
        "op5_topk": "query_id rank vec_id score", "op6_bpe": "doc_id n_tokens ids_sha256 decoded_sha256", "op7_toxicity": "doc_id held_out score predicted",
        "op8_quality_classifier": "doc_id held_out score predicted", "op9_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    }
    for name, columns in want.items():
        if name != "op2_jaccard":
            assert set(columns.split()) <= set(entry.queries()[name](spark, sf_dir).columns)

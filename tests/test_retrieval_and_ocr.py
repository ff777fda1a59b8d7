import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from quillspark.operators import answers, embed, evaluate, imaging, ocr, retrieve
from quillspark.sources import readers, sinks


def route(spark, question, chunks, **k):
    q = spark.createDataFrame([(1, question, [1.0, 0.0])], "question_id int, question string, q_embedding array<double>")
    c = spark.createDataFrame(chunks, "chunk_idx int, document string, section string, embedding array<double>")
    out = retrieve.routed_retrieve(q, c, retrieve.section_routes(spark), retrieve.document_routes(spark), **k)
    return [(r.chunk_idx, r.fallback) for r in out.orderBy("rank").collect()]


CHUNKS = [(0, "LIPITOR", "DOSAGE AND USE", [1.0, 0.1]), (1, "LIPITOR", "WARNING: X", [1.0, 0.0]), (2, "ZOLOFT", "DOSAGE", [1.0, 0.0]), (3, "LIPITOR", "DOSAGE AND USE", [1.0, 0.1])]


def test_document_and_section_filters(spark):
    assert route(spark, "dosage of lipitor?", CHUNKS) == [(0, False), (3, False)]
    assert route(spark, "dosage of lipitor?", CHUNKS, tie_break="last") == [(3, False), (0, False)]


def test_section_falls_back_and_document_does_not(spark):
    assert route(spark, "drug interaction of lipitor?", CHUNKS) == [(1, True), (0, True), (3, True)]
    assert route(spark, "dosage of viagra?", CHUNKS) == []


def test_the_first_phrase_of_the_table_wins(spark):
    assert route(spark, "dosage or black box warning of lipitor", CHUNKS) == [(1, False)]


def test_threshold_comes_after_top_k(spark):
    df = spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.2), (1, 2, None)], "question_id int, chunk_idx int, score double")
    assert [r.chunk_idx for r in retrieve.threshold(retrieve.rank(df, 3), 0.3).collect()] == [0]


@pytest.mark.parametrize("pattern,want", [("^DOSAGE", [0, 2, 3]), ("(WARN|DOS)[A-Z]+:", [1]), ("^.*USE$", [0, 3]), ("USE", [0, 1, 2, 3]), ("^DOSAGE|NONE", [0, 2, 3])])
def test_section_patterns_are_matched_from_the_start(spark, pattern, want):
    q = spark.createDataFrame([(1, pattern, None)], "question_id int, section_pattern string, document_filter string")
    c = spark.createDataFrame([*CHUNKS, (4, None, None, [1.0, 0.0])], "chunk_idx int, document string, section string, embedding array<double>")
    got = sorted(r.chunk_idx for r in retrieve.candidates(q, c).collect())
    assert got == (want if pattern != "USE" else [0, 1, 2, 3, 4])


def test_more_routes_and_gaps_than_are_broadcast(spark):
    many = [(i, f"phrase {i:06d}!", f"^P{i}") for i in range(retrieve.ROUTE_ROWS + 5)]
    routes = spark.createDataFrame(many, "priority int, phrase string, pattern string")
    q = spark.createDataFrame([(1, f"what of {many[-1][1]}"), (2, "none")], "question_id int, question string")
    assert {r.question_id: r.section_pattern for r in retrieve.resolve_section(q, routes).collect()} == {1: many[-1][2], 2: None}
    gaps = spark.createDataFrame([(f"B{i}", "f") for i in range(retrieve.ROUTE_ROWS + 5)], "brand string, field string")
    fields = spark.createDataFrame([("B10003", "f"), ("C", "f")], "brand_name string, field string")
    assert [r.brand_name for r in evaluate.without_gaps(fields, gaps).collect()] == ["C"]


@pytest.mark.parametrize("tie", ["first", "last"])
def test_nearest_equals_all_pairs(spark, tie):
    r = np.random.default_rng(4)
    vectors = r.integers(-3, 4, (60, 4)).astype(float)
    vectors[7] = 0
    rows = [(i, vectors[i].tolist()) for i in range(60)]
    questions, chunks = spark.createDataFrame(rows[::6], "question_id long, q_embedding array<double>"), spark.createDataFrame(rows, "chunk_idx long, embedding array<double>")
    got = {(x.question_id, x["rank"]): x.chunk_idx for x in retrieve.nearest(questions, chunks, 3, False, tie, 4, 16).collect()}
    for q in range(0, 60, 6):
        best = sorted((-(vectors[q] @ vectors[c]), c if tie == "first" else -c) for c in range(60) if c != q)[:3]
        assert [got[q, k + 1] for k in range(3)] == [abs(c) for _, c in best]
    cosines = retrieve.nearest(questions, chunks, 100, question_rows=4, chunk_rows=16).where("question_id = 6")
    assert 7 not in {x.chunk_idx for x in cosines.collect()} and cosines.count() == int(vectors.any(1).sum()) - 1
    assert retrieve.nearest(questions.limit(0), chunks, 3).count() == 0


def test_answers_come_from_the_found_texts(spark):
    chunks = spark.createDataFrame([(10, "far", [0.0, 1.0]), (11, "near", [1.0, 0.0]), (12, "mid", [1.0, 1.0])], "chunk_idx int, text string, embedding array<double>")
    q = spark.createDataFrame([(1, "which?", [1.0, 0.0])], "question_id int, question string, q_embedding array<double>")
    made = answers.Loaded(lambda: lambda prompt, settings: f" {settings.system} {settings.max_tokens}: {prompt} ")
    got = answers.answer_questions(q, chunks, {"mistral": made}, k=2).first()
    assert got.answer == "You are a precise clinical document analyst. 512: Context:\nnear\n\nmid\n\nQuestion: which?\n\nAnswer based only on the context above."
    assert got.sources == [11, 12] and got.scores[0] == got.top_score == pytest.approx(1.0) and got.error == ""
    none = answers.answer_questions(q, chunks.limit(0), {}, k=2).first()
    assert (none.sources, none.scores, none.top_score) == ([], [], 0.0) and none.error


def test_words_of_one_engine_are_filtered(spark):
    rows = [(1, 0, e, p, t, c) for e, scale in (("tesseract", 100.0), ("easyocr", 1.0)) for p, t, c in ((0, "a", 0.509 * scale), (1, " ", 0.9 * scale), (2, "b", 0.0), (3, "c", 0.7 * scale))]
    rows += [(1, 1, "tesseract", 0, " ", 90.0)]
    words = spark.createDataFrame(rows, "doc_id int, page_num int, engine string, pos int, text string, conf double")
    got = {(r.page_num, r.engine): (r.text, r.avg_confidence) for r in ocr.page_results(words).collect()}
    assert got == {(0, "tesseract"): ("a c", 60.0), (1, "tesseract"): ("", 0.0), (0, "easyocr"): ("a   b c", pytest.approx((0.509 + 0.9 + 0.0 + 0.7) / 4))}


def test_a_stored_index_knows_its_model(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id int, embedding array<double>")
    embed.build_index(df, str(tmp_path / "i"), model="minilm")
    assert embed.load_index(spark, str(tmp_path / "i"), "minilm").count() == 1
    with pytest.raises(ValueError):
        embed.load_index(spark, str(tmp_path / "i"), "bge-base")


def test_top_k_is_limited_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 as question_id", "id as chunk_idx", "rand(1) as score")
    assert "WindowGroupLimit" in retrieve.rank(df, 2)._jdf.queryExecution().toString()


def test_ensemble_compares_raw_confidences(spark):
    rows = [("d", 0, "tesseract", "t", 12.0), ("d", 0, "paddleocr", "p", 0.98), ("d", 1, "paddleocr", "q", 0.5), ("d", 1, "easyocr", "e", 0.5)]
    df = spark.createDataFrame(rows, "doc_id string, page_num int, engine string, text string, avg_confidence double")
    assert ocr.ensemble(df).first().text == "t\n\nq"
    assert ocr.ensemble(df, confidence_scale={"tesseract": 100.0}).first().text == "p\n\nq"
    assert ocr.ensemble(df, strategy="all").first().text == "t\n---\np\n\nq\n---\ne"
    assert ocr.ensemble(df, engines=("easyocr",)).first().text == "e"


def test_engines_plug_in(spark):
    ocr.register("fake", lambda image: {"text": image.decode(), "avg_confidence": 1.0, "words": [{"text": image.decode(), "conf": 1.0}]})
    df = spark.createDataFrame([("d", 0, bytearray(b"hi"))], "doc_id string, page_num int, image binary")
    assert ocr.run_engines(df, ("fake",)).first().text == "hi"
    with pytest.raises(ValueError):
        ocr.run_engines(df, ("absent",))


def test_approval_counts_twice(spark):
    kind = "struct<brand_name:string,initial_us_approval:string,revision_dates:struct<prescribing_information:string,spl_document:string,medication_guide:string>,ndc:string>"
    df = spark.createDataFrame([("d", ("B", "2006", (None, "1/2014", ""), "1"))], f"doc_id string, fields {kind}")
    got = sorted((r.field, r.value, r.field_type) for r in evaluate.scored_fields(df).collect())
    assert got == [("brand_name", "B", "text"), ("initial_us_approval", "2006", "date"), ("initial_us_approval", "2006", "text"), ("revision_dates.spl_document", "1/2014", "date")]


def test_answers_keep_errors(spark):
    q = spark.createDataFrame([(1, "why?", "because")], "question_id int, question string, context string")
    got = answers.compare_models(q, {"mistral": lambda p, settings: " " + p[:8] + " "}).orderBy("ord").collect()
    assert [(r.model, r.answer, bool(r.error)) for r in got] == [("mistral", "Context:", False), ("phi-2", "", True), ("gemini-1.5-flash", "", True)]


def test_embeddings_and_index(spark, tmp_path):
    df = embed.embed(spark.createDataFrame([("a b",), ("",)], "text string"))
    assert [round(float(np.linalg.norm(r.embedding)), 5) for r in df.collect()] == [1.0, 0.0]
    assert embed.build_index(df, str(tmp_path / "i")).count() == 2
    mixed = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "embedding array<double>")
    with pytest.raises(ValueError):
        embed.build_index(mixed)
    assert embed.model_id("minilm").endswith("MiniLM-L6-v2") and embed.model_id("own") == "own"


def test_image_kernels(spark):
    page = np.full((60, 80), 255, np.uint8)
    assert (imaging.deskew(page) == page).all()
    page[20:24, 10:70] = 0
    turned = imaging.rotate(page, 3.0)
    straight = imaging.deskew(turned)
    dark = lambda im: np.ptp(np.argwhere(im < 128)[:, 0])
    assert dark(straight) < dark(turned)
    assert set(np.unique(imaging.preprocess(np.dstack([turned] * 3)))) <= {0, 255}
    assert imaging.degrade(page, 2.5, True).shape[0] > 60
    df = spark.createDataFrame([("d", 0, 60, 80, bytearray(page.tobytes()))], "doc_id string, page_num int, height int, width int, image binary")
    assert imaging.map_images(df, imaging.binarize).first().height == 60
    angles = [r[0] for r in spark.createDataFrame([(-87.5,), (-2.5,), (-40.0,)], "a double").select(imaging.deskew_angle(F.col("a"))).collect()]
    assert angles == [-2.5, 2.5, None]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "20140820_x.json").write_text(json.dumps({"source_pdf": "x.pdf", "fields": {"brand_name": "B", "revision_dates": {"spl_document": "8/2014"}}}))
    (tmp_path / "findings.json").write_text("{}")
    rows = readers.read_ground_truth(spark, str(tmp_path)).collect()
    assert [(r.stem, r.fields.brand_name) for r in rows] == [("20140820_x", "B")]
    (tmp_path / "q.json").write_text(json.dumps({"_readme": "", "questions": [{"id": 1, "document": "d", "question": "q", "expected_phrase": "p"}]}))
    assert readers.read_eval_set(spark, str(tmp_path / "q.json")).first().question == "q"
    (tmp_path / "t.txt").write_text("one\ntwo")
    assert readers.read_texts(spark, str(tmp_path / "t.txt")).first().text == "one\ntwo"
    files = readers.read_files(spark, str(tmp_path), "*.txt")
    spans = readers.read_spans(files, lambda raw: [(0, 0, i, "text", x) for i, x in enumerate(raw.decode().split("\n"))])
    assert sorted((r.doc_id, r.text) for r in spans.collect()) == [("t", "one"), ("t", "two")]
    one = spark.createDataFrame([(2,)], "n int")
    doc = json.loads(sinks.report(one, spark.createDataFrame([(2, "b"), (1, "a")], "id int, v string"), "id").first().value)
    assert doc == {"summary": {"n": 2}, "results": [{"id": 1, "v": "a"}, {"id": 2, "v": "b"}]}


def test_streaming_front(spark, tmp_path):
    from quillspark.streaming import files

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("hello")
    q = files.run_batches(files.stream_files(spark, str(tmp_path / "in")), lambda df: df.selectExpr("doc_id", "cast(content as string) as text"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).first().text == "hello"


def test_held_out_evaluation_and_benchmark(spark):
    q = spark.createDataFrame([(1, "dosage of lipitor?", "take one tablet", [1.0, 0.0]), (2, "dosage of viagra?", "x", [1.0, 0.0])], "question_id int, question string, expected_phrase string, q_embedding array<double>")
    c = spark.createDataFrame([(0, "LIPITOR", "DOSAGE", "nothing here", [1.0, 0.0]), (1, "LIPITOR", "DOSAGE", "Take one tablet daily", [1.0, 0.2])], "chunk_idx int, document string, section string, text string, embedding array<double>")
    rows = {r.question_id: r for r in evaluate.retrieval_eval(q, c, retrieve.section_routes(spark), retrieve.document_routes(spark)).collect()}
    assert (rows[1].hit_at_1, rows[1].hit_at_k, rows[1].document_filter) == (False, True, "LIPITOR")
    assert (rows[2].hit_at_1, rows[2].hit_at_k, rows[2].top1_section) == (False, False, None)
    ocr.register("reader", lambda image: {"text": image.decode(), "avg_confidence": 0.5, "words": []})
    images = spark.createDataFrame([("d", 0, bytearray(b"Approved 8/2014 by Acme"))], "doc_id string, page_num int, image binary")
    kind = "struct<manufacturer_labeler:string,revision_dates:struct<prescribing_information:string,spl_document:string,medication_guide:string>>"
    truth = spark.createDataFrame([("d", "B", ("Acme", (None, "08/2014", None)))], f"doc_id string, brand_name string, fields {kind}")
    gaps = spark.createDataFrame([("IBRANCE", "manufacturer_labeler")], "brand string, field string")
    got = sorted((r.field, r.matched, r.matched_candidate) for r in evaluate.ocr_benchmark(images, truth, gaps, ("reader",)).collect())
    assert got == [("manufacturer_labeler", True, None), ("revision_dates.spl_document", True, "8/2014")]


def test_large_tables_are_joined_whole(spark):
    n = retrieve.ROUTE_ROWS + 500
    q = spark.createDataFrame([(1, f"about phrase{n - 1}."), (2, "about phrase7."), (3, "nothing")], "question_id int, question string")
    routes = spark.range(n).selectExpr("cast(id as int) as priority", "concat('phrase', id, '.') as phrase", "concat('^', id) as pattern").coalesce(1)
    out = retrieve.resolve_section(q, routes)
    assert {r.question_id: r.section_pattern for r in out.collect()} == {1: f"^{n - 1}", 2: "^7", 3: None}
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    few = retrieve.resolve_section(q, routes.where("priority < 10"))
    assert {r.question_id: r.section_pattern for r in few.collect()} == {1: None, 2: "^7", 3: None}
    fields = spark.createDataFrame([(f"b{n - 1}", "f"), ("b3", "f"), ("other", "f")], "brand_name string, field string")
    gaps = spark.range(n).selectExpr("concat('b', id) as brand", "'f' as field").coalesce(1)
    assert [r.brand_name for r in evaluate.without_gaps(fields, gaps).collect()] == ["other"]

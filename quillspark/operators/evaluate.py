"""Scoring against ground truth and the roll-ups of the scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DATE_FIELDS, EXCLUDED_FIELDS, MATCH_THRESHOLD
from ..functions.dates import first_match, granularity, parse_any, parsed_candidates
from ..functions.fuzzy import is_match, window_scores
from . import ocr, retrieve


def scored_fields(truth: DataFrame, fields: str = "fields") -> DataFrame:
    """Ground-truth rows as (…, field, value, field_type): date fields by their paths, then all other text fields.
    Null and empty values go. A text field that is also a date field counts twice."""
    rest = [c for c in truth.columns if c != fields]
    kinds = {f.name: f.dataType.simpleString() for f in truth.schema[fields].dataType.fields}

    def long(pairs: list[tuple[str, str]], kind: str) -> DataFrame:
        entries = F.array(*(F.struct(F.lit(n).alias("field"), F.col(f"{fields}.{p}").alias("value")) for n, p in pairs))
        out = truth.select(*rest, F.explode(entries).alias("e"))
        return out.select(*rest, "e.field", "e.value", F.lit(kind).alias("field_type")).where("value is not null and value <> ''")

    dates = [(p, p) for p in DATE_FIELDS if p.split(".")[0] in kinds]
    texts = [(n, n) for n, k in kinds.items() if n not in EXCLUDED_FIELDS and k == "string"]
    return long(dates, "date").unionByName(long(texts, "text"))


def without_gaps(fields: DataFrame, gaps: DataFrame, brand: str = "brand_name") -> DataFrame:
    """Leaves out known gaps (brand, field)."""
    known = F.broadcast(gaps) if retrieve.is_small(gaps) else gaps
    return fields.join(known, (fields[brand] == gaps["brand"]) & (fields["field"] == gaps["field"]), "left_anti")


def score_documents(texts: DataFrame, fields: DataFrame, key: str = "doc_id", threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """Each engine's document text (key, engine, text, confidence) against the document's fields: dates by strict
    equality at their granularity, texts by the best fuzzy window. A document's few fields travel as one array, their dates
    parsed once; a text is searched for dates once and goes to Python once, for all its fields."""
    own = [c for c in fields.columns if c != key]
    dated = fields.withColumn("__value", F.when(F.col("field_type") == "date", F.col("value")))
    dated = dated.select("*", granularity(F.col("__value")).alias("__grain"), parse_any(F.col("__value")).alias("__date"))
    listed = dated.groupBy(key).agg(F.collect_list(F.struct(*own, "__grain", "__date")).alias("__fields"))
    needles = F.transform("__fields", lambda f: F.when(f["field_type"] == "text", f["value"]))
    scored = texts.join(listed, key).withColumn("__scores", window_scores(needles, F.col("text")))
    found = F.transform(F.array(parsed_candidates(F.col("text"))), lambda p: F.transform("__fields", lambda f: F.when(f["field_type"] == "date", first_match(f["__date"], f["__grain"], p))))[0]
    rest = [c for c in texts.columns if c != "text"]
    rows = scored.select(*rest, F.explode(F.arrays_zip(F.col("__fields").alias("f"), F.col("__scores").alias("score"), found.alias("candidate"))).alias("x"))
    is_date, candidate = F.col("x.f.field_type") == "date", F.col("x.candidate")
    score = F.when(is_date, candidate.isNotNull().cast("double")).otherwise(F.col("x.score"))
    verdict = F.when(is_date, candidate.isNotNull()).otherwise(F.col("x.score") >= threshold)
    out = rows.where(F.col("x.f.field_type").isin("date", "text")).select(*rest, *(F.col(f"x.f.{c}").alias(c) for c in own), candidate.alias("matched_candidate"), verdict.alias("matched"), F.bround(score, 3).alias("score"))
    return out.withColumn("confidence", F.bround("confidence", 3))


def score_exact(texts: DataFrame, fields: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each engine's document text against the document's fields, by plain containment. A document's few fields travel as
    one array, so a text moves through the join once and not once a field."""
    listed = fields.groupBy(key).agg(F.collect_list(F.struct("field", "field_type", "value")).alias("fields"))
    tests = F.transform("fields", lambda f: F.struct(f["field"].alias("field"), f["field_type"].alias("field_type"), F.contains(F.col("text"), f["value"]).alias("matched")))
    return texts.join(listed, key).select(key, "engine", "confidence", F.explode(tests).alias("t")).select(key, "engine", "t.*", "confidence")


def by_score(ranked: DataFrame, text: str = "text", score: str = "score") -> DataFrame:
    """Lengths and scores of all retrieved chunks, the best first."""
    return ranked.select("question_id", F.length(text).alias("n_chars"), F.col(score).alias("score")).orderBy(F.desc("score"), "question_id", "n_chars")


def same_winner(first: DataFrame, second: DataFrame) -> DataFrame:
    """The best chunk of each question under two embedding models, and whether they agree."""
    best = lambda df, name: df.where("rank = 1").select("question_id", F.col("chunk_idx").alias(name))
    return best(first, "first").join(best(second, "second"), "question_id", "full").withColumn("same", F.coalesce(F.col("first") == F.col("second"), F.lit(False)))


def intent_gap(compound: DataFrame, single: DataFrame) -> DataFrame:
    """Of rankings of a compound question and of its single intents (with a column `compound_id`): the best score of each
    intent, and how far the compound question's best score lies below it."""
    top = compound.where("rank = 1").select(F.col("question_id").alias("compound_id"), F.col("score").alias("compound_score"))
    return single.where("rank = 1").join(top, "compound_id").select("compound_id", "question_id", "score", (F.col("score") - F.col("compound_score")).alias("gap"))


def summarize(scores: DataFrame, keys: list[str]) -> DataFrame:
    return scores.groupBy(*keys).agg(F.count_if("matched").alias("n_matched"), F.count("*").alias("n_total"), F.avg(F.col("matched").cast("int")).alias("rate"), F.min("confidence").alias("confidence"))


def roll_up(scores: DataFrame) -> DataFrame:
    """By engine, by engine and field type, and by engine and document, in one pass of grouping sets."""
    return scores.groupingSets([["engine"], ["engine", "field_type"], ["engine", "doc_id"]], "engine", "field_type", "doc_id").agg(
        F.grouping_id("engine", "field_type", "doc_id").cast("int").alias("level"), F.count_if("matched").alias("n_matched"), F.count("*").alias("n_total")
    )


def retrieval_summary(ranked: DataFrame, questions: DataFrame, hit: str = "hit") -> DataFrame:
    """accuracy@1, hit@3 and the counts; questions without any result count as missed."""
    per = ranked.groupBy("question_id").agg(F.max(F.when(F.col("rank") == 1, F.col(hit))).alias("h1"), F.max(F.when(F.col("rank") <= 3, F.col(hit))).alias("h3"))
    all_ = questions.select("question_id").join(per, "question_id", "left")
    of = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("int"))
    return all_.agg(of("h1").alias("accuracy_at_1"), of("h3").alias("hit_at_3"), F.count("*").alias("n_questions"))


def length_score_correlation(ranked: DataFrame, text: str = "text", score: str = "score") -> DataFrame:
    return ranked.agg(F.corr(F.length(text).cast("double"), score).alias("correlation"))


def inventory_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows in one chunk inventory and not in the other, copies counted."""
    return old.exceptAll(new).withColumn("side", F.lit("old")).unionByName(new.exceptAll(old).withColumn("side", F.lit("new")))


def ocr_benchmark(images: DataFrame, truth: DataFrame, gaps: DataFrame, engines: tuple[str, ...], scale: dict[str, float] | None = None) -> DataFrame:
    """The whole OCR benchmark: page images through the engines, texts per document, scores per field."""
    pages = ocr.run_engines(images, engines)
    return score_documents(ocr.document_results(pages, scale), without_gaps(scored_fields(truth), gaps))


def retrieval_eval(questions: DataFrame, chunks: DataFrame, sections: DataFrame, documents: DataFrame, k: int = 3, limit: float = MATCH_THRESHOLD) -> DataFrame:
    """The held-out evaluation, one row per question (question_id, question, expected_phrase, q_embedding): what was
    resolved, the best chunk with its cosine and fuzzy score, and whether the phrase is in the first or in any result."""
    ranked = retrieve.routed_retrieve(questions, chunks, sections, documents, k, "last").withColumn("m", is_match(F.col("expected_phrase"), F.col("text"), limit))
    first = lambda c: F.max(F.when(F.col("rank") == 1, c))
    per = ranked.groupBy("question_id").agg(
        first(F.col("section")).alias("top1_section"), first(F.bround("score", 4)).alias("top1_cosine"), first(F.bround("m.score", 3)).alias("top1_fuzzy_score"), first(F.col("m.matched")).alias("hit_at_1"), F.max("m.matched").alias("hit_at_k")
    )
    asked = retrieve.resolve_document(retrieve.resolve_section(questions.select("question_id", "question", "expected_phrase"), sections), documents)
    return asked.join(per, "question_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("hit_at_1", "hit_at_k")})

"""Page tags and document boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_of, strip

# Patterns of document types, sections and dates, in order of priority, and of boundary signals.
DOC_TYPES = [
    ("CSR", r"(?idU)Clinical\s+Study\s+Report"),
    ("IB", r"(?idU)Investigator\s+Brochure"),
    ("Protocol", r"(?idU)\bProtocol\b(?!\s+Number|\s+No)"),
    ("ICF", r"(?idU)Informed\s+Consent"),
    ("AE_Report", r"(?idU)Adverse\s+Event\s+Report"),
    ("SAP", r"(?idU)Statistical\s+Analysis\s+Plan"),
]
SECTIONS = [
    ("synopsis", r"(?idU)\bSYNOPSIS\b"),
    ("methods", r"(?idU)\b(?:METHODS|STUDY\s+DESIGN)\b"),
    ("results", r"(?idU)\bRESULTS\b"),
    ("safety", r"(?idU)\b(?:SAFETY|ADVERSE\s+EVENTS?)\b"),
    ("efficacy", r"(?idU)\bEFFICACY\b"),
]
DATE = r"(?idU)(?:Date\s*[:\-]?\s*)?(\d{1,2}[\s\-/]\w{3,9}[\s\-/]\d{4}|\w{3,9}\s+\d{1,2},?\s+\d{4}|\d{4}-\d{2}-\d{2})"
BOUNDARY_SIGNALS = [
    r"(?imdU)^\s*(?:CONFIDENTIAL|PROPRIETARY)\s*$",
    r"(?idU)(?:Protocol|Study)\s+(?:Number|No\.?|#)\s*[:\-]?\s*[A-Z0-9\-]{4,}",
    r"(?idU)\bTable\s+of\s+Contents\b",
    r"(?imdU)^1\.\s+(?:INTRODUCTION|BACKGROUND|SYNOPSIS)\s*$",
]


def tag_page(df: DataFrame, text: Column | None = None) -> DataFrame:
    t = F.col("text") if text is None else text
    return df.withColumns({"doc_type": first_of(t, DOC_TYPES), "section": first_of(t, SECTIONS), "date": F.nullif(strip(F.regexp_extract(t, DATE, 1)), F.lit(""))})


def boundary_score(text: Column) -> Column:
    hits = sum((text.rlike(p).cast("int") for p in BOUNDARY_SIGNALS), F.lit(0))
    return hits / F.lit(float(len(BOUNDARY_SIGNALS)))


def detect_boundaries(pages: DataFrame) -> DataFrame:
    """Documents within page streams: (doc_id, start_page, end_page, confidence). Page 0 starts one; so does a page of
    score 0.5 or more behind one below 0.3, and page 1 whatever page 0 scored. No pages give no rows."""
    order = Window.partitionBy("doc_id").orderBy("page_num")
    scored = pages.withColumn("score", boundary_score(F.col("text")))
    start = (F.col("page_num") == 0) | ((F.col("score") >= 0.5) & ((F.lag("score").over(order) < 0.3) | (F.col("page_num") == 1)))
    segments = scored.withColumn("segment", F.sum(F.coalesce(start, F.lit(False)).cast("int")).over(order))
    return segments.groupBy("doc_id", "segment").agg(F.min("page_num").alias("start_page"), F.max("page_num").alias("end_page"), F.avg("score").alias("confidence")).drop("segment")

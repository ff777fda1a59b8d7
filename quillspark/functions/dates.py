"""Dates of year, month or day granularity."""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Forms of date candidates in running text.
CANDIDATES = (
    r"(?d)\b\d{1,2}/\d{1,2}/\d{4}\b|\b\d{1,2}/\d{4}\b"
    r"|\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4}\b"
    r"|\b(?:19|20)\d{2}\b"
)


def candidates(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CANDIDATES), F.lit(0))


def granularity(value: Column) -> Column:
    v = strip(value)
    return F.when(v.rlike(r"^(19|20)\d{2}$"), "year").when(v.rlike(r"^\d{1,2}/\d{4}$"), "month").otherwise("day")


FORMS = (
    "M/d/yyyy", "M/yyyy", "MMMM d yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy", "MMMM yyyy", "MMM yyyy", "yyyy MMMM d", "yyyy MMM d", "d-MMM-yyyy", "M-d-yyyy", "yyyy-M-d", "yyyy/M/d", "yyyy-M", "yyyy/M", "yyyyMMdd", "yyyy",
)


def parse(value: Column) -> Column:
    """The date, with missing parts as in January 1st; null for what is none of the known forms. Commas, full stops after
    words, ordinal endings and capitals play no part."""
    v = F.regexp_replace(F.lower(strip(value)), r",|(?<=[a-z])\.|(?<=\d)(st|nd|rd|th)\b", " ")
    v = F.regexp_replace(F.regexp_replace(strip(v), r"\s+", " "), r"\bsept\b", "sep")
    v = F.when(v.rlike("[a-z]"), F.initcap(F.regexp_replace(v, r"-(?=[a-z])", "- "))).otherwise(v)
    v = F.regexp_replace(v, "- ", "-")
    return F.coalesce(*(F.try_to_date(v, f) for f in FORMS))


def parse_candidate(value: Column) -> Column:
    """As `parse`, for the forms of candidates alone."""
    return F.coalesce(*(F.try_to_date(F.regexp_replace(value, r"(?U)\s+", " "), f) for f in ("M/d/yyyy", "M/yyyy", "MMMM yyyy", "yyyy")))


def _lenient(values: pd.Series) -> pd.Series:
    from dateutil import parser

    start = datetime(2000, 1, 1)

    def one(v: str | None) -> str | None:
        try:
            return None if v is None else f"{parser.parse(v, default=start):%Y-%m-%d}"
        except (ValueError, OverflowError):
            return None

    return pd.Series([one(v) for v in values], dtype=object)


def parse_any(value: Column) -> Column:
    """As `parse`; what is none of its forms is read leniently, missing parts as in January 1st, 2000."""
    known = parse(value)
    return F.coalesce(known, F.try_to_date(F.pandas_udf(_lenient, "string")(F.when(known.isNull(), value)), "yyyy-MM-dd"))


def equal_at(x: Column, y: Column, grain: Column) -> Column:
    """Whether two dates agree at a granularity; false where either is none."""
    same = F.year(x) == F.year(y)
    month = same & (F.month(x) == F.month(y))
    day = month & (F.dayofmonth(x) == F.dayofmonth(y))
    return F.coalesce(F.when(grain == "year", same).when(grain == "month", month).otherwise(day), F.lit(False))


def matching(truth: Column, text: Column) -> Column:
    """All candidates in the text that equal the truth at its granularity, in text order."""
    grain, date_ = granularity(truth), parse_any(truth)
    # The truth's date is an argument and not part of the lambda, where no Python function may stand.
    return F.flatten(F.transform(F.array(date_), lambda d: F.filter(candidates(text), lambda c: equal_at(d, parse_candidate(c), grain))))


def parsed_candidates(text: Column) -> Column:
    """All candidates in the text with their dates, in text order."""
    return F.transform(candidates(text), lambda c: F.struct(c.alias("candidate"), parse_candidate(c).alias("date")))


def first_match(date_: Column, grain: Column, parsed: Column) -> Column:
    """Of `parsed_candidates`, the first that equals a date (of `parse_any`) at a granularity, or null."""
    return F.get(F.filter(parsed, lambda c: equal_at(date_, c["date"], grain)), F.lit(0))["candidate"]

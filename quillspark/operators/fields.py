"""Regex fields of label and study texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import last_group

# The patterns of the fields and the number of their groups.
FIELDS = {
    "protocol_number": (r"(?id)(?:protocol\s+(?:number|no\.?|#)\s*[:\-]?\s*)([A-Z0-9\-]{4,20})|\b((?:NDA|BLA)\s?\d{5,7})\b", 2),
    "sponsor": (
        r"(?idU)(?:sponsor\s*[:\-]?\s*)([A-Za-z][\w\s,\.]+?)(?:\n|$)|(?:Labeler\s*-\s*)([A-Za-z][\w\s,\.&]+?)(?:\s*\(|\n|$)"
        r"|(?:(?:Distributed|Manufactured|Marketed)\s+by\s*[:\-]?\s*)([A-Za-z][\w\s,\.&]+?)(?:\n|$)",
        3,
    ),
    "study_title": (r"(?id)(?:(?:study|trial)\s+title\s*[:\-]?\s*)(.{10,200}?)(?:\n|$)", 1),
    "phase": (r"(?id)\bPhase\s+(I{1,3}V?|[1-4](?:[Aa]|[Bb])?)\b", 1),
    "indication": (r"(?d)INDICATIONS AND USAGE\s+(.{10,400}?)(?:\n|$)", 1),
    "document_date": (r"(?idU)(?:date\s*[:\-]?\s*)(\d{1,2}[\s\-/]\w+[\s\-/]\d{2,4}|\w+\s+\d{1,2},?\s+\d{4})|(?:Revised\s*[:\-]?\s*)(\d{1,2}/\d{4}|\w+\s+\d{4})", 2),
    "document_type": (
        r"(?id)\b(Clinical\s+Study\s+Report|Investigator\s+Brochure|Protocol\s+Amendment|Informed\s+Consent|Adverse\s+Event\s+Report"
        r"|Highlights\s+of\s+Prescribing\s+Information|Prescribing\s+Information|Drug\s+Facts|Medication\s+Guide)\b",
        1,
    ),
}


def parse_fields(df: DataFrame, text: Column | None = None) -> DataFrame:
    """Seven nullable columns: of each field the leftmost match."""
    t = F.col("text") if text is None else text
    return df.withColumns({name: last_group(t, pattern, groups) for name, (pattern, groups) in FIELDS.items()})

"""Section-aware chunking of label texts.

A run is a series of header lines with nothing but blank lines between. Each run gives at most one chunk: it starts
at the run's first WARNING: header if there is one, else at its last header; its label joins the headers from there
on, its text goes up to the next run. Text before the first header is lost, as is a run without a body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ordered_text, strip

# Fixed value: a header line.
HEADER = r"(?d)^(WARNING:[A-Z0-9 ,:/&\-()]{2,112}|[A-Z][A-Z0-9 ,:/&\-]{9,120})$"
_BREAK = r"\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x85\u2028\u2029]"


def is_header(line: Column) -> Column:
    return line.rlike(HEADER)


def lines_of(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per line, with its ordinal."""
    return df.select(*[c for c in df.columns if c != text], F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))


def section_chunks(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks (key, chunk_idx, section, text) of line rows (key, line_no, line)."""
    order = Window.partitionBy(key).orderBy("line_no")
    marked = lines.select(key, "line_no", "line", is_header(F.col("line")).alias("head"), (strip(F.col("line")) == "").alias("blank"))
    before = F.last(F.when(~F.col("blank"), F.col("head")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = marked.withColumn("run", F.sum((F.col("head") & ~F.coalesce(before, F.lit(False))).cast("int")).over(order)).where("run > 0")
    item = F.struct("line_no", "line", "head", "blank")
    grouped = runs.groupBy(key, "run").agg(F.array_sort(F.collect_list(item)).alias("lines"))
    heads = F.filter("lines", lambda x: x["head"])
    warning = F.filter(heads, lambda x: x["line"].startswith("WARNING:"))
    first = F.when(F.size(warning) > 0, F.try_element_at(warning, F.lit(1))["line_no"]).otherwise(F.element_at(heads, -1)["line_no"])
    grouped = grouped.withColumns({"start": first, "last": F.element_at(heads, -1)["line_no"]})
    body = F.filter("lines", lambda x: x["line_no"] > F.col("last"))
    text = strip(F.array_join(F.transform(F.filter("lines", lambda x: x["line_no"] >= F.col("start")), lambda x: x["line"]), "\n"))
    label = F.array_join(F.transform(F.filter("lines", lambda x: x["head"] & (x["line_no"] >= F.col("start"))), lambda x: strip(x["line"])), " ")
    rest = strip(F.array_join(F.transform(body, lambda x: x["line"]), "\n"))
    opening = strip(F.element_at(F.split(rest, _BREAK), 1))
    absorb = label.startswith("WARNING:") & ~F.lower(opening).startswith("see full prescribing")
    out = grouped.select(key, "run", label.alias("label"), text.alias("text"), rest.alias("rest"), F.when(absorb, F.concat(label, F.lit(" "), opening)).otherwise(label).alias("section")).where("rest <> ''")
    return out.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("run")) - 1).alias("chunk_idx"), "section", "text")


def highlights(pages: DataFrame, brand: Column, limit: int = 2) -> DataFrame:
    """Section chunks of the first pages of each document, tagged with its brand."""
    text = ordered_text(pages.where(F.col("page_num") < limit), ["doc_id"], ["page_num"], "text", "\n")
    return section_chunks(lines_of(text)).withColumn("document", brand)

"""Writers of results."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_rows(df: DataFrame, path: str) -> None:
    """Score rows as JSON lines, one file a partition."""
    df.write.mode("overwrite").json(path)


def report(summary: DataFrame, rows: DataFrame, order: str, most: int = 100_000) -> DataFrame:
    """One JSON document {summary, results} of a summary row and a table of result rows. The document is made in one
    task, so more than `most` rows are an error; `write_rows` takes any number."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows for one document")
    results = rows.agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in rows.columns if c != order]))).alias("results"))
    one = summary.select(F.struct(*summary.columns).alias("summary")).crossJoin(results)
    return one.select(F.to_json(F.struct("summary", "results")).alias("value"))


def write_report(summary: DataFrame, rows: DataFrame, order: str, path: str) -> None:
    report(summary, rows, order).write.mode("overwrite").text(path)


def write_index(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_image_pdfs(images: DataFrame, writer: Callable[[str, list[tuple[int, int, int, bytes]]], int]) -> DataFrame:
    """Hands each document's page images, in order, to a backend that writes its PDF and gives the bytes written."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("page_num")
        pages = list(zip(pdf["page_num"], pdf["height"], pdf["width"], pdf["image"], strict=True))
        return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[:1], "n_bytes": [writer(pdf["doc_id"].iloc[0], pages)]})

    return images.groupBy("doc_id").applyInPandas(run, "doc_id string, n_bytes long")


def score_lines(summary: DataFrame) -> DataFrame:
    """Lines for the console."""
    return summary.select(F.format_string("%-12s %4d/%-4d %6.1f%%", "engine", "n_matched", "n_total", F.col("rate") * 100).alias("line"))


def show(df: DataFrame, n: int = 50) -> None:
    df.show(n, truncate=False)


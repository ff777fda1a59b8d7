"""Text of pages and documents from blocks, spans and fragments."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ROW_TOLERANCE
from ..functions.text import ordered_text, strip


def blocks_from_spans(spans: DataFrame) -> DataFrame:
    """Blocks of span rows (doc_id, page_num, block_idx, span_idx, block_type, text): text blocks join their spans by
    one space and fall away when empty; image blocks have no text."""
    text = ordered_text(spans.where("block_type = 'text'"), ["doc_id", "page_num", "block_idx"], ["span_idx"], "text", " ")
    text = text.select("doc_id", "page_num", "block_idx", strip(F.col("text")).alias("text"), F.lit("text").alias("block_type")).where("text <> ''")
    images = spans.where("block_type = 'image'").select("doc_id", "page_num", "block_idx", F.lit("").alias("text"), F.lit("image").alias("block_type")).distinct()
    return text.unionByName(images)


def full_text(blocks: DataFrame) -> DataFrame:
    return ordered_text(blocks.where("block_type = 'text'"), ["doc_id"], ["page_num", "block_idx"], "text", "\n")


def page_text(blocks: DataFrame) -> DataFrame:
    return ordered_text(blocks.where("block_type = 'text'"), ["doc_id", "page_num"], ["block_idx"], "text", "\n")


def iter_pages(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """Every page of every document (doc_id, num_pages), blank ones with an empty text."""
    pages = documents.where("num_pages > 0").select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("num_pages") - 1).cast("int"))).alias("page_num"))
    return pages.join(page_text(blocks), ["doc_id", "page_num"], "left").select("doc_id", "page_num", F.coalesce("text", F.lit("")).alias("text"))


def first_pages(df: DataFrame, limit: int) -> DataFrame:
    return df.where(F.col("page_num") < limit)


def fragments_from_spans(spans: DataFrame) -> DataFrame:
    """Lines of span rows (doc_id, page_num, frag_idx, span_idx, y0, x0, text), joined by spaces, empty ones dropped."""
    lines = ordered_text(spans, ["doc_id", "page_num", "frag_idx", "y0", "x0"], ["span_idx"], "text", " ")
    return lines.withColumn("text", strip(F.col("text"))).where("text <> ''")


def reading_order(fragments: DataFrame, tolerance: float = ROW_TOLERANCE) -> DataFrame:
    """Page texts in reading order. A visual row takes the fragments within `tolerance` of its first fragment's y0;
    rows are sorted by x0 and joined by spaces, pages join rows by newlines. The engine sorts each page's fragments, one
    pass over them then anchors the rows, so time follows the number of fragments."""
    keys = ["doc_id", "page_num"]
    ordered = fragments.select(*keys, "y0", "x0", "frag_idx", "text").repartition(*keys).sortWithinPartitions(*keys, "y0", "x0", "frag_idx")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, anchor, row, lines = None, 0.0, [], []
        done: tuple[list, list, list] = ([], [], [])

        def close() -> None:
            if key is not None:
                lines.append(" ".join([t for _, t in sorted(row)]))
                for column, value in zip(done, (*key, "\n".join(lines)), strict=True):
                    column.append(value)

        for pdf in frames:
            for doc, page, y, x, text in zip(*(pdf[c].tolist() for c in (*keys, "y0", "x0", "text")), strict=True):
                if (doc, page) != key:
                    close()
                    key, anchor, row, lines = (doc, page), y, [], []
                elif abs(y - anchor) > tolerance:
                    lines.append(" ".join([t for _, t in sorted(row)]))
                    anchor, row = y, []
                row.append((x, text))
            if done[0]:
                yield pd.DataFrame(dict(zip((*keys, "text"), done, strict=True)))
            done = ([], [], [])
        close()
        if done[0]:
            yield pd.DataFrame(dict(zip((*keys, "text"), done, strict=True)))

    schema = ", ".join(f"{c} {fragments.schema[c].dataType.simpleString()}" for c in keys)
    return ordered.mapInPandas(run, f"{schema}, text string")

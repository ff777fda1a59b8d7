"""Readers: files, ground truth, question sets and stored indexes. PDF parsers plug in as callables."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

#: bytes of a file -> rows of (page_num, …); see each reader for the columns.
Parser = Callable[[bytes], list[tuple]]


def stem(path: str = "path"):
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files as (doc_id, content); doc_id is the name without its ending."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(stem().alias("doc_id"), "content")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file."""
    return spark.read.text(path, wholetext=True).select(stem("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def parse_files(files: DataFrame, parser: Parser, columns: str) -> DataFrame:
    """Rows of each file, opened once; one file is held at a time. A file that cannot be parsed raises."""
    names = ["doc_id", *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, raw in zip(pdf["doc_id"], pdf["content"], strict=True):
                yield pd.DataFrame([(doc, *row) for row in parser(bytes(raw))], columns=names)

    return files.select("doc_id", "content").mapInPandas(run, f"doc_id string, {columns}")


def read_spans(files: DataFrame, parser: Parser) -> DataFrame:
    return parse_files(files, parser, "page_num int, block_idx int, span_idx int, block_type string, text string")


def read_fragments(files: DataFrame, parser: Parser, max_pages: int | None = None) -> DataFrame:
    """Line fragments; `max_pages` is the parser's business too, and is held to here."""
    out = parse_files(files, parser, "page_num int, frag_idx int, span_idx int, y0 double, x0 double, text string")
    return out if max_pages is None else out.where(F.col("page_num") < max_pages)


def read_tables(files: DataFrame, parser: Parser) -> DataFrame:
    return parse_files(files, parser, "page_num int, table_idx int, rows array<array<string>>")


def read_page_images(files: DataFrame, rasterizer: Parser) -> DataFrame:
    return parse_files(files, rasterizer, "page_num int, height int, width int, image binary")


def read_ground_truth(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON file per document, named by its stem; other files of the folder begin with letters and are left out."""
    df = spark.read.schema(schemas.GROUND_TRUTH).option("multiLine", True).option("pathGlobFilter", "[0-9]*.json").json(folder)
    return df.withColumn("stem", stem("_metadata.file_path"))


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EVAL_SET).option("multiLine", True).json(path).select(F.explode("questions").alias("q")).select("q.*")


def read_qa_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.QA_SET).option("multiLine", True).json(path)


def read_scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SCAN_MANIFEST).option("multiLine", True).json(path).select(F.explode("documents").alias("d")).select("d.*")


def secret(name: str) -> str:
    """A key from the driver's environment; never put into a closure."""
    value = os.environ.get(name)
    if not value:
        raise OSError(f"{name} is not set")
    return value

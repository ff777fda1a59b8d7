"""OCR results: word filter, confidences, ensembles; engines plug in as callables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIDENCE_SCALE, ENGINES, FILTERED_ENGINES
from ..functions.text import blank, joined, ordered_text

Engine = Callable[[bytes], dict]
_engines: dict[str, Engine] = {}


def register(name: str, engine: Engine) -> None:
    """An engine takes a page image and gives {"text", "avg_confidence", "words": [{"text", "conf"}]}."""
    _engines[name] = engine


def usable_words(words: DataFrame) -> DataFrame:
    """Words with text and a whole confidence above zero."""
    return words.where(is_usable(F.col("text"), F.col("conf")))


def is_usable(text: Column, conf: Column) -> Column:
    return ~blank(text) & (conf.cast("int") > 0)


def page_results(words: DataFrame, separator: str = " ", filtered: tuple[str, ...] = FILTERED_ENGINES) -> DataFrame:
    """Text and mean confidence per page and engine, '' and 0 where no word is left. Of `filtered` engines only usable
    words count, with their whole confidences; the others give words that count as they are."""
    own = F.col("engine").isin(*filtered)
    counts = ~own | F.coalesce(is_usable(F.col("text"), F.col("conf")), F.lit(False))
    conf = F.when(own, F.col("conf").cast("int").cast("double")).otherwise(F.col("conf"))
    counted = words.select("doc_id", "page_num", "engine", "pos", F.when(counts, F.col("text")).alias("text"), F.when(counts, conf).alias("conf"))
    return counted.groupBy("doc_id", "page_num", "engine").agg(joined("text", "pos", separator).alias("text"), F.coalesce(F.avg("conf"), F.lit(0.0)).alias("avg_confidence"))


def listed_results(pages: DataFrame, separator: str = " ", filtered: tuple[str, ...] = FILTERED_ENGINES) -> DataFrame:
    """As `page_results`, from pages with their words in order (doc_id, page_num, engine, texts, confs). Each page is
    settled within its row, so nothing is shuffled; two rows of one page stay two."""
    own = F.col("engine").isin(*filtered)
    usable = F.filter(F.arrays_zip("texts", "confs"), lambda w: is_usable(w["texts"], w["confs"]))
    texts = F.when(own, F.transform(usable, lambda w: w["texts"])).otherwise(F.col("texts"))
    confs = F.when(own, F.transform(usable, lambda w: w["confs"].cast("int").cast("double"))).otherwise(F.filter("confs", F.isnotnull))
    read = pages.select("doc_id", "page_num", "engine", F.array_join(texts, separator).alias("text"), confs.alias("confs"))
    mean = F.try_divide(F.aggregate("confs", F.lit(0.0), lambda s, c: s + c), F.size("confs"))
    return read.select("doc_id", "page_num", "engine", "text", F.coalesce(mean, F.lit(0.0)).alias("avg_confidence"))


def scaled(conf: Column, engine: Column, scale: dict[str, float] | None = None) -> Column:
    """Confidence over the engine's scale, 1 for engines without one."""
    scale = CONFIDENCE_SCALE if scale is None else scale
    by = F.lit(1.0)
    for name, s in scale.items():
        by = F.when(engine == name, F.lit(float(s))).otherwise(by)
    return conf / by


def document_results(pages: DataFrame, scale: dict[str, float] | None = None) -> DataFrame:
    """Text of all pages, and the unweighted mean of the page means over the engine's scale."""
    both = pages.groupBy("doc_id", "engine").agg(joined("text", "page_num", "\n").alias("text"), F.avg("avg_confidence").alias("mean"))
    return both.withColumn("confidence", scaled(F.col("mean"), F.col("engine"), scale)).drop("mean")


def engine_order(engine: Column, engines: tuple[str, ...] = ENGINES) -> Column:
    return F.array_position(F.array(*map(F.lit, engines)), engine)


def ensemble(pages: DataFrame, engines: tuple[str, ...] = ENGINES, strategy: str = "best_confidence", confidence_scale: dict[str, float] | None = None) -> DataFrame:
    """One text per document. `best_confidence` takes each page from the most confident engine, the first of equals,
    and joins pages by a blank line; any other strategy joins all engines' texts page by page. Confidences are raw
    unless scales are given."""
    chosen = pages.where(F.col("engine").isin(*engines)).withColumn("ord", engine_order(F.col("engine"), engines))
    if strategy != "best_confidence":
        per_page = ordered_text(chosen, ["doc_id", "page_num"], ["ord"], "text", "\n---\n")
        return ordered_text(per_page, ["doc_id"], ["page_num"], "text", "\n\n")
    conf = scaled(F.col("avg_confidence"), F.col("engine"), confidence_scale or {})
    best = chosen.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "page_num").orderBy(conf.desc(), "ord"))).where("r = 1")
    return ordered_text(best, ["doc_id"], ["page_num"], "text", "\n\n")


def best_engines(pages: DataFrame, engines: tuple[str, ...] = ENGINES, confidence_scale: dict[str, float] | None = None) -> DataFrame:
    """The page rows that `ensemble` takes."""
    chosen = pages.where(F.col("engine").isin(*engines)).withColumn("ord", engine_order(F.col("engine"), engines))
    conf = scaled(F.col("avg_confidence"), F.col("engine"), confidence_scale or {})
    return chosen.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "page_num").orderBy(conf.desc(), "ord"))).where("r = 1").drop("r", "ord")


def run_engines(images: DataFrame, engines: tuple[str, ...] = ENGINES) -> DataFrame:
    """OCR of image rows (doc_id, page_num, image) by registered engines; engines are chosen before any image is read."""
    chosen = {e: _engines[e] for e in engines if e in _engines}
    missing = [e for e in engines if e not in _engines]
    if missing:
        raise ValueError(f"no such OCR engine: {', '.join(missing)}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(d, p, name, r["text"], float(r["avg_confidence"]), r["words"]) for d, p, image in zip(pdf["doc_id"], pdf["page_num"], pdf["image"], strict=True) for name, fn in chosen.items() for r in [fn(image)]]
            yield pd.DataFrame(got, columns=["doc_id", "page_num", "engine", "text", "avg_confidence", "words"])

    return images.select("doc_id", "page_num", "image").mapInPandas(run, "doc_id string, page_num int, engine string, text string, avg_confidence double, words array<struct<text:string,conf:double>>")

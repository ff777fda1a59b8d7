"""Language-model answers: clients are callables from prompt and settings to text; errors become rows, never failures."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import prompt_answer_only, prompt_instruct, prompt_plain
from . import retrieve


@dataclass(frozen=True)
class Settings:
    """What a model is asked with beside the prompt; a temperature of 0 means greedy decoding."""

    system: str | None = None
    temperature: float = 0.0
    max_tokens: int | None = None


Client = Callable[[str, Settings], str]
#: The models that are compared, in order, with the prompt each of them takes and its settings (fixed values).
MODELS = (
    ("mistral", prompt_answer_only, Settings("You are a precise clinical document analyst.", 0.0, 512)),
    ("phi-2", prompt_instruct, Settings(None, 0.0, 256)),
    ("gemini-1.5-flash", prompt_plain, Settings()),
)
RESULT = "answer string, latency_s double, error string"
#: Between the texts of one context.
CONTEXT_SEPARATOR = "\n\n"


@dataclass(frozen=True)
class Loaded:
    """A client that is made once in each worker, such as a local model with its weights."""

    load: Callable[[], Client]


_made: dict[str, Client] = {}


def _client(name: str, clients: dict[str, Client | Loaded]) -> Client:
    client = clients[name]
    if not isinstance(client, Loaded):
        return client
    if name not in _made:
        _made[name] = client.load()
    return _made[name]


def complete(df: DataFrame, clients: dict[str, Client | Loaded], prompt_col: str = "prompt", model_col: str = "model", settings: dict[str, Settings] | None = None) -> DataFrame:
    """Adds answer, latency and error; a missing client, or one that cannot be made, is an error of its row."""
    names = [f.name for f in df.schema]
    own = {name: s for name, _, s in MODELS} | (settings or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = []
            for model, prompt in zip(pdf[model_col], pdf[prompt_col], strict=True):
                start = time.perf_counter()
                try:
                    got.append((_client(model, clients)(prompt, own.get(model, Settings())).strip(), time.perf_counter() - start, ""))
                except Exception as e:  # noqa: BLE001
                    got.append(("", time.perf_counter() - start, str(e)))
            yield pd.concat([pdf[names].reset_index(drop=True), pd.DataFrame(got, columns=["answer", "latency_s", "error"])], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{schema}, {RESULT}")


def prompts(questions: DataFrame) -> DataFrame:
    """Each question (question_id, question, context) under each model's prompt, in the models' order."""
    parts = [questions.select("question_id", F.lit(i).alias("ord"), F.lit(name).alias("model"), make(F.col("context"), F.col("question")).alias("prompt")) for i, (name, make, _) in enumerate(MODELS)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def compare_models(questions: DataFrame, clients: dict[str, Client | Loaded]) -> DataFrame:
    return complete(prompts(questions), clients)


def contexts(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per question of a ranking (question_id, rank, chunk_idx, score): the texts of its chunks in rank order as
    one context, with sources and scores. Texts join the few winners only."""
    full = ranked.join(chunks.select("chunk_idx", "text"), "chunk_idx")
    listed = F.array_sort(F.collect_list(F.struct("rank", "chunk_idx", F.coalesce("score", F.lit(0.0)).alias("score"), "text")))
    out = full.groupBy("question_id").agg(listed.alias("s"))
    of: Callable[[str], Column] = lambda name: F.transform("s", lambda x: x[name])
    return out.select("question_id", F.array_join(of("text"), CONTEXT_SEPARATOR).alias("context"), of("chunk_idx").alias("sources"), of("score").alias("scores"))


def answer_questions(questions: DataFrame, chunks: DataFrame, clients: dict[str, Client | Loaded], model: str = "mistral", k: int = 5, settings: dict[str, Settings] | None = None) -> DataFrame:
    """Retrieve, put the found texts into one context, prompt the model, and give answer, sources, scores and top score.
    A question without any chunk gets an empty context and a top score of 0."""
    make = next((p for name, p, _ in MODELS if name == model), prompt_answer_only)
    found = contexts(retrieve.nearest(questions, chunks, k), chunks)
    asked = questions.select("question_id", "question").join(found, "question_id", "left").withColumns(
        {"context": F.coalesce("context", F.lit("")), "sources": F.coalesce("sources", F.array().cast(found.schema["sources"].dataType)), "scores": F.coalesce("scores", F.array().cast("array<double>"))}
    )
    asked = asked.withColumns({"prompt": make(F.col("context"), F.col("question")), "model": F.lit(model)}).drop("context")
    return complete(asked, clients, settings=settings).withColumn("top_score", F.coalesce(F.array_max("scores"), F.lit(0.0)))

"""Token counts by count-only Viterbi.

An Aho-Corasick automaton over a public piece vocabulary, read as a unigram model with the file's own scores,
enumerates all pieces in a word; dynamic programming over the ends of pieces carries the best score and its number
of pieces, and no segmentation is kept. Tie rules are those of the tokenizers library's Unigram model: among equal
scores the path whose last piece starts first wins, sums run from the left in double precision, a character without
a piece of its own costs the lowest score less ten and counts as its bytes.

Words are runs of non-space characters behind the mark of a word's start; pieces never cross white space, so a
text's count is the sum over its words and each distinct word is counted once per cache.

Edge cases: null and empty texts have no tokens; null ids stay null; repeated rows are counted one by one; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SPACES, WordCache, map_texts, run_hashes, runs
from .tokenizer_files import tokenizer_path

UNKNOWN_PENALTY = 10.0
WORD_START = "▁"


class UnigramCounter:
    def __init__(self, pieces: dict[str, float], word_start: str = WORD_START):
        self.word_start = word_start
        self.unknown = min(pieces.values()) - UNKNOWN_PENALTY
        self.single = {p for p in pieces if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, score in pieces.items():
            self.automaton.add_word(p, (len(p), score))
        self.automaton.make_automaton()

    @classmethod
    def load(cls, path: str) -> UnigramCounter:
        return cls(load_pieces(path))

    def count(self, word: str) -> tuple[float, int]:
        """Best score and number of tokens of one word, its start mark included."""
        text = self.word_start + word
        n = len(text)
        if self.single.issuperset(text):  # the automaton names the longest match of an end first, so ties need no test
            sums, counts = [0.0] + [float("-inf")] * n, [0] * (n + 1)
            for end, (length, own) in self.automaton.iter(text):
                got = sums[end + 1 - length] + own
                if got > sums[end + 1]:
                    sums[end + 1], counts[end + 1] = got, counts[end + 1 - length] + 1
            return sums[n], counts[n]
        score, tokens = [0.0] + [None] * n, [0] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(text):
            ends[end].append(match)
        single = self.single
        for end in range(n):
            best, start, add = None, -1, 1
            for length, own in ends[end]:
                at = end + 1 - length
                got = score[at] + own
                if best is None or got > best or (got == best and at < start):
                    best, start, add = got, at, 1
            if text[end] not in single:
                got = score[end] + self.unknown
                if best is None or got > best:
                    best, start, add = got, end, len(text[end].encode("utf-8"))
            score[end + 1], tokens[end + 1] = best, tokens[start] + add
        return score[n], tokens[n]


def load_pieces(path: str) -> dict[str, float]:
    """Pieces and scores of a sentencepiece file, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}


SCHEMA = "id bigint, n_words bigint, n_tokens bigint, best_score double"


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", file: str = "piece_bpe_32k.model", folder: str | None = None) -> DataFrame:
    """One row per row of `df`: its number of words and tokens, and the score of the best segmentation."""

    def fn() -> Callable:
        counter = UnigramCounter.load(tokenizer_path(file, folder))

        def compute(words: list[bytes]) -> dict:
            got = [counter.count(w.decode("utf-8", "replace")) for w in words]
            return {"score": np.array([s for s, _ in got], float), "tokens": np.array([n for _, n in got], np.int64)}

        cache = WordCache(compute)

        def work(data: np.ndarray, off: np.ndarray, batch: pa.RecordBatch) -> dict:
            n = len(off) - 1
            starts, ends, text = runs(data, off, SPACES)
            row = cache.look(data, starts, ends, run_hashes(data, starts, ends))
            edge = np.searchsorted(text, np.arange(n + 1))
            tokens = np.concatenate([[0], np.cumsum(cache.columns["tokens"][row])])[edge]
            scores = np.bincount(text, cache.columns["score"][row], n)
            return {"id": batch.column(0), "n_words": np.diff(edge), "n_tokens": np.diff(tokens), "best_score": scores}

        return work

    return map_texts(df, fn, SCHEMA, id_col, text_col).withColumnRenamed("id", id_col)

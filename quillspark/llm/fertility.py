"""Quality rules by tokeniser fertility.

Public vocabularies measure each whole text: characters per token (two vocabularies), the share of tokens that are
byte fallbacks, and the entropy of the text's token distribution. Each main script has its own rejection bands.
Tokenisation works on words, since no piece crosses white space, and each distinct word is encoded once per cache.

Edge cases: a null or empty text has no words and fails the base rules; a null id is kept as it is; repeated rows are
measured one by one; other columns, whatever their names, play no part in `measure` and pass through `filter`
unchanged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from .common import NEWLINE, SPACES, WordCache, combine, count_in, filter_rows, map_texts, mix, run_hashes, runs, same_runs
from .tokenizer_files import tokenizer_path

SCRIPTS = ("latin", "greek", "cyrillic", "semitic", "indic", "east_asian", "none")


@dataclass(frozen=True)
class Band:
    """Limits of one script. `entropy` bounds bits per token over log2(tokens), so that short and long texts compare."""

    chars_per_token: tuple[float, float]
    chars_per_token_bytes: tuple[float, float]
    byte_share: float
    entropy: tuple[float, float]


#: By main script. Non-Latin scripts take more tokens and, in a vocabulary of 32,000, more byte fallbacks.
BANDS = {
    "latin": Band((1.35, 6.5), (1.5, 8.0), 0.10, (0.42, 1.0)),
    "greek": Band((0.7, 5.0), (0.9, 7.0), 0.30, (0.35, 1.0)),
    "cyrillic": Band((1.2, 6.0), (1.2, 7.0), 0.20, (0.40, 1.0)),
    "semitic": Band((0.5, 5.0), (0.8, 7.0), 0.50, (0.35, 1.0)),
    "indic": Band((0.2, 4.0), (0.3, 6.0), 0.95, (0.25, 1.0)),
    "east_asian": Band((0.2, 3.0), (0.3, 4.0), 0.80, (0.35, 1.0)),
    "none": Band((0.8, 6.5), (0.8, 8.0), 0.50, (0.40, 1.0)),
}


@dataclass(frozen=True)
class FertilityRules:
    min_words: int = 20
    window: int = 8
    max_repeat_percent: int = 30
    symbols: str = "#*$%&|<>"
    max_symbols_per_word: float = 0.1
    bands: tuple[tuple[str, Band], ...] = tuple(BANDS.items())
    pieces: str = "piece_bpe_32k.model"
    bytes_vocabulary: str = "byte_bpe_multi_50k.tiktoken"
    folder: str | None = None


SCHEMA = (
    "id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, script string, n_tokens bigint, chars_per_token double, "
    "chars_per_token_bytes double, byte_share double, token_entropy double"
)


def _byte_counter(path: str) -> Callable[[list[str]], np.ndarray]:
    """Token counts of words under a byte-level vocabulary: one call encodes all, token ends tell the words apart."""
    import base64

    import tiktoken

    #: Fixed pattern of the vocabulary's own words.
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        size[i] = len(token)

    def count(words: list[str]) -> np.ndarray:
        ends = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in words), np.int64, len(words)))
        tokens = np.cumsum(size[np.asarray(encoding.encode_ordinary(" " + " ".join(words)), np.int64)])
        upto = np.searchsorted(tokens, ends, "right")
        return np.diff(upto, prepend=0)

    return count


def _word_measurer(rules: FertilityRules) -> tuple[Callable[[list[bytes]], dict], np.ndarray]:
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(rules.pieces, rules.folder))
    count_bytes = _byte_counter(tokenizer_path(rules.bytes_vocabulary, rules.folder))
    is_byte = np.array([pieces.is_byte(i) for i in range(pieces.get_piece_size())])

    def compute(words: list[bytes]) -> dict:
        text = [w.decode("utf-8", "replace") for w in words]
        ids = pieces.encode(text, num_threads=1) if text else []
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(lens.sum()))
        fallback = np.zeros(len(ids) + 1, np.int64)
        np.add.at(fallback, np.repeat(np.arange(len(ids)), lens)[is_byte[flat]], 1)
        return {"flat": flat, "lens": lens, "fallback": fallback[:-1], "by_bytes": count_bytes(text) if text else lens}

    return compute, is_byte


#: First UTF-8 bytes of the scripts' letters.
_LEADS = [(0xC3, 0xCA, 0), (0xCE, 0xD0, 1), (0xD0, 0xD5, 2), (0xD6, 0xDC, 3), (0xE0, 0xE1, 4), (0xE3, 0xEE, 5)]


def repeated_words(words: np.ndarray, text: np.ndarray, window: int) -> np.ndarray:
    """Marks words that lie in a window of words that occurs more than once in its text. `words` numbers the distinct
    words; windows meet by a hash and are then compared word by word."""
    marks = np.zeros(len(words), bool)
    if len(words) < window:
        return marks
    at = np.flatnonzero(text[: 1 - window] == text[window - 1 :])
    keys = mix(combine(mix(words.astype(np.uint64)), window)[at] + mix(text[at].astype(np.uint64)))
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return marks
    place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    some = twice[place] == keys
    at, place = at[some], place[some]
    _, first = np.unique(place, return_index=True)
    model = at[first][place]
    same = text[at] == text[model]
    for k in range(window):
        same &= words[at + k] == words[model + k]
    if not same.all():
        at = at[~np.isin(place, place[~same])].tolist() + _repeated(words, text, at[np.isin(place, place[~same])].tolist(), window)
        at = np.array(at, np.int64)
    delta = np.zeros(len(words) + 1, np.int32)
    np.add.at(delta, at, 1)
    np.subtract.at(delta, at + window, 1)
    return np.cumsum(delta[:-1]) > 0


def _repeated(words: np.ndarray, text: np.ndarray, at: list[int], window: int) -> list[int]:
    """Of the windows at these places, those that occur more than once, by their words."""
    own = [(int(text[k]), *words[k : k + window].tolist()) for k in at]
    count = Counter(own)
    return [k for k, w in zip(at, own, strict=True) if count[w] > 1]


def repeated_lines(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """How many lines of each text equal an earlier one. Lines meet by a hash and are then compared byte by byte."""
    _, first, where = np.unique(mix(run_hashes(data, starts, ends) + mix(text.astype(np.uint64))), return_index=True, return_inverse=True)
    out = np.bincount(text, minlength=n) - np.bincount(text[first], minlength=n)
    model = first[where]
    odd = np.flatnonzero((text != text[model]) | ~same_runs(data, starts, ends - starts, data, starts[model], (ends - starts)[model]))
    for k in np.unique(np.concatenate([text[odd], text[model[odd]]])).tolist():
        own = [data[a:b].tobytes() for a, b in zip(starts[text == k].tolist(), ends[text == k].tolist(), strict=True)]
        out[k] = len(own) - len(set(own))
    return out


def _entropies(ids: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Shannon entropy in bits of the ids of each text."""
    out = np.zeros(len(edges) - 1)
    for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        if b - a > 1:
            c = np.bincount(ids[a:b])
            c = c[c > 1]
            out[i] = np.log2(b - a) - float((c * np.log2(c)).sum()) / (b - a)
    return out


def _worker(rules: FertilityRules) -> Callable:
    compute, is_byte = _word_measurer(rules)
    cache = WordCache(compute)
    symbols = np.zeros(256, bool)
    symbols[list(rules.symbols.encode())] = True
    script_of = np.full(256, -1, np.int64)
    for lo, hi, k in _LEADS:
        script_of[lo:hi] = k
    letter = np.zeros(256, bool)
    letter[[*range(65, 91), *range(97, 123)]] = True
    bands = dict(rules.bands)

    def work(data: np.ndarray, off: np.ndarray) -> dict:
        n = len(off) - 1
        starts, ends, text = runs(data, off, SPACES)
        hashes = run_hashes(data, starts, ends)
        edge = np.searchsorted(text, np.arange(n + 1))
        n_words = np.diff(edge)
        byte_end = np.concatenate([[0], np.cumsum(ends - starts)])
        chars = np.diff(byte_end[edge]) - count_in((data & 0xC0) == 0x80, off)
        n_symbols = count_in(symbols[data], off)
        ls, le, lt = runs(data, off, NEWLINE)
        some = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
        ls, le, lt = ls[some], le[some], lt[some]
        dup_lines = repeated_lines(data, ls, le, lt, n)
        row = cache.look(data, starts, ends, hashes)
        repeat = np.bincount(text[repeated_words(row, text, rules.window)], minlength=n)
        failed = (n_words < rules.min_words) | (100 * repeat > rules.max_repeat_percent * n_words)

        col = cache.columns
        lens = col["lens"][row]
        upto = np.concatenate([[0], np.cumsum(lens)])
        total = int(upto[-1])
        ids = col["flat"][np.arange(total) + np.repeat(col["base"][row] - upto[:-1], lens)] if total else np.zeros(0, np.int32)
        tokens = np.diff(upto[edge])
        tokens_bytes = np.bincount(text, col["by_bytes"][row], n)
        byte_tokens = np.bincount(text, col["fallback"][row], n)
        entropy = _entropies(ids, upto[edge])
        wide = np.flatnonzero(data >= 0xC3)
        wide_text = np.searchsorted(off, wide, "right") - 1
        script = script_of[data[wide]]
        letters = np.stack([np.bincount(wide_text[script == k], minlength=n) for k in range(len(SCRIPTS) - 1)])
        if letters[1:].any():
            letters[0] += count_in(letter[data], off)
        plain = letters.sum(0) > 0
        plain |= n_words > 0
        main = np.where(plain, letters.argmax(0), len(SCRIPTS) - 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            cpt = np.where(tokens > 0, chars / tokens, 0.0)
            cpt_bytes = np.where(tokens_bytes > 0, chars / tokens_bytes, 0.0)
            share = np.where(tokens > 0, byte_tokens / tokens, 0.0)
            scaled = np.where(tokens > 1, entropy / np.log2(np.maximum(tokens, 2)), 1.0)
        kept = ~failed & (n_symbols <= rules.max_symbols_per_word * n_words)
        for k, name in enumerate(SCRIPTS):
            b = bands[name]
            fits = (cpt >= b.chars_per_token[0]) & (cpt <= b.chars_per_token[1]) & (cpt_bytes >= b.chars_per_token_bytes[0]) & (cpt_bytes <= b.chars_per_token_bytes[1])
            fits &= (share <= b.byte_share) & (scaled >= b.entropy[0]) & (scaled <= b.entropy[1] + 1e-9)
            kept &= (main != k) | fits
        return {
            "n_words": n_words, "word_chars": chars, "n_symbols": n_symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat, "base_failed": failed, "kept": kept,
            "script": np.array(SCRIPTS, object)[main], "n_tokens": tokens, "chars_per_token": cpt, "chars_per_token_bytes": cpt_bytes, "byte_share": share, "token_entropy": entropy,
        }

    return work


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: FertilityRules = FertilityRules()) -> DataFrame:
    """One row per row of `df`: the base counts, the tokenisers' measures and the verdict `kept`."""

    def fn() -> Callable:
        work = _worker(rules)
        return lambda data, off, batch: work(data, off) | {"id": batch.column(0)}

    return map_texts(df, fn, SCHEMA, id_col, text_col).withColumnRenamed("id", id_col)


def filter_quality(df: DataFrame, text_col: str = "text", rules: FertilityRules = FertilityRules()) -> DataFrame:
    """The rows of `df` that the rules keep, with all their columns."""

    def keep() -> Callable:
        work = _worker(rules)
        return lambda data, off, batch: work(data, off)["kept"]

    return filter_rows(df, keep, text_col)

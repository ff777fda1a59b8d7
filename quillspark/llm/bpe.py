"""BPE encoding and decoding by speculation and verification.

Greedy longest-match proposes the tokens of a word. A proposal is the exact result precisely when every two
neighbours are compatible: merging the pair's text afresh gives the same two tokens. That test depends on the two
tokens alone, so all pairs of a batch are tested together in NumPy. Only words with a failing pair are merged
step by step, and of long words only the stretches about failing pairs, so that time follows a word's length. Works for vocabularies whose ids follow the order of their merges (checked on loading).

Edge cases: a null or empty text gives no tokens, the hash of nothing and an empty text; a null id stays null;
repeated rows are encoded one by one; extra columns are ignored. Special-token strings in a text are their own
tokens, as in the library. Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import SPACES, WordCache, map_texts, run_hashes, runs
from .tokenizer_files import tokenizer_path

#: Fixed pattern of the word-level vocabulary: contractions, letters, single digits, other signs.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^ \t-\r\p{L}\p{N}]+"
#: Longer words are repaired stretch by stretch.
LONG_WORD = 192
_WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A BPE vocabulary with an end-of-word mark, read from a `tokenizers` file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.text = [""] * size
        for t, i in chain(self.vocab.items(), self.special.items()):
            self.text[i] = t
        self.letters = _byte_letters()
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.merges: dict[tuple[int, int], int] = {}
        last = -1
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            i = self.vocab[a + b]
            if i <= last:
                raise ValueError("the ids do not follow the order of the merges")
            last = i
            self.left[i], self.right[i] = self.vocab[a], self.vocab[b]
            self.merges[self.vocab[a], self.vocab[b]] = i
        self.size = size
        keys = np.array([a * size + b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ids = keys[order], np.fromiter(self.merges.values(), np.int64)[order]
        self.longest = max(map(len, self.vocab))
        self.length = np.array([len(t.removesuffix(self.end)) if self.end and t != self.end else len(t) for t in self.text], np.int64)
        self._tree()

    def _tree(self) -> None:
        """Prefixes of tokens, for longest match: text -> id or -1 for a mere prefix."""
        self.prefix: dict[str, int] = {}
        for t in self.vocab:
            body = t.removesuffix(self.end) if self.end and t != self.end else t
            for k in range(1, len(body) + 1):
                self.prefix.setdefault(body[:k], -1)
        for t, i in self.vocab.items():
            if not (self.end and t.endswith(self.end) and t != self.end):
                self.prefix[t] = i

    def propose(self, word: str) -> list[int]:
        """Greedy longest match; the last token is one that ends words."""
        out, i, n = [], 0, len(word)
        vocab, prefix = self.vocab, self.prefix
        while i < n:
            tail = vocab.get(word[i:] + self.end) if n - i <= self.longest else None
            if tail is not None:
                out.append(tail)
                break
            best, k = -1, i + 1
            while k < n:
                got = prefix.get(word[i:k])
                if got is None:
                    break
                if got >= 0:
                    best, stop = got, k
                k += 1
            if best < 0:
                raise KeyError(word[i])
            out.append(best)
            i = stop
        return out

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """For each pair of tokens: would BPE, given their joined text, cut it between them and nowhere else?

        The last merges of both tokens are undone in turn, the later one first; a merge across the border that ranks
        before the one undone would have happened earlier, and then the pair is not what BPE makes.
        """
        ok = np.ones(len(first), bool)
        at = np.arange(len(first))
        a, b = first.astype(np.int64), second.astype(np.int64)
        limit = np.full(len(first), np.iinfo(np.int64).max)
        while len(at):
            place = np.minimum(np.searchsorted(self.pair_keys, a * self.size + b), len(self.pair_keys) - 1)
            crossed = (self.pair_keys[place] == a * self.size + b) & (self.pair_ids[place] < limit)
            ok[at[crossed]] = False
            undo_left = (a > b) & (self.left[a] >= 0)
            undo_right = ~undo_left & (self.left[b] >= 0)
            undo_left |= ~undo_right & (self.left[a] >= 0)
            limit = np.where(undo_left, a, np.where(undo_right, b + 1, limit))
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_right, self.left[b], b)
            go = ~crossed & (undo_left | undo_right)
            at, a, b, limit = at[go], a[go], b[go], limit[go]
        return ok

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge of each two neighbours, or `size` where there is none."""
        key = a * self.size + b
        place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[place] == key, self.pair_ids[place], self.size)

    def merge(self, words: list[str], last: list[bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many short words side by side: in each round every word merges its lowest-ranked pair, the
        leftmost among equals; a word without pairs is done. `last` tells which of them end a word; all, if not given."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        ids = np.concatenate([np.zeros(0, np.int64), *(self._letters(w, last is None or last[k]) for k, w in enumerate(words))])
        lens = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), lens)
        ranks = np.full(len(ids), self.size)
        inner = np.flatnonzero(word[1:] == word[:-1])
        ranks[inner] = self.rank(ids[inner], ids[inner + 1])
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            n = np.diff(np.append(first, len(ids)))
            low = np.minimum.reduceat(ranks, first)
            done = low == self.size
            if done.any():
                for k in np.flatnonzero(done).tolist():
                    out[word[first[k]]] = ids[first[k] : first[k] + n[k]]
                stay = np.repeat(~done, n)
                ids, word, ranks = ids[stay], word[stay], ranks[stay]
                continue
            hit = np.flatnonzero(ranks == np.repeat(low, n))
            at = hit[np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])]
            ids[at] = low
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            moved = np.cumsum(stay) - 1
            ids, word, ranks = ids[stay], word[stay], ranks[stay]
            for k in (moved[at], moved[at] - 1):
                k = k[k >= 0]
                pair = (k + 1 < len(ids)) & (word[np.minimum(k + 1, len(ids) - 1)] == word[k])
                ranks[k] = self.size
                ranks[k[pair]] = self.rank(ids[k[pair]], ids[k[pair] + 1])
        return np.concatenate(out) if out else np.zeros(0, np.int64), np.fromiter(map(len, out), np.int64, len(out))

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """Exact merging of one long sequence: all places of the lowest-ranked pair at once while they are many, then
        pair by pair from a heap, over linked neighbours."""
        while len(ids) > 1:
            ranks = self.rank(ids[:-1], ids[1:])
            low = ranks.min()
            hit = np.flatnonzero(ranks == low)
            if low == self.size or len(hit) * 64 < len(ids):
                break
            first = np.flatnonzero(np.diff(hit, prepend=-2) > 1)
            hit = hit[(np.arange(len(hit)) - np.repeat(first, np.diff(np.append(first, len(hit))))) % 2 == 0]
            ids = ids.copy()
            ids[hit] = low
            ids = np.delete(ids, hit + 1)
        n = len(ids)
        if n < 2 or low == self.size:
            return ids
        own, after, before, merges = ids.tolist(), [*range(1, n + 1)], [*range(-1, n - 1)], self.merges
        some = np.flatnonzero(ranks < self.size)
        heap = list(zip(ranks[some].tolist(), some.tolist(), strict=True))
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            j = after[i]
            if j == n or own[i] < 0 or merges.get((own[i], own[j])) != r:
                continue
            own[i], own[j] = r, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (x := merges.get((r, own[k]))) is not None:
                    heappush(heap, (x, i))
            if (k := before[i]) >= 0 and (x := merges.get((own[k], r))) is not None:
                heappush(heap, (x, k))
        return np.array([x for x in own if x >= 0], np.int64)

    def _letters(self, text: str, last: bool) -> np.ndarray:
        """The ids that merging starts from."""
        vocab = self.vocab
        return np.fromiter(chain(map(vocab.__getitem__, text[:-1]), [vocab[text[-1] + self.end] if last else vocab[text[-1]]]), np.int64, len(text))

    def repair(self, word: str, ids: np.ndarray) -> np.ndarray:
        """Exact tokens of a long word from its proposal: stretches about failing pairs are merged afresh, wider ones as
        long as a pair fails at their borders. Where no pair fails the whole is exact, so the rest is never merged."""
        reach = 4
        while True:
            key, where = np.unique(ids[:-1] * self.size + ids[1:], return_inverse=True)
            bad = np.flatnonzero(~self.compatible(key // self.size, key % self.size)[where])
            if not len(bad):
                return ids
            lo, hi = np.maximum(bad + 1 - reach, 0), np.minimum(bad + 1 + reach, len(ids))
            head = np.flatnonzero(np.concatenate([[True], lo[1:] > np.maximum.accumulate(hi)[:-1]]))
            lo, hi = lo[head], np.maximum.reduceat(hi, head)
            edge = np.concatenate([[0], np.cumsum(self.length[ids])])
            texts = [(word[a:b], b == len(word)) for a, b in zip(edge[lo].tolist(), edge[hi].tolist(), strict=True)]
            short = [k for k, (t, _) in enumerate(texts) if len(t) <= LONG_WORD]
            flat, lens = self.merge([texts[k][0] for k in short], [texts[k][1] for k in short])
            fresh = dict(zip(short, np.split(flat, np.cumsum(lens)[:-1]), strict=True)) if short else {}
            out, at = [], 0
            for k, (a, b) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
                out += [ids[at:a], fresh[k] if k in fresh else self.merge_long(self._letters(*texts[k]))]
                at = b
            ids = np.concatenate([*out, ids[at:]])
            reach *= 4

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of words that are already in byte letters, joined, and the count of each word."""
        out = [self.propose(w) for w in words]
        lens = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter(chain.from_iterable(out), np.int64, int(lens.sum()))
        word = np.repeat(np.arange(len(out)), lens)
        pair = np.flatnonzero(word[1:] == word[:-1])
        key, where = np.unique(flat[pair] * self.size + flat[pair + 1], return_inverse=True)
        failing = np.unique(word[pair[~self.compatible(key // self.size, key % self.size)[where]]])
        if not len(failing):
            return flat, lens
        long = [i for i in failing.tolist() if len(words[i]) > LONG_WORD]
        failing = np.array([i for i in failing.tolist() if len(words[i]) <= LONG_WORD], np.int64)
        fixed, n = self.merge([words[i] for i in failing.tolist()])
        whole = [self.repair(words[i], np.array(out[i], np.int64)) for i in long]
        fixed, n = np.concatenate([fixed, *whole]), np.concatenate([n, np.fromiter(map(len, whole), np.int64, len(whole))])
        failing = np.concatenate([failing, np.array(long, np.int64)])
        old = np.isin(word, failing)
        order = np.argsort(np.concatenate([word[~old], np.repeat(failing, n)]), kind="stable")
        lens[failing] = n
        return np.concatenate([flat[~old], fixed])[order], lens

    def spell(self, piece: str) -> str:
        letters = self.letters
        return "".join([letters[b] for b in piece.encode("utf-8")])

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.text[i] for i in ids])


def normalise(text: str) -> str:
    """NFC, one kind of white space, lower case by single code points."""
    if not text.isascii():
        text = _WIDE_SPACE.sub(" ", unicodedata.normalize("NFC", text))
        return text.replace("Σ", "σ").lower()
    return text.lower()


SCHEMA = "id bigint, n_tokens bigint, ids binary, decoded string"
DIGEST = "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _worker(file: str, folder: str | None) -> Callable:
    bpe = WordBpe(tokenizer_path(file, folder))
    pieces = regex.compile(WORD_PATTERN)
    ascii_pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zA-Z]+|[0-9]|[^ \t-\ra-zA-Z0-9]+")
    special = re.compile("(" + "|".join(map(re.escape, bpe.special)) + ")") if bpe.special else None
    codes: list[bytes] = []
    shown: list[bytes] = []

    def compute(words: list[bytes]) -> dict:
        parts = []
        for w in words:
            t = w.decode("utf-8", "replace")
            parts.append((ascii_pieces if t.isascii() else pieces).findall(t))
        lens = [len(p) for p in parts]
        spelled = [x if x.isascii() and x.isprintable() else bpe.spell(x) for x in chain.from_iterable(parts)]
        flat, per_part = bpe.encode_words(spelled)
        upto = np.concatenate([[0], np.cumsum(per_part)])
        edge = upto[np.concatenate([[0], np.cumsum(np.array(lens, np.int64))]).astype(np.int64)].tolist()
        if cache.keys.size == 0:
            codes.clear()
            shown.clear()
        raw, text = flat.astype("<u4").tobytes(), [*map(bpe.text.__getitem__, flat.tolist())]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            codes.append(raw[4 * a : 4 * b])
            shown.append(" ".join(text[a:b]).encode("utf-8"))
        return {"n": np.array(lens, np.int64)}

    cache = WordCache(compute, 1_000_000)
    marks = {s: (np.array([i], "<u4").tobytes(), s.encode()) for s, i in bpe.special.items()}

    def encode(texts: list[str]) -> list[tuple[bytes, bytes]]:
        blocks, owner = [], []
        for i, t in enumerate(texts):
            for part in special.split(t) if special and "<|" in t else (t,):
                blocks.append(part if part in marks else normalise(part).encode("utf-8", "replace"))
                owner.append(i)
        plain = [b"" if isinstance(b, str) else b for b in blocks]
        off = np.concatenate([[0], np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)))])
        data = np.frombuffer(b"".join(plain), np.uint8)
        starts, ends, block = runs(data, off, SPACES)
        rows = cache.look(data, starts, ends, run_hashes(data, starts, ends))
        edge = np.searchsorted(block, np.arange(len(blocks) + 1)).tolist()
        rows = rows.tolist()
        out: list[tuple[list[bytes], list[bytes]]] = [([], []) for _ in texts]
        for k, i in enumerate(owner):
            if isinstance(blocks[k], str):
                out[i][0].append(marks[blocks[k]][0])
                out[i][1].append(marks[blocks[k]][1])
            else:
                own = rows[edge[k] : edge[k + 1]]
                out[i][0].extend([codes[r] for r in own])
                out[i][1].extend([x for r in own if (x := shown[r])])
        return [(b"".join(a), b" ".join(b)) for a, b in out]

    return encode


def _run(df: DataFrame, id_col: str, text_col: str, file: str, folder: str | None, digest: bool) -> DataFrame:
    def fn() -> Callable:
        encode = _worker(file, folder)

        def work(data: np.ndarray, off: np.ndarray, batch: pa.RecordBatch) -> dict:
            raw, at = data.tobytes(), off.tolist()
            got = encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)])
            out = {"id": batch.column(0), "n_tokens": np.array([len(a) // 4 for a, _ in got], np.int64)}
            if digest:
                return out | {"ids_sha256": pa.array([hashlib.sha256(a).hexdigest() for a, _ in got], pa.string()), "decoded_sha256": pa.array([hashlib.sha256(b).hexdigest() for _, b in got], pa.string())}
            return out | {"ids": pa.array([a for a, _ in got], pa.binary()), "decoded": pa.array([b.decode() for _, b in got], pa.string())}

        return work

    return map_texts(df, fn, DIGEST if digest else SCHEMA, id_col, text_col).withColumnRenamed("id", id_col)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", file: str = "word_bpe_49k.json", folder: str | None = None) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) and the decoded text of each row."""
    return _run(df, id_col, text_col, file, folder, False)


def encode_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", file: str = "word_bpe_49k.json", folder: str | None = None) -> DataFrame:
    """As `encode`, with SHA-256 of ids and decoded text in their place, taken in the same pass."""
    return _run(df, id_col, text_col, file, folder, True)

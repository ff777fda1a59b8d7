"""Toxicity by noisy-channel deobfuscation.

Fit: from all labelled texts come a character trigram model of words, and a lexicon of words and word beginnings that
mark label 1, chosen by a likelihood-ratio test that grows with the number of candidates. Score: all tokens that hold a sign, a digit or a letter twice in a row, and all runs of single characters set apart by spaces,
become lattices of the letters they may stand for and of the places where words may end; Viterbi decoding under the
character model restores the likeliest words; these and the plain words are held against the lexicon. Letters under
marks (diacritics) may stand for the bare letter, signs among letters for nothing, and the spaces between pieces of up
to three letters may be none. The evidence of the distinct words, the number of hits and the text's number of words
give the score by a logistic curve fitted on the same texts and set to the share of label 1, since a long text holds
some word of the lexicon by chance.

Edge cases: null and empty texts score as texts without words and evidence; a null id stays null; repeated rows are
scored one by one; labels without a class give an empty lexicon and a constant score; extra columns are ignored by
`score` and kept by `filter_toxic`. Whole texts are scored, whatever their length.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import chain, count

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WordCache, Workspace, filter_rows, map_texts, row_groups, run_hashes, runs, string_column, text_buffer, tidily
from .families import labelled_families
from .samples import logistic, share_of

#: What signs and digits may stand for (fixed values).
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "*": "aeiou",
}
SEPARATORS = frozenset(".-_*~'`,/")
_LETTERS = re.compile(r"[^\W\d_]+")
_BLANKS = " \t\n\r\x0b\x0c"
_SPACE = re.compile(f"[{_BLANKS}]+")
_REPEATED = re.compile(r"([^\W\d_])\1")
_SIGNS = "".join(c for c in LEET if not c.isalnum())
_EDGES = re.compile(rf"^[^\w{re.escape(_SIGNS)}]*(.*?)[^\w{re.escape(_SIGNS)}]*$", re.S)
#: Log weights of the channel: a sign for a letter, a letter repeated, a separator dropped, a mark on a letter dropped, a
#: sign among letters dropped, a space between pieces dropped.
_SWAP, _REPEAT, _DROP, _BARE, _JUNK, _JOIN = -1.5, -0.7, -1.0, -2.0, -2.0, -2.0
#: Pieces of so many letters and digits may be parts of one word.
PIECE = 3


class _Bare(dict):
    """Code points without their marks, filled as they are met."""

    def __missing__(self, code: int) -> str:
        self[code] = out = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        return out


_BARE_LETTERS = _Bare()


def bare(text: str) -> str:
    """Letters without their marks."""
    return text if text.isascii() else text.translate(_BARE_LETTERS)


@dataclass(frozen=True)
class ToxicModel:
    words: dict[str, float]
    beginnings: dict[str, float]
    trigrams: dict[str, float]
    alphabet: int
    weights: tuple[float, ...] = ()
    min_beginning: int = 4
    max_beginning: int = 8


def features(word: str, lo: int = 4, hi: int = 8) -> list[str]:
    """A word and its beginnings; the latter end in a sign that no word has."""
    return [word, *[word[:k] + "^" for k in range(lo, min(hi, len(word)) + 1)]]


def plain_words(text: str) -> set[str]:
    return set(_LETTERS.findall(text.lower()))


def text_features(text: str, known: dict[str, list[str]]) -> set[str]:
    """The features of a text's words; `known` keeps those of words met before."""
    out: set[str] = set()
    for w in plain_words(text):
        own = known.get(w)
        if own is None:
            if len(known) >= MOST_KEPT:
                known.clear()
            own = known[w] = features(w)
        out.update(own)
    return out


def mark_chances(a: np.ndarray, b: np.ndarray, n0: int, n1: int, candidates: int, prior: float) -> np.ndarray:
    """The chance of label 1 given each feature that `a` of n0 texts of label 0 and `b` of n1 of label 1 have; 0 where it
    fails the likelihood-ratio test or speaks too little for label 1."""
    n0, n1 = max(1, n0), max(1, n1)
    share, p = n1 / (n0 + n1), b / (a + b)
    ratio = 2 * (b * np.log(p / share) + a * np.log(np.where(a > 0, 1 - p, 1 - share) / (1 - share)))
    hit1, hit0 = (b + 0.2) / (n1 + 1), (a + 0.2) / (n0 + 1)
    chance = prior * hit1 / (prior * hit1 + (1 - prior) * hit0)
    return np.where((b / n1 > 4 * a / n0) & (ratio >= 2 * math.log(max(candidates, 2)) + 12) & (chance >= 0.3), chance, 0.0)


def count_trigrams(word: str, n: int, into: Counter) -> None:
    s = f"\x02\x02{word}\x03"
    for i in range(2, len(s)):
        into[s[i - 2 : i + 1]] += n


def _model(found: dict[str, float], three: dict[str, int]) -> ToxicModel:
    """A model without curve, of a lexicon and of the numbers of trigrams."""
    grams: Counter = Counter(three)
    for g, n in three.items():
        grams["2" + g[1:]] += n
        grams["1" + g[2]] += n
        grams["c" + g[:2]] += n
        grams["d" + g[1]] += n
    total = sum(n for g, n in grams.items() if g[0] == "1" and len(g) == 2)
    alphabet = sum(1 for g in grams if g[0] == "1" and len(g) == 2)
    return ToxicModel({f: p for f, p in found.items() if f[-1] != "^"}, {f: p for f, p in found.items() if f[-1] == "^"}, {**grams, "": total}, max(1, alphabet))


def _flat_curve(prior: float) -> tuple[float, ...]:
    return (math.log(prior / (1 - prior)), *([0.0] * (N_FEATURES - 1)))


def _set_share(w: np.ndarray, n0: int, n1: int, prior: float) -> tuple[float, ...]:
    """A curve fitted on n0 and n1 texts, set to the given share of label 1."""
    return (float(w[0] + math.log(prior / (1 - prior)) - math.log(n1 / n0)), *w[1:].tolist())


def fit(clean: list[str] | DataFrame, toxic: list[str] | DataFrame, min_count: int = 3, prior: float = 0.1) -> ToxicModel:
    """The model of all texts of two lists, or of two tables with a column `text`; `prior` is the weight of label 1 that
    evidence is turned into chances with."""
    if isinstance(clean, DataFrame):
        return _fit_tables(clean, toxic, min_count, prior)
    known: dict[str, list[str]] = {}
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for count, texts in zip(counts, (clean, toxic), strict=True):
        for t in texts:
            count.update(text_features(t, known))
    candidates = [f for f, n in counts[1].items() if n >= min_count]
    a, b = (np.array([count[f] for f in candidates], float) for count in counts)
    three: Counter = Counter()
    for f, n in (counts[0] + counts[1]).items():
        if f[-1] != "^":
            count_trigrams(f, n, three)
    model = _model({f: p for f, p in zip(candidates, mark_chances(a, b, len(clean), len(toxic), len(candidates), prior).tolist(), strict=True) if p}, three)
    if not clean or not toxic:
        return replace(model, weights=_flat_curve(prior))
    evidence = _worker(model)
    x = []
    for t in chain(clean, toxic):
        raw = np.frombuffer(t.encode("utf-8", "replace"), np.uint8)
        x.append(curve_features(*evidence(raw, np.array([0, len(raw)]))))
    w = logistic(np.concatenate(x), np.repeat([0.0, 1.0], [len(clean), len(toxic)]), ridge=RIDGE)
    return replace(model, weights=_set_share(w, len(clean), len(toxic), prior))


def _fit_tables(clean: DataFrame, toxic: DataFrame, min_count: int, prior: float) -> ToxicModel:
    """`fit` where the texts lie: only the lexicon, the trigrams and sums for the curve come to the driver."""
    space = Workspace(clean.sparkSession, "toxicity")
    try:
        texts = clean.select(F.lit(0).cast("bigint").alias("label"), "text").unionByName(toxic.select(F.lit(1).cast("bigint").alias("label"), "text"))
        sizes = {r.label: r.n for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
        n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
        counts = texts.mapInArrow(tidily(_count_features), "feature string, a bigint, b bigint")
        counts = space.put(counts.groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "counts")
        candidates = counts.where(F.col("b") >= min_count)
        n = candidates.count()

        def marks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = (batch.column(k).to_numpy().astype(float) for k in (1, 2))
                chance = pa.array(mark_chances(a, b, n0, n1, n, prior))
                yield pa.RecordBatch.from_arrays([batch.column(0), chance], names=["feature", "chance"]).filter(pc.greater(chance, 0))

        found = {r.feature: r.chance for r in candidates.mapInArrow(marks, "feature string, chance double").collect()}
        words = counts.where(~F.col("feature").endswith("^")).select("feature", (F.col("a") + F.col("b")).alias("n"))
        three = words.mapInArrow(tidily(_count_trigrams), "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
        model = _model(found, {r.gram: r.n for r in three.collect()})
        if not n0 or not n1:
            return replace(model, weights=_flat_curve(prior))
        shared = clean.sparkSession.sparkContext.broadcast(model)

        def evidence() -> Callable:
            work = _worker(shared.value)

            def columns(data: np.ndarray, off: np.ndarray, batch: pa.RecordBatch) -> dict:
                sums, hits, words = work(data, off)
                return {"label": batch.column(0), "sums": sums.astype(float), "hits": hits, "words": np.where(hits > 0, words, 0)}

            return columns

        of_texts = map_texts(texts, evidence, "label bigint, sums double, hits bigint, words bigint", "label", "text")
        points = space.put(of_texts.groupBy("label", "sums", "hits", "words").agg(F.count("*").alias("n")), "points")
        return replace(model, weights=_set_share(_newton(points, n0 + n1), n0, n1, prior))
    finally:
        space.drop("")


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])[: len(x)]]


def _count_features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of label 0 and of label 1 each feature is, in parts."""
    ids: defaultdict[str, int] = defaultdict(count().__next__)
    totals = np.zeros((2, 0), np.int64)
    size = 0

    def columns(words: list[bytes]) -> dict:
        lows = [w.decode("utf-8", "replace").lower() for w in words]
        own = [features(x) if x.isalpha() else [f for w in _LETTERS.findall(x) for f in features(w)] for x in lows]
        return {"lens": np.fromiter(map(len, own), np.int64, len(own)), "flat": np.fromiter(map(ids.__getitem__, chain.from_iterable(own)), np.int64)}

    cache = WordCache(columns)

    def part() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(ids), pa.string()), pa.array(totals[0]), pa.array(totals[1])], names=["feature", "a", "b"])
        ids.clear()
        ids.default_factory = count().__next__
        cache.clear()
        return out

    for batch in batches:
        raw, off = text_buffer(string_column(batch, "text"))
        labels = batch.column(0).to_numpy()
        for lo, hi in row_groups(off):
            data = raw[off[lo] : off[hi]]
            starts, ends, text = runs(data, off[lo : hi + 1] - off[lo], SPACES)
            if not len(starts):
                continue
            row = cache.look(data, starts, ends, run_hashes(data, starts, ends))
            n = len(cache.sizes)
            text, row = np.divmod(_distinct(text * n + row), n)
            lens = cache.columns["lens"][row]
            at = np.repeat(cache.columns["base"][row] - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())
            text, feature = np.divmod(_distinct(np.repeat(text, lens) * len(ids) + cache.columns["flat"][at]), max(1, len(ids)))
            totals = np.pad(totals, ((0, 0), (0, len(ids) - totals.shape[1])))
            for k in (0, 1):
                totals[k] += np.bincount(feature[labels[lo + text] == k], minlength=len(ids))
            size += len(data)
            if len(ids) >= MOST_KEPT or size >= PART_BYTES:
                yield part()
                totals, size = totals[:, :0], 0
    yield part()


def _count_trigrams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each trigram of letters is in words, in parts."""
    three: Counter = Counter()

    def part() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(three), pa.string()), pa.array(list(three.values()), pa.int64())], names=["gram", "n"])
        three.clear()
        return out

    for batch in batches:
        for word, n in zip(batch.column(0), batch.column(1), strict=True):
            count_trigrams(word.as_py(), n.as_py(), three)
            if len(three) >= MOST_KEPT:
                yield part()
    yield part()


def _newton(points: DataFrame, n: int, steps: int = 50) -> np.ndarray:
    """`logistic` over a table: each step adds up gradient and curvature where the rows lie."""
    w = np.zeros(N_FEATURES)
    for _ in range(steps):

        def sums(batches: Iterable[pa.RecordBatch], w: np.ndarray = w) -> Iterator[pa.RecordBatch]:
            total = np.zeros((N_FEATURES + 1, N_FEATURES))
            for batch in batches:
                y, log, hits, words, times = (c.to_numpy() for c in batch.columns)
                x = curve_features(log, hits, words)
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                total[0] += x.T @ (times * (y - p))
                total[1:] += (x * (times * p * (1 - p))[:, None]).T @ x
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], names=["sums"])

        parts = points.mapInArrow(sums, "sums array<double>").collect()
        total = np.sum([r.sums for r in parts], axis=0).reshape(N_FEATURES + 1, N_FEATURES)
        move = np.linalg.solve(total[1:] + RIDGE * n * np.eye(N_FEATURES), total[0] - RIDGE * n * w)
        w = w + move
        if np.abs(move).max() < 1e-8:
            break
    return w


N_FEATURES = 6
RIDGE = 1e-4
#: Words, features or trigrams that a task keeps, and bytes of text it counts, before it hands its counts on.
MOST_KEPT, PART_BYTES = 500_000, 64 << 20


def curve_features(sums: np.ndarray, hits: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Of texts: evidence, hits and number of words, on bounded scales."""
    some = np.log1p(hits)
    return np.column_stack([np.ones(len(sums)), np.minimum(-sums, 12.0) / 4, some, hits > 1, some * np.log1p(words) / 8, (hits > 0) * np.log1p(words) / 8])


def chances(model: ToxicModel, sums: np.ndarray, hits: np.ndarray, words: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(curve_features(sums, hits, words) @ np.array(model.weights), -30, 30)))


class Restorer:
    """Viterbi decoding of obfuscated tokens."""

    def __init__(self, model: ToxicModel):
        self.grams, self.size = model.trigrams, model.alphabet
        self.known: dict[str, float] = {}

    def chance(self, a: str, b: str, c: str) -> float:
        """Log of the interpolated chance of c after a and b."""
        key = a + b + c
        got = self.known.get(key)
        if got is None:
            g = self.grams
            one = (g.get("1" + c, 0) + 1) / (g[""] + self.size + 1)
            two = (g.get("2" + b + c, 0) + 4 * one) / (g.get("d" + b, 0) + 4)
            got = self.known[key] = math.log((g.get(key, 0) + 4 * two) / (g.get("c" + a + b, 0) + 4))
        return got

    def lattice(self, token: str, edges: bool = True) -> list[list[tuple[str, float]]]:
        """For each run of one sign, what it may stand for, with the channel's log weights; a space ends a word. With
        `edges`, signs before and after all letters and digits may stand for nothing."""
        out: list[list[tuple[str, float]]] = []
        inner = [k for k, c in enumerate(token) if c.isalnum()]
        lo, hi = (inner[0], inner[-1]) if inner else (0, len(token) - 1)
        i = 0
        while i < len(token):
            c, k = token[i], i + 1
            while k < len(token) and token[k] == c:
                k += 1
            n, at, i = k - i, i, k
            arcs: list[tuple[str, float]] = []
            if c.isalpha():
                arcs = [(c, _REPEAT * (n > 1))] + ([(c + c, _REPEAT * (n > 2))] if n > 1 else [])
                if (plain := bare(c)) != c:
                    arcs += [(plain, _BARE + _REPEAT * (n > 1))]
            for x in LEET.get(c, ""):
                arcs += [(x, _SWAP + _REPEAT * (n > 1))] + ([(x + x, _SWAP)] if n > 1 else [])
            inside = lo <= at <= hi
            if not arcs or (c in SEPARATORS and (edges or inside)):
                arcs += [("", _DROP), (" ", _DROP)]
            elif not c.isalnum() and inside:
                arcs.append(("", _JUNK))
            elif edges and not inside:
                arcs.append(("", _DROP))
            out.append(arcs)
        return out

    def decode(self, lattice: list[list[tuple[str, float]]]) -> str:
        """The likeliest way through a lattice."""
        states: dict[tuple[str, str], tuple[float, tuple]] = {("\x02", "\x02"): (0.0, ())}
        for arcs in lattice:
            new: dict[tuple[str, str], tuple[float, tuple]] = {}
            for (a, b), (score, path) in states.items():
                for letters, weight in arcs:
                    x, y, total = a, b, score + weight
                    for c in letters:
                        if c == " ":
                            total += self.chance(x, y, "\x03") if y != "\x02" else 0.0
                            x = y = "\x02"
                        else:
                            total += self.chance(x, y, c)
                            x, y = y, c
                    old = new.get((x, y))
                    if old is None or total > old[0]:
                        new[x, y] = (total, (path, letters))
            states = new
        path = max((score + self.chance(a, b, "\x03"), k) for k, ((a, b), (score, _)) in enumerate(states.items()))[1]
        path, out = list(states.values())[path][1], []
        while path:
            path, letters = path
            out.append(letters)
        return "".join(reversed(out))

    def restore(self, token: str, edges: bool = True) -> str:
        return self.decode(self.lattice(token, edges))

    def restore_run(self, tokens: list[str]) -> str:
        """Pieces set apart by spaces: a word may end at each space, and a single letter may repeat the one before."""
        out: list[list[tuple[str, float]]] = []
        before = ""
        for t in tokens:
            letter = "".join(c for c in t if c.isalnum())
            if out:
                out.append([("", _JOIN if max(len(letter), len(before)) > 1 else 0.0), (" ", 0.0)])
            own = self.lattice(t)
            if len(letter) == 1 and letter == before:
                own = [[*arcs, ("", _REPEAT)] if any(x == letter or x in LEET.get(letter, "") for x, _ in arcs if x) else arcs for arcs in own]
            before = letter or before
            out += own
        return self.decode(out)


def suspicious(token: str) -> str | None:
    """The part of a lower-case token to restore, or None where its letters are plain."""
    core = _EDGES.match(token)[1]
    if core.isalpha():
        return core if _REPEATED.search(core) or not core.isascii() and bare(core) != core else None
    return core if any(c.isalpha() or c in LEET for c in core) else None


class Scorer:
    def __init__(self, model: ToxicModel, min_letters: int = 4):
        self.model, self.restorer = model, Restorer(model)
        self.heads = {f[:min_letters].rstrip("^") for f in (*model.words, *model.beginnings)}
        self.head = min_letters
        self.marks = ahocorasick.Automaton()
        for f in (*model.words, *model.beginnings):
            self.marks.add_word(outline(f.rstrip("^")), 0)
        if len(self.marks):
            self.marks.make_automaton()

    def word(self, word: str) -> float:
        """Chance of label 1 given a word of letters; 0 without evidence."""
        if word[: self.head] not in self.heads:
            return 0.0
        m, best = self.model, self.model.words.get(word, 0.0)
        if m.beginnings:
            for k in range(m.min_beginning, min(m.max_beginning, len(word)) + 1):
                best = max(best, m.beginnings.get(word[:k] + "^", 0.0))
        return best

    def evidence(self, words: Iterable[str]) -> float:
        """Log of the chance that all of the words speak for label 0 only."""
        return sum(math.log1p(-min(p, 1 - 1e-9)) for w in set(words) if (p := self.word(w)))

    def tokens(self, tokens: Iterable[str]) -> list[float]:
        """Logs of the chances that tokens speak for label 0 only."""
        out: list[float] = []
        cores: list[str] = []
        places: list[int] = []
        for token in tokens:
            low = token.lower()
            if plain := low.isalpha():
                p = self.word(low)
                out.append(math.log1p(-min(p, 1 - 1e-9)) if p else 0.0)
            else:
                out.append(self.evidence(_LETTERS.findall(low)))
            if not (plain and low.isascii() and not _REPEATED.search(low)) and (core := suspicious(low)):
                cores.append(core)
                places.append(len(out) - 1)
        for k in self.hiding(cores):
            core, at = cores[k], places[k]
            inner = core.strip(_SIGNS)
            ways = {self.restorer.restore(core)} if inner == core else {self.restorer.restore(x, edges) for x, edges in ((core, True), (core, False), (inner, True))}
            out[at] = min(out[at], *(self.evidence(w.split()) for w in ways), 0.0)
        return out

    def run(self, tokens: list[str]) -> list[str]:
        """The words of the lexicon in pieces set apart by spaces: of the likeliest way through the whole run or, where it
        has none, through its rest from a piece on at which an entry of the lexicon begins."""
        for k in range(len(tokens)):
            if k == 0 or self.may_hide("".join(tokens[k:]), True):
                if found := [w for w in set(self.restorer.restore_run(tokens[k:]).split()) if self.word(w)]:
                    return found
        return []

    def may_hide(self, text: str, first: bool = False) -> bool:
        """Whether an entry of the lexicon can come out of a text (at its beginning): no way through its lattice has one
        whose outline the text's outlines lack, if its signs go the same way, all as letters or all as nothing, and its
        letters all keep their marks or all lose them. A text with an asterisk always may."""
        if not len(self.marks):
            return False
        if "*" in text:
            return True
        ways = {outline(text)} if text.isalnum() else {outline(text), outline(text, True)}
        if not text.isascii():
            ways |= {outline(w) for w in map(bare, (text, *ways))}
        return any(not first or found for w in ways for _, found in self._found(w))

    def _found(self, text: str) -> Iterator[tuple[int, bool]]:
        """Ends of entries in an outline, and whether what goes up to there is an entry."""
        for end, _ in self.marks.iter(text):
            yield end, self.marks.exists(text[: end + 1])

    def hiding(self, texts: list[str]) -> list[int]:
        """Which of many texts without line ends `may_hide`, all read as lines of one."""
        if not len(self.marks):
            return []
        found = {k for k, t in enumerate(texts) if "*" in t}
        drawn: list[tuple[list[int], list[str]]] = []
        for plain in (True, False):
            own = [k for k, t in enumerate(texts) if t.isascii() == plain]
            signs = [k for k in own if not texts[k].isalnum()]
            ways = [(own, outlines([texts[k] for k in own])), (signs, outlines([texts[k] for k in signs], True))]
            drawn += ways
            if not plain:
                ways.append((own, [texts[k] for k in own]))
                drawn += [(places, outlines("\n".join(lines).translate(_BARE_LETTERS).split("\n"))) for places, lines in ways if lines]
        for places, lines in drawn:
            ends = np.fromiter((end for end, _ in self.marks.iter("\n".join(lines))), np.int64)
            sizes = np.fromiter(map(len, lines), np.int64, len(lines)) + 1
            found.update(places[k] for k in set(np.searchsorted(np.cumsum(sizes), ends, "right").tolist()))
        return sorted(found)


def outline(text: str, drop: bool = False) -> str:
    """Letters without repeats, digits and signs as what they may stand for, i and l as one; separators and other signs,
    with `drop` all signs, as nothing."""
    plain = text.translate(_DROPPED if drop else _READ)
    return _REPEATS.sub(r"\1", plain if plain.isalpha() else "".join([c for c in plain if c.isalpha()]))


def outlines(texts: list[str], drop: bool = False) -> list[str]:
    """The outline of each of many texts without line ends."""
    plain = "\n".join(texts).translate(_LINES_DROPPED if drop else _LINES_READ)
    if not plain.isascii():
        odd = {c for c in set(plain) if not c.isalpha() and c != "\n"}
        if len(odd) > 20:
            plain = "".join([c for c in plain if c not in odd])
        else:
            for c in odd:
                plain = plain.replace(c, "")
    return _REPEATS.sub(r"\1", plain).split("\n") if texts else []


_READ = {**{c: None for c in range(128) if not chr(c).isalpha()}, **{ord(c): x[0] for c, x in LEET.items()}, ord("l"): "i", ord("1"): "i", ord("|"): "i", ord("£"): "i"}
_DROPPED = {c: x if chr(c).isalnum() else None for c, x in _READ.items()}
_LINES_READ, _LINES_DROPPED = ({**x, ord("\n"): "\n"} for x in (_READ, _DROPPED))
_REPEATS = re.compile(r"(.)\1+")


#: Bytes that count as a letter or digit: ASCII ones, and the first bytes of the letters of other scripts.
_LETTER_BYTES = np.zeros(256, np.int64)
_LETTER_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(0xC3, 0xE2), *range(0xE3, 0xEE)]] = 1


def _worker(model: ToxicModel) -> Callable:
    scorer = Scorer(model)

    def columns(words: list[bytes]) -> dict:
        return {"log": np.array(scorer.tokens(w.decode("utf-8", "replace") for w in words), float)}

    cache = WordCache(columns)
    in_runs: dict[bytes, list[str]] = {}

    def read_runs(raws: list[bytes]) -> None:
        if len(in_runs) >= 20_000:
            in_runs.clear()
        fresh = [x for x in dict.fromkeys(raws) if x not in in_runs]
        pieces = [_SPACE.split(x.decode("utf-8", "replace").lower().strip(_BLANKS)) for x in fresh]
        in_runs.update((x, []) for x in fresh)
        for k in scorer.hiding(["".join(x) for x in pieces]):
            in_runs[fresh[k]] = scorer.run(pieces[k])

    def work(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Evidence, hits and words of each text."""
        n = len(off) - 1
        starts, ends, text = runs(data, off, SPACES)
        row = cache.look(data, starts, ends, run_hashes(data, starts, ends))
        log = cache.columns["log"][row] if len(row) else np.zeros(0)
        at = np.flatnonzero(log < 0)
        _, first = np.unique(np.stack([text[at], row[at]]), axis=1, return_index=True)
        at = at[first]
        hits = np.bincount(text[log < 0], minlength=n)
        sums = np.bincount(text[at], log[at], n)
        count = np.concatenate([[0], np.cumsum(_LETTER_BYTES[data])])
        size = count[ends] - count[starts]
        short = size <= PIECE
        head = short.copy()
        head[1:] &= ~(short[:-1] & (text[1:] == text[:-1]))
        tail = short.copy()
        tail[:-1] &= ~(short[1:] & (text[1:] == text[:-1]))
        upto = np.concatenate([[0], np.cumsum(size)])
        seen: set[tuple[int, str]] = set()
        a, b = np.flatnonzero(head), np.flatnonzero(tail)
        many = (b > a) & (upto[b + 1] - upto[a] >= scorer.head)
        raws = [data[x:y].tobytes() for x, y in zip(starts[a[many]].tolist(), ends[b[many]].tolist(), strict=True)]
        read_runs(raws)
        for k, x in zip(text[a[many]].tolist(), raws, strict=True):
            for w in in_runs[x]:
                hits[k] += 1
                if (k, w) not in seen:
                    seen.add((k, w))
                    sums[k] += scorer.evidence([w])
        return sums, hits, np.bincount(text, minlength=n)

    return work


def fit_from(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> ToxicModel:
    """The model of all labelled texts, one of each family of near copies, and of the share of label 1, none of them held
    out."""
    space = Workspace(docs.sparkSession, "families")
    try:
        return fit(*labelled_families(space, docs, labels, "toxic", id_col=id_col, text_col=text_col), prior=share_of(labels, "toxic", id_col))
    finally:
        space.drop("")


def score(df: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df`: the chance of label 1."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def fn() -> Callable:
        work = _worker(shared.value)
        return lambda data, off, batch: {"id": batch.column(0), "score": pa.array(chances(shared.value, *work(data, off)))}

    return map_texts(df, fn, "id bigint, score double", id_col, text_col).withColumnRenamed("id", id_col)


def filter_toxic(df: DataFrame, model: ToxicModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of `df` that score below the threshold, with all their columns."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def keep() -> Callable:
        work = _worker(shared.value)
        return lambda data, off, batch: chances(shared.value, *work(data, off)) < threshold

    return filter_rows(df, keep, text_col)

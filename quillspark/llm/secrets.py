"""Secret scans.

Base kinds are fixed patterns: assignments of secret-named values, access keys, long hex strings. The method adds
spans of high entropy: over candidate strings a window slides, character counts are updated by one character in and
one out, and the window's Shannon entropy is held against the limit of its character class: hexadecimal, letters alone,
letters and digits, or these with signs. An allow-list suppresses
known harmless forms. Spans are in code points, end exclusive.

Edge cases: a null or empty text has no spans (and stays as it is under `redact`); null ids stay null; repeated rows
are scanned one by one; texts of any length are scanned whole; extra columns are ignored by `scan` and kept by
`redact`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts, string_column, tidily

KINDS = ("assign", "access", "hex", "entropy")
_NAMES = ("password", "passwd", "secret", "token", "api_?key")
_EITHER = "|".join(re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", n) for n in _NAMES)
ASSIGN = re.compile(rf"""({_EITHER})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
_HINTS = ("passw", "secret", "token", "apikey", "api_key")


@dataclass(frozen=True)
class EntropyRules:
    """Limits in bits a character for windows of `window` characters, by the window's character class."""

    window: int = 20
    hex_limit: float = 3.0
    alphanumeric_limit: float = 3.7
    base64_limit: float = 3.9
    letters_limit: float = 3.7
    #: Windows of letters alone need so many capitals and so many small letters, and so many changes of case from one
    #: letter to the next, more where no two capitals stand side by side: words in camel case or capitals lack one of these.
    letters_each: int = 6
    letters_changes: int = 7
    letters_changes_alone: int = 14
    #: Forms that are no secrets: UUIDs, digits alone, dates and versions, file paths, names with a number.
    allowed: tuple[str, ...] = (
        r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
        r"[0-9_/=+-]+",
        r"(?:[A-Za-z]+[_/-])+[A-Za-z0-9]{0,6}",
        r"[A-Za-z_-]+[0-9]{1,4}",
    )


CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_LOWER_HEX, _UPPER_HEX = frozenset("0123456789abcdef"), frozenset("0123456789ABCDEF")
_MARKS = frozenset("+/=_-")


def entropy_spans(text: str, rules: EntropyRules, allowed: re.Pattern) -> list[tuple[int, int]]:
    """Unions of the windows over their class's limit, within candidate strings."""
    out, w = [], rules.window
    xlogx = [0.0] + [k * log2(k) for k in range(1, w + 2)]
    top = log2(w)
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if allowed.fullmatch(s):
            continue
        counts: dict[str, int] = {}
        total, marks, lower, upper, digits, capitals, changes, twins = 0.0, 0, 0, 0, 0, 0, 0, 0
        start = stop = -1
        for i, c in enumerate(s):
            k = counts.get(c, 0)
            total += xlogx[k + 1] - xlogx[k]
            counts[c] = k + 1
            marks += c in _MARKS
            lower += c not in _LOWER_HEX
            upper += c not in _UPPER_HEX
            digits += c.isdigit()
            capitals += c.isupper()
            if i:
                changes += c.isupper() != s[i - 1].isupper()
                twins += c.isupper() and s[i - 1].isupper()
            if i >= w:
                old = s[i - w]
                k = counts[old]
                total += xlogx[k - 1] - xlogx[k]
                counts[old] = k - 1
                marks -= old in _MARKS
                lower -= old not in _LOWER_HEX
                upper -= old not in _UPPER_HEX
                digits -= old.isdigit()
                capitals -= old.isupper()
                changes -= old.isupper() != s[i - w + 1].isupper()
                twins -= old.isupper() and s[i - w + 1].isupper()
            mixed = not digits and not marks and changes >= (rules.letters_changes if twins else rules.letters_changes_alone) and rules.letters_each <= capitals <= w - rules.letters_each
            if i >= w - 1 and (0 < digits < w or mixed):
                limit = rules.letters_limit if not digits else rules.hex_limit if not lower or not upper else rules.base64_limit if marks else rules.alphanumeric_limit
                if top - total / w >= limit:
                    if i - w + 1 > stop and stop >= 0:
                        out.append((m.start() + start, m.start() + stop))
                        start = -1
                    start, stop = (i - w + 1 if start < 0 else start), i + 1
        if stop >= 0:
            out.append((m.start() + start, m.start() + stop))
    return out


def without(span: tuple[int, int], others: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pieces of a span that none of the others, in order, covers."""
    out, (at, end) = [], span
    for a, b in others:
        if b <= at:
            continue
        if a >= end:
            break
        if a > at:
            out.append((at, a))
        at = b
    return [*out, (at, end)] if at < end else out


def find_spans(text: str, rules: EntropyRules = EntropyRules(), allowed: re.Pattern | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans, in order; entropy spans give way to base spans where they overlap, and what
    remains of them on either side is kept."""
    found = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    allowed = allowed or re.compile("|".join(rules.allowed))
    base = sorted((a, b) for a, _, b in found)
    found += [(a, 3, b) for span in entropy_spans(text, rules, allowed) for a, b in without(span, base)]
    return sorted(found)


def show(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = "id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_entropy bigint, base_sha256 string, spans string"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: EntropyRules = EntropyRules()) -> DataFrame:
    """One row per row of `df`: counts by kind, all spans, and a digest of the base spans."""

    def fn() -> Callable:
        allowed = re.compile("|".join(rules.allowed))

        def work(data: np.ndarray, off: np.ndarray, batch: pa.RecordBatch) -> dict:
            raw, at = data.tobytes(), off.tolist()
            got = [find_spans(raw[a:b].decode("utf-8", "replace"), rules, allowed) for a, b in zip(at[:-1], at[1:], strict=True)]
            counts = np.array([[sum(k == x for _, k, _ in s) for x in range(4)] for s in got], np.int64).reshape(-1, 4)
            digest = [hashlib.sha256(show(x for x in s if x[1] < 3).encode()).hexdigest() for s in got]
            return {"id": batch.column(0), "n_assign": counts[:, 0], "n_access": counts[:, 1], "n_hex": counts[:, 2], "n_entropy": counts[:, 3], "base_sha256": pa.array(digest, pa.string()), "spans": pa.array([show(s) for s in got], pa.string())}

        return work

    return map_texts(df, fn, SCHEMA, id_col, text_col).withColumnRenamed("id", id_col)


def redact_text(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[secret]", rules: EntropyRules = EntropyRules()) -> DataFrame:
    """All rows and columns of `df` with secrets replaced by `mark`; `length_col`, if present, follows the new text."""
    schema = df.schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = re.compile("|".join(rules.allowed))
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = string_column(batch, text_col).to_pylist()
            changed = {i: redact_text(t, s, mark) for i, t in enumerate(texts) if (s := find_spans(t, rules, allowed))}
            if changed:
                old = batch.column(at).to_pylist()
                cols = list(batch.columns)
                cols[at] = pa.array([changed.get(i, t) for i, t in enumerate(old)], batch.schema.field(at).type)
                n = batch.schema.get_field_index(length_col) if length_col else -1
                if n >= 0:
                    cols[n] = pa.array([len(changed[i]) if i in changed else x for i, x in enumerate(cols[n].to_pylist())], batch.schema.field(n).type)
                batch = pa.RecordBatch.from_arrays(cols, schema=batch.schema)
            yield batch

    return df.mapInArrow(tidily(run), schema)

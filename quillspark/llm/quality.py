"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths, in numpy, measure how many characters of a text lie inside duplicated
n-grams; lines are compared by their bytes. A word's hash mixes its bytes as two 64-bit numbers (up to 16
bytes) or is its XXH3 (longer words). The hashes of n words in a row are rolled on from those of fewer. Hashes only bring
together what may be equal: words with one hash are compared by their bytes, n-grams with one hash by their words, and where
two differ all of the batch are numbered by their contents instead. Everything is per document, so the operator is one narrow
stage without a shuffle: skew between sources or documents that are copies of each other do not matter.

Defined results: a null or empty text, or one of white space only, has zero in all counts and fails the base rules (it
has under 50 words). Repeated rows and ties give repeated results. Extra columns pass through `quality_filter` and are
ignored by `repetition`. An empty table gives an empty table. A text longer than a batch is a batch of its own; memory
is then about 30 bytes for each of its bytes. Lines, words and n-grams that differ are never taken for equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import map_slices, raw

#: Share of a text's word characters that may lie inside n-grams found twice or more, by n.
MAX_COVERED = {5: 0.40, 7: 0.35, 10: 0.30}
MAX_DUP_LINES, MAX_DUP_LINE_CHARS = 0.40, 0.40
#: Symbols a word, punctuation a word character, and share of words that hold a letter.
MAX_SYMBOLS, MAX_PUNCTUATION, MIN_LETTER_WORDS = 0.10, 0.20, 0.70
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    + ", ".join(f"covered_{n} double" for n in MAX_COVERED)
    + ", dup_line_chars double, symbol_ratio double, punctuation_ratio double, letter_words double"
)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[b for b in range(256) if b >= 0x80 or chr(b).isalpha()]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SALTS = [np.uint64(x | 1) for x in np.random.default_rng(7).integers(1, 1 << 63, 3, dtype=np.uint64).tolist()]
#: What is kept of a 64-bit number that holds so many bytes of a word.
_HOLDS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word data[start:end]."""
    if not len(start):
        return np.zeros(0, np.uint64)
    eight = np.ndarray(len(data) + 8, "<u8", data + b"\0" * 16, strides=(1,))  # the eight bytes from each place on
    size = end - start
    low = eight[start] & _HOLDS[np.minimum(size, 8)]
    high = eight[start + np.minimum(size, 8)] & _HOLDS[np.clip(size - 8, 0, 8)]
    out = _mix(_mix(low + _SALTS[0]) + high * _SALTS[1] + size.astype(np.uint64) * _SALTS[2])
    for i in np.flatnonzero(size > 16).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]], 7)
    return out


def gram_hashes(words: np.ndarray, sizes: tuple[int, ...]) -> Iterator[np.ndarray]:
    """For each size (ascending), the hashes of all runs of so many words, rolled on from the shorter runs that start there."""
    out, done = np.zeros(len(words), np.uint64), 0
    for size in sizes:
        n = max(0, len(words) - size + 1)
        out = out[:n]
        for k in range(done, size):
            out = out * _BASE + words[k : k + n]
        done = size
        yield _mix(out)


def told_apart(keys: np.ndarray, same: Callable[[np.ndarray, np.ndarray], np.ndarray], value: Callable[[int], object]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of which equal ones stand for equal things, and whether each is found twice or more.

    Neighbours among equal keys are compared by `same`; if any two differ (texts can be made so), all are numbered by `value`.
    """
    again = np.zeros(len(keys), bool)
    if len(keys) < 2:
        return keys, again
    order = np.argsort(keys, kind="stable")
    at = np.flatnonzero(keys[order][1:] == keys[order][:-1])
    a, b = order[at], order[at + 1]
    if len(at) and not same(a, b).all():
        numbers: dict = {}
        exact = np.array([numbers.setdefault(value(i), len(numbers)) for i in range(len(keys))], np.uint64)
        return exact, (np.bincount(exact.astype(np.int64)) > 1)[exact.astype(np.int64)]
    again[a] = again[b] = True
    return keys, again


def word_ids(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number of each word data[start:end]; words have the same one if and only if their bytes are equal."""
    size = end - start
    eight = np.ndarray(len(data) + 8, "<u8", data + b"\0" * 16, strides=(1,))

    def same(a, b):
        low = [eight[start[x]] & _HOLDS[np.minimum(size[x], 8)] for x in (a, b)]
        high = [eight[start[x] + np.minimum(size[x], 8)] & _HOLDS[np.clip(size[x] - 8, 0, 8)] for x in (a, b)]
        equal = (low[0] == low[1]) & (high[0] == high[1]) & (size[a] == size[b])
        for k in np.flatnonzero(equal & (size[a] > 16)).tolist():
            equal[k] = data[start[a[k]] : end[a[k]]] == data[start[b[k]] : end[b[k]]]
        return equal

    return told_apart(word_hashes(data, start, end), same, lambda i: data[start[i] : end[i]])[0]


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Counts and coverages of each of the texts (UTF-8)."""
    n = len(texts)
    data = b"\n".join(texts) + b"\n"
    buf = np.frombuffer(data, np.uint8)
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    space = _SPACE[buf]
    edge = np.diff(np.concatenate(([True], space)).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    owner = np.searchsorted(offsets, start, "right") - 1

    def prefix(mask):
        out = np.zeros(len(mask) + 1, np.int32 if len(mask) < 1 << 31 else np.int64)
        np.cumsum(mask, out=out[1:])
        return out

    chars = prefix(((buf & 0xC0) != 0x80) & ~space)
    each = lambda mask: np.add.reduceat(mask, offsets[:-1], dtype=np.int64)
    count = lambda rows, weights=None: np.bincount(rows, weights, n)
    out = {"n_words": count(owner), "word_chars": (chars[offsets[1:]] - chars[offsets[:-1]]).astype(np.int64), "n_symbols": each(_SYMBOL[buf])}
    punct, letters = each(_PUNCT[buf]), prefix(_LETTER[buf])
    words, word_chars = word_ids(data, start, end), chars[end] - chars[start]
    salt = _mix(np.arange(1, n + 1).astype(np.uint64) * _BASE)
    sizes = (3, *MAX_COVERED)
    for size, hashes in zip(sizes, gram_hashes(words, sizes)):
        first = np.arange(max(0, len(words) - size + 1))
        first = first[owner[first] == owner[first + size - 1]] if len(first) else first
        at = np.arange(size)
        same = lambda a, b: (owner[first[a]] == owner[first[b]]) & (words[first[a][:, None] + at] == words[first[b][:, None] + at]).all(axis=1)  # noqa: E731, B023
        _, again = told_apart(hashes[first] ^ salt[owner[first]], same, lambda i: (owner[first[i]], words[first[i] : first[i] + size].tobytes()))  # noqa: B023
        covered = np.zeros(len(words), bool)
        for k in range(size):
            covered[first[again] + k] = True
        if size == 3:
            out["n_repeat_words"] = count(owner[covered])
        else:
            out[f"covered_{size}"] = count(owner[covered], word_chars[covered])
    line_end = np.flatnonzero(buf == 0x0A)
    line_start = np.concatenate(([0], line_end[:-1] + 1)) if len(line_end) else line_end
    worded = chars[line_end] > chars[line_start]
    line_start, line_end = line_start[worded], line_end[worded]
    of = np.searchsorted(offsets, line_start, "right") - 1
    later, seen, at = np.zeros(len(of), bool), set(), -1
    for i, (a, b, k) in enumerate(zip(line_start.tolist(), line_end.tolist(), of.tolist())):
        if k != at:
            seen, at = set(), k
        line = data[a:b]
        if line in seen:
            later[i] = True
        else:
            seen.add(line)
    out["n_lines"], out["n_dup_lines"] = count(of), count(of[later])
    out["dup_line_chars"] = count(of[later], (chars[line_end] - chars[line_start])[later])
    total, n_words = np.maximum(out["word_chars"], 1), np.maximum(out["n_words"], 1)
    for name in [*(f"covered_{k}" for k in MAX_COVERED), "dup_line_chars"]:
        out[name] = out[name] / total
    out["symbol_ratio"], out["punctuation_ratio"] = out["n_symbols"] / n_words, punct / total
    out["letter_words"] = count(owner[letters[end] > letters[start]]) / n_words
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    bad = out["base_failed"] | (out["n_dup_lines"] > MAX_DUP_LINES * out["n_lines"]) | (out["dup_line_chars"] > MAX_DUP_LINE_CHARS)
    for k, most in MAX_COVERED.items():
        bad |= out[f"covered_{k}"] > most
    out["kept"] = ~(bad | (out["symbol_ratio"] > MAX_SYMBOLS) | (out["punctuation_ratio"] > MAX_PUNCTUATION) | (out["letter_words"] < MIN_LETTER_WORDS))
    return out


_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = measure(raw(batch.column("text")))
    columns = [batch.column("doc_id")] + [pa.array(found[k] if found[k].dtype in (bool, np.float64) else found[k].astype(np.int64)) for k in _NAMES[1:]]
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)


def repetition(docs: DataFrame) -> DataFrame:
    """A row of counts, coverages and the verdict for each document."""
    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "text", SCHEMA, _rows)


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns. The verdict is made row by row, so nothing is joined or shuffled."""
    names = docs.columns

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(measure(raw(batch.column("text")))["kept"]))

    return map_slices(docs, "text", docs.schema, keep).select(*names)

"""Vectorised word hashing over batches of texts.

A word is a run of characters whose Unicode category is a letter or a number, or the underscore, after lower-casing.
Equal words have equal 64-bit hashes everywhere; nothing depends on the batch that a text came in.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ripplegraph.runtime import ship

U = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
CHUNK_CHARS = 200_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift)."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


@lru_cache(1)
def _kinds() -> np.ndarray:
    """For each code point: 2 for a letter, 1 for a number or the underscore, else 0."""
    kind = {"L": 2, "N": 1}
    table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[ord("_")] = 1
    return table


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i below n."""
    if not _powers or len(_powers[0]) < n:
        inverse, size = pow(BASE, -1, 1 << 64), max(n, 1 << 18)
        _powers[:] = []
        for b in (BASE, inverse):
            p = np.full(size, b, U)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0][:n], _powers[1][:n]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, each followed by a 0, and the position where each text starts (one more at the end)."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
    joined = "\0".join([*texts, ""])
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), bounds


def word_spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """code points, starts and ends of all words, and the number of the first word of each text (one more at the end)."""
    codes, bounds = code_points([t.lower() for t in texts])
    inside = np.empty(len(codes) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = _kinds()[codes] > 0
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return codes, starts, ends, np.searchsorted(starts, bounds)


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word of all texts, and the number of the first word of each text (one more at the end)."""
    codes, starts, ends, first = word_spans(texts)
    up, down = powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, U)
    np.cumsum(mix(codes.astype(U) + U(1)) * up[: len(codes)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts]), first


def shingles(w: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of all runs of k words; a text of 1 to k-1 words has one, of all its words; an empty text none."""
    if not len(w):
        return w
    k = min(k, len(w))
    h = w[: len(w) - k + 1].copy()
    for j in range(1, k):
        h *= U(0x9FB21C651E98DF25)
        h += w[j : len(w) - k + 1 + j]
    return mix(h + U(k))


def chunks(texts: list[str | None], chars: int = CHUNK_CHARS, most: int = 4096) -> Iterator[tuple[int, list[str]]]:
    """Runs of at most so many texts (null: empty) and about so many characters, with the number of the first."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars or i + 1 - at >= most:
            yield at, [x or "" for x in texts[at : i + 1]]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, [x or "" for x in texts[at:]]


def keep_where(documents: DataFrame, decider: Callable[[], Callable[[list[str]], np.ndarray]], most: int = 4096) -> DataFrame:
    """The rows of documents whose text is kept, with all their columns as they are. decider() is called once a task and gives
    the function from texts (null: empty) to booleans."""
    ship(documents.sparkSession)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = decider()
        for b in batches:
            for at, texts in chunks(b["text"].to_pylist(), most=most):
                yield b.slice(at, len(texts)).filter(pa.array(decide(texts)))

    return documents.mapInArrow(kept, documents.schema)

"""Benchmark decontamination: SimHash fingerprints of item-sized windows, multi-index Hamming search, exact verification.

Items fall into width classes (a geometric row of widths; an item of m words takes the largest width of at most 4/5 m).
An item has a 64-bit SimHash of its words for each run of its width; a document has one for every run of each width that
starts at a multiple of a quarter of the width. Wherever a document holds a passage of the item's length, one of its runs
thus lies wholly within the passage, opposite an equal run of the item.

A fingerprint is cut into four blocks of 16 bits. Two fingerprints within RADIUS = 11 bits differ by at most two bits in
some block, so a table of the items' block values with up to two bits flipped finds every pair within the radius; the
others are never compared. Each candidate places the whole item over the document; the similarity of the item's five-word
shingles and those of that item-sized window (weighted Jaccard, weights the number of occurrences; windows up to two words
to either side are tried as well) must reach THRESHOLD.

Items of one to four words have one shingle, of all their words, and match equal runs of as many words.

The index (fingerprints, block tables, shingles) is built once on the driver, ITEMS items at a time, and written to one file,
which Spark's file server hands out and tasks map into memory; documents are read once, row by row without a shuffle,
however many items there are, and no document's texts meet another's.

Defined cases: null and empty texts, and items without words, match nothing; a null
doc_id or item_id is carried along; repeated documents each get their rows; repeated items each match; ties in
similarity go to the earliest place; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from ripplegraph.llm import textkit
from ripplegraph.llm.handout import get, hand_out, put
from ripplegraph.runtime import ship

SHINGLE = 5
THRESHOLD = 0.8
BLOCKS, BLOCK_BITS, FLIPS = 4, 16, 2
RADIUS = BLOCKS * (FLIPS + 1) - 1
ITEMS = 2000
KNOWN_BITS = 20
MATCHES = "doc_id long, item_id long, similarity double, start_word long, n_words long"
_FLIPPED = np.array([sum(1 << b for b in bits) for k in range(FLIPS + 1) for bits in combinations(range(BLOCK_BITS), k)], np.int64)


def width_of(m: int) -> int:
    """The largest of the class widths 4, 5, 6, 7, 8, 10, 12, ... (each a quarter more, rounded down) of at most 4/5 m."""
    w = 4
    while 5 * (nxt := max(w + 1, w * 5 // 4)) <= 4 * m:
        w = nxt
    return w


def lane_of(width: int) -> int:
    return 8 if width < 256 else 16


def sums(w: np.ndarray, lane: int = 8) -> np.ndarray:
    """Running sums of the words' hash bits, in lanes of 8 or 16 bits packed into 64-bit integers. Carries between lanes cancel in the
    difference of two sums, so the bit counts of any run shorter than 2^lane words come out right."""
    spread = (np.arange(256, dtype=np.uint8)[:, None] >> np.arange(7, -1, -1, dtype=np.uint8)) & 1
    spread = spread.astype("<u2" if lane == 16 else np.uint8).view("<u8")
    parts = spread[w.view(np.uint8).reshape(-1, 8)].reshape(len(w), -1).T
    out = np.zeros((len(parts), len(w) + 1), np.uint64)
    np.cumsum(parts, axis=1, out=out[:, 1:])
    return out


def fingerprints(total: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """SimHash of the `width` words from each start: the bits set in more than half of the words' hashes."""
    counts = np.ascontiguousarray((total[:, starts + width] - total[:, starts]).T)
    counts = counts.view(np.uint8 if len(total) == 8 else "<u2")
    return np.packbits(counts > width // 2, axis=1).view(np.uint64).ravel()


def class_of(m: int) -> tuple[int, int]:
    """The width class of items of m words, and how far apart documents' runs start: any m words hold one run of that grid."""
    if m < SHINGLE:
        return m, 1
    width = width_of(min(m, 1 << 15))
    return width, width // 4 + 1


def block_arrays(items: list[tuple[int | None, str | None]]) -> dict[str, np.ndarray]:
    """The index of some items as plain arrays: names, lengths, shingles with counts, and for each width class its runs' fingerprints with
    a table for each block of bits (first entry of each value; runs with such a value or one up to FLIPS bits off)."""
    names, lengths, shingles, counts = [], [], [], []
    runs: dict[tuple[int, int], list] = {}
    for name, text in items:
        w, _ = textkit.words([text or ""])
        if not len(w):
            continue
        width, step = class_of(len(w))
        at = np.arange(len(w) - width + 1)
        runs.setdefault((width, step), []).append((fingerprints(sums(w, lane_of(width)), at, width), np.full(len(at), len(names)), at))
        names.append(name)
        lengths.append(len(w))
        s, n = np.unique(textkit.shingles(w, SHINGLE), return_counts=True)
        shingles.append(s)
        counts.append(n)
    places = np.zeros(len(names) + 1, np.int64)
    np.cumsum([len(s) for s in shingles], out=places[1:])
    known = np.zeros(1 << KNOWN_BITS, bool)
    for s in shingles:
        known[s >> np.uint64(64 - KNOWN_BITS)] = True
    out = {
        "names": np.array([n or 0 for n in names], np.int64),
        "unnamed": np.array([n is None for n in names], bool),
        "lengths": np.array(lengths, np.int64),
        "places": places,
        "shingles": np.concatenate([np.zeros(0, np.uint64), *shingles]),
        "counts": np.concatenate([np.zeros(0, np.int64), *counts]),
        "known": known,
    }
    for (width, step), rows in sorted(runs.items()):
        prints, item, offset = (np.concatenate(c) for c in zip(*rows, strict=True))
        key = f"{width}/{step}/"
        out |= {key + "prints": prints, key + "item": item, key + "offset": offset}
        for b in range(BLOCKS):
            value = _block(prints, b)
            near = (value[:, None] ^ _FLIPPED).ravel().astype(np.uint16)
            order = np.argsort(near, kind="stable")
            first = np.zeros((1 << BLOCK_BITS) + 1, np.int64)
            np.cumsum(np.bincount(near, minlength=1 << BLOCK_BITS), out=first[1:])
            out |= {f"{key}first{b}": first, f"{key}runs{b}": (order // len(_FLIPPED)).astype(np.int32)}
    return out


def _block(prints: np.ndarray, b: int) -> np.ndarray:
    return ((prints >> np.uint64(BLOCK_BITS * b)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)


def write_index(items: Iterable[tuple[int | None, str | None]], path: str) -> None:
    """One file: arrays of each block of ITEMS items, then a table of where they are, then its place."""
    told, held = [], []
    with open(path, "wb") as f:

        def flush() -> None:
            if held:
                told.append({name: put(f, a) for name, a in block_arrays(held).items()})
                held.clear()

        for item in items:
            held.append(item)
            if len(held) >= ITEMS:
                flush()
        flush()
        at = f.tell()
        f.write(json.dumps(told).encode())
        f.write(at.to_bytes(8, "little"))


class Index:
    """An index file, mapped into memory."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        at = int.from_bytes(raw[-8:].tobytes(), "little")
        self.blocks = [Block({name: get(raw, t) for name, t in told.items()}) for told in json.loads(raw[at:-8].tobytes())]
        self.classes = sorted({c for b in self.blocks for c in b.classes})

    def scan(self, texts: list[str]) -> list[tuple[int, int | None, float, int, int]]:
        """(text, item's name, similarity, first word, words) of the best place of each item in each text that reaches THRESHOLD."""
        w, first = textkit.words(texts)
        if not len(w) or not self.blocks:
            return []
        total = {lane: sums(w, lane) for lane in {lane_of(width) for width, _ in self.classes}}
        doc_of = np.repeat(np.arange(len(texts)), np.diff(first))
        ends = first[1:][doc_of]
        since = np.arange(len(w)) - first[:-1][doc_of]
        grid = {}
        for width, step in self.classes:
            starts = np.flatnonzero((since % step == 0) & (np.arange(len(w)) + width <= ends))
            grid[width, step] = starts, fingerprints(total[lane_of(width)], starts, width)
        shingles = (textkit.shingles(w, SHINGLE) >> np.uint64(64 - KNOWN_BITS)).astype(np.int64) if len(w) >= SHINGLE else np.zeros(0, np.int64)
        out = []
        for b in self.blocks:
            out += b.scan(w, first, doc_of, grid, shingles)
        return out


class Block:
    """Some items, by width class."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.names, self.unnamed, self.lengths, self.places, self.shingles, self.counts, self.known = (arrays[n] for n in ("names", "unnamed", "lengths", "places", "shingles", "counts", "known"))
        self.classes: dict[tuple[int, int], tuple] = {}
        for name in arrays:
            if name.endswith("/prints"):
                key = name.removesuffix("prints")
                width, step = map(int, key.split("/")[:2])
                self.classes[width, step] = (arrays[key + "prints"], arrays[key + "item"], arrays[key + "offset"], [(arrays[f"{key}first{b}"], arrays[f"{key}runs{b}"]) for b in range(BLOCKS)])
        self._counter = lru_cache(4096)(self._counted)

    def _counted(self, item: int) -> Counter:
        lo, hi = self.places[item], self.places[item + 1]
        return Counter(dict(zip(self.shingles[lo:hi].tolist(), self.counts[lo:hi].tolist(), strict=True)))

    def near(self, prints: np.ndarray, key: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """All (number of a print, number of an item's run) within RADIUS bits."""
        own, _, _, tables = self.classes[key]
        left, right = [], []
        for b, (first, runs) in enumerate(tables):
            value = _block(prints, b)
            lo, many = first[value], first[value + 1] - first[value]
            i = np.repeat(np.arange(len(prints)), many)
            j = runs[np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)]
            ok = np.bitwise_count(prints[i] ^ own[j]) <= RADIUS
            left.append(i[ok])
            right.append(j[ok])
        return np.concatenate(left), np.concatenate(right)

    def scan(self, w: np.ndarray, first: np.ndarray, doc_of: np.ndarray, grid: dict, shingles: np.ndarray) -> list[tuple]:
        # how many shingles up to here may be some item's: no window can share more with its item, so most candidates end here
        known = np.zeros(len(w) + 1, np.int64)
        np.cumsum(self.known[shingles], out=known[1 : len(shingles) + 1])
        known[len(shingles) + 1 :] = known[len(shingles)]
        places: list[np.ndarray] = []
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for key, (_, item, offset, _) in self.classes.items():
            starts, prints = grid[key]
            i, j = self.near(prints, key)
            doc, at, mine = doc_of[starts[i]], starts[i] - offset[j], item[j]
            if key[0] < SHINGLE and key[1] == 1:  # whole items of few words: equal or not
                whole = textkit.shingles(w, key[0])[at] if len(at) else np.zeros(0, np.uint64)
                ok = whole == self.shingles[self.places[mine]]
                for d, n, p in zip(doc[ok].tolist(), mine[ok].tolist(), (at - first[:-1][doc])[ok].tolist(), strict=True):
                    best[d, n] = max(best.get((d, n), (1.0, -p)), (1.0, -p))
                continue
            most = known[np.clip(at + self.lengths[mine] + 2, 0, len(w))] - known[np.clip(at - 2, 0, len(w))]
            ok = most >= THRESHOLD * (self.lengths[mine] - SHINGLE + 1)
            places.append(np.stack([doc, mine, at - first[:-1][doc]], 1)[ok])
        for doc, item, at in np.unique(np.concatenate(places), axis=0).tolist() if places else ():
            mine = w[first[doc] : first[doc + 1]]
            for p in range(at - 2, at + 3):
                found = self._similarity(mine[max(p, 0) : max(p + int(self.lengths[item]), 0)], item)
                if found >= THRESHOLD and (found, -p) > best.get((doc, item), (0.0, 0)):
                    best[doc, item] = (found, -max(p, 0))
        return [(doc, None if self.unnamed[item] else int(self.names[item]), s, -p, int(self.lengths[item])) for (doc, item), (s, p) in sorted(best.items())]

    def _similarity(self, window: np.ndarray, item: int) -> float:
        if len(window) < SHINGLE:
            return 0.0
        count, whole = len(window) - SHINGLE + 1, int(self.lengths[item]) - SHINGLE + 1
        if min(count, whole) < THRESHOLD * max(count, whole):
            return 0.0
        other = self._counter(item)
        mine = Counter(textkit.shingles(window, SHINGLE).tolist())
        both = sum(min(n, other[s]) for s, n in mine.items() if s in other)
        return both / (count + whole - both)


def hand_out_index(spark: SparkSession, benchmark: DataFrame) -> str:
    """Build the items' index file and name it; items come to the driver a partition at a time."""
    items = benchmark.select("item_id", "text").where("text IS NOT NULL").toLocalIterator()
    return hand_out(spark, "benchmark-index", lambda path: write_index(map(tuple, items), path))


def matches(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents(doc_id, text), benchmark(item_id, text) to a row for each item that a document holds."""
    spark = documents.sparkSession
    ship(spark)
    name = hand_out_index(spark, benchmark)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(SparkFiles.get(name))
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
        for b in batches:
            docs, rows = b["doc_id"].to_pylist(), []
            for at, texts in textkit.chunks(b["text"].to_pylist()):
                rows += [(docs[at + d], *told) for d, *told in index.scan(texts)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in MATCHES.split(", ")])

    return documents.select("doc_id", "text").mapInArrow(found, MATCHES)


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents that hold no item, with all their columns."""
    ship(documents.sparkSession)
    name = hand_out_index(documents.sparkSession, benchmark)

    def decider():
        index = Index(SparkFiles.get(name))

        def decide(texts: list[str]) -> np.ndarray:
            ok = np.ones(len(texts), bool)
            ok[[d for d, *_ in index.scan(texts)]] = False
            return ok

        return decide

    return textkit.keep_where(documents, decider)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

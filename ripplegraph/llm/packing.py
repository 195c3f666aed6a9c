"""Packing along a space-filling curve.

Each document's token counts are hashed into a vector, projected to three dimensions and placed on a three-dimensional
Hilbert curve; documents in curve order are laid end to end and cut every LENGTH tokens. Neighbours on the curve share
sequences, and all sequences but the last are full, so the only padding in the whole corpus is the last sequence's.

The plan: tokenize once into a stored table; range-sort only (key, doc_id, row, tokens) by the curve; number tokens within
each range and add up the ranges' totals (as many rows as partitions, the only thing that reaches the driver); join the
places back to the stored token ids and cut. Documents with equal text have equal keys and are told apart by doc_id, so
a group of copies of any size is spread over as many ranges as it needs. The result doesn't depend on the partitioning.

Token ids are those of byte_bpe_50k.json by `tokenizers` without special tokens added (one that stands in the text keeps its
own id), and a closing 0. They are computed with tiktoken from the same vocabulary's rank file, which is
five times as fast; texts with SPACES or more white-space characters in a row, which tiktoken's matcher can't take at any length, go
to `tokenizers` itself. Tests hold both against each other.

Defined cases: null and empty texts are the closing 0 alone; a null doc_id sorts first and stays null; repeated rows are
packed each; other columns are ignored; very long documents span as many sequences as they need; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ripplegraph.llm import textkit
from ripplegraph.runtime import materialize, ship

LENGTH = 1024
DIMS, BITS, SLOTS = 3, 12, 1024
RANKS, NAMED = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
#: Rows of places a range holds at least: less would only make many tiny files, and every file written starts processes on the executor.
RANGE_ROWS = 20_000
SPECIAL = {"<|endoftext|>": 50256}
SPACES, SPACED = 50_000, re.compile(r"\s{64,}")
#: Coordinates are summed as whole numbers of 1 / SCALE, so that centre and spread don't depend on the order of tasks.
SCALE = 1024
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(2)
def encoder(ranks: str = RANKS) -> tiktoken.Encoding:
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=SPECIAL)


@lru_cache(1)
def named_tokenizer(path: str = NAMED) -> Tokenizer:
    return Tokenizer.from_file(path)


@lru_cache(1)
def _projection() -> np.ndarray:
    return np.random.default_rng(20240229).standard_normal((SLOTS, DIMS))


def token_ids(text: str | None, ranks: str = RANKS) -> np.ndarray:
    text = text or ""
    if len(text) >= SPACES and any(m.end() - m.start() >= SPACES for m in SPACED.finditer(text)):
        ids = named_tokenizer().encode(text, add_special_tokens=False).ids
    else:
        ids = encoder(ranks).encode(text, allowed_special="all")
    return np.array([*ids, 0], np.uint16)


def place(ids: np.ndarray) -> np.ndarray:
    """The document's vector (square roots of hashed token counts, unit length) on the projection."""
    slot = (textkit.mix(ids[:-1].astype(np.uint64) + np.uint64(1)) & np.uint64(SLOTS - 1)).astype(np.int64)
    v = np.sqrt(np.bincount(slot, minlength=SLOTS))
    return (v / max(np.linalg.norm(v), 1e-12)) @ _projection()


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place on the Hilbert curve of each row of whole coordinates below 2^bits (Skilling's transposition, vectorised)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            flip = (x[i] & q) > 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _tokenized(ranks: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            docs = b["doc_id"].to_pylist()
            for at, texts in textkit.chunks(b["text"].to_pylist(), 2_000_000):
                ids = [token_ids(t, ranks) for t in texts]
                points = np.stack([place(x) for x in ids])
                columns = [pa.array(np.arange(row, row + len(ids))), pa.array(docs[at : at + len(ids)], pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
                row += len(ids)
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(points[:, d]) for d in range(DIMS))], ["row", "doc_id", "n", "ids", *(f"p{d}" for d in range(DIMS))])

    return run


def _keyed(centre: list[float], spread: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.stack([b[f"p{d}"].to_numpy() for d in range(DIMS)], 1)
            share = 1 / (1 + np.exp(-1.7 * (p - centre) / spread))  # about the normal distribution's own share
            yield pa.RecordBatch.from_arrays([b["row"], b["doc_id"], b["n"], pa.array(hilbert(np.minimum(share * (1 << BITS), (1 << BITS) - 1)))], ["row", "doc_id", "n", "key"])

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, total = TaskContext.get().partitionId(), 0
    for b in batches:
        n = b["n"].to_numpy()
        ends = total + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([b["row"], pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n), pa.array(ends)], ["row", "part", "begin", "end"])
        total = int(ends[-1]) if len(n) else total


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PIECES.split(", ")]
        for b in batches:
            out: list[tuple] = []
            for doc, raw, begin in zip(b["doc_id"].to_pylist(), b["ids"], b["begin"].to_pylist(), strict=True):
                ids = np.frombuffer(raw.as_buffer(), np.uint16).astype("<u4")
                at = 0
                while at < len(ids):
                    offset = (begin + at) % length
                    take = min(length - offset, len(ids) - at)
                    out.append((doc, at, take, zlib.crc32(ids[at : at + take].tobytes()), len(ids), (begin + at) // length, offset))
                    at += take
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

    return run


def pack(documents: DataFrame, length: int = LENGTH, ranks: str = RANKS) -> DataFrame:
    """documents(doc_id, text) to pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    spark = documents.sparkSession
    ship(spark)
    points = [f"p{d}" for d in range(DIMS)]
    tokens = materialize(documents.select("doc_id", "text").mapInArrow(_tokenized(ranks), f"row long, doc_id long, n long, ids binary, {', '.join(f'{p} double' for p in points)}"), "packing-tokens")
    whole = [F.round(F.col(p) * SCALE).cast("decimal(18,0)") for p in points]
    n, *told = tokens.agg(F.count("*"), *(F.coalesce(F.sum(x), F.lit(0)) for x in whole), *(F.coalesce(F.sum(x * x), F.lit(0)) for x in whole)).first()
    centre = [float(t) / max(n, 1) / SCALE for t in told[:DIMS]]
    spread = [max(float(t) / max(n, 1) / SCALE**2 - c * c, 0) ** 0.5 for t, c in zip(told[DIMS:], centre, strict=True)]
    keyed = tokens.select("row", "doc_id", "n", *points).mapInArrow(_keyed(centre, [max(s, 1e-9) for s in spread]), "row long, doc_id long, n long, key long")
    ranges = min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // RANGE_ROWS + 1)
    sorted_rows = keyed.repartitionByRange(ranges, "key", "doc_id", "row").sortWithinPartitions("key", "doc_id", "row")
    order = materialize(sorted_rows.select("row", "n").mapInArrow(_numbered, "row long, part int, begin long, end long"), "packing-order")
    offsets, total = [], 0
    for part, end in sorted(tuple(r) for r in order.groupBy("part").agg(F.max("end")).collect()):  # as many rows as ranges
        offsets.append((part, total))
        total += end
    offset = F.broadcast(spark.createDataFrame(offsets, "part int, before long"))
    places = order.join(offset, "part").select("row", (F.col("begin") + F.col("before")).alias("begin"))
    return tokens.select("row", "doc_id", "ids").join(places.hint("shuffle_hash"), "row").select("doc_id", "ids", "begin").mapInArrow(_cut(length), PIECES)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))

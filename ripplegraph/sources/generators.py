"""Contact networks to experiment on.

small_world() is native and scales: each ring edge is rewired by its own keyed dice. copy_model() is a scale-free network
that scales: each new edge end copies the end of a keyed random earlier edge, resolved by pointer jumping. small_world_exact()
and scale_free_exact() give the very networks of a sequential 32-bit Mersenne Twister with its published distributions; they are
sequential by nature, run on the driver and are there for comparisons with published runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.functions.keyed import unit, wrapping
from ripplegraph.runtime import materialize


def even(k: int) -> int:
    return k + k % 2


def small_world(spark: SparkSession, n: int, k: int = 6, p: float = 0.1, seed: int = 777) -> DataFrame:
    """edges(a, b): a ring of n people, k neighbours each (made even), each edge (numbered from 0) rewired if its first throw is below p,
    to the person named by the second, unless that is its own start."""
    half = even(k) // 2
    with wrapping(spark):
        ring = spark.range(n * half).select(F.expr(f"id div {max(half, 1)}").alias("a"), F.col("id").alias("edge"))
        ring = ring.select("a", F.pmod(F.col("a") + 1 + F.col("edge") % max(half, 1), F.lit(n)).alias("next"), unit(seed, "edge", 0, 0).alias("u"), F.floor(unit(seed, "edge", 0, 1) * n).cast("long").alias("other"))
        return ring.select("a", F.when((F.col("u") < p) & (F.col("other") != F.col("a")), F.col("other")).otherwise(F.col("next")).alias("b"))


def copy_model(spark: SparkSession, n: int, m: int = 3, seed: int = 777) -> DataFrame:
    """edges(a, b): person i > 0 brings m edges; each takes a random end of all edges before it, so popular people gain more. An end that
    is itself a copy is looked up again until all are known. Edges to oneself are left out, repeated ones stay."""
    with wrapping(spark):
        ends = spark.range(m, n * m).select("id", F.expr(f"id div {m}").alias("a"), F.floor(unit(seed, "id", 0, 0) * 2 * (F.expr(f"id div {m}") * m)).cast("long").alias("pick"))
    # ends are numbered 2e (the start of edge e, person e div m) and 2e+1 (its target); the m edges of person 0 point at 0 itself
    now = ends.select("id", "a", F.when(F.col("pick") % 2 == 0, F.expr(f"pick div {2 * m}")).when(F.expr(f"pick div 2 < {m}"), 0).alias("b"), F.expr("pick div 2").alias("via"))
    for _ in range(64):
        now = materialize(now, "copy-model")
        if not now.where("b IS NULL").limit(1).count():
            break
        known = now.select(F.col("id").alias("via"), F.col("b").alias("b2"), F.col("via").alias("via2"))
        now = now.join(known, "via", "left").select("id", "a", F.coalesce("b", "b2").alias("b"), F.when(F.col("b").isNull(), F.col("via2")).otherwise(F.col("via")).alias("via"))
    return now.where("a <> b").select("a", F.col("b").cast("long").alias("b"))


class Twister:
    """Draws of the 32-bit Mersenne Twister seeded with one number."""

    def __init__(self, seed: int):
        self.bits = np.random.MT19937()
        self.bits._legacy_seeding(seed)
        self.held, self.at = np.zeros(0, np.uint64), 0

    def draw(self) -> int:
        if self.at == len(self.held):
            self.held, self.at = self.bits.random_raw(1 << 16), 0
        self.at += 1
        return int(self.held[self.at - 1])

    def real(self) -> float:
        """In [0, 1), of two draws, the lower half first."""
        low = self.draw()
        return min((low + self.draw() * 2.0**32) / 2.0**64, 1 - 2.0**-53)

    def below(self, n: int) -> int:
        """A whole number below n: multiply and shift, with rejection of the uneven rest."""
        product = self.draw() * n
        if product & 0xFFFFFFFF < n:
            rest = (1 << 32) % n
            while product & 0xFFFFFFFF < rest:
                product = self.draw() * n
        return product >> 32


def _frame(spark: SparkSession, a: np.ndarray, b: np.ndarray) -> DataFrame:
    return spark.createDataFrame(pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())}))


def small_world_exact(spark: SparkSession, n: int, k: int = 6, p: float = 0.1, seed: int = 777) -> DataFrame:
    twister, half = Twister(seed), even(k) // 2
    a = np.repeat(np.arange(n), half)
    b = (a + np.tile(np.arange(1, half + 1), n)) % n
    for e in range(len(a)):
        if twister.real() < p:
            other = twister.below(n)
            if other != a[e]:
                b[e] = other
    return _frame(spark, a, b)


def scale_free_exact(spark: SparkSession, n: int, m: int = 3, seed: int = 777) -> DataFrame:
    m = max(m, 1)
    if n <= m:
        raise ValueError("a scale-free network needs more people than edges per newcomer")
    twister = Twister(seed)
    pairs = [(i, j) for i in range(m + 1) for j in range(i + 1, m + 1)]
    ends = [x for pair in pairs for x in pair]
    for new in range(m + 1, n):
        mine: dict[int, None] = {}
        while len(mine) < m:
            mine[ends[twister.below(len(ends))]] = None
        for other in mine:
            pairs.append((new, other))
            ends += (new, other)
    both = np.array(pairs, np.int64)
    return _frame(spark, both[:, 0], both[:, 1])

"""Keyed randomness: a number in [0, 1) that depends on seed, node, step and counter alone, as native expressions."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Multipliers of seed, node, step and counter, then the two of the 64-bit finaliser (splitmix64).
SEED_FACTOR = 0x9E3779B97F4A7C15
NODE_FACTOR = 0xD1B54A32D192ED03
STEP_FACTOR = 0xA0761D6478BD642F
COUNTER_FACTOR = 0x8EBC6AF09C88C6E3
FINAL_1 = 0xBF58476D1CE4E5B9
FINAL_2 = 0x94D049BB133111EB


@contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    """Within it, DataFrames are built with 64-bit arithmetic that wraps; they keep that when they run later."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def _signed(x: int) -> str:
    return f"{x - (1 << 64) if x >> 63 else x}L" if x != 1 << 63 else "(-9223372036854775807L - 1L)"


def unit_text(seed: int | str, node: int | str, step: int | str, counter: int | str) -> str:
    """unit() as text: whole numbers, or SQL expressions."""
    x = " + ".join(f"CAST({k} AS BIGINT) * {_signed(factor)}" for k, factor in ((seed, SEED_FACTOR), (node, NODE_FACTOR), (step, STEP_FACTOR), (counter, COUNTER_FACTOR)))
    for shift, factor in ((30, FINAL_1), (27, FINAL_2)):
        x = f"(({x}) ^ shiftrightunsigned({x}, {shift})) * {_signed(factor)}"
    return f"CAST(shiftrightunsigned(({x}) ^ shiftrightunsigned({x}, 31), 11) AS DOUBLE) * {2.0**-53!r}D"


def unit(seed: int | str, node: int | str, step: int | str, counter: int | str) -> Column:
    """Build DataFrames that use it within wrapping(). Texts are SQL expressions, such as names of columns; a seed isn't negative."""
    return F.expr(unit_text(seed, node, step, counter))


def unit_of(seed: int, node: int, step: int, counter: int) -> float:
    """The same number for plain integers."""
    mask = (1 << 64) - 1
    x = (seed * SEED_FACTOR + node * NODE_FACTOR + step * STEP_FACTOR + counter * COUNTER_FACTOR) & mask
    for shift, factor in ((30, FINAL_1), (27, FINAL_2)):
        x = ((x ^ (x >> shift)) * factor) & mask
    return ((x ^ (x >> 31)) >> 11) * 2.0**-53

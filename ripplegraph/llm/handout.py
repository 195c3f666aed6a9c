"""Files that the driver writes once and every executor maps into memory: Spark's file server hands them out."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable
from typing import BinaryIO

import numpy as np
from pyspark.sql import SparkSession

ALIGN = 64


def hand_out(spark: SparkSession, kind: str, write: Callable[[str], None]) -> str:
    """Let write(path) make a file, give it to Spark's file server (kept until the driver ends), and name it for SparkFiles.get."""
    folder = tempfile.mkdtemp(prefix=f"{kind}-")
    atexit.register(shutil.rmtree, folder, True)
    name = f"{kind}-{uuid.uuid4().hex}.bin"
    write(f"{folder}/{name}")
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


def put(f: BinaryIO, array: np.ndarray) -> tuple[int, str, int]:
    """Append an array to the file: its place, type and length."""
    f.write(bytes(-f.tell() % ALIGN))
    told = f.tell(), array.dtype.str, len(array)
    f.write(np.ascontiguousarray(array).tobytes())
    return told


def get(raw: np.ndarray, told: Iterable) -> np.ndarray:
    """The array that put() told of, as a view of the mapped file."""
    at, kind, n = told
    kind = np.dtype(kind)
    return raw[at : at + n * kind.itemsize].view(kind)

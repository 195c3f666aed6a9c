"""What every operator needs from the session: shared storage, code on the executors, lineage cuts."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: What a Python worker gets and what a Parquet reader holds at once, unless the session says less: rows of long texts add up fast.
ARROW_ROWS, ARROW_BYTES, READER_ROWS = 1000, 16 << 20, 1000
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ARROW_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": ARROW_BYTES, "spark.sql.parquet.columnarReaderBatchSize": READER_ROWS}

_shipped: set[str] = set()
_stored: set[str] = set()
_settings: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder, or, in local mode only, one of our own."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = f"{tempfile.gettempdir()}/checkpoints/ripplegraph-{os.getpid()}"
    os.makedirs(own, exist_ok=True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so that Python workers can import it anywhere; bound their batches and
    those of the readers (plans read these settings when they run, so they stay changed until release())."""
    for name, most in BATCHES.items():
        now = spark.conf.get(name).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            _settings.setdefault(name, now)
            spark.conf.set(name, str(most))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp()) / "ripplegraph_code.zip"
    atexit.register(shutil.rmtree, to.parent, True)
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(str(to))
    _shipped.add(app)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str, codec: str = "zstd", partition_by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, computes df once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ripplegraph-tables/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", codec)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    if not _stored:
        atexit.register(release, spark)
    _stored.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ripplegraph_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    path = getattr(df, "_ripplegraph_path", None)
    if path:
        remove(df.sparkSession, path)
        _stored.discard(path)


def release(spark: SparkSession) -> None:
    """Delete every table that materialize() stored and that is still there, and give the session its own settings back. For when all
    results have been written; also called when the driver ends."""
    with contextlib.suppress(Exception):
        if spark.sparkContext._jsc is None:
            return
        for path in sorted(_stored):
            remove(spark, path)
            _stored.discard(path)
        for name, before in _settings.items():
            spark.conf.set(name, before)
        _settings.clear()


def sweep(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more; it notices only when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()

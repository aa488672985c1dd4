"""Helpers of the training-data operators: the shared folder, shipping, sizes."""

from __future__ import annotations

import ctypes
import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parents[1]
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 1 << 20
SMALL = 4 << 20  # bytes on disk up to which a table is broadcast or read by one task


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a context, and
    bound the session's Arrow batches by bytes, unless it has a bound: a batch of
    a fixed number of rows grows with the texts' length, in the JVM and in Python."""
    sc = spark.sparkContext
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    if getattr(sc, "_lexarium_shipped", False):
        return
    sc._lexarium_shipped = True
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, str(p.relative_to(_PACKAGE.parent)))
    target = Path(tempfile.mkdtemp()) / "lexarium_shipped.zip"
    target.write_bytes(held.getvalue())
    sc.addPyFile(str(target))


def give_back() -> None:
    """Hand freed memory back to the system: a Python worker lives on beside the
    JVM when its task has ended, and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run):
    """The function of batches, which gives memory back at its end."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def lean_group(run):
    """The function of one table or of two, which gives memory back at its end."""

    def one(t):
        try:
            return run(t)
        finally:
            give_back()

    def two(t, other):
        try:
            return run(t, other)
        finally:
            give_back()

    return one if run.__code__.co_argcount == 1 else two


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, else (in tests, on
    one machine) a temporary one that is set here. A cluster has to name one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = getattr(sc, "_lexarium_dir", None)
        if not named:
            named = "file://" + tempfile.mkdtemp(prefix="lexarium-")
            sc._lexarium_dir = named
    if "://" not in named and not named.startswith("file:"):
        named = "file://" + os.path.abspath(named) if named.startswith("/") else named
    return named.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/lexarium-{name}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends
    there, and a lost executor costs nothing that was computed before."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of df; for files, what they hold on disk."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df, to be broadcast if the files it is read from hold at most `most`
    bytes; a larger one is joined by a shuffle."""
    return F.broadcast(df) if estimated_bytes(df) <= most else df


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names like these that df has no column of (in any letter case)."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def open_shared(path: str, mode: str):
    """Open a file of the shared folder in a Python worker: plain files for
    file: paths, else the store that pyarrow knows by the scheme."""
    if path.startswith("file:") or "://" not in path:
        local = path[5:] if path.startswith("file:") else path
        local = "/" + local.lstrip("/")
        if "w" in mode:
            os.makedirs(os.path.dirname(local), exist_ok=True)
        return open(local, mode)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_output_stream(inner) if "w" in mode else store.open_input_file(inner)


def publish(path: str, payload: bytes) -> None:
    """Write a file whole or not at all: attempts write beside it, then rename."""
    if path.startswith("file:") or "://" not in path:
        part = f"{path}.{uuid.uuid4().hex}"
        with open_shared(part, "wb") as f:
            f.write(payload)
        strip = lambda p: "/" + (p[5:] if p.startswith("file:") else p).lstrip("/")
        os.replace(strip(part), strip(path))
        return
    with open_shared(path, "wb") as f:  # object stores publish on close
        f.write(payload)

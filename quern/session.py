"""Session helpers shared by every subpackage: scratch space, code shipping, whole-run settings."""

from __future__ import annotations

import contextlib
import functools
import inspect
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: dict[str, str] = {}


def build_session(app: str = "quern", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    return SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=settings).getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a fresh temporary one only where none is set and all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = known.get() if known.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = Path(tempfile.mkdtemp(prefix="quern-")).as_uri()
        spark.sparkContext.setCheckpointDir(root)
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name (not yet created) below the shared scratch folder."""
    return f"{scratch_root(spark)}/quern/{name}-{uuid.uuid4().hex[:12]}"


#: Parquet writers of scratch tables hold at most so much of a row group and of a page, for each open file.
SCRATCH_FILES = {"parquet.block.size": str(16 << 20), "parquet.page.size": str(256 << 10)}


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile are given up as soon as it is."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` once as Parquet in the shared folder and read it back.

    Lost executors cost nothing afterwards, since the files are not theirs; the shuffle files behind
    ``df`` are given up as soon as it is written.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    with swept(spark):
        df.write.options(**SCRATCH_FILES).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` has written, once nothing that is still to run reads them."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Remove what the operators have written below the shared folder; tables read from it are gone then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/quern")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per application, for the functions that run in Python workers."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    path = os.path.join(tempfile.mkdtemp(prefix="quern-ship-"), "quern.zip")
    Path(path).write_bytes(held.getvalue())
    spark.sparkContext.addPyFile(path)
    _SHIPPED[app] = path


def give_back() -> None:
    """Hand memory that this worker no longer uses back to the system: workers outlive their tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(f):
    """``f``, a function of a worker over batches or over a group, that gives memory back when it is done."""
    if inspect.isgeneratorfunction(f):

        @functools.wraps(f)
        def over_batches(*args):
            try:
                yield from f(*args)
            finally:
                give_back()

        return over_batches

    @functools.wraps(f)
    def over_group(*args):
        try:
            return f(*args)
        finally:
            give_back()

    return over_group


def batch_bytes(spark: SparkSession, most: int = 8 << 20) -> None:
    """Bound Arrow batches by bytes where the user has not, so very long texts do not meet in one batch."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or int(now) > most or int(now) <= 0:
        spark.conf.set(key, str(most))


def lean(spark: SparkSession, batch: int = 2 << 20, rows: int = 512) -> None:
    """Smaller Arrow batches, and fewer rows of a Parquet file at a time, where the user has not said otherwise: for long texts beside workers that hold models."""
    batch_bytes(spark, batch)
    key = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(key)) == 4096:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

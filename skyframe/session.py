"""Session settings, the cut of lineage that iterative operators share, and tables that live between their steps."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches on one machine; on a cluster the session comes from outside."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("skyframe").config("spark.sql.shuffle.partitions", str(cores))
    conf = {"spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"}
    return builder.config(map=conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share; on one machine alone, where none is set, a temporary one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="skyframe-"))
    return sc.getCheckpointDir()


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside go when it ends, as nothing reads them again; the session's own setting comes back after."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)


def bound_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Let an Arrow batch hold at most ``rows`` rows and about ``size`` bytes, so that texts and files under way between the JVM and Python stay small on both sides.

    This sets the session's own two settings where they are larger, and leaves them set: a plan reads them when it is run, which is after the call that made it.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def checkpoint(df: DataFrame) -> DataFrame:
    """Write to the cluster's shared checkpoint folder and go on from there."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    with freed_shuffles(spark):
        return df.select("*").checkpoint(eager=True)


class Scratch:
    """Tables that an operator writes between its steps: Parquet files in the shared folder, so they outlive lost executors.

    Each is dropped as soon as no later step reads it, and all that are left when the block ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.made = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", 0
        self.places: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self._delete(self.folder)

    def until_exit(self) -> Scratch:
        """For results that read the tables when they are run: the folder goes when the driver's Python ends."""
        atexit.register(self._last)
        return self

    def keep(self, df: DataFrame, compression: str | None = None) -> DataFrame:
        """The rows of ``df``, written once and read from there."""
        self.made += 1
        path = f"{self.folder}/{self.made}"
        with freed_shuffles(self.spark):
            df.write.parquet(path, compression=compression)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.places.append((kept, path))
        return kept

    def drop(self, *tables: DataFrame) -> None:
        for kept, path in self.places:
            if any(kept is t for t in tables):
                self._delete(path)

    def _last(self) -> None:
        if self.spark.sparkContext._jsc is not None:  # else Spark has stopped, and the folder's owner clears it
            with suppress(Exception):
                self._delete(self.folder)

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

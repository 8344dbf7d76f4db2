"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
WAREHOUSE_DIR = "spark.sql.warehouse.dir"
#: Lets a query's shuffle files go as soon as it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Scratch paths written and not yet removed, oldest first.
_written: list[str] = []


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks on one machine. A cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("creditloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the folder the cluster shares: ``spark.checkpoint.dir``, or the warehouse where that is unset.

    Both are reached through Spark's file system, never through the driver's disk.
    """
    shared = spark.conf.get(CHECKPOINT_DIR, None)
    if not shared:
        shared = spark.conf.get(WAREHOUSE_DIR).rstrip("/") + "/_scratch"
    return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Writes the table to a scratch path and reads it back, so that several passes do not compute it again. What the write
    has shuffled is removed when it is done, as later steps read the files."""
    path = scratch_dir(df.sparkSession, purpose)
    settings = df.sparkSession.conf
    before = settings.get(SHUFFLE_CLEANUP, "false")
    settings.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        settings.set(SHUFFLE_CLEANUP, before)
    to_be_cleared(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.scratch_path = path
    return back


def to_be_cleared(path: str) -> str:
    """The scratch path, which ``clear_scratch`` removes with the others."""
    _written.append(path)
    return path


def discard(*tables: DataFrame) -> None:
    """Removes the files of tables that ``stored`` has made and that nothing reads any more.

    Shuffle files go when the driver's garbage is collected, so that is asked for too: else those of finished steps stay.
    """
    for table in tables:
        path = getattr(table, "scratch_path", None)
        if path in _written:
            _remove(table.sparkSession, path)
        table.sparkSession.sparkContext._jvm.System.gc()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder, through Spark's file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def copied(spark: SparkSession, path: str, to: str) -> None:
    """Copies a file or folder through Spark's file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    here, there = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, to))
    from_, into = here.getFileSystem(conf), there.getFileSystem(conf)
    into.mkdirs(there.getParent())
    jvm.org.apache.hadoop.fs.FileUtil.copy(from_, here, into, there, False, conf)


def clear_scratch(spark: SparkSession) -> None:
    """Removes every scratch table of this process. Results that still read them must have been taken before."""
    for path in list(_written):
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    """Through Spark's file system: the folder need not be local."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    _written.remove(path)

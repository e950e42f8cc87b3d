"""Session helpers: the time zone pin and the shared scratch folder."""

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def pin_time_zone(spark: SparkSession, zone: str = "UTC") -> SparkSession:
    """Make time text and epoch seconds mean the same on every machine."""
    spark.conf.set("spark.sql.session.timeZone", zone)
    return spark


def _context_folder(spark: SparkSession) -> str | None:
    """The folder set by ``setCheckpointDir``, if any."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get() if found.isDefined() else None


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new, not yet existing folder below the cluster's shared checkpoint folder.

    Only a local session may fall back to a temporary folder of the machine.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None) or _context_folder(spark)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="run-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


# Tasks per core that list folders: Spark's own way is a task for each folder, up to 10,000, each with a result of its own.
LISTING_TASKS = 4


@contextlib.contextmanager
def listing_in_few_tasks(spark: SparkSession):
    """Let readers opened in the block list many folders in a number of tasks that follows from the cores."""
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(LISTING_TASKS * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate data, on whatever store it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


_open_scopes: list = []


@contextlib.contextmanager
def clearing(spark: SparkSession):
    """Remove at the end of a block what was staged in it. For jobs that write their results: data frames that
    outlive the block must not read what it staged."""
    folders: list = []
    _open_scopes.append(folders)
    try:
        yield
    finally:
        _open_scopes.remove(folders)
        for path in folders:
            drop_folder(spark, path)


@contextlib.contextmanager
def staged(df: DataFrame, label: str = "stage"):
    """``stage`` for the length of a block that reads it; then the folder goes."""
    path = shared_folder(df.sparkSession, label)
    try:
        df.write.parquet(path)
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        drop_folder(df.sparkSession, path)


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage of rows that are costly to compute and used more than once; the files
    outlive any executor, and stay unless ``clearing`` is around.
    """
    path = shared_folder(df.sparkSession, label)
    if _open_scopes:
        _open_scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

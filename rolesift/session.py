"""Session helpers: local sessions for tests and bench, checked broadcasts, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# a side is broadcast only when it is counted and found no larger than this
BROADCAST_ROWS = 20_000


def local_session(cpus: int = 8, name: str = "rolesift") -> SparkSession:
    """A session on this machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        # call sites are not recorded for every column, which halves plan building
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def built_once(make: Callable) -> Callable:
    """Expressions over columns of fixed names are built in the JVM once and shared by all later plans.

    A large expression is tens of thousands of calls to the JVM; the arguments and the JVM are the key.
    """
    made: dict = {}

    @wraps(make)
    def get(*args):
        key = (id(SparkContext._gateway), *args)
        if key not in made:
            made[key] = make(*args)
        return made[key]

    return get


def broadcast_if_small(side: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when a bounded count proves the side small.

    Beyond the bound the join keeps Spark's own choice: a shuffle join, whose
    skewed partitions adaptive execution splits.
    """
    if side.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(side)
    return side


def spread_if_few(rows: DataFrame) -> DataFrame:
    """Spread heavy per-row work over all cores when the input is too small for it.

    Judged by the size Spark knows for the input and its split size, without
    running anything: an input with a split for every core is left alone.
    """
    spark = rows.sparkSession
    split = int(spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("bB"))
    cores = spark.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < split * cores else rows


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only where it is unset and all tasks run in this process, as in tests, a
    temporary folder stands in; a cluster without the setting is refused.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir", "")
        if not named and not is_local(context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="rolesift-"))
    return context.getCheckpointDir()


def is_local(master: str) -> bool:
    """Whether tasks run in the driver's own process."""
    return master == "local" or master.startswith("local[")


def _staged(spark: SparkSession):
    return spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/staged")


def materialize(rows: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Cut lineage by a table written to the shared folder.

    Unlike executor caches it outlives lost executors, and later reads prune
    its columns and partitions and know its size.
    """
    spark = rows.sparkSession
    path = f"{_staged(spark)}/{uuid.uuid4().hex}"
    rows.write.parquet(path, partitionBy=partition_by)
    return spark.read.schema(rows.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files once it ends; else they stay until the driver collects its garbage.

    For plans that no later query shares.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialize` once nothing reads them."""
    for table in tables:
        spark = table.sparkSession
        folder = _staged(spark)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        for name in {f.split("/staged/", 1)[1].split("/", 1)[0] for f in table.inputFiles()}:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, name), True)

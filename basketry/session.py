"""Session helpers: shared scratch tables that survive the loss of executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_MADE: dict[str, set[str]] = {}


def local_session(name: str = "basketry", cores: str = "8", **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for scratch tables: ``spark.checkpoint.dir`` of the session.

    Only where the cluster names none *and* runs in local mode is a temporary folder made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    have = context._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return str(have.get()).rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="basketry-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return _LOCAL[app]


def cut(frame: DataFrame, whole_files: bool = False) -> DataFrame:
    """Write ``frame`` as a table in the shared scratch folder and read it back.

    Cuts the lineage: the result no longer depends on shuffle files of executors that may be lost,
    and unlike a checkpoint of rows it is columnar and compressed. With ``whole_files`` no file has a second
    row group (below 1 GB), so that a part's rows are read by one task.
    """
    spark = frame.sparkSession
    path = f"{scratch_dir(spark)}/basketry-{uuid.uuid4().hex}"
    writer = frame.write.option("compression", "zstd")
    if whole_files:
        writer = writer.option("parquet.block.size", str(1 << 30))
    writer.parquet(path)
    _MADE.setdefault(spark.sparkContext.applicationId, set()).add(path)
    table = spark.read.schema(frame.schema).parquet(path)
    table._basketry_path = path
    return table


def cut_counted(frame: DataFrame, count: Column | None = None) -> tuple[DataFrame, int]:
    """:func:`cut`, and the number of rows (or another whole aggregate), taken as they are written."""
    seen = Observation()
    table = cut(frame.observe(seen, (F.count(F.lit(1)) if count is None else count).alias("n")))
    return table, seen.get["n"]


def together(tables: list[DataFrame]) -> DataFrame:
    """Tables of :func:`cut` with the same columns as one scan."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*[t._basketry_path for t in tables])


#: Rows of a side that is sent to every task.
SMALL_ROWS = 100_000


def sized(frame: DataFrame) -> DataFrame:
    """``frame`` as a stored table, marked for broadcast only if it has at most :data:`SMALL_ROWS` rows and the
    optimizer puts it below 32 MB; beyond, a join with it is a shuffle."""
    table, rows = cut_counted(frame)
    return F.broadcast(table) if rows <= SMALL_ROWS and bytes_of(table) <= 32 << 20 else table


def clear(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; results that still read them end with it."""
    for path in _MADE.pop(spark.sparkContext.applicationId, set()):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def discard(table: DataFrame) -> None:
    """Delete a table made by :func:`cut` that nothing reads any more."""
    path = getattr(table, "_basketry_path", None)
    if path:
        _delete(table.sparkSession, path)
        _MADE.get(table.sparkSession.sparkContext.applicationId, set()).discard(path)


def bytes_of(frame: DataFrame) -> int:
    """The optimizer's estimate of a frame's size."""
    return int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(frame: DataFrame) -> DataFrame:
    """``frame`` over all cores, if its files give fewer tasks than there are cores.

    For stages of heavy work per row only: a file of few large row groups cannot be split by the scan.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(2 * cores) if frame.rdd.getNumPartitions() < cores else frame

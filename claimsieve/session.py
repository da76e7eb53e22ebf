"""Session defaults and the shared folder used to cut long lineages."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDERS: dict[str, str] = {}
_GROUP: ContextVar[str] = ContextVar("group", default="")


def build_session(app: str = "claimsieve", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; on a cluster the submitter's own session is used unchanged."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; only a local master falls back to a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = sc.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="claimsieve-")
    return _LOCAL_FOLDERS[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{_app_folder(spark)}/{_GROUP.get()}{label}-{uuid.uuid4().hex[:12]}"


def _app_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/claimsieve/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def step_group(name: str) -> Iterator[str]:
    """Step tables written inside lie in one folder, which :func:`release_group` deletes."""
    own = f"{_GROUP.get()}{name}-{uuid.uuid4().hex[:12]}/"
    token = _GROUP.set(own)
    try:
        yield own
    finally:
        _GROUP.reset(token)


def release_group(spark: SparkSession, group: str, reader: DataFrame | None = None) -> bool:
    """Delete the step tables of a group, unless ``reader`` still reads files of it.  Whether they are gone."""
    if reader is not None and any(group in f for f in reader.inputFiles()):
        return False
    _delete(spark, f"{_app_folder(spark)}/{group}")
    return True


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a table is scanned by several later passes or where an iterative loop would grow its lineage.  A
    written Parquet table survives the loss of executors and keeps column pruning, unlike a local checkpoint.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give a written table at least one partition per core before a CPU-heavy pass; a large table is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def release(spark: SparkSession) -> bool:
    """Delete the step tables this application wrote to the shared folder.  Call it once results are stored elsewhere."""
    return _delete(spark, _app_folder(spark))

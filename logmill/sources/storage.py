"""Where files lie: paths as Spark resolves them, files of own formats in shared storage, the folder for intermediate tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of local sessions that name no spark.checkpoint.dir, by application.
_LOCAL: dict[str, str] = {}
#: What a leaf of a plan reports whose size Spark doesn't know.
_UNKNOWN = 1 << 62


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and authority that Spark's own readers and writers would give it (fs.defaultFS)."""
    given = spark._jvm.org.apache.hadoop.fs.Path(path)
    return given.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(given).toString()


def file_system(uri: str):
    """A pyarrow file system and the path within it. Only local URIs and those with a scheme: what has none must be
    qualified() first, as it may mean any file system."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        raise ValueError(f"{uri} names no file system")
    return fs.FileSystem.from_uri(uri)


def scratch_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all machines share. Only where driver and executors are one process
    may it be unset; then it is a temporary one that goes with the process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return qualified(spark, named.rstrip("/"))
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="logmill-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return f"file://{_LOCAL[app]}"


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{scratch_root(spark)}/logmill/{name}-{uuid.uuid4().hex}"


def input_bytes(df: DataFrame) -> int | None:
    """The size of the files that ``df`` reads, as Spark has listed them; None if it reads something else too."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return None if any(s >= _UNKNOWN for s in sizes) else sum(sizes)


def partitions_for(df: DataFrame, bytes_each: int) -> int:
    """Shuffle partitions for data that grows as the input does: those of the session, or more if the input is so large."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(df)
    return max(least, df.rdd.getNumPartitions() if size is None else -(-size // bytes_each))

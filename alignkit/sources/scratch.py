"""Tables that cut a plan: written once to the folder that driver and executors share, and read back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, as the session names it.

    Only where that is unset and the session runs on one machine, as in tests, a temporary folder is
    made, which goes with the process. Elsewhere an unset folder is an error: executors would not
    find each other's files.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="alignkit-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
        root = sc.getCheckpointDir()
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which Hadoop deletes when the application ends."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    _file_system(spark, path).deleteOnExit(_path(spark, path))
    return path


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def file_facts(spark: SparkSession, path: str) -> tuple[float, int]:
    """(time of modification in seconds, bytes of all files below it) of an input, for its provenance."""
    system, at = _file_system(spark, path), _path(spark, path)
    return system.getFileStatus(at).getModificationTime() / 1000.0, system.getContentSummary(at).getLength()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: its lineage ends at those files."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def observed(df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, dict]:
    """``materialise(df, name)`` and counters of its rows, taken in the tasks that write them.

    A task's counts are added once, when the write accepts its rows: a lost or repeated task does not count
    twice. So the counters are of the frame that is written and not of one below a shuffle.
    """
    seen = Observation()
    out = materialise(df.observe(seen, *[c.alias(n) for n, c in counters.items()]), name)
    return out, seen.get


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised frame that no later step reads."""
    path = getattr(df, "scratch", None)
    if path is not None:
        _file_system(df.sparkSession, path).delete(_path(df.sparkSession, path), True)

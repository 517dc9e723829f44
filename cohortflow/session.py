"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators are written for.  Times are compared as UTC instants,
# and a join may split a hot key even where the split costs one more shuffle.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings above to a session; all can change at run time."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        path = tempfile.mkdtemp(prefix="cohortflow-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


# Paths that this process has handed out and not removed.
_paths: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; ``clear_scratch`` removes it."""
    _paths.append(f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _paths[-1]


def clear_scratch(spark: SparkSession) -> int:
    """Remove what lies under the paths handed out so far; call it when no frame reads them any more.

    Checkpoints go by themselves, with their frames, where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    removed = 0
    while _paths:
        path = jvm.org.apache.hadoop.fs.Path(_paths.pop())
        removed += bool(path.getFileSystem(conf).delete(path, True))
    return removed


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back, so that Spark knows its size."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder once, so later jobs reread it."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)

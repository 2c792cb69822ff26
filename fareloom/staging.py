"""Intermediate results written to the shared scratch folder.

A staged table cuts lineage the way ``checkpoint()`` does, but as Parquet: one
pass over the input, column pruning on every later read, and real size
statistics for the optimizer's broadcast decision. It survives the loss of
the executors that wrote it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

_local_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, one sub-folder per application.

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local path is invisible to the other executors.
    """
    app = spark.conf.get("spark.app.id", "app")
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
        if app not in _local_roots:
            _local_roots[app] = tempfile.mkdtemp(prefix="fareloom-")
        root = _local_roots[app]
    return f"{root.rstrip('/')}/fareloom-{app}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the scratch root; nothing is created there."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, **options) -> DataFrame:
    """Write ``df`` to scratch once, with the writer's ``options``, and return the table read back."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(jvm_path)


def remove_path(spark: SparkSession, path: str) -> bool:
    """Delete a path this package created (staging sets, emptied partitions)."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.delete(jvm_path, True)


def drop_scratch(spark: SparkSession) -> bool:
    """Remove everything this application staged; call it when its results are consumed."""
    removed = remove_path(spark, scratch_root(spark))
    local = _local_roots.pop(spark.conf.get("spark.app.id", "app"), None)
    if local:
        remove_path(spark, local)
    return removed


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes what the application staged when the block ends, also if it fails.

    Results that are not written or collected inside the block are lost with it.
    """
    try:
        yield
    finally:
        drop_scratch(spark)

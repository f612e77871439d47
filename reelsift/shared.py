"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet there and reading it back: the files outlive any executor, are
compressed and keep column statistics.  The folder is ``spark.checkpoint.dir`` of the session.  Only a
local session that has none gets a temporary one; on a cluster without the setting this is an error.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}
_SCOPES: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables of this application."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="reelsift-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(base)
        _ROOTS[app] = f"{base.rstrip('/')}/reelsift-{app}"
        atexit.register(_drop, spark, _ROOTS[app])
    return _ROOTS[app]


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back; its lineage starts at the files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._reelsift_path = path
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


@contextmanager
def scope() -> Iterator[None]:
    """Deletes, at its end, the tables that :func:`materialize` wrote within; results must be written or collected before.

    Without a scope they stay until the session ends.  Scopes may be nested: a table belongs to the innermost one.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        for df in _SCOPES.pop():
            release(df)


def release(df: DataFrame | None) -> None:
    """Delete a table made by :func:`materialize` that nothing reads any more."""
    path = getattr(df, "_reelsift_path", None)
    if path:
        _drop(df.sparkSession, path)

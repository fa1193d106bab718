"""Intermediate tables in the folder that the driver and all executors share.

An operator that uses a costly intermediate result twice writes it here as
Parquet and reads it back: the lineage ends at files that outlive executors,
and Catalyst can prune the columns of the result and knows its size.

An operator's result reads such tables until it is written itself; whoever
writes it does so within :func:`scratch`, which then removes them.  Those made
outside of it go when the driver's Python ends.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import shared_dir

_scopes: list[list[str]] = []
_left: list[str] = []


def materialize(df: DataFrame, name: str, outlive: bool = False) -> DataFrame:
    """Writes ``df`` to the shared folder and returns it as read back.

    The table goes with the innermost scope of :func:`scratch`, or the one around it if it is to outlive that.
    """
    path = new_folder(df.sparkSession, name, outlive)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, name: str, outlive: bool = False) -> str:
    """The path of a folder to be made in the shared one; it goes as tables go."""
    path = f"{shared_dir(spark)}/swaraflow/{name}-{uuid.uuid4().hex}"
    around = _scopes[:-1] if outlive else _scopes
    if around:
        around[-1].append(path)
    else:
        if not _left:
            atexit.register(_remove_left, spark)
        _left.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that are written inside, at the end."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.pop()
        _remove(spark, paths)


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def _remove_left(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended before
        _remove(spark, _left)

"""What the operators of this subpackage share: reading tables, scratch tables, word patterns."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from branchwise.session import scratch_path

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(key: str, make: Callable[[], Any]) -> Any:
    """What ``make`` returns, made once in each Python process (functions sent by value have no cache of their own)."""
    store = sys.modules.setdefault("__branchwise_once", types.ModuleType("__branchwise_once")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


#: Folders that ``written`` made, for each open ``cleared``.
_made: list[list[str]] = []


def written(df: DataFrame, label: str) -> DataFrame:
    """Write to a fresh table in the shared scratch folder and read it back.

    Cuts the lineage: what follows is recomputed from this table, not from the inputs, when an
    executor is lost.
    """
    path = scratch_path(df.sparkSession, label)
    if _made:
        _made[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the library's own, wherever it is stored."""
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Tables that ``written`` makes inside are deleted at the end; what is needed of them must be written elsewhere by then."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            remove(spark, path)

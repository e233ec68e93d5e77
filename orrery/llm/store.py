"""Intermediate tables in the folder that all executors share.

The folder is ``spark.checkpoint.dir``. Where the session has none and runs on one machine
(tests, a laptop) a folder of its own is made, once an application; on a cluster that is an
error. Tables are plain Parquet, so a lost executor costs a re-read and never a recomputation
of the lineage above. ``stage_only`` and ``drop_staged`` remove what a job has left once its
result is written; what is left when the driver ends is removed then.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

__all__ = ["delete", "drop", "drop_staged", "fresh_name", "hashed_sample", "partitions", "shared_dir", "ship", "stage", "stage_only"]


_own: dict[str, str] = {}
_staged: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        app = spark.sparkContext.applicationId
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="orrery-shared-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        found = _own[app]
    return found.rstrip("/")


def fresh_name(label: str) -> str:
    return f"orrery_{label}_{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{fresh_name(label)}"
    df.write.parquet(path)
    if not _staged:
        atexit.register(drop_staged, spark)
    _staged.append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, *paths: str) -> None:
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    except AttributeError:  # the session has ended
        return
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def drop(spark: SparkSession, label: str) -> None:
    """Delete the table staged last under a label, when nothing reads it any more."""
    path = next(p for p in reversed(_staged) if f"/orrery_{label}_" in p)
    delete(spark, path)
    _staged.remove(path)


def drop_staged(spark: SparkSession, since: int = 0, but: tuple[str, ...] = ()) -> None:
    """Delete the tables staged so far, from the ``since``-th on and but for some. Frames made from them must have been written before."""
    delete(spark, *[p for p in _staged[since:] if p not in but])
    _staged[since:] = [p for p in _staged[since:] if p in but]


def stage_only(make: Callable[[], DataFrame], spark: SparkSession, label: str, *done: str) -> tuple[DataFrame, str]:
    """Stage what ``make`` returns and delete the tables it has staged on the way, and those of the paths ``done``; the frame and its path."""
    since = len(_staged)
    out = stage(make(), label)
    path = _staged[-1]
    drop_staged(spark, since, (path,))
    drop_staged(spark, 0, tuple(p for p in _staged if p not in done))
    return out, path


def hashed_sample(df: DataFrame, key: list[str], most: int) -> DataFrame:
    """At most ``most`` rows, those of least hash of ``key``; equal keys are one. A threshold on the hash leaves about twice as many before the exact cut, so no task sorts its rows."""
    h = F.xxhash64(*key)
    n = df.count()
    if n > 2 * most:
        df = df.where(h <= int(-(2**63) + 2**64 * (2 * most / n)))
    return df.withColumn("_h", h).dropDuplicates(["_h"]).orderBy("_h").limit(most).drop("_h")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

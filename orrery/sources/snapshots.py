"""Snapshots as Parquet, a folder for each family, so that a filter on the family reads no other."""

from __future__ import annotations

import json
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ALIASES
from ..snapshot import Snapshot


def write_snapshot(snap: Snapshot, path: str, mode: str = "error") -> None:
    """Units, properties and the order of rows go into a small table beside the particles."""
    snap.df.write.mode(mode).partitionBy("family").parquet(f"{path}/particles")
    about = json.dumps({"units": dict(snap.units), "properties": dict(snap.properties), "order": list(snap.order)})
    snap.df.sparkSession.range(1).select(F.lit(about).alias("about")).coalesce(1).write.mode(mode).parquet(f"{path}/about")


def read_snapshot(spark: SparkSession, path: str) -> Snapshot:
    about = json.loads(spark.read.parquet(f"{path}/about").first()[0])
    return Snapshot(spark.read.parquet(f"{path}/particles"), about["units"], about["properties"], tuple(about["order"]))


def from_arrays(spark: SparkSession, arrays: Mapping[str, np.ndarray], family: str | np.ndarray = "dm", units: Mapping[str, str] | None = None, **properties: float) -> Snapshot:
    """A snapshot of arrays on the driver: vectors (N, 3) by their name, other fields (N,)."""
    columns: dict[str, np.ndarray] = {}
    for name, a in arrays.items():
        a = np.asarray(a)
        if name in ALIASES:
            if a.ndim != 2 or a.shape[1] != 3:
                raise ValueError(f"{name} is not (N, 3)")
            columns |= {c: a[:, i].astype(float) for i, c in enumerate(ALIASES[name])}
        else:
            columns[name] = a.astype(float) if a.dtype.kind in "fiu" else a
    n = len(next(iter(columns.values())))
    frame = pd.DataFrame({"pid": np.arange(n), "family": family, **columns})
    return Snapshot(spark.createDataFrame(frame), units or {}, properties)


def chunks(snap: Snapshot, chunk_size: int = 1_000_000) -> DataFrame:
    """The snapshot dealt into tasks of about ``chunk_size`` rows. Scans are split by ``spark.sql.files.maxPartitionBytes`` already; this is for frames made otherwise."""
    n = max(1, -(-snap.df.count() // chunk_size))
    return snap.df.repartition(n)

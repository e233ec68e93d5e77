"""Particles over the shared test tables, and the same views in SQL for the tests' oracle."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..snapshot import Snapshot

PARTICLES_L_SQL = """
SELECT CASE l_returnflag WHEN 'N' THEN 'dm' WHEN 'A' THEN 'gas' ELSE 'star' END AS family,
  CAST(l_quantity - 25.5 AS DOUBLE) AS x,
  CAST((l_partkey % 101) - 50 AS DOUBLE) AS y,
  CAST(((l_orderkey + l_suppkey) % 61) - 30 AS DOUBLE) AS z,
  CAST((l_suppkey % 41) - 20 AS DOUBLE) AS vx,
  CAST((l_orderkey % 37) - 18 AS DOUBLE) AS vy,
  CAST((l_partkey % 29) - 14 AS DOUBLE) AS vz,
  CAST(8 + (l_orderkey % 17) AS DOUBLE) / 16 AS mass,
  -l_extendedprice AS phi, l_extendedprice AS temp,
  CAST(date_diff('day', CAST(l_shipdate AS DATE), DATE '2002-01-01') AS DOUBLE) / CAST(365.25 AS DOUBLE) AS age,
  l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4
FROM lineitem"""
PARTICLES_E_SQL = """
SELECT vec_id AS pid, CASE label % 3 WHEN 0 THEN 'dm' WHEN 1 THEN 'gas' ELSE 'star' END AS family,
  CAST(embedding[1] AS DOUBLE)*10 AS x, CAST(embedding[2] AS DOUBLE)*10 AS y, CAST(embedding[3] AS DOUBLE)*10 AS z,
  CAST(embedding[4] AS DOUBLE)*100 AS vx, CAST(embedding[5] AS DOUBLE)*100 AS vy, CAST(embedding[6] AS DOUBLE)*100 AS vz,
  1 + CAST(label AS DOUBLE) / 8 AS mass, CAST(1 + label % 2 AS DOUBLE) / 20 AS eps
FROM embeddings"""
STARS_EV_SQL = """
SELECT event_id AS pid, 'star' AS family, value AS mass,
  CAST(31 - day(ts) AS DOUBLE) + CAST(24 - hour(ts) AS DOUBLE) / 24 AS age
FROM events"""


def particles_l(spark: SparkSession, sf_dir: str) -> Snapshot:
    c, d = F.col, "double"
    flag = c("l_returnflag")
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.when(flag == "N", "dm").when(flag == "A", "gas").otherwise("star").alias("family"),
        (c("l_quantity") - 25.5).cast(d).alias("x"), (c("l_partkey") % 101 - 50).cast(d).alias("y"), ((c("l_orderkey") + c("l_suppkey")) % 61 - 30).cast(d).alias("z"),
        (c("l_suppkey") % 41 - 20).cast(d).alias("vx"), (c("l_orderkey") % 37 - 18).cast(d).alias("vy"), (c("l_partkey") % 29 - 14).cast(d).alias("vz"),
        ((8 + c("l_orderkey") % 17).cast(d) / 16).alias("mass"), (-c("l_extendedprice")).alias("phi"), c("l_extendedprice").alias("temp"),
        (F.datediff(F.lit("2002-01-01").cast("date"), c("l_shipdate").cast("date")).cast(d) / 365.25).alias("age"),
        c("l_orderkey").alias("k1"), c("l_linenumber").alias("k2"), c("l_partkey").alias("k3"), c("l_suppkey").alias("k4"),
    )
    return Snapshot(df, order=("k1", "k2", "k3", "k4", "temp", "age"))


def particles_e(spark: SparkSession, sf_dir: str) -> Snapshot:
    e = [F.col("embedding")[i].cast("double") for i in range(6)]
    label = F.col("label")
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("pid"), F.when(label % 3 == 0, "dm").when(label % 3 == 1, "gas").otherwise("star").alias("family"),
        *[(v * 10).alias(n) for v, n in zip(e[:3], ("x", "y", "z"), strict=True)], *[(v * 100).alias(n) for v, n in zip(e[3:], ("vx", "vy", "vz"), strict=True)],
        (1 + label.cast("double") / 8).alias("mass"), ((1 + label % 2).cast("double") / 20).alias("eps"),
    )
    return Snapshot(df)


def stars_ev(spark: SparkSession, sf_dir: str) -> Snapshot:
    ts = F.col("ts")
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("pid"), F.lit("star").alias("family"), F.col("value").alias("mass"), ((31 - F.day(ts)).cast("double") + (24 - F.hour(ts)).cast("double") / 24).alias("age"))
    return Snapshot(df)

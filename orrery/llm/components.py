"""Connected components by contraction.

Every node takes the least of itself and its neighbours; edges are renamed, and loops and
doubles fall away, until none is left. The least node of a component is never renamed, so
it becomes the component's name. A node with many edges only makes one side of a join
uneven, which adaptive execution splits; minima are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stage


def components(edges: DataFrame) -> DataFrame:
    """``id, root`` for each node of the edges ``a, b`` (longs); root is the least id of the component."""
    edges = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    names = None
    while names is None or not edges.isEmpty():
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("to")), F.struct(F.col("b").alias("id"), F.col("a").alias("to")))).alias("e")).select("e.*")
        least = stage(both.groupBy("id").agg(F.min("to").alias("to")).select("id", F.least("id", "to").alias("to")), "least")
        if names is None:
            names = least.withColumnRenamed("to", "root")
        else:
            names = stage(names.join(least.select(F.col("id").alias("root"), "to"), "root", "left").select("id", F.coalesce("to", "root").alias("root")), "names")
        moved = edges.join(least.select(F.col("id").alias("a"), F.col("to").alias("ta")), "a").join(least.select(F.col("id").alias("b"), F.col("to").alias("tb")), "b")
        edges = stage(moved.where("ta <> tb").select(F.greatest("ta", "tb").alias("a"), F.least("ta", "tb").alias("b")).distinct(), "edges")
    return names


class Union:
    """Union-find over small integers, by least member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

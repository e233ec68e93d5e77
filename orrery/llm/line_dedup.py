"""Line dedup against levelled sorted runs of line hashes.

A line's key is the line without white space at both ends, A-Z lower-cased; it is held as
two 64-bit hashes. ``LineRuns`` keeps the keys as runs: tables bucketed and sorted by key,
so that a batch meets them in merge joins that shuffle neither side. A key is in one run
at most. Each new batch is reduced to one row a key, merge-anti-joined with every run, and
what remains becomes a run of level 0; keys that some run has already go to a log with
their number of documents. ``fanout`` runs of a level are compacted into one of the next.

Batches come by falling document id, so the run that first holds a key names its keeper.

Defined results: a null text is one empty line; a null id is one document below all
others; rows that share an id are one document (each keeps its own text); identical rows
give identical results; an empty table gives an empty result; further columns pass
through, but for ``n_lines`` and ``n_dropped``, which are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import delete, fresh_name, partitions, shared_dir, stage
from .text import WHITE, let, lower_ascii, put

KEY = ["k1", "k2"]
NO_ID = -(2**63)


def line_key(line: Column) -> Column:
    return F.btrim(lower_ascii(line), F.lit(WHITE))


class LineRuns:
    """Runs of line keys by level: ``k1, k2, docs, keeper``; and the log of repeats: ``k1, k2, docs``."""

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout, self.buckets = spark, fanout, partitions(spark)
        self.levels: dict[int, list[str]] = defaultdict(list)
        self.repeats: list[str] = []
        self.made: list[str] = []

    def _write(self, df: DataFrame, label: str) -> str:
        name = fresh_name(label)
        df.write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", self._path(name)).saveAsTable(name)
        self.made.append(name)
        return name

    def _path(self, name: str) -> str:
        return f"{shared_dir(self.spark)}/{name}"

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in sorted(self.levels) for t in self.levels[level]]

    def add(self, batch: DataFrame) -> None:
        """Take in a batch of ``k1, k2, did``."""
        held = self.runs()
        own = batch.distinct().groupBy(*KEY).agg(F.count("*").alias("docs"), F.max("did").alias("keeper"))
        if held:
            own = self.spark.table(self._write(own, "batch"))
        new = reduce(lambda left, run: left.join(run.select(*KEY).hint("merge"), KEY, "left_anti"), held, own)
        run = self._write(new, "run")
        if held:
            self.repeats.append(self._write(own.join(self.spark.table(run).select(*KEY).hint("merge"), KEY, "left_anti").drop("keeper"), "repeats"))
        self.levels[0].append(run)
        self._compact()

    def _compact(self) -> None:
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged = reduce(DataFrame.unionByName, [self.spark.table(t) for t in self.levels.pop(level)])
            self.levels[level + 1].append(self._write(merged.repartition(self.buckets, *KEY), f"level{level + 1}"))
            level += 1

    def found_in(self, min_docs: int) -> DataFrame:
        """``k1, k2, keeper`` of the keys found in at least so many documents."""
        every = [r.select(*KEY, "docs", "keeper") for r in self.runs()] + [self.spark.table(t).select(*KEY, "docs", F.lit(None).cast("long").alias("keeper")) for t in self.repeats]
        counts = reduce(DataFrame.unionByName, every).groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper"))
        return counts.where(F.col("docs") >= min_docs).select(*KEY, "keeper")

    def drop(self) -> None:
        for name in self.made:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete(self.spark, self._path(name))  # a table with a path of its own leaves its files
        self.made, self.repeats = [], []
        self.levels.clear()


def _long_lines(docs: DataFrame, text_col: str, id_col: str, min_chars: int) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    keyed = rows.where(F.octet_length("line") >= min_chars).select("did", "th", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keyed.select("did", "th", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2"))


def dedup_lines(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 2) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text_col``, and ``n_lines``, ``n_dropped``."""
    spark = docs.sparkSession
    lines = stage(_long_lines(docs, text_col, id_col, min_chars), "lines")
    lo, hi = lines.where(F.col("did") != NO_ID).agg(F.min("did"), F.max("did")).first()
    index = LineRuns(spark, fanout)
    try:
        if hi is not None:
            cuts = [hi - (hi - lo + 1) * i // batches for i in range(batches)]  # upper ends, falling
            for top, below in zip(cuts, [*cuts[1:], None], strict=True):
                part = lines.where(F.col("did") <= top)
                index.add((part if below is None else part.where(F.col("did") > below)).select(*KEY, "did"))
        else:
            index.add(lines.select(*KEY, "did"))
        often = stage(index.found_in(min_docs), "often")
    finally:
        index.drop()

    # A key in many documents makes one side of this join uneven, never the other: adaptive execution splits it.
    gone = lines.join(often, KEY).where(F.col("did") != F.col("keeper")).groupBy("did", "th").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    held = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64(text).alias("th"))
    both = held.join(gone, ["did", "th"], "left").select("row", "gone", F.split(F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")), "\n", -1).alias("lines"))
    kept = F.array_join(let(F.struct("lines", "gone"), lambda s: F.flatten(F.transform(F.sequence(F.lit(0), F.size(s["gone"])), lambda i: _between(s, i)))), "\n")
    out = both.select("row", F.when(F.col("gone").isNull(), F.col(f"row.`{text_col}`")).otherwise(kept).alias("kept"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
    out = out.select("row", "kept", "n_lines", F.greatest("n_dropped", F.lit(0)).alias("n_dropped"))
    return put(out.select("row.*", F.col("kept").alias("_kept"), F.col("n_lines").alias("_n_lines"), F.col("n_dropped").alias("_n_dropped")), **{text_col: F.col("_kept"), "n_lines": F.col("_n_lines"), "n_dropped": F.col("_n_dropped")}).drop("_kept", "_n_lines", "_n_dropped")


def _between(s: Column, i: Column) -> Column:
    """The lines after the i-th dropped line (from 0: none before) and before the next."""
    start = F.when(i == 0, F.lit(0)).otherwise(F.get(s["gone"], i - 1) + 1)
    end = F.coalesce(F.get(s["gone"], i), F.size(s["lines"]))
    return F.slice(s["lines"], start + 1, end - start)

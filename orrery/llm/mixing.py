"""Mixing sources to target weights.

Each source's words are packed into blocks of ``block_words``, document after document in
a fixed pseudorandom order. Targets share the total by weight, never above ``max_repeats``
times what a source has. The mix is a row of slots, dealt to output shards. Each source gets
slots in proportion to its target, and a pseudorandom permutation of all slots deals them to
the places of the shards. So the source counts of a shard are a multinomial draw with the
targets' shares, given that the totals of all shards meet the targets: what a shard holds is
left to chance, what the mix holds is not, at every size. A source's slots, numbered through,
are mapped to blocks by a pseudorandom permutation of its indices, a new one each time all
blocks have been used, and joined to the blocks by index. As no block is used more than
``max_repeats`` times, no document is.

Prefix sums run in two steps, within hashed buckets and over the totals of buckets, so a
source with most of the rows is never in one task. Sources are numbered, filled up and given
their slots by running sums over ranges of them, so their number has no limit.

Defined results: a null or empty text has size 0 and is never taken; a null source is a
source, last in order; a null id is an id; rows with the same id are mixed as rows of their
own; an empty table gives an empty result. All draws are hashes: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranges import running
from .store import partitions, stage
from .text import n_words

CHUNK = 4096
#: Sources up to this many are broadcast to their documents; more are joined by shuffle.
BROADCAST_SOURCES = 10_000
#: Slots are summed in parts of 1 / 2^20.
SLOT_BITS = 20


def permuted(x: Column, n: Column, rounds: int, *seed: Column) -> Column:
    """The place of ``x`` in a pseudorandom permutation of 0..n-1 (swap-or-not rounds)."""

    def step(y: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(1), r, *seed), n) - y, n)
        return F.when(F.xxhash64(F.lit(2), r, F.greatest(y, other), *seed).bitwiseAND(F.lit(1)) == 1, other).otherwise(y)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x, step)


def sized(docs: DataFrame, text_col: str, id_col: str, source_col: str, buckets: int) -> DataFrame:
    """``id, th, source, skey, size, bucket`` for each row."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    source = F.col(f"`{source_col}`").cast("string")
    return docs.select(
        F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("th"), source.alias("source"), F.coalesce(F.concat(F.lit("s"), source), F.lit("")).alias("skey"),
        n_words(F.col(f"`{text_col}`")).alias("size"), F.pmod(F.xxhash64(F.col(f"`{id_col}`"), text), F.lit(buckets)).alias("bucket"),
    )


def source_plan(rows: DataFrame, *, block_words: int, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """One row a source: its size, target, number of blocks and its slots, from ``begin`` to ``end`` of ``slots``."""
    src = rows.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    src = running(src, [F.col("source").asc_nulls_last()], {"sid": F.lit(1).cast("long")}, "numbered_sources")
    src = src.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("sid", F.lit(len(weights)))))
    src = src.withColumn("cap", max_repeats * F.col("source_size").cast("double"))
    # Shares by weight under caps: sources fill up in the order of cap / weight; the first that need not fill up gives the level.
    src = running(src, [F.col("cap") / F.col("weight"), F.col("sid")], {"caps": F.col("cap"), "weights": F.col("weight")}, "filled_sources")
    src = stage(src, "source_sums")
    sums = src.agg(F.sum("source_size").cast("double").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(sums["size"]) - F.col("caps")) / (F.lit(sums["weight"]) - F.col("weights"))
    level = src.agg(F.max(F.when(level * F.col("weight") <= F.col("cap"), level)).alias("level")).first()["level"] or 0.0
    src = src.withColumn("target", F.least("cap", F.lit(level) * F.col("weight")))
    src = src.withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    want = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0)
    # Whole parts of a slot, so that sums are the same in any ranges; rounding the running sum gives slots within one of what is wanted.
    src = src.withColumn("want", F.round(want * (1 << SLOT_BITS)).cast("long"))
    whole = lambda c: F.shiftright(c + (1 << SLOT_BITS - 1), SLOT_BITS)
    wanted = src.agg(F.sum("want")).first()[0] or 0
    src = running(src, [F.col("sid")], {"earlier": F.col("want")}, "wanted_slots")
    return src.select("skey", "source_size", "target", "blocks", whole(F.col("earlier")).alias("begin"), whole(F.col("earlier") + F.col("want")).alias("end"), whole(F.lit(wanted).cast("long")).alias("slots"))


def draw_slots(plan: DataFrame, *, seed: int, shard_slots: int, max_shards: int, max_repeats: int, rounds: int) -> DataFrame:
    """``skey, shard, slot, epoch, block``: which block each slot of each output shard takes."""
    p = plan.withColumnRenamed("slots", "all").withColumn("n", F.least(F.col("end") - F.col("begin"), max_repeats * F.col("blocks"))).where("n > 0")
    p = p.withColumn("each", F.greatest(F.lit(shard_slots), F.ceil(F.col("all") / max_shards)).cast("long"))
    p = p.select("skey", "blocks", "begin", "n", "all", "each", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))).alias("k0"))
    p = p.repartition(partitions(plan.sparkSession), "skey", "k0")  # few rows become very many
    p = p.select("skey", "blocks", "begin", "all", "each", F.explode(F.sequence(F.col("k0"), F.least(F.col("k0") + CHUNK, F.col("n")) - 1)).alias("k"))
    epoch = F.floor(F.col("k") / F.col("blocks")).cast("long")
    place = permuted(F.col("begin") + F.col("k"), F.col("all"), rounds, F.lit(seed), F.lit("shards"))
    p = p.select("skey", "blocks", "each", place.alias("place"), epoch.alias("epoch"), (F.col("k") - epoch * F.col("blocks")).alias("at"))
    shard = F.floor(F.col("place") / F.col("each")).cast("long")
    return p.select("skey", shard.alias("shard"), (F.col("place") - shard * F.col("each")).alias("slot"), "epoch", permuted(F.col("at"), F.col("blocks"), rounds, F.lit(seed), F.col("skey"), F.col("epoch")).alias("block"))


def packed(rows: DataFrame, block_words: int) -> DataFrame:
    """A row for each document and block it lies in: ``skey, block, id, th, size, start, lo, hi`` (lo, hi: words of the document)."""
    rows = rows.where("size > 0")
    local = W.partitionBy("skey", "bucket").orderBy("id", "th", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(local), F.lit(0)))
    totals = rows.groupBy("skey", "bucket").agg(F.sum("size").alias("held"))
    base = totals.select("skey", "bucket", F.coalesce(F.sum("held").over(W.partitionBy("skey").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = rows.join(base, ["skey", "bucket"]).withColumn("start", F.col("base") + F.col("within"))
    first, last = F.floor(F.col("start") / block_words).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / block_words).cast("long")
    placed = placed.select("skey", "id", "th", "size", "start", F.explode(F.sequence(first, last)).alias("block"))
    lo = F.greatest(F.col("block") * block_words - F.col("start"), F.lit(0))
    hi = F.least((F.col("block") + 1) * block_words - F.col("start"), F.col("size"))
    return placed.select("*", lo.alias("lo"), hi.alias("hi"))


class Mix:
    """A mix of ``docs``: ``plan`` by source, ``slots`` of the output shards, and ``pieces`` of documents in blocks."""

    def __init__(self, docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", block_words: int = 128, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: int = 7, shard_slots: int = 4096, max_shards: int = 4096, rounds: int = 16, buckets: int = 1024):
        self.text_col, self.id_col = text_col, id_col
        self.docs = docs
        self.rows = rows = stage(sized(docs, text_col, id_col, source_col, buckets), "sizes")
        self.plan = stage(source_plan(rows, block_words=block_words, weights=weights, max_repeats=max_repeats), "sources")
        self.slots = draw_slots(self.plan, seed=seed, shard_slots=shard_slots, max_shards=max_shards, max_repeats=max_repeats, rounds=rounds)
        self.pieces = packed(rows, block_words)

    def shard_counts(self) -> DataFrame:
        """``shard, skey, n``: how many blocks of each source a shard has."""
        return self.slots.groupBy("shard", "skey").agg(F.count("*").alias("n"))

    def taken(self) -> DataFrame:
        """``id, th, size, source_size, target, taken`` for each row of the documents."""
        uses = self.slots.groupBy("skey", "block").agg(F.count("*").alias("uses")).hint("merge")
        rows = self.pieces.join(uses, ["skey", "block"], "left").groupBy("skey", "id", "th", "size", "start").agg(F.sum((F.col("hi") - F.col("lo")) * F.coalesce("uses", F.lit(0))).alias("taken"))
        rows = rows.select("skey", "id", "th", "size", "taken").unionByName(self.rows.where("size = 0").select("skey", "id", "th", "size", F.lit(0).cast("long").alias("taken")))
        src = self.plan.select("skey", "source_size", "target")
        return rows.join(F.broadcast(src) if src.count() <= BROADCAST_SOURCES else src, "skey").select("id", "th", "size", "source_size", "target", "taken")

    def mixed(self) -> DataFrame:
        """The documents' rows as the mix has them: one for each time round, its text the words taken then."""
        cols = self.docs.columns
        got = self.pieces.join(self.slots.select("skey", "block", "epoch").hint("merge"), ["skey", "block"])
        got = got.groupBy("id", "th", "start").agg(F.sort_array(F.collect_list(F.struct("epoch", "lo", "hi"))).alias("got"))
        got = got.select("id", "th", "got", F.row_number().over(W.partitionBy("id", "th").orderBy("start")).alias("copy"))
        text = F.coalesce(F.col(f"`{self.text_col}`"), F.lit(""))
        held = self.docs.select(F.struct("*").alias("row"), F.col(f"`{self.id_col}`").alias("hid"), F.xxhash64(text).alias("hth"))
        held = held.withColumn("copy", F.row_number().over(W.partitionBy("hid", "hth").orderBy(F.col(f"row.`{self.id_col}`"))))
        both = held.join(got, F.col("hid").eqNullSafe(F.col("id")) & (F.col("hth") == F.col("th")) & (held["copy"] == got["copy"])).select("row", "got")
        body = F.regexp_extract_all(F.col(f"row.`{self.text_col}`"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
        rounds = both.select("row", "got", body.alias("tokens")).select("row", "got", "tokens", F.explode(F.array_distinct(F.transform("got", lambda g: g["epoch"]))).alias("epoch"))
        parts = F.filter("got", lambda g: g["epoch"] == F.col("epoch"))
        whole = F.aggregate(parts, F.lit(0).cast("long"), lambda a, g: a + g["hi"] - g["lo"]) == F.size("tokens")
        cut = F.array_join(F.flatten(F.transform(parts, lambda g: F.slice("tokens", (g["lo"] + 1).cast("int"), (g["hi"] - g["lo"]).cast("int")))), "")
        out = rounds.select("row", F.when(whole, F.col(f"row.`{self.text_col}`")).otherwise(F.btrim(cut, F.lit(" \t\n\x0b\f\r"))).alias("cut"))
        return out.select(*[F.col("cut").alias(c) if c == self.text_col else F.col(f"row.`{c}`").alias(c) for c in cols])

"""Secret scans: fixed patterns, and character Markov models for what they miss.

The base patterns find spans of three kinds. The method adds spans of kind ``markov``: in each
run of at least ``min_run`` token characters, or what base spans leave of it, the part that a
first-order character model of random strings explains best against one of ordinary
identifiers (largest sum of log ratios) is weighed. It is a secret if its sum, in natural
logs, reaches the threshold of the run's length. The whole run is reported if its own sum
does so too, else that part.

Both models and the thresholds come from a bounded sample of documents (``max_docs`` of them,
by hash). Random strings are the values of base spans that hold digits, and ``made`` digests
in hex and base64. Ordinary identifiers are the sample's runs that are made of words and
numbers, and its words (``max_words`` of them) joined as in names and paths. A quarter of the identifiers is held
out of the models: a threshold is the ratio that a share of ``false_alarms`` of those of its
length exceeds, and ``margin`` on top. A share ``unfamiliar`` of the ordinary model knows only
kinds of characters, as names may be of languages that the samples lack; so letters of one case
alone are no evidence, and random strings of lower case only are not found.

Starts and ends are code points, ends exclusive. Offsets come from the pieces between
matches: the text is split by the pattern, and lengths are summed in blocks. Work grows with
the length of the text; documents are scanned in one pass and nothing is shuffled.

Defined results: a null text is empty and has no spans; rows are scanned alone, so ids may
be null or repeated; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import hashed_sample, partitions, stage
from .text import let

# The base patterns, the group whose length counts, and the least length.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # the same spans as [0-9a-f]+ of 32 characters or more: a run is matched whole
BASE = (("assign", ASSIGN, 1, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32))
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = 128  # codes are those of ASCII; 0 stands before a run
#: Lengths of runs from which on thresholds differ.
LENGTHS = (8, 10, 12, 16, 20, 24, 32, 48)
SPANS = "array<struct<start:int,rank:int,end:int,value:string>>"
ORDINARY = r"^(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?:[+/_=-]*(?:[A-Z]?[a-z]+|[A-Z]+))*(?:[+/_=-]+[0-9]+)*[0-9]{0,2}[+/_=-]*$"
BLOCK = 256


def _none() -> Column:
    return F.array().cast(SPANS)


def _running(lengths: Column) -> Column:
    """Running sums of an array that is not empty, in blocks: an append copies the array."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    add = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"] + x)).alias("out"))
    blocks = let(lengths, lambda v: F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))
    inner = F.transform(blocks, lambda b: F.aggregate(b, zero, add, lambda s: s["out"]))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
    join = lambda s, a: F.struct((s["at"] + F.element_at(a, -1)).alias("at"), F.concat(s["out"], F.array(F.transform(a, lambda v: v + s["at"]))).alias("out"))
    return F.flatten(F.aggregate(inner, start, join, lambda s: s["out"]))


def _spans(text: Column, pattern: str, matches: Column, values: Column, rank: int, least: int) -> Column:
    """The spans of the matches whose values are long enough, as structs of start, rank, end and value."""
    lengths = F.transform(matches, F.char_length)
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    ends = let(lengths, lambda n: _running(F.zip_with(F.slice(gaps, 1, F.size(n)), n, lambda g, m: g + m)))
    each = F.zip_with(F.arrays_zip(ends.alias("end"), matches.alias("m")), values, lambda e, v: F.struct((e["end"] - F.char_length(e["m"])).alias("start"), F.lit(rank).alias("rank"), e["end"].alias("end"), v.alias("value")))
    return F.when(F.size(matches) > 0, F.filter(each, lambda s: F.char_length(s["value"]) >= least)).otherwise(_none())


def _left_over(runs: Column, base: Column, least: int) -> Column:
    """What base spans leave of the runs: one sweep over both, by start."""
    events = F.array_sort(F.concat(runs, base))
    zero = F.struct(F.lit(0).alias("from"), F.lit(0).alias("to"), F.lit(0).alias("first"), F.lit("").alias("value"), F.lit(0).alias("past"), _none().alias("out"))

    def with_part(s: Column, end: Column) -> Column:
        part = F.struct(s["from"].alias("start"), F.lit(3).alias("rank"), end.alias("end"), F.substring(s["value"], s["from"] - s["first"] + 1, end - s["from"]).alias("value"))
        return F.when(end - s["from"] >= least, F.concat(s["out"], F.array(part))).otherwise(s["out"])

    def step(s: Column, e: Column) -> Column:
        run = F.struct(F.greatest(e["start"], s["past"]).alias("from"), e["end"].alias("to"), e["start"].alias("first"), e["value"].alias("value"), s["past"].alias("past"), with_part(s, s["to"]).alias("out"))
        base_span = F.struct(F.greatest(s["from"], e["end"]).alias("from"), s["to"].alias("to"), s["first"].alias("first"), s["value"].alias("value"), F.greatest(s["past"], e["end"]).alias("past"), with_part(s, F.least(s["to"], e["start"])).alias("out"))
        return F.when(e["rank"] == 3, run).otherwise(base_span)

    # In blocks, as an append copies the array.
    kept = ("from", "to", "first", "value", "past")
    blocks = let(events, lambda v: F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))
    begin = F.struct(*[zero[c].alias(c) for c in kept], F.array().cast(f"array<{SPANS}>").alias("out"))

    def in_block(s: Column, block: Column) -> Column:
        fresh = F.struct(*[s[c].alias(c) for c in kept], _none().alias("out"))
        return let(F.aggregate(block, fresh, step), lambda r: F.struct(*[r[c].alias(c) for c in kept], F.concat(s["out"], F.array(r["out"])).alias("out")))

    last = lambda s: F.concat(F.flatten(s["out"]), with_part(F.struct(*[s[c].alias(c) for c in kept], _none().alias("out")), s["to"]))
    return F.when(F.size(events) > 0, F.aggregate(blocks, begin, in_block, last)).otherwise(_none())


def base_and_runs(docs: DataFrame, text_col: str, id_col: str, min_run: int, model: MarkovPair | None = None) -> DataFrame:
    """``id, base, runs``: spans of the base patterns, and runs of token characters outside them. With a model, texts without base spans in which no run can be a secret have no runs: most need no offsets."""
    run = r"[A-Za-z0-9+/_=-]{" + str(min_run) + r",}+"
    df = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    df = df.select("*", F.lower("text").alias("low"), F.regexp_extract_all("text", F.lit(run), F.lit(0)).alias("m3"))
    # What a match cannot be without is looked for first: that is much cheaper than the patterns.
    can = (F.col("low").contains("passw") | F.col("low").contains("secret") | F.col("low").contains("token") | F.col("low").contains("api"), F.col("text").contains("AKIA"), F.exists("m3", lambda v: F.length(v) >= 32) if min_run <= 32 else F.lit(True))
    found = lambda c, p, group: F.when(c, F.regexp_extract_all("text", F.lit(p), F.lit(group))).otherwise(F.array().cast("array<string>"))
    df = df.select("id", "text", "m3", *[found(c, p, 0).alias(f"m{k}") for k, (c, (_, p, _, _)) in enumerate(zip(can, BASE, strict=True))])
    df = df.select("*", found(F.size("m0") > 0, ASSIGN, 1).alias("v0"))
    spans = [_spans(F.col("text"), p, F.col(f"m{k}"), F.col("v0" if g else f"m{k}"), k, least) for k, (_, p, g, least) in enumerate(BASE)]
    df = df.select("id", "text", "m3", F.array_sort(F.concat(*spans)).alias("base"))
    runs = _spans(F.col("text"), run, F.col("m3"), F.col("m3"), 3, min_run)
    if model is not None:
        runs = F.when((F.size("base") > 0) | F.exists("m3", model.may_be), runs).otherwise(_none())
    df = df.select("id", "base", runs.alias("runs"))
    return df.select("id", "base", F.when(F.size("base") > 0, _left_over(F.col("runs"), F.col("base"), min_run)).otherwise(F.col("runs")).alias("runs"))


def labelled_samples(scanned: DataFrame, made: int, max_words: int) -> DataFrame:
    """``text, random, n``: distinct labelled strings and how often they occur."""
    spark = scanned.sparkSession
    values = scanned.select(F.explode("base").alias("b")).select(F.col("b.value").alias("text")).where(F.col("text").rlike("[0-9]") & F.col("text").rlike("[A-Za-z]") & ~F.col("text").rlike(ORDINARY)).distinct()
    digests = spark.range(made).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("d"))
    digests = digests.select(F.explode(F.array(F.lower(F.hex("d")), F.hex("d"), F.base64("d"), F.translate(F.base64("d"), "+/=", "-_"))).alias("text"))
    names = scanned.select(F.explode("runs").alias("r")).select(F.col("r.value").alias("text")).where(F.col("text").rlike(ORDINARY)).groupBy("text").agg(F.count("*").alias("n"))
    names = stage(names, "names")
    words = names.where(F.col("text").rlike("^[A-Za-z]+$")).select(F.lower("text").alias("a")).distinct().orderBy(F.xxhash64("a"), "a").limit(max_words)
    # A word beside another one, joined as in names and paths; capitals and numbers as they follow words.
    other = lambda k: F.substring(F.lead("a", k, "value").over(Window.partitionBy(F.pmod(F.xxhash64("a"), F.lit(64))).orderBy(F.xxhash64("a"), "a")), 1, 8)
    joined = words.select("a", other(1).alias("b"), other(2).alias("c"), F.pmod(F.xxhash64("a"), F.lit(10_000)).cast("string").alias("d"))
    made_up = F.array(F.upper("a"), F.concat_ws("_", "a", "b"), F.concat_ws("-", "a", "b"), F.concat_ws("/", "a", "b"), F.concat("a", F.initcap("b")), F.concat("b", F.initcap("c"), F.initcap("a")), F.concat(F.initcap("b"), F.initcap("a"), F.initcap("c")), F.concat_ws("_", F.upper("a"), F.upper("b")), F.concat_ws("-", "a", "d"), F.concat_ws("_", "d", "a"), F.concat("d", F.lit("-"), "d", F.lit("-"), "d"), F.repeat("d", 4))
    joined = joined.select(F.explode(made_up).alias("text")).distinct().select("text", F.lit(1).cast("long").alias("n"))
    # Rules and rows of one character.
    ruled = spark.range(len(ALPHABET)).select(F.repeat(F.substring(F.lit(ALPHABET), F.col("id").cast("int") + 1, F.lit(1)), F.lit(64)).alias("text"), F.when(F.col("id") >= 62, 50).otherwise(1).cast("long").alias("n"))
    joined = joined.unionByName(ruled)
    one = F.lit(1).cast("long").alias("n")
    return values.select("text", F.lit(True).alias("random"), one).unionByName(digests.select("text", F.lit(True).alias("random"), one)).unionByName(names.unionByName(joined).select("text", F.lit(False).alias("random"), "n"))


def _ratios(text: Column, table: Column) -> Column:
    """The log ratio of each character after the one before it."""
    codes = F.transform(F.split(text, ""), F.ascii)
    return let(codes, lambda v: F.transform(v, lambda c, i: F.get(table, F.coalesce(F.get(v, i - 1), F.lit(0)) * SIZE + c)))


def _kind(code: int) -> int:
    c = chr(code)
    return 0 if not code else 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4


@dataclass(frozen=True)
class MarkovPair:
    """Log ratios of the SIZE x SIZE character steps, random over ordinary, and a threshold for each of LENGTHS."""

    ratios: tuple[float, ...]
    thresholds: tuple[float, ...]

    @classmethod
    def fit(cls, samples: DataFrame, *, false_alarms: float, min_llr: float, margin: float, unfamiliar: float) -> MarkovPair:
        samples = samples.where(F.length("text") > 0).select("*", (~F.col("random") & (F.pmod(F.crc32("text"), F.lit(4)) == 0) & ~F.col("text").rlike(r"^(.)\1+$")).alias("held"))
        codes = F.transform(F.split("text", ""), F.ascii)
        steps = let(codes, lambda v: F.transform(v, lambda c, i: F.coalesce(F.get(v, i - 1), F.lit(0)) * SIZE + c))
        steps = samples.where("not held").select("random", "n", F.explode(steps).alias("step"))
        counts = {(r["random"], r["step"]): r["n"] for r in steps.groupBy("random", "step").agg(F.sum("n").alias("n")).collect()}  # bounded: pairs of ALPHABET
        models = [cls._model({k: n for (c, k), n in counts.items() if c is label}, share) for label, share in ((True, 0.0), (False, unfamiliar))]
        one = cls(tuple(math.log(p / q) for p, q in zip(*models, strict=True)), (min_llr,) * len(LENGTHS))
        held = samples.where("held").where(F.char_length("text") >= LENGTHS[0]).select("n", one._nth(F.char_length("text")).alias("nth"), one.best("text")["best"].alias("best"))
        found = {r["nth"]: r["high"] for r in held.groupBy("nth").agg(F.percentile("best", 1 - false_alarms, F.col("n")).alias("high")).collect()}
        return cls(one.ratios, tuple(max(min_llr, found.get(k, min_llr) + margin) for k in range(len(LENGTHS))))

    @staticmethod
    def _model(counts: dict[int, int], unfamiliar: float, weight: float = 64.0) -> list[float]:
        """Step probabilities. Rare characters lean on how their kind (lower case, capital, digit, other) is followed by kinds. A share ``unfamiliar`` is that alone: words of languages that the samples do not have."""
        kinds = {ord(c): _kind(ord(c)) for c in ALPHABET} | {0: 0}
        size = [list(kinds.values()).count(k) for k in range(5)]
        by_kind = [[1.0] * 5 for _ in range(5)]
        of = dict.fromkeys(kinds, 0)
        for step, n in counts.items():
            by_kind[kinds[step // SIZE]][kinds[step % SIZE]] += n
            of[step // SIZE] += n
        back = [[n / sum(row) / size[k] for k, n in enumerate(row)] for row in by_kind]

        def step(a: int, b: int) -> float:
            own = (counts.get(a * SIZE + b, 0) + weight * back[kinds[a]][kinds[b]]) / (of[a] + weight)
            return (1 - unfamiliar) * own + unfamiliar * back[kinds[a]][kinds[b]]

        return [step(a, b) if a in kinds and b in kinds else 1.0 for a in range(SIZE) for b in range(SIZE)]

    def _table(self) -> Column:
        return F.split(F.lit(",".join(f"{r:.9g}" for r in self.ratios)), ",").cast("array<double>")

    def may_be(self, text: Column) -> Column:
        """Whether the positive ratios alone reach a threshold: no part can have a larger sum."""
        return F.aggregate(_ratios(text, self._table()), F.lit(0.0), lambda s, x: s + F.greatest(x, F.lit(0.0))) >= min(self.thresholds)

    def _nth(self, length: Column) -> Column:
        return F.greatest(sum((F.when(length >= n, 1).otherwise(0) for n in LENGTHS), F.lit(0)) - 1, F.lit(0))

    def best(self, text: Column | str) -> Column:
        """The part of largest sum, and the sum of all: ``best, lo, hi, total``."""
        zero = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("now"), F.lit(0).alias("from"), F.lit(0.0).alias("best"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0.0).alias("total"))

        def step(s: Column, x: Column) -> Column:
            now = F.greatest(s["now"], F.lit(0.0)) + x
            start = F.when(s["now"] > 0, s["from"]).otherwise(s["i"])
            more = now > s["best"]
            return F.struct((s["i"] + 1).alias("i"), now.alias("now"), start.alias("from"), F.greatest(s["best"], now).alias("best"), F.when(more, start).otherwise(s["lo"]).alias("lo"), F.when(more, s["i"] + 1).otherwise(s["hi"]).alias("hi"), (s["total"] + x).alias("total"))

        return F.aggregate(_ratios(F.col(text) if isinstance(text, str) else text, self._table()), zero, step)

    def found(self, runs: Column, min_run: int) -> Column:
        """The spans of the runs that are secrets."""
        limits = F.array(*map(F.lit, self.thresholds))

        def of(r: Column) -> Column:
            def span(b: Column) -> Column:
                limit = F.get(limits, self._nth(r["end"] - r["start"]))
                part = F.struct((r["start"] + b["lo"]).alias("start"), F.lit(3).alias("rank"), (r["start"] + b["hi"]).alias("end"), F.substring(r["value"], b["lo"] + 1, b["hi"] - b["lo"]).alias("value"))
                return F.when((b["best"] >= limit) & (b["hi"] - b["lo"] >= min_run), F.when(b["total"] >= limit, r).otherwise(part))

            return let(self.best(r["value"]), span)

        return F.filter(F.transform(F.filter(runs, lambda r: self.may_be(r["value"])), of), lambda s: s.isNotNull())


def fit_models(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", min_run: int = 8, max_docs: int = 2000, max_words: int = 5000, made: int = 1000, false_alarms: float = 1e-4, min_llr: float = 10.0, margin: float = 2.0, unfamiliar: float = 0.25) -> MarkovPair:
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    chosen = stage(hashed_sample(texts.where("text <> ''"), ["id", "text"], max_docs).repartition(partitions(docs.sparkSession)), "secret_sample")
    scanned = stage(base_and_runs(chosen, "text", "id", min_run), "secret_runs")
    return MarkovPair.fit(stage(labelled_samples(scanned, made, max_words), "labelled"), false_alarms=false_alarms, min_llr=min_llr, margin=margin, unfamiliar=unfamiliar)


def scan_secrets(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", min_run: int = 8, model: MarkovPair | None = None, **fit) -> DataFrame:
    """``id_col`` and ``spans``: an array of structs of start, rank (in KINDS), end and value, in order. ``fit``: what ``fit_models`` takes."""
    model = model or fit_models(docs, text_col=text_col, id_col=id_col, min_run=min_run, **fit)
    scanned = base_and_runs(docs, text_col, id_col, min_run, model)
    return scanned.select(F.col("id").alias(id_col), F.array_sort(F.concat("base", model.found(F.col("runs"), min_run))).alias("spans"))


def spans_text(spans: Column) -> Column:
    kind = lambda s: F.get(F.array(*map(F.lit, KINDS)), s["rank"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")

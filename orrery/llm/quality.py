"""Quality rules whose cutoffs come with a guarantee.

Each rule rejects a document when a measure reaches its cutoff. Labelled documents are dealt to
two parts by a hash of their id. The first (a third) proposes a sequence: pairs of rule and
cutoff, midpoints between quantiles of its good and bad documents, those first that reject most
bad documents for a good one; pairs that reject too few bad ones, or too many good ones for
them, are left out. Each step of the sequence rejects what the one before does and some more.

The rest, the holdout, tests the sequence in each stratum (language) by itself: a step stands
if the exact binomial bound on its false rejections is at most ``alpha``, and steps are tested
in order up to the first that fails (fixed sequence: no correction needed within a stratum).
Over the strata that have good documents enough for a test the error ``delta`` is divided by
their number (Bonferroni). So, with probability 1 - delta, no stratum loses more than ``alpha``
of its good documents. A stratum's cutoffs are those of the last step that stands.

A stratum with too few labels for a bound has no cutoffs and loses only base failures.

Defined results: a null text has no words and fails the base rule; a null stratum is one
of its own; labels of null id or value are ignored, of an id labelled twice the worse
counts; rows that share an id are judged alone; empty tables give empty results; further
columns pass through unless they bear the name of a measure.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import running
from .store import stage
from .text import WORD_CLASS, let, put

WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
BASE_WORDS, BASE_REPEAT_PERCENT = 10, 20
#: Strata with cutoffs up to this number are broadcast.
BROADCAST_STRATA = 50_000

#: Rule: what is compared with the cutoff.
RULES = {
    "symbols": lambda c: _ratio(c("n_symbols"), c("word_chars")),
    "capitals": lambda c: _ratio(c("n_upper"), c("word_chars")),
    "duplicate_lines": lambda c: _ratio(c("n_dup_lines"), c("n_lines")),
    "repeats": lambda c: _ratio(c("n_repeat_words"), c("n_words")),
}
GOOD_SHARES = (1.0, 0.999, 0.995, 0.99, 0.98, 0.95, 0.9)
BAD_SHARES = (0.0, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def _covered(windows: Column) -> Column:
    """Words in the windows that occur twice or more: sort by hash, keep those with an equal neighbour, sum what each covers before the next."""
    by_hash = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = let(by_hash, lambda s: F.filter(F.transform(s, lambda x, j: F.when((x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]), x["i"])), lambda i: i.isNotNull()))
    lengths = let(F.sort_array(twice), lambda p: F.transform(p, lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - i, F.lit(WINDOW)))))
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, n: a + n)


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the MEASURES (long). Nothing is shuffled."""
    df = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select("row", F.regexp_extract_all("text", F.lit(WORD_CLASS), F.lit(0)).alias("w"), lines.alias("l"), F.regexp_count("text", F.lit(r"[#*$%&|<>]")).alias("sym"), F.regexp_count("text", F.lit(r"\p{Lu}")).alias("up"))
    hashed = F.transform("w", lambda x: F.xxhash64(x))
    windows = let(hashed, lambda h: F.transform(F.slice(h, 1, F.size(h) - WINDOW + 1), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)])))
    df = df.select("row", F.size("w").alias("n"), F.char_length(F.array_join("w", "")).alias("chars"), "l", "sym", "up", F.when(F.size("w") > WINDOW, windows).otherwise(F.array().cast("array<bigint>")).alias("win"))
    repeated = F.when(F.size(F.array_distinct("win")) < F.size("win"), _covered(F.col("win"))).otherwise(F.lit(0))
    got = [F.col("n"), F.col("chars"), F.col("sym"), F.size("l") - F.size(F.array_distinct("l")), repeated, F.size("l"), F.col("up")]
    df = df.select("row", *[c.cast("long").alias(f"_{k}") for k, c in zip(MEASURES, got, strict=True)])
    return put(df.select("row.*", *[f"_{k}" for k in MEASURES]), **{k: F.col(f"_{k}") for k in MEASURES}).drop(*[f"_{k}" for k in MEASURES])


def base_failed(words: Column, repeated: Column) -> Column:
    return (words < BASE_WORDS) | (100 * repeated > BASE_REPEAT_PERCENT * words)


def allowed_rejections(n: Column, alpha: float, error: Column) -> Column:
    """The most false rejections x of n good documents at which P(X <= x | n, alpha) <= error; -1 if none. That is where the exact upper bound is at most alpha."""
    odds = math.log(alpha / (1 - alpha))
    zero = F.struct((n * math.log(1 - alpha)).alias("log"), F.lit(0.0).alias("sum"), F.lit(-1).cast("long").alias("best"))

    def step(s: Column, k: Column) -> Column:
        total = s["sum"] + F.exp(s["log"])
        after = s["log"] + F.log((F.greatest(n - k, F.lit(0)) + 1e-300) / (k + 1)) + odds
        return F.struct(after.alias("log"), total.alias("sum"), F.when(total <= error, k).otherwise(s["best"]).alias("best"))

    upto = F.least(F.ceil(n * alpha).cast("long"), n)
    return F.aggregate(F.sequence(F.lit(0).cast("long"), upto), zero, step, lambda s: s["best"])


def _stratum(name: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(f"`{name}`").cast("string")), F.lit(""))


def quantiles(each: DataFrame) -> dict[tuple[str, bool], list[float]]:
    """Of ``rule, good, value`` the quantiles at GOOD_SHARES or BAD_SHARES for each rule and label, exact over all rows: places by running sums over ranges of values."""
    held = running(each.groupBy("rule", "good", "value").agg(F.count("*").alias("n")), [F.col("rule"), F.col("good"), F.col("value")], {"before": F.col("n")}, "label_values")
    held = stage(held, "label_places")
    # Bounded: a row for each rule and label.
    total = held.groupBy("rule", "good").agg(F.sum("n").alias("total"), F.min("before").alias("start"))
    at = F.col("before") - F.col("start")
    places = lambda shares: F.flatten(F.array(*[F.array(*[f(F.lit(p) * (F.col("total") - 1)) for f in (F.floor, F.ceil)]) for p in shares]))
    wanted = F.array_distinct(F.when(F.col("good"), places(GOOD_SHARES)).otherwise(places(BAD_SHARES)))
    met = held.join(F.broadcast(total), ["rule", "good"]).select("rule", "good", "value", "total", F.explode(F.filter(wanted, lambda i: (i >= at) & (i < at + F.col("n")))).alias("place"))
    of: dict[tuple[str, bool], dict[int, float]] = {}
    totals = {}
    for r in met.collect():  # bounded: two rows a rule, label and share
        of.setdefault((r["rule"], r["good"]), {})[r["place"]] = r["value"]
        totals[r["rule"], r["good"]] = r["total"]
    out = {}
    for key, values in of.items():
        out[key] = []
        for share in GOOD_SHARES if key[1] else BAD_SHARES:
            place = share * (totals[key] - 1)
            low, high = values[math.floor(place)], values[math.ceil(place)]
            out[key].append(low if low == high else (math.ceil(place) - place) * low + (place - math.floor(place)) * high)
    return out


def propose(rows: DataFrame, *, min_bad: float, max_good: float, least_ratio: float) -> list[tuple[str, float]]:
    """The sequence of rules and cutoffs, from ``good`` and a column for each rule. Its length is bounded by RULES and the shares."""
    each = rows.select("good", F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("value")) for k in RULES])).alias("r")).select("good", "r.rule", "r.value")
    each = stage(each, "label_rules")
    at = quantiles(each)
    cuts = [(k, sorted({(g + b) / 2 for g in at.get((k, True), []) for b in at.get((k, False), [])})) for k in RULES]
    cuts = rows.sparkSession.createDataFrame(cuts, "rule string, cuts array<double>")
    # The number of cutoffs a value reaches tells all of them; counts by that number are summed from the top.
    reached = each.join(F.broadcast(cuts), "rule").groupBy("rule", "cuts", "good", F.size(F.filter("cuts", lambda c: c <= F.col("value"))).alias("reached")).agg(F.count("*").alias("n"))
    counts: dict[tuple[str, bool], dict[int, int]] = {}
    values: dict[str, list[float]] = {}
    for r in reached.collect():  # bounded: a row for each proposed cutoff and label
        values[r["rule"]] = r["cuts"]
        counts.setdefault((r["rule"], r["good"]), {})[r["reached"]] = r["n"]
    found = []
    for rule, cutoffs in values.items():
        good, bad = (counts.get((rule, label), {}) for label in (True, False))
        n_good, n_bad = max(sum(good.values()), 1), max(sum(bad.values()), 1)
        for i, cutoff in enumerate(cutoffs):
            g, b = (sum(n for k, n in side.items() if k > i) for side in (good, bad))
            if b >= min_bad * n_bad and b and g <= max_good * n_good and b / n_bad >= least_ratio * g / n_good:
                found.append((-((b + 0.5) / (n_bad + 1)) / ((g + 0.5) / (n_good + 1)), -cutoff, rule))
    return [(rule, -cutoff) for _, cutoff, rule in sorted(found)]


def fit_cutoffs(measured: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", stratum_col: str = "lang", alpha: float = 0.04, delta: float = 0.05, min_bad: float = 0.01, max_good: float = 0.02, least_ratio: float = 5.0) -> DataFrame:
    """``stratum, rule, cutoff``: a row for each rule that stands in a stratum. All labelled documents take part."""
    lab = labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("q")).where("id is not null and q is not null").groupBy("id").agg((F.min("q") > 0).alias("good"))
    rows = measured.where(~base_failed(F.col("n_words"), F.col("n_repeat_words"))).select(F.col(f"`{id_col}`").alias("id"), _stratum(stratum_col).alias("stratum"), *[f(F.col).alias(k) for k, f in RULES.items()])
    first = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(3)) == 0
    rows = stage(rows.join(lab, "id").select("stratum", first.alias("first"), "good", *RULES), "labelled")
    steps = propose(rows.where("first"), min_bad=min_bad, max_good=max_good, least_ratio=least_ratio)
    spark = measured.sparkSession
    if not steps:
        return spark.createDataFrame([], "stratum string, rule string, cutoff double")
    sequence = F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(c).alias("cutoff"), F.lit(i).alias("step")) for i, (k, c) in enumerate(steps)])
    # The first step that rejects a document tells all of them.

    def first_step(rule: str) -> Column:
        return F.array_min(F.transform(F.filter(sequence, lambda s: (s["rule"] == rule) & (s["cutoff"] <= F.col(rule))), lambda s: s["step"]))

    of_rule = [first_step(k) for k in RULES]
    held = rows.where("not first and good").groupBy("stratum", F.coalesce(F.least(*of_rule), F.lit(len(steps))).alias("step")).agg(F.count("*").alias("n"))
    of = Window.partitionBy("stratum")
    held = held.select("stratum", "step", F.sum("n").over(of).alias("n_hold"), F.sum("n").over(of.orderBy("step")).alias("lost"))
    sizes = held.groupBy("stratum").agg(F.first("n_hold").alias("n_hold"), F.collect_list(F.struct("step", "lost")).alias("losses"))
    sizes = sizes.where(allowed_rejections(F.col("n_hold"), alpha, F.lit(delta)) >= 0)
    sizes = stage(sizes, "strata")
    allowed = allowed_rejections(F.col("n_hold"), alpha, F.lit(delta / max(sizes.count(), 1)))
    stands = sizes.select("stratum", allowed.alias("allowed"), "losses").where("allowed >= 0")
    # Losses only grow along the sequence.
    fails = F.array_min(F.transform(F.filter("losses", lambda x: (x["lost"] > F.col("allowed")) & (x["step"] < len(steps))), lambda x: x["step"]))
    stands = stands.select("stratum", F.coalesce(fails, F.lit(len(steps))).alias("end"))
    return stands.select("stratum", "end", F.explode(sequence).alias("s")).where("s.step < end").groupBy("stratum", "s.rule").agg(F.min("s.cutoff").alias("cutoff"))


def judge(measured: DataFrame, cutoffs: DataFrame, *, stratum_col: str = "lang") -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``. ``cutoffs`` has a row a stratum and rule: it is joined as one row a stratum."""
    one = cutoffs.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff")).select(F.col("stratum").alias("_stratum"), *[F.col(k).alias(f"_cut_{k}") for k in RULES])
    one = stage(one, "cutoffs")
    one = F.broadcast(one) if one.count() <= BROADCAST_STRATA else one
    both = measured.join(one, _stratum(stratum_col) == F.col("_stratum"), "left")
    rejected = F.lit(False)
    for k, f in RULES.items():
        rejected = rejected | F.coalesce(f(F.col) >= F.col(f"_cut_{k}"), F.lit(False))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    both = both.withColumn("_failed", failed).withColumn("_kept", ~failed & ~rejected)
    return put(both, base_failed=F.col("_failed"), kept=F.col("_kept")).drop("_failed", "_kept", "_stratum", *[f"_cut_{k}" for k in RULES])

"""URL filters by dated lists.

A list is a log of events: a domain was added to or removed from it on a day. Events become
validity intervals (from an addition up to the next event of the same list and domain), and
an as-of join holds every capture against the entries in force on the day it was fetched. A
capture is looked up under its host and each parent domain; if several entries hold, the
most specific domain counts, then the list's name.

Only what the join needs is shuffled: hosts and days, not pages. A host with a great part of
the captures makes one side of the join uneven, which adaptive execution splits.

Defined results: a null or unreadable URL has no host and is not blocked; so is a capture
with no day; events with a null list, domain or day are ignored; of events of one list,
domain and day a removal counts; repeated events change nothing; rows with the same id are
looked up alone; an empty table gives an empty result; further columns pass through unless
they bear the name of an output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import lower_ascii, put

OUTPUTS = ("host", "blocked", "list", "domain", "since")


def host_of(url: Column) -> Column:
    """The host of a URL, A-Z lower-cased, without user, port and last dot; null if there is none."""
    host = F.regexp_extract(lower_ascii(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    host = F.regexp_replace(host, r"\.$", "")
    return F.when(host != "", host)


def suffixes(host: Column) -> Column:
    """The host and its parent domains of two labels or more, longest first."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    return F.when(n < 2, F.array(host)).otherwise(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n - i + 1), ".")))


def intervals(events: DataFrame) -> DataFrame:
    """``list, domain, since, until``: when each entry is in force (until is exclusive, null if it still is)."""
    log = events.select("list", lower_ascii(F.col("domain")).alias("domain"), F.col("day").cast("date").alias("since"), "added").where("list is not null and domain is not null and since is not null")
    log = log.groupBy("list", "domain", "since").agg(F.min("added").alias("added"))
    nxt = F.lead("since").over(Window.partitionBy("list", "domain").orderBy("since"))
    return log.select("list", "domain", "since", nxt.alias("until"), "added").where("added").drop("added")


def filter_urls(captures: DataFrame, events: DataFrame, *, url_col: str = "url", day_col: str = "fetched") -> DataFrame:
    """``captures`` with ``host, blocked, list, domain, since``."""
    held = captures.select(F.struct("*").alias("row"), host_of(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{day_col}`").cast("date").alias("day"))
    asked = held.select("host", "day").distinct().select("host", "day", F.posexplode(suffixes(F.col("host"))).alias("place", "domain"))
    found = asked.join(intervals(events), "domain").where((F.col("since") <= F.col("day")) & (F.col("until").isNull() | (F.col("day") < F.col("until"))))
    best = found.groupBy("host", "day").agg(F.min(F.struct("place", "list", "domain", "since")).alias("hit"))
    both = held.join(best, ["host", "day"], "left").select("row.*", F.col("host").alias("_host"), F.col("hit").alias("_hit"))
    return put(both, host=F.col("_host"), blocked=F.col("_hit").isNotNull(), list=F.col("_hit.list"), domain=F.col("_hit.domain"), since=F.col("_hit.since")).drop("_host", "_hit")

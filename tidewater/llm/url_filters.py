"""URL filters as a temporal list join, in DataFrame functions only.

A list is a table of dated events: an entry is added to a list, or taken off it. Events of an entry
become validity intervals [since, until). Each capture asks for the entries that name its host, a domain
above it or a path prefix, and holds those whose interval covers its fetch time; the most specific one
decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Intervals up to this number are sent to every task; more are joined by a shuffle.
SENT = 100_000
#: Longest key in the list for that, in characters.
SENT_KEY = 2048


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and a last dot; empty if there is none."""
    return F.lower(F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1), r"\.$", ""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, path: Column) -> Column:
    """The host and the domains above it of two labels at least, then host and path at each segment."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.when(n < 2, F.array(host)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.array_join(F.slice(labels, k, n), ".")))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    m = F.size(parts)
    prefixes = F.when(m == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), lambda k: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), k), "/"))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, prefixes)))


def intervals(events: DataFrame) -> DataFrame:
    """(list, key, since, until) from events (list, key, at, action).

    An entry is in force from an 'add' to its next event; a repeated 'add' goes on. Events of one entry
    at one time: 'remove' counts after 'add'. Rows with a null in any of the four columns are left out.
    """
    w = Window.partitionBy("list", "key").orderBy("at", "action")
    return (
        events.select("list", F.lower("key").alias("key"), "at", "action")
        .dropna()
        .withColumn("until", F.lead("at").over(w))
        .where("action = 'add' AND (until IS NULL OR until > at)")
        .select("list", "key", F.col("at").alias("since"), "until")
    )


def verdicts(captures: DataFrame, events: DataFrame) -> DataFrame:
    """The rows of captures (with url and fetched_at) plus host, n_active, entry, entry_list and blocked.

    blocked is true if the most specific active entry, by length of its key, is on the list 'block';
    at equal length 'block' wins. A null or malformed url has an empty host and no entries; a null
    fetch time has no active entries. Copies of a capture are judged once and each get the result.
    Other columns of captures stay; the five result columns replace columns of their names.
    """
    made = ["host", "n_active", "entry", "entry_list", "blocked"]
    captures = captures.drop(*made)
    asked = captures.select("url", "fetched_at").distinct().where("url IS NOT NULL AND fetched_at IS NOT NULL")
    asked = asked.withColumn("key", F.explode(F.transform(keys_of(host_of(F.col("url")), path_of(F.col("url"))), F.lower)))
    listed = intervals(events)
    size = listed.agg(F.count("*").alias("n"), F.max(F.length("key")).alias("longest")).first()
    if size.n <= SENT and (size.longest or 0) <= SENT_KEY:
        listed = F.broadcast(listed)
    active = asked.join(listed, "key").where("since <= fetched_at AND (until IS NULL OR fetched_at < until)")
    rank = F.struct(F.length("key").alias("length"), F.col("list").alias("list"), F.col("key").alias("key"))
    found = active.groupBy("url", "fetched_at").agg(F.count("*").alias("__n"), F.max(rank).alias("__best"))
    rows = captures.join(found, ["url", "fetched_at"], "left")
    return rows.select(
        *[F.col(f"`{c}`") for c in captures.columns],
        F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"),
        F.coalesce("__n", F.lit(0)).cast("long").alias("n_active"),
        F.col("__best.key").alias("entry"),
        F.col("__best.list").alias("entry_list"),
        F.coalesce(F.col("__best.list") == "block", F.lit(False)).alias("blocked"),
    )

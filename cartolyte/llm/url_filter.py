"""URL filters with a history: every capture against the list entries that were active when it was fetched.

A list is a table of dated changes (list, action, pattern, day, state): an entry of action ``block`` or ``allow`` for a
domain pattern was ``added`` or ``removed`` on a day. Successive changes of an entry become validity intervals
[day, next change). A pattern holds for a host that equals it or ends with a dot and it; of the active entries that
hold, those with the longest pattern decide, and of these a block wins.

Captures are reduced to their distinct (host, day) pairs before anything is joined, so a host with a third of all
captures costs as many rows as it has days; each pair's host is unfolded to its suffixes, which meet the intervals by an
equality with a range of days. The verdicts are written and go back to the captures by (host, day): by broadcast if Spark finds
their files small, else by a join with plain exchanges on both sides, in which Spark splits a hot (host, day). DataFrame
operations only.

Defined cases: null or malformed URLs have no host and are not blocked, nor are captures without a day; changes with a
null in pattern, day or state are left out; of several changes of an entry on one day ``removed`` wins; repeated
captures are judged each; URLs of any length are read whole; empty tables give empty results or no blocks; other columns are
kept under their names, whatever these are, but for columns with the name of a result, which it replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolyte.llm.common import free_names, written

FAR = "9999-12-31"


def host_of(url: Column) -> Column:
    """The lower-case host without user, port and trailing dot; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(F.rtrim(host, F.lit(".")), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and each of its parent domains."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def intervals(changes: DataFrame) -> DataFrame:
    """(list, action, pattern, since, until): when each entry was active, ``until`` excluded."""
    day = changes.where("pattern IS NOT NULL AND day IS NOT NULL AND state IS NOT NULL").groupBy("list", "action", F.lower("pattern").alias("pattern"), "day").agg(F.max("state").alias("state"))
    until = F.coalesce(F.lead("day").over(Window.partitionBy("list", "action", "pattern").orderBy("day")), F.lit(FAR).cast("date"))
    return day.withColumn("until", until).where("state = 'added'").select("list", "action", "pattern", F.col("day").alias("since"), "until")


def filter_captures(captures: DataFrame, changes: DataFrame, url_col: str = "url", day_col: str = "fetch_day") -> DataFrame:
    """The captures with _host, _blocked, _pattern and _lists (the deciding pattern and its lists, null if no entry holds)."""
    held = captures.drop("_blocked", "_pattern", "_lists").withColumn("_host", host_of(F.col(url_col)))
    pairs = held.select(F.col("_host").alias("h"), F.col(day_col).alias("d")).where("h IS NOT NULL AND d IS NOT NULL").distinct()
    unfolded = pairs.select("h", "d", F.explode(suffixes(F.col("h"))).alias("pattern"))
    met = unfolded.join(intervals(changes), "pattern").where("d >= since AND d < until")
    deciding = F.max(F.struct(F.length("pattern").alias("size"), "pattern")).alias("best")
    action = met.groupBy("h", "d", "pattern").agg(F.max((F.col("action") == "block").cast("int")).alias("block"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"))
    verdict = action.groupBy("h", "d").agg(deciding, F.max_by(F.struct("block", "lists"), F.length("pattern")).alias("v"))
    host, day = free_names(held, "_h", "_d")
    verdict = verdict.select(F.col("h").alias(host), F.col("d").alias(day), (F.col("v.block") == 1).alias("_blocked"), F.col("best.pattern").alias("_pattern"), F.col("v.lists").alias("_lists"))
    verdict = written(verdict, "verdicts")
    out = held.join(verdict, (held["_host"] == verdict[host]) & (held[day_col] == verdict[day]), "left").drop(host, day)
    return out.withColumn("_blocked", F.coalesce("_blocked", F.lit(False)))

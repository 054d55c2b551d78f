"""Dated URL lists joined with captures as of the time of fetching.

List entries are events: a key (a host, a parent domain, or a host with a path) is added to or removed from a list on a
date. They become validity intervals, and each capture is evaluated against the entries active when it was fetched, for
its host, all parent domains and all leading folders of its path.

Intervals and captures meet on the key and the month, so that a key with very many captures or entries is spread over
the months; within a month the exact bounds decide. Intervals of one list and key do not overlap, so a capture finds
at most one entry per list and key.

An entry is active from the day it is added (inclusive) to the day it is removed (exclusive). Adding what is on the list and
removing what is not change nothing; on one day removals come first. Events without key, list or date are ignored. A
capture without a URL or a time matches nothing and is returned; equal rows are returned as often as they are
given. Empty tables give empty results or no matches. Columns that are not named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.common import pick
from tradewind.session import stage


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)


def url_keys(url: Column) -> Column:
    """All keys that can list a URL: host, parent domains of two labels or more, leading folders and the whole path."""
    host, path = url_host(url), url_path(url)
    labels, folders = F.split(host, r"\."), F.split(path, "/")
    domains = F.when(F.size(labels) > 1, F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    inside = F.when(
        F.size(folders) > 1,
        F.transform(F.sequence(F.lit(1), F.size(folders) - 1), lambda i: F.concat(host, F.array_join(F.slice(folders, 1, i), "/"), F.lit("/"))),
    )
    none = F.array().cast("array<string>")
    keys = F.array_distinct(F.concat(F.array(host), F.coalesce(domains, none), F.coalesce(inside, none), F.array(F.concat(host, path))))
    return F.when(host != "", keys).otherwise(none)


def intervals(events: DataFrame, key: str = "key", list_: str = "list", action: str = "action", day: str = "day") -> DataFrame:
    """``key``, ``list``, ``valid_from`` and ``valid_to`` (null while the entry stands) from 'add' and 'remove' events."""
    rows = pick(events, key=key, list=list_, action=action, day=day).filter("key IS NOT NULL AND list IS NOT NULL AND day IS NOT NULL AND action IN ('add', 'remove')").distinct()
    by_key = Window.partitionBy("list", "key").orderBy("day", F.desc("action"))
    changes = rows.withColumn("before", F.lag("action").over(by_key)).filter("action <> coalesce(before, 'remove')")
    spans = changes.withColumn("valid_to", F.lead("day").over(by_key)).filter("action = 'add'")
    return spans.select("key", "list", F.col("day").alias("valid_from"), "valid_to").filter("valid_to IS NULL OR valid_to > valid_from")


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def active_entries(captures: DataFrame, spans: DataFrame, id_col: str, url_col: str, day_col: str) -> DataFrame:
    """One row per capture with ``blocked``, ``n_entries``, ``lists`` (their names, sorted, joined by commas) and ``since``, the
    first day of the entry that is active longest."""
    rows = stage(pick(captures, id=id_col, url=url_col, day=day_col).withColumn("row", F.monotonically_increasing_id()), "captures")
    bounds = rows.agg(F.min("day").alias("first"), F.max("day").alias("last")).first()
    keyed = rows.filter("day IS NOT NULL").select("row", "day", _month(F.col("day")).alias("month"), F.explode(url_keys(F.col("url"))).alias("key"))
    # Only months in which something was fetched matter.
    first, last = F.lit(bounds["first"]).cast("date"), F.lit(bounds["last"]).cast("date")
    start, end = F.greatest("valid_from", first), F.least(F.coalesce("valid_to", last), last)
    by_month = spans.withColumns({"__a": start, "__b": end}).filter("__a <= __b")
    by_month = by_month.withColumn("month", F.explode(F.sequence(_month(F.col("__a")), _month(F.col("__b"))))).drop("__a", "__b")
    hits = keyed.join(by_month, ["key", "month"]).filter("day >= valid_from AND (valid_to IS NULL OR day < valid_to)")
    found = hits.groupBy("row").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("list")).alias("lists"), F.min("valid_from").alias("since"))
    return rows.join(found, "row", "left").select(
        F.col("id").alias(id_col), F.col("day").alias(day_col), F.col("n").isNotNull().alias("blocked"),
        F.coalesce("n", F.lit(0)).alias("n_entries"), F.coalesce(F.array_join("lists", ","), F.lit("")).alias("lists"), "since",
    )

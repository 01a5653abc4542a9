"""URL filters against dated lists: entries become validity intervals, captures are judged as of their fetch day.

An entry is switched on and off by dated rows (list, kind, entry, action, dated). Kind ``domain`` covers a host and all
hosts below it, kind ``host`` the host alone. The state set on a day holds until the next row for the same entry; of
several rows on one day a removal wins. Captures are reduced to distinct (host, day) before any join, so a host with a
third of all captures is at most as many rows as there are days. Built-in functions only.

Edge cases: a null or unparsable url has a null host and matches nothing, as does a null day; rows of the log without
entry or date are void, unknown actions count as ``add``; repeated rows change nothing; empty tables give no rows or no
match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+)"


def host_of(url: Column) -> Column:
    """Lower-case host without port, user and trailing dots; null if there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"[.]+$", "")
    return F.when(host != "", host)


def intervals(log: DataFrame) -> DataFrame:
    """list, kind, entry, valid_from, valid_to (exclusive, null if open) of the listed times of each entry."""
    rows = log.where("entry IS NOT NULL AND dated IS NOT NULL").select(
        "list", "kind", F.lower("entry").alias("entry"), F.col("dated").cast("date").alias("dated"), (F.col("action") == "remove").alias("off")
    )
    days = rows.groupBy("list", "kind", "entry", "dated").agg(F.max(F.coalesce("off", F.lit(False))).alias("off"))
    following = F.lead("dated").over(Window.partitionBy("list", "kind", "entry").orderBy("dated"))
    return days.withColumn("valid_to", following).where(~F.col("off")).select("list", "kind", "entry", F.col("dated").alias("valid_from"), "valid_to")


def covering(host: Column) -> Column:
    """(kind, entry) keys under which a host may be listed: itself, and itself and its parents as domains."""
    labels = F.split(host, "[.]")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    as_domain = F.transform(parents, lambda p: F.struct(F.lit("domain").alias("kind"), p.alias("entry")))
    return F.concat(F.array(F.struct(F.lit("host").alias("kind"), host.alias("entry"))), as_domain)


def filtered(captures: DataFrame, log: DataFrame) -> DataFrame:
    """``captures`` (page_id, url, fetched_on) with host, ``lists`` (names, sorted, joined by commas) and blocked."""
    seen = captures.select("page_id", host_of(F.col("url")).alias("host"), F.col("fetched_on").cast("date").alias("fetched_on"))
    asked = seen.where("host IS NOT NULL AND fetched_on IS NOT NULL").select("host", "fetched_on").distinct()
    keyed = asked.select("host", "fetched_on", F.explode(covering(F.col("host"))).alias("key")).select("host", "fetched_on", "key.*")
    listed = keyed.join(intervals(log), ["kind", "entry"]).where("valid_from <= fetched_on AND (valid_to IS NULL OR fetched_on < valid_to)")
    found = listed.groupBy("host", "fetched_on").agg(F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"))
    return seen.join(found, ["host", "fetched_on"], "left").select(
        "page_id", "host", "fetched_on", "lists", F.col("lists").isNotNull().alias("blocked")
    )

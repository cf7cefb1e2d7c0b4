"""Captures against dated URL lists: was an entry for the capture's URL active when it was fetched?

Everything is column functions, aggregates, windows and equi-joins. List records become validity
intervals; an interval meets captures with the same key in the time buckets that it touches. Keys
with many records have narrow buckets, so neither a busy host nor a long list history makes a
bucket in which everything meets everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from midmile.runtime import stage

CHUNK_SECONDS = 30 * 86_400  # of a key's history that one window sorts
BUCKET_RECORDS = 16  # wanted in a bucket, on average
#: How exact a match is, the most exact first.
KINDS = ("url", "prefix", "host", "domain")


def host(url: Column) -> Column:
    """Lower-case host without user or port; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def path(url: Column) -> Column:
    """Path and query, without a fragment; at least ``/``."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)", 1)
    return F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))


def keys(url: Column) -> Column:
    """Keys under which a list may hold ``url``: itself, its first folder, its host, and domains above that."""
    name, rest = host(url), path(url)
    labels = F.split(name, r"\.")
    above = F.transform(
        F.when(F.size(labels) > 2, F.sequence(F.lit(2), F.size(labels) - 1)).otherwise(F.array().cast("array<int>")),
        lambda k: _key("domain", F.array_join(F.slice(labels, k, 100), ".")),
    )
    folder = F.regexp_extract(rest, r"^(/[^/?]+/)", 1)
    own = [_key("url", F.concat(name, rest)), F.when(folder != "", _key("prefix", F.concat(name, folder))), _key("host", name)]
    return F.when(name != "", F.array_distinct(F.filter(F.concat(F.array(*own), above), lambda k: k.isNotNull())))


def _key(kind: str, text: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), text)


def intervals(records: DataFrame, chunk: int = CHUNK_SECONDS) -> DataFrame:
    """Rows (list, key, since, until) in which an entry is active, from records (list, key, at, active).

    ``at`` is in seconds. A record holds from ``at`` until the next record of its list and key;
    ``until`` is null while there is none. Of records at the same time, one that ends the entry wins;
    repeated records are one. Records with a null in any column say nothing.
    A key's history is sorted in parts of ``chunk`` seconds; only the first times of the parts meet.
    """
    entry = ["list", "key"]
    known = records.select(*entry, F.col("at").cast("long").alias("at"), "active").na.drop()
    known = known.groupBy(*entry, "at").agg(F.min("active").alias("active")).withColumn("chunk", F.floor(F.col("at") / chunk))
    firsts = known.groupBy(*entry, "chunk").agg(F.min("at").alias("first"))
    firsts = firsts.select(*entry, "chunk", F.lead("first").over(Window.partitionBy(*entry).orderBy("chunk")).alias("later"))
    ordered = known.withColumn("until", F.lead("at").over(Window.partitionBy(*entry, "chunk").orderBy("at")))
    return (
        ordered.join(firsts, [*entry, "chunk"])
        .where("active")
        .select(*entry, F.col("at").alias("since"), F.coalesce("until", "later").alias("until"))
    )


def judge(captures: DataFrame, records: DataFrame, url: str = "url", at: str = "fetched", wanted: int = BUCKET_RECORDS) -> DataFrame:
    """``captures`` with ``lists``, ``kind`` and ``n_entries``: what was active at the time of the fetch.

    ``lists`` are the sorted names of lists with an active entry for any key of the URL, ``kind`` the
    most exact kind of entry among them (null if none), ``n_entries`` their number. An entry is active from
    its own second on, and no longer in the second that ends it. Captures without URL, host or time
    match nothing. Equal capture rows come out once; all columns of ``captures`` are kept, and
    columns named like an added one are replaced.
    """
    captures = captures.drop("lists", "kind", "n_entries")
    held = stage(intervals(records), "intervals")
    seen = stage(captures.select(F.col(url).alias("_url"), F.col(at).cast("long").alias("_at")).na.drop().distinct(), "fetches")
    low, high = seen.agg(F.min("_at"), F.max("_at")).first()  # one row
    low, high = (0, 1) if low is None else (low, high + 1)
    span = F.lit(float(high - low))
    # each key's time range is halved until a bucket has few records
    many = held.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > wanted)
    cuts = stage(many.select("key", F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n") / wanted))).alias("parts")), "cuts")
    cut = lambda df: df.join(cuts, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1.0)))
    bucket = lambda t: F.floor((t - low) / span * F.col("parts"))
    first, last = F.greatest(F.col("since"), F.lit(low)), F.least(F.coalesce(F.col("until") - 1, F.lit(high - 1)), F.lit(high - 1))
    spread = cut(held.where(first <= last)).withColumn("bucket", F.explode(F.sequence(bucket(first), bucket(last))))
    asked = cut(seen.select("_url", "_at", F.explode(keys(F.col("_url"))).alias("key"))).withColumn("bucket", bucket(F.col("_at")))
    active = (F.col("_at") >= F.col("since")) & (F.col("until").isNull() | (F.col("_at") < F.col("until")))
    met = asked.drop("parts").join(spread.drop("parts"), ["key", "bucket"]).where(active)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.substring_index("key", ":", 1))
    found = met.groupBy("_url", "_at").agg(
        F.array_sort(F.collect_set("list")).alias("lists"), F.min(rank).alias("kind"), F.count("*").alias("n_entries")
    )
    same = (F.col(url) == F.col("_url")) & (F.col(at).cast("long") == F.col("_at"))
    return captures.distinct().join(found, same, "left").select(
        *captures.columns,
        F.coalesce("lists", F.array().cast("array<string>")).alias("lists"),
        F.coalesce(*[F.when(F.col("kind") == k + 1, name) for k, name in enumerate(KINDS)]).alias("kind"),
        F.coalesce("n_entries", F.lit(0)).alias("n_entries"),
    )

"""URL filters as a temporal list join: dated list entries become validity intervals, and each
capture meets the entries that were active when it was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import fresh


def host(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and a last dot; an IPv6 address with its
    brackets; null if there is none."""
    found = F.regexp_extract(F.trim(url), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9a-f:.]*\]|[^/?#:@]*)", 1)
    return F.nullif(F.regexp_replace(F.lower(found), "\\.$", ""), F.lit(""))


def domains(name: Column) -> Column:
    """The host and its parent domains of two labels or more, the longest first; an address has no parents."""
    parts = F.split(name, "\\.")
    n = F.size(parts)
    return F.when((n <= 2) | name.rlike(r"^\[|^\d+(\.\d+){3}$"), F.array(name)).otherwise(F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.array_join(F.slice(parts, k, n - k + 1), ".")))


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, since, until): when each domain was listed, from entries (domain, day, listed).

    An entry holds from its day until the day of the domain's next entry; until is null for the
    last. Of entries of one day, one that takes the domain off the list wins. Rows with a null are
    ignored; domains are compared in lower case.
    """
    days = entries.dropna(subset=["domain", "day", "listed"]).groupBy(F.lower("domain").alias("domain"), "day").agg(F.min("listed").alias("listed"))
    until = F.lead("day").over(W.partitionBy("domain").orderBy("day"))
    return days.withColumn("until", until).filter("listed").select("domain", F.col("day").alias("since"), "until")


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per row of `captures` (url, fetched date, more): its columns with host, blocked,
    domain and since: the longest listed domain that holds the host and was listed on that day.

    Each capture meets its own host and parent domains only; a host with very many captures is a key
    of few entries, and partitions of such a join can be split. A null URL, one without a host or a
    null date is not blocked. Repeated rows stay. An empty list blocks nothing. Columns named like
    the new ones give way.
    """
    captures = captures.drop("host", "blocked", "domain", "since")
    rows = captures.withColumn("host", host(F.col("url")))
    # a host's days are judged once, however many captures it has on a day
    seen = rows.filter("host is not null and fetched is not null").select("host", "fetched").distinct()
    keys = seen.select("host", "fetched", F.posexplode(domains(F.col("host"))).alias("depth", "key"))
    active = intervals(entries).select(F.col("domain"), "since", "until")
    hit = keys.join(active, (F.col("key") == F.col("domain")) & (F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))))
    best = hit.groupBy("host", "fetched").agg(F.min_by(F.struct("domain", "since"), "depth").alias("b"))
    h, f, b = fresh(rows, "best_host", "best_fetched", "best")
    best = best.toDF(h, f, b)
    found = rows.join(best, (rows["host"] == best[h]) & (rows["fetched"] == best[f]), "left")
    return found.select(*captures.columns, "host", F.col(b).isNotNull().alias("blocked"), F.col(b)["domain"].alias("domain"), F.col(b)["since"].alias("since"))

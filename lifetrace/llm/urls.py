"""URL filters: dated block-list entries joined to captures as of their fetch time.

Entries (kind, key, day, action) become validity intervals: an entry holds from its day
until the next entry of the same key. Keys are whole urls, hosts or domains; the most
specific kind with an active entry decides. A domain holds for all hosts below it, whatever
its number of labels, and among several the longest decides. Intervals are cut at slots of ``SLOT`` days
and joined on (key, slot), so a host that holds a third of all captures is dealt over
its days, and per key at most one interval is active: a capture never meets two.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lifetrace.session import staged

SLOT = 16
KINDS = ("url", "host", "domain")  # the most specific first
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1))


def keys_of(url: Column) -> dict[str, Column]:
    """The keys under which a url can be listed. The url itself is compared without
    its fragment; the domain is the last two labels of the host."""
    host = host_of(url)
    return {
        "url": F.regexp_replace(F.coalesce(url, F.lit("")), "#.*$", ""),
        "host": host,
        "domain": F.coalesce(F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")), host),
    }


def intervals(entries: DataFrame) -> DataFrame:
    """kind, key, since, until (null: open), blocks. Entries of one key and day count
    as one, and block if any of them does; those without key or day never hold. Listed
    hosts and domains are taken in lower case."""
    daily = (
        entries.withColumn("key", F.when(F.col("kind") == "url", F.col("key")).otherwise(F.lower("key")))
        .filter("key IS NOT NULL AND key <> '' AND day IS NOT NULL")
        .groupBy("kind", "key", F.col("day").alias("since"))
        .agg(F.max(F.col("action") == "block").alias("blocks"))
    )
    # one row per key and day at most, so a window never holds more than the days there are
    ahead = Window.partitionBy("kind", "key").orderBy("since")
    return daily.select("kind", "key", "since", F.lead("since").over(ahead).alias("until"), "blocks")


def decide(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (page_id, url, day) with what was active on their day.

    Adds blocked, by (the deciding kind or null) and since. A null url, or one without
    a host, matches no entry of that kind; a null day matches none. Repeated captures
    stay repeated; empty tables are allowed on either side.
    """
    spans = staged(intervals(entries), "intervals")
    last = captures.agg(F.max("day")).first()[0]
    end = F.coalesce("until", F.lit(last).cast("bigint") + 1)
    slot = lambda day: F.floor(day / SLOT)
    slotted = spans.withColumn("until", end).filter("since < until").withColumn(
        "slot", F.explode(F.sequence(slot(F.col("since")), slot(F.col("until") - 1)))
    )
    def met(rows: DataFrame, kind: str, key: str, how: str) -> DataFrame:
        listed = slotted.filter(F.col("kind") == kind).select(
            F.col("key").alias("_key"), F.col("slot").alias("_slot"), F.col("until").alias("_until"),
            F.col("since").alias(f"{kind}_since"), F.col("blocks").alias(f"{kind}_blocks"),
        )
        active = (
            (F.col("_key") == F.col(key)) & (F.col("_slot") == F.col("slot"))
            & (F.col(f"{kind}_since") <= F.col("day")) & (F.col("day") < F.col("_until"))
        )
        return rows.join(listed, active, how).drop("_key", "_slot", "_until")

    table = captures.select("page_id", "url", "day", slot(F.col("day")).alias("slot"))
    keys = keys_of(F.col("url"))
    for kind in ("url", "host"):
        table = met(table.withColumn(f"{kind}_key", keys[kind]), kind, f"{kind}_key", "left")
    # domains by (host, day), under every suffix of as many labels as a listed domain has
    labels = spans.filter("kind = 'domain'").agg(F.max(F.size(F.split("key", r"\.")))).first()[0] or 1
    above = captures.select(host_of(F.col("url")).alias("host_key"), "day", slot(F.col("day")).alias("slot")).filter("host_key <> ''").distinct()
    above = above.withColumn("size", F.explode(F.expr(f"sequence(1, least({labels}, size(split(host_key, '[.]'))))")))
    above = met(above.withColumn("suffix", F.expr("substring_index(host_key, '.', -size)")), "domain", "suffix", "inner")
    longest = above.groupBy(F.col("host_key").alias("_host"), F.col("day").alias("_day")).agg(
        *[F.max_by(c, "size").alias(c) for c in ("domain_since", "domain_blocks")]
    )
    table = table.join(longest, (F.col("host_key") == F.col("_host")) & (F.col("day") == F.col("_day")), "left")
    first = lambda f: F.coalesce(*[f(k) for k in KINDS])
    return table.select(
        "page_id", "url", "day",
        F.coalesce(first(lambda k: F.col(f"{k}_blocks")), F.lit(False)).alias("blocked"),
        first(lambda k: F.when(F.col(f"{k}_since").isNotNull(), F.lit(k))).alias("by"),
        first(lambda k: F.col(f"{k}_since")).alias("since"),
    )


DAYS = 365


def captures_of(pages: DataFrame) -> DataFrame:
    """The pages as captures; their table has no fetch time, a rule over page_id gives one."""
    return pages.select("page_id", "url", F.pmod(F.col("page_id") * 37, F.lit(DAYS)).cast("bigint").alias("day"))


def entries_of(pages: DataFrame) -> DataFrame:
    """List entries drawn from the pages by rule: reports against hosts, domains and
    single urls, and appeals that lift them, each on a day of its own."""
    keys = keys_of(F.col("url"))
    day = F.pmod(F.col("page_id") * 53, F.lit(DAYS)).cast("bigint")
    every = lambda n: F.pmod("page_id", F.lit(n)) == 0
    entry = lambda when, kind, action: F.when(
        when, F.struct(F.lit(kind).alias("kind"), keys[kind].alias("key"), day.alias("day"), F.lit(action).alias("action"))
    )
    given = F.array_compact(
        F.array(
            entry(every(5), "host", "block"), entry(every(7), "host", "allow"),
            entry(every(11), "domain", "block"), entry(every(13), "domain", "allow"),
            entry(every(17), "url", "block"), entry(every(19), "url", "allow"),
        )
    )
    return pages.select(F.inline(given))

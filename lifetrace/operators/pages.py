"""Pages of raw events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def event_page(events: DataFrame, start: int, count: int) -> DataFrame:
    """Events [start, start + count) with geometry; a free shows what it ends.

    The range reaches the scan, so only the row groups holding it are read.
    """
    stop = start + count
    page = events.filter((F.col("seq") >= start) & (F.col("seq") < stop))
    free = (F.col("op") == "F") & F.col("target").isNotNull()
    mark = F.col("op") == "E"
    pick = lambda hit, own: F.when(mark, None).when(free, F.col(hit)).otherwise(F.col(own))
    return page.select(
        "trace_id", "seq", "op", "t",
        F.when(~mark, F.col("id")).alias("id"),
        F.when(free, F.col("target")).when(~mark, F.col("seq")).alias("creator"),
        pick("target_addr", "addr").alias("addr"),
        pick("target_size", "size").alias("size"),
        F.when(F.col("op") == "R", F.coalesce("old_addr", F.lit(0))).alias("old_addr"),
        F.when(F.col("op") == "R", F.coalesce("old_size", F.lit(0))).alias("old_size"),
        F.when(~mark, F.coalesce(F.when(free, F.col("target_site")), F.col("site"))).alias("site"),
        "title",
        F.when(mark, F.col("thr")).alias("thr"),
        F.when(mark, F.col("extras")).alias("extras"),
    )

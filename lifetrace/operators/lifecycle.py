"""From decoded records to events and allocations.

``records`` holds one row per line that is neither blank nor comment, in
stream order (a header line has op H and its version as ``id``):

  trace_id, ord (dense line number), op (null: malformed line), id, kid (the
  id a free or resize ends), addr, size, usable, t, dseq (declared seq), thr,
  site, stack, title, old_addr, old_size, extras (JSON of the custom fields)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lifetrace.functions.u64 import is_compact, saturating_end
from lifetrace.operators.overlap import births_meeting_live
from lifetrace.plans import prefix, ranges, skew
from lifetrace.session import scratch_path, staged
from lifetrace.operators.fields import catalog_of, parsed
from lifetrace.trace import Trace, trace_spans, write_table

CREATORS = ("M", "R")

RECORD_COLUMNS = (
    "trace_id ord op id kid addr size usable t dseq thr site stack title old_addr old_size extras"
).split()


def accepted(df_prefix: str = "") -> Column:
    """Whether a record becomes an event."""
    c = lambda name: F.col(df_prefix + name)
    known = c("op").isin("M", "F", "R", "E")
    null_free = (c("op") == "F") & F.coalesce(c("id") == 0, F.lit(False))
    no_addr = c("op").isin(*CREATORS) & c("addr").isNull()
    return F.coalesce(known, F.lit(False)) & ~null_free & ~no_addr


def sequence(records: DataFrame, block_bits: int = prefix.BLOCK_BITS) -> DataFrame:
    """Dense ``seq`` over accepted records, and the clamped time.

    Also kept: ``t_raw`` as written and ``t_before``, the running maximum
    ahead of the record (null before any time was seen).
    """
    runs = [
        prefix.Run("seq", "sum", F.col("_ok").cast("bigint"), inclusive=False),
        prefix.Run("_t", "max", F.col("t")),
        prefix.Run("t_before", "max", F.col("t"), inclusive=False),
    ]
    marked = records.withColumn("_ok", accepted())
    scanned = prefix.scan(
        marked, ["trace_id"], ["ord"], prefix.block_of("ord", block_bits), runs
    )
    zero = F.lit(0).cast(records.schema["t"].dataType)
    # The first record of a trace has nothing before it to fall behind.
    return scanned.select(
        *[c for c in RECORD_COLUMNS if c != "t"],
        F.col("_ok").alias("ok"),
        F.col("seq").cast("bigint").alias("seq"),
        F.coalesce("_t", zero).alias("t"),
        F.col("t").alias("t_raw"),
        "t_before",
    )


def normalised(df: DataFrame) -> DataFrame:
    """Size at least 1, slack kept only when it exceeds the size."""
    size = F.when(F.col("size") > 0, F.col("size")).otherwise(F.lit(1).cast(df.schema["size"].dataType))
    creator = F.col("op").isin(*CREATORS)
    return (
        df.withColumn("bad_size", creator & ~F.coalesce(F.col("size") > 0, F.lit(False)))
        .withColumn("size", F.when(creator, size))
        .withColumn("usable", F.when(creator & (F.col("usable") > F.col("size")), F.col("usable")))
    )


_BIRTH = ["seq", "t", "addr", "size", "usable", "site", "thr"]
_DEATH = ["seq", "t", "op", "thr", "site", "extras"]


def id_steps(lines: DataFrame) -> DataFrame:
    """The kill and create steps of each record, keyed by the id they touch.

    A resize gives two steps, its kill first. ``obs`` marks a resize that was
    dropped for want of an address: it sees the id but ends nothing.
    """
    base = lines.filter(F.col("op").isin("M", "F", "R"))
    dropped = (F.col("op") == "R") & F.col("addr").isNull()
    kept = base.filter(F.col("ok") | dropped).withColumn("obs", dropped)
    kills = kept.filter(F.col("op").isin("F", "R")).withColumn("key", F.col("kid"))
    creates = kept.filter(F.col("op").isin(*CREATORS) & F.col("ok")).withColumn("key", F.col("id"))
    return kills.withColumn("create", F.lit(False)).unionByName(
        creates.withColumn("create", F.lit(True))
    )


def linked_steps(
    steps: DataFrame, rows: int, hot_rows: int = skew.HOT_ROWS, block_bits: int = prefix.BLOCK_BITS
) -> DataFrame:
    """What each step finds on its id, with one shuffle by id.

    Along one id a kill succeeds exactly when the step before it is a create:
    a kill after a kill is a double free, one with no create ahead is unknown.
    A create right after a create reuses a live id, and a create is ended by
    the very next step when that is a kill. An id hot enough to fill a task is
    cut into blocks of the order; the steps at the block edges are carried.
    """
    keyed = steps.filter(F.col("key").isNotNull())
    keys = ["trace_id", "key"]
    hot = skew.hot_keys(keyed, keys, rows, "seq", hot_rows)
    keyed = skew.mark_hot(keyed, keys, hot)
    order = ["seq", "create"]
    keyed = keyed.withColumn("_block", skew.hot_block(prefix.block_of("seq", block_bits)))
    window = Window.partitionBy(*keys, "_block").orderBy(*order)
    before = window.rowsBetween(Window.unboundedPreceding, -1)

    birth = F.struct("create", *_BIRTH)
    death = F.struct("create", *_DEATH)
    effective = ~F.col("obs")
    linked = keyed.withColumns(
        {"_birth": F.when(effective, birth), "_death": F.when(effective, death)}
    ).select(
        *keyed.columns,
        F.last("_birth", ignorenulls=True).over(before).alias("prev"),
        F.max(F.when(F.col("create"), True)).over(before).alias("seen"),
        F.expr(
            "lead(_death) IGNORE NULLS OVER "
            "(PARTITION BY trace_id, key, _block ORDER BY seq, create)"
        ).alias("next"),
    )
    if hot is None:
        return linked.drop("_hot", "_block")

    position = F.struct(*order)
    edges = (
        keyed.filter("_hot")
        .groupBy(*keys, "_block")
        .agg(
            F.max_by(birth, F.when(effective, position)).alias("_last"),
            F.min_by(death, F.when(effective, position)).alias("_first"),
            F.max(F.when(F.col("create"), True)).alias("_any"),
        )
    )
    by_block = Window.partitionBy(*keys).orderBy("_block")
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    carry = edges.select(
        *keys,
        "_block",
        F.last("_last", ignorenulls=True).over(earlier).alias("_prev"),
        F.max("_any").over(earlier).alias("_seen"),
        F.expr(
            "lead(_first) IGNORE NULLS OVER (PARTITION BY trace_id, key ORDER BY _block)"
        ).alias("_next"),
    )
    return linked.join(carry, [*keys, "_block"], "left").select(
        *[c for c in linked.columns if c not in ("prev", "seen", "next", "_hot", "_block")],
        F.coalesce("prev", "_prev").alias("prev"),
        F.coalesce("seen", "_seen").alias("seen"),
        F.coalesce("next", "_next").alias("next"),
    )


def kill_status(prev: str = "prev", seen: str = "seen") -> Column:
    return (
        F.when(F.col(f"{prev}.create"), "ok")
        .when(F.col(seen), "double")
        .otherwise("unknown")
    )


def resolve(
    lines: DataFrame,
    rows: int,
    hot_rows: int = skew.HOT_ROWS,
    block_bits: int = prefix.BLOCK_BITS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events, allocations and the statuses of dropped resizes."""
    compact = is_compact(lines)
    steps = id_steps(normalised(lines))
    linked = staged(linked_steps(steps, rows, hot_rows, block_bits), "steps")
    number = lines.schema["addr"].dataType

    # Steps without an id were kept out of the shuffle: they all share "no id".
    unkeyed = steps.filter(F.col("key").isNull())
    for name in ("prev", "seen", "next"):
        unkeyed = unkeyed.withColumn(name, F.lit(None).cast(linked.schema[name].dataType))
    every = linked.unionByName(unkeyed)

    kills = every.filter(~F.col("create")).withColumn("kill_status", kill_status())
    hit = F.col("kill_status") == "ok"
    target = [
        F.when(hit, F.col(f"prev.{source}")).alias(name)
        for source, name in (
            ("seq", "target"),
            ("addr", "target_addr"),
            ("size", "target_size"),
            ("usable", "target_usable"),
            ("site", "target_site"),
        )
    ]
    next_is_kill = F.coalesce(~F.col("next.create"), F.lit(False))
    creates = every.filter("create").withColumn("dup_id", F.coalesce(F.col("prev.create"), F.lit(False)))

    common = [
        "trace_id", "seq", "ord", "op", "t", "t_raw", "t_before", "dseq",
        F.coalesce("id", F.lit(0).cast(number)).alias("id"),
        F.coalesce("addr", F.lit(0).cast(number)).alias("addr"),
        F.coalesce("size", F.lit(0).cast(number)).alias("size"),
        "usable", "thr",
        F.when(F.col("op") != "E", F.col("site")).alias("site"),
        F.when(F.col("op") != "E", F.col("stack")).alias("stack"),
        F.when(F.col("op") == "E", F.col("title")).alias("title"),
        "extras", "kid", "bad_size",
    ]
    no_target = [
        F.lit(None).cast(t).alias(n)
        for n, t in (
            ("target", "bigint"), ("target_addr", number), ("target_size", number),
            ("target_usable", number), ("target_site", "string"), ("kill_status", "string"),
        )
    ]
    old_none = [F.lit(None).cast(number).alias(n) for n in ("old_addr", "old_size")]
    dup_none = F.lit(False).alias("dup_id")

    landmarks = normalised(lines.filter((F.col("op") == "E") & F.col("ok")))
    ev_marks = landmarks.select(*common, *no_target, *old_none, dup_none)
    ev_births = creates.filter(F.col("op") == "M").select(*common, *no_target, *old_none, "dup_id")
    # A free carries no geometry of its own.
    ev_frees = kills.filter(F.col("op") == "F").withColumn("addr", F.lit(None).cast(number)).select(
        *common, *target, "kill_status", *old_none, dup_none
    )
    resize_kills = kills.filter((F.col("op") == "R") & ~F.col("obs")).select(
        "trace_id", "seq", *target, "kill_status",
        F.col("old_addr").alias("_oa"), F.col("old_size").alias("_os"),
    )
    resizes = creates.filter(F.col("op") == "R").join(resize_kills, ["trace_id", "seq"])
    # Geometry a resize leaves behind, its target's before the record's.
    zero = F.lit(0).cast(number)
    old_addr = F.coalesce(F.when(F.col("target").isNull(), F.col("_oa")), F.col("target_addr"), zero)
    old_size = F.coalesce(F.when(F.col("target").isNull(), F.col("_os")), F.col("target_size"), zero)
    known = (old_addr != 0) | (old_size != 0)
    ev_resizes = resizes.select(
        *common,
        "target", "target_addr", "target_size", "target_usable", "target_site", "kill_status",
        F.when(known, old_addr).alias("old_addr"),
        F.when(known, old_size).alias("old_size"),
        "dup_id",
    )
    events = (
        ev_marks.unionByName(ev_births).unionByName(ev_frees).unionByName(ev_resizes)
    )

    def allocation(df: DataFrame, came_from: Column) -> DataFrame:
        span = F.greatest("size", "usable")
        death = lambda f: F.when(next_is_kill, F.col(f"next.{f}"))
        return df.select(
            "trace_id",
            F.col("seq").alias("creator"),
            "op",
            F.coalesce("id", zero).alias("id"),
            F.col("id").isNotNull().alias("registered"),
            "addr",
            saturating_end(F.col("addr"), F.col("size"), compact).alias("end_req"),
            saturating_end(F.col("addr"), span, compact).alias("end_span"),
            "size", "usable", span.alias("span"),
            F.col("t").alias("birth_t"),
            death("seq").alias("death"),
            death("t").alias("death_t"),
            death("op").alias("death_op"),
            (death("t") - F.col("t")).cast(number).alias("lifetime"),
            next_is_kill.alias("freed"),
            "site", "thr", "stack",
            came_from.alias("realloc_from"),
            F.when(death("op") == "R", death("seq")).alias("realloc_to"),
            "extras",
            death("extras").alias("death_extras"),
            death("thr").alias("death_thr"),
        )

    allocations = allocation(
        creates.filter(F.col("op") == "M"), F.lit(None).cast("bigint")
    ).unionByName(allocation(resizes, F.col("target")))
    dropped = kills.filter("obs").select("trace_id", "ord", "kill_status", "kid")
    return events, allocations, dropped


def reject_table(lines: DataFrame, dropped: DataFrame) -> DataFrame:
    """Lines that gave no event but may have warned, with what they warned of."""
    gone = lines.filter(~F.col("ok"))
    reason = (
        F.when(F.col("op").isNull(), "malformed")
        .when(F.col("op") == "H", "header")
        .when(F.col("op").isin(*CREATORS), "no-addr")
        .when(F.col("op") == "F", "null-free")
        .otherwise("unknown-op")
    )
    return gone.select(
        "trace_id", "ord", "seq", "op", "id", "t_raw", "t_before", "dseq", "site",
        "thr", "extras", reason.alias("reason"),
    ).join(dropped, ["trace_id", "ord"], "left")


def build(
    records: DataFrame,
    headers: DataFrame,
    path: str | None = None,
    hot_rows: int = skew.HOT_ROWS,
    block_bits: int = prefix.BLOCK_BITS,
    pair_limit: int = ranges.PAIR_LIMIT,
) -> Trace:
    """Resolve records and write the tables of the traces below ``path``.

    Narrow decode, one shuffle by order block, one by id, one by address bin.
    Between the steps the rows are written, so a lost executor costs its own
    tasks and not the whole lineage. The limits only decide how work is cut.
    """
    spark = records.sparkSession
    path = path or scratch_path(spark, "trace")
    lines = staged(sequence(records, block_bits), "lines")
    rows = lines.count()
    events, allocations, dropped = resolve(lines, rows, hot_rows, block_bits)
    spans = staged(trace_spans(lines), "spans")
    stored_events = write_table(events.withColumn("custom", parsed("extras")), path, "events", spans)
    with_fields = allocations.withColumns({"custom": parsed("extras"), "death_custom": parsed("death_extras")})
    stored = write_table(with_fields, path, "allocations", spans)
    write_table(births_meeting_live(stored, pair_limit), path, "overlaps")
    rejects = reject_table(lines, dropped).withColumn("custom", parsed("extras"))
    rejects = write_table(rejects, path, "rejects")
    write_table(headers, path, "headers")
    write_table(catalog_of(stored_events, rejects), path, "fields")
    return Trace.load(spark, path)

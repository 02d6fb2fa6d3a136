"""What is wrong with a trace, without rejecting it."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifetrace.plans.prefix import dense_index
from lifetrace.plans.small import per_trace
from lifetrace.session import staged
from lifetrace.trace import Trace

# The warning kinds in code order.
KINDS = (
    "malformed_line",
    "decreasing_time",
    "sequence_mismatch",
    "unknown_id",
    "double_free",
    "duplicate_id",
    "overlap",
    "invalid_size",
    "unknown_version",
)
_RANK = {
    "decreasing_time": 1, "sequence_mismatch": 2, "unknown_id": 3, "double_free": 3,
    "malformed_line": 4, "invalid_size": 5, "duplicate_id": 6, "overlap": 7, "unknown_version": 0,
}


def _as(df: DataFrame, kind: str, detail: Column, seq: Column | None = None) -> DataFrame:
    return df.select(
        "trace_id",
        (F.col("seq") if seq is None else seq).cast("bigint").alias("seq"),
        F.lit(kind).alias("kind"),
        F.coalesce(detail.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")).alias("detail"),
        "ord",
        F.lit(_RANK[kind]).alias("emit_rank"),
    )


def _before(seq: str = "seq") -> Column:
    return F.greatest(F.col(seq) - 1, F.lit(0))


def _shared(trace: Trace) -> DataFrame:
    """Events and rejected records alike: both pass the time and seq checks."""
    cols = ["trace_id", "seq", "ord", "t_raw", "t_before", "dseq"]
    gone = trace.rejects.filter("reason not in ('malformed', 'header')")
    return trace.events.select(*cols).unionByName(gone.select(*cols))


def of_kind(trace: Trace, kind: str) -> DataFrame:
    """All warnings of one kind."""
    events, rejects = trace.events, trace.rejects
    if kind == "decreasing_time":
        late = _shared(trace).filter(F.col("t_raw") < F.col("t_before"))
        return _as(late, kind, F.col("t_raw"))
    if kind == "sequence_mismatch":
        # Reported once per trace: the first record that disagrees.
        off = _shared(trace).filter(F.col("dseq") != F.col("seq"))
        first = off.groupBy("trace_id").agg(
            F.min_by(F.struct("seq", "dseq", "ord"), "ord").alias("f")
        ).select("trace_id", "f.*")
        return _as(first, kind, _wrapped(F.col("dseq")))
    if kind in ("unknown_id", "double_free"):
        status = "unknown" if kind == "unknown_id" else "double"
        seen = events.filter(F.col("kill_status") == status)
        gone = rejects.filter(F.col("kill_status") == status)
        return _as(seen, kind, F.col("kid")).unionByName(_as(gone, kind, F.col("kid")))
    if kind == "malformed_line":
        bad = rejects.filter(F.col("reason").isin("malformed", "no-addr"))
        return _as(bad, kind, F.when(F.col("reason") == "no-addr", F.col("id")), _before())
    if kind == "invalid_size":
        return _as(events.filter("bad_size"), kind, F.col("id"))
    if kind == "duplicate_id":
        return _as(events.filter("dup_id"), kind, F.col("id"))
    if kind == "overlap":
        met = trace.overlaps.select("trace_id", F.col("creator").alias("seq"))
        where = events.filter("op in ('M','R')").select("trace_id", "seq", "ord", "addr")
        return _as(where.join(met, ["trace_id", "seq"], "left_semi"), kind, F.col("addr"))
    if kind == "unknown_version":
        odd = rejects.filter((F.col("reason") == "header") & (F.col("id") != 1))
        return _as(odd, kind, _wrapped(F.col("id")), _before())
    raise ValueError(f"unknown warning kind: {kind}")


def _wrapped(col: Column) -> Column:
    """A signed number as the unsigned one with the same bits."""
    wide = col.cast("decimal(38,0)")
    return F.when(col < 0, wide + F.lit(Decimal(1 << 64)).cast("decimal(38,0)")).otherwise(wide)


def _listed(rows: DataFrame, found: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """The warnings of each row, from one pass: kind -> (when, detail, seq)."""
    some = [
        F.when(
            when,
            F.struct(
                seq.cast("bigint").alias("seq"), F.lit(kind).alias("kind"),
                F.coalesce(detail.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")).alias("detail"),
                F.lit(_RANK[kind]).alias("emit_rank"),
            ),
        )
        for kind, (when, detail, seq) in found.items()
    ]
    # rows without any leave before the list of the others is taken apart
    noted = rows.filter(F.coalesce(*[F.when(when, True) for when, _, _ in found.values()], F.lit(False)))
    return noted.select("trace_id", "ord", F.explode(F.array_compact(F.array(*some))).alias("w")).select(
        "trace_id", "w.seq", "w.kind", "w.detail", "ord", "w.emit_rank"
    )


def warnings(trace: Trace) -> DataFrame:
    """Every warning; (ord, emit_rank) is the order they come up in.

    One pass over events and one over rejects find all kinds a row shows by
    itself; the first mismatch of a trace and overlaps are found apart.
    """
    col, here = F.col, F.col("seq")
    late = F.col("t_raw") < F.col("t_before")
    events = _listed(
        trace.events,
        {
            "decreasing_time": (late, col("t_raw"), here),
            "unknown_id": (col("kill_status") == "unknown", col("kid"), here),
            "double_free": (col("kill_status") == "double", col("kid"), here),
            "invalid_size": (col("bad_size"), col("id"), here),
            "duplicate_id": (col("dup_id"), col("id"), here),
        },
    )
    reason = col("reason")
    rejects = _listed(
        trace.rejects,
        {
            "decreasing_time": (late & ~reason.isin("malformed", "header"), col("t_raw"), here),
            "unknown_id": (col("kill_status") == "unknown", col("kid"), here),
            "double_free": (col("kill_status") == "double", col("kid"), here),
            "malformed_line": (reason.isin("malformed", "no-addr"), F.when(reason == "no-addr", col("id")), _before()),
            "unknown_version": ((reason == "header") & (col("id") != 1), _wrapped(col("id")), _before()),
        },
    )
    out = events.unionByName(rejects)
    for kind in ("sequence_mismatch", "overlap"):
        out = out.unionByName(of_kind(trace, kind))
    return out


def counts_by_kind(trace: Trace) -> DataFrame:
    return warnings(trace).groupBy("trace_id", "kind").agg(F.count(F.lit(1)).alias("warnings"))


def page(trace: Trace, start: int = 0, count: int | None = None, kept: int | None = None) -> DataFrame:
    """Warnings [start, start + count) of each trace, with totals on every row.

    Without ``count`` the page goes on to the end; ``kept`` lists the first that
    many of a trace only, and says how many are left out. Places come from one
    range shuffle, so a trace with very many warnings is never in one task.
    """
    found = staged(warnings(trace), "warnings")
    ranked = dense_index(found, ["trace_id"], ["ord", "emit_rank", "detail"], "position")
    totals = per_trace(found.groupBy("trace_id").agg(F.count(F.lit(1)).alias("observed")), "observed")
    place = F.col("position")
    ends = [e for e in (kept, None if count is None else start + count) if e is not None]
    shown = ranked.filter((place >= start) & (place < min(ends)) if ends else place >= start)
    held = F.col("observed") if kept is None else F.least("observed", F.lit(kept).cast("bigint"))
    return shown.join(totals, "trace_id").select(
        "trace_id", "position", "seq", "kind", "detail", "observed",
        held.alias("retained"), (F.col("observed") - held).alias("omitted"),
    )

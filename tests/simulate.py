"""A sequential reading of a small trace, to compare the Spark jobs with."""

from __future__ import annotations


def simulate(records: list[dict]) -> dict:
    """Records in order (dicts of the record columns) to rows of each table."""
    events, creators, warnings, overlapping = [], {}, [], set()
    latest: dict = {}
    top, seen_t, mismatch = 0, False, False
    for ordinal, r in enumerate(records):
        g = r.get
        op = g("op")
        at = len(events)
        if op is None:
            warnings.append((max(at - 1, 0), "malformed_line", 0))
            continue
        if g("t") is not None:
            if seen_t and g("t") < top:
                warnings.append((at, "decreasing_time", g("t")))
            top = max(top, g("t"))
        seen_t = True
        if g("dseq") is not None and g("dseq") != at and not mismatch:
            warnings.append((at, "sequence_mismatch", g("dseq")))
            mismatch = True
        if op not in "MFRE" or (op == "F" and g("id") == 0):
            continue
        target = None
        if op in "FR":
            kid = g("kid")
            c = latest.get(kid) if kid is not None else None
            if c is None:
                warnings.append((at, "unknown_id", kid or 0))
            elif creators[c]["death"] is not None:
                warnings.append((at, "double_free", kid))
            else:
                target = c
        size = usable = None
        if op in "MR":
            if g("addr") is None:
                warnings.append((max(at - 1, 0), "malformed_line", g("id") or 0))
                continue
            size = g("size") or 0
            if size == 0:
                warnings.append((at, "invalid_size", g("id") or 0))
                size = 1
            usable = g("usable") if (g("usable") or 0) > size else None
        events.append({"seq": at, "op": op, "t": top, "target": target})
        if target is not None:
            creators[target]["death"] = at
        if op in "MR":
            if g("id") is not None:
                before = latest.get(g("id"))
                if before is not None and creators[before]["death"] is None:
                    warnings.append((at, "duplicate_id", g("id")))
                latest[g("id")] = at
            end = g("addr") + max(size, usable or 0)
            if any(
                c["death"] is None and c["addr"] < end and c["end"] > g("addr")
                for c in creators.values()
            ):
                warnings.append((at, "overlap", g("addr")))
                overlapping.add(at)
            creators[at] = {
                "addr": g("addr"), "end": end, "size": size, "death": None,
                "from": target if op == "R" else None,
            }
    live, peak = 0, (0, 0)
    for e in events:
        if e["target"] is not None:
            live -= creators[e["target"]]["size"]
        if e["seq"] in creators:
            live += creators[e["seq"]]["size"]
        e["live"] = live
        if live > peak[0]:
            peak = (live, e["seq"] + 1)
    return {
        "events": events, "creators": creators, "warnings": warnings,
        "overlaps": overlapping, "peak": peak,
    }

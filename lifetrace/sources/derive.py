"""Traces out of ordinary tables.

An adapter says, for each row of a user table, which record it stands for.
Two are given: a clean one over ``orders`` and a dirty one over ``events``
with every kind of defect a record can carry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lifetrace.operators.lifecycle import RECORD_COLUMNS
from lifetrace.plans.prefix import dense_index

RECORD_TYPES = {
    "trace_id": "string", "ord": "bigint", "op": "string", "id": "bigint", "kid": "bigint",
    "addr": "bigint", "size": "bigint", "usable": "bigint", "t": "bigint", "dseq": "bigint",
    "thr": "bigint", "site": "string", "stack": "string", "title": "string",
    "old_addr": "bigint", "old_size": "bigint", "extras": "string",
}


def as_records(df: DataFrame, **columns: Column) -> DataFrame:
    """Select record columns from expressions; what is not given is null."""
    return df.select(
        *[
            columns.get(n, F.lit(None)).cast(RECORD_TYPES[n]).alias(n)
            for n in RECORD_COLUMNS
        ]
    )


def _seconds(ts: str) -> Column:
    """Epoch seconds of a timestamp's wall clock, whatever the session zone."""
    day = F.unix_date(F.col(ts).cast("date")).cast("bigint")
    return day * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def _round_up(col: Column, step: int) -> Column:
    return F.call_function("div", col + (step - 1), F.lit(step).cast("bigint")) * step


def orders_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as allocations: opened at the order date, closed by status.

    F orders are freed, P orders are resized once and stay, O orders stay.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    base = orders.select(
        key.alias("key"), cust.alias("cust"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("prio"),
        F.floor("o_totalprice").cast("bigint").alias("price"), _seconds("o_orderdate").alias("t0"),
        (cust * 16777216 + (key % 4) * 2097152).alias("base"),
    )
    k = F.col("key")
    extras = lambda: F.concat(
        F.lit('"status":"'), "status", F.lit('","cust":'), F.col("cust").cast("string")
    )
    usable = lambda size: F.when(k % 3 == 0, _round_up(size, 65536))
    common = {"trace_id": F.lit("orders"), "thr": F.col("cust") % 8}
    price = F.col("price")
    births = as_records(
        base, op=F.lit("M"), id=k + 1, addr=F.col("base"), size=price, usable=usable(price),
        t=F.col("t0"), site=F.col("prio"), stack=F.concat(F.lit("order\n"), "prio"),
        extras=extras(), **common,
    )
    frees = as_records(
        base.filter("status = 'F'"), op=F.lit("F"), id=k + 1, kid=k + 1,
        t=F.col("t0") + 86400 * (1 + k % 60),
        extras=F.concat(F.lit('"reason":"r'), (k % 3).cast("string"), F.lit('"')), **common,
    )
    resizes = as_records(
        base.filter("status = 'P'"), op=F.lit("R"), id=k + 1000000001, kid=k + 1,
        addr=F.col("base") + 8388608, size=price * 2, usable=usable(price * 2),
        t=F.col("t0") + 864000, site=F.col("prio"), extras=extras(), **common,
    )
    every = births.unionByName(frees).unionByName(resizes).drop("ord")
    return dense_index(every, ["trace_id"], ["t", "op", "id"], "ord").select(*RECORD_COLUMNS)


def events_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a dirty trace; ``event_id`` is the stream order."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    e, u = F.col("event_id"), F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("bigint")
    op = (
        F.when(F.col("event_type").isin("view", "click"), "M")
        .when(F.col("event_type") == "purchase", "F")
        .when(F.col("event_type") == "signup", "R")
        .otherwise("E")
    )
    micros = (
        F.unix_date(F.col("ts").cast("date")).cast("bigint") * 86400
        + F.hour("ts") * 3600 + F.minute("ts") * 60
    ) * 1000000 + (F.expr("extract(SECOND FROM ts)") * 1000000).cast("bigint")
    base = events.select(
        e.alias("e"), u.alias("u"), k.alias("k"), op.alias("op"), micros.alias("us"),
        F.floor(F.col("value") * 10).cast("bigint").alias("amount"),
    )
    e, u, k, op = F.col("e"), F.col("u"), F.col("k"), F.col("op")
    creator = op.isin("M", "R")
    amount = F.col("amount")
    text = lambda c: c.cast("string")
    hot = (
        F.when(k % 5 == 0, ',"hot":true').when(k % 5 == 1, ',"hot":false')
        .when(k % 5 == 2, ',"hot":null').otherwise("")
    )
    load = F.when(
        k % 2 == 0,
        F.concat(text(F.call_function("div", k, F.lit(4).cast("bigint"))), F.lit("."), F.when(k % 4 == 0, "0").otherwise("5")),
    ).otherwise(text(k))
    extras = (
        F.when(
            creator,
            F.concat(
                F.lit('"k":'), text(k), F.lit(',"lane":"L'), text(k % 3), F.lit('"'), hot,
                F.lit(',"load":'), load,
                F.when(k % 11 == 0, F.concat(F.lit(',"dbg":{"a":'), text(k), F.lit("}"))).otherwise(""),
            ),
        )
        .when(op == "F", F.concat(F.lit('"k":'), text(k), F.lit(',"reason":"r'), text(k % 3), F.lit('"')))
        .otherwise(F.concat(F.lit('"k":'), text(k), F.lit(',"frame":'), text(e), F.lit(',"ptr":'), text(u * 4096 + k * 32)))
    )
    return as_records(
        base,
        trace_id=F.lit("events"), ord=e, op=op,
        id=F.when((op == "M") & (k != 13), u).when(op == "R", (u + k) % 150).when(op == "F", u),
        kid=F.when(op.isin("F", "R"), u),
        addr=F.when(creator & ~((k == 7) & (e % 3 == 0)), u * 4096 + k * 32),
        size=F.when(creator, amount),
        usable=F.when(creator & (k % 3 == 0), _round_up(amount, 64)),
        t=F.when(e % 40 != 3, F.col("us") - F.when(e % 50 == 7, 3600000000).otherwise(0)),
        dseq=F.when(e % 1000 == 999, e + 5),
        thr=F.when(k != 21, u % 8),
        site=F.when(creator & (k % 10 != 9), F.concat(F.lit("site_"), text(k % 10)))
        .when((op == "F") & (k % 2 == 0), F.concat(F.lit("drain_"), text(u % 3))),
        stack=F.when(creator & (k % 4 == 0), F.concat(F.lit("main\nstep_"), text(k % 7))),
        title=F.when((op == "E") & (k % 4 != 0), F.concat(F.lit("phase-"), text(k % 5))),
        old_addr=F.when(op == "R", u * 4096), old_size=F.when((op == "R") & (k % 2 == 0), amount + 1),
        extras=extras,
    )


HEADER_TYPES = (
    "trace_id string, has_header boolean, version bigint, unit string, title string, "
    "row_bytes bigint, arena_base bigint, meta string"
)


def header_row(spark: SparkSession, trace_id: str, unit: str, title: str = "") -> DataFrame:
    return spark.createDataFrame([(trace_id, True, 1, unit, title, 0, 0, "")], HEADER_TYPES)


def change_log(spark: SparkSession, sf_dir: str, trace_id: str = "events") -> DataFrame:
    """A log of annotation changes, one per event, some of them invalid in one of
    all the ways there are but the limit of tags. Creators are spread over the
    whole trace."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = events.count()
    k = F.get_json_object("props", "$.k").cast("bigint")
    e, u, k = F.col("e"), F.col("u"), F.col("k")
    base = events.select(
        F.col("event_id").alias("e"), F.col("user_id").alias("u"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )
    kind = e % 12
    tag = F.concat(F.lit("t"), (k % 25).cast("string"))
    text = lambda c: c.cast("string")
    types = [
        "putTag", "setAllocationName", "setAllocationColor", "setAllocationTag", "setAllocationTag",
        "replaceAllocationTags", "replaceTagMembers", "putBookmark", "putAddressMark",
        "putSavedFilter", "deleteTag", "deleteBookmark",
    ]
    chosen = F.element_at(F.array(*[F.lit(t) for t in types]), (kind + 1).cast("int"))
    chosen = F.when((kind == 10) & (k % 4 != 0), "putTag").when((kind == 9) & (k == 94), "putNote").otherwise(chosen)
    creator = (e * 7919 + u * 7 + k) % n
    return base.withColumn("type", chosen).select(
        F.lit(trace_id).alias("trace_id"), (e + 1).alias("revision"), "type",
        F.when(F.col("type").isin("setAllocationName", "setAllocationColor", "setAllocationTag", "replaceAllocationTags"), creator).alias("creator"),
        F.when(F.col("type").isin("putTag", "deleteTag", "setAllocationTag", "replaceTagMembers"), F.when(k == 99, "bad id!").otherwise(F.concat(F.lit(" "), tag, F.lit(" "))))
        .when(F.col("type").isin("putBookmark", "deleteBookmark"), F.concat(F.lit("b"), text(k % 30)))
        .when(F.col("type") == "putAddressMark", F.concat(F.lit("a"), text(k % 30)))
        .when(F.col("type") == "putSavedFilter", F.concat(F.lit("f"), text(k % 30))).alias("id"),
        F.when(F.col("type") == "replaceAllocationTags", F.array(tag, F.concat(F.lit("t"), text((k + 1) % 25)))).alias("tag_ids"),
        F.when(F.col("type") == "replaceTagMembers", F.array(creator, (creator + 3) % n)).alias("creators"),
        F.when((F.col("type") == "setAllocationTag") & (k != 92), k % 3 != 0).alias("present"),
        F.when(F.col("type") == "setAllocationName", F.when(k % 9 != 0, F.concat(F.lit(" n"), text(k))))
        .when(F.col("type").startswith("put"), F.when(k == 98, "  ").otherwise(F.concat(F.lit("N"), text(k)))).alias("name"),
        F.when(F.col("type") == "setAllocationColor", F.when(k == 97, "#GG0000").when(k % 9 != 0, F.concat(F.lit("#AABB"), text(10 + k % 90))))
        .when(F.col("type") == "putTag", F.lit("#CCDDEE")).alias("color"),
        F.when((F.col("type") == "putBookmark") & (k != 93), e * (1 + F.when(k == 50, 1).otherwise(0))).alias("seq"),
        F.when(F.col("type") == "putBookmark", F.when(k == 96, float("nan")).otherwise(text(e).cast("double"))).alias("t"),
        F.when(F.col("type") == "putAddressMark", F.when(k == 51, "zz").otherwise(F.concat(F.lit("0X00"), F.upper(F.hex(u * 4096 + k))))).alias("addr"),
        F.when((F.col("type") == "putSavedFilter") & (k != 91), F.when(k == 95, F.repeat(F.lit("x"), 16385)).otherwise(F.concat(F.lit("alloc.size > "), text(k)))).alias("source"),
    )

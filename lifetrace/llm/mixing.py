"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets share all words by weight, none above ``EPOCHS`` times its source. The
documents of a source are dealt, by a seeded hash, to shards of bounded size; a shard
lays its documents one after another in seeded order and cuts the words into equal
blocks. Sainte-Laguë hands out blocks one by one to the shard with the highest
quotient target / (2 * given + 1); the outcome is found without the loop, as the
quotient down to which everything is served: a search over sums, a few small jobs for
any number of shards. With its quota a shard takes whole passes over its words and,
for the rest, a seeded choice of blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lifetrace.llm.common import WORD, whole_text
from lifetrace.plans.prefix import dense_index
from lifetrace.session import staged

EPOCHS = 3
WEIGHTS = 3  # sources weigh 1, 2, ... WEIGHTS, again and again
SHARD_WORDS = 1 << 17
SHARD_ROWS = 1 << 10
MOST_BLOCK = 256
#: Blocks that the smallest target has at least, so that rounding to whole blocks
#: moves no source by more than about a hundredth of its target.
LEAST_BLOCKS = 64
SEED = 7
_PROBES = 32
#: Primes above any number of blocks in a shard, steps of the choice.
_STEPS = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549)


def _rows(docs: DataFrame, *carried: Column) -> DataFrame:
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    return docs.select(
        *carried,
        F.col("doc_id"),
        key.alias("skey"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(whole_text(), F.lit(WORD)).cast("bigint").alias("size"),
        F.xxhash64(F.lit(SEED), "doc_id", "text").alias("draw"),
    )


def targets(sizes: DataFrame) -> DataFrame:
    """skey, source, source_size, n_shards and target of every source."""
    totals = sizes.groupBy("skey", "source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows")
    )
    ordered = dense_index(totals.withColumn("none", F.col("source").isNull()), [], ["none", "source"], "number")
    sources = staged(
        ordered.select(
            "skey", "source", "source_size", "number",
            (F.pmod("number", F.lit(WEIGHTS)) + 1).cast("double").alias("weight"),
            F.greatest(
                F.lit(1).cast("bigint"),
                F.ceil(F.col("source_size") / SHARD_WORDS), F.ceil(F.col("n_rows") / SHARD_ROWS),
            ).alias("n_shards"),
        ),
        "sources",
    )
    cap = (F.col("source_size") * EPOCHS).cast("double")
    everything = sources.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while everything:
        # sources above their cap at this level stop there, the rest share what is left
        over = F.lit(level) * F.col("weight") > cap
        row = sources.agg(
            F.sum(F.when(over, cap).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))),
            F.sum(over.cast("bigint")),
        ).first()
        if row[2] == full or not row[1]:
            break
        full, level = row[2], (everything - row[0]) / row[1]
    return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def _quotas(cells: DataFrame, blocks: int) -> Column:
    """Seats of each row of ``cells`` (target, number, shard): ``blocks`` in total."""
    seats = lambda quotient: F.floor((F.col("target") / quotient + 1) / 2)
    total, n, most = cells.agg(F.sum("target"), F.count(F.lit(1)), F.max("target")).first()
    low, high = total / (2 * blocks + n), 2 * most  # served down to: at least all, none
    under = 0
    while True:
        step = (high - low) / (_PROBES + 1)
        probes = [low + step * (i + 1) for i in range(_PROBES)]
        probes = [p for p in probes if low < p < high]
        if not probes:
            break
        given = cells.agg(*[F.sum(seats(F.lit(p))) for p in probes]).first()
        if blocks in list(given):
            return seats(F.lit(probes[list(given).index(blocks)]))
        for p, g in zip(probes, given):
            if g > blocks:
                low = p
            else:
                high, under = p, g
                break
    # equal quotients: the first sources and shards get the blocks that are left
    tied = seats(F.lit(low)) > seats(F.lit(high))
    last = (
        cells.filter(tied).orderBy("number", "shard").limit(blocks - under)
        .agg(F.max(F.struct("number", "shard")).alias("x")).first()["x"]
    )
    if last is None:
        return seats(F.lit(high))
    served = (F.col("number") < last["number"]) | (
        (F.col("number") == last["number"]) & (F.col("shard") <= last["shard"])
    )
    return seats(F.lit(high)) + (tied & served).cast("bigint")


def _plan(sizes: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Sources with targets, quotas per shard, and the words of a block."""
    sources = staged(targets(sizes), "targets")
    total, least = sources.agg(
        F.sum("target"), F.min(F.when(F.col("target") > 0, F.col("target")))
    ).first()
    block = 1
    while least and 2 * block <= min(MOST_BLOCK, least / LEAST_BLOCKS):
        block *= 2
    share = F.col("target") * F.col("shard_size") / F.col("source_size")
    cells = staged(
        _dealt(sizes, sources)
        .groupBy("skey", "number", "shard", "source_size", F.col("target"))
        .agg(F.sum("size").alias("shard_size"))
        .select("skey", "number", "shard", "shard_size", F.when(F.col("shard_size") > 0, share).otherwise(0.0).alias("target")),
        "shards",
    )
    blocks = math.floor((total or 0) / block + 0.5)
    quota = _quotas(cells, blocks) if blocks else F.lit(0).cast("bigint")
    size = F.col("shard_size")
    words = F.least(quota * block, size * EPOCHS)
    passes = F.when(size > 0, F.floor(words / size)).otherwise(F.lit(0).cast("bigint"))
    drawn = F.xxhash64(F.lit(SEED + 1), "skey", "shard")
    steps = F.array(*[F.lit(s).cast("bigint") for s in _STEPS])
    plan = cells.select(
        "skey", "shard", "shard_size", passes.alias("passes"), quota.alias("quota"),
        F.ceil(size / block).cast("bigint").alias("n_blocks"),
        F.floor((words - passes * size) / block + 0.5).alias("chosen"),
        F.get(steps, F.pmod(drawn, F.lit(len(_STEPS))).cast("int")).alias("step"),
        F.pmod(F.shiftrightunsigned(drawn, 8), F.greatest(F.ceil(size / block), F.lit(1))).alias("first"),
    )
    return sources, staged(plan, "plan"), block


def _dealt(rows: DataFrame, sources: DataFrame) -> DataFrame:
    described = rows.drop("source").join(
        sources.select("skey", "source", "number", "source_size", "target", "n_shards"), "skey"
    )
    return described.withColumn("shard", F.pmod("draw", "n_shards"))


def _is_chosen(number: Column) -> Column:
    """Whether the block of that number is one of the shard's chosen ones."""
    n = F.greatest(F.col("n_blocks"), F.lit(1))
    return F.pmod(F.pmod(F.col("step"), n) * number + F.col("first"), n) < F.col("chosen")


def _laid_out(rows: DataFrame, plan: tuple[DataFrame, DataFrame, int]) -> DataFrame:
    """``rows`` with their place in the shard and the shard's part of the plan."""
    sources, shards, block = plan
    order = Window.partitionBy("skey", "shard").orderBy("draw", "doc_id")
    placed = _dealt(rows, sources).withColumn(
        "start", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    )
    stop = F.col("start") + F.col("size")
    extra = F.aggregate(
        F.sequence(F.floor(F.col("start") / block), F.floor((stop - 1) / block)),
        F.lit(0).cast("bigint"),
        lambda n, b: n + F.when(
            _is_chosen(b), F.least(stop, (b + 1) * block) - F.greatest(F.col("start"), b * block)
        ).otherwise(F.lit(0).cast("bigint")),
    )
    return placed.join(shards, ["skey", "shard"]).withColumn(
        "extra", F.when(F.col("size") > 0, extra).otherwise(F.lit(0).cast("bigint"))
    )


def quotas(docs: DataFrame) -> DataFrame:
    """doc_id, size, source, source_size, target and taken of every row of ``docs``.

    A null text has size 0; a null source is a source of its own, the last one.
    Documents of size 0 take nothing. Equal rows are laid one after another, so each
    gets its own share. An empty table gives no rows.
    """
    sizes = staged(_rows(docs), "sizes")
    plan = _plan(sizes)
    return _laid_out(sizes, plan).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("passes") * F.col("size") + F.col("extra")).cast("bigint").alias("taken"),
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The mix as documents: a row for every pass over a text, and one of its chosen words.

    Columns are those of ``docs``; n_chars, where there is one, follows the text.
    """
    plan = _plan(staged(_rows(docs), "sizes"))
    block = plan[2]
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    laid = _laid_out(_rows(docs, whole), plan)
    copies = F.col("passes").cast("int") + F.when(F.col("extra") > 0, 1).otherwise(0)
    part = F.array_join(
        F.filter(
            F.regexp_extract_all(F.col("doc.text"), F.lit(WORD), F.lit(0)),
            lambda w, i: _is_chosen(F.floor((F.col("start") + i) / block)),
        ),
        " ",
    )
    some = laid.filter("size > 0").withColumn(
        "copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>")))
    )
    text = F.when(F.col("copy") <= F.col("passes"), F.col("doc.text")).when(
        F.col("extra") == F.col("size"), F.col("doc.text")
    ).otherwise(part)
    out = some.select("doc", text.alias("mixed_text"))
    columns = []
    for field in docs.schema.fields:
        value = F.col("doc").getField(field.name)
        if field.name == "text":
            value = F.col("mixed_text")
        elif field.name == "n_chars":
            value = F.length("mixed_text").cast(field.dataType)
        columns.append(value.alias(field.name))
    return out.select(*columns)

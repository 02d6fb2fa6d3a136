"""Hard negatives by exact integer products in a residue number system.

Vectors become integers. Their products are taken modulo several small primes, as
float32 matrix products of centred residues whose sums stay below 2^24 and so are
exact; Chinese remaindering, digit by digit, gives the signed scores back. How many
primes are needed follows from the longest vector (no score is above its squared
length).

Rows are dealt to blocks; every block meets the anchors, which stream by in sorted
order behind the block's rows, so a task holds one block and a few anchors. Per anchor
a block gives its few best rows. A first pass finds the positives, a second one, which
then knows the windows of scores, the negatives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lifetrace.session import staged

SCALE = 256
ANCHORS_EVERY = 100
RELABELLED_EVERY, LABELS = 7, 10
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH, OF = 3, 9, 10  # a negative's score is from 3 / 10 to 9 / 10 of the positive's
BLOCK_ROWS = 1 << 17
LEAST_BLOCKS = 32
LIMIT = 1 << 56  # squared lengths, so that no multiple of a score leaves 64 bits
INNER = 64  # columns summed before a reduction
LARGEST_PRIME = 1021  # INNER * ((p - 1) / 2)^2 + p stays below 2^24
_TILE = 1 << 22  # scores held at once


def primes_for(bound: int) -> list[int]:
    """Primes from LARGEST_PRIME down whose product is over four times ``bound``."""
    out, product, p = [], 1, LARGEST_PRIME
    while product <= 4 * (bound + 2 * LARGEST_PRIME):
        if all(p % d for d in range(2, int(p**0.5) + 1)):
            out.append(p)
            product *= p
        p -= 1
    return out


def residues(rows: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """Centred residues of an integer matrix, one float32 matrix per prime."""
    return [((rows + p // 2) % p - p // 2).astype(np.float32) for p in primes]


def _reduced(x: np.ndarray, p: int) -> np.ndarray:
    x -= np.rint(x * np.float32(1 / p)) * np.float32(p)
    return x


def scores(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact products of all rows of ``left`` with all rows of ``right`` (their residues)."""
    digits: list[np.ndarray] = []
    for i, p in enumerate(primes):
        a, b = left[i], right[i]
        t = np.zeros((len(a), len(b)), np.float32)
        for lo in range(0, a.shape[1], INNER):
            t += a[:, lo : lo + INNER] @ b[:, lo : lo + INNER].T
            t = _reduced(t, p)
        # the number in mixed radix: subtract every digit found, divide by its prime
        for q, digit in zip(primes, digits):
            inverse = pow(q, -1, p)
            t = _reduced((t - digit) * np.float32(inverse if inverse <= p // 2 else inverse - p), p)
        digits.append(t)
    out = digits[-1].astype(np.int64)
    for q, digit in zip(primes[-2::-1], digits[-2::-1]):
        out = out * q + digit.astype(np.int64)
    return out


def _best(values: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest values, the first of equal ones; in no order."""
    if len(values) <= k:
        return np.arange(len(values))
    least = np.partition(values, len(values) - k)[len(values) - k]
    above = np.flatnonzero(values > least)
    return np.concatenate([above, np.flatnonzero(values == least)[: k - len(above)]])


def usable(rows: DataFrame) -> DataFrame:
    """(row, vec_id, label, parts, square) of the rows that take part, written.

    Out are rows with a null vec_id, label or vector, with a null or non-finite
    component, and with a squared integer length of 2^56 or more, whose scores no long
    could hold in all sums.
    """
    whole = F.transform("embedding", lambda x: F.floor(SCALE * x.cast("double")).cast("double"))
    fine = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    label = F.when(F.col("vec_id") % RELABELLED_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    kept = (
        rows.select("vec_id", "label", "embedding")
        .filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
        .filter(fine)
        .select("vec_id", label.alias("label"), whole.alias("whole"))
        .withColumn("square", F.aggregate("whole", F.lit(0.0), lambda s, x: s + x * x))
        .filter(F.col("square") < float(LIMIT))
    )
    return staged(
        kept.select(
            F.monotonically_increasing_id().alias("row"), "vec_id", F.col("label").cast("int").alias("label"),
            F.col("whole").cast("array<int>").alias("parts"), "square",
        ),
        "vectors",
    )


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """The vectors as a matrix; shorter ones end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.values.slice(column.offsets[0].as_py(), int(sizes.sum())).to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


class _Block:
    """The rows of one block, in the order of vec_id."""

    def __init__(self, pieces: list[tuple], primes: list[int]):
        self.row, self.vec_id, self.label, parts = (np.concatenate(x) for x in zip(*pieces))
        self.rest = residues(parts, primes)
        self.size = len(self.row)
        self.by_label = {x: np.flatnonzero(self.label == x) for x in np.unique(self.label).tolist()}

    def positives(self, anchors: dict, primes: list[int]):
        """(anchor, place) of the best rows of an anchor's label, without itself."""
        for label in np.unique(anchors["label"]).tolist():
            here = self.by_label.get(label)
            if here is None:
                continue
            own = np.flatnonzero(anchors["label"] == label)
            right = [r[here] for r in self.rest]
            tile = max(1, _TILE // len(here))
            for lo in range(0, len(own), tile):
                part = own[lo : lo + tile]
                found = scores([r[part] for r in anchors["rest"]], right, primes)
                for i, values in zip(part.tolist(), found):
                    others = self.row[here] != anchors["row"][i]
                    place = _best(values[others], POSITIVES)
                    yield i, here[others][place], values[others][place]

    def negatives(self, anchors: dict, primes: list[int]):
        """(anchor, place) of the best rows of other labels in any window of an anchor."""
        tile = max(1, _TILE // self.size)
        for lo in range(0, len(anchors["row"]), tile):
            found = scores([r[lo : lo + tile] for r in anchors["rest"]], self.rest, primes)
            for i, values in enumerate(found, lo):
                windows = [(-(-LOW * p // OF), HIGH * p // OF) for p in set(anchors["wanted"][i]) if p >= 0]
                if not windows:
                    continue
                inside = (values >= min(w[0] for w in windows)) & (values <= max(w[1] for w in windows))
                near = np.flatnonzero(inside & (self.label != anchors["label"][i]))
                places = set()
                for least, most in windows:
                    fit = near[(values[near] >= least) & (values[near] <= most)]
                    places.update(fit[_best(values[fit], NEGATIVES)].tolist())
                place = np.array(sorted(places), np.int64)
                yield i, place, values[place]


def _met(table: DataFrame, anchors: DataFrame, blocks: int, width: int, primes: list[int], find: str) -> DataFrame:
    """(anchor, vec_id, score): for every anchor the best rows of each block.

    ``anchors`` has row, vec_id, label, parts and wanted (scores of its positives).
    """
    names = ["block", "kind", "row", "vec_id", "label", "parts", "wanted"]
    rows = table.select(
        F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"),
        "row", "vec_id", "label", "parts", F.lit(None).cast("array<bigint>").alias("wanted"),
    )
    streams = anchors.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"),
        "row", "vec_id", "label", "parts", "wanted",
    )

    def run(batches):
        number, pieces, block = None, [], None
        for batch in batches:
            key = batch.column("block").to_numpy().astype(np.int64) * 2 + batch.column("kind").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]]).tolist()
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                columns = [part.column(c).to_numpy() for c in ("row", "vec_id", "label")] + [_matrix(part.column("parts"), width)]
                if number != key[lo] // 2:
                    number, pieces, block = key[lo] // 2, [], None
                if key[lo] % 2 == 0:
                    pieces.append(tuple(columns))
                    continue
                if not pieces:
                    continue
                block = block or _Block(pieces, primes)
                met = dict(zip(("row", "vec_id", "label"), columns)) | {
                    "rest": residues(columns[3], primes), "wanted": part.column("wanted").to_pylist(),
                }
                out = list(getattr(block, find)(met, primes))
                if out:
                    sizes = [len(p) for _, p, _ in out]
                    place = np.concatenate([p for _, p, _ in out]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(met["row"][[i for i, _, _ in out]], sizes)),
                            pa.array(block.vec_id[place]), pa.array(np.concatenate([s for *_, s in out])),
                        ],
                        ["anchor", "vec_id", "score"],
                    )

    dealt = rows.unionByName(streams).repartition(blocks, "block").sortWithinPartitions("block", "kind", "vec_id", "row")
    return dealt.select(*names).mapInArrow(run, "anchor bigint, vec_id bigint, score bigint")


def mined(rows: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has vec_id, label and embedding; which rows take part says ``usable``.
    Vectors of different lengths are compared as if the shorter ended in zeros. A
    repeated row is another row: it can be its copy's positive, and repeated anchors
    give repeated rows. Rows of one vec_id and score are interchangeable. An anchor
    without another row of its label gives nothing; so do an empty table and windows of
    positives below zero. Further columns are not looked at.
    """
    table = usable(rows)
    seen = table.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("parts")).alias("width"), F.max("square").alias("square")).first()
    width, blocks = max(1, seen["width"] or 0), max(LEAST_BLOCKS, -(-seen["n"] // BLOCK_ROWS))
    primes = primes_for(int(seen["square"] or 0) + 1)
    anchors = table.filter(F.col("vec_id") % ANCHORS_EVERY == 0)

    nothing = F.lit(None).cast("array<bigint>").alias("wanted")
    first = _met(table, anchors.select("*", nothing), blocks, width, primes, "positives")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id")
    positives = staged(
        first.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= POSITIVES), "positives"
    )
    wanted = positives.groupBy("anchor").agg(F.collect_list("score").alias("wanted"))
    with_windows = staged(anchors.join(wanted, F.col("row") == F.col("anchor")).drop("anchor"), "anchors")
    second = _met(table, with_windows, blocks, width, primes, "negatives")

    named = positives.join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor").select(
        "anchor", "anchor_id", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    pairs = second.select("anchor", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, "anchor")
    inside = (LOW * F.col("positive_score") <= OF * F.col("negative_score")) & (
        OF * F.col("negative_score") <= HIGH * F.col("positive_score")
    )
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    return (
        pairs.filter(inside).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= NEGATIVES)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )

"""Document quality from random-indexing word vectors and a small network.

Every word has a fixed sparse random index vector. Its context vector is the sum of the
index vectors of its neighbours, over all occurrences in all documents, in a table with a
row per word (by 63 bits of a hash), whatever the number of words. A second vector stands for the word's outline (case, last signs, repetition of the word before). A
document is the weighted mean of the context vectors of its words, and of its outlines;
a two-layer network over that gives a score, whose temperature is fitted apart.

The vectors are learnt from all documents: partial sums of a task, shuffled by word. The
``KEPT`` most frequent words are looked up in every task; the others are joined to their
documents by word. Which way a word takes changes no result. The network is fitted on at most ``LABELLED`` labelled rows, chosen by hash of the doc_id.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lifetrace.llm import network
from lifetrace.llm.common import as_bytes, slices
from lifetrace.session import staged

DIMENSION = 48
KEPT = 1 << 18
OUTLINES = 1 << 10
REACH = 2  # neighbours on each side
LABELLED = 20_000
FOLDS = 5
THRESHOLD = 0.3
_REMEMBERED = 250_000
_BYTES = 1 << 18  # text that is worked on at once, so that its vectors stay in the cache
_FREQUENT = 1e-3  # words of this share of the corpus count half

#: Signs of an outline: capitals, letters (and all beyond ASCII), digits, the rest itself.
_OUTLINE = bytes(
    88 if 65 <= c <= 90 else 120 if 97 <= c <= 122 or c > 127 else 48 if 48 <= c <= 57 else c for c in range(256)
)


def index_vectors(keys: np.ndarray) -> np.ndarray:
    """Four signs in each row, the rest zero; the same everywhere."""
    table = np.zeros((len(keys), DIMENSION), np.float32)
    for k in range(4):
        table[np.arange(len(keys)), (keys >> (15 * k) & 0x7FFF) % DIMENSION] = 1 if k % 2 else -1
    return table


def _key(word: bytes) -> int:
    """Of a word; below OUTLINES are the keys of outlines."""
    return max(OUTLINES, int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little") >> 1)


def outline_vectors() -> np.ndarray:
    return index_vectors(np.array([_key(b"outline %d" % k) for k in range(OUTLINES)]))


class _Terms(dict):
    """word -> number, remembered for a bounded number of words, with keys and outlines."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.clear()
        self._keys, self._outlines = [], []
        self.keys, self.outlines = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        shape = word.translate(_OUTLINE)
        self._keys.append(_key(word))
        self._outlines.append(zlib.crc32(shape[:1] + b" " + shape[-3:]) % (OUTLINES // 2))
        value = self[word] = len(self)
        return value

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers, outlines, and where documents begin."""
        words = [(t or b"").split() for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        code = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
        if self._keys:
            self.keys = np.concatenate([self.keys, np.array(self._keys, np.int64)])
            self.outlines = np.concatenate([self.outlines, np.array(self._outlines, np.int64)])
            self._keys, self._outlines = [], []
        starts = np.concatenate([[0], np.cumsum(sizes)])
        again = np.zeros(len(code), bool)
        again[1:] = code[1:] == code[:-1]
        again[starts[:-1][sizes > 0]] = False
        return code, self.outlines[code] + again * (OUTLINES // 2), starts


_SUMS = "key bigint, n bigint, v binary"


def _grown(table: np.ndarray, n: int) -> np.ndarray:
    if n <= len(table):
        return table
    return np.concatenate([table, np.zeros((max(n, 2 * len(table)) - len(table), *table.shape[1:]), table.dtype)])


def _rows(keys: np.ndarray, counts: np.ndarray, sums: np.ndarray):
    """Batches of _SUMS; a sum is written in the fewest bytes that hold it."""
    for lo in range(0, len(keys), 1 << 14):
        part = sums[lo : lo + (1 << 14)].astype(np.int64)
        most, out = np.abs(part).max(axis=1), [b""] * len(part)
        for least, top, kind in ((-1, 127, np.int8), (127, 2**31 - 1, np.int32), (2**31 - 1, 2**63 - 1, np.int64)):
            at = np.flatnonzero((most > least) & (most <= top))
            data, size = part[at].astype(kind).tobytes(), DIMENSION * np.dtype(kind).itemsize
            for i, k in enumerate(at.tolist()):
                out[k] = data[i * size : (i + 1) * size]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[lo : lo + len(part)]), pa.array(counts[lo : lo + len(part)]), pa.array(out, pa.binary())], ["key", "n", "v"]
        )


def _sums(column) -> np.ndarray:
    """The sums that ``_rows`` wrote."""
    rows = column.to_pylist()
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    out = np.zeros((len(rows), DIMENSION), np.int64)
    for kind in (np.int8, np.int32, np.int64):
        at = np.flatnonzero(sizes == DIMENSION * np.dtype(kind).itemsize)
        out[at] = np.frombuffer(b"".join([rows[i] for i in at.tolist()]), kind).reshape(-1, DIMENSION)
    return out


def context_vectors(docs: DataFrame) -> DataFrame:
    """(key, n, v): count and summed context vector of every word, and of every outline."""

    def parts(batches):
        terms, outer = _Terms(), outline_vectors()
        index, sums, counts = np.zeros((0, DIMENSION), np.float32), np.zeros((0, DIMENSION), np.int32), np.zeros(0, np.int64)
        outline_sums, outline_counts = np.zeros((OUTLINES, DIMENSION), np.int64), np.zeros(OUTLINES, np.int64)
        known = 0
        for batch in slices(batches, "text", _BYTES):
            if len(terms) > _REMEMBERED:
                yield from _rows(terms.keys, counts[:known], sums[:known])
                terms.forget()
                sums[:], counts[:], known = 0, 0, 0
            word, outline, starts = terms.of(as_bytes(batch.column("text")))
            if not len(word):
                continue
            n = len(terms)
            index, sums, counts = _grown(index, n), _grown(sums, n), _grown(counts, n)
            index[known:n], known = index_vectors(terms.keys[known:]), n
            doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            own = index[word] + outer[outline]
            around = np.zeros_like(own)
            for shift in range(1, REACH + 1):
                around[shift:] += own[:-shift]
                around[:-shift] += own[shift:]
                apart = np.flatnonzero(doc[shift:] != doc[:-shift]) + shift  # not neighbours after all
                around[apart] -= own[apart - shift]
                around[apart - shift] -= own[apart]
            for rows, to, seen in ((word.astype(np.int32), sums, counts), (outline.astype(np.uint16), outline_sums, outline_counts)):
                order = np.argsort(rows, kind="stable")
                ordered = rows[order]
                first = np.flatnonzero(np.diff(ordered.astype(np.int64), prepend=-1))
                to[ordered[first]] += np.add.reduceat(around[order], first, axis=0).astype(to.dtype)
                seen[ordered[first]] += np.diff(first, append=len(ordered))
        yield from _rows(terms.keys, counts[:known], sums[:known])
        there = np.flatnonzero(outline_counts)
        yield from _rows(there, outline_counts[there], outline_sums[there])

    def total(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, counts, sums = batch.column("key").to_numpy(), batch.column("n").to_numpy(), _sums(batch.column("v"))
            if held:
                keys, counts, sums = (np.concatenate(x) for x in zip(held, (keys, counts, sums)))
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            keys, counts, sums = keys[first], np.add.reduceat(counts, first), np.add.reduceat(sums, first, axis=0)
            held = keys[-1:], counts[-1:], sums[-1:]
            yield from _rows(keys[:-1], counts[:-1], sums[:-1])
        if held:
            yield from _rows(*held)

    partial = docs.select("text").mapInArrow(parts, _SUMS)
    return staged(partial.repartition("key").sortWithinPartitions("key").mapInArrow(total, _SUMS), "words")


def word_vectors(sums: np.ndarray, counts: np.ndarray, total: int) -> np.ndarray:
    """Context vectors of length 1, times the weight of the word: frequent ones count less."""
    length = np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return sums / length * (_FREQUENT / (_FREQUENT + counts / max(1, total)))[:, None]


def features(docs: DataFrame, kept: int | None = None) -> DataFrame:
    """(doc_id, x) of every row: the mean vectors of its words and of its outlines, and its
    length. A text without words is a row of zeros. To the driver come the ``kept`` most
    frequent words and the outlines, whatever the size of ``docs``."""
    spark = docs.sparkSession
    table = context_vectors(docs)
    words = table.filter(F.col("key") >= OUTLINES)
    n_words = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = words.orderBy(F.desc("n"), "key").limit(KEPT if kept is None else kept).toArrow().sort_by("key")
    outer = table.filter(F.col("key") < OUTLINES).toArrow()
    outlines = np.zeros((OUTLINES + 1, DIMENSION))
    outlines[outer.column("key").to_numpy()] = word_vectors(_sums(outer.column("v")), np.zeros(outer.num_rows), 1)
    keys = often.column("key").to_numpy()
    vectors = word_vectors(_sums(often.column("v")), often.column("n").to_numpy(), n_words)
    vectors = np.concatenate([vectors, np.zeros((1, DIMENSION))]).astype(np.float32)  # the last: not among them
    shared = spark.sparkContext.broadcast((keys, vectors, outlines.astype(np.float32)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def known(batches):
        keys, vectors, outlines = shared.value
        terms, place, part, row = _Terms(), np.zeros(0, np.int64), TaskContext.get().partitionId() << 40, 0
        for batch in slices(batches, "text", _BYTES):
            if len(terms) > _REMEMBERED:
                terms.forget()
                place = place[:0]
            word, outline, starts = terms.of(as_bytes(batch.column("text")))
            new = terms.keys[len(place) :]
            if len(new):
                at = np.searchsorted(keys, new)
                found = at < len(keys)
                found[found] = keys[at[found]] == new[found]
                place = np.concatenate([place, np.where(found, at, len(keys))])
            sizes = np.diff(starts)
            full = np.flatnonzero(sizes)
            x = np.zeros((len(sizes), 2 * DIMENSION), np.float32)
            own = place[word]
            if len(full):
                for to, rows, vs in ((0, own, vectors), (DIMENSION, outline, outlines)):
                    x[full, to : to + DIMENSION] = np.add.reduceat(vs[rows], starts[full], axis=0)
            rare = own == len(keys)
            bounds = np.concatenate([[0], np.cumsum(rare)])[starts]
            data, size = x.tobytes(), 8 * DIMENSION
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part + row + np.arange(len(sizes))), batch.column("doc_id"), pa.array(sizes),
                    pa.array([data[i : i + size] for i in range(0, len(data), size)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(terms.keys[word[rare]])),
                ],
                ["row", "doc_id", "n", "v", "rare"],
            )
            row += len(sizes)

    def met(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            row, key, n = (batch.column(c).to_numpy() for c in ("row", "key", "n"))
            head, x = key < 0, np.zeros((len(row), 2 * DIMENSION))
            v = batch.column("v")
            x[head] = np.frombuffer(b"".join(v.filter(pa.array(head)).to_pylist()), np.float32).reshape(-1, 2 * DIMENSION)
            x[~head, :DIMENSION] = word_vectors(_sums(v.filter(pa.array(~head))), n[~head], n_words)
            first = np.flatnonzero(np.diff(row, prepend=-1))
            # the first row of a document has its id and its length
            ids, row, sizes, x = batch.column("doc_id").take(pa.array(first)).to_pylist(), row[first], n[first], np.add.reduceat(x, first, axis=0)
            if held:
                if held[0] == row[0]:
                    x[0] += held[3]
                    ids[0], sizes[0] = held[1], held[2]
                else:
                    yield done([held[1]], np.array([held[2]]), held[3][None])
            held = row[-1], ids[-1], sizes[-1], x[-1].copy()
            yield done(ids[:-1], sizes[:-1], x[:-1])
        if held:
            yield done([held[1]], np.array([held[2]]), held[3][None])

    id_type = to_arrow_type(docs.schema["doc_id"].dataType)

    def done(ids, sizes, x):
        out = np.concatenate([x / np.maximum(sizes, 1)[:, None], np.log1p(sizes)[:, None]], axis=1).astype(np.float32)
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array([r.tobytes() for r in out], pa.binary())], ["doc_id", "x"])

    pooled = staged(
        docs.select("doc_id", "text").mapInArrow(known, f"row bigint, doc_id {kind}, n bigint, v binary, rare array<bigint>"), "pooled"
    )
    asked = pooled.select("row", F.explode("rare").alias("key"))
    answers = asked.join(words, "key").select("row", "key", "n", "v", F.lit(None).cast(kind).alias("doc_id"))
    both = pooled.select("row", F.lit(-1).cast("bigint").alias("key"), "n", "v", "doc_id").unionByName(answers)
    return staged(both.repartition("row").sortWithinPartitions("row", "key").mapInArrow(met, f"doc_id {kind}, x binary"), "features")


def _fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS))


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, 2 * DIMENSION + 1).astype(float)


def fitted(found: DataFrame, labels: DataFrame) -> network.Network:
    """The network, from labelled rows of ``features`` outside the held-out fold; another fold
    sets the temperature. Null labels are left out; several labels of a document are averaged."""
    known = (
        labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(_fold(F.col("doc_id")) != 0)
        .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    )
    chosen = found.join(F.broadcast(known), "doc_id")  # at most LABELLED rows
    rows = chosen.select(_fold(F.col("doc_id")).cast("int").alias("fold"), "label", "x").orderBy("fold", "label", "x").toArrow()
    y = rows.column("label").to_numpy().astype(float)
    x = _matrix(rows.column("x"))
    apart = rows.column("fold").to_numpy() == 1
    return network.calibrate(network.train(x[~apart], y[~apart]), x[apart], y[apart])


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Nothing but the text enters a score. Null and empty texts get the score of a text
    without words; a null doc_id is not held out; repeated rows stay repeated; without
    labels every score is one half; an empty table gives no rows.
    """
    found = features(docs)
    shared = docs.sparkSession.sparkContext.broadcast(fitted(found, labels))

    def run(batches):
        model = shared.value
        for batch in batches:
            score = model.probability(_matrix(batch.column("x")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score)], ["doc_id", "held_out", "score"]
            )

    rows = found.select("doc_id", F.coalesce(_fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "x")
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))

"""Alignment of the tokens of two tokenizers by divide and conquer at shared cuts.

Both tokenizers cut the same bytes. Where a token of each ends at the same byte, the
text can be cut for both. An interval between two cuts is searched from its middle
outwards for a further common end, each candidate by bisection in the other
tokenizer's ends; it is split there and both halves are searched in the same way. An
interval without a common end inside is a leaf: one group of tokens that belong
together. All open intervals of a batch of texts take their step at once, in numpy.

Token ids and cuts are written to a table, a bit per token for the cuts, so that texts
are tokenized once. The number of documents that hold an id pair linked is a partial
aggregate over that table. Reading it again, a task looks pairs up in a broadcast
table of the most frequent ones, of bounded size; the others are joined.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lifetrace.llm.common import slices
from lifetrace.llm.tokenids import Pieces, tokenizer_path
from lifetrace.session import staged

BYTE_LEVEL = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
SPACE = "▁"  # stands for a blank in the pieces of B
_BITS = 21  # of an id; two ids and the number of a text in its batch fit in 63 bits
KEPT = 1 << 21  # pairs that are broadcast with their counts, 32 MB
_STEPS = 8  # classes of counts per power of two, to find the counts to keep
_HELD = 1 << 22  # distinct pairs a task holds before it sends their counts
WIDE = 1 << 16  # links from which on a group's pairs are taken once per distinct pair
LONG = 400  # characters in a run from which on a text is encoded whole
_LONG = re.compile(rf"[^ ]{{{LONG}}}|\s{{{LONG}}}")
_BATCH = 3 << 18  # bytes of text that a task works on at once; its arrays are many times that
_IDS = 1 << 19  # bytes of ids of A, the same


def _pieces(batches, column: str, most: int):
    """``slices``; between them Arrow gives back the memory it holds but does not use, which
    for two tasks beside the JVM is a good part of what an executor may take."""
    for piece in slices(batches, column, most):
        yield piece
        pa.default_memory_pool().release_unused()


def common_ends(a: np.ndarray, b: np.ndarray, a_doc: np.ndarray, b_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of A and of B end where one of the other ends too.

    ``a`` and ``b`` are the ends of all tokens, ascending over all texts; ``a_doc`` and
    ``b_doc`` say where the tokens of every text begin, and the last one's where they
    end. Both have the same end for the last token of a text.
    """
    cut_a, cut_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    filled = a_doc[1:] > a_doc[:-1]
    cut_a[a_doc[1:][filled] - 1] = True
    cut_b[b_doc[1:][filled] - 1] = True
    # candidates inside the intervals: [lo, hi) of A and [blo, bhi) of B
    lo, hi = a_doc[:-1][filled], a_doc[1:][filled] - 1
    blo, bhi = b_doc[:-1][filled], b_doc[1:][filled] - 1
    step = np.zeros(len(lo), np.int64)
    while True:
        mid = (lo + hi) >> 1
        reach = np.maximum(mid - lo, hi - 1 - mid)
        going = (lo < hi) & (blo < bhi) & ((step + 1) >> 1 <= reach)
        if not going.all():
            lo, hi, blo, bhi, step, mid = (x[going] for x in (lo, hi, blo, bhi, step, mid))
        if not len(lo):
            return cut_a, cut_b
        # mid, mid + 1, mid - 1, mid + 2, ...
        probe = mid + np.where(step & 1, (step + 1) >> 1, -(step >> 1))
        inside = (probe >= lo) & (probe < hi)
        at = a[np.where(inside, probe, lo)]
        spot = np.searchsorted(b, at)
        hit = inside & (spot < bhi) & (b[np.minimum(spot, len(b) - 1)] == at)
        cut_a[probe[hit]] = True
        cut_b[spot[hit]] = True
        # a hit leaves its left and right half, in order: bisection likes neighbours
        of = np.repeat(np.arange(len(lo)), 1 + hit)
        split = hit[of]
        right = split & np.concatenate([[False], of[1:] == of[:-1]])
        left = split & ~right
        p, q = probe[of], spot[of]
        lo, hi = np.where(right, p + 1, lo[of]), np.where(left, p, hi[of])
        blo, bhi = np.where(right, q + 1, blo[of]), np.where(left, q, bhi[of])
        step = np.where(split, 0, step[of] + 1)


def byte_level_bytes(tokenizer) -> list[bytes]:
    """Bytes of every entry of a byte-level vocabulary.

    The printable bytes of Latin-1 stand for themselves there, the others, in order,
    for the signs from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    sign = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    entries = (tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size()))
    return [bytes(sign[c] for c in e) if set(e) <= sign.keys() else e.encode() for e in entries]


def piece_bytes(model) -> list[bytes]:
    """Bytes of every entry of a piece model."""
    return [
        bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(SPACE, " ").encode()
        for i in range(model.get_piece_size())
    ]


class _Both:
    """Both tokenizers over lists of texts, with the bytes of their tokens.

    Neither merges across a blank that stands alone between two other characters, so
    texts are cut before such blanks and each distinct part is encoded once, behind a
    blank. Texts where white space meets a blank, or that begin or end with one, and
    those with runs of LONG characters are encoded whole.

    A runs in ``tiktoken`` on the entries of its file (an id is the rank of its merge);
    what has long runs goes through the library of the file, whose time stays linear.
    """

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(byte_level), sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.a.encode_special_tokens = True
        tables = byte_level_bytes(self.a), piece_bytes(self.b)
        special = set(self.a.get_added_tokens_decoder())
        ranks = {t: i for i, t in enumerate(tables[0]) if i not in special}
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [pa.array(t, pa.large_binary()) for t in tables]
        self.lengths = [np.array([len(x) for x in t], np.int64) for t in tables]

    def _a(self, parts: list[str], whole: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A for parts, all in one go, and for whole texts; and their numbers."""
        ids, sizes = [], []
        if parts:
            ids.append(np.array(self.fast.encode_ordinary(" " + " ".join(parts)), np.int32))
            ends = np.cumsum([len(p.encode()) + 1 for p in parts])
            sizes.append(np.diff(np.searchsorted(np.cumsum(self.lengths[0][ids[0]]), ends, "right"), prepend=0))
        for text in whole:
            if _LONG.search(text):
                found = self.a.encode(" " + text, add_special_tokens=False).ids
            else:
                found = self.fast.encode_ordinary(" " + text)
            ids.append(np.array(found, np.int32))
            sizes.append([len(found)])
        none = np.zeros(0, np.int64)
        return np.concatenate([none.astype(np.int32), *ids]), np.concatenate([none, *sizes]).astype(np.int64)

    def _b(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.b.encode(texts, num_threads=1) if texts else []
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())), sizes

    def __call__(self, texts: list[str]):
        """(ids, where each text begins and ends) of A and of B; nothing for texts that
        are empty or do not come out of both again."""
        column = pa.array(texts, pa.large_string())
        whole = pc.or_(
            pc.match_substring_regex(column, f"{Pieces._WHITE} | {Pieces._WHITE}|[^ ]{{{LONG}}}"),
            pc.or_(pc.starts_with(column, " "), pc.ends_with(column, " ")),
        ).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(column.filter(pa.array(~whole)), " ")
        words = split.flatten().dictionary_encode()
        parts, alone = words.dictionary.to_pylist(), [t for t, one in zip(texts, whole.tolist()) if one]
        counts = np.ones(len(texts), np.int64)
        counts[~whole] = np.diff(split.offsets.to_numpy())
        edge = np.concatenate([[0], np.cumsum(counts)])
        which = np.zeros(edge[-1], np.int64)
        cut = np.repeat(~whole, counts)
        which[cut] = words.indices.to_numpy()
        which[~cut] = len(parts) + np.arange(len(alone))

        data = [t.encode() for t in texts]
        good = np.array([bool(t) for t in data], bool)
        sides = []
        for (ids, sizes), table, lengths in zip((self._a(parts, alone), self._b(parts + alone)), self.bytes, self.lengths):
            size = sizes[which]
            total = np.concatenate([[0], np.cumsum(size)])
            ids = ids[np.repeat((np.cumsum(sizes) - sizes)[which] - total[:-1], size) + np.arange(total[-1])]
            ends = total[edge]
            sides.append((ids, ends))
            at = np.concatenate([[0], np.cumsum(lengths[ids])])[ends]
            joined = memoryview(table.take(pa.array(ids)).buffers()[2] or b"").cast("B")
            for i, text in enumerate(data):
                if good[i]:
                    good[i] = at[i + 1] - at[i] == len(text) + 1 and joined[at[i] : at[i + 1]] == b" " + text
        if good.all():
            return sides
        return [
            (ids[np.repeat(good, np.diff(ends))], np.concatenate([[0], np.cumsum(np.where(good, np.diff(ends), 0))]))
            for ids, ends in sides
        ]


_KEPT_BOTH: dict[tuple[str, str], _Both] = {}


def _both(paths: tuple[str, str]) -> _Both:
    """The tokenizers of a worker, loaded once."""
    if paths not in _KEPT_BOTH:
        _KEPT_BOTH[paths] = _Both(*paths)
    return _KEPT_BOTH[paths]


def aligned(docs: DataFrame, byte_level: str | None = None, pieces: str | None = None) -> DataFrame:
    """(row, doc_id, a_ids, b_ids, a_cuts, b_cuts) for every row of ``docs``, written.

    Ids are little-endian unsigned 32-bit integers; cuts are bits, first token first,
    set where a group ends (``groups`` reads them). A is the byte-level tokenizer on a
    blank and the text, B the piece model on the text; strings of special tokens are
    plain text. A null or empty text, and one that the tokens' bytes do not give back,
    has no tokens. ``row`` numbers rows; repeated rows stay rows of their own. Paths
    must hold on every executor.
    """
    paths = byte_level or tokenizer_path(BYTE_LEVEL), pieces or tokenizer_path(PIECES)
    schema = T.StructType(
        [T.StructField("row", T.LongType()), docs.select("doc_id").schema["doc_id"],
         *[T.StructField(c, T.BinaryType()) for c in ("a_ids", "b_ids", "a_cuts", "b_cuts")]]
    )

    def run(batches):
        both = _both(paths)
        row = TaskContext.get().partitionId() << 33
        for batch in _pieces(batches, "text", _BATCH):
            (a, a_doc), (b, b_doc) = both([t or "" for t in batch.column("text").to_pylist()])
            cut_a, cut_b = common_ends(np.cumsum(both.lengths[0][a]), np.cumsum(both.lengths[1][b]), a_doc, b_doc)
            columns = []
            for values, doc in ((a.astype("<u4"), a_doc), (b.astype("<u4"), b_doc)):
                columns.append(pa.array([values[i:j].tobytes() for i, j in zip(doc, doc[1:])], pa.binary()))
            for cuts, doc in ((cut_a, a_doc), (cut_b, b_doc)):
                columns.append(pa.array([np.packbits(cuts[i:j]).tobytes() for i, j in zip(doc, doc[1:])], pa.binary()))
            numbers = pa.array(np.arange(row, row + batch.num_rows))
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([numbers, batch.column("doc_id"), *columns], schema.names)

    return staged(docs.select("doc_id", "text").mapInArrow(run, schema), "aligned")


class _Groups:
    """The groups of a batch of rows of the table ``aligned``."""

    def __init__(self, batch: pa.RecordBatch):
        self.ids, self.doc, self.cut = [], [], []
        for ids, cuts in (("a_ids", "a_cuts"), ("b_ids", "b_cuts")):
            data = batch.column(ids).to_pylist()
            sizes = [len(x) // 4 for x in data]
            bits = [np.unpackbits(np.frombuffer(c, np.uint8), count=n) for c, n in zip(batch.column(cuts).to_pylist(), sizes)]
            self.ids.append(np.frombuffer(b"".join(data), "<u4").astype(np.int64))
            self.doc.append(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]))
            self.cut.append(np.concatenate([np.zeros(0, np.uint8), *bits]).astype(bool))
        self.rows = batch.num_rows
        # per group: where its tokens of A and of B begin, one more for the end
        self.start = [np.concatenate([[0], np.flatnonzero(c) + 1]) for c in self.cut]
        self.size = [np.diff(s) for s in self.start]
        before = [np.concatenate([[0], np.cumsum(c)]) for c in self.cut]
        self.wide = self.size[0] * self.size[1] > WIDE
        self.doc_group = before[0][self.doc[0]]  # groups before every row
        self.group = [x[:-1] for x in before]  # of every token

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, A id and B id of all token pairs that share a group, but for wide ones."""
        (a, b), (ga, _) = self.ids, self.group
        times = np.where(self.wide[ga], 0, self.size[1][ga])
        total = np.cumsum(times)
        within = np.arange(total[-1] if len(total) else 0) - np.repeat(total - times, times)
        other = np.repeat(self.start[1][:-1][ga], times) + within
        row = np.repeat(np.arange(self.rows), np.diff(self.doc[0]))
        return np.repeat(row, times), np.repeat(a, times), b[other]

    def wide_links(self):
        """Row, key and number of links of the distinct id pairs of every wide group."""
        for g in np.flatnonzero(self.wide):
            (ua, ca), (ub, cb) = (
                np.unique(ids[s[g] : s[g + 1]], return_counts=True) for ids, s in zip(self.ids, self.start)
            )
            row = np.searchsorted(self.doc_group, g, "right") - 1
            yield row, ((ua << _BITS)[:, None] | ub).reshape(-1), (ca[:, None] * cb).reshape(-1)

    def per_row(self, of_group: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(of_group)])
        return np.diff(total[self.doc_group])

    def written(self) -> pa.Array:
        """``a1,a2|b1;a3|b2,b3``: every id with the sign behind it, in order."""
        n = [len(x) for x in self.ids]
        order = np.zeros(sum(n), np.int64)
        sign = [np.where(self.cut[0], 1, 0), np.where(self.cut[1], 2, 0)]
        last = self.doc[1][1:][np.diff(self.doc[1]) > 0] - 1
        sign[1][last] = 3
        coded = [s * (1 << _BITS) + i for s, i in zip(sign, self.ids)]
        order[np.arange(n[0]) + self.start[1][:-1][self.group[0]]] = coded[0]
        order[np.arange(n[1]) + self.start[0][1:][self.group[1]]] = coded[1]
        return order


def _signs(entries: int) -> pa.Array:
    return pa.array([f"{i}{s}".encode() for s in (",", "|", ";", "") for i in range(entries)], pa.large_binary())


def _distinct(groups: _Groups) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, id pair and number of links, once per row and pair."""
    row, a, b = groups.links()
    keys, times = np.unique((row << 2 * _BITS) | (a << _BITS) | b, return_counts=True)
    for row, pairs, n in groups.wide_links():
        more = np.concatenate([keys, (row << 2 * _BITS) | pairs])
        keys, place = np.unique(more, return_inverse=True)
        merged = np.zeros(len(keys), np.int64)
        np.add.at(merged, place, np.concatenate([times, n]))
        times = merged
    return keys >> 2 * _BITS, keys & ((1 << 2 * _BITS) - 1), times


def pair_counts(table: DataFrame) -> DataFrame:
    """(pair, n): how many rows of ``aligned`` hold the pair of ids linked, written.

    ``pair`` is the id of A shifted left by 21 bits, plus that of B.
    """

    def count(batches):
        held, size = [], 0

        def summed():
            pairs = np.concatenate([p for p, _ in held])
            which, place = np.unique(pairs, return_inverse=True)
            return which, np.bincount(place, np.concatenate([n for _, n in held]), len(which)).astype(np.int64)

        def sent(which, n):
            for lo in range(0, len(which), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(which[part]), pa.array(n[part])], ["pair", "n"])

        for batch in _pieces(batches, "a_ids", _IDS):
            _, pairs, _ = _distinct(_Groups(batch))
            which, n = np.unique(pairs, return_counts=True)
            held.append((which, n.astype(np.int64)))
            size += len(which)
            if size > 2 * _HELD:
                held = [summed()]
                size = len(held[0][0])
                if size > _HELD:
                    yield from sent(*held[0])
                    held, size = [], 0
        if held:
            yield from sent(*summed())

    slim = table.select("a_ids", "b_ids", "a_cuts", "b_cuts").mapInArrow(count, "pair bigint, n bigint")
    return staged(slim.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")


def _frequent(counts: DataFrame) -> tuple[DataFrame, bool]:
    """The pairs that are broadcast, at most KEPT, and whether that is all of them."""
    step = F.floor(F.log2(F.col("n").cast("double")) * _STEPS)
    held, least = 0, None
    for size, low in sorted(
        ((r["c"], r["low"]) for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("low")).collect()),
        key=lambda r: -r[1],
    ):
        if held + size > KEPT:
            return counts.filter(F.col("n") >= (least if least is not None else (1 << 62))), False
        held, least = held + size, low
    return counts, True


_DIGEST = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def digest(table: DataFrame) -> DataFrame:
    """Per row of ``aligned``: doc_id, counts of tokens, groups and links, the sum of the
    links' counts, how many links have the highest count of their A id, and the hash."""
    spark = table.sparkSession
    counts = pair_counts(table)
    frequent, is_all = _frequent(counts)
    top = frequent.toPandas().sort_values("pair")
    best = counts.groupBy(F.shiftright("pair", _BITS).alias("a")).agg(F.max("n").alias("n")).toPandas()  # one per A id
    highest = np.zeros(int(best["a"].max()) + 1 if len(best) else 1, np.int64)
    highest[best["a"].to_numpy(np.int64)] = best["n"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast((top["pair"].to_numpy(np.int64), top["n"].to_numpy(np.int64), highest))
    schema = T.StructType(
        [*table.select("row", "doc_id").schema.fields, *[T.StructField(c, T.LongType()) for c in _DIGEST],
         T.StructField("groups_sha256", T.StringType()),
         T.StructField("rare", T.ArrayType(T.StructType([T.StructField("pair", T.LongType()), T.StructField("times", T.LongType())])))]
    )

    def run(batches):
        known, n, highest = shared.value
        signs = None
        for batch in _pieces(batches, "a_ids", _IDS):
            groups = _Groups(batch)
            if signs is None or max((int(x.max()) for x in groups.ids if len(x)), default=0) >= len(signs) // 4:
                entries = max(1 << 16, *(int(x.max()) + 1 for x in groups.ids if len(x))) if len(groups.ids[0]) else 1 << 16
                signs = _signs(entries)
            order = groups.written()
            place = (order >> _BITS) * (len(signs) // 4) + (order & ((1 << _BITS) - 1))
            text = signs.take(pa.array(place))
            data = memoryview(text.buffers()[2] or b"")
            ends = np.frombuffer(text.buffers()[1] or bytes(8), np.int64)[: len(place) + 1][groups.doc[0] + groups.doc[1]]
            hashes = [hashlib.sha256(data[i:j]).hexdigest() if j > i else "" for i, j in zip(ends, ends[1:])]

            row, pair, times = _distinct(groups)
            spot = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
            found = known[spot] == pair if len(known) else np.zeros(len(pair), bool)
            count = np.where(found, n[spot], 0) if len(known) else np.zeros(len(pair), np.int64)
            is_best = found & (count == highest[np.minimum(pair >> _BITS, len(highest) - 1)])
            total = lambda v: _sums(row, v, groups.rows)
            rare_rows = row[~found]
            rare = pa.StructArray.from_arrays([pa.array(pair[~found]), pa.array(times[~found].astype(np.int64))], ["pair", "times"])
            at = np.searchsorted(rare_rows, np.arange(groups.rows + 1)).astype(np.int32)
            columns = [
                np.diff(groups.doc[0]), np.diff(groups.doc[1]), np.diff(groups.doc_group),
                groups.per_row(groups.size[0] * groups.size[1]), total(times * is_best), total(times * count),
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), *[pa.array(c.astype(np.int64)) for c in columns],
                 pa.array(hashes, pa.string()), pa.ListArray.from_arrays(pa.array(at), rare)],
                schema.names,
            )

    found = table.mapInArrow(run, schema)
    if is_all:
        return found.drop("row", "rare")
    found = staged(found, "aligned-digest")
    highest_of = F.broadcast(spark.createDataFrame(best[["a", "n"]].rename(columns={"n": "highest"}), "a bigint, highest bigint"))
    # the broadcast pairs are complete, so only the others' counts are needed here
    rest = (
        found.select("row", F.inline("rare")).join(counts, "pair")
        .join(highest_of, F.shiftright("pair", _BITS) == F.col("a"))
        .groupBy("row").agg(
            F.sum(F.when(F.col("n") == F.col("highest"), F.col("times")).otherwise(0)).alias("more_best"),
            F.sum(F.col("times") * F.col("n")).alias("more_sum"),
        )
    )
    return found.drop("rare").join(rest, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )


def _sums(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """Exact sums per row; rows ascend."""
    total = np.concatenate([[0], np.cumsum(value.astype(np.int64))])
    return np.diff(total[np.searchsorted(row, np.arange(rows + 1))])


def groups(table: DataFrame) -> DataFrame:
    """The groups themselves: (row, doc_id, number, a_ids, b_ids), numbered from 0."""
    schema = T.StructType(
        [*table.select("row", "doc_id").schema.fields, T.StructField("number", T.LongType()),
         *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("a_ids", "b_ids")]]
    )

    def run(batches):
        for batch in _pieces(batches, "a_ids", _IDS):
            found = _Groups(batch)
            per_row = np.diff(found.doc_group)
            of = pa.array(np.repeat(np.arange(found.rows), per_row))
            number = np.arange(len(found.size[0])) - np.repeat(found.doc_group[:-1], per_row)
            lists = [pa.ListArray.from_arrays(pa.array(s.astype(np.int32)), pa.array(i)) for s, i in zip(found.start, found.ids)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(of), batch.column("doc_id").take(of), pa.array(number), *lists], schema.names
            )

    return table.mapInArrow(run, schema)


def report(docs: DataFrame, byte_level: str | None = None, pieces: str | None = None) -> DataFrame:
    """``digest`` of the alignment of ``docs`` (doc_id, text); one row per row.

    Rows without tokens have zeros and an empty string. Counts are over all rows, so a
    repeated row counts again. An empty table gives no rows; further columns are not
    looked at.
    """
    return digest(aligned(docs, byte_level, pieces))

"""Token ids of whole texts in a binary format of compressed blocks.

Rows are range-partitioned by doc_id, so the partitions in order hold the documents in
ascending order. A task tokenizes its rows and writes segments: a table of documents
(doc_id, number of ids) and one coded stream (``coder``). A segment is a row of a
Parquet table, so Spark's commit protocol decides what counts as written and a lost
task is simply run again. Readers decode segment by segment; where a segment begins
is a running sum over the segments' sizes.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lifetrace.llm import coder
from lifetrace.llm.common import slices
from lifetrace.session import staged

END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
SEGMENT_IDS = coder.BLOCK * coder.LANES
#: Pieces of text whose ids a task remembers at once.
REMEMBERED = 400_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """Ids of whole texts; equal pieces of text are encoded once.

    A byte-level BPE never merges across a blank that stands alone between two other
    characters, so a text is cut before such blanks, the tokenizers library encodes
    every distinct piece, and the ids are put together. A text where white space
    meets a blank, or that starts or ends with one, is encoded in one piece.
    """

    #: White space of Unicode, and the separators that some libraries count as such.
    _WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

    def __init__(self, path: str, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # as the library does it, the string of a special token is that token's id;
        # without ``special`` it is ordinary text
        self.tokenizer.encode_special_tokens = not special
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}  # of pieces behind a blank
        self.ids, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not pieces:
            return self.ids[:0], self.sizes[:0]
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        ids = [np.array(e.ids, np.int32) for e in found]
        return np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids))

    def _encode_lines(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_encode``, for pieces behind a blank without a line break: the library
        gets many at once as lines, and a line break stays an id of its own."""
        breaks = self.tokenizer.encode("a\n b", add_special_tokens=False).ids[1]
        ids, sizes = [], []
        parts = [pieces[lo : lo + 100] for lo in range(0, len(pieces), 100)]
        lines = self._encode([" " + "\n ".join(part) for part in parts])
        for part, line in zip(parts, np.split(lines[0], np.cumsum(lines[1])[:-1])):
            at = np.flatnonzero(line == breaks)
            if len(at) == len(part) - 1:
                own, size = np.delete(line, at), np.diff(at, prepend=-1, append=len(line)) - 1
            else:
                own, size = self._encode([" " + p for p in part])
            ids.append(own)
            sizes.append(size)
        if not ids:
            return self.ids[:0], self.sizes[:0]
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, pieces: list[str]) -> None:
        plain, odd = [], []
        for p in pieces:
            (odd if not p or "\n" in p or p[-1].isspace() else plain).append(p)
        self.number.update(zip(plain + odd, range(len(self.sizes), len(self.sizes) + len(pieces))))
        parts = [self._encode_lines(plain), self._encode([" " + p for p in odd])]
        self.ids = np.concatenate([self.ids, *(ids for ids, _ in parts)])
        self.sizes = np.concatenate([self.sizes, *(sizes for _, sizes in parts)])

    def _whole(self, column: pa.Array) -> np.ndarray:
        """Texts that must stay in one piece."""
        met = pc.or_(
            pc.match_substring_regex(column, f"{self._WHITE} | {self._WHITE}"),
            pc.or_(pc.starts_with(column, " "), pc.ends_with(column, " ")),
        )
        return met.to_numpy(zero_copy_only=False)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of every text."""
        if not texts:
            return self.ids[:0], self.sizes[:0]
        if len(self.number) > REMEMBERED:
            self._forget()
        column = pa.array(texts, pa.large_string())
        whole = self._whole(column)
        split = pc.split_pattern(column.filter(pa.array(~whole)), " ")
        words, bounds = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
        is_first = np.zeros(len(words), bool)
        is_first[bounds[:-1]] = True
        later = words.filter(pa.array(~is_first)).dictionary_encode()
        kinds = later.dictionary.to_pylist()
        self._learn([k for k in kinds if k not in self.number])
        numbers = np.fromiter(map(self.number.__getitem__, kinds), np.int64, len(kinds))

        first = iter(words.filter(pa.array(is_first)).to_pylist())
        heads = [t if one else next(first) for t, one in zip(texts, whole.tolist())]
        head_ids, head_sizes = self._encode(heads)
        ids, sizes = np.concatenate([self.ids, head_ids]), np.concatenate([self.sizes, head_sizes])
        begins = np.cumsum(sizes) - sizes
        counts = np.ones(len(texts), np.int64)
        counts[~whole] = np.diff(bounds)
        edge = np.concatenate([[0], np.cumsum(counts)])
        pieces = np.zeros(edge[-1], np.int64)
        behind = np.ones(edge[-1], bool)
        behind[edge[:-1]] = False
        pieces[edge[:-1]] = len(self.sizes) + np.arange(len(texts))
        pieces[behind] = numbers[later.indices.to_numpy()]
        size = sizes[pieces]
        total = np.concatenate([[0], np.cumsum(size)])
        found = ids[np.repeat(begins[pieces] - total[:-1], size) + np.arange(total[-1])]
        return found, np.diff(total[edge])


_SEGMENTS = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("sizes", T.ArrayType(T.LongType())),
        T.StructField("stream", T.BinaryType()),
    ]
)


def write(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """The written segments of ``docs`` (doc_id, text), in ascending doc_id order.

    The strings of special tokens in a text give their ids, as the library has it by
    default. A null text is an empty one and gives the end id only. Null doc_ids come first;
    rows of one doc_id follow the hash of their text. ``tokenizer`` is a path on
    every executor.
    """
    path = tokenizer or tokenizer_path()
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_ids", T.ArrayType(id_type)) if f.name == "doc_ids" else f for f in _SEGMENTS])

    def run(batches):
        encode = Pieces(path, special=True)
        part = TaskContext.get().partitionId()
        seq, doc_ids, sizes, ids, held = 0, [], [], [], 0

        def segment():
            stream = b"".join(_streams(np.concatenate(ids)))
            kind = pa.list_(schema_type)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([held], pa.int64()),
                    pa.array([doc_ids], kind), pa.array([sizes], pa.list_(pa.int64())), pa.array([stream], pa.binary()),
                ],
                _SEGMENTS.names,
            )

        for batch in slices(batches, "text", 2 << 20):
            schema_type = batch.column("doc_id").type
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found, counts = encode(texts)
            ends = np.cumsum(counts)
            found = np.insert(found, ends, end_id)
            doc_ids += batch.column("doc_id").to_pylist()
            sizes += (counts + 1).tolist()
            ids.append(found)
            held += len(found)
            if held >= SEGMENT_IDS * 3 // 4:
                yield segment()
                seq, doc_ids, sizes, ids, held = seq + 1, [], [], [], 0
        if doc_ids:
            yield segment()

    keyed = docs.select("doc_id", "text").withColumn("_tie", F.xxhash64("text"))
    ranged = keyed.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    return staged(ranged.select("doc_id", "text").mapInArrow(run, schema), "segments")


def _streams(ids: np.ndarray):
    """Coded streams of at most SEGMENT_IDS ids each, every one behind its length."""
    for lo in range(0, max(1, len(ids)), SEGMENT_IDS):
        stream = coder.encode(ids[lo : lo + SEGMENT_IDS])
        yield len(stream).to_bytes(8, "little") + stream


def ids_of(streams: bytes) -> np.ndarray:
    out, at = [], 0
    while at < len(streams):
        size = int.from_bytes(streams[at : at + 8], "little")
        out.append(coder.decode(streams[at + 8 : at + 8 + size]))
        at += 8 + size
    return np.concatenate(out)


def documents(segments: DataFrame) -> DataFrame:
    """Every document as the segments hold it: (doc_id, part, seq, at, n_tokens, ids_crc32)."""
    id_type = segments.schema["doc_ids"].dataType.elementType
    schema = T.StructType(
        [T.StructField("doc_id", id_type), T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType())]
        + [T.StructField(n, T.LongType()) for n in ("at", "n_tokens", "ids_crc32")]
    )

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                sizes = row.column("sizes")[0].values.to_numpy()
                data = memoryview(ids_of(row.column("stream")[0].as_py()).astype("<u4").tobytes())
                ends = np.cumsum(sizes)
                at = ends - sizes
                sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at.tolist(), ends.tolist())]
                same = lambda c: pa.array(np.full(len(sizes), row.column(c)[0].as_py(), np.int32))
                yield pa.RecordBatch.from_arrays(
                    [row.column("doc_ids")[0].values, same("part"), same("seq"), pa.array(at), pa.array(sizes), pa.array(sums, pa.int64())],
                    schema.names,
                )

    return segments.select("part", "seq", "doc_ids", "sizes", "stream").mapInArrow(run, schema)


def digest(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 per document, read back from the segments."""
    sizes = segments.select("part", "seq", "n_ids")
    # one row per partition of the write, and inside it one per segment
    whole = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_part"))
    ahead = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = whole.select("part", ahead("n_part").alias("part_start"))
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = staged(
        sizes.select("part", "seq", ahead("n_ids").alias("seq_start")).join(parts, "part")
        .select("part", "seq", (F.col("part_start") + F.col("seq_start")).alias("base")),
        "starts",
    )
    return documents(segments).join(starts, ["part", "seq"]).select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def encoded(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` and read them back; an empty table gives no rows."""
    return digest(write(docs, tokenizer))

"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by document: a task cuts its documents into segments of
about a million words, and a segment row holds, for the terms of the test items,
their postings (positions of the words in the segment, ascending) beside a table of
its documents. Words outside the test vocabulary keep their position but need no
posting, no query can ask for them. The segments are written to a table once.

Term counts of the whole corpus are summed from it and order the terms of every
window from rarest to commonest. A phrase is found by taking the postings of its
rarest term, shifted by the term's offset, and intersecting them with the shifted
postings of the next rarest until all terms are used or nothing is left. A
proximity match needs the three rarest terms of an item within ``NEAR`` words of
the rarest of them, in any order.

Everything after the one scan of the texts is local to a segment: no posting is
shuffled, and a passage that a third of all documents share is spread like them.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lifetrace.llm.common import as_bytes, free_names, slices
from lifetrace.session import staged

WINDOW = 13
NEAR = 26
SEGMENT_WORDS = 1 << 20
#: Text of test items that is sent to every task at once; more is done in rounds.
ROUND_BYTES = 32 << 20

#: Lower case for A-Z; digits, letters and everything beyond ASCII stay; else a blank.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32
    for c in range(256)
)
_NOTHING = hashlib.sha256(b"").hexdigest()


def words_of(text: bytes | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a UTF-8 text, A-Z lower-cased."""
    return (text or b"").translate(_FOLD).split()


class Queries:
    """Test items as distinct windows of term numbers."""

    def __init__(self, items: list[tuple[str, bytes]]):
        self.vocabulary: dict[bytes, int] = {}
        number = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary))
        windows: dict[tuple, set[int]] = {}
        self.names: list[str] = []
        self.item_terms: list[np.ndarray] = []
        for name, text in items:
            terms = [number(w) for w in words_of(text)]
            if not terms:
                continue
            self.names.append(name)
            self.item_terms.append(np.unique(terms))
            for i in range(max(1, len(terms) - WINDOW + 1)):
                windows.setdefault(tuple(terms[i : i + WINDOW]), set()).add(len(self.names) - 1)
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.terms = np.full((len(windows), WINDOW), -1, np.int64)
        for row, window in zip(self.terms, windows):
            row[: len(window)] = window
        self.items = [np.array(sorted(s)) for s in windows.values()]

    def rank(self, counts: np.ndarray) -> None:
        """Order the terms of windows and items by their corpus counts, rarest first."""
        weight = np.append(counts, np.iinfo(np.int64).max)  # -1 (no term) sorts last
        self.order = np.argsort(weight[self.terms], axis=1, kind="stable")
        # a term that no document has is in no proximity to anything; a single term that is
        # left of several says nothing
        there = [t[counts[t] > 0] for t in self.item_terms]
        self.rarest = [
            t[np.argsort(counts[t], kind="stable")][: 3 if len(t) > 1 or len(own) == 1 else 0]
            for t, own in zip(there, self.item_terms)
        ]


def _index_row(docs: list, ids: np.ndarray, doc_type: pa.DataType) -> pa.RecordBatch:
    """One segment. Between documents one position is left free, so that no phrase
    runs from one into the next."""
    at = np.flatnonzero(ids >= 0).astype(np.int32)
    terms = ids[at]
    order = np.argsort(terms, kind="stable")
    present, first = np.unique(terms[order], return_index=True)
    one = lambda values, kind: pa.array([values], kind)
    return pa.RecordBatch.from_arrays(
        [
            one([d[0] for d in docs], pa.list_(doc_type)),
            one([d[1] for d in docs], pa.list_(pa.int64())),
            one([d[2] for d in docs], pa.list_(pa.int64())),
            one(present.astype(np.int32), pa.list_(pa.int32())),
            one(np.diff(np.append(first, len(at))).astype(np.int32), pa.list_(pa.int32())),
            one(at[order].tobytes(), pa.binary()),
        ],
        ["doc_ids", "keys", "n_words", "terms", "counts", "postings"],
    )


def build_index(docs: DataFrame, queries: Queries) -> DataFrame:
    """The written index of ``docs`` (doc_id, key, text), one row per segment."""
    shared = docs.sparkSession.sparkContext.broadcast(queries.vocabulary)
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("doc_ids", T.ArrayType(id_type)),
            T.StructField("keys", T.ArrayType(T.LongType())),
            T.StructField("n_words", T.ArrayType(T.LongType())),
            T.StructField("terms", T.ArrayType(T.IntegerType())),
            T.StructField("counts", T.ArrayType(T.IntegerType())),
            T.StructField("postings", T.BinaryType()),
        ]
    )

    def run(batches):
        number = shared.value.get
        docs, parts, held = [], [], 0
        gap = np.array([-1], np.int32)
        for batch in slices(batches, "text", 32 << 20):
            kind = batch.column("doc_id").type
            rows = zip(
                batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(),
                as_bytes(batch.column("text")),
            )
            for doc_id, key, text in rows:
                words = words_of(text)
                parts += [np.fromiter(map(number, words, repeat(-1)), np.int32, len(words)), gap]
                docs.append((doc_id, key, len(words)))
                held += len(words) + 1
                if held >= SEGMENT_WORDS:
                    yield _index_row(docs, np.concatenate(parts), kind)
                    docs, parts, held = [], [], 0
        if docs:
            yield _index_row(docs, np.concatenate(parts), kind)

    return staged(docs.select("doc_id", "key", "text").mapInArrow(run, schema), "postings")


class Segment:
    def __init__(self, terms, counts, postings, n_words):
        at = np.frombuffer(postings, np.int32)
        ends = np.cumsum(counts)
        self.postings = {int(t): at[e - c : e] for t, c, e in zip(terms, counts, ends)}
        n_words = np.asarray(n_words, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(n_words + 1)])

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1

    def phrase(self, terms: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Positions where the whole phrase begins."""
        found = None
        for k in order:
            if terms[k] < 0:
                break
            list_ = self.postings[int(terms[k])]
            if found is None:
                found = list_ - np.int32(k)
                continue
            found = found[_in(found + np.int32(k), list_)]
            if not len(found):
                break
        return found

    def near(self, terms: np.ndarray) -> np.ndarray:
        """Documents where every term is within NEAR words of the first one."""
        if not len(terms) or any(int(t) not in self.postings for t in terms):
            return np.zeros(0, np.int64)
        at = self.postings[int(terms[0])]
        low = np.maximum(at - NEAR, self.starts[self.document(at)])
        high = np.minimum(at + NEAR, self.starts[self.document(at) + 1] - 2)
        for t in terms[1:]:
            other = self.postings[int(t)]
            keep = np.searchsorted(other, low) < np.searchsorted(other, high, "right")
            at, low, high = at[keep], low[keep], high[keep]
        return np.unique(self.document(at))


def _in(wanted: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    place = np.searchsorted(ascending, wanted)
    place[place == len(ascending)] = 0
    return ascending[place] == wanted


def search(index: DataFrame, queries: Queries) -> DataFrame:
    """Per document: hit word ranges and the items found as phrase or in proximity."""
    counts = (
        index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x"))
        .groupBy("x.terms").agg(F.sum("x.counts").alias("n")).collect()  # at most the vocabulary
    )
    total = np.zeros(len(queries.vocabulary), np.int64)
    for term, n in counts:
        total[term] = n
    queries.rank(total)
    shared = index.sparkSession.sparkContext.broadcast(queries)
    id_type = index.schema["doc_ids"].dataType.elementType
    spans = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("stop", T.LongType())]))
    schema = T.StructType(
        [
            T.StructField("doc_id", id_type), T.StructField("key", T.LongType()),
            T.StructField("n_words", T.LongType()), T.StructField("hits", spans),
            T.StructField("items", T.ArrayType(T.StringType())),
            T.StructField("near_items", T.ArrayType(T.StringType())),
        ]
    )

    def run(batches):
        q = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                yield from _search_segment(q, batch.slice(i, 1))

    def _search_segment(q, row):
        n_words = row.column("n_words")[0].values.to_numpy()
        terms = row.column("terms")[0].values.to_numpy()
        segment = Segment(terms, row.column("counts")[0].values.to_numpy(), row.column("postings")[0].as_py(), n_words)
        present = np.zeros(len(q.vocabulary) + 1, bool)
        present[-1] = True  # the filler of short windows
        present[terms] = True
        change = np.zeros(segment.starts[-1] + 1, np.int32)
        pairs = []
        for w in np.flatnonzero(present[q.terms].all(axis=1)):
            found = segment.phrase(q.terms[w], q.order[w])
            if not len(found):
                continue
            change[found] += 1
            change[found + q.lengths[w]] -= 1
            docs = np.unique(segment.document(found))
            pairs += [(d, item) for d in docs.tolist() for item in q.items[w].tolist()]
        edges = np.flatnonzero(np.diff(np.cumsum(change) > 0, prepend=False, append=False))
        first, stop = edges[::2], edges[1::2]
        hits: dict[int, list] = {}
        for d, a, b in zip(segment.document(first).tolist(), first.tolist(), stop.tolist()):
            base = int(segment.starts[d])
            hits.setdefault(d, []).append({"first": a - base, "stop": b - base})
        items: dict[int, set] = {}
        for d, item in set(pairs):
            items.setdefault(d, set()).add(q.names[item])
        near: dict[int, set] = {}
        for item, rarest in enumerate(q.rarest):
            for d in segment.near(rarest).tolist():
                near.setdefault(d, set()).add(q.names[item])
        n = len(n_words)
        yield pa.RecordBatch.from_arrays(
            [
                row.column("doc_ids")[0].values, row.column("keys")[0].values, pa.array(n_words),
                pa.array([hits.get(d, []) for d in range(n)], pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))),
                pa.array([sorted(items.get(d, ())) for d in range(n)], pa.list_(pa.string())),
                pa.array([sorted(near.get(d, ())) for d in range(n)], pa.list_(pa.string())),
            ],
            ["doc_id", "key", "n_words", "hits", "items", "near_items"],
        )

    return index.mapInArrow(run, schema)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Phrase and proximity matches of every row of ``docs``.

    Columns: doc_id, key (hash of the text), n_words, hits (disjoint word ranges),
    items and near_items (item ids as strings, sorted). Null texts have no words and
    no matches; items without words match nothing; a null item id is named ``null``;
    repeated rows and items of equal text each count. Test items beyond ROUND_BYTES
    are searched in rounds, whose ranges are merged.
    """
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "text")
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rounds = 1 + size // ROUND_BYTES
    found = []
    for r in range(rounds):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == r)
        queries = Queries([(i, t.encode("utf-8")) for i, t in mine.collect()])  # about ROUND_BYTES
        found.append(search(build_index(keyed, queries), queries))
    return found[0] if rounds == 1 else _merged(found)


def _merged(found: list[DataFrame]) -> DataFrame:
    """The rounds of one document together; a repeated row comes once per round."""
    table = found[0]
    for other in found[1:]:
        table = table.unionByName(other)
    sets = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    by_doc = staged(table, "rounds").groupBy("doc_id", "key").agg(
        F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_set("hits"))).alias("hits"),
        sets("items").alias("items"),
        sets("near_items").alias("near_items"),
        (F.count(F.lit(1)) / len(found)).cast("int").alias("copies"),
    )
    grown = F.aggregate(
        "hits",
        F.expr("CAST(array() AS ARRAY<STRUCT<first: BIGINT, stop: BIGINT>>)"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["stop"] >= x["first"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(
                    F.element_at(done, -1)["first"].alias("first"),
                    F.greatest(F.element_at(done, -1)["stop"], x["stop"]).alias("stop"),
                )),
            ),
        ).otherwise(F.concat(done, F.array(x))),
    )
    return by_doc.withColumn("hits", grown).withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), "copies"))
    ).drop("copies", "_copy")


def report(found: DataFrame) -> DataFrame:
    """The contract's digest of ``matches``."""
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, x: n + x["stop"] - x["first"])
    return found.select(
        "doc_id", "key", "n_words", n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.size("near_items").cast("bigint").alias("n_near_items"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns kept."""
    doc_id, key, mark = free_names(docs, "_doc_id", "_key", "_mark")
    bad = staged(
        report(matches(docs, benchmark)).filter("contaminated")
        .select(F.col("doc_id").alias(doc_id), F.col("key").alias(key)).distinct(),
        "contaminated",
    )
    marked = docs.withColumn(mark, F.xxhash64(F.coalesce("text", F.lit(""))))
    same = marked["doc_id"].eqNullSafe(bad[doc_id]) & (marked[mark] == bad[key])
    return marked.join(bad, same, "left_anti").select(*docs.columns)

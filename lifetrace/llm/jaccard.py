"""Jaccard self-join of word-shingle sets by a grouped prefix join.

Shingles are put in one order for the whole corpus, rare ones first. If two sets have
a Jaccard similarity of at least ``NUM / DEN``, their first tokens in that order (the
prefix, about an eighth of the set) have one in common. So documents with the same
prefix and the same size are collapsed into one group, a group is posted under every
token of its prefix, and only groups that meet in a posting list, at fitting sizes and
positions, are expanded to their members and verified on the whole sets.

The order comes from a table of counters of fixed size: a shingle's rank is the order
of magnitude of its counter, then its hash. Any order gives right results; this one
keeps common passages out of the prefixes.

Results are classes, so a list is not turned into all its pairs: each round verifies
members against a few of those they share lists with (pivots) and joins what is
similar; then only pairs between different classes are left, and all of those that can
be links are verified.

Whether a pair can be a link is decided before any set is moved, by sketches: bit i
of a sketch is the parity of the tokens with remainder i, so that two sets differ in at
least as many tokens as their sketches differ in bits.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lifetrace.llm.common import as_bytes, slices
from lifetrace.llm.graph import components
from lifetrace.session import staged

SHINGLE = 4
NUM, DEN = 85, 100  # a link: DEN * intersection >= NUM * union
COUNTER_BITS = 22  # 4 million counters; their orders of magnitude take 4 MB
CHUNK = 1 << 12  # counters in a row of the table of counters, and words in one of a filter
FILTER_BITS = 27  # bits of the filters that find the texts to verify and shared tokens, 16 MB
PIVOTS = 4  # of a list, and partners of a set, in one round
ROUNDS = 3  # with pivots, at most; what they leave is verified pair by pair
GAIN = 8  # a round in which less than this part of the pairs are links is the last one with pivots
MOVED = 1 << 19  # set ids that are broadcast, at most, so that only their sets are moved
SKETCH = 512  # bits
CROWDED = 64  # entries of a list from which on sketches decide inside the join
_PIECE = 8 << 20  # bytes of a text whose words are held at once
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: Odd multipliers of the words of a shingle, and of the last mix.
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _word_hashes(text: bytes) -> np.ndarray:
    from xxhash import xxh3_64_digest as digest

    parts, at = [], 0
    while at < len(text):
        cut = _BLANK.search(text, at + _PIECE) if len(text) - at > _PIECE else None
        end = cut.start() if cut else len(text)
        words = text[at:end].lower().split()  # on bytes: A-Z only, and the six ASCII blanks
        parts.append(np.frombuffer(b"".join(map(digest, words)), np.uint64))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 4-word shingles of a UTF-8 text.

    Fewer words give the whole sequence as one, none an empty set. 64-bit hashes
    stand for the shingles: two that differ get one hash with probability 2^-63.
    """
    words = _word_hashes(text)
    if not len(words):
        return words
    if len(words) < SHINGLE:
        mixed = np.array([len(words)], np.uint64) * _MIX
        for i in range(len(words)):
            mixed += words[i : i + 1] * _FACTORS[i]
    else:
        n = len(words) - SHINGLE + 1
        mixed = np.zeros(n, np.uint64)
        for i in range(SHINGLE):
            mixed += words[i : i + n] * _FACTORS[i]
    mixed ^= mixed >> np.uint64(32)
    mixed *= _MIX
    mixed ^= mixed >> np.uint64(29)
    mixed.sort()
    return mixed[np.concatenate([[True], mixed[1:] != mixed[:-1]])]


def _sets(batches, column: str = "text"):
    """Pieces of batches with the shingle sets of their texts."""
    for batch in slices(batches, column, 16 << 20):
        yield batch, [shingle_set(t or b"") for t in as_bytes(batch.column(column))]


def _magnitudes(docs: DataFrame) -> np.ndarray:
    """Order of magnitude of every counter, over all documents.

    Tasks count all their shingles and send their counters in compressed chunks; the
    sums stay in the tasks that the chunks are dealt to, 4 MB come to the driver.
    """
    size = 1 << COUNTER_BITS
    shift = np.uint64(64 - COUNTER_BITS)

    def count(batches):
        seen = np.zeros(size, np.uint32)
        for _, sets in _sets(batches):
            cells = np.concatenate([np.zeros(0, np.uint64), *sets]) >> shift
            if len(cells) > size // 8:
                seen += np.bincount(cells.astype(np.int64), minlength=size).astype(np.uint32)
            elif len(cells):
                which, n = np.unique(cells.astype(np.int64), return_counts=True)
                seen[which] += n.astype(np.uint32)
        rows = seen.reshape(-1, CHUNK)
        for lo in range(0, len(rows), 64):
            used = [i for i in range(lo, min(lo + 64, len(rows))) if rows[i].any()]
            if used:
                packed = [pa.compress(rows[i].tobytes(), codec="zstd", asbytes=True) for i in used]
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(packed, pa.binary())], ["chunk", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, packed in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                raw = pa.decompress(packed, CHUNK * 4, codec="zstd", asbytes=True)
                held = sums.setdefault(chunk, np.zeros(CHUNK, np.int64))
                held += np.frombuffer(raw, np.uint32)
        if sums:
            found = [np.frexp(s.astype(np.float64))[1].astype(np.uint8).tobytes() for s in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(found, pa.binary())], ["chunk", "counts"])

    kind = "chunk int, counts binary"
    counted = docs.select("text").mapInArrow(count, kind).repartition("chunk").mapInArrow(add, kind)
    out = np.zeros((size // CHUNK, CHUNK), np.uint8)
    for row in counted.collect():
        out[row["chunk"]] = np.frombuffer(row["counts"], np.uint8)
    return out.reshape(-1)


def prefix_length(n: int) -> int:
    """How many first tokens two similar sets cannot miss each other in."""
    return n - -(-NUM * n // DEN) + 1


def _two_longs(data: bytes) -> tuple[int, int]:
    from xxhash import xxh3_128_digest

    both = np.frombuffer(xxh3_128_digest(data), np.int64)
    return int(both[0]), int(both[1])


def _text_hash(text: bytes | None) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(text or b"") - (1 << 63)


def _signed(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n (size of the set), digests of the set and of its group, and of
    the text, sketch, prefix."""
    spark = docs.sparkSession
    magnitudes = spark.sparkContext.broadcast(_magnitudes(docs))
    shift = np.uint64(64 - COUNTER_BITS)
    longs = ("n", "s1", "s2", "g1", "g2", "text_hash")
    schema = T.StructType(
        [docs.select("doc_id").schema["doc_id"], *[T.StructField(c, T.LongType()) for c in longs],
         *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("sketch", "prefix")]]
    )

    def run(batches):
        rank = magnitudes.value
        for batch, sets in _sets(batches):
            rows, prefixes = [], []
            sketches = np.zeros((len(sets), SKETCH), np.uint8)
            for i, s in enumerate(sets):
                sketches[i] = np.bincount((s & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
            words = np.packbits(sketches, axis=1).view(np.int64)
            for s, text in zip(sets, as_bytes(batch.column("text"))):
                order = (rank[(s >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (s >> np.uint64(6))
                order.sort()
                prefix = order[: prefix_length(len(s))] if len(s) else order
                group = prefix.tobytes() + len(s).to_bytes(8, "little")
                rows.append((len(s), *_two_longs(s.tobytes()), *_two_longs(group), _text_hash(text)))
                prefixes.append(prefix.view(np.int64))
            table = np.array(rows, np.int64).reshape(-1, 6)
            ends = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *prefixes])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(np.ascontiguousarray(table[:, i])) for i in range(6)],
                 pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * words.shape[1]), pa.array(words.reshape(-1))), lists],
                schema.names,
            )

    return staged(docs.select("doc_id", "text").mapInArrow(run, schema), "jaccard-signed")


def _fits(na: Column, pa_: Column, nb: Column, pb: Column) -> Column:
    """Whether sets of these sizes, met at these positions first, can still be similar."""
    longer, shorter = F.greatest(na, nb), F.least(na, nb)
    left = F.least(na - pa_, nb - pb)
    return (shorter * DEN >= longer * NUM) & (left * (NUM + DEN) >= (na + nb) * NUM)


def _close(na: Column, sketch_a: Column, nb: Column, sketch_b: Column) -> Column:
    """Whether sketches allow the sets to be similar."""
    differing = F.aggregate(F.zip_with(sketch_a, sketch_b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return differing * (NUM + DEN) <= (na + nb) * (DEN - NUM)


def _likely(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` that their sketches allow, written."""
    of = lambda x: sets.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    met = pairs.join(of("a"), "a").join(of("b"), "b")
    return staged(met.filter(_close(F.col("na"), F.col("sa"), F.col("nb"), F.col("sb"))).select("a", "b"), "jaccard-likely")


def _filter_of(keys: DataFrame) -> np.ndarray:
    """A bit for every value of ``key``, by its last FILTER_BITS bits. Tasks make the words
    that are dealt to them; to the driver come compressed chunks, 16 MB at most."""
    words = 1 << (FILTER_BITS - 6)

    def build(batches):
        held = np.zeros(words, np.uint64)
        for batch in batches:
            at = np.unique(batch.column("key").to_numpy() & ((1 << FILTER_BITS) - 1))
            if len(at):
                first = np.flatnonzero(np.diff(at >> 6, prepend=-1))
                held[at[first] >> 6] |= np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first)
        for lo in np.unique(np.flatnonzero(held) // CHUNK * CHUNK).tolist():
            packed = pa.compress(held[lo : lo + CHUNK].tobytes(), codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([lo], pa.int32()), pa.array([packed], pa.binary())], ["at", "bits"])

    chunk = F.shiftright(F.shiftright("key", 6).bitwiseAND(words - 1), CHUNK.bit_length() - 1)
    out = np.zeros(words, np.uint64)
    for row in keys.select("key").repartition(chunk).mapInArrow(build, "at int, bits binary").collect():
        part = out[row["at"] : row["at"] + CHUNK]
        part |= np.frombuffer(pa.decompress(row["bits"], part.nbytes, codec="zstd", asbytes=True), np.uint64)
    return out


def _vectors(docs: DataFrame, sets: DataFrame, ids: DataFrame) -> DataFrame:
    """(sid, tokens) of the sets ``ids``, hashed from their texts again.

    Of each set one text is looked for. A filter of fixed size over the hashes of those
    texts spares most others the work; the join after it is exact.
    """
    spark = docs.sparkSession
    wanted = staged(sets.join(ids, "sid").select("sid", "s1", "s2", "text_hash"), "jaccard-wanted")
    words = 1 << (FILTER_BITS - 6)
    filter_bits = spark.sparkContext.broadcast(_filter_of(wanted.select(F.col("text_hash").alias("key"))))

    def run(batches):
        bits, sent = filter_bits.value, set()
        for batch in slices(batches, "text", 16 << 20):
            out = []
            for text in as_bytes(batch.column("text")):
                key = _text_hash(text)
                if int(bits[(key >> 6) & (words - 1)]) >> (key & 63) & 1 and key not in sent:
                    sent.add(key)
                    tokens = shingle_set(text or b"")
                    out.append((*_two_longs(tokens.tobytes()), tokens))
            if out:
                ends = np.concatenate([[0], np.cumsum([len(s) for *_, s in out])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([s for *_, s in out]).view(np.int64)))
                firsts = [pa.array([row[i] for row in out], pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*firsts, lists], ["s1", "s2", "tokens"])

    hashed = docs.select("text").mapInArrow(run, "s1 bigint, s2 bigint, tokens array<bigint>")
    return staged(
        hashed.join(wanted, ["s1", "s2"]).groupBy("sid").agg(F.first("tokens").alias("tokens")), "jaccard-vectors"
    )


class _Verifier:
    """Verifies pairs on whole sets; a set is hashed again once, when it is needed first."""

    def __init__(self, docs: DataFrame, sets: DataFrame):
        self.docs, self.sets, self.vectors = docs, sets, None

    def _known(self, ids: DataFrame) -> DataFrame:
        """Vectors of the sets ``ids``, a written table; of others too where it is long."""
        if self.vectors is None:
            self.vectors = _vectors(self.docs, self.sets, ids)
            return self.vectors
        more = staged(ids.join(self.vectors.select("sid"), "sid", "left_anti"), "jaccard-more")
        if not more.isEmpty():
            self.vectors = self.vectors.union(_vectors(self.docs, self.sets, more))
        if ids.count() > MOVED:
            return self.vectors
        return self.vectors.join(F.broadcast(ids), "sid", "left_semi")

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """The links among ``pairs`` (a, b), a written table of set ids."""
        vectors = self._known(staged(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "jaccard-asked"))
        a = vectors.select(F.col("sid").alias("a"), F.col("tokens").alias("ta"))
        b = vectors.select(F.col("sid").alias("b"), F.col("tokens").alias("tb"))
        common = F.size(F.array_intersect("ta", "tb"))
        similar = common * (NUM + DEN) >= (F.size("ta") + F.size("tb")).cast("bigint") * NUM
        return staged(pairs.join(b, "b").join(a, "a").filter(similar).select("a", "b"), "jaccard-links")


def _posted(groups: DataFrame, shared: DataFrame) -> DataFrame:
    """(gid, n, pos, key) of the tokens ``shared`` in prefixes; a filter drops nearly all
    others before they are moved, the join after it is exact."""
    shared_bits = groups.sparkSession.sparkContext.broadcast(_filter_of(shared))

    def run(batches):
        bits = shared_bits.value
        for batch in batches:
            lists = batch.column("prefix")
            keys, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            found = np.flatnonzero(bits[(keys >> 6) & (len(bits) - 1)] >> (keys & 63).astype(np.uint64) & np.uint64(1))
            row = np.repeat(np.arange(len(sizes)), sizes)[found]
            pos = found - (np.cumsum(sizes) - sizes)[row]
            yield pa.RecordBatch.from_arrays(
                [batch.column("gid").take(pa.array(row)), batch.column("n").take(pa.array(row)), pa.array(pos, pa.int64()), pa.array(keys[found])],
                ["gid", "n", "pos", "key"],
            )

    tokens = groups.select("gid", "n", "prefix").mapInArrow(run, "gid bigint, n bigint, pos bigint, key bigint")
    return tokens.join(shared, "key")


def _lists(signed: DataFrame, sets: DataFrame) -> DataFrame:
    """Entries (kind, key, sid, n, pos): members of lists that two sets or more are in.

    Kind 0 are tokens, with the members of every group posted there; kind 1 are groups
    of several sets.
    """
    filled = signed.filter("n > 0")
    groups = staged(
        filled.groupBy("g1", "g2").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
        .withColumn("gid", F.monotonically_increasing_id()),
        "jaccard-groups",
    )
    members = staged(sets.join(groups.drop("n", "prefix"), ["g1", "g2"]).select("sid", "n", "gid"), "jaccard-members")
    counted = groups.select(F.explode("prefix").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    shared = staged(counted.filter("c > 1").select("key"), "jaccard-shared")
    met = staged(_posted(groups, shared), "jaccard-posted")
    by_token = met.join(members.select("gid", "sid"), "gid").select(F.lit(0).alias("kind"), "key", "sid", "n", "pos")
    several = members.groupBy("gid").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("gid")
    by_group = members.join(several, "gid").select(
        F.lit(1).alias("kind"), F.col("gid").alias("key"), "sid", "n", F.lit(0).cast("bigint").alias("pos")
    )
    return staged(by_token.union(by_group), "jaccard-lists")


def _open_lists(entries: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Entries with their class, of lists where more than one class is left."""
    if labels is None:
        labelled = entries.withColumn("class", F.col("sid"))
    else:
        entries = entries.drop("class", "size")
        labelled = staged(
            entries.join(labels, "sid", "left").select(*entries.columns, F.coalesce("label", "sid").alias("class")),
            "jaccard-labelled",
        )
    open_keys = labelled.groupBy("kind", "key").agg(
        F.min("class").alias("lo"), F.max("class").alias("hi"), F.count(F.lit(1)).alias("size")
    ).filter("lo < hi")
    return staged(labelled.join(open_keys.select("kind", "key", "size"), ["kind", "key"]), "jaccard-open")


def _hooked(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after every set took the least one among its links, or of the set it is named after.

    Sets of one label are connected; not all that are connected have one label yet.
    """
    both = links.union(links.select("b", "a")).toDF("sid", "other")
    old = both.select("sid").distinct().withColumn("label", F.col("sid"))
    if labels is not None:
        old = labels.unionByName(old.join(labels.select("sid"), "sid", "left_anti"))
    of_other = old.select(F.col("sid").alias("other"), F.col("label").alias("near"))
    near = both.join(of_other, "other").groupBy("sid").agg(F.min("near").alias("near"))
    hooked = staged(old.join(near, "sid", "left").select("sid", F.least("label", "near").alias("label")), "jaccard-hooked")
    of_label = hooked.select(F.col("sid").alias("label"), F.col("label").alias("further"))
    return staged(hooked.join(of_label, "label").select("sid", F.col("further").alias("label")), "jaccard-labels")


def _pivot_pairs(entries: DataFrame, turn: int) -> DataFrame:
    """Every set with the pivots, out of those of its lists, that it meets most often."""
    firsts = [
        F.min(F.struct(F.xxhash64(F.lit(turn * PIVOTS + i), "sid").alias("draw"), "sid", "n", "pos", "class"))
        for i in range(PIVOTS)
    ]
    drawn = entries.groupBy("kind", "key").agg(*[f.alias(f"p{i}") for i, f in enumerate(firsts)])
    inside = F.transform(F.array(*[f"p{i}" for i in range(PIVOTS)]), lambda p: p.dropFields("draw"))
    pivots = drawn.select("kind", "key", F.explode(F.array_distinct(inside)).alias("p"))
    met = (
        entries.join(pivots, ["kind", "key"])
        .filter(F.col("class") != F.col("p.class"))
        .filter(_fits(F.col("n"), F.col("pos"), F.col("p.n"), F.col("p.pos")))
        .groupBy("sid", F.col("p.sid").alias("pivot")).agg(F.count(F.lit(1)).alias("times"))
    )
    place = F.row_number().over(Window.partitionBy("sid").orderBy(F.desc("times"), "pivot"))
    best = met.withColumn("place", place).filter(F.col("place") <= PIVOTS)
    return best.select(F.least("sid", "pivot").alias("a"), F.greatest("sid", "pivot").alias("b")).distinct()


def _meet(a: DataFrame, b: DataFrame, more: Column) -> DataFrame:
    """Pairs of two sides of open lists that lengths, positions and ``more`` allow.

    Sizes meet by classes of size, so that a long list is not compared as a whole.
    """
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DEN / NUM)) + 1e-9)
    names = [c for c in a.columns if c not in ("kind", "key")]
    a = a.withColumn("step", step).select("kind", "key", "step", *[F.col(c).alias(f"{c}_a") for c in names])
    b = b.withColumn("own", step).select(
        "kind", "key", F.explode(F.array(F.col("own"), F.col("own") + 1, F.col("own") + 2)).alias("step"),
        *[F.col(c).alias(f"{c}_b") for c in names],
    )
    # b is the smaller one, or as large and of a lower class
    smaller = (F.col("n_b") < F.col("n_a")) | ((F.col("n_b") == F.col("n_a")) & (F.col("class_b") < F.col("class_a")))
    return (
        a.join(b, ["kind", "key", "step"])
        .filter(smaller & (F.col("class_a") != F.col("class_b")))
        .filter(_fits(F.col("n_a"), F.col("pos_a"), F.col("n_b"), F.col("pos_b")) & more)
        .select(F.least("sid_a", "sid_b").alias("a"), F.greatest("sid_a", "sid_b").alias("b"))
    )


def _cross_pairs(entries: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs between classes that can be links, written.

    A list with at most CROWDED entries gives its pairs; in a longer one entries
    carry their sketches, and only what those allow becomes a row.
    """
    cols = ["kind", "key", "sid", "n", "pos", "class"]
    short = entries.filter(F.col("size") <= CROWDED).select(*cols)
    pairs = _likely(sets, _meet(short, short, F.lit(True)).distinct())
    crowded = entries.filter(F.col("size") > CROWDED).select(*cols)
    if crowded.isEmpty():
        return pairs
    crowded = staged(crowded.join(sets.select("sid", "sketch"), "sid"), "jaccard-crowded")
    close = _close(F.col("n_a"), F.col("sketch_a"), F.col("n_b"), F.col("sketch_b"))
    return staged(pairs.union(_meet(crowded, crowded, close)).distinct(), "jaccard-rest")


def classes(docs: DataFrame, signed: DataFrame, sets: DataFrame) -> DataFrame | None:
    """(node, root) of the sets that have a link; None where there is no link."""
    entries, verify = _lists(signed, sets), _Verifier(docs, sets)
    links, labels, last = None, None, ROUNDS == 0
    for turn in range(ROUNDS + 1):
        last = last or turn == ROUNDS
        entries = left = _open_lists(entries, labels)  # what is closed stays closed
        if left.isEmpty():
            break
        pairs = _cross_pairs(left, sets) if last else _likely(sets, _pivot_pairs(left, turn))
        if not last and pairs.isEmpty():
            last = True
            continue
        new = verify(pairs)
        links = new if links is None else links.union(new)
        if last:
            break
        for _ in range(2):
            labels = _hooked(labels, links)
        last = new.count() * GAIN < pairs.count()
    if links is None or links.isEmpty():
        return None
    return components(links)


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs`` (doc_id, text).

    ``component_id`` is the least non-null doc_id that links reach, itself included; it
    is null where no row of the class has one. A null text, an empty one and one of
    blanks only have an empty set and no links: their component is their own doc_id.
    Equal sets are one set, so copies and repeated rows share a class and stay rows of
    their own. An empty table gives no rows; further columns are not looked at.
    """
    signed = _signed(docs)
    sets = staged(
        signed.filter("n > 0").groupBy("s1", "s2").agg(
            F.first("n").alias("n"), F.first("g1").alias("g1"), F.first("g2").alias("g2"), F.min("doc_id").alias("low"),
            F.min("text_hash").alias("text_hash"), F.first("sketch").alias("sketch"),
        ).withColumn("sid", F.monotonically_increasing_id()),
        "jaccard-sets",
    )
    found = classes(docs, signed, sets)
    if found is None:
        of_set = sets.select("s1", "s2", "low")
    else:
        rooted = staged(
            sets.join(found, sets.sid == found.node, "left").select("s1", "s2", "low", F.coalesce("root", "sid").alias("root")),
            "jaccard-rooted",
        )
        least = rooted.groupBy("root").agg(F.min("low").alias("low"))
        of_set = staged(rooted.drop("low").join(least, "root").select("s1", "s2", "low"), "jaccard-classes")
    return signed.select("doc_id", "n", "s1", "s2").join(of_set, ["s1", "s2"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("doc_id")).alias("component_id"),
    )

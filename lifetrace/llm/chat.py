"""Transcripts to chat turns: a hidden Markov model over lines recovers the roles.

A state is a role, opening a turn or going on with it. A line shows which speaker
marker it begins with, whether it begins a paragraph, its length and whether it asks.
Transition and emission counts come from conversations whose roles are known, as one
partial aggregate over all their lines. Viterbi decodes many conversations at once, in
numpy, a lane each. Turns are then rendered in one canonical form, markers removed.

A conversation is decoded in chunks of ``CHUNK`` rows, whatever their turn numbers, so that one that holds most of
the rows is many rows of work: a first pass reduces every chunk of a long conversation to
its best score from each state to each state; a scan over these small tables fixes the
states where chunks meet; then all chunks are decoded on their own. The path is the same
as over the whole conversation.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifetrace.llm.crf import _packed
from lifetrace.plans.prefix import dense_index
from lifetrace.session import staged

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # role r opening: 2r, going on: 2r + 1
CHUNK = 1024
#: How transcripts mark speakers, before a colon, in brackets or as a heading.
MARKERS = {
    "system": ("system", "instructions", "sys"),
    "user": ("user", "human", "customer", "q", "question", "you", "prompt"),
    "assistant": ("assistant", "ai", "bot", "agent", "a", "answer", "model"),
}
_NAMES = "|".join(sorted(chain.from_iterable(MARKERS.values()), key=len, reverse=True))
_MARKER = re.compile(
    rf"[ \t]*(?:<\|({_NAMES})\|>|\[({_NAMES})\][ \t]*:?|#{{1,4}}[ \t]*({_NAMES})[ \t]*:?(?=\Z)|\*{{0,2}}({_NAMES})\*{{0,2}}[ \t]*[:>])[ \t]*",
    re.I | re.A,
)
_ROLE_OF = {word: r for r, role in enumerate(ROLES) for word in MARKERS[role]}
#: Observations of a line: 4 markers, 2 paragraph starts, 3 lengths, 2 questions.
_KINDS = (4, 2, 3, 2)
N_FEATURES = sum(_KINDS)
SMOOTH = 1.0


def observed(line: str, opens: bool) -> tuple[int, tuple[int, ...]]:
    """Length of the marker, and the four observations of a line."""
    m = _MARKER.match(line)
    marker = 1 + _ROLE_OF[next(g for g in m.groups() if g).lower()] if m else 0
    n = len(line)
    seen = (marker, int(opens), 0 if n < 40 else 1 if n < 160 else 2, int(line.rstrip().endswith("?")))
    return (m.end() if m else 0), seen


def _lines(text: str | None) -> list[str]:
    return (text or "").split("\n")


class Chat:
    """Log probabilities of the model."""

    def __init__(self, start: np.ndarray, moves: np.ndarray, shows: np.ndarray):
        norm = lambda x: np.log((x + SMOOTH) / (x + SMOOTH).sum(axis=-1, keepdims=True))
        self.start, self.moves = norm(start), norm(moves)
        parts, at = [], 0
        for k in _KINDS:
            parts.append(norm(shows[:, at : at + k]))
            at += k
        self.shows = np.concatenate(parts, axis=1).T  # feature, state

    def scores(self, seen: np.ndarray) -> np.ndarray:
        """A row per line: log probability of its observations in every state."""
        shift = np.cumsum((0, *_KINDS[:-1]))
        return self.shows[seen + shift].sum(axis=1)


def fitted(labelled: DataFrame) -> Chat:
    """The model from ``labelled`` (conv_id, turn, role, text) in true order.

    Rows of other roles, or of none, teach nothing. Lines are counted where they are;
    how turns follow each other comes from pairs of neighbouring turns, joined on
    (conv_id, turn), so no conversation is gathered.
    """
    known = labelled.filter(F.col("role").isin(*ROLES)).select(
        "conv_id", "turn", "text", F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role")).cast("int").alias("role")
    )

    def count(batches):
        shows = np.zeros((STATES, N_FEATURES))
        inner = np.zeros(STATES)
        shift = np.cumsum((0, *_KINDS[:-1]))
        for batch in batches:
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                for i, line in enumerate(_lines(text)):
                    state = 2 * (role - 1) + (i > 0)
                    shows[state, observed(line, i == 0)[1] + shift] += 1
                    inner[state] += i > 0
        n = STATES * N_FEATURES
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(n + STATES)), pa.array(np.concatenate([shows.reshape(-1), inner]))], ["at", "n"]
        )

    sums = np.zeros(STATES * N_FEATURES + STATES)
    for at, n in known.select("role", "text").mapInArrow(count, "at bigint, n double").groupBy("at").agg(F.sum("n")).collect():
        sums[at] = n
    shows, inner = sums[: STATES * N_FEATURES].reshape(STATES, N_FEATURES), sums[STATES * N_FEATURES :]
    slim = staged(known.select("conv_id", "turn", "role"), "turns")
    ahead = slim.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next"))
    pairs = slim.join(ahead, ["conv_id", "turn"]).groupBy("role", "next").count().collect()
    first = slim.groupBy("conv_id").agg(F.min_by("role", "turn").alias("role")).groupBy("role").count().collect()
    start, moves = np.zeros(STATES), np.zeros((STATES, STATES))
    for role, n in first:
        start[2 * (role - 1)] = n
    opened = shows[0::2, 4:6].sum(axis=1)  # turns of a role
    for r in range(len(ROLES)):
        # from a line to the next: on inside the turn, or to the opening of the turn behind
        lines = max(1.0, opened[r] + inner[2 * r + 1])
        moves[2 * r, 2 * r + 1] = moves[2 * r + 1, 2 * r + 1] = inner[2 * r + 1] / lines * opened[r]
    for role, after, n in pairs:
        for state in (2 * (role - 1), 2 * (role - 1) + 1):
            moves[state, 2 * (after - 1)] += n * (1 - inner[2 * (role - 1) + 1] / max(1.0, opened[role - 1] + inner[2 * (role - 1) + 1]))
    return Chat(start, moves, shows)


def paths(model: Chat, scores: np.ndarray, lengths: np.ndarray, before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Best states of many sequences; ``before`` is the state ahead of a sequence and
    ``last`` its last state, -1 where free."""
    best = np.zeros(len(scores), np.int64)
    order, steps = _packed(lengths)
    if not steps:
        return best
    entry = np.where(before[order][:, None] < 0, model.start, model.moves[before[order]])
    state, back = scores[steps[0]] + entry, []
    for at in steps[1:]:
        ways = state[: len(at)][:, :, None] + model.moves
        back.append(ways.argmax(axis=1))
        state = np.concatenate([scores[at] + ways.max(axis=1), state[len(at) :]])
    label = np.where(last[order] < 0, state.argmax(axis=1), last[order])
    for t in range(len(steps) - 1, -1, -1):
        at = steps[t]
        best[at] = label[: len(at)]
        if t:
            label[: len(at)] = back[t - 1][np.arange(len(at)), label[: len(at)]]
    return best


def _reduced(model: Chat, scores: np.ndarray) -> np.ndarray:
    """Best score of a chunk from every first to every last state (without the entry)."""
    table = np.full((STATES, STATES), -np.inf)
    np.fill_diagonal(table, scores[0])
    for row in scores[1:]:
        table = (table[:, :, None] + model.moves).max(axis=1) + row
    return table


def _groups(batches):
    """Rows of each (conv_id, chunk), in order; the input is sorted by them."""
    held, key = [], None
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for row in zip(*columns):
            if row[:2] != key and held:
                yield held
                held = []
            key = row[:2]
            held.append(row)
    if held:
        yield held


def _seen(rows: list[tuple]) -> list[tuple]:
    """(row number, line number, marker length, observations) of every line."""
    return [(r, i, *observed(line, i == 0)) for r, row in enumerate(rows) for i, line in enumerate(_lines(row[4]))]


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "turn", "tie")


def _chunked(turns: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """conv_id, chunk, turn, tie, text of all rows, and of the conversations that have
    several chunks, whose rows are numbered in order; None where there are none."""
    rows = turns.select("conv_id", F.lit(0).cast("bigint").alias("chunk"), "turn", F.xxhash64("text").alias("tie"), "text")
    many = staged(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CHUNK).select("conv_id"), "long")
    if many.isEmpty():
        return rows, None
    apart = lambda how: rows.alias("t").join(many.alias("m"), F.col("t.conv_id").eqNullSafe(F.col("m.conv_id")), how)
    named = apart("left_semi").withColumns(
        {"_none": F.col("conv_id").isNull(), "_conv": F.coalesce(F.col("conv_id").cast("string"), F.lit(""))}
    )
    numbered = dense_index(named, ["_none", "_conv"], ["turn", "tie"], "_at")
    long = numbered.withColumn("chunk", F.floor(F.col("_at") / CHUNK).cast("bigint")).select(rows.columns)
    return apart("left_anti").unionByName(long), long


def _bounds(model: Chat, long: DataFrame) -> DataFrame:
    """(conv_id, chunk, before, last) of the chunks of conversations that have several."""
    kind = long.schema["conv_id"].dataType.simpleString()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = f"conv_id {kind}, chunk bigint, best array<double>"
    target = to_arrow_schema(_parse_datatype_string(schema))

    def reduce(batches):
        for rows in _groups(batches):
            table = _reduced(model, model.scores(np.array([s for *_, s in _seen(rows)])))
            yield pa.RecordBatch.from_pylist([{"conv_id": rows[0][0], "chunk": rows[0][1], "best": table.reshape(-1).tolist()}], schema=target)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        tables = np.array(pdf["best"].tolist()).reshape(-1, STATES, STATES)
        state, firsts, lasts = (model.start[:, None] + tables[0]).max(axis=0), [None], []
        for table in tables[1:]:
            ways = state[:, None] + model.moves
            firsts.append(ways.argmax(axis=0))
            lasts.append((ways.max(axis=0)[:, None] + table))
            state = lasts[-1].max(axis=0)
        end, out = int(state.argmax()), []
        for k in range(len(tables) - 1, 0, -1):
            first = int(lasts[k - 1][:, end].argmax())
            before = int(firsts[k][first])
            out.append((before, end))
            end = before
        out.append((-1, end))
        out.reverse()
        return pd.DataFrame({"conv_id": pdf["conv_id"].to_numpy(), "chunk": pdf["chunk"].to_numpy(), "before": [b for b, _ in out], "last": [e for _, e in out]})

    small = staged(_ordered(long).mapInArrow(reduce, schema), "chunks")
    return staged(small.groupBy("conv_id").applyInPandas(meet, f"conv_id {kind}, chunk bigint, before int, last int"), "bounds")


def turns_of(transcripts: DataFrame, model: Chat) -> DataFrame:
    """conv_id, turn, role, n_opened, rendered for every row of ``transcripts`` (conv_id, turn, text).

    ``role`` is that of the row's first line; ``rendered`` has a header ``<|role|>`` for
    every turn that opens in the row, and its lines without their markers, so the rows of a
    conversation in order are its canonical transcript. A null text is an empty line; rows
    of one turn follow the hash of their text; a null turn comes first and a null conv_id
    is a conversation of its own. An empty table gives no rows.
    """
    kind, turn_kind = (transcripts.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    rows, long = _chunked(transcripts)
    if long is None:
        rows = _ordered(rows).select("*", F.lit(-1).alias("before"), F.lit(-1).alias("last"))
    else:
        b = _bounds(model, long).select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"), "before", "last")
        joined = rows.join(b, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k")), "left")
        rows = joined.select(
            "conv_id", "chunk", "turn", "tie", "text",
            F.coalesce("before", F.lit(-1)).alias("before"), F.coalesce("last", F.lit(-1)).alias("last"),
        ).repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "turn", "tie")

    def flush(groups):
        seen = [_seen(rows) for rows in groups]
        scores = model.scores(np.array([s for own in seen for *_, s in own]))
        lengths = np.array([len(own) for own in seen])
        ends = [(rows[0][5], rows[0][6]) for rows in groups]
        states = paths(model, scores, lengths, *(np.array(x) for x in zip(*ends))).tolist()
        out, at = [], 0
        for rows, own in zip(groups, seen):
            texts = [_lines(row[4]) for row in rows]
            made = [["", 0, []] for _ in rows]
            for r, i, skip, _ in own:
                role, on = divmod(states[at], 2)
                at += 1
                if i == 0:
                    made[r][0] = ROLES[role]
                if not on:
                    made[r][1] += 1
                    made[r][2].append(f"<|{ROLES[role]}|>")
                made[r][2].append(texts[r][i][skip:])
            for row, (role, opened, lines) in zip(rows, made):
                out.append({"conv_id": row[0], "turn": row[2], "role": role, "n_opened": opened, "rendered": "\n".join(lines) + "\n"})
        return pa.RecordBatch.from_pylist(out, schema=target)

    def run(batches):
        held, size = [], 0
        for rows in _groups(batches):
            held.append(rows)
            size += sum(len(row[4] or "") for row in rows) + 100
            if size >= 4 << 20:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = f"conv_id {kind}, turn {turn_kind}, role string, n_opened int, rendered string"
    target = to_arrow_schema(_parse_datatype_string(schema))
    return rows.mapInArrow(run, schema)


FOLDS = 5


def held_out(conv_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(conv_id.cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


def transcripts_of(conversations: DataFrame) -> DataFrame:
    """The conversations as plain transcripts: by a rule over (conv_id, turn) two of three
    turns begin with a marker in one of several spellings. The role stays beside them."""
    rule = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(12))
    capital = lambda names: F.array(*[F.lit(n.capitalize()) for n in names])
    name = F.coalesce(*[
        F.when(F.col("role") == role, F.get(capital(MARKERS[role]), F.pmod(F.xxhash64("turn", "conv_id"), F.lit(len(MARKERS[role]))).cast("int")))
        for role in ROLES
    ])
    marker = (
        F.when(rule < 4, F.concat(name, F.lit(": "))).when(rule < 6, F.concat(F.lit("["), name, F.lit("] ")))
        .when(rule < 8, F.concat(F.lit("<|"), F.lower(name), F.lit("|>")))
    )
    return conversations.select(
        "conv_id", "turn", "role", F.concat(F.coalesce(marker, F.lit("")), F.coalesce("text", F.lit(""))).alias("text")
    )


def recovered(conversations: DataFrame) -> DataFrame:
    """Fit on the conversations that are not held out; read all as transcripts, without roles."""
    transcripts = transcripts_of(conversations)
    model = fitted(transcripts.filter(~held_out(F.col("conv_id"))))
    return turns_of(transcripts.drop("role"), model)

"""A linear-chain conditional random field over hashed features, in numpy.

Sequences of different lengths are decoded together: ordered by length, one step of
Viterbi moves all that are still running.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

STEPS = 120
RATE = 0.1
DECAY = 1e-3  # L2


@dataclass
class Field:
    weights: np.ndarray  # feature, label
    moves: np.ndarray  # label, next label
    start: np.ndarray  # label


def _packed(lengths: np.ndarray):
    """Sequences by falling length: their order, and per step the tokens at it."""
    order = np.argsort(-lengths, kind="stable")
    begins = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    steps = [begins[: np.searchsorted(-sizes, -t, "left")] + t for t in range(int(sizes[0]) if len(sizes) else 0)]
    return order, steps


def emissions(field: Field, features: np.ndarray) -> np.ndarray:
    return field.weights[features].sum(axis=1)


def viterbi(field: Field, features: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best label of every token; ``features`` has one row of indexes per token."""
    scores = emissions(field, features)
    best = np.zeros(len(features), np.int64)
    _, steps = _packed(lengths)
    back = []
    state = None
    for t, at in enumerate(steps):
        if t == 0:
            state = scores[at] + field.start
            continue
        running = state[: len(at)]
        ways = running[:, :, None] + field.moves
        back.append(ways.argmax(axis=1))
        state = np.concatenate([scores[at] + ways.max(axis=1), state[len(at) :]])
    if state is None:
        return best
    label = state.argmax(axis=1)
    for t in range(len(steps) - 1, -1, -1):
        at = steps[t]
        best[at] = label[: len(at)]
        if t:
            label[: len(at)] = back[t - 1][np.arange(len(at)), label[: len(at)]]
    return best


def _gradient(field: Field, scores: np.ndarray, labels: np.ndarray, steps: list):
    """Expected minus seen counts, by forward and backward sums in the log domain."""
    sum_exp = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
    ahead = []
    for t, at in enumerate(steps):
        if t == 0:
            ahead.append(scores[at] + field.start)
        else:
            ahead.append(scores[at] + sum_exp(ahead[-1][: len(at), :, None] + field.moves, 1))
    d_scores, d_moves = np.zeros_like(scores), np.zeros_like(field.moves)
    behind = np.zeros_like(ahead[0])
    whole = np.zeros(len(ahead[0]))
    for t in range(len(steps) - 1, -1, -1):
        n = len(steps[t])
        ends = n if t == len(steps) - 1 else len(steps[t + 1])
        whole[ends if t < len(steps) - 1 else 0 : n] = sum_exp(ahead[t][ends if t < len(steps) - 1 else 0 : n], 1)
        share = np.exp(ahead[t] + behind[:n] - whole[:n, None])
        d_scores[steps[t]] += share
        if t:
            into = field.moves + (scores[steps[t]] + behind[:n])[:, None, :]
            pairs = np.exp(ahead[t - 1][:n, :, None] + into - whole[:n, None, None])
            d_moves += pairs.sum(axis=0)
            behind[:n] = sum_exp(into, 2)
            np.add.at(d_moves, (labels[steps[t - 1][:n]], labels[steps[t]]), -1.0)
    d_scores[np.arange(len(labels)), labels] -= 1.0
    return d_scores, d_moves, d_scores[steps[0]].sum(axis=0)


def train(features: np.ndarray, lengths: np.ndarray, labels: np.ndarray, size: int, kinds: int) -> Field:
    """The field of greatest penalised likelihood, by Adam over all sequences at once."""
    field = Field(np.zeros((size, kinds)), np.zeros((kinds, kinds)), np.zeros(kinds))
    _, steps = _packed(lengths)
    parts = [field.weights, field.moves, field.start]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, STEPS + 1):
        d_scores, d_moves, d_start = _gradient(field, emissions(field, features), labels, steps)
        d_weights = np.zeros_like(field.weights)
        for column in features.T:
            np.add.at(d_weights, column, d_scores)
        for p, g, m, v in zip(parts, (d_weights, d_moves, d_start), first, second):
            g = g / len(lengths) + DECAY * p
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return field

"""Viterbi decoding of many sequences at once, and of long ones in blocks at once."""

from __future__ import annotations

import numpy as np

#: Scores are integers of so many parts of one, so that sums don't hang on their order.
UNIT = 1 << 16
#: Steps beyond which a sequence is decoded by itself in blocks, and numbers that its blocks' matrices hold at most.
LONG, HELD = 4096, 4_000_000
_NEVER = -(1 << 60)


def decode(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray | float) -> np.ndarray:
    """The best label of each step of sequences that lie one after another in `emissions` (steps x labels).

    `transitions[i, j]` is added where label j follows i; a number is a penalty for any change of label, and then a step
    takes time in proportion to the labels, not to their square. All scores are rounded to 1 / UNIT. Of equal paths the one
    with the smaller last label wins, then the one with the smaller label before it, and so on.

    Sequences advance together, longest first, so that a step costs a few array operations however many there are. One of
    over LONG steps is cut into blocks that advance together as well, so it takes about the root of its steps of them.
    """
    labels = np.zeros(len(emissions), np.int16)
    given = np.rint(np.asarray(transitions, np.float64) * UNIT).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    for i in np.flatnonzero(lengths > LONG).tolist():
        a, b = int(starts[i]), int(starts[i] + lengths[i])
        labels[a:b] = _long(_scores(emissions[a:b]), given)
    short = np.where(lengths > LONG, 0, lengths)
    _together(emissions, labels, starts, short, given)
    return labels


def _scores(emissions: np.ndarray) -> np.ndarray:
    return np.rint(emissions.astype(np.float64) * UNIT).astype(np.int64)


def _step(best: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of best scores by label: the best by the next label, and the label that each came from."""
    if np.ndim(transitions) == 0:
        top, stay = best.argmax(axis=-1)[..., None], np.arange(best.shape[-1])
        changed = np.take_along_axis(best, top, axis=-1) - transitions
        came = np.where(changed > best, top, np.where(changed == best, np.minimum(top, stay), stay))
        return np.maximum(best, changed), came
    ways = best[..., :, None] + transitions
    came = ways.argmax(axis=-2)
    return np.take_along_axis(ways, came[..., None, :], axis=-2)[..., 0, :], came


def _together(emissions: np.ndarray, labels: np.ndarray, starts: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> None:
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    if not len(order):
        return
    longest, begin, size = int(lengths[order[0]]), starts[order], lengths[order]
    active = np.searchsorted(-size, -np.arange(longest), side="left")  # sequences longer than t
    back = np.zeros(emissions.shape, np.int16)
    best = _scores(emissions[begin])
    last = np.zeros(len(order), np.int16)
    for t in range(1, longest):
        n = active[t]
        if n < len(best):
            last[n : len(best)] = best[n:].argmax(axis=1)
            best = best[:n]
        best, back[begin[:n] + t] = _step(best, transitions)
        best += _scores(emissions[begin[:n] + t])
    last[: len(best)] = best.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        ends = size[:n] == t + 1
        if t + 1 < longest:
            follow = ~ends
            now = last[:n].copy()
            now[follow] = back[begin[:n][follow] + t + 1, labels[begin[:n][follow] + t + 1]]
            labels[at] = now
        else:
            labels[at] = last[:n]


def _long(scores: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """The labels of one sequence, as _together() has them.

    What a block does to the best scores before it is a matrix (max-plus); matrices are made for all blocks at once, then a
    walk over blocks gives the scores before each. With these all blocks advance as sequences do. Each block's last label
    gives the one of the block before, which another walk over blocks follows back.
    """
    n, k = scores.shape
    width = max(int(n**0.5), -(-n * k * k // HELD), 2)
    blocks = -(-(n - 1) // width)  # of the steps after the first, which has no label before it
    padded = np.zeros((blocks * width, k), np.int64)
    padded[: n - 1] = scores[1:]
    steps = padded.reshape(blocks, width, k)
    sizes = np.full(blocks, width)
    sizes[-1] = n - 1 - width * (blocks - 1)
    active = lambda t: blocks if t < sizes[-1] else blocks - 1
    matrix = np.full((blocks, k, k), _NEVER, np.int64)
    matrix[:, np.arange(k), np.arange(k)] = 0
    for t in range(width):
        m = active(t)
        matrix[:m] = _step(matrix[:m], transitions)[0] + steps[:m, t, None, :]
    before = np.zeros((blocks, k), np.int64)
    before[0] = scores[0]
    for b in range(1, blocks):
        before[b] = (before[b - 1][:, None] + matrix[b - 1]).max(axis=0)
    back = np.zeros((blocks, width, k), np.int16)
    best = before.copy()
    for t in range(width):
        m = active(t)
        best[:m], back[:m, t] = _step(best[:m], transitions)
        best[:m] += steps[:m, t]
    first = np.tile(np.arange(k), (blocks, 1))  # the label before a block, by its last label
    for t in range(width - 1, -1, -1):
        m = active(t)
        first[:m] = np.take_along_axis(back[:m, t], first[:m], axis=1)
    ends = np.zeros(blocks, np.int64)
    ends[-1] = best[-1].argmax()
    for b in range(blocks - 1, 0, -1):
        ends[b - 1] = first[b, ends[b]]
    out = np.zeros((blocks, width), np.int16)
    now, rows = ends.copy(), np.arange(blocks)
    for t in range(width - 1, -1, -1):
        m = active(t)
        out[:m, t] = now[:m]
        now[:m] = back[rows[:m], t, now[:m]]
    return np.concatenate([[now[0]], out.ravel()[: n - 1]]).astype(np.int16)

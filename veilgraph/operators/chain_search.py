"""The search for inference chains and their estimators, vectorised over a block of masks of one model.

Everything a mask needs is the mask and its model (a few kilobytes), so masks are dealt over tasks and nothing is
shuffled. A block of masks takes every step together: its knowledge states times the model's edges make one matrix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: A block's matrices hold at most about so many cells.
MOST_CELLS = 1 << 21


@dataclass(frozen=True)
class Model:
    """One (dataset, target): the target's bit, and each edge's cells as bits and its weight, in edge order."""

    tbit: int
    masks: np.ndarray
    weights: np.ndarray

    @property
    def has_target(self) -> np.ndarray:
        return (self.masks & self.tbit) != 0


@dataclass
class Chains:
    """Chains of a block, in order of discovery: the mask's place, level, place among its level's states, last edge, weight, inferred cells, edges (or None)."""

    mask: np.ndarray
    level: np.ndarray
    path: np.ndarray
    eid: np.ndarray
    weight: np.ndarray
    inferred: np.ndarray
    edges: np.ndarray | None


def _single(x: np.ndarray) -> np.ndarray:
    """Where exactly one bit is set."""
    return (x != 0) & ((x & (x - 1)) == 0)


def _first_of_each(*keys: np.ndarray) -> np.ndarray:
    """The places of the first row of each distinct combination, in row order."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    return np.sort(order[new])  # lexsort is stable, so a group's first row is its least place


def find_chains(model: Model, masks: np.ndarray, *, with_edges: bool = False) -> Chains:
    """Every chain of every mask. A state is what was inferred so far; of several equal-length ways to it the first by edge numbers stays."""
    n = len(model.masks)
    gone = masks.astype(np.int64) | model.tbit
    lack = model.masks[None, :] & gone[:, None]
    target = model.has_target
    m, e = np.nonzero(target[None, :] & (lack == model.tbit))
    none = np.zeros(len(m), np.int64)
    one = np.eye(n, dtype=bool)
    found = [Chains(m, none, none, e, model.weights[e], none, one[e] if with_edges else None)]
    m, e = np.nonzero(~target[None, :] & _single(lack))
    inferred, weight, used = lack[m, e], model.weights[e], one[e] if with_edges else None
    level = 0
    while len(m):
        level += 1
        kept = _first_of_each(m, inferred)
        m, inferred, weight = m[kept], inferred[kept], weight[kept]
        used = used[kept] if with_edges else None
        parts = []
        for at in range(0, len(m), step := max(1, MOST_CELLS // max(n, 1))):
            some = slice(at, at + step)
            now = model.masks[None, :] & (gone[m[some]] & ~inferred[some])[:, None]
            # an edge that lacks one cell from the start doesn't extend a chain
            s, e = np.nonzero(_single(now) & ~_single(lack[m[some]]) & (now != 0))
            parts.append((s + at, e, now[s, e]))
        s, e, new = (np.concatenate([p[i] for p in parts]) for i in range(3))
        longer = weight[s] * model.weights[e]
        both = (used[s] | one[e]) if with_edges else None
        end = new == model.tbit
        t = s[end]
        found.append(Chains(m[t], np.full(len(t), level), t, e[end], longer[end], inferred[t], both[end] if with_edges else None))
        go = ~end
        m, inferred, weight, used = m[s[go]], inferred[s[go]] | new[go], longer[go], both[go] if with_edges else None
    return Chains(
        *[np.concatenate([getattr(f, k) for f in found]) for k in ("mask", "level", "path", "eid", "weight", "inferred")], np.concatenate([f.edges for f in found]) if with_edges else None
    )


def _product_left(mask: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """For each mask the product of 1 - weight over its rows (sorted by mask)."""
    out = np.ones(n)
    if len(mask):
        first = np.flatnonzero(np.append(True, mask[1:] != mask[:-1]))
        out[mask[first]] = np.multiply.reduceat(1.0 - weight, first)
    return out


def _greedy_left(mask: np.ndarray, weight: np.ndarray, inferred: np.ndarray, n: int) -> np.ndarray:
    """The product over chains taken in order, each if it infers no cell that one taken before infers. Rows come sorted by mask and order.

    Chains that infer nothing are always taken. After them each round takes every mask's first chain that is left and drops
    those that share a cell with it, so there are at most as many rounds as cells.
    """
    taken = inferred == 0
    rows = np.flatnonzero(~taken)
    while len(rows):
        head = np.append(True, mask[rows[1:]] != mask[rows[:-1]])
        first = rows[head][np.cumsum(head) - 1]
        taken[rows[head]] = True
        rows = rows[(inferred[rows] & inferred[first]) == 0]
    at = np.flatnonzero(taken)
    return _product_left(mask[at], weight[at], n)


def _pair_bound(weight: np.ndarray, edges: np.ndarray, logs: np.ndarray) -> float:
    """The smaller of noisy-or and the second-order bound of one mask's chains."""
    own, pairs = edges @ logs, 0.0
    for at in range(0, len(weight), 512):  # blocks bound the memory, no pair is left out
        some = slice(at, at + 512)
        union = own[some, None] + own[None, at:] - (edges[some] * logs) @ edges[at:].T
        pairs += np.triu(np.exp(union), 1).sum()
    return min(1.0 - np.prod(1.0 - weight), max(0.0, min(1.0, weight.sum() - pairs)))


def estimate(model: Model, masks: np.ndarray, *, bound: bool = False) -> dict[str, np.ndarray]:
    """Chain counts and the estimators of each mask; ``bound`` adds the second-order one.

    Greedy order: chains by falling weight, then fewer inferred cells, then order of discovery. Only direct chains are
    active, as any longer one ends in an edge with two deleted cells.
    """
    n = len(masks)
    c = find_chains(model, masks, with_edges=bound)
    order = np.lexsort((c.inferred, c.eid, c.path, c.level, np.bitwise_count(c.inferred), -c.weight, c.mask))
    mask, weight, inferred, direct = c.mask[order], c.weight[order], c.inferred[order], c.level[order] == 0
    count, active, largest = np.bincount(mask, minlength=n), np.bincount(mask[direct], minlength=n), np.zeros(n)
    np.maximum.at(largest, mask[direct], weight[direct])
    out = {
        "num_chains": count, "active_chains": active, "blocked_chains": count - active, "leakage_max": largest,
        "leakage_greedy": 1.0 - _greedy_left(mask, weight, inferred, n), "leakage_noisy_or": 1.0 - _product_left(mask, weight, n),
    }
    if bound:
        edges, logs = c.edges[order].astype(np.float64), np.log(np.maximum(model.weights, 1e-300))
        ends = np.cumsum(count)
        out["leakage_ie"] = np.array([_pair_bound(weight[b - k : b], edges[b - k : b], logs) if k else 0.0 for k, b in zip(count.tolist(), ends.tolist(), strict=True)], np.float64)
    return out


def conflicts(tbit: int, edges: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """For each mask visible cells that infer the target together (as bits, without the target); 0 if the visible cells don't infer it.

    Every inferred cell keeps the visible cells that it was inferred from, for all masks at once.
    """
    cells = tbit.bit_length()
    known = ~masks & (tbit - 1)
    leaves = np.where((known[:, None] >> np.arange(cells)) & 1 == 1, np.int64(1) << np.arange(cells, dtype=np.int64), 0)
    members = [(int(e), [c for c in range(cells) if int(e) >> c & 1]) for e in np.unique(edges)]
    while True:
        before = known.copy()
        for edge, own in members:
            lack = edge & ~known
            at = np.flatnonzero(_single(lack))
            if not len(at):
                continue
            cause = np.bitwise_or.reduce(np.where(((lack[at][:, None] >> np.array(own)) & 1) == 1, 0, leaves[at][:, own]), axis=1)
            leaves[at, np.bitwise_count(lack[at] - 1).astype(np.int64)] = cause
            known[at] |= lack[at]
        if (known == before).all() or (known & tbit != 0).all():
            return np.where(known & tbit != 0, leaves[:, cells - 1], 0)


def wider_masks(tbit: int, edges: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(safe masks, those to be looked at next): a mask that isn't safe grows by each cell of its conflict.

    Every safe mask that holds an unsafe one holds a cell of its conflict as well, so sizes tried in order miss no smallest mask.
    """
    found = conflicts(tbit, edges, masks)
    open_, causes = masks[found != 0], found[found != 0]
    bits = np.int64(1) << np.arange(tbit.bit_length(), dtype=np.int64)
    row, bit = np.nonzero(causes[:, None] & bits)
    return masks[found == 0], np.unique(open_[row] | bits[bit])


def smallest_masks(tbit: int, edges: np.ndarray, most: int) -> tuple[int, np.ndarray, bool]:
    """(size, masks, whether they are safe): all smallest safe masks, or the masks of the first size of which there are more than ``most`` to be looked at."""
    size, masks = 0, np.zeros(1, np.int64)
    while len(masks) <= most:
        safe, more = wider_masks(tbit, edges, masks)
        if len(safe):
            return size, safe, True
        size, masks = size + 1, more
    return size, masks, False

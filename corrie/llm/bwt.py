"""Burrows-Wheeler transforms of string collections, and their merge by iterative interleave refinement."""

from __future__ import annotations

import numpy as np


class Bwt:
    """The transform of some strings, each ended by a terminator that sorts first; equal suffixes keep the strings' order.

    last: the symbol before each suffix in suffix order (byte + 1; 0 before a string's start); at: where each suffix
    starts in the concatenation of the terminated strings.
    """

    def __init__(self, data: np.ndarray, lengths: np.ndarray) -> None:
        lengths = np.asarray(lengths, np.int64)
        n = int(lengths.sum()) + len(lengths)
        ends = np.cumsum(lengths + 1) - 1
        sym = np.zeros(n, np.int64)
        inner = np.ones(n, bool)
        inner[ends] = False
        sym[inner] = data.astype(np.int64) + 1
        left = np.repeat(ends, lengths + 1) - np.arange(n)  # symbols before the terminator
        key = np.zeros(n, np.int64)
        for j in range(6):
            key *= 512
            if j < n:
                key[: n - j] += np.where(left[: n - j] >= j, sym[j:], 0)
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = _firsts(key[order])
        todo = order[_repeated(rank[order])]
        h = 6
        while len(todo) and h <= int(lengths.max(initial=0)):
            ahead = np.where(left[todo] >= h, rank[np.minimum(todo + h, n - 1)] + 1, 0)
            key = rank[todo] * (n + 1) + ahead
            o = np.argsort(key, kind="stable")
            todo, key, old = todo[o], key[o], rank[todo[o]]
            # Ranks are the place of a group's first suffix, so a new group's is the old one's and how far it lies behind.
            place = _firsts(key) - _firsts(old)
            rank[todo] = old + place
            todo = todo[_repeated(key)]
            h *= 2
        self.at = np.argsort(rank, kind="stable").astype(np.int32 if n < 1 << 31 else np.int64)
        before = np.r_[0, sym[:-1]]
        self.last = before[self.at].astype(np.uint16)


def _firsts(x: np.ndarray) -> np.ndarray:
    """For each place of a sorted array, the place of the first equal value."""
    new = np.r_[True, x[1:] != x[:-1]] if len(x) else np.zeros(0, bool)
    return np.maximum.accumulate(np.where(new, np.arange(len(x)), 0)) if len(x) else np.zeros(0, np.int64)


def _repeated(x: np.ndarray) -> np.ndarray:
    """For each place of a sorted array, whether a neighbour is equal."""
    same = x[1:] == x[:-1]
    return np.r_[False, same] | np.r_[same, False] if len(x) else np.zeros(0, bool)


def merge(shards: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleaves transforms: their `last` arrays to (order, block).

    order lists the suffixes of all shards (numbered shard after shard, in each shard's own order) by their first `depth`
    symbols; block names equal prefixes of that length in that order, so places in blocks of two or more are the repeated
    intervals. Each round doubles the depth d: the interleave is refined by the blocks at d of the suffix itself and of
    the one d symbols further on, which the transforms alone give. Within a shard these keys already ascend, so a round
    merges runs and sorts nothing anew. Two suffixes part in the round in which their common prefix ends.
    """
    base = np.cumsum([0, *map(len, shards)])
    n = int(base[-1])
    kind = np.int32 if n < 1 << 31 else np.int64
    first, nxt = np.zeros(n, np.uint16), np.arange(n, dtype=kind)
    for b, last in zip(base, shards, strict=False):
        by = np.argsort(last, kind="stable")
        m = int((last == 0).sum())  # the terminators' own suffixes come first and lead nowhere
        first[b + m : b + len(last)] = last[by][m:]
        nxt[b + m : b + len(last)] = by[m:] + b
    d, steps = 1, {1: nxt}
    order = np.argsort(first, kind="stable").astype(kind)
    key = first[order]
    del first, nxt
    while True:
        block = _firsts(key).astype(kind)  # in the order of the suffixes' d symbols
        if d == depth:
            return order, block
        names = np.empty(n, kind)
        names[order] = block
        del block, key, order
        more = min(d, depth - d)
        key = names[steps[d] if more == d else _jump(steps, more)].astype(np.int64)
        key += names * np.int64(n + 1)
        del names
        by = np.argsort(key, kind="stable")
        key, order = key[by], by.astype(kind)
        del by
        if 2 * d <= depth:
            steps[2 * d] = steps[d][steps[d]]
        if not (depth & d):  # only the powers that make up the last jump are needed again
            del steps[d]
        d += more


def _jump(steps: dict[int, np.ndarray], by: int) -> np.ndarray:
    out = None
    for d in sorted(steps):
        if by & d:
            out = steps[d] if out is None else steps[d][out]
    return out


def repeated(strings: list[tuple[np.ndarray, np.ndarray]], depth: int) -> list[np.ndarray]:
    """For each shard (bytes of all strings, lengths): whether the `depth` bytes from each byte on, of one string, also start anywhere else in the shards; False where fewer are left."""
    if not strings:
        return []
    made = [Bwt(data, lengths) for data, lengths in strings]
    order, block = merge([b.last for b in made], depth)
    hit = np.zeros(len(order), bool)
    hit[order] = _repeated(block)
    out, base = [], 0
    for b, (data, lengths) in zip(made, strings, strict=True):
        lengths = np.asarray(lengths, np.int64)
        own = np.zeros(len(b.at), bool)
        own[b.at] = hit[base : base + len(b.at)]
        base += len(b.at)
        ends = np.cumsum(lengths + 1) - 1
        left = np.repeat(ends, lengths + 1) - np.arange(len(own))
        inner = np.ones(len(own), bool)
        inner[ends] = False
        out.append((own & (left >= depth))[inner])
    return out

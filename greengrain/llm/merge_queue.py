"""A queue of byte-pair merges over many pre-tokens at once: one bucket per rank, a two-level bitmap over the ranks.

Merges of different pre-tokens do not touch each other, so a bucket is taken as a whole, by array operations over the positions of
all pre-tokens. Where pairs of a bucket overlap, every second one is taken from the left. A merge that makes a pair of a lower
rank than its own would have to come before the rest of its bucket; such a pre-token is odd and left to the caller.
"""

from __future__ import annotations

import numpy as np

WIDTH = 256
BIT = [1 << i for i in range(WIDTH)]


def pointers(counts: np.ndarray) -> np.ndarray:
    """Row pointers of a sparse matrix from the lengths of its rows."""
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(counts, dtype=np.int64)])


class MergeQueue:
    """`one` gives the token of each byte, `pairs` (left, right, rank) of all merges, `made` the token of a rank."""

    def __init__(self, one: list[int], pairs: list[tuple[int, int, int]], made: np.ndarray, tokens: int):
        left, right, rank = np.array(pairs, np.int64).reshape(-1, 3).T
        self.tokens, self.made, self.one = tokens, np.asarray(made).tolist(), np.array(one, np.int32)
        self.low = [0] * (len(self.made) // WIDTH + 1)

        def rows(x: np.ndarray, y: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
            order = np.lexsort((y, x))
            return pointers(np.bincount(x, minlength=tokens + 1)).tolist(), y[order].astype(np.int32), rank[order].astype(np.int32)
        self.by_left, self.by_right = rows(left, right), rows(right, left)
        byte = {t: b for b, t in enumerate(one)}
        self.two = np.full(1 << 16, -1, np.int32)
        for a, b, r in pairs:
            if a in byte and b in byte:
                self.two[byte[a] * 256 + byte[b]] = r

    def run(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """(ids without those of odd pre-tokens, counts, odd pre-tokens) of pre-tokens that are not empty."""
        (l_ptr, l_other, l_rank), (r_ptr, r_other, r_rank) = self.by_left, self.by_right
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ptr, n, none = pointers([len(p) for p in pieces]), len(raw), self.tokens
        token = np.append(self.one[raw], np.int32(none))
        after, before, alive = np.arange(1, n + 2), np.arange(-1, n), np.ones(n, bool)
        after[ptr[1:] - 1] = before[ptr[:-1]] = n
        pair = np.full(n + 1, -1, np.int32)
        pair[:n - 1] = self.two[raw[:-1].astype(np.int64) * 256 + raw[1:]]
        pair[ptr[1:] - 1] = -1
        low, high, buckets = self.low, 0, {}
        at, ranks, odd = np.flatnonzero(pair >= 0), pair[pair >= 0], set()

        def look(ptr_: list[int], other: np.ndarray, rank: np.ndarray, made: int, x: np.ndarray) -> np.ndarray:
            a, b = ptr_[made], ptr_[made + 1]
            if a == b:
                return np.full(len(x), -1, np.int32)
            k = other[a:b].searchsorted(x)
            k[k == b - a] = 0
            return np.where(other[a:b][k] == x, rank[a:b][k], -1)

        while True:
            if len(at):
                order = ranks.argsort(kind="stable")
                at, ranks = at[order], ranks[order]
                cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(at)]
                for r, a, b in zip(ranks[cuts[:-1]].tolist(), cuts[:-1], cuts[1:]):
                    held = buckets.get(r)
                    if held is None:
                        buckets[r] = [at[a:b]]
                        low[r // WIDTH] |= BIT[r % WIDTH]
                        high |= 1 << r // WIDTH
                    else:
                        held.append(at[a:b])
            if not high:
                break
            word = (high & -high).bit_length() - 1
            bits = low[word]
            r = word * WIDTH + (bits & -bits).bit_length() - 1
            low[word] = bits & bits - 1
            if not low[word]:
                high &= high - 1
            held = buckets.pop(r)
            at = held[0] if len(held) == 1 else np.concatenate(held)
            at = at[pair[at] == r]
            if len(at) > 1:
                at = np.sort(at)
                at = at[np.append(True, at[1:] != at[:-1])]
                tied = after[at[:-1]] == at[1:]
                if tied.any():
                    k = np.arange(len(at))
                    begin = np.maximum.accumulate(np.where(np.append(False, tied), 0, k))
                    at = at[(k - begin) % 2 == 0]
            if not len(at):
                ranks = at
                continue
            gone = after[at]
            end, early, made = after[gone], at[:0], self.made[r]
            if (end[:-1] == at[1:]).any():  # between two merges of the bucket there is a pair of the new token and an old one
                between = look(l_ptr, l_other, l_rank, made, token[end])
                early = at[(between >= 0) & (between < r)]
            token[at], after[at], before[end], pair[gone], alive[gone] = made, end, at, -1, False
            prior = before[at]
            fresh = np.concatenate([look(r_ptr, r_other, r_rank, made, token[prior]), look(l_ptr, l_other, l_rank, made, token[end])])
            at = np.concatenate([prior, at])
            pair[at] = fresh
            pair[n] = -1
            good = fresh >= 0
            at, ranks = at[good], fresh[good]
            early = np.concatenate([early, at[ranks < r]])
            if len(early):
                for k in set((ptr.searchsorted(early, "right") - 1).tolist()):
                    odd.add(k)
                    pair[ptr[k]:ptr[k + 1]] = -1
                stays = pair[at] >= 0
                at, ranks = at[stays], ranks[stays]
        counts = np.add.reduceat(alive, ptr[:-1], dtype=np.int64)
        for k in odd:
            alive[ptr[k]:ptr[k + 1]] = False
        return token[:n][alive], counts, sorted(odd)

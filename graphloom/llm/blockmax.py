"""Inverted lists in blocks of variable length, each with its largest impact, and exact search that skips blocks.

Where a list is cut is chosen by dynamic programming: a block's bound is its largest impact, and the cuts make the sum of
all bounds' errors, with a fee for each block, as small as it can be. A search sums the bounds of the blocks that lie over
each document, looks into the most promising documents first, and reads only blocks over documents that can still reach
the k-th best score. What it returns is exact, whatever the cuts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of a text that are split at a time.
CHUNK = 1 << 20
#: Postings in a block at most, and a block's fee as a multiple of its list's mean impact.
LONGEST, FEE = 64, 4.0
#: Whole numbers up to here are exact as doubles.
EXACT = 2.0**53
#: Documents that a search looks into first, as a multiple of k; each further step takes GROWTH times as many.
FIRST, GROWTH = 4, 8

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_TABLE = bytes(b + 32 if 0x41 <= b < 0x5B else b if _LETTER[b] else 0x20 for b in range(256))


def terms(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, part by part: maximal runs of letters and digits of ASCII (A-Z lower-cased) and of all
    characters beyond ASCII."""
    at = 0
    while at < len(data):
        part = data[at : at + CHUNK].translate(_TABLE)
        if at + CHUNK < len(data):
            end = part.rfind(b" ")
            if end < 0:  # a term longer than the part: up to its end
                end = at + CHUNK
                while end < len(data) and _LETTER[data[end]]:
                    end += 1
                part, end = data[at:end].translate(_TABLE), end - at
            part = part[:end]
        yield part.split()
        at += max(1, len(part))


def cuts(impacts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where blocks begin, ascending. List i holds impacts[starts[i]:starts[i + 1]]; none is empty.

    The least sum of errors (a block's largest impact less each of its impacts) and fees, found for all lists at once: step j
    looks at the j-th posting of every list that has one, and at the LONGEST blocks that may end there.
    """
    lengths = np.diff(starts)
    order = np.argsort(-lengths, kind="stable")
    first, lengths = starts[:-1][order], lengths[order]
    fee = FEE * np.add.reduceat(impacts.astype(float), starts[:-1])[order] / lengths if len(order) else np.empty(0)
    size = np.arange(1, LONGEST + 1, dtype=float)
    before, top = np.full((len(order), LONGEST), np.inf), np.zeros((len(order), LONGEST))
    least, back = np.zeros(len(order)), np.empty(len(impacts), np.int64)
    for j in range(int(lengths.max(initial=0))):
        m = int(np.searchsorted(-lengths, -j, "left"))  # lists longer than j
        own = impacts[first[:m] + j].astype(float)
        wide = min(j + 1, LONGEST)
        b, t = before[:m, :wide], top[:m, :wide]
        b[:, 1:] = b[:, :-1].copy()
        b[:, 0] = least[:m]
        np.maximum(t[:, :-1].copy(), own[:, None], out=t[:, 1:])
        t[:, 0] = own
        cost = b + size[:wide] * t
        best = cost.argmin(axis=1)
        least[:m] = cost[np.arange(m), best] + fee[:m]
        back[first[:m] + j] = best + 1
    found, at = [], first + lengths
    while len(at):
        at = at - back[at - 1]
        found.append(at)
        keep = at > first
        at, first = at[keep], first[keep]
    return np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers of the ranges low[i]..high[i] - 1, one range after the other."""
    n = high - low
    return np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)


def _sums(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of values by place; of whole numbers exactly."""
    if values.dtype.kind == "f" or np.abs(values).astype(float).sum() < EXACT:
        return np.bincount(at, values, size).astype(values.dtype)
    out = np.zeros(size, values.dtype)
    np.add.at(out, at, values)
    return out


class Lists:
    """Postings of one shard. terms: ascending; term i has the documents docs[starts[i]:starts[i + 1]], ascending numbers
    below n, with impacts of 0 or more (whole numbers or doubles)."""

    def __init__(self, terms: np.ndarray, starts: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n: int):
        self.terms, self.docs, self.impacts, self.n = terms, docs, impacts, n
        self.at = np.append(cuts(impacts, starts), len(impacts))
        self.blocks = np.searchsorted(self.at, starts)  # a term's blocks
        self.first, self.last = docs[self.at[:-1]], docs[self.at[1:] - 1]
        self.most = np.maximum.reduceat(impacts, self.at[:-1]) if len(impacts) else impacts
        self.slack = 0 if impacts.dtype.kind == "i" else 1e-9

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, least: float = 0) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores (sums of weight times impact) of the k best above 0 that reach least, best first, ties to
        the smaller number; terms are distinct, weights 0 or more."""
        place = np.searchsorted(self.terms, terms)
        there = place < len(self.terms)
        there[there] = self.terms[place[there]] == terms[there]
        place, weights = place[there], weights[there]
        none = np.empty(0, np.int64), np.empty(0, self.impacts.dtype)
        if not len(place):
            return none
        low, high = self.blocks[place], self.blocks[place + 1]
        blocks, own = _ranges(low, high), np.repeat(weights, high - low)
        first, last, bound = self.first[blocks], self.last[blocks], own * self.most[blocks]
        upper = np.cumsum(_sums(first, bound, self.n + 1) - _sums(last + 1, bound, self.n + 1))[: self.n]
        left = np.flatnonzero((upper > 0) & (upper >= least - self.slack))
        ids, scores, step = none[0], none[1], FIRST * k
        while len(left):
            take = left
            if len(left) > step:
                chosen = np.argpartition(-upper[left], step)[:step]
                take, mask = left[chosen], np.ones(len(left), bool)
                mask[chosen] = False
                left = left[mask]
            else:
                left = left[:0]
            ids = np.concatenate([ids, np.sort(take)])
            scores = np.concatenate([scores, self._scores(np.sort(take), blocks, own, first, last)])
            best = np.lexsort((ids, -scores))
            best = best[scores[best] > 0][:k]
            ids, scores = ids[best], scores[best]
            if len(ids) == k:
                least = max(least, scores[-1])
            left = left[upper[left] >= least - self.slack]
            step *= GROWTH
        keep = scores >= least if not self.slack else np.ones(len(ids), bool)
        return ids[keep], scores[keep]

    def _scores(self, wanted: np.ndarray, blocks: np.ndarray, own: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Scores of the wanted documents (ascending), from the blocks that lie over any of them."""
        mark = np.zeros(self.n + 1, np.int64)
        mark[wanted + 1] = 1
        upto = np.cumsum(mark)
        live = upto[last + 1] > upto[first]
        low, high = self.at[blocks[live]], self.at[blocks[live] + 1]
        postings, weight = _ranges(low, high), np.repeat(own[live], high - low)
        docs = self.docs[postings]
        keep = mark[docs + 1] == 1
        return _sums(upto[docs[keep] + 1] - 1, weight[keep] * self.impacts[postings[keep]], len(wanted))

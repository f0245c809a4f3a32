"""Re-Pair: a grammar that replaces frequent pairs of ids by new symbols."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Symbols below this are ids, the others are rules.
TERMINALS = 1 << 20
#: A pair becomes a rule if it occurs so often (a rule is three numbers, so that
#: fewer save nothing), and at least this share of the count of the most frequent
#: pair of the round.
LEAST, SHARE = 4, 0.25
#: Pairs are counted in so many bits of slots before they are counted exactly.
SLOT_BITS = 18


@dataclass
class Grammar:
    """`sequence` of symbols; rule i stands for the symbols left[i] and right[i],
    and for lengths[i] ids in all."""

    sequence: np.ndarray
    left: np.ndarray
    right: np.ndarray
    lengths: np.ndarray

    def sizes(self) -> np.ndarray:
        """How many ids each symbol of the sequence stands for."""
        sizes = np.ones(len(self.sequence), np.int64)
        rules = self.sequence >= TERMINALS
        sizes[rules] = self.lengths[self.sequence[rules] - TERMINALS]
        return sizes

    def decode(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Ids `begin` to `end`: only the symbols that cover them are expanded."""
        sizes = self.sizes()
        ends = np.cumsum(sizes)
        end = int(ends[-1]) if end is None and len(ends) else end or 0
        if end <= begin:
            return np.empty(0, np.uint32)
        first, last = np.searchsorted(ends, begin, "right"), np.searchsorted(ends, end, "left")
        skipped = int(ends[first] - sizes[first])
        return self.expand(self.sequence[first : last + 1])[begin - skipped : end - skipped]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        while len(at := np.flatnonzero(symbols >= TERMINALS)):
            rule = symbols[at] - TERMINALS
            wide = np.repeat(symbols, 1 + (symbols >= TERMINALS))
            place = at + np.arange(len(at))
            wide[place], wide[place + 1] = self.left[rule], self.right[rule]
            symbols = wide
        return symbols


def chosen(hits: np.ndarray) -> np.ndarray:
    """Of places where pairs begin, those left once none overlaps the one before."""
    if not len(hits):
        return hits
    new = np.append(True, np.diff(hits) > 1)
    begins = hits[new][np.cumsum(new) - 1]
    return hits[(hits - begins) % 2 == 0]


def slots_of(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A slot of 2^SLOT_BITS for each pair, equal for equal pairs."""
    return (first * np.uint32(0x9E3779B1) ^ second * np.uint32(0x85EBCA6B)) >> np.uint32(32 - SLOT_BITS)


def frequent_pairs(s: np.ndarray, at: np.ndarray, often: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that begin `often` times or more at the places `at` (ascending), in
    order; the places where they begin; and which of them begins there.

    Pairs are first counted by slots, which can only count too many. The few
    that may be frequent are then counted exactly.
    """
    slots = slots_of(s[at], s[at + 1])
    at = at[(np.bincount(slots, minlength=1 << SLOT_BITS) >= often)[slots]]
    found, which, counts = np.unique(s[at].astype(np.uint64) << np.uint64(32) | s[at + 1], return_inverse=True, return_counts=True)
    keep = counts >= often
    number = np.cumsum(keep) - 1
    return found[keep], at[keep[which]], number[which[keep[which]]]


def compress(ids: np.ndarray, least: int = LEAST, share: float = SHARE) -> Grammar:
    """The grammar of a shard's ids.

    A bound falls from the count of the most frequent pair, by `share` at a
    time, to `least`. At each bound, the pairs that occur as often are replaced
    from left to right by new symbols. What is replaced makes new pairs; those
    are counted next, until none reaches the bound. (The count of a pair
    without a new symbol can't have risen, so it need not be counted again.)
    In the end no pair worth a rule occurs `least` times.
    """
    s = ids.astype(np.uint32)
    left, right, lengths = [np.empty(0, np.uint32)], [np.empty(0, np.uint32)], np.empty(0, np.uint32)
    bound = int(np.bincount(slots_of(s[:-1], s[1:])).max()) if len(s) > 1 else 0
    bound, new = max(least, int(share * bound)), 0
    while len(s) > 1:
        if new:
            with_new = s >= new
            at = np.flatnonzero(with_new[:-1] | with_new[1:])
        else:
            at = np.arange(len(s) - 1)
        frequent, hits, which = frequent_pairs(s, at, bound)
        first = chosen(hits)
        which = which[np.searchsorted(hits, first)]
        used = np.bincount(which, minlength=len(frequent))
        # a rule must be worth its place after overlaps; else the pair stays
        worth = used >= min(least, 3)
        if not worth.any():
            if bound == least:
                break
            bound, new = max(least, int(share * bound)), 0
            continue
        places, which = first[worth[which]], which[worth[which]]
        new = TERMINALS + len(lengths)
        kept = frequent[worth]
        left.append((kept >> np.uint64(32)).astype(np.uint32))
        right.append((kept & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        size = [np.where(x < TERMINALS, 1, lengths[np.where(x < TERMINALS, 0, x - TERMINALS)] if len(lengths) else 1) for x in (left[-1].astype(np.int64), right[-1].astype(np.int64))]
        lengths = np.append(lengths, (size[0] + size[1]).astype(np.uint32))
        stay = np.ones(len(s), bool)
        stay[places + 1] = False
        s[places] = ((np.cumsum(worth) - 1)[which] + new).astype(np.uint32)
        s = s[stay]
    return Grammar(s, np.concatenate(left), np.concatenate(right), lengths)

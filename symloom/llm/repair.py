"""Re-Pair grammars over token sequences.

Re-Pair replaces the most frequent pair of neighbouring symbols by a new rule until no pair occurs twice. What the grammar saves
tells how much of a sequence is repetition, and the rules name the repeated phrases.
"""

from __future__ import annotations

import heapq

import numpy as np


class Grammar:
    """rules: (left, right) of each new symbol, numbered from `first`; final: what is left of the sequence; uses: occurrences of each rule
    in the sequence when it was made."""

    __slots__ = ("first", "rules", "final", "uses")

    def __init__(self, first: int, rules: list[tuple[int, int]], final: list[int], uses: list[int]):
        self.first, self.rules, self.final, self.uses = first, rules, final, uses

    def size(self) -> int:
        return len(self.final) + 2 * len(self.rules)

    def expand(self, symbol: int) -> tuple[int, ...]:
        """The tokens behind a symbol."""
        out, stack = [], [symbol]
        while stack:
            s = stack.pop()
            if s < self.first:
                out.append(s)
            else:
                left, right = self.rules[s - self.first]
                stack += [right, left]
        return tuple(out)


def infer(sequence: list[int], alphabet: int) -> Grammar:
    """The Re-Pair grammar of a sequence of symbols below `alphabet`; ties go to the pair met first. An empty sequence has no rules."""
    n = len(sequence)
    seq: list[int] = list(sequence)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], set[int]] = {}
    last: dict[tuple[int, int], int] = {}
    for i in range(n - 1):
        pair = (seq[i], seq[i + 1])
        if pair[0] == pair[1] and last.get(pair) == i - 1:  # occurrences must not overlap
            continue
        places.setdefault(pair, set()).add(i)
        last[pair] = i
    heap = [(-len(p), min(p), pair) for pair, p in places.items() if len(p) > 1]
    heapq.heapify(heap)
    rules: list[tuple[int, int]] = []
    uses: list[int] = []
    while heap:
        count, _, pair = heapq.heappop(heap)
        at = places.get(pair)
        if not at or len(at) < 2:
            continue
        if -count != len(at):
            heapq.heappush(heap, (-len(at), min(at), pair))
            continue
        new = alphabet + len(rules)
        rules.append(pair)
        del places[pair]
        touched: set[tuple[int, int]] = set()
        done = 0
        for i in sorted(at):
            j = nxt[i]
            if seq[i] != pair[0] or j >= n or seq[j] != pair[1]:
                continue
            done += 1
            k, h = nxt[j], prv[i]
            if h >= 0:
                old = (seq[h], pair[0])
                if old in places:
                    places[old].discard(h)
            if k < n:
                old = (pair[1], seq[k])
                if old in places:
                    places[old].discard(j)
            seq[i], seq[j] = new, -1
            nxt[i] = k
            if k < n:
                prv[k] = i
            if h >= 0:
                p = (seq[h], new)
                if not (p[0] == p[1] and prv[h] >= 0 and prv[h] in places.get(p, ())):
                    places.setdefault(p, set()).add(h)
                    touched.add(p)
            if k < n:
                p = (new, seq[k])
                places.setdefault(p, set()).add(i)
                touched.add(p)
        uses.append(done)
        for p in touched:
            q = places.get(p)
            if q and len(q) > 1:
                heapq.heappush(heap, (-len(q), min(q), p))
    final, i = [], 0
    while i < n:
        final.append(seq[i])
        i = nxt[i]
    return Grammar(alphabet, rules, final, uses)


def infer_rounds(sequence: np.ndarray, alphabet: int) -> Grammar:
    """A Re-Pair grammar made in rounds: each round replaces all pairs that are more frequent than every pair they overlap with.

    The most frequent pair of all is among them, so a round makes at least one rule while some pair occurs twice without overlap. A sequence of n symbols takes
    a number of rounds about logarithmic in n, each of a few array operations.
    """
    seq = np.asarray(sequence, np.int64)
    rules: list[tuple[int, int]] = []
    uses: list[int] = []
    top = alphabet
    while len(seq) > 1:
        left, right = seq[:-1], seq[1:]
        names, which = np.unique(left * (top + 1) + right, return_inverse=True)
        # of a run of one symbol every second pair stands, as occurrences must not overlap
        valid = np.ones(len(which), bool)
        same = which[1:] == which[:-1]
        if same.any():
            at = np.arange(len(which))
            start = np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), at, 0))
            valid = (at - start) % 2 == 0
        count = np.bincount(which[valid], minlength=len(names))
        if count.max() < 2:
            break
        score = np.where(valid & (count[which] > 1), count[which] * len(names) + (len(names) - which), 0)
        take = score > 0
        take[1:] &= score[1:] > score[:-1]
        take[:-1] &= score[:-1] > score[1:]
        taken = np.bincount(which[take], minlength=len(names))
        chosen = taken > 1
        take &= chosen[which]
        number = np.cumsum(chosen) - 1 + top
        for name in names[chosen].tolist():
            rules.append((name // (top + 1), name % (top + 1)))
        uses += taken[chosen].tolist()
        at = np.flatnonzero(take)
        seq = seq.copy()
        seq[at] = number[which[at]]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        top += int(chosen.sum())
    return Grammar(alphabet, rules, seq.tolist(), uses)


def sizes(sequence: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
    """Sizes of the grammars of many sequences at once. Sequences stand one after another; owner tells the sequence of each place. As no two
    sequences share a symbol, no pair of one occurs in another, and the joint grammar is that of each apart."""
    order = np.lexsort((sequence, owner))
    s, o = sequence[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1])
    symbol = np.empty(len(s), np.int64)
    symbol[order] = np.cumsum(new) - 1
    of = o[new]  # the sequence of each symbol
    g = infer_rounds(symbol, len(of))
    rules = np.array([left for left, _ in g.rules], np.int64)
    # a rule's sequence is that of its left symbol, which was made before it
    of = np.concatenate((of, np.zeros(len(rules), np.int64)))
    for i, left in enumerate(rules.tolist()):
        of[g.first + i] = of[left]
    return np.bincount(of[np.asarray(g.final, np.int64)], minlength=owners) + 2 * np.bincount(of[g.first :], minlength=owners)


def phrases(tokens: np.ndarray, owner: np.ndarray, least: int, levels: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, length) of the rules of at least `least` tokens in a locally consistent grammar over 64-bit token hashes; owner tells which of many
    sequences, one after another, a token is of.

    In each round a phrase ends before every symbol whose hash is a local minimum, and a phrase's symbol is a hash of its parts. Where a phrase ends depends
    on its close neighbours alone, so the same passage has the same rules in every file it stands in, and a rule is known by its hash without a
    common numbering.
    """
    sym = tokens.astype(np.uint64)
    start, n = np.arange(len(sym)), len(sym)
    out_h, out_s, out_n = [], [], []
    with np.errstate(over="ignore"):
        for level in range(levels):
            if len(sym) < 2:
                break
            begins = np.ones(len(sym), bool)
            begins[1:] = owner[1:] != owner[:-1]
            h = _mix(sym + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1))
            cut = begins.copy()
            inner = ~begins[1:-1] & ~begins[2:]
            cut[1:-1] |= inner & (h[1:-1] < h[:-2]) & (h[1:-1] <= h[2:])
            first = np.flatnonzero(cut)
            place = np.arange(len(sym)) - first[np.cumsum(cut) - 1]
            sym = _mix(np.add.reduceat(_mix(h + np.uint64(0xD1B54A32D192ED03) * place.astype(np.uint64)), first))
            start, owner = start[first], owner[first]
            length = np.diff(np.append(start, n))
            long = length >= least
            out_h.append(sym[long])
            out_s.append(start[long])
            out_n.append(length[long])
    if not out_h:
        z = np.zeros(0, np.int64)
        return z, z, z
    return np.concatenate(out_h).view(np.int64), np.concatenate(out_s), np.concatenate(out_n)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))

"""Whether a text quotes a passage: alignment of word sequences."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence


def longest_gap(least: int, kept: float) -> int:
    """Longest run of missing, exchanged or put-in words that a quote can need.

    If a run with a longer gap meets the rule, the part before or after the gap meets it too: both parts can only be short
    of it with fewer than ``least`` words each, and then 2 * (least - 1) agreeing words bear no more than this.
    """
    return int(2 * (least - 1) * (1 - kept) / kept + 1e-9)


def chain(pairs: list[tuple[int, int]], gap: int) -> list[tuple[int, int]]:
    """Best chain of agreeing words (place in the item, place in the text), both rising, with gaps of at most ``gap`` words.

    An agreeing word counts 1, every word of a gap, on the side that has more of them, costs 0.3.
    """
    pairs = sorted(pairs)
    at: dict[int, list[tuple[int, int]]] = {}  # item place -> (text place, index) in rising order
    score, back, best = [0.0] * len(pairs), [-1] * len(pairs), -1
    for n, (i, j) in enumerate(pairs):
        top, prev = 0.0, -1
        for di in range(1, gap + 2):
            row = at.get(i - di)
            if not row:
                continue
            k = bisect_left(row, (j, -1)) - 1
            while k >= 0 and j - row[k][0] <= gap + 1:
                s = score[row[k][1]] - 0.3 * (max(di, j - row[k][0]) - 1)
                if s > top:
                    top, prev = s, row[k][1]
                k -= 1
        score[n], back[n] = 1 + top, prev
        if best < 0 or score[n] > score[best]:
            best = n
        at.setdefault(i, []).append((j, n))
    out = []
    while best >= 0:
        out.append(pairs[best])
        best = back[best]
    return out[::-1]


def longest_quote(item: Sequence[int], text: Sequence[int], least: int, kept: float, stretch: float) -> float:
    """Best share of agreeing words over runs of at least ``least`` successive item words of which at least ``kept`` agree
    in order, within a stretch of the text at most ``stretch`` times as long; 0 if there is none."""
    where: dict[int, list[int]] = {}
    for i, w in enumerate(item):
        if w >= 0:
            where.setdefault(w, []).append(i)
    pairs = [(i, j) for j, w in enumerate(text) for i in where.get(w, ())]
    best, gap = 0.0, longest_gap(least, kept)
    while len(pairs) >= least * kept:
        path = chain(pairs, gap)
        if len(path) < least * kept:
            break
        for a in range(len(path)):
            ia, ja = path[a]
            for b in range(len(path) - 1, a, -1):
                span = path[b][0] - ia + 1
                if span < least:
                    break
                share = (b - a + 1) / span
                if share >= kept and share > best and path[b][1] - ja + 1 <= stretch * span:
                    best = share
        if best >= 1:
            break
        used = set(path)
        pairs = [p for p in pairs if p not in used]
    return best

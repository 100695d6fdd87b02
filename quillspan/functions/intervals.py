"""Intervals as numpy arrays, many documents of an Arrow batch at a time.

Positions of a document are moved behind those of the document before it, so that one sort and one binary search serve a
whole batch. Sweeps over sorted borders replace comparisons of each with each: costs follow the number of intervals and
of pairs that overlap.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PAIRS_AT_ONCE = 1 << 21


def lengths(lists: pa.Array) -> np.ndarray:
    """How many elements each list has, none for a null one."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def field(structs: pa.Array, name: str) -> np.ndarray:
    return structs.field(name).to_numpy(zero_copy_only=False)


def sliced(batches: Iterator[pa.RecordBatch], weigh: Callable[[pa.RecordBatch], np.ndarray], limit: int = 400_000) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the weights of a slice's rows come to `limit` at most; a heavier row is a slice alone."""
    for batch in batches:
        ends, at = np.cumsum(weigh(batch)), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 50_000, size: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold so many rows or bytes; empty ones go."""
    held: list[pa.RecordBatch] = []

    def joined() -> list[pa.RecordBatch]:
        return held if len(held) < 2 else pa.Table.from_batches(held).combine_chunks().to_batches()

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= size:
            yield from joined()
            held = []
    yield from joined()


def shifts(groups: int, *positions: np.ndarray) -> np.ndarray:
    """What to add to the positions of each group so that groups stand one behind the other."""
    some = [p for p in positions if len(p)]
    low, high = min((int(p.min()) for p in some), default=0), max((int(p.max()) for p in some), default=0)
    return np.arange(groups, dtype=np.int64) * (high - low + 2) - low


def met(starts: np.ndarray, ends: np.ndarray, from_: np.ndarray, to: np.ndarray) -> np.ndarray:
    """For each stretch [from_, to) whether an interval [start, end) overlaps it: of the intervals that begin before its
    end, some end after its start."""
    return np.searchsorted(np.sort(starts), to, "left") > np.searchsorted(np.sort(ends), from_, "right")


def overlapping(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray, slack: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of pairs (a, b) that can overlap. b is sorted by start; behind the running maximum of ends no earlier b
    reaches an a. slack: how far before a a b may begin at most."""
    reach = np.maximum.accumulate(b_end) if len(b_end) else b_end
    low, high = np.searchsorted(reach, a_start, "right"), np.searchsorted(b_start, a_end, "left")
    if slack is not None:
        low = np.maximum(low, np.searchsorted(b_start, a_start - slack, "left"))
    many = np.maximum(high - low, 0)
    total = np.cumsum(many)
    at = 0
    while at < len(many):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        for k in range(0, int(many[at]) if to == at + 1 else 1, PAIRS_AT_ONCE):
            n = many[at:to] if to > at + 1 else np.minimum(many[at:to] - k, PAIRS_AT_ONCE)
            a = np.repeat(np.arange(at, to), n)
            yield a, np.repeat(low[at:to] + k - (np.cumsum(n) - n), n) + np.arange(len(a))
        at = to


def _classes(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Equal intervals of a group as one: group, start, end, and the places of its members in rising order."""
    kept = np.flatnonzero(end > start)
    order = kept[np.lexsort((kept, end[kept], start[kept], group[kept]))]
    g, s, e = group[order], start[order], end[order]
    first = np.append(True, (g[1:] != g[:-1]) | (s[1:] != s[:-1]) | (e[1:] != e[:-1]))[: len(order)]
    heads = np.flatnonzero(first)
    return g[heads], s[heads], e[heads], order, heads, np.append(heads[1:], len(order))


def greedy_matches(gold: tuple, predicted: tuple, groups: int, threshold: float) -> tuple[list[int], list[int], list[float]]:
    """One-to-one matches inside groups by overlap over hull, best first; of equal scores the later gold comes first and
    takes the latest free prediction. gold, predicted: group, start, end. Returns places in both and scores.

    Equal intervals are matched as one class whose members are taken from behind, so that repeated spans cost no pairs."""
    if threshold <= 0:
        raise ValueError("the threshold must be above 0: spans that share nothing are no pairs")
    move = shifts(groups, gold[1], gold[2], predicted[1], predicted[2])
    ag, a_start, a_end, a_order, a_low, a_high = _classes(*gold)
    bg, b_start, b_end, b_order, b_low, b_high = _classes(*predicted)
    a_start, a_end, b_start, b_end = a_start + move[ag], a_end + move[ag], b_start + move[bg], b_end + move[bg]
    slack = np.ceil((a_end - a_start) * (1 / threshold - 1)).astype(np.int64) + 1
    found = []
    for a, b in overlapping(a_start, a_end, b_start, b_end, slack):
        shared = np.minimum(a_end[a], b_end[b]) - np.maximum(a_start[a], b_start[b])
        score = shared / (np.maximum(a_end[a], b_end[b]) - np.minimum(a_start[a], b_start[b]))
        good = (score >= threshold) & (shared > 0)
        found.append((a[good], b[good], score[good]))
    a, b, score = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((-score, ag[a]))
    a, b, score = a[order], b[order], score[order]
    level = np.append(True, (score[1:] != score[:-1]) | (ag[a][1:] != ag[a][:-1]))[: len(a)]
    heads = np.flatnonzero(level).tolist()
    a_of, b_of, scores, a_left, b_left = a.tolist(), b.tolist(), score.tolist(), a_high.tolist(), b_high.tolist()
    a_low, b_low, out_a, out_b, out_score = a_low.tolist(), b_low.tolist(), [], [], []

    def take(x: int, y: int, s: float) -> None:
        a_left[x] -= 1
        b_left[y] -= 1
        out_a.append(int(a_order[a_left[x]]))
        out_b.append(int(b_order[b_left[y]]))
        out_score.append(s)

    for k, to in zip(heads, [*heads[1:], len(a_of)], strict=True):
        if to == k + 1:
            x, y = a_of[k], b_of[k]
            while a_left[x] > a_low[x] and b_left[y] > b_low[y]:
                take(x, y, scores[k])
            continue
        near: dict[int, list[int]] = {}
        for x, y in zip(a_of[k:to], b_of[k:to], strict=True):
            if a_left[x] > a_low[x] and b_left[y] > b_low[y]:
                near.setdefault(x, []).append(y)
        heap = [(-int(a_order[a_left[x] - 1]), x) for x in near]
        heapq.heapify(heap)
        while heap:
            _, x = heapq.heappop(heap)
            near[x] = [y for y in near[x] if b_left[y] > b_low[y]]
            if near[x]:
                take(x, max(near[x], key=lambda y: b_order[b_left[y] - 1]), scores[k])
                if a_left[x] > a_low[x]:
                    heapq.heappush(heap, (-int(a_order[a_left[x] - 1]), x))
    return out_a, out_b, out_score

"""External induced sorting of one shard, as a plain version of the method named for op7.

Suffix tuples, each with the length of the prefix it shares with the one before (up to a bound), go
through priority queues that spill sorted runs to disk: first the suffixes that are greater than their
successor, from the least up, then the others, from the greatest down. The order of the leftmost
suffixes of the second kind comes from a recursion on the names of the stretches between them.
"""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Iterator


class DiskQueue:
    """A priority queue of tuples; what is over ``limit`` goes to disk as a sorted run."""

    def __init__(self, limit: int = 1 << 14):
        self.limit, self.heap, self.runs = limit, [], []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            file = tempfile.TemporaryFile()
            self.heap.sort()
            for at in range(0, len(self.heap), 256):
                pickle.dump(self.heap[at : at + 256], file)
            file.seek(0)
            self.heap = []
            run = self._read(file)
            heapq.heappush(self.runs, (next(run), len(self.runs), run))

    @staticmethod
    def _read(file) -> Iterator[tuple]:
        while True:
            try:
                yield from pickle.load(file)
            except EOFError:
                return

    def least(self) -> tuple | None:
        from_heap = self.heap[0] if self.heap else None
        return self.runs[0][0] if self.runs and (from_heap is None or self.runs[0][0] < from_heap) else from_heap

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            item, no, run = self.runs[0]
            following = next(run, None)
            heapq.heapreplace(self.runs, (following, no, run)) if following is not None else heapq.heappop(self.runs)
            return item
        return heapq.heappop(self.heap)


def shared(text: list[int], a: int, b: int, bound: int) -> int:
    n = 0
    while n < bound and max(a, b) + n < len(text) and text[a + n] == text[b + n]:
        n += 1
    return n


def induced(text: list[int], small: list[bool], seeds: list[tuple[int, int]], up: bool, bound: int) -> Iterator[tuple[int, int]]:
    """(suffix, shared prefix with the one before) of all suffixes of one kind that the seeds' predecessors lead to, in scan order.

    ``seeds`` are suffixes of the other kind in scan order. Of every letter the least shared prefix
    since its last push is kept, which is that of the two suffixes' successors.
    """
    sign = 1 if up else -1
    queue, since, count, i, last = DiskQueue(), {}, 0, 0, None

    def scan(at: int, common: int) -> None:
        nonlocal count
        if bound:
            for c in since:
                since[c] = min(since[c], common)
        before = at - 1
        if before >= 0 and small[before] != up:
            c = text[before]
            queue.push((sign * c, count, before, min(bound, since[c] + 1) if c in since else 0))
            if bound:
                since[c] = bound
        count += 1

    while True:
        head = queue.least()
        # Suffixes that are greater than their successor precede the others of the same letter.
        if head is not None and (i == len(seeds) or head[0] <= sign * text[seeds[i][0]]):
            _, _, at, common = queue.pop()
            yield at, common
        elif i < len(seeds):
            at, common = seeds[i]
            i += 1
        else:
            return
        scan(at, common if last is None or text[last] == text[at] and small[last] == small[at] else shared(text, last, at, bound))
        last = at


def suffix_order(text: list[int], bound: int) -> list[tuple[int, int]]:
    """(suffix, shared prefix with the one before up to ``bound``) in order; the text ends with a letter less than all others."""
    n = len(text)
    if n == 1:
        return [(0, 0)]
    small = [False] * n
    small[-1] = True
    for i in range(n - 2, -1, -1):
        small[i] = text[i] < text[i + 1] or text[i] == text[i + 1] and small[i + 1]
    stars = [i for i in range(1, n) if small[i] and not small[i - 1]]
    pieces = DiskQueue()
    for a, b in zip(stars, [*stars[1:], n - 1], strict=True):
        pieces.push((tuple((text[k], small[k]) for k in range(a, b + 1)), a))
    names, name, before = {}, -1, None
    for _ in stars:
        piece, at = pieces.pop()
        name += piece != before
        names[at], before = name, piece
    if name + 1 == len(stars):
        order = sorted(stars, key=names.get)
    else:
        order = [stars[i] for i, _ in suffix_order([names[i] for i in stars], 0)]
    seeds = [(at, shared(text, order[k - 1], at, bound) if k else 0) for k, at in enumerate(order)]
    larger = list(induced(text, small, seeds, True, bound))
    # Going down, each shared prefix belongs to the suffix scanned before.
    down = [(larger[k][0], larger[k + 1][1] if k + 1 < len(larger) else 0) for k in range(len(larger) - 1, -1, -1)]
    smaller = [(n - 1, 0), *list(induced(text, small, down, False, bound))[::-1]]
    merged = list(heapq.merge(((text[i], 0, k, i) for k, (i, _) in enumerate(larger)), ((text[i], 1, k, i) for k, (i, _) in enumerate(smaller))))
    order = [x[3] for x in merged]
    ups, downs = dict(larger), {}
    for (a, _), (b, common) in zip(smaller[::-1], smaller[::-1][1:], strict=False):
        downs[a] = common  # of a and the one below it
    out = []
    for k, at in enumerate(order):
        prior = order[k - 1] if k else None
        if prior is None or text[prior] != text[at]:
            out.append((at, 0))
        elif small[prior] != small[at]:
            out.append((at, shared(text, prior, at, bound)))
        else:
            out.append((at, ups[at] if not small[at] else downs[at]))
    return out


def removed_bytes(docs: list[tuple[int, bytes]], length: int = 50) -> dict[int, int]:
    """Bytes covered by strings that also start in a document with a smaller id."""
    text: list[int] = []
    owner: list[tuple[int, int]] = []
    for doc_id, raw in docs:
        text += [*(b + 2 for b in raw), 1]
        owner += [(doc_id, len(raw) - k) for k in range(len(raw) + 1)]
    text.append(0)
    owner.append((-1, 0))
    gone: dict[int, set[int]] = {i: set() for i, _ in docs}
    group: list[int] = []

    def settle() -> None:
        least = min((owner[p][0] for p in group), default=None)
        for p in group:
            doc_id, left = owner[p]
            if doc_id > least:
                gone[doc_id].update(range(left - length, left))  # counted from the end

    for at, common in suffix_order(text, length):
        if common < length:
            settle()
            group = []
        if owner[at][1] >= length:
            group.append(at)
    settle()
    return {i: len(x) for i, x in gone.items()}

"""External suffix sorting by induction, with capped common-prefix values.

A text of small integers (one unique smallest symbol at the end) is sorted as induced sorting
does: suffixes are of type L or S by their next differing symbol, the leftmost S suffixes (S*)
are named by their substrings and ordered by recursion on the shorter text of names, and all
others are induced from them, L suffixes in ascending and S suffixes in descending order.

What each step has yet to visit waits in a priority queue by first symbol, which hands out the
entries of a symbol in the order they came (induction finds them sorted). An entry is a tuple of
the suffix and its common prefix with the entry before it. Queues hold at most ``memory`` rows;
beyond that, their entries go to an unnamed scratch file of the task, as a sort's spill does,
which no other process reads. The text itself may be memory-mapped. In memory are the lists of S*
suffixes, about ten arrays of 8 bytes for each: callers keep a shard's text small enough for that. The text of names is sorted by doubling once it fits the same bound, else by
the same induction.

Common prefixes are carried along: two neighbours induced from x and y share one symbol more
than x and y do, and that is the least value between x and y in the order of their sources.
Everything is cut off at ``limit`` symbols, which also bounds the recursion's work.
"""

from __future__ import annotations

import heapq
import tempfile
from collections import deque
from collections.abc import Iterator

import numpy as np

from frauddeck.llm.common import run_hashes

MEMORY, CHUNK = 1 << 22, 1 << 18
NONE = 255  # no value between


class Queue:
    """Entries (suffix, common prefix) by symbol, smallest symbol first, spilled to a scratch file."""

    def __init__(self, memory: int):
        self.memory, self.held = memory, 0
        self.waiting: dict[int, deque] = {}
        self.symbols: list[int] = []
        self.file = None

    def push(self, symbols: np.ndarray, suffix: np.ndarray, common: np.ndarray) -> None:
        """Appends entries; those of one symbol keep their order. ``symbols`` ascending."""
        cut = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
        for s, e in zip(cut.tolist(), np.append(cut[1:], len(symbols)).tolist()):
            c = int(symbols[s])
            if c not in self.waiting:
                self.waiting[c] = deque()
                heapq.heappush(self.symbols, c)
            self.waiting[c].append((suffix[s:e], common[s:e]))
        self.held += len(symbols)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for c, parts in self.waiting.items():
            kept, rest = deque(), []
            for x in parts:
                if len(x) == 3:
                    kept.append(x)
                else:
                    rest.append(x)
            if rest:
                at = self.file.tell()
                suffix, common = (np.concatenate(y) for y in zip(*rest))
                suffix.astype("<i8").tofile(self.file)
                common.tofile(self.file)
                kept.append((at, len(suffix), None))
            self.waiting[c] = kept
        self.held = 0

    def _load(self, at: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        self.file.seek(at)
        return np.fromfile(self.file, "<i8", n), np.fromfile(self.file, np.uint8, n)

    def first(self) -> int | None:
        """The smallest symbol that waits."""
        while self.symbols and not self.waiting.get(self.symbols[0]):
            self.waiting.pop(heapq.heappop(self.symbols), None)
        return self.symbols[0] if self.symbols else None

    def take(self, symbol: int, last: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
        """Some of the oldest (or newest) entries of a symbol, in the order they came."""
        parts = self.waiting.get(symbol)
        if not parts:
            return None
        got, n = [], 0
        while parts and n < CHUNK:
            x = parts.pop() if last else parts.popleft()
            if len(x) == 3:
                x = self._load(x[0], x[1])
            else:
                self.held -= len(x[0])
            got.append(x)
            n += len(x[0])
        if last:
            got.reverse()
        return got[0] if len(got) == 1 else tuple(np.concatenate(y) for y in zip(*got))


class _Carry:
    """Common prefixes of induced neighbours: the least value since a symbol was last induced."""

    def __init__(self, alphabet: int, limit: int):
        self.least, self.limit = np.zeros(alphabet, np.uint8), limit

    def __call__(self, adjacent: np.ndarray, order: np.ndarray, target: np.ndarray) -> np.ndarray:
        """For entries ``order`` (positions in the batch, ascending for each ``target``, sorted by it)."""
        new = np.concatenate([[True], target[1:] != target[:-1]])
        begin = np.where(new, 0, np.concatenate([[0], order[:-1]]) + 1)
        pair = np.empty(2 * len(order), np.int64)
        pair[::2], pair[1::2] = begin, order + 1
        value = np.minimum.reduceat(np.append(adjacent, np.uint8(NONE)), pair)[::2]
        value = np.where(new, np.minimum(value, self.least[target]), value)
        after = np.append(np.minimum.accumulate(adjacent[::-1])[::-1], np.uint8(NONE))
        np.minimum(self.least, after[0], out=self.least)
        last = np.flatnonzero(np.concatenate([new[1:], [True]]))
        self.least[target[last]] = after[order[last] + 1]
        return np.minimum(value.astype(np.int64) + 1, self.limit).astype(np.uint8)


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Common prefixes of pairs of suffixes, cut off at ``limit`` (compared symbol by symbol)."""
    out, on = np.zeros(len(a), np.uint8), np.arange(len(a))
    n = len(text)
    for k in range(limit):
        if not len(on):
            break
        x, y = a[on] + k, b[on] + k
        inside = (x < n) & (y < n)
        on = on[inside]
        on = on[text[x[inside]] == text[y[inside]]]
        out[on] = k + 1
    return out


def _pass(text, seeds, common, limit, memory, carry) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Induces all suffixes from sorted S* ones; yields them in descending order, by batches.

    A batch is suffixes, their common prefix with the suffix yielded before, whether they are of
    type S, and the symbol before each (-1 at the start). ``seeds`` are by ascending first symbol.
    """
    alphabet = int(text.max()) + 1 if carry else 0
    ahead, back, todo = _Carry(alphabet, limit), _Carry(alphabet, limit), Queue(memory)
    done = Queue(memory)  # L suffixes found, by symbol
    first = text[seeds]
    cut = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])) if len(seeds) else np.zeros(0, np.int64)
    of = dict(zip(first[cut].tolist(), zip(cut.tolist(), np.append(cut[1:], len(seeds)).tolist())))
    symbols = sorted(of, reverse=True)

    def direct(a, b):
        return common_prefix(text, np.array([a]), np.array([b]), limit)[0] if carry else 0

    def induce(queue, carried, suffix, adjacent, chosen, before):
        at = np.flatnonzero(chosen)
        if not len(at) and not carry:
            return
        target = before[at]
        order = np.argsort(target, kind="stable")
        at, target = at[order], target[order]
        if not carry:
            queue.push(target, suffix[at] - 1, np.zeros(len(at), np.uint8))
        elif len(at):
            queue.push(target, suffix[at] - 1, carried(adjacent, at, target))
        elif len(adjacent):
            np.minimum(carried.least, adjacent.min(), out=carried.least)

    def preceding(suffix):
        return np.where(suffix > 0, text[np.maximum(suffix, 1) - 1].astype(np.int64), -1)

    while True:  # ascending: L suffixes of a symbol, then its S* suffixes
        c = todo.first()
        if symbols and (c is None or symbols[-1] < c):
            c = symbols[-1]
        if c is None:
            break
        last, begun = None, False
        while (got := todo.take(c)) is not None:
            suffix, adjacent = got
            if not begun:
                adjacent = adjacent.copy()
                adjacent[0], begun = 0, True  # the source before it begins with a smaller symbol
            last = int(suffix[-1])
            done.push(np.full(len(suffix), c), suffix, adjacent)
            before = preceding(suffix)
            induce(todo, ahead, suffix, adjacent, before >= c, before)
        if symbols and symbols[-1] == c:
            symbols.pop()
            s, e = of[c]
            for a in range(s, e, CHUNK):
                suffix, adjacent = seeds[a:min(a + CHUNK, e)], common[a:min(a + CHUNK, e)]
                if a == s:
                    adjacent = adjacent.copy()
                    adjacent[0] = 0 if last is None else direct(last, int(suffix[0]))
                before = preceding(suffix)
                induce(todo, ahead, suffix, adjacent, before > c, before)

    found = Queue(memory)  # S suffixes; symbols are negated, so that the largest comes first
    left = sorted(done.waiting, reverse=True)
    while True:
        c = found.first()
        c = None if c is None else -c
        if left and (c is None or left[0] > c):
            c = left[0]
        if c is None:
            return
        last = None
        while (got := found.take(-c)) is not None:
            suffix, adjacent = got
            if last is None:
                adjacent = adjacent.copy()
                adjacent[0] = 0
            last = int(suffix[-1])
            before = preceding(suffix)
            yield suffix, adjacent, np.ones(len(suffix), bool), before
            induce(_Negated(found), back, suffix, adjacent, (before <= c) & (before >= 0), before)
        if left and left[0] == c:
            left.pop(0)
            link = None  # common prefix with the L suffix above, told by that one's own entry
            while (got := done.take(c, last=True)) is not None:
                suffix, up = got[0][::-1], got[1][::-1]
                adjacent = np.empty(len(up), np.uint8)
                adjacent[1:] = up[:-1]
                adjacent[0] = link if link is not None else 0 if last is None else direct(last, int(suffix[0]))
                link = up[-1]
                before = preceding(suffix)
                yield suffix, adjacent, np.zeros(len(suffix), bool), before
                induce(_Negated(found), back, suffix, adjacent, (before < c) & (before >= 0), before)


class _Negated:
    def __init__(self, queue):
        self.queue = queue

    def push(self, symbols, suffix, common):
        starts = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
        for s, e in zip(starts.tolist(), np.append(starts[1:], len(symbols)).tolist()):
            self.queue.push(-symbols[s:e].astype(np.int64), suffix[s:e], common[s:e])


def _leftmost(text: np.ndarray) -> np.ndarray:
    """Positions of the S* suffixes, the end symbol's included."""
    n = len(text)
    out, nxt = [], True  # type (S) of the position after the block
    for b in range(n, 0, -CHUNK * 4):
        a = max(b - CHUNK * 4, 0)
        x = text[a:min(b + 1, n)].astype(np.int64)
        k = b - a
        sign = np.sign(x[1:] - x[:-1]) if b < n else np.append(np.sign(x[1:] - x[:-1]), -1)  # the end counts as S below
        kind = sign[:k]
        if b == n:
            kind[k - 1] = 1
        at = np.where(kind != 0, np.arange(k), k)  # the next position that decides
        at = np.minimum.accumulate(at[::-1])[::-1]
        small = np.where(at < k, kind[np.minimum(at, k - 1)] > 0, nxt)
        prior = np.concatenate([[False], ~small[:-1]])
        if a > 0:  # the type of a - 1: L if its symbol is larger, or equal and the next is L
            prior[0] = text[a - 1] > text[a] or (text[a - 1] == text[a] and not small[0])
        out.append(np.flatnonzero(small & prior) + a)
        nxt = bool(small[0])
    return np.concatenate(out[::-1]) if out else np.zeros(0, np.int64)


def _doubled(names: np.ndarray, symbols: int) -> np.ndarray:
    """Suffixes of ``names`` in the order of their first ``symbols`` symbols, by doubling."""
    rank, k, n = names.astype(np.int64), 1, len(names)
    while True:
        second = np.zeros(n, np.int64)
        second[:n - k] = rank[k:] + 1
        key = (rank << 32) | second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))
        rank, k = new, 2 * k
        if k >= symbols or k >= n or rank[order[-1]] == n - 1:
            return order


def _sorted_leftmost(text: np.ndarray, limit: int, memory: int) -> np.ndarray:
    """The S* suffixes of ``text`` in order (of their first ``limit`` symbols at least)."""
    at = _leftmost(text)
    if len(at) < 2:
        return at
    seeds = at[np.argsort(text[at], kind="stable")]
    parts = [s[kind & (before > text[s])] for s, _, kind, before in _pass(text, seeds, np.zeros(len(seeds), np.uint8), limit, memory, False)]
    order = np.concatenate([[len(text) - 1], *[x[::-1] for x in parts[::-1]]]).astype(np.int64)
    order = order[np.concatenate([[True], order[1:] != len(text) - 1])]
    # names: equal substrings up to and with the next S* symbol have one name
    whole = run_hashes(text, at[:-1], at[1:])
    tail = text[at[1:]].astype(np.uint64)
    size = np.diff(at)
    place = np.searchsorted(at, order)
    h = np.append(whole ^ (tail * np.uint64(0x9E3779B97F4A7C15)), np.uint64(0))[place]
    n = np.append(size, 0)[place]
    names = np.empty(len(at), np.int64)
    names[place] = np.cumsum(np.concatenate([[0], (h[1:] != h[:-1]) | (n[1:] != n[:-1])]))
    if names[place[-1]] == len(at) - 1:
        return order
    symbols = limit // 2 + 2  # an S* substring spans two symbols at least
    return at[_doubled(names, symbols) if len(names) <= memory else suffixes(names, symbols, memory)]


def suffixes(text: np.ndarray, limit: int, memory: int = MEMORY) -> np.ndarray:
    """All suffixes in order (of their first ``limit`` symbols at least)."""
    seeds = _sorted_leftmost(text, limit, memory)
    parts = [s for s, _, _, _ in _pass(text, seeds, np.zeros(len(seeds), np.uint8), limit, memory, False)]
    out = np.concatenate([[len(text) - 1], *[x[::-1] for x in parts[::-1]]]).astype(np.int64)
    return out[np.concatenate([[True], out[1:] != len(text) - 1])]


def neighbours(text: np.ndarray, limit: int, memory: int = MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of suffixes in descending order and their common prefixes with the one before."""
    seeds = _sorted_leftmost(text, limit, memory)
    common = np.zeros(len(seeds), np.uint8)
    for a in range(1, len(seeds), CHUNK):
        b = min(a + CHUNK, len(seeds))
        common[a:b] = common_prefix(text, seeds[a - 1:b - 1], seeds[a:b], limit)
    for suffix, adjacent, _, _ in _pass(text, seeds, common, limit, memory, True):
        yield suffix, adjacent


def repeats(text: np.ndarray, limit: int, memory: int = MEMORY) -> Iterator[np.ndarray]:
    """Batches of the suffixes whose first ``limit`` symbols also begin at a smaller position."""
    least = None  # smallest suffix of the group that the last batch ended in
    for suffix, adjacent in neighbours(text, limit, memory):
        new = adjacent < limit
        if least is not None and not new[0]:
            suffix, new = np.append(least, suffix), np.append(True, new)
        else:
            new = new.copy()
            new[0] = True
        first = np.flatnonzero(new)
        low = np.minimum.reduceat(suffix, first)
        least = low[-1]
        yield suffix[suffix != np.repeat(low, np.diff(np.append(first, len(suffix))))]

"""External induced sorting of suffixes with their common prefixes.

Suffixes are L (greater than the next one) or S (smaller); an S after an L is a seed. Seeds are named by the order of the
substrings that reach to the next seed, and if names repeat, the text of the names is sorted by recursion, which also gives
common prefixes of seeds; a text of names that fits the budget ends it and is sorted in memory, and seeds are compared for theirs. Then L suffixes are induced from the seeds in ascending order and S suffixes from the L ones in
descending order: whoever comes out of the priority queue puts the suffix before it in.

Tuples are (symbol, place, common prefix with the tuple before it). A symbol's tuples come out in the order in which they
came in, so the queue is one first-in-first-out queue for each range of symbols, sorted by symbol when its turn comes. A tuple's
common prefix is one more than the least value passed since the last tuple of its symbol.

What is in memory: ``budget`` tuples of the queues, beyond which they are written to a scratch file and read back block by
block, one range of symbols, and four numbers a symbol. Text, types, names and sorted seeds of every level lie in mapped scratch
files, which the system may drop from memory at any time. Scratch files have no name and go with the process.

Order and values are exact up to ``depth`` symbols, which is all that matches of ``depth`` need. If only some places are asked for,
all seeds are sorted, but only those induce from which an asked place comes.
"""

from __future__ import annotations

import tempfile
from collections import deque
from collections.abc import Iterator

import numpy as np

#: Tuples held by the queues of a level; places of a scan in memory at a time.
BUDGET = 1 << 22
BLOCK = 1 << 18


def room(n: int, kind) -> np.ndarray:
    """Zeros in a mapped scratch file."""
    if n * np.dtype(kind).itemsize <= 1 << 16:
        return np.zeros(n, kind)
    with tempfile.TemporaryFile() as f:
        return np.asarray(np.memmap(f, kind, "w+", shape=(n,)))


class Queues:
    """First-in-first-out queues of (symbol, place, common prefix)."""

    kinds = (np.int32, np.int64, np.uint8)

    def __init__(self, n: int, budget: int):
        self.parts: list[deque] = [deque() for _ in range(n)]
        self.size = np.zeros(n, np.int64)
        self.inside, self.budget, self.file, self.spilled = 0, budget, None, 0

    def push(self, q: int, *columns: np.ndarray) -> None:
        self.parts[q].append(columns)
        self.size[q] += len(columns[0])
        self.inside += len(columns[0])
        if self.inside > self.budget:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        for parts in self.parts:
            held = [p for p in parts if not isinstance(p[0], int)]
            if held:
                whole = [np.concatenate([p[k] for p in held]) for k in range(3)]
                at = self.file.seek(0, 2)
                for x, kind in zip(whole, self.kinds, strict=True):
                    self.file.write(np.ascontiguousarray(x, kind).tobytes())
                n = len(whole[0])
                spilled = [p for p in parts if isinstance(p[0], int)]  # what was written earlier came in earlier
                parts.clear()
                parts.extend([*spilled, (at, n, 0)])
                self.spilled += n
        self.inside = 0

    def pop(self, q: int, most: int) -> tuple[np.ndarray, ...]:
        """The next tuples of a queue, ``most`` at a time."""
        got, parts = [], self.parts[q]
        while most and parts:
            part = parts.popleft()
            if isinstance(part[0], int):
                at, n, start = part
                count = min(most, n - start)
                out = []
                for kind in self.kinds:
                    size = np.dtype(kind).itemsize
                    self.file.seek(at + start * size)
                    out.append(np.frombuffer(self.file.read(count * size), kind))
                    at += n * size
                if start + count < n:
                    parts.appendleft((part[0], n, start + count))
            else:
                count = min(most, len(part[0]))
                out = [x[:count] for x in part]
                self.inside -= count
                if len(part[0]) > count:
                    parts.appendleft(tuple(x[count:] for x in part))
            got.append(out)
            most -= count
            self.size[q] -= count
        if len(got) == 1:
            return tuple(got[0])
        return tuple(np.concatenate([g[k] for g in got]) if got else np.zeros(0, kind) for k, kind in enumerate(self.kinds))

    def rest(self, q: int) -> tuple[np.ndarray, ...]:
        """All tuples of a queue."""
        return self.pop(q, 1 << 62)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of pairs of suffixes; of bytes eight at a time as far as the text goes."""
    out = np.zeros(len(a), np.int64)
    on = np.arange(len(a))
    if text.dtype == np.uint8 and len(text) >= 8:
        words, late = np.lib.stride_tricks.sliding_window_view(text, 8), []
        for k in range(0, depth, 8):
            x, y = a[on] + k, b[on] + k
            inside = np.maximum(x, y) < len(words)
            if not inside.all():
                late.append(on[~inside])
                on, x, y = on[inside], x[inside], y[inside]
            differ = (words[x].view("<u8") ^ words[y].view("<u8"))[:, 0]
            same = differ == 0
            ended, differ = on[~same], differ[~same]
            out[ended] = k + np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) // 8
            on = on[same]
            out[on] = k + 8
            if not len(on):
                break
        on = np.concatenate(late) if late else on[:0]
    while len(on):
        x, y = a[on] + out[on], b[on] + out[on]
        inside = (np.maximum(x, y) < len(text)) & (out[on] < depth)
        on, x, y = on[inside], x[inside], y[inside]
        on = on[text[x] == text[y]]
        out[on] += 1
    return np.minimum(out, depth, out=out)


def _least_between(lcp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min(lcp[a..b]), both included, by a table of powers of two."""
    level = np.log2(np.maximum(b - a, 0) + 1).astype(np.uint8)
    out = np.empty(len(a), lcp.dtype)
    table = lcp
    for k in range(int(level.max()) + 1):
        here = np.flatnonzero(level == k)
        if len(here):
            out[here] = np.minimum(table[a[here]], table[b[here] - (1 << k) + 1])
        if len(table) > 1 << k:
            table = np.minimum(table[: len(table) - (1 << k)], table[1 << k :])
    return out


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted numbers."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


class _Ranges:
    """Ranges of symbols that are sorted at a time: about ``size`` places each, or one symbol."""

    def __init__(self, counts: np.ndarray, size: int):
        if len(counts) <= 256:
            first = np.arange(len(counts))
        else:
            heavy = counts >= size
            step = np.cumsum(np.where(heavy, 0, counts)) // size
            first = np.flatnonzero(np.concatenate(([True], (step[1:] != step[:-1]) | heavy[1:] | heavy[:-1])))
        self.edges = np.append(first, len(counts))
        self.of = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(self.edges))
        self.number = len(first)


class _Induction:
    """One direction over all ranges: ``up`` gives L suffixes from seeds, else S suffixes from L ones."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, ranges: _Ranges, symbols: int, depth: int, budget: int, up: bool):
        self.text, self.wanted, self.ranges, self.depth, self.up = text, wanted, ranges, depth, up
        self.queues = Queues(ranges.number, budget)
        self.block = max(1, min(BLOCK, budget))
        self.after = np.zeros(symbols, np.uint8)  # least value after the last tuple of each symbol in the call that made it
        self.call = np.full(symbols, -1, np.int32)  # that call
        self.calls = 0
        self.stack: list[tuple[int, int]] = []  # (call, least value from it on), ascending in both

    def take(self, at: np.ndarray, lcp: np.ndarray) -> None:
        """Puts in the suffixes before these, which come next in the order; ``lcp``: common prefixes with the one before."""
        if not len(at):
            return
        lcp = lcp.astype(np.uint8, copy=False)
        before = at - 1
        chosen = np.flatnonzero((at > 0) & self.wanted[before])
        if len(chosen):
            where = before[chosen]
            symbol = self.text[where]
            order = np.argsort(symbol, kind="stable")  # bytes are sorted by radix
            symbol = symbol.astype(np.int64)
            k, s = chosen[order], symbol[order]
            first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            since = np.concatenate(([0], k[:-1] + 1))
            since[first] = 0
            value = _least_between(lcp, since, k)
            names = s[first]
            calls, least = (np.array(x, np.int64) for x in zip(*self.stack, (1 << 60, 255), strict=True)) if self.stack else (np.array([1 << 60]), np.array([255]))
            since_then = least[np.searchsorted(calls, self.call[names], side="right")]
            value[first] = np.minimum(value[first], np.minimum(since_then, self.after[names]))
            value = np.minimum(value, self.depth - 1) + np.uint8(1)
            last = k[np.append(first[1:], len(k)) - 1] + 1
            tail = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.uint8(255))
            self.after[names], self.call[names] = tail[last], self.calls
            lcp_of = np.empty(len(chosen), np.uint8)
            lcp_of[order] = value
            range_of = self.ranges.of[symbol]
            deal = order if self.ranges.number == len(self.ranges.of) else np.argsort(range_of, kind="stable")
            q = range_of[deal]
            cuts = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1], [True])))
            columns = symbol[deal].astype(np.int32), where[deal], lcp_of[deal]
            for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                self.queues.push(int(q[a]), *(c[a:b] for c in columns))
        least = int(lcp.min())
        while self.stack and self.stack[-1][1] >= least:
            self.stack.pop()
        self.stack.append((self.calls, least))
        self.calls += 1

    def one(self, q: int, others: Iterator) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """A range of one symbol, block by block: its queue, which grows meanwhile, then the others."""
        last = None
        while self.queues.size[q]:
            _, at, lcp = self.queues.pop(q, self.block)
            lcp = lcp.copy()
            if last is None:
                lcp[0] = 0
            last = at[-1:]
            yield "own", at, lcp
            self.take(at, lcp)
        start = True
        for at, lcp in others:
            if start:
                lcp = lcp.copy()
                lcp[0] = 0 if last is None else _common(self.text, last, at[:1], self.depth)[0]
                start = False
            yield "other", at, lcp
            self.take(at, lcp)

    def many(self, q: int, others: Iterator) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """A range of many symbols: as many of them at a time as put nothing into each other."""
        got = list(others)
        o_at, o_lcp = (np.concatenate([g[k] for g in got]) if got else np.zeros(0, kind) for k, kind in ((0, np.int64), (1, np.uint8)))
        o_key = self._key(self.text[o_at].astype(np.int64))
        key, at, lcp = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
        while True:
            s, more, more_lcp = self.queues.rest(q)
            key, at, lcp = np.concatenate((key, self._key(s.astype(np.int64)))), np.concatenate((at, more)), np.concatenate((lcp, more_lcp))
            if not len(key) + len(o_key):
                return
            order = np.argsort(key, kind="stable")
            key, at, lcp = key[order], at[order], lcp[order]
            end, alone = self._end(q, np.concatenate((key, o_key)), np.concatenate((at, o_at)))
            a, b = int(np.searchsorted(key, end)), int(np.searchsorted(o_key, end))
            if alone:
                yield from self._alone(q, (key[:a], at[:a], lcp[:a]), iter([(o_at[:b], o_lcp[:b])] if b else ()))
            else:
                own, rest = lcp[:a].copy(), o_lcp[:b].copy()
                own[_firsts(key[:a])] = 0
                first = _firsts(o_key[:b])
                before = np.searchsorted(key[:a], o_key[first], side="right") - 1
                met = (before >= 0) & (key[np.maximum(before, 0)] == o_key[first]) if a else np.zeros(len(first), bool)
                rest[first] = 0
                rest[first[met]] = _common(self.text, at[before[met]], o_at[first[met]], self.depth)
                merged = np.argsort(np.concatenate((2 * key[:a], 2 * o_key[:b] + 1)), kind="stable")
                all_at, all_lcp, mine = np.concatenate((at[:a], o_at[:b]))[merged], np.concatenate((own, rest))[merged], merged < a
                self.take(all_at, all_lcp)
                yield "mixed", all_at, np.stack((all_lcp, mine))
            key, at, lcp, o_key, o_at, o_lcp = key[a:], at[a:], lcp[a:], o_key[b:], o_at[b:], o_lcp[b:]

    def _alone(self, q: int, own, others):
        """The first symbol of a range by itself, since its suffixes follow each other."""
        key, at, lcp = own
        s = self._key(key).astype(np.int32)
        later = self.queues.rest(q)
        if len(at):
            self.queues.push(q, s, at, lcp)
        symbol = int(s[0]) if len(at) else None
        kept = [later]
        last = None
        while self.queues.size[q]:
            sym, at, lcp = self.queues.rest(q)
            same = sym == symbol
            kept.append((sym[~same], at[~same], lcp[~same]))
            at, lcp = at[same], lcp[same].copy()
            if not len(at):
                break
            if last is None:
                lcp[0] = 0
            last = at[-1:]
            yield "own", at, lcp
            self.take(at, lcp)
        for at, lcp in others:
            lcp = lcp.copy()
            lcp[0] = 0 if last is None else _common(self.text, last, at[:1], self.depth)[0]
            yield "other", at, lcp
            self.take(at, lcp)
        new = self.queues.rest(q)
        for part in [*kept, new]:
            if len(part[0]):
                self.queues.push(q, *part)

    def _key(self, symbol: np.ndarray) -> np.ndarray:
        """Symbols so that the direction is ascending; its own inverse."""
        return symbol if self.up else -symbol

    def _end(self, q: int, key: np.ndarray, at: np.ndarray) -> tuple[int, bool]:
        """Where the symbols end that can be taken together, and whether that is one symbol that puts tuples into itself."""
        before = np.maximum(at - 1, 0)
        puts = (at > 0) & self.wanted[before]
        symbol = self.text[before].astype(np.int64)
        puts &= self.ranges.of[symbol] == q
        target = np.where(puts, self._key(symbol), 1 << 60)
        order = np.argsort(key, kind="stable")
        key, target = key[order], target[order]
        own = np.flatnonzero(target == key)
        if len(own) and key[own[0]] == key[0]:
            return int(key[0]) + 1, True
        end = int(key[own[0]]) if len(own) else 1 << 60
        hit = np.flatnonzero(np.minimum.accumulate(target) <= key)
        return (min(end, int(key[hit[0]])) if len(hit) else end), False

    def run(self, q: int, others: Iterator) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        single = self.ranges.edges[q + 1] - self.ranges.edges[q] == 1
        return self.one(q, others) if single else self.many(q, others)


def _types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is S, by blocks from the end."""
    n = len(text)
    small = room(n, bool)
    ahead, state = -1, False  # the end is smaller than any symbol
    for stop in range(n, 0, -BLOCK):
        start = max(0, stop - BLOCK)
        here = text[start:stop].astype(np.int64)
        rise = np.sign(np.append(here[1:], ahead) - here)
        place = np.where(rise != 0, np.arange(len(here)), len(here))
        nearest = np.minimum.accumulate(place[::-1])[::-1]
        found = nearest < len(here)
        small[start:stop] = np.where(found, rise[np.minimum(nearest, len(here) - 1)] > 0, state)
        ahead, state = int(here[0]), bool(small[start])
    return small


def _seeds(small: np.ndarray) -> np.ndarray:
    found = []
    for a in range(1, len(small), BLOCK):
        b = min(len(small), a + BLOCK)
        found.append(np.flatnonzero(small[a:b] & ~small[a - 1 : b - 1]) + a)
    out = room(sum(map(len, found)), np.int64)
    out[:] = np.concatenate(found) if found else 0
    return out


def _names(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, ranges: _Ranges, symbols: int, depth: int, budget: int) -> tuple[np.ndarray, int]:
    """The name of each seed: the rank of its substring up to the next seed, types included. Ranges of first symbols are sorted one by one."""
    m, n = len(seeds), len(text)
    queues = Queues(ranges.number, budget)
    for a in range(0, m, BLOCK):
        own = ranges.of[text[seeds[a : a + BLOCK]]]
        deal = np.argsort(own, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], own[deal][1:] != own[deal][:-1], [True])))
        for x, y in zip(cuts, cuts[1:], strict=False):
            part = deal[x:y]
            queues.push(int(own[part[0]]), np.zeros(len(part), np.int32), part + a, np.zeros(len(part), np.uint8))
    names, made = room(m, np.int32), 0
    bits = int(2 * symbols + 2).bit_length()
    per = 64 // bits
    codes = room(n, np.uint16 if bits <= 16 else np.int64)
    for a in range(0, n, BLOCK):
        codes[a : a + BLOCK] = 2 * text[a : a + BLOCK].astype(np.int64) + small[a : a + BLOCK] + 1
    for q in range(ranges.number):
        _, k, _ = queues.rest(q)
        if not len(k):
            continue
        start = seeds[k]
        length = np.minimum(np.where(k + 1 < m, seeds[np.minimum(k + 1, m - 1)] + 1, n) - start, depth + 1)
        group, order = np.zeros(len(k), np.int64), np.arange(len(k))
        alike, done = np.arange(len(k)), 0
        while len(alike):
            rows = order[alike]
            word = np.zeros(len(rows), np.uint64)
            for j in range(done, done + per):
                inside = j < length[rows]
                at = np.minimum(start[rows] + j, n - 1)
                word = (word << np.uint64(bits)) | np.where(inside, codes[at], 0).astype(np.uint64)
            g = group[alike]
            by = np.lexsort((word, g)) if done else np.argsort(word)
            order[alike], word = rows[by], word[by]
            near = g[1:] == g[:-1]
            part = near & (word[1:] != word[:-1])
            split = np.zeros(len(k), np.int64)
            split[alike[1:][part]] = 1
            group += np.cumsum(split)
            done += per
            held = near & ~part & (length[order[alike[1:]]] > done)
            alike = alike[np.concatenate((held, [False])) | np.concatenate(([False], held))]
        names[k[order]] = group + made
        made += int(group[-1]) + 1
    queues.close()
    return names, made


def _needed(seeds: np.ndarray, asked: np.ndarray | None) -> np.ndarray:
    """Which seeds give an asked place: a seed gives the places from the seed before it on."""
    need = room(len(seeds), bool)
    if asked is None:
        need[:] = True
        return need
    number, count = 0, np.zeros(len(asked) // BLOCK + 2, np.int64)  # of asked places before each block
    for k, a in enumerate(range(0, len(asked), BLOCK)):
        number += int(np.count_nonzero(asked[a : a + BLOCK]))
        count[k + 1] = number
    passed = 0
    for a in range(0, len(seeds), BLOCK):
        part = seeds[a : a + BLOCK]
        below = np.empty(len(part), np.int64)  # asked places before the seed
        for k in range(int(part[0]) // BLOCK, int(part[-1]) // BLOCK + 1):
            x, y = np.searchsorted(part, (k * BLOCK, (k + 1) * BLOCK))
            sums = np.concatenate(([0], np.cumsum(asked[k * BLOCK : (k + 1) * BLOCK])))
            below[x:y] = count[k] + sums[part[x:y] - k * BLOCK]
        need[a : a + BLOCK] = np.diff(below, prepend=passed) > 0
        passed = int(below[-1])
    return need


def _sorted_seeds(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, need: np.ndarray, ranges: _Ranges, symbols: int, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Needed seeds in order, and common prefixes with the one before."""
    m = len(seeds)
    if not m:
        return seeds, np.zeros(0, np.uint8)
    names, made = _names(text, small, seeds, ranges, symbols, depth, budget)
    order, same = room(m, np.int64), room(m, np.uint8)
    inner = depth // 2 + 1  # a name stands for two symbols at least
    if made == m:
        order[names] = np.arange(m)
    elif m <= budget:
        order[:] = _in_memory(names, inner)
    else:
        end = m
        for at, lcp in descending(names, made, inner, budget):
            # a tuple's value is with its greater neighbour, so it belongs to that one here
            order[end - len(at) : end] = at[::-1]
            if end < m:
                same[end] = lcp[0]
            same[end - len(at) + 1 : end] = lcp[:0:-1]
            end -= len(at)
    count = int(np.count_nonzero(need))
    out, common, done = room(count, np.int64), room(count, np.uint8), 0
    last, least = np.zeros(0, np.int64), 255  # the needed one before, the least value since
    for a in range(0, m, BLOCK):
        k, l = order[a : a + BLOCK], same[a : a + BLOCK]
        hit = np.flatnonzero(need[k])
        if not len(hit):
            least = min(least, int(l.min()))
            continue
        values = np.minimum.reduceat(l[: hit[-1] + 1], np.concatenate(([0], hit[:-1] + 1))).astype(np.int64)
        values[0] = min(values[0], least)
        least = int(l[hit[-1] + 1 :].min(initial=255))
        k, l = k[hit], values
        before = np.concatenate((last if len(last) else k[:1], k[:-1]))
        x, y = np.minimum(k + l, m - 1), np.minimum(before + l, m - 1)
        known = np.minimum(np.where((k + l < m) & (before + l < m), seeds[x] - seeds[k], 0), depth)
        known = np.minimum(known, np.where(l > 0, depth, 0))
        more = _common(text, seeds[k] + known, seeds[before] + known, depth)
        out[done : done + len(k)], common[done : done + len(k)] = seeds[k], np.minimum(known + more, depth)
        done, last = done + len(k), k[-1:]
    if count:
        common[0] = 0
    return out, common


def _parts(pos: np.ndarray, lcp: np.ndarray, a: int, b: int, up: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places a..b with their values, block by block, in the direction; values are with the neighbour that came before in it."""
    if up:
        for k in range(a, b, BLOCK):
            yield pos[k : min(b, k + BLOCK)], lcp[k : min(b, k + BLOCK)]
        return
    for k in range(b, a, -BLOCK):
        low = max(a, k - BLOCK)
        later = lcp[low + 1 : k + 1]
        later = np.append(later, np.uint8(0)) if k == len(lcp) else later
        yield pos[low:k][::-1], later[::-1]


def _in_memory(text: np.ndarray, depth: int) -> np.ndarray:
    """The recursion's end: suffixes in order, by doubling ranks, for a text that fits the budget."""
    n, width = len(text), 1
    order = np.argsort(text)
    rank, alike, key = np.empty(n, np.int64), np.arange(n), text[order]
    while True:  # a suffix's rank is the place of the first of its group; only groups of several are sorted on
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        first = np.flatnonzero(fresh)
        rank[order[alike]] = alike[np.repeat(first, np.diff(np.append(first, len(alike))))]
        several = np.repeat(np.diff(np.append(first, len(alike))) > 1, np.diff(np.append(first, len(alike))))
        alike = alike[several]
        if width >= depth or not len(alike):
            break
        at = order[alike]
        after = at + width
        key = rank[at] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key)
        order[alike], key, width = at[by], key[by], 2 * width
    return order


def descending(text: np.ndarray, symbols: int, depth: int, budget: int = BUDGET, asked: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (places, values): all suffixes from the greatest on, each with its common prefix with the one before it here.

    ``asked`` marks the places that must come; others come only if a seed that gives an asked place gives them too."""
    n = len(text)
    if not n:
        return
    counts = np.zeros(symbols, np.int64)
    for a in range(0, n, BLOCK):
        counts += np.bincount(text[a : a + BLOCK], minlength=symbols)
    ranges = _Ranges(counts, max(1024, n // 64))
    small = _types(text)
    seeds = _seeds(small)
    seeds, common = _sorted_seeds(text, small, seeds, _needed(seeds, asked), ranges, symbols, depth, budget)
    of_seeds = np.zeros(ranges.number, np.int64)
    for a in range(0, len(seeds), BLOCK):
        of_seeds += np.bincount(ranges.of[text[seeds[a : a + BLOCK]]], minlength=ranges.number)

    large = np.invert(small, out=room(n, bool))
    number = int(large.sum())
    l_at, l_lcp, done = room(number, np.int64), room(number, np.uint8), 0
    up = _Induction(text, large, ranges, symbols, depth, budget, True)
    up.take(np.array([n]), np.zeros(1, np.uint8))
    ends = np.zeros(ranges.number + 1, np.int64)
    first = 0
    for q in range(ranges.number):
        last = first + int(of_seeds[q])
        for kind, at, lcp in up.run(q, _parts(seeds, common, first, last, True)):
            if kind == "mixed":
                mine = lcp[1].astype(bool)  # a symbol's seeds come after them, so their neighbours are their own
                at, lcp = at[mine], lcp[0][mine]
            if kind != "other":
                l_at[done : done + len(at)], l_lcp[done : done + len(at)] = at, lcp
                done += len(at)
        first, ends[q + 1] = last, done
    up.queues.close()

    down = _Induction(text, small, ranges, symbols, depth, budget, False)
    for q in range(ranges.number - 1, -1, -1):
        for kind, at, lcp in down.run(q, _parts(l_at, l_lcp, int(ends[q]), int(ends[q + 1]), False)):
            yield at, lcp[0] if kind == "mixed" else lcp
    down.queues.close()


def sort_suffixes(text: np.ndarray, depth: int, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """(positions, common): all suffixes of the bytes in order of their first ``depth`` characters at least, and each one's
    common prefix with the one before, up to ``depth``."""
    got = list(descending(text, 256, depth, budget))
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    at, lcp = (np.concatenate([g[k] for g in got]) for k in (0, 1))
    return at[::-1], np.concatenate(([0], lcp[:0:-1])).astype(np.uint8)

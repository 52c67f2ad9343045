"""Suffix array and common prefixes of one shard by induced sorting outside memory.

The suffixes that are smaller than their follower (S) and follow one that is not (L) are the
*seeds* of a text. Sorted seeds induce the order of all L suffixes in ascending order, and those the
order of all S suffixes in descending order: whenever a suffix is taken from the queue, its left
neighbour goes in under its own first symbol. The seeds are sorted by naming the substrings between
them, in an order that two such passes give, and by sorting the text of names in the same way.

The tuples of a pass (key, position, source) wait in :class:`Queue`, a priority queue of sorted runs
that lie on disk beyond a size; it hands out all tuples of which it is certain that nothing smaller
can still come, so numpy works on many at once. The length of the common prefix of neighbours comes
by the same recursion, up to ``depth``: two neighbours with one first symbol share one symbol more
than their sources do, and what these share is a range minimum over the pass itself; for seeds it
is what their names share; only where an L and an S suffix meet under a symbol are runs compared.

Arrays over the text lie in temporary files beyond ``IN_MEMORY`` bytes. These have no name, live as
long as the task and are never read by another one; an executor that is lost does its shard again.
Text and kinds of suffixes are read by position through the mapped file.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Bytes above which an array or a run of the queue lies in a temporary file.
IN_MEMORY = 64_000_000
#: Elements that one step over a whole array handles.
STEP = 1 << 20
#: Tuples that a queue hands out together.
BLOCK = 1 << 18
#: Symbols of a text of names that is sorted in memory.
BASE = 1 << 22
_NEVER = np.iinfo(np.int64).max


def _wide(n: int) -> type:
    """The type of positions in a text of ``n`` symbols."""
    return np.int32 if n < np.iinfo(np.int32).max // 2 else np.int64


def allot(shape: int | tuple[int, ...], dtype: type) -> np.ndarray:
    """An array of zeros in memory or, if large, in a temporary file without a name."""
    size = int(np.prod(shape)) * np.dtype(dtype).itemsize
    if size <= IN_MEMORY:
        return np.zeros(shape, dtype)
    with tempfile.TemporaryFile() as file:
        return np.memmap(file, dtype, "w+", shape=shape)


def steps(n: int) -> list[tuple[int, int]]:
    return [(a, min(a + STEP, n)) for a in range(0, n, STEP)]


class Queue:
    """Tuples (key, position, source) in the order of their keys, equal keys in the order they
    came. ``held`` bytes of runs stay in memory."""

    FAN = 8

    def __init__(self, held: int = IN_MEMORY) -> None:
        self.held = held
        #: Oldest first: [level, first tuple that is left, key, position, source].
        self.runs: list[list] = []

    def push(self, key: np.ndarray, *values: np.ndarray) -> None:
        if not len(key):
            return
        order = np.argsort(_small(key), kind="stable")
        self._add(0, [key[order], *(v[order] for v in values)])
        while len(self.runs) >= self.FAN and self.runs[-self.FAN][0] == self.runs[-1][0]:
            merged, self.runs = self.runs[-self.FAN :], self.runs[: -self.FAN]
            parts = [np.concatenate([r[2 + c][r[1] :] for r in merged]) for c in range(3)]
            order = np.argsort(_small(parts[0]), kind="stable")
            self._add(merged[0][0] + 1, [p[order] for p in parts])

    def _add(self, level: int, columns: list[np.ndarray]) -> None:
        size = sum(c.nbytes for c in columns)
        if size > self.held or size + sum(3 * r[2].nbytes for r in self.runs if not isinstance(r[2], np.memmap)) > 4 * self.held:
            for i, column in enumerate(columns):
                with tempfile.TemporaryFile() as file:
                    mapped = np.memmap(file, column.dtype, "w+", shape=column.shape)
                mapped[:] = column
                columns[i] = mapped
        self.runs.append([level, 0, *columns])

    def peek(self, limit: int) -> list[np.ndarray] | None:
        """The first tuples, some ``limit`` of them from each run at most; None at the end."""
        self.runs = [r for r in self.runs if r[1] < len(r[2])]
        if not self.runs:
            return None
        ends = [min(r[1] + limit, len(r[2])) for r in self.runs]
        bound = min((r[2][e - 1] for r, e in zip(self.runs, ends, strict=True) if e < len(r[2])), default=_NEVER)
        count = [int(np.searchsorted(r[2][r[1] : e], bound, "left")) for r, e in zip(self.runs, ends, strict=True)]
        if not sum(count):
            # More tuples of the least key than one run may give: the oldest of them.
            least = min(r[2][r[1]] for r in self.runs)
            count = []
            for r, e in zip(self.runs, ends, strict=True):
                full = sum(count) >= limit
                count.append(0 if full else int(np.searchsorted(r[2][r[1] : e], least, "right")))
                if not full and r[1] + count[-1] == e < len(r[2]):
                    count += [0] * (len(self.runs) - len(count))
                    break
        taken = [i for i, n in enumerate(count) if n]
        columns = [np.concatenate([self.runs[i][2 + c][self.runs[i][1] :][: count[i]] for i in taken]) for c in range(3)]
        self.owner = np.repeat(taken, [count[i] for i in taken])
        if len(taken) > 1:
            order = np.argsort(_small(columns[0]), kind="stable")
            self.owner, columns = self.owner[order], [c[order] for c in columns]
        return columns

    def pop(self, count: int) -> None:
        """Take the first ``count`` tuples of the last look away."""
        for i, n in enumerate(np.bincount(self.owner[:count], minlength=len(self.runs)).tolist()):
            self.runs[i][1] += n


def _small(key: np.ndarray) -> np.ndarray:
    """Keys in 16 bits where they fit, which are sorted by radix."""
    return key.astype(np.uint16) if len(key) > 64 and int(key.max()) < 1 << 16 else key


class Minima:
    """Minima over ranges of a growing sequence of small numbers: over 1, 2 .. ``BLOCK`` numbers up
    to each, and over 1, 2, 4 .. whole blocks."""

    BLOCK = 16

    def __init__(self, n: int) -> None:
        self.near = allot((self.BLOCK.bit_length(), n), np.uint8)
        blocks = n // self.BLOCK + 1
        self.far = allot((blocks.bit_length(), blocks), np.uint8)
        self.n = self.blocks = 0

    @staticmethod
    def _double(table: np.ndarray, a: int, b: int) -> None:
        for k in range(1, min(len(table), b.bit_length())):
            half = 1 << (k - 1)
            table[k, a:b] = table[k - 1, a:b]
            first = max(a, half)
            if first < b:
                np.minimum(table[k, first:b], table[k - 1, first - half : b - half], out=table[k, first:b])

    def append(self, values: np.ndarray) -> None:
        a, self.n = self.n, self.n + len(values)
        self.near[0, a : self.n] = values
        self._double(self.near, a, self.n)
        old, self.blocks = self.blocks, self.n // self.BLOCK
        if self.blocks > old:
            self.far[0, old : self.blocks] = self.near[-1, (np.arange(old, self.blocks) + 1) * self.BLOCK - 1]
            self._double(self.far, old, self.blocks)

    @staticmethod
    def _least(table: np.ndarray, after: np.ndarray, to: np.ndarray) -> np.ndarray:
        k = np.frexp(to - after)[1].astype(np.int64) - 1
        return np.minimum(table[k, to], table[k, after + (np.int64(1) << k)])

    def least(self, after: np.ndarray, to: np.ndarray) -> np.ndarray:
        """The least of the numbers behind ``after`` up to and with ``to``."""
        wide = to - after > self.BLOCK
        out = np.empty(len(to), np.uint8)
        close = ~wide
        out[close] = self._least(self.near, after[close], to[close])
        after, to = after[wide], to[wide]
        ends = np.minimum(self.near[-1, after + self.BLOCK], self.near[-1, to])
        # Whole blocks between the two ends.
        first, last = (after + 1) // self.BLOCK, to // self.BLOCK - 1
        some = last > first
        ends[some] = np.minimum(ends[some], self._least(self.far, first[some], last[some]))
        out[wide] = ends
        return out


def kinds(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their follower; the last symbol is the least of all."""
    n = len(text)
    small = allot(n, np.bool_)
    small[n - 1] = True
    later = True
    for a, b in reversed(steps(n - 1)):
        now, after = np.asarray(text[a:b]), np.asarray(text[a + 1 : b + 1])
        # 1 smaller, -1 larger, and 0 where the follower decides.
        sign = (now < after).astype(np.int8) - (now > after)
        known = np.append(np.where(sign != 0, np.arange(b - a), b - a), b - a)
        near = np.minimum.accumulate(known[::-1])[::-1][:-1]
        small[a:b] = np.append(sign > 0, later)[near]
        later = bool(small[a])
    return small


def seeds_of(small: np.ndarray) -> np.ndarray:
    """Positions of the S suffixes behind an L suffix, in the order of the text."""
    return np.concatenate(
        [np.zeros(0, np.int64), *(np.flatnonzero(small[a + 1 : b + 1] & ~small[a:b]) + a + 1 for a, b in steps(len(small) - 1))]
    )


def extended(text: np.ndarray, a: np.ndarray, b: np.ndarray, common: np.ndarray, limit: np.ndarray | int) -> np.ndarray:
    """How many symbols the suffixes at ``a`` and ``b`` share, ``limit`` at most, if they share
    ``common`` at least."""
    common = np.minimum(common, limit)
    on = np.flatnonzero(common < limit)
    last = len(text) - 1
    limit = np.broadcast_to(limit, common.shape)
    while len(on):
        i, j = a[on] + common[on], b[on] + common[on]
        inside = (i <= last) & (j <= last)
        on, i, j = on[inside], i[inside], j[inside]
        on = on[text[i] == text[j]]
        common[on] += 1
        on = on[common[on] < limit[on]]
    return common


def _run(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """How often the first symbol of each suffix is repeated at once, ``depth`` at most."""
    length = np.ones(len(at), np.int64)
    on = np.arange(len(at))
    while len(on):
        next_one = at[on] + length[on]
        inside = next_one < len(text)
        on, next_one = on[inside], next_one[inside]
        on = on[text[next_one] == text[at[on]]]
        length[on] += 1
        on = on[length[on] < depth]
    return length


def induce(
    text: np.ndarray, small: np.ndarray, seeds: np.ndarray, common: np.ndarray, descending: bool, depth: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One pass from sorted ``seeds``: positions taken in order, what each shares with the one
    before it, and whether it was induced. ``common`` has what the seeds share. Ascending, L suffixes
    are induced; descending, S suffixes."""
    wide = np.int64 if 2 * int(text.max()) + 1 > np.iinfo(np.int32).max else _wide(len(text))
    top = int(text.max()) if descending else 0
    n = len(seeds) + sum(int(np.count_nonzero(small[a:b] == descending)) for a, b in steps(len(small)))

    def symbol(at: np.ndarray) -> np.ndarray:
        found = text[at].astype(wide)
        return top - found if descending else found

    taken, induced = allot(n, _wide(len(text))), allot(n, np.bool_)
    shared, minima = allot(n, np.uint8), Minima(n)
    queue, out, limit = Queue(), 0, 4_096
    for a, b in steps(len(seeds)):
        # An induced suffix comes before the seeds of its symbol.
        some = seeds[a:b].astype(wide)
        queue.push(2 * symbol(some) + 1, some, common[a:b].astype(wide))
    last = None
    while (block := queue.peek(limit)) is not None:
        key, at, source = block
        before = at - 1
        goes = (at > 0) & (small[before] == descending)
        pushed = np.full(len(key), np.iinfo(wide).max, wide)
        pushed[goes] = 2 * symbol(before[goes])
        least = np.minimum.accumulate(pushed)
        late = np.flatnonzero(key[1:] > least[:-1])
        count = int(late[0]) + 1 if len(late) else len(key)
        queue.pop(count)
        limit = min(max(2 * count, 512), BLOCK)
        key, at, source, goes, pushed = (c[:count] for c in (key, at, source, goes, pushed))
        taken[out : out + count] = at
        induced[out : out + count] = key & 1 == 0
        first = last is None
        k, p, s = (np.concatenate([c if not first else x[:1], x]) for c, x in zip(last or [None] * 3, (key, at, source), strict=True))
        value = np.zeros(count, np.int64)
        same = k[1:] >> 1 == k[:-1] >> 1
        if first:
            same[0] = False
        both = np.flatnonzero(same & (k[1:] & 1 == 0))
        value[both] = 1 + minima.least(s[both], s[both + 1]).astype(np.int64)
        seeded = np.flatnonzero(same & (k[:-1] & 1 == 1))
        value[seeded] = s[seeded + 1]
        meet = np.flatnonzero(same & (k[:-1] & 1 == 0) & (k[1:] & 1 == 1))
        value[meet] = np.minimum(_run(text, p[meet], depth), _run(text, p[meet + 1], depth))
        value = np.minimum(value, depth).astype(np.uint8)
        shared[out : out + count] = value
        minima.append(value)
        last = [key[-1:], at[-1:], source[-1:]]
        rank = np.flatnonzero(goes)
        queue.push(pushed[rank], before[:count][rank], (out + rank).astype(wide))
        out += count
    return taken[:out], shared[:out], induced[:out]


def _only(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The ``wanted`` ones of ``values``, step by step."""
    out, n = allot(sum(int(np.count_nonzero(wanted[a:b])) for a, b in steps(len(wanted))), values.dtype), 0
    for a, b in steps(len(values)):
        some = values[a:b][wanted[a:b]]
        out[n : n + len(some)] = some
        n += len(some)
    return out


def _descending(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, common: np.ndarray, depth: int):
    """All suffixes but the last one from the largest to the least, by both passes."""
    taken, shared, induced = induce(text, small, seeds, common, False, depth)
    large = _only(taken, induced)[::-1]
    # What a suffix shares with the one behind it is what that one shares with it.
    before = _only(shared, induced)
    turned = np.concatenate([np.zeros(min(1, len(before)), np.uint8), before[:0:-1]])
    return induce(text, small, large, turned, True, depth)


def _doubled(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`suffix_array` of a text in memory: groups of suffixes that share ``span`` symbols are
    divided by the group of what follows, until every group has one."""
    n, span = len(text), 1
    order = np.argsort(text, kind="stable")
    sorted_text = text[order]
    opens = np.flatnonzero(np.concatenate([[True], sorted_text[1:] != sorted_text[:-1]]))
    size = np.diff(np.append(opens, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(opens, size)
    open_ones = order[np.repeat(size > 1, size)]
    while len(open_ones):
        follows = open_ones + span
        after = np.where(follows < n, rank[np.minimum(follows, n - 1)] + 1, 0)
        key = rank[open_ones] * (n + 1) + after
        sort = np.argsort(key, kind="stable")
        open_ones, key = open_ones[sort], key[sort]
        group = key // (n + 1)
        place = np.arange(len(key))
        first = np.concatenate([[True], group[1:] != group[:-1]])
        parts = np.concatenate([[True], key[1:] != key[:-1]])
        begin = np.maximum.accumulate(np.where(first, place, 0))
        part = np.maximum.accumulate(np.where(parts, place, 0))
        rank[open_ones] = group + part - begin
        size = np.diff(np.append(np.flatnonzero(parts), len(key)))
        open_ones = open_ones[np.repeat(size > 1, size)]
        span *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    prefixes = np.zeros(n, np.uint8)
    prefixes[1:] = extended(text, suffixes[:-1], suffixes[1:], np.zeros(n - 1, np.int64), depth)
    return suffixes, prefixes


def _named(text: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the substrings from each seed to the next one (its first symbol included) in their
    order, equal ones with one name, and the numbers of the seeds in that order.

    As many symbols as fit are packed into one number, and a queue sorts the numbers. A substring that
    another one begins with is the larger of the two, as it ends in an S
    suffix where the other has an L suffix; so what lies behind the end counts as the largest symbol. Only substrings that agree so
    far and go on are looked at again, with their next symbols."""
    n = len(seeds)
    bits = max(1, (int(text.max()) + 1).bit_length())
    width, pad = max(1, 62 // bits), (1 << bits) - 1
    size = np.append(np.diff(seeds), 0) + 1

    def packed(some: np.ndarray, first: int) -> np.ndarray:
        key = np.zeros(len(some), np.int64)
        at, left = seeds[some] + first, size[some] - first
        for j in range(width):
            here = left > j
            key <<= bits
            key |= np.where(here, text[np.where(here, at + j, 0)].astype(np.int64), pad)
        return key

    queue = Queue()
    for a, b in steps(n):
        some = np.arange(a, b, dtype=_wide(n))
        queue.push(packed(some, 0), some, some)
    number, keys, out = allot(n, _wide(n)), allot(n, np.int64), 0
    while (block := queue.peek(STEP)) is not None:
        count = len(block[0])
        queue.pop(count)
        keys[out : out + count], number[out : out + count] = block[0], block[1]
        out += count
    # Places where a name begins, and the runs of equal keys that go on behind them.
    opens = allot(n, np.bool_)
    opens[0] = True
    for a, b in steps(n - 1):
        opens[a + 1 : b + 1] = keys[a + 1 : b + 1] != keys[a:b]
    del keys
    parts = []
    for a, b in steps(n):
        # One that ends with its key takes part: it may stand with longer ones, which come before it.
        goes_on = size[number[a:b]] >= width
        twin = ~np.append(opens[a + 1 : b], opens[b] if b < n else True) | ~opens[a:b]
        parts.append(np.flatnonzero(goes_on & twin) + a)
    place, first = np.concatenate(parts), width
    group = np.cumsum(opens[place]) if len(place) else place
    while len(place):
        some = number[place]
        key = packed(some, first)
        order = np.lexsort((key, group))
        some, key, group = some[order], key[order], group[order]
        number[place] = some
        fresh = np.ones(len(place), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        opens[place] |= fresh
        first += width
        twin = ~np.append(fresh[1:], True) | ~fresh
        on = twin & (size[some] >= first)
        place, group = place[on], np.cumsum(fresh)[on]
    names, name = allot(n, np.int64), -1
    for a, b in steps(n):
        here = np.cumsum(opens[a:b]) + name
        names[number[a:b]] = here
        name = int(here[-1])
    return names, number


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``text`` in order and what each shares with the one before it, ``depth`` (at
    most 254) symbols at most. The last symbol is the least and stands nowhere else."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.uint8)
    small = kinds(text)
    seeds = seeds_of(small)
    names, number = _named(text, seeds)
    if int(names[number[-1]]) + 1 == len(seeds):
        order, common = seeds[number], np.zeros(len(seeds), np.int64)
    else:
        inner, shared = (_doubled if len(names) <= BASE else suffix_array)(names, depth)
        order = seeds[inner]
        common = seeds[inner + shared] - order
    for a, b in steps(len(order) - 1):
        common[a + 1 : b + 1] = extended(text, order[a:b], order[a + 1 : b + 1], common[a + 1 : b + 1], depth)
    common[0] = 0
    taken, shared, _ = _descending(text, small, order, common.astype(np.uint8), depth)
    suffixes, prefixes = allot(n, _wide(n)), allot(n, np.uint8)
    suffixes[0] = n - 1
    suffixes[1:] = taken[::-1]
    prefixes[2:] = shared[:0:-1]
    return suffixes, prefixes

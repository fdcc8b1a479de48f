"""Operator 8, near-duplicate passages by compact windows of min-hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.anchors import Hashes, sliding_min, spread
from tessella.llm.common import connected, discard, mix64, stored

#: Words of a shingle and of the shortest passage; similarity in percent; min-hashes; windows of a group up to which their
#: texts meet in pairs; texts that are compared with one text in one task, and windows of a tile; pairs that are compared
#: together.
SHINGLE, WORDS, PERCENT, HASHES, FEW, TILE, PAIRS = 5, 50, 80, 4, 32, 1024, 4096

_ODD = mix64(np.arange(101, 101 + HASHES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_SPANS = "array<struct<start: int, end: int>>"


_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Bytes of texts that are cut together, and of words that are hashed with others.
BUFFER, WORD_BYTES = 1 << 20, 64


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words of raw, in order: 8 bytes at a time, of all words together."""
    held = np.frombuffer(raw + bytes(8), np.uint8)
    text = np.concatenate([[False], ~_BLANK[held[:-8]], [False]])
    start, end = np.flatnonzero(text[1:] & ~text[:-1]), np.flatnonzero(text[:-1] & ~text[1:])
    size = end - start
    eight = np.ndarray((len(raw) + 1,), "<u8", held.data, strides=(1,))
    out = mix64(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    left = np.flatnonzero(size <= WORD_BYTES)
    at = 0
    while len(left):
        rest = np.minimum(size[left] - at, 8).astype(np.uint64) << np.uint64(3)
        part = eight[start[left] + at] & (~np.uint64(0) >> (np.uint64(64) - rest))
        out[left] = mix64((out[left] ^ part) * np.uint64(0xD1342543DE82EF95))
        at += 8
        left = left[size[left] > at]
    long = np.flatnonzero(size > WORD_BYTES).tolist()
    if long:
        import xxhash

        for i in long:
            out[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]])
    return start, out


def shingle_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(h, size): the 64-bit hashes of the texts' shingles, in order, one for each place; size: how many of each text."""
    held = [b"" if t is None else t.encode("utf-8", "surrogatepass").lower() for t in texts]
    start, words = word_hashes(b"\n".join(held))
    begin = np.cumsum([0, *(len(t) + 1 for t in held)])
    first = np.searchsorted(start, begin)
    h = np.zeros(max(len(words) - SHINGLE + 1, 0), np.uint64)
    for i in range(SHINGLE):
        h = mix64(h * np.uint64(0xD1342543DE82EF95) + words[i : i + len(h)])
    size = np.maximum(np.diff(first) - SHINGLE + 1, 0)
    return h[spread(first[:-1], size)], size


def cut_together(texts: list[str | None]) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(which, h, size) for runs of texts of some BUFFER bytes."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= BUFFER or i + 1 == len(texts):
            yield slice(begin, i + 1), *shingle_hashes(texts[begin : i + 1])
            begin, held = i + 1, 0


def _before(value: np.ndarray, item: np.ndarray, equal: bool) -> np.ndarray:
    """Where the last value before each, in its item, is smaller, or equal, if that counts; -1: nowhere. All go back at once,
    over what those that are in the way have passed already."""
    at = np.arange(-1, len(value) - 1)
    left = np.arange(len(value))
    while len(left):
        to = at[left]
        left, to = left[to >= 0], to[to >= 0]
        other = item[to] != item[left]
        at[left[other]] = -1
        wait = ~other & ((value[to] > value[left]) if equal else (value[to] >= value[left]))
        left, to = left[wait], to[wait]
        at[left] = at[to]
    return at


def nodes(h: np.ndarray, size: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item, l, c, r), by item and c, of the compact windows of the items that stand in h one after the other: h[c] is the
    first least value of every subsequence of its item that starts in l..c and ends in c..r, where r - l + 1 is at least
    `least`; each subsequence that long has one. l, c and r are counted from the item's start.

    These are the nodes of the Cartesian tree of an item that span enough. A node spans `least` places only if it is the
    least of some window of that width, and so do all above it: the others are left out before the tree is made.
    """
    none = np.zeros(0, np.int64)
    if len(h) < least:
        return none, none, none, none
    end = np.cumsum(size)
    begin = end - size
    inside = np.zeros(len(h) + 1, np.int64)  # which windows lie in one item
    enough = size >= least
    np.add.at(inside, begin[enough], 1)
    np.add.at(inside, end[enough] - least + 1, -1)
    low = ~sliding_min(h, least)
    low[np.cumsum(inside)[: len(low)] == 0] = ~np.uint64(0)
    top = sliding_min(np.concatenate([np.full(least - 1, ~np.uint64(0)), low, np.full(least - 1, ~np.uint64(0))]), least)
    c = np.flatnonzero(top == ~h)
    item = np.searchsorted(end, c, "right")
    c, item = c[enough[item]], item[enough[item]]
    value = h[c]
    before = _before(value, item, True)
    after = _before(value[::-1], item[::-1], False)[::-1]
    left = np.where(before >= 0, c[before] + 1, begin[item])
    right = np.where(after >= 0, c[::-1][after], end[item]) - 1
    wide = right - left + 1 >= least
    item, left, c, right = item[wide], left[wide], c[wide], right[wide]
    return item, left - begin[item], c - begin[item], right - begin[item]


def compact_windows(h: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(l, c, r) of the nodes of one sequence."""
    return zip(*(x.tolist() for x in nodes(h, np.array([len(h)]), least)[1:]), strict=True)


def thinned(item: np.ndarray, c: np.ndarray, right: np.ndarray, value: np.ndarray, least: int) -> np.ndarray:
    """Which windows, by item and c, stay without those whose least value stands less than `least` places before, in one
    window: what they hold is within `least` places of that one's c, so its surroundings hold it too."""
    order = np.lexsort((c, value, item))
    again = (item[order[1:]] == item[order[:-1]]) & (value[order[1:]] == value[order[:-1]])
    if not again.any():
        return np.arange(len(item))
    kept = np.ones(len(item), bool)
    some = np.concatenate([again, [False]]) | np.concatenate([[False], again])
    last: dict[tuple[int, int], tuple[int, int]] = {}
    for i, *key, at, r in zip(order[some].tolist(), item[order[some]].tolist(), value[order[some]].tolist(), c[order[some]].tolist(), right[order[some]].tolist(), strict=True):
        before = last.get(tuple(key))
        if before is None or at - before[0] >= least or before[1] < at:
            last[tuple(key)] = (at, r)
        else:
            kept[i] = False
    return np.flatnonzero(kept)


def windows_of(h: np.ndarray, size: np.ndarray, least: int, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(items, signatures, places) of the compact windows of the items of h under the hashes of a level. A place is c, l and
    r in one number, 16 bits for each distance, l and r no farther from c than twice `least`: in passages that are alike, a
    part of that length is alike."""
    items, keys, places = [], [], []
    begin = np.cumsum(size) - size
    for odd in _ODD[level * HASHES : (level + 1) * HASHES]:
        g = h * odd
        item, left, c, right = nodes(g, size, least)
        value = g[begin[item] + c]
        kept = thinned(item, c, right, value, least)
        item, left, c, right, value = item[kept], left[kept], c[kept], right[kept], value[kept]
        items.append(item)
        keys.append(mix64(value ^ odd).view(np.int64))
        places.append((c << 32) | (np.minimum(c - left, 2 * least) << 16) | np.minimum(right - c, 2 * least))
    return np.concatenate(items), np.concatenate(keys), np.concatenate(places)


def unpacked(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    c = places >> 32
    return c - ((places >> 16) & 0xFFFF), c, c + (places & 0xFFFF)


def joined(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """The ranges left..right, without overlaps, as half-open ones."""
    out: list[list[int]] = []
    for a, b in sorted(zip(left.tolist(), right.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + 1)
        else:
            out.append([a, b + 1])
    return [(a, b) for a, b in out]


def longest(match: np.ndarray, size: np.ndarray, least: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end), in order, of the longest stretch of at least `least` places that is alike enough from each place that
    starts one, in the items that stand in match one after the other: with m of s places matched on both sides,
    m / (2 s - m) reaches percent."""
    n, none = len(match), np.zeros(0, np.int64)
    if n < least or np.count_nonzero(match) * (100 + percent) < 2 * percent * least:
        return none, none
    item = np.repeat(np.arange(len(size)), size)
    sums = np.concatenate([[0], np.cumsum(np.where(match, 100 - percent, -2 * percent))])  # a stretch is alike if its sum doesn't fall
    drop = item * (200 * n + 1)  # no stretch reaches over an item's end
    from_, to = sums[:-1] - drop, sums[1:] - drop
    top = np.maximum.accumulate(to[::-1])[::-1]  # the largest sum from each place on
    start = np.flatnonzero(from_[: n - least + 1] <= top[least - 1 :])
    return start, np.searchsorted(-top, -from_[start], "right")  # where the longest such stretch from each place ends


def stretches(match: np.ndarray, size: np.ndarray, least: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, start, end), in order, of what the longest stretches cover, in each of the items that stand in match one after
    the other. Stretches that overlap or touch are one, and lose their unmatched ends, down to `least` places."""
    start, far = longest(match, size, least, percent)
    if not len(start):
        return start, start, start
    of = np.repeat(np.arange(len(size)), size)[start]
    end = np.maximum.accumulate(far)
    new = np.flatnonzero((start[1:] > end[:-1]) | (of[1:] != of[:-1]))
    s, e = start[np.concatenate([[0], new + 1])], end[np.concatenate([new, [len(start) - 1]])]
    at = np.flatnonzero(match)
    first, last = at[np.searchsorted(at, s)], at[np.searchsorted(at, e) - 1]
    first = np.minimum(first, e - least)
    of = of[np.searchsorted(start, s)]
    begin = (np.cumsum(size) - size)[of]
    return of, first - begin, np.maximum(last + 1, first + least) - begin


def segments(match: np.ndarray, least: int, percent: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches of one item."""
    _, start, end = stretches(match, np.array([len(match)]), least, percent)
    return list(zip(start.tolist(), end.tolist(), strict=True))


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values, sorted; for few values faster than numpy's own."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def numbered(names: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where each of x stands among the names, which are sorted; -1: nowhere."""
    at = np.minimum(np.searchsorted(names, x), len(names) - 1)
    return np.where(names[at] == x, at, -1)


def _flags(rows: int, width: int, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros((rows, width), bool)
    out[row, at] = True
    return out


def alike(a: np.ndarray, size: np.ndarray, theirs: np.ndarray, b: np.ndarray, mine: np.ndarray, at_b: np.ndarray, size_b: np.ndarray, width: int, percent: int, words: int, done: Callable | None = None) -> np.ndarray:
    """Rows (item, start, end, start in b, end in b), by item: the passages of each of the items that stand in a one after
    the other, and of its partner, the size_b places from at_b of b, that are alike, as ranges of words. theirs and mine are a
    and b as numbers below width, one for each value of the partner, -1 for others. Stretches of an item that consist of its
    partner's shingles are sought in that, what is found there in them again, and the sets of both are compared; for all
    items together, as far as their tables stay small. done tells of which (item, start, end, start in b, end in b), in places,
    no more need be known."""
    least, begin = words - SHINGLE + 1, np.cumsum(size) - size
    item, s, e = stretches(theirs >= 0, size, least, percent)
    out = [np.zeros((0, 5), np.int64)]
    if not len(item):
        return out[0]
    step = max((1 << 20) // int(size_b.max()), 1)
    for i in range(0, len(item), step):
        of, start, length = item[i : i + step], s[i : i + step], (e - s)[i : i + step]
        at, row = spread(begin[of] + start, length), np.repeat(np.arange(len(of)), length)
        hit = theirs[at] >= 0
        flags = _flags(len(of), width, row[hit], theirs[at][hit])
        back, t, u = stretches(flags[np.repeat(np.arange(len(of)), size_b[of]), mine[spread(at_b[of], size_b[of])]], size_b[of], least, percent)
        if done is not None:
            more = np.flatnonzero(~done(of[back], start[back], start[back] + length[back], t, u))
            back, t, u = back[more], t[more], u[more]
        for j in range(0, len(back), step):
            k = back[j : j + step]
            out.append(_confirmed(a, theirs, b, mine, at_b[of[k]], width, percent, words, of[k], start[k], begin[of[k]] + start[k], length[k], t[j : j + step], u[j : j + step]))
    out = np.concatenate(out)
    return out[np.argsort(out[:, 0], kind="stable")]


def _confirmed(a, theirs, b, mine, at_b, width: int, percent: int, words: int, item, start, place, length, t, u) -> np.ndarray:
    """Rows of alike() for stretches of a (from start of their item, that is place of a) and t..u of the partner."""
    least = words - SHINGLE + 1
    of_b = _flags(len(t), width, np.repeat(np.arange(len(t)), u - t), mine[spread(at_b + t, u - t)])
    x, row = theirs[spread(place, length)], np.repeat(np.arange(len(t)), length)
    back, v, w = stretches((x >= 0) & of_b[row, x], length, least, percent)
    item, start, place, at_b, t, u = item[back], start[back], place[back], at_b[back], t[back], u[back]
    at, row = spread(place + v, w - v), np.repeat(np.arange(len(back)), w - v)
    kinds = np.bincount((distinct((row.astype(np.uint64) << np.uint64(32)) | a[at]) >> np.uint64(32)).astype(np.int64), minlength=len(back))
    x = theirs[at]
    both = (_flags(len(back), width, row[x >= 0], x[x >= 0]) & of_b[back]).sum(1)
    near = 100 * both >= percent * (of_b.sum(1)[back] + kinds - both)
    out = np.stack([item, start + v, start + w + SHINGLE - 1, t, u + SHINGLE - 1], axis=1)[near]
    far = np.flatnonzero(~near & ((w - v > least) | (u - t > least)))
    if not len(far):
        return out
    # of long ranges the ends may not belong: the longest stretches of them, then all parts of `least` outside of those
    first = np.full((len(far), width), -1)  # where each value of the partner first stands in t..u
    row, at = np.repeat(np.arange(len(far)), (u - t)[far]), spread(t[far], (u - t)[far])
    value = mine[at_b[far][row] + at]
    first[row[::-1], value[::-1]] = at[::-1]
    kinds_b, begin_b = kinds_of(row, value, least), np.cumsum((u - t)[far]) - (u - t)[far]
    size, row = (w - v)[far], np.repeat(np.arange(len(far)), (w - v)[far])
    at = spread((place + v)[far], size)
    where = np.where(theirs[at] >= 0, first[row, theirs[at]], -1)  # where what each place holds stands in the partner
    hit, begin = where >= 0, np.cumsum(size) - size
    kinds_a, common = kinds_of(row, a[at], least), kinds_of(row, a[at], least, hit)

    def found_in(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Rows of what is alike of the parts i..j: where a part's first, middle and last shingle stand in the partner tells
        where it may stand. At most three rows a part."""
        f, places = row[i], np.flatnonzero(hit)
        lo, hi = np.searchsorted(places, i), np.searchsorted(places, j) - 1
        low, high = t[far][f], u[far][f]
        ends = [(i, j, where[x] - (x - i), where[y] + (j - y)) for x, y in ((places[lo], places[hi]), *((z, z) for z in (places[lo], places[(lo + hi) // 2], places[hi])))]
        got = []
        for x, y, k, m in ends:
            k = np.minimum(np.maximum(k, low), high - least)
            m = np.minimum(np.maximum(m, k + least), high)
            # no more than `most` can be in both, and what a part of `least` holds is in the whole
            most = np.where(y - x == least, common[x], both[far][f])
            some = np.flatnonzero(100 * most >= percent * (kinds_a[x] + kinds_b[begin_b[f] + k - low] - most))
            x, y, k, m, q = x[some], y[some], k[some], m[some], far[f[some]]
            at = x - begin[f[some]]
            near = same_sets(a, (place + v)[q] + at, y - x, b, at_b[q] + k, m - k, percent)
            got.append(np.stack([item[q], (start + v)[q] + at, (start + v)[q] + at + y - x + SHINGLE - 1, k, m + SHINGLE - 1, x, y], axis=1)[near])
        return np.concatenate(got)

    i, j = longest(hit, size, least, percent)
    if len(i):
        new = np.ones(len(i), bool)
        new[1:] = (j[1:] > j[:-1]) | (row[i[1:]] != row[i[:-1]])
        got = found_in(i[new], j[new])
        out = np.concatenate([out, got[:, :5]])
        depth = np.zeros(len(hit) + 1, np.int64)  # parts that lie in what is found
        np.add.at(depth, got[:, 5], 1)
        np.add.at(depth, got[:, 6] - least + 1, -1)
        sums = np.concatenate([[0], np.cumsum(hit)])
        i = np.arange(len(hit) - least + 1)
        i = i[(row[i] == row[i + least - 1]) & ((sums[i + least] - sums[i]) * (100 + percent) >= 2 * percent * least) & (np.cumsum(depth)[i] == 0)]
        if len(i):
            out = np.concatenate([out, found_in(i, i + least)[:, :5]])
    return out


def kinds_of(row: np.ndarray, value: np.ndarray, width: int, counted: np.ndarray | None = None) -> np.ndarray:
    """How many different values the `width` places from each place on hold, as far as they are in one row; of the places that
    are counted, if they are given. A value is counted where it last stands in them."""
    at = np.arange(len(row)) if counted is None else np.flatnonzero(counted)
    key = (row[at].astype(np.uint64) << np.uint64(32)) | value[at].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    again, order = key[order[1:]] == key[order[:-1]], at[order]
    until = np.full(len(row), len(row) + width)
    until[order[:-1][again]] = order[1:][again]
    low, high = np.maximum(at - width + 1, np.searchsorted(row, row[at])), np.minimum(at, until[at] - width)
    some = low <= high
    return np.cumsum(np.bincount(low[some], minlength=len(row) + 1) - np.bincount(high[some] + 1, minlength=len(row) + 1))


def same_sets(a: np.ndarray, i: np.ndarray, n: np.ndarray, b: np.ndarray, k: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Which of the ranges of n values from i in a, and of m from k in b, hold sets that are alike."""
    key = lambda x, start, size, side: (np.repeat(np.arange(len(size)), size).astype(np.uint64) << np.uint64(33)) | (x[spread(start, size)].astype(np.uint64) << np.uint64(1)) | np.uint64(side)
    value = distinct(np.concatenate([key(a, i, n, 0), key(b, k, m, 1)])) >> np.uint64(1)
    row = (value >> np.uint64(32)).astype(np.int64)
    both = np.bincount(row[1:][value[1:] == value[:-1]], minlength=len(n))
    return 100 * both >= percent * (np.bincount(row, minlength=len(n)) - both)


def shared_places(windows: list[np.ndarray], split: int, counted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """How many places of each of the first `split` windows hold a shingle of each of the others (of each, if split is all),
    and how many places of the others hold one of theirs; of the places that are counted, if they are given."""
    row = np.repeat(np.arange(len(windows)), [len(x) for x in windows])
    _, column, count = np.unique(np.concatenate(windows), return_inverse=True, return_counts=True)
    keep = count[column] > 1
    row, column = row[keep], (np.cumsum(count > 1) - 1)[column[keep]]
    weight = np.ones(len(row), np.float32) if counted is None else counted[keep].astype(np.float32)
    order = np.argsort(column, kind="stable")
    row, column, weight = row[order], column[order], weight[order]
    n, others = int((count > 1).sum()), slice(split, None) if split < len(windows) else slice(None)
    ones = theirs = np.zeros((split, len(windows) - split or split), np.float32)
    for at in range(0, n, 4096):
        a, b = np.searchsorted(column, [at, at + 4096])
        m, held = np.zeros((2, len(windows), min(4096, n - at)), np.float32)
        np.add.at(m, (row[a:b], column[a:b] - at), weight[a:b])
        held[row[a:b], column[a:b] - at] = 1
        ones = ones + m[:split] @ held[others].T
        theirs = theirs + held[:split] @ m[others].T
    return ones, theirs


def compare_tiles(b: pd.DataFrame, begin: np.ndarray, percent: int, words: int) -> list[tuple]:
    """compare_tile for each tile of b from begin on, some tiles at a time; windows with too few places whose shingle is
    in another window of their tile have no link there and are left out first."""
    size = np.fromiter(map(len, b["h"]), np.int64, len(b)) // 4
    ends = np.cumsum(size)
    tile = np.repeat(np.arange(len(begin)), np.diff([*begin, len(b)]))
    out = []
    turn = (ends[np.append(begin[1:], len(b)) - 1] if len(begin) else ends) // 300_000
    for k in np.unique(turn).tolist():
        some = np.flatnonzero(turn[tile] == k)
        h = np.frombuffer(b"".join(b["h"].iloc[some[0] : some[-1] + 1]), np.uint32)
        _, at, n = np.unique((np.repeat(tile[some], size[some]).astype(np.uint64) << np.uint64(32)) | h, return_inverse=True, return_counts=True)
        shared = np.add.reduceat((n > 1)[at].astype(np.int64), np.cumsum(size[some]) - size[some])
        left = some[shared * (100 + percent) >= 2 * percent * (words - SHINGLE + 1)]
        first = np.flatnonzero(np.diff(tile[left], prepend=-1))
        for i, j in zip(first.tolist(), np.append(first[1:], len(left)).tolist() if len(left) else [], strict=True):
            if j - i > 1:
                out += compare_tile(b.iloc[left[i:j]], percent, words)
    return out


def compare_tile(b: pd.DataFrame, percent: int, words: int) -> list[tuple]:
    """Links and passages of a tile of one signature's windows (tid, part, component, l, c, h), by rows; further columns: start
    and end, what is covered around c, and shared, whether another text has the same window. At most one row for each window
    with passages and a forest of the links.

    A pair needs no comparison if its texts are of one component and all places that it has in common lie in what is covered
    around c on both sides: passages start and end at such places. Pairs are taken by their earlier window, the first
    alone, then twice as many at a time, so where all share a passage, the first two passes settle most."""
    b = b.sort_values("part", kind="stable")
    part, tid, c, left = (b[k].to_numpy() for k in ("part", "tid", "c", "l"))
    split = len(b) if b["lo"].iloc[0] == b["hi"].iloc[0] else int((part == b["lo"].iloc[0]).sum())
    if not split or split == len(b) and b["lo"].iloc[0] != b["hi"].iloc[0] or len(b) < 2:
        return []
    h = [np.frombuffer(x, np.uint32) for x in b["h"]]
    component = b["component"].to_numpy().copy()
    start, end = (b[k].to_numpy() if k in b else np.zeros(len(b), np.int64) for k in ("start", "end"))
    many = b["shared"].to_numpy(bool) if "shared" in b else np.zeros(len(b), bool)
    first = split if split < len(b) else 0
    other = slice(split, None) if split < len(b) else slice(None)
    enough = shared_places(h, split)[0] * (100 + percent) >= 2 * percent * (words - SHINGLE + 1)
    enough &= (tid[:split, None] != tid[other]) | many[:split, None] | many[other]
    if split == len(b):
        enough = np.triu(enough, 1)
    one, other = np.nonzero(enough)
    if not len(one):
        return []
    flip = one > other
    one, other = np.where(flip, other + first, one), np.where(flip, one, other + first)
    turn = np.where(one >= first, one - first, one)
    order = np.lexsort((other, one, turn))
    one, other, turn = one[order], other[order], turn[order]
    known = np.flatnonzero(start < end)
    spans = known, start[known].astype(np.int64), end[known].astype(np.int64)  # windows, and what of them is in passages
    size, a = np.fromiter(map(len, h), np.int64, len(h)), np.concatenate(h)
    begin = np.cumsum(size) - size
    names, code = np.unique(a, return_inverse=True)
    row = np.repeat(np.arange(len(size)), size)
    order = np.argsort(row * len(names) + code)
    new = np.diff(code[order], prepend=-1) != 0
    new[begin] = True
    nth = np.cumsum(new)
    mine = np.empty(len(a), np.int64)  # the names of each window, as numbers from 0
    mine[order] = nth - np.repeat(nth[begin], size)
    width = int(size.max())
    word = spread(left, size)  # where each place stands in its text
    edges = []

    def left_over(one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Which pairs may still tell something."""
        apart = component[one] != component[other]
        if apart.all() or len(one) < len(h):
            return np.ones(len(one), bool)
        k, s, e = spans
        around = (s <= c[k]) & (c[k] + SHINGLE <= e)
        from_, to = np.zeros((2, len(h)), np.int64)
        from_[k[around]], to[k[around]] = s[around], e[around]
        outside = (word < from_[row]) | (word + SHINGLE > to[row])
        ones, theirs = shared_places(h, split, outside)
        i, j = np.minimum(one, other), np.maximum(one, other) - first
        return apart | (ones[i, j] > 0) | (theirs[i, j] > 0)

    def told(window: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Which of the places s..e of windows are in passages already."""
        k, x, y = spans
        s, e = s + left[window], e + left[window] + SHINGLE - 1
        if not len(k):
            return np.zeros(len(s), bool)
        far = int(max(y.max(), e.max(initial=0))) + 1
        at = np.maximum(np.searchsorted(k * far + x, window * far + s, "right") - 1, 0)
        return (k[at] == window) & (x[at] <= s) & (e <= y[at])

    most = max((1 << 22) // len(names), 1)  # windows of which a table of their numbers of the names is held
    at, until = 0, 0
    while len(one):
        some = left_over(one, other)
        one, other, turn = one[some], other[some], turn[some]
        until = 2 * until + 1
        at = int(np.searchsorted(turn, until))
        nth = np.cumsum(np.diff(one[:at], prepend=-1) != 0)
        cut = np.maximum(np.arange(at) // PAIRS, nth // most) if at else nth
        for pairs in np.split(np.arange(at), np.flatnonzero(np.diff(cut)) + 1):
            if not len(pairs):
                continue
            ones, others = one[pairs], other[pairs]
            rows, own_row = np.unique(ones, return_inverse=True)
            own = np.full((len(rows), len(names)), -1, np.int32)
            places = spread(begin[rows], size[rows])
            own[np.repeat(np.arange(len(rows)), size[rows]), code[places]] = mine[places]
            places = spread(begin[others], size[others])
            theirs = own[np.repeat(own_row, size[others]), code[places]]
            done = lambda k, s, e, t, u: (component[ones[k]] == component[others[k]]) & told(others[k], s, e) & told(ones[k], t, u)  # noqa: B023, E731
            found = alike(a[places], size[others], theirs, a, mine, begin[ones], size[ones], width, percent, words, done)
            window = np.concatenate([others[found[:, 0]], ones[found[:, 0]]])
            new = window, left[window] + np.concatenate([found[:, 1], found[:, 3]]), left[window] + np.concatenate([found[:, 2], found[:, 4]])
            spans = merged(*(np.concatenate(x) for x in zip(spans, new, strict=True)))
            k = np.unique(found[:, 0])
            for i, j in zip(ones[k].tolist(), others[k].tolist(), strict=True):
                if component[i] != component[j]:
                    component[component == component[j]] = component[i]
                    edges.append((tid[i], tid[j], [], []))
        one, other, turn = one[at:], other[at:], turn[at:]
    k, s, e = spans
    new = (s < start[k]) | (e > end[k])  # the others were known
    k, s, e = k[new].tolist(), s[new].tolist(), e[new].tolist()
    cut = np.flatnonzero(np.diff(k, prepend=-1)).tolist()
    return edges + [(tid[k[x]], tid[k[x]], [{"start": s[z], "end": e[z]} for z in range(x, y)], []) for x, y in zip(cut, [*cut[1:], len(k)], strict=False)]


def merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The half-open ranges of each row, in order; those that overlap or touch are one."""
    if not len(row):
        return row, start, end
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    apart = row * (int(end.max()) + 2)  # no range reaches over a row's end
    far = np.maximum.accumulate(end + apart)
    new = np.flatnonzero(np.concatenate([[True], (start + apart)[1:] > far[:-1]]))
    return row[new], start[new], (far - apart)[np.append(new[1:], len(row)) - 1]


def _sequences(base: DataFrame, members: DataFrame) -> DataFrame:
    """(tid, h) of the members' texts: 32 bits of each shingle's hash, in order. Texts are cut into words once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for _, h, size in cut_together(b["text"].tolist()):
                h = (h >> np.uint64(32)).astype(np.uint32).tobytes()
                end = (4 * np.cumsum(size)).tolist()
                out += [h[x:y] for x, y in zip([0, *end], end, strict=False)]
            yield pd.DataFrame({"tid": b["tid"], "h": out})

    need = members.select("tid").distinct()
    return stored(base.select("tid", "text").join(need, "tid").groupBy("tid").agg(F.first("text").alias("text")).mapInPandas(run, "tid long, h binary"), "sequences")


def _grouped(rows: DataFrame) -> DataFrame:
    """(signature, tid, place, shared, other, kept, n) of the windows (signature, tid, place, content) whose signature several
    texts have. Windows with the same content are one if several texts have it: shared, kept is the one of the smallest text,
    and other the largest text. n is the number of windows of the signature that are kept."""
    of, same = Window.partitionBy("signature"), Window.partitionBy("signature", "content")
    found = rows.withColumns({"_t0": F.min("tid").over(of), "_t1": F.max("tid").over(of)}).where("_t0 < _t1")
    place = F.struct("tid", "place")
    found = found.withColumns({"_t0": F.min("tid").over(same), "_t1": F.max("tid").over(same), "_last": F.lag(place).over(same.orderBy("tid", "place"))})
    shared = F.col("_t0") < F.col("_t1")
    found = found.where(F.col("_last").isNull() | (F.col("_last") != place)).withColumn("kept", ~shared | F.col("_last").isNull())
    return found.select("signature", "tid", "place", shared.alias("shared"), F.when(shared, F.col("_t0")).alias("rep"), F.when(shared, F.col("_t1")).alias("other"), "kept", F.sum(F.col("kept").cast("int")).over(of).alias("n"))


def _spans(links: DataFrame, node: str, p: str) -> DataFrame:
    return links.select(F.col(node).alias("tid"), F.explode(p).alias("s")).select("tid", "s.start", "s.end")


def _met(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b, p, q) for each text a that has passages p around its places which are alike passages q of the text b, for pairs
    (lead, tid, w: places): b is lead, a is tid.

    Only what surrounds its places goes from a text to its partner; a partner's text goes once to each of its parts, of
    TILE texts."""
    parts = pairs.groupBy("lead").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("tid"), F.col("parts")).cast("int").alias("part")
    rows = pairs.join(parts, "lead").select("tid", "lead", part, "w")
    rows = rows.union(parts.select(F.col("lead").alias("tid"), "lead", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.array().cast("array<long>").alias("w")))
    asked = rows.groupBy("tid").agg(F.collect_list(F.struct("lead", "part", "w")).alias("asked"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["lead", "part", "tid", "starts", "ends", "h"]
        for b in batches:
            out, size = [], 0
            for tid, h, some in zip(b["tid"], b["h"], b["asked"], strict=True):
                for r in some:
                    if r["lead"] == tid:
                        out.append((tid, r["part"], tid, [0], [len(h) // 4], h))
                    else:
                        left, _, right = unpacked(np.array(r["w"], np.int64))
                        ranges = joined(left, right)
                        out.append((r["lead"], r["part"], tid, [x for x, _ in ranges], [y for _, y in ranges], b"".join(h[4 * x : 4 * y] for x, y in ranges)))
                    size += len(out[-1][5])
                    if size > 1 << 22:
                        yield pd.DataFrame(out, columns=names)
                        out, size = [], 0
            if out:
                yield pd.DataFrame(out, columns=names)

    schema = "lead long, part int, tid long, starts array<int>, ends array<int>, h binary"
    sent = texts.join(asked, "tid").select("tid", "h", "asked").mapInPandas(cut, schema).repartition("lead", "part").sortWithinPartitions("lead", "part", F.col("lead") != F.col("tid"), "tid")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["a", "b", "p", "q"]
        last = None
        for b in batches:
            own, held, out, size = [last] if last else [], [], [], 0
            for lead, tid, starts, ends, h in b[["lead", "tid", "starts", "ends", "h"]].itertuples(index=False, name=None):
                h = np.frombuffer(h, np.uint32)
                if lead == tid:
                    own.append((tid, h))
                    last = own[-1]
                else:
                    held.append((tid, len(own) - 1, starts, ends, h))
                size += len(h)
                if size > 1 << 17 and held:
                    out += compare_pairs(own, held, words, percent)
                    own, held, size = [last], [], 0
            if held:
                out += compare_pairs(own, held, words, percent)
            yield pd.DataFrame(out, columns=names)

    return stored(sent.mapInPandas(compare, f"a long, b long, p {_SPANS}, q {_SPANS}"), "links")


def compare_pairs(own: list[tuple], held: list[tuple], words: int, percent: int) -> list[tuple]:
    """Rows (a, b, p, q) of texts held (tid, which of own, starts, ends, h: what lies in the ranges), each against one of own
    (tid, h), for all of them together."""
    of_text = np.fromiter((x[1] for x in held), np.int64, len(held))
    n = np.fromiter((len(x[2]) for x in held), np.int64, len(held))
    starts, ends = (np.concatenate([np.asarray(x[k], np.int64) for x in held]) for k in (2, 3))
    size, text = ends - starts, np.repeat(np.arange(len(held)), n)
    of, a = of_text[text], np.concatenate([x[4] for x in held])
    length = np.fromiter((len(h) for _, h in own), np.int64, len(own))
    begin, b = np.cumsum(length) - length, np.concatenate([h for _, h in own])
    key = (np.repeat(np.arange(len(own)), length).astype(np.uint64) << np.uint64(32)) | b
    names = distinct(key)
    base = np.searchsorted(names, np.arange(len(own) + 1).astype(np.uint64) << np.uint64(32))
    mine = np.searchsorted(names, key) - np.repeat(base[:-1], length)
    at = np.repeat(of, size)
    theirs = numbered(names, (at.astype(np.uint64) << np.uint64(32)) | a)
    theirs = np.where(theirs >= 0, theirs - base[at], -1)
    found = alike(a, size, theirs, b, mine, begin[of], length[of], int(np.diff(base).max()), percent, words)
    found[:, 1:3] += starts[found[:, 0], None]
    spans: list[dict] = [{}, {}]
    for side, k in zip(spans, (1, 3), strict=True):
        for i, s, e in zip(*(x.tolist() for x in merged(text[found[:, 0]], found[:, k], found[:, k + 1])), strict=True):
            side.setdefault(i, []).append({"start": s, "end": e})
    return [(held[i][0], own[held[i][1]][0], p, spans[1][i]) for i, p in spans[0].items()]


def _runs(spans: DataFrame) -> DataFrame:
    """(tid, start, end): the ranges (tid, start, end) of each text; those that overlap or touch are one."""
    text = Window.partitionBy("tid").orderBy("start", "end")
    every = spans.withColumn("before", F.max("end").over(text.rowsBetween(Window.unboundedPreceding, -1)))
    every = every.withColumn("run", F.sum((F.col("before").isNull() | (F.col("before") < F.col("start"))).cast("int")).over(text.rowsBetween(Window.unboundedPreceding, 0)))
    return every.groupBy("tid", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def _open(rows: DataFrame, runs: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (signature, tid, place, shared) with their text's component and what is covered around their place (start, end;
    0: nothing), of signatures that may still tell something: whose texts are of several components, or whose windows are
    not all covered to their ends."""
    c, left, right = F.shiftright("place", 32), F.shiftright("place", 16).bitwiseAND(F.lit(0xFFFF)), F.col("place").bitwiseAND(F.lit(0xFFFF))
    known = runs.groupBy("tid").agg(F.collect_list(F.struct("start", "end")).alias("p"))
    around = F.element_at(F.filter("p", lambda x: (x["start"] <= c) & (c + SHINGLE <= x["end"])), 1)
    told = rows.join(groups, "tid", "left").join(known, "tid", "left").withColumn("_r", F.when(F.exists("p", lambda x: (x["start"] <= c) & (c + SHINGLE <= x["end"])), around))
    told = told.select("signature", "tid", "place", "shared", F.coalesce("component", "tid").alias("component"), F.coalesce("_r.start", F.lit(0)).alias("start"), F.coalesce("_r.end", F.lit(0)).alias("end"))
    whole = (F.col("start") <= c - left) & (F.col("end") >= c + right + SHINGLE)
    of = Window.partitionBy("signature")
    told = told.withColumns({"_c0": F.min("component").over(of), "_c1": F.max("component").over(of), "_all": F.min(whole).over(of)})
    return stored(told.where("_c0 < _c1 or not _all").drop("_c0", "_c1", "_all"), "open")


def _tiled(members: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links of all windows (signature, tid, place, component, start, end, shared) that share a signature, compared in tiles
    of two parts of a signature's windows."""
    size = members.groupBy("signature").agg(F.count("*").alias("m")).where("m > 1").select("signature", F.ceil(F.col("m") / TILE).cast("int").alias("parts"))
    asked = members.join(size, "signature").groupBy("tid", "component").agg(F.collect_list(F.struct("place", "signature", "parts", "start", "end", "shared")).alias("asked"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["signature", "parts", "tid", "component", "start", "end", "shared", "l", "c", "h"]
        for b in batches:
            out = []
            for tid, component, h, some in zip(b["tid"], b["component"], b["h"], b["asked"], strict=True):
                left, c, right = unpacked(np.array([w["place"] for w in some], np.int64))
                for w, x, y, z in zip(some, left.tolist(), c.tolist(), right.tolist(), strict=True):
                    out.append((w["signature"], w["parts"], tid, component, w["start"], w["end"], w["shared"], x, y, h[4 * x : 4 * z + 4]))
                if len(out) > 1 << 14:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    def tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Tiles come sorted; one may reach over batches."""
        rest, names = None, ["a", "b", "p", "q"]
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            key = b[["signature", "lo", "hi"]].to_numpy()
            begin = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
            whole, rest = b.iloc[: begin[-1]], b.iloc[begin[-1] :].reset_index(drop=True)
            if len(whole):
                yield pd.DataFrame(compare_tiles(whole, begin[:-1], percent, words), columns=names)
        if rest is not None and len(rest):
            yield pd.DataFrame(compare_tiles(rest, np.array([0]), percent, words), columns=names)

    rows = texts.join(asked, "tid").select("tid", "component", "h", "asked").mapInPandas(cut, "signature long, parts int, tid long, component long, start int, end int, shared boolean, l int, c int, h binary")
    part = F.pmod(F.xxhash64("tid", "c"), F.col("parts")).cast("int")
    rows = rows.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("signature", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "tid", "component", "start", "end", "shared", "l", "c", "h")
    return stored(rows.repartition("signature", "lo", "hi").sortWithinPartitions("signature", "lo", "hi", "tid", "c").mapInPandas(tiles, f"a long, b long, p {_SPANS}, q {_SPANS}"), "links")


def near_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row for each document that shares a passage of at least `words` words with another one: id, component_id, n_component
    (documents of its component), passages array<struct<start, end>> in words.

    Passages are alike if the similarity of their sets of five-word shingles reaches percent. Documents with null ids or
    texts, or too few words, are in no row; equal texts are one text and, long enough, one passage; repetition inside one
    text doesn't count; rows that repeat an id each have their row; an empty table gives no rows; other columns, whatever
    their names, are not read.

    Every compact window (l, c, r) of each text and hash is a row keyed by its signature. Windows with equal contents are a
    passage as they are, and one of them stands for all. Every pair of the others that share a signature is compared, what
    is found is verified on the sets of both passages: in groups of up to FEW windows text by text, around all places at
    which two texts meet, in larger ones in tiles of windows. A pair of windows is left out only if both texts are in one
    component and what they have in common is in passages already. Two passages at the threshold share none of the four
    hashes with a chance of 0.2 %; equal passages share all.
    """
    if not SHINGLE <= words < 1 << 15:
        raise ValueError("words must lie between 5 and 32767")
    least = words - SHINGLE + 1
    base = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tid"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            b = whole.drop_duplicates("tid")
            tid = b["tid"].to_numpy()
            for which, h, size in cut_together(b["text"].tolist()):
                item, signature, place = windows_of(h, size, least)
                left, _, right = unpacked(place)
                begin = (np.cumsum(size) - size)[item]
                content = Hashes(h).of(begin + left, begin + right + 1).view(np.int64)
                yield pd.DataFrame({"signature": signature, "tid": tid[which][item], "place": place, "content": content})

    rows = base.select("tid", "text").mapInPandas(cut, "signature long, tid long, place long, content long")
    members = stored(_grouped(rows), "members")
    left, right = (F.shiftright("place", 32) - F.shiftright("place", 16).bitwiseAND(F.lit(0xFFFF))).cast("int"), (F.shiftright("place", 32) + F.col("place").bitwiseAND(F.lit(0xFFFF)) + SHINGLE).cast("int")
    spans = [members.where("shared").select("tid", left.alias("start"), right.alias("end")).distinct()]
    edges = [members.where("tid <> rep").select(F.col("rep").alias("a"), F.col("tid").alias("b")).distinct()]
    kept = members.where("kept and n > 1")
    # few windows of a signature: their texts meet in pairs; of one text, another one that has the same window stands for it
    group = kept.where(F.col("n") <= FEW).groupBy("signature").agg(F.array_sort(F.collect_list(F.struct("tid", "place", "other"))).alias("w"))
    each = group.select("w", F.posexplode("w").alias("i", "x")).select("x", F.explode(F.slice("w", F.col("i") + 2, F.lit(FEW))).alias("y"))
    apart = F.col("x.tid") != F.col("y.tid")
    lead = F.when(apart, F.col("x.tid")).otherwise(F.coalesce("x.other", "y.other"))
    each = each.select(lead.alias("lead"), F.when(apart | F.col("x.other").isNotNull(), F.col("y")).otherwise(F.col("x")).alias("y")).where("lead is not null")
    pairs = stored(each.groupBy("lead", F.col("y.tid").alias("tid")).agg(F.collect_set("y.place").alias("w")), "pairs")
    texts = _sequences(base, kept.select("tid").union(pairs.select("lead")))
    met = _met(pairs, texts, words, percent)
    for node, p in (("a", "p"), ("b", "q")):
        spans.append(_spans(met, node, p))
    known = stored(_runs(reduce(DataFrame.union, spans)), "runs")
    groups = connected(reduce(DataFrame.union, [*edges, met.select("a", "b")])).withColumnRenamed("node", "tid")
    spans = [known]
    rows = _open(kept.where(F.col("n") > FEW), known, groups)
    discard(pairs, met, members)
    if not rows.isEmpty():
        tiled = _tiled(rows, texts, words, percent)
        spans.append(_spans(tiled, "a", "p"))
        groups = connected(groups.select(F.col("component").alias("a"), F.col("tid").alias("b")).union(tiled.select("a", "b"))).withColumnRenamed("node", "tid")
    discard(rows, texts)
    held = base.groupBy("tid").agg(F.count("*").alias("n"), F.min("id").alias("rep")).join(groups, "tid", "left")
    named = held.select("tid", "n", "rep", F.coalesce("component", "tid").alias("c"))
    named = named.join(named.groupBy("c").agg(F.min("rep").alias("component_id"), F.sum("n").alias("n_component")), "c").select("tid", "component_id", "n_component")
    size = F.size(F.split(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), " "))
    copies = base.groupBy("tid").agg(F.count("*").alias("n"), F.max(size).alias("w")).where(F.col("n") > 1).where(F.col("w") >= words)
    spans.append(copies.select("tid", F.lit(0).alias("start"), F.col("w").alias("end")))
    per = _runs(reduce(DataFrame.union, spans)).groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("passages")).join(named, "tid")
    return base.select("id", "tid").join(per, "tid").select(F.col("id").alias(id_col), "component_id", "n_component", "passages")

"""Cuts texts into runs of windows that can only equal windows of runs with the same key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tessella.llm.common import mix64

#: Windows of one run at most, and bytes that are hashed together.
RUN, BUFFER = 400, 1 << 18

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, np.uint64(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hashes:
    """Polynomial hashes, modulo 2**64 and then mixed, of any part of a buffer of bytes, or of hashes of 64 bits."""

    up, down = _powers(_BASE, BUFFER), _powers(_INVERSE, BUFFER)

    def __init__(self, raw: np.ndarray):
        if len(raw) >= len(self.up):
            Hashes.up, Hashes.down = _powers(_BASE, 2 * len(raw)), _powers(_INVERSE, 2 * len(raw))
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((_BYTES[raw] if raw.dtype == np.uint8 else raw) * self.up[: len(raw)], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w values in a row: of blocks' running minima from both ends."""
    if w == 1:
        return x
    blocks = -(-len(x) // w)
    padded = np.full(blocks * w, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    padded = padded.reshape(blocks, w)
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(padded, axis=1).ravel()
    n = len(x) - w + 1
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The positions of all ranges, one after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length - start, length)


def runs(texts: list[bytes], window: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For buffers of texts: (text, start, count, key, content, twice, place), one value a run of `count` windows from `start`.

    A window's key is the least hash of the grams in it, so equal windows have equal keys wherever they stand. content is
    a hash of all bytes of the run's windows; twice tells that the run has its least gram more than once, without which
    no two windows of the run can be equal; place is where that gram first stands, from the run's start. Texts shorter than a window have no runs; long ones are cut into overlapping
    pieces.
    """
    pieces = []
    step = BUFFER - window
    for i, t in enumerate(texts):
        pieces += [(i, at, t[at : at + step + window - 1]) for at in range(0, len(t) - window + 1, step)]
    batch, size = [], 0
    for p in [*pieces, None]:
        if batch and (p is None or size + len(p[2]) > BUFFER):
            yield _runs(batch, window, gram)
            batch, size = [], 0
        if p:
            batch.append(p)
            size += len(p[2])


def _runs(pieces: list[tuple[int, int, bytes]], window: int, gram: int) -> tuple[np.ndarray, ...]:
    raw = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    h = Hashes(raw)
    at = np.arange(len(raw) - gram + 1)
    grams = h.of(at, at + gram)
    w = window - gram + 1
    least = sliding_min(grams, w)
    length = np.array([len(p[2]) for p in pieces])
    begin = np.cumsum(length) - length
    windows = length - window + 1
    new = np.ones(len(least) + 1, bool)
    new[1:-1] = least[1:] != least[:-1]
    # positions whose window would reach into the next piece belong to no run
    new[begin], new[begin + windows] = True, True
    cut = np.flatnonzero(new)
    start, count = cut[:-1], np.diff(cut)
    piece = np.searchsorted(begin, start, "right") - 1
    inside = start < begin[piece] + windows[piece]
    start, count, piece = start[inside], count[inside], piece[inside]
    parts = -(-count // RUN)
    nth = spread(np.zeros(len(parts), np.int64), parts)
    start, count, piece = np.repeat(start, parts) + nth * RUN, np.minimum(np.repeat(count, parts) - nth * RUN, RUN), np.repeat(piece, parts)
    key = least[start]
    span = count + w - 1
    first = np.cumsum(span) - span
    there = np.flatnonzero(grams[spread(start, span)] == np.repeat(key, span))
    nth = np.searchsorted(there, first)
    twice = np.searchsorted(there, first + span) - nth > 1
    place = there[nth] - first
    content = h.of(start, start + count + window - 1)
    text, offset = np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces])
    return text[piece], start - begin[piece] + offset[piece], count, key, content, twice, place

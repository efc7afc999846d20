"""Alignment kernels over batches of pairs.

Strings are rows of a padded matrix of integer symbols; a kernel walks the
cells of the dynamic programme once, each step for all pairs of the batch, with
rolling rows. Pairs are deduplicated and sorted by size first, so padding and
memory stay bounded whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa

#: Cells of the padded matrices of one kernel call; of one over plain strings, whose matrices should stay in the processor's cache.
CELLS, STRING_CELLS = 1 << 20, 1 << 15
#: Symbols of a row up to which a step for each pair of places is cheaper than a step for each place.
NARROW = 32
Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def padded(rows: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows as a matrix filled with -1, and their sizes."""
    size = np.array([len(r) for r in rows], np.int64)
    out = np.full((len(rows), max(1, int(size.max(initial=0)))), -1, np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = np.concatenate(rows) if len(rows) else []
    return out, size


def over_pairs(pairs: Sequence[tuple | None], encode: Callable[[object], np.ndarray], kernel: Kernel) -> list[float | None]:
    """``kernel`` of each pair (null for null), every different pair once, in blocks of like size."""
    place: dict[tuple, int] = {}
    for p in pairs:
        if p is not None and p not in place:
            place[p] = len(place)
    codes = {v: encode(v) for p in place for v in p}  # a string is part of many pairs
    symbols = [(codes[x], codes[y]) for x, y in place]
    order = sorted(range(len(symbols)), key=lambda k: (len(symbols[k][0]), len(symbols[k][1])))
    out = np.zeros(len(symbols))
    start = 0
    while start < len(order):
        stop, widest = start, 1
        while stop < len(order):
            x, y = symbols[order[stop]]
            wider = max(widest, len(x), len(y))
            if stop > start and wider * (stop - start + 1) > CELLS:
                break
            widest, stop = wider, stop + 1
        block = order[start:stop]
        (a, m), (b, n) = padded([symbols[k][0] for k in block]), padded([symbols[k][1] for k in block])
        out[block] = kernel(a, m, b, n)
        start = stop
    return [None if p is None else float(out[place[p]]) for p in pairs]


def string_codes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all strings one after another, and where each string starts (nulls as empty ones)."""
    values = values.cast(pa.large_string())
    values = values.fill_null("") if values.null_count else values
    if not len(values):
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    _, places, data = values.buffers()
    at = np.frombuffer(places, np.int64)[values.offset : values.offset + len(values) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    if raw.max(initial=0) < 128:
        return raw.astype(np.int32), at
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points that start before each byte
    wide = raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass")
    return np.frombuffer(wide, np.uint32).astype(np.int32), before[at]


def string_rows(codes: np.ndarray, start: np.ndarray, size: np.ndarray, fill: int) -> np.ndarray:
    """Strings of ``codes`` as rows of a matrix padded with ``fill``."""
    place = np.arange(max(1, int(size.max(initial=0))))
    inside = place < size[:, None]
    out = np.full(inside.shape, fill, np.int32)
    out[inside] = codes[(start[:, None] + place)[inside]]
    return out


def over_strings(x: pa.Array, y: pa.Array, kernel: Kernel) -> pa.Array:
    """``kernel`` of each pair of strings, null for null, in blocks of like size without an object for any string."""
    (cx, sx), (cy, sy) = string_codes(x), string_codes(y)
    m, n = np.diff(sx), np.diff(sy)
    width = np.maximum(np.maximum(m, n), 1)
    order = np.argsort(width, kind="stable")
    width, out, start = width[order], np.zeros(len(order)), 0
    while start < len(order):
        stop = min(len(order), start + max(1, STRING_CELLS // int(width[start])))
        stop = min(stop, start + max(1, STRING_CELLS // int(width[stop - 1])))
        rows = order[start:stop]
        out[rows] = kernel(string_rows(cx, sx[rows], m[rows], -1), m[rows], string_rows(cy, sy[rows], n[rows], -2), n[rows])
        start = stop
    null = np.asarray(x.is_null()) | np.asarray(y.is_null()) if x.null_count or y.null_count else None
    return pa.array(out, pa.float64(), mask=null)


def alone(kernel: Kernel, x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """``kernel`` of each row with itself, every different row once."""
    different, back = np.unique(np.column_stack([x, m]), axis=0, return_inverse=True)
    y, n = different[:, :-1], different[:, -1]
    return kernel(y, n, y, n)[back.ravel()]


def code_points(s: str) -> np.ndarray:
    """Code points of ``s``."""
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def edit_distance(insert: float, delete: float, substitute: float) -> Kernel:
    """Least cost of insertions, deletions and substitutions that turn x into y."""

    def run(x: np.ndarray, m: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        row = np.broadcast_to(np.arange(y.shape[1] + 1) * insert, (len(x), y.shape[1] + 1)).astype(float)
        out = np.where(m == 0, n * insert, 0.0)
        for i in range(x.shape[1]):
            swap = row[:, :-1] + np.where(y == x[:, i, None], 0.0, substitute)
            step = np.minimum(row[:, 1:] + delete, swap)
            new = np.empty_like(row)
            new[:, 0] = (i + 1) * delete
            for j in range(y.shape[1]):
                new[:, j + 1] = np.minimum(step[:, j], new[:, j] + insert)
            row = new
            done = m == i + 1
            out[done] = row[done, n[done]]
        return out

    return run


def common_subsequence(x: np.ndarray, m: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence; padding never matches as y's is made different."""
    y = np.where(y < 0, -2, y)
    row = np.zeros((len(x), y.shape[1] + 1), np.int64)
    for i in range(x.shape[1]):
        # Along the row the best so far only grows, so a running maximum replaces the inner loop.
        new = row.copy()
        new[:, 1:] = np.maximum(row[:, 1:], np.where(y == x[:, i, None], row[:, :-1] + 1, 0))
        row = np.maximum.accumulate(new, axis=1)
    return row[:, -1].astype(float)


def jaro(x: np.ndarray, m: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Jaro similarity with greedy matching and whole transpositions."""
    hit_x, hit_y = (_matches_narrow if max(x.shape[1], y.shape[1]) <= NARROW else _matches)(x, m, y, n)
    count = hit_x.sum(1)
    at = np.cumsum(count) - count  # both sides have as many matches: pair by pair, the k-th stand at the same place
    differ = np.concatenate([[0], np.cumsum(x[hit_x] != y[hit_y])])
    moved = (differ[at + count] - differ[at]) // 2
    c = np.maximum(count, 1)
    value = (c / np.maximum(m, 1) + c / np.maximum(n, 1) + (c - moved) / c) / 3
    return np.where((m == 0) & (n == 0), 1.0, np.where(count == 0, 0.0, value))


def _matches(x: np.ndarray, m: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of both sides that Jaro's greedy search matches; a step for each place of x."""
    window = np.maximum(0, np.maximum(m, n) // 2 - 1)
    place = np.arange(y.shape[1])
    free = place < n[:, None]
    hit_x, rows = np.zeros(x.shape, bool), np.arange(len(x))
    for i in range(x.shape[1]):
        ok = free & (y == x[:, i, None]) & (np.abs(place - i) <= window[:, None]) & (i < m)[:, None]
        found = ok.any(1)
        free[rows[found], ok.argmax(1)[found]] = False
        hit_x[:, i] = found
    return hit_x, ~free & (place < n[:, None])


def _matches_narrow(x: np.ndarray, m: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``_matches``; a step for each two places, over contiguous columns."""
    window = np.maximum(0, np.maximum(m, n) // 2 - 1)
    near = [window >= d for d in range(int(window.max(initial=0)) + 1)]
    wide, high = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    hit_x, hit_y = np.zeros(wide.shape, bool), np.zeros(high.shape, bool)
    inside_x, inside_y = np.arange(len(wide))[:, None] < m, np.arange(len(high))[:, None] < n
    free = inside_y.copy()
    for i in range(len(wide)):
        todo = inside_x[i].copy()
        for j in range(max(0, i - len(near) + 1), min(len(high), i + len(near))):
            ok = (wide[i] == high[j]) & free[j] & todo
            ok &= near[abs(i - j)]
            free[j] ^= ok
            todo ^= ok
        hit_x[i] = inside_x[i] & ~todo
    np.logical_and(inside_y, ~free, out=hit_y)
    return np.ascontiguousarray(hit_x.T), np.ascontiguousarray(hit_y.T)


def _shared(x: np.ndarray, m: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Length of the common prefix."""
    width = min(x.shape[1], y.shape[1])
    differ = np.ones((len(x), width + 1), bool)
    place = np.arange(width)
    differ[:, :width] = (x[:, :width] != y[:, :width]) | (place >= np.minimum(m, n)[:, None])
    return differ.argmax(1)


def jaro_winkler(scale: float, most: int) -> Kernel:
    """Jaro similarity and ``scale`` of what it lacks for each symbol of the common prefix, ``most`` at most."""

    def run(x: np.ndarray, m: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        j = jaro(x, m, y, n)
        bonus = np.minimum(_shared(x[:, : max(1, most)], m, y[:, : max(1, most)], n), most) * scale * (1 - j)
        return np.where(j == 0, 0.0, np.clip(j + bonus, 0.0, 1.0))

    return run


def _of_longer(shared: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    most = np.maximum(m, n)
    return np.where(most == 0, 1.0, shared / np.maximum(most, 1))


def prefix_share(x: np.ndarray, m: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Common prefix over the longer size, 1 for two empty sides."""
    return _of_longer(_shared(x, m, y, n), m, n)


def suffix_share(x: np.ndarray, m: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Common suffix over the longer size, 1 for two empty sides."""
    back = lambda s, size: np.take_along_axis(s, np.maximum(size[:, None] - 1 - np.arange(s.shape[1]), 0), 1)
    return _of_longer(_shared(back(x, m), m, back(y, n), n), m, n)


def _gram_names(s: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """A number for each window of ``n`` symbols of each row, equal for equal windows, and how many numbers there may be."""
    seen = np.zeros(int(s.max(initial=0)) + 2, bool)
    seen[s + 1] = True
    names = (np.cumsum(seen) - 1)[s + 1]
    base = int(names.max(initial=0)) + 1
    out, many = names[:, : s.shape[1] - n + 1], base
    for k in range(1, n):
        if many * base >= 1 << 61:
            different, out = np.unique(out, return_inverse=True)
            out, many = out.reshape(len(s), -1), len(different)
        out = out * base + names[:, k : s.shape[1] - n + 1 + k]
        many *= base
    return out, many


def gram_share(n: int, before: int, after: int, share: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> Kernel:
    """``share(both, of x, of y)`` of the numbers of different windows of ``n`` symbols, padded with spaces."""

    def padded_rows(s: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
        out = np.full((len(s), width), -1, np.int32)
        out[:, :before] = 32
        out[:, before : before + s.shape[1]] = np.maximum(s, -1)
        if after:
            rows, place = np.arange(len(s))[:, None], (before + size)[:, None] + np.arange(after)
            out[rows, place] = 32
        return out

    def run(x: np.ndarray, m: np.ndarray, y: np.ndarray, k: np.ndarray) -> np.ndarray:
        width = max(n, before + max(x.shape[1], y.shape[1]) + after)
        names, many = _gram_names(np.concatenate([padded_rows(x, m, width), padded_rows(y, k, width)]), n)
        half, windows = len(x), names.shape[1]
        place = np.arange(windows)
        held = np.empty((half, 2 * windows), np.int64)
        # Twice the number, and 1 for y's: once sorted, equal windows of both sides are neighbours. Places without a window come last.
        held[:, :windows] = np.where(place < (m + before + after - n + 1)[:, None], 2 * names[:half], 2 * many)
        held[:, windows:] = np.where(place < (k + before + after - n + 1)[:, None], 2 * names[half:] + 1, 2 * many)
        held.sort(axis=1)
        new = np.ones(held.shape, bool)
        new[:, 1:] = held[:, 1:] != held[:, :-1]
        new &= held < 2 * many
        side = (held & 1).astype(bool)
        of_y = (new & side).sum(1)
        both = (new[:, 1:] & (held[:, 1:] >> 1 == held[:, :-1] >> 1)).sum(1)
        return share(both, new.sum(1) - of_y, of_y)

    return run


def grouped_edit_distance(gap: np.ndarray, swap: np.ndarray, first: float) -> Kernel:
    """Edit distance whose gap cost depends on the letter before (``gap[letter, before]``) and swap cost on both letters."""

    def gaps(s: np.ndarray) -> np.ndarray:
        out = np.full(s.shape, first)
        out[:, 1:] = gap[s[:, 1:], s[:, :-1]]
        return out

    def run(x: np.ndarray, m: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        across, down = gaps(y), gaps(x)
        row = np.zeros((len(x), y.shape[1] + 1))
        np.cumsum(across, axis=1, out=row[:, 1:])
        out = np.where(m == 0, row[np.arange(len(x)), n], 0.0)
        for i in range(x.shape[1]):
            step = np.minimum(row[:, 1:] + down[:, i, None], row[:, :-1] + swap[x[:, i, None], y])
            new = np.empty_like(row)
            new[:, 0] = row[:, 0] + down[:, i]
            for j in range(y.shape[1]):
                new[:, j + 1] = np.minimum(step[:, j], new[:, j] + across[:, j])
            row = new
            done = m == i + 1
            out[done] = row[done, n[done]]
        return out

    return run


def local_alignment(skip: float, swap: np.ndarray, widen: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> Kernel:
    """Best local alignment with skips, swaps, and one symbol against two neighbours (``widen(one, before, at)``)."""

    def run(x: np.ndarray, m: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        shape = (len(x), y.shape[1] + 1)
        before, row, best = np.zeros(shape), np.zeros(shape), np.zeros(len(x))
        inside = np.arange(y.shape[1]) < n[:, None]
        for i in range(x.shape[1]):
            here = x[:, i, None]
            step = np.maximum(0.0, np.maximum(row[:, 1:] + skip, row[:, :-1] + swap[here, y]))
            if i:
                step = np.maximum(step, before[:, :-1] + widen(y, x[:, i - 1, None], here))
            if y.shape[1] > 1:
                step[:, 1:] = np.maximum(step[:, 1:], row[:, :-2] + widen(here, y[:, :-1], y[:, 1:]))
            new = np.zeros(shape)
            for j in range(y.shape[1]):
                new[:, j + 1] = np.maximum(step[:, j], new[:, j] + skip)
            before, row = row, new
            best = np.maximum(best, np.where(inside & (i < m)[:, None], row[:, 1:], 0.0).max(1))
        return best

    return run

"""All pairs of strings whose Jaro-Winkler similarity reaches a threshold: no block of letters, no cut by language or length.

Strings are dealt into blocks; a task compares two blocks. Within a task, tables of strings of two lengths are compared
by signatures of their letters, which bound the number of letters that can match from above; only pairs that may reach
the threshold are scored. Work grows with the square of the strings; memory is that of two blocks and their pairs found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisim.functions import kernels
from lexisim.functions.scorers import JaroWinkler
from lexisim.functions.text import six_places

#: Strings of a block at most, on average; rows and columns of signatures compared at a time; pairs scored at a time.
BLOCK, ROWS, COLUMNS, SCORED = 1 << 15, 128, 2048, 1 << 17
#: What rounding to six places may add to a value.
SLACK = 1e-6


def signatures(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64 bits of each row's symbols: one for each symbol and how often it came before.

    A bit of one side that the other lacks is a symbol that cannot be matched, whatever shares the bit.
    """
    out = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        before = (rows[:, :k] == rows[:, k, None]).sum(1)
        kind = (rows[:, k] - 97) % 26
        bit = np.where(before < 2, kind + 26 * before, 52 + (kind + 5 * before) % 12).astype(np.uint64)
        out |= np.where(k < size, np.uint64(1) << bit, np.uint64(0))
    return out


def most_unmatched(a: int, b: int, threshold: float, scale: float, prefix: int) -> list[int]:
    """For a common prefix of 0 to ``prefix``: how many symbols of both sides may stay unmatched; below 0 for none that reach the threshold."""
    out = []
    for shared in range(prefix + 1):
        jaro = (threshold - SLACK - shared * scale) / (1 - shared * scale)
        least = max(1, math.ceil((3 * jaro - 1) * a * b / (a + b) - 1e-9))
        out.append(a + b - 2 * least if least <= min(a, b) else -1)
    return out


class _Classes:
    """Strings of equal keys and signatures as one class each, in the order of the keys: a class is compared once for all its strings."""

    def __init__(self, bits: np.ndarray, *keys: np.ndarray):
        self.place = np.lexsort((bits, *reversed(keys)))
        new = np.ones(len(bits), bool)
        new[1:] = np.any([k[self.place][1:] != k[self.place][:-1] for k in (bits, *keys)], axis=0)
        self.start = np.flatnonzero(new)
        self.many = np.diff([*self.start, len(bits)])
        self.bits = bits[self.place][self.start]
        self.keys = [k[self.place][self.start] for k in keys]

    def runs(self) -> dict[tuple, tuple[int, int]]:
        """Keys -> begin and end of their classes."""
        new = np.ones(len(self.bits), bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in self.keys], axis=0)
        at = np.flatnonzero(new)
        return {tuple(int(k[s]) for k in self.keys): (int(s), int(e)) for s, e in zip(at, [*at[1:], len(new)], strict=True)}


class _Side:
    """Strings of one block by length, and by length and first symbol."""

    def __init__(self, words: pa.Array):
        codes, start = kernels.string_codes(words)
        size = np.diff(start)
        full = np.flatnonzero(size)
        self.words, self.size = words.take(pa.array(full)), size[full]
        self.rows = kernels.string_rows(codes, start[:-1][full], self.size, -1)
        bits = signatures(self.rows, self.size)
        self.by_size, self.by_first = _Classes(bits, self.size), _Classes(bits, self.size, self.rows[:, 0])


def _tables(x: _Classes, y: _Classes, span: tuple[int, int], other: tuple[int, int], above: int, most: int, triangle: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Strings of classes and how many bits are unlike, more than ``above`` and ``most`` at most; a few classes at a time."""
    for r in range(*span, ROWS):
        left = x.bits[r : min(r + ROWS, span[1]), None]
        for c in range(max(other[0], r) if triangle else other[0], other[1], COLUMNS):
            unlike = np.bitwise_count(left ^ y.bits[c : min(c + COLUMNS, other[1])])
            ok = unlike <= most
            if above >= 0:
                ok &= unlike > above
            found = np.flatnonzero(ok)
            sums = np.cumsum(x.many[(k := found // unlike.shape[1]) + r] * y.many[found - k * unlike.shape[1] + c])
            done = 0
            while done < len(found):
                # As many pairs of classes as have SCORED pairs of strings, one at least.
                stop = max(done + 1, int(np.searchsorted(sums, (sums[done - 1] if done else 0) + SCORED, "right")))
                part = found[done:stop]
                i, j = np.divmod(part, unlike.shape[1])
                n, m = x.many[i + r], y.many[j + c]
                pair = np.repeat(np.arange(len(part)), n * m)
                at = np.arange(len(pair)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
                one, two = x.start[i + r][pair] + at // m[pair], y.start[j + c][pair] + at % m[pair]
                keep = one < two if triangle else slice(None)
                yield x.place[one[keep]], y.place[two[keep]], unlike.ravel()[part][pair][keep]
                done = stop


def _found(x: _Side, y: _Side, same: bool, threshold: float, scorer: JaroWinkler) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    scale, prefix = float(scorer.prefix_scale), scorer.max_prefix_length
    score = kernels.jaro_winkler(scale, prefix)

    def scored(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        value, step = np.zeros(len(i)), max(1, kernels.STRING_CELLS // max(a, b))
        for s in range(0, len(i), step):
            one, two = i[s : s + step], j[s : s + step]
            value[s : s + step] = score(x.rows[one, :a], x.size[one], y.rows[two, :b], y.size[two])
        ok = value >= threshold - SLACK
        return i[ok], j[ok], value[ok]

    mine, theirs = x.by_first.runs(), y.by_first.runs()
    for (a,), span in x.by_size.runs().items():
        for (b,), other in y.by_size.runs().items():
            if same and b < a:
                continue
            most = most_unmatched(a, b, threshold, scale, prefix)
            runs = [(x.by_size, y.by_size, span, other, -1, most[0])] if most[0] >= 0 else []
            if max(most) > most[0]:
                runs += [(x.by_first, y.by_first, at, theirs[b, k], most[0], max(most)) for (n, k), at in mine.items() if n == a and (b, k) in theirs]
            parts, many = [], 0
            for one, two, rows, columns, above, top in runs:
                for i, j, unlike in _tables(one, two, rows, columns, above, top, same and a == b):
                    if top > most[0]:
                        width = min(prefix, a, b)
                        alike = np.logical_and.accumulate(x.rows[i, :width] == y.rows[j, :width], axis=1).sum(1)
                        keep = unlike <= np.array(most)[alike]
                        i, j = i[keep], j[keep]
                    parts.append((i, j))
                    many += len(i)
                    if many >= SCORED:
                        yield scored(parts)
                        parts, many = [], 0
            if parts:
                yield scored(parts)


def close_pairs(x: pa.Array, y: pa.Array | None, threshold: float, scorer: JaroWinkler) -> pa.Table:
    """x_1, x_2 (in order) and value of all pairs of ``x`` and ``y``, or of different places of ``x``, that may reach the threshold once rounded."""
    one = _Side(x)
    two = one if y is None else _Side(y)
    made = [pa.table({"u": one.words.take(pa.array(i)), "v": two.words.take(pa.array(j)), "value": v}) for i, j, v in _found(one, two, y is None, threshold, scorer)]
    none = pa.table({"u": pa.array([], x.type), "v": pa.array([], x.type), "value": pa.array([], pa.float64())})
    return pa.concat_tables([none, *made])


def jaro_winkler_join(words: DataFrame, threshold: float, scorer: JaroWinkler | None = None) -> DataFrame:
    """x_1 < x_2 and value (six places) of all pairs of the different, non-empty strings ``w`` whose value is ``threshold`` at least."""
    scorer = scorer or JaroWinkler()
    cores = words.sparkSession.sparkContext.defaultParallelism
    # The tables that are compared shrink with the square of the blocks: some for each core, however few the words.
    blocks = max(math.ceil(words.count() / BLOCK), math.ceil(math.sqrt(4 * cores)))
    tasks = blocks * (blocks + 1) // 2
    # Strings of the same letters go to the same block, where they are compared as one.
    h = F.pmod(F.xxhash64(F.array_sort(F.split("w", ""))), F.lit(blocks)).cast("int")
    dealt = words.select("w", h.alias("h")).select("w", "h", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o"))
    dealt = dealt.select("w", F.least("h", "o").alias("i"), F.greatest("h", "o").alias("j"), (F.col("h") <= F.col("o")).alias("low"))

    def compare(table: pa.Table) -> pa.Table:
        low = table["low"]
        x = table.filter(low)["w"].combine_chunks()
        alone = table["i"][0].as_py() == table["j"][0].as_py()
        y = None if alone else table.filter(pc.invert(low))["w"].combine_chunks()
        return close_pairs(x, y, threshold, scorer)

    found = dealt.repartition(2 * tasks, "i", "j").groupBy("i", "j").applyInArrow(compare, "u string, v string, value double")
    value = six_places(F.col("value"))
    return found.select(F.least("u", "v").alias("x_1"), F.greatest("u", "v").alias("x_2"), value.alias("value")).where(F.col("value") >= threshold)

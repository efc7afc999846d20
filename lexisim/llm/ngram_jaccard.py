"""N-gram Jaccard join by a prefix tree.

A document's set is its distinct ``n``-word shingles (A-Z lower-cased; with
fewer words, the whole sequence as one), as 64-bit hashes in one global order:
rare shingles first, by a count sketch over the whole corpus, then by hash.
Two sets link when ``100 * common >= percent * union``.

* Equal sets are one node; copies are never paired.
* Sets that link share a shingle among the first ``n - ceil(percent * n) + 1``
  of each (the prefix). Nodes that share a prefix shingle form a bucket; each
  is compared with the bucket's leader first, so a large group of near copies
  is a star, not all its pairs. Then only pairs of nodes that are still in
  different components are compared. Positions in the order and set sizes bound
  the common part that a pair can have, and rule out most pairs unseen.
* A comparison block stores up to ``MEMBERS`` globally ordered sets in a trie
  and walks it level by level for one probe set: members that share a path share
  its partial overlap, and what the remaining lengths can no longer lift to the
  required overlap is pruned.
* Components of the verified links come from a distributed star algorithm.

No pair is lost: every pair that could link and is not already connected gets
verified in the second round. Buckets, classes and components are never
gathered; hot shingles (a bucket of more than ``HOT`` nodes, counted exactly
where the sketch leaves it open) are salted in both rounds. Texts that share a
hot shingle in their prefix but differ are still compared pair by pair, as far
as sizes, places and histograms leave room.

Defined cases: null, empty and white texts have no shingles and are linked
with nothing (their component is their own id); repeated rows are copies; a
null ``doc_id`` takes part, and a component of null ids only has id null; an
empty table gives an empty result; very long texts are used whole; other
columns are not read. Nodes are named by 64 bits of their set's hash: N
different sets collide with probability N**2 / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisim.llm.common import bound_batches, chunks, few, materialise, mix64, release, span_hashes, text_bytes, word_spans
from lexisim.llm.components import components

#: Cells of the count sketch (a bounded broadcast) and bits of the filter on nodes (another).
CELLS, BITS = 1 << 18, 1 << 23
#: Nodes of a shingle's bucket above which it is salted; members of a comparison block.
HOT, MEMBERS = 200_000, 256
#: Pairs of a bucket that are looked at side by side (some 100 bytes each).
STEP = 1 << 18
#: Bins of a set's histogram, which bounds the common part of two sets from above: BINS, doubled until a bin has
#: PER_BIN shingles at most (with many in a bin, unlike sets look alike).
BINS, PER_BIN = 128, 8
_K1, _K2 = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of each row, in the order of the text, and the rows' offsets into them."""
    starts, ends, words = word_spans(data, off)
    h = span_hashes(data, starts, ends, lower=True)
    have = np.diff(words)
    count = np.where(have >= n, have - n + 1, np.minimum(have, 1))
    edge = np.zeros(len(off), np.int64)
    np.cumsum(count, out=edge[1:])
    row = np.repeat(np.arange(len(count)), count)
    first = words[row] + np.arange(edge[-1]) - edge[row]
    x = np.zeros(len(first), np.uint64)
    padded = np.concatenate([h, np.zeros(n, np.uint64)])
    for k in range(n):
        x = np.where(have[row] > k, mix64(x + padded[first + k] + np.uint64(k)), x)
    return x, edge


def _ordered(x: np.ndarray, edge: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' distinct shingles in the global order, and their offsets."""
    row = np.repeat(np.arange(len(edge) - 1, dtype=np.uint64), np.diff(edge))
    cell = sketch[(x & np.uint64(len(sketch) - 1)).astype(np.int64)].astype(np.uint64)
    order = np.argsort(x)
    order = order[np.argsort(row[order] << np.uint64(32) | cell[order], kind="stable")]
    x, row = x[order], row[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (row[1:] != row[:-1])
    x, row = x[new], row[new]
    return x, np.searchsorted(row, np.arange(len(edge), dtype=np.uint64))


def _sums(x: np.ndarray, edge: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=total[1:])
    return total[edge[1:]] - total[edge[:-1]]


def _nodes(x: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """A set's name: 64 bits of an order-free hash of it and its size."""
    size = np.diff(edge).astype(np.uint64)
    return mix64(_sums(mix64(x ^ _K1), edge) + mix64(_sums(mix64(x ^ _K2), edge) + size)).view(np.int64)


def histograms(x: np.ndarray, edge: np.ndarray) -> list[bytes]:
    """How many shingles of each row fall into each bin, as 16-bit numbers; the number of bins follows the row's size."""
    size = np.diff(edge)
    width = np.full(len(size), BINS)
    while (small := width * PER_BIN < size).any():
        width[small] *= 2
    base = np.zeros(len(size) + 1, np.int64)
    np.cumsum(width, out=base[1:])
    row = np.repeat(np.arange(len(size)), size)
    bins = np.bincount(base[row] + ((x >> np.uint64(24)).astype(np.int64) & (width[row] - 1)), minlength=int(base[-1]))
    raw = np.minimum(bins, 65535).astype(np.uint16).tobytes()
    return [raw[2 * a : 2 * b] for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


def common_at_most(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """For each pair of histograms, the most shingles that both sets can have (2**62 where a bin is at its limit)."""
    out = np.zeros(len(x), np.int64)
    kinds = np.array([len(a) << 32 | len(b) for a, b in zip(x, y, strict=True)], np.int64)
    for kind in np.unique(kinds):
        at = np.flatnonzero(kinds == kind)
        full, parts = np.zeros(len(at), bool), []
        bins = min(int(kind) >> 32, int(kind) & 0xFFFFFFFF) // 2
        for side in (x, y):
            h = np.frombuffer(b"".join(side[k] for k in at.tolist()), np.uint16).reshape(len(at), -1)
            full |= (h == 65535).any(1)
            parts.append(h.reshape(len(at), -1, bins).sum(1, dtype=np.int64))  # bins that are one in the shorter one
        out[at] = np.where(full, 1 << 62, np.minimum(*parts).sum(1))
    return out


def _count_cells(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for whole in batches:
            for batch in chunks(whole):
                x, _ = shingle_sets(*text_bytes(batch.column(0)), n)
                total += np.bincount((x & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(total[cell])], ["cell", "n"])

    return run


def sketch_counts(docs: DataFrame, n: int) -> np.ndarray:
    """How many shingles of the whole corpus fall into each of CELLS cells (at most CELLS rows reach the driver)."""
    rows = docs.select("text").mapInArrow(_count_cells(n), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CELLS, np.int64)
    out[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return np.minimum(out, (1 << 32) - 1).astype(np.uint32)


def _describe(n: int, percent: int, sketch: Broadcast):
    """node, n_shingles and the prefix (with salts) of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for whole in batches:
            for batch in chunks(whole):
                x, edge = _ordered(*shingle_sets(*text_bytes(batch.column(1)), n), counts)
                size = np.diff(edge)
                keep = np.where(size > 0, size - (percent * size + 99) // 100 + 1, 0)
                off = np.zeros(len(size) + 1, np.int32)
                np.cumsum(keep, out=off[1:])
                row = np.repeat(np.arange(len(size)), keep)
                token = x[edge[row] + np.arange(off[-1]) - off[row]]
                salts = counts[(token & np.uint64(CELLS - 1)).astype(np.int64)] // HOT + 1
                prefix = pa.ListArray.from_arrays(pa.array(off), pa.array(token.view(np.int64)))
                salted = np.repeat(np.bincount(row, salts > 1, len(size)) > 0, keep)  # rows without a hot shingle have no list
                many = np.zeros(len(size) + 1, np.int32)
                np.cumsum(np.bincount(row[salted], minlength=len(size)), out=many[1:])
                salts = pa.ListArray.from_arrays(pa.array(many), pa.array(salts[salted].astype(np.int32)))
                node = pa.array(_nodes(x, edge), pa.int64(), mask=size == 0)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), node, prefix, salts, pa.array(histograms(x, edge), pa.binary())], ["doc_id", "n_shingles", "node", "prefix", "salts", "bins"])

    return run


def _read_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of whole groups (rows with equal keys are adjacent), a batch or more at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        last = np.ones(batch.num_rows, bool)
        for c in columns:
            last &= c == c[-1]
        cut = int(batch.num_rows - np.argmin(last[::-1])) if not last.all() else 0
        same = bool(held) and all(h.column(k)[-1].as_py() == batch.column(k)[0].as_py() for h, k in ((held[-1], k) for k in keys))
        if cut == 0 and (same or not held):
            held.append(batch)
            continue
        ready = [*held, batch.slice(0, cut)] if cut else held
        yield _columns(ready)
        held = [batch.slice(cut)]
    if held:
        yield _columns(held)


def _columns(batches: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    table = pa.Table.from_batches(batches)
    return {c: table.column(c).to_numpy() for c in table.column_names}


def _lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of buckets with two nodes or more, with the bucket's leader (its first row: the least place, then size)."""
    names = ["token", "salts", "node", "n", "pos", "leader", "leader_n", "leader_pos"]
    for g in _read_groups(batches, ["token", "salt"]):
        new = np.ones(len(g["token"]), bool)
        new[1:] = (g["token"][1:] != g["token"][:-1]) | (g["salt"][1:] != g["salt"][:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(new)))
        keep = np.repeat((size > 1) | (g["salts"][first] > 1), size)
        at = np.repeat(first, size)[keep]
        out = [g[c][keep] for c in ("token", "salts", "node", "n", "pos")] + [g["node"][at], g["n"][at], g["pos"][at]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names)


def _cross(percent: int):
    """Pairs of a bucket's nodes in different components whose sizes and places let them link.

    A salted bucket comes in cells: (x, y) has the rows of salts x and y, whose pairs are formed there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _read_groups(batches, ["token", "x", "y"]):
            token, x, y, salt, comp, node, n, pos = (g[c] for c in ("token", "x", "y", "salt", "comp", "node", "n", "pos"))
            other = np.r_[True, (token[1:] != token[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
            cell = np.flatnonzero(other)
            run_ = np.flatnonzero(other | np.r_[True, comp[1:] != comp[:-1]])
            stop_cell = np.repeat(np.append(cell[1:], len(token)), np.diff(np.append(cell, len(token))))
            stop_run = np.repeat(np.append(run_[1:], len(token)), np.diff(np.append(run_, len(token))))
            many = stop_cell - stop_run  # partners after the own component's rows
            total = np.zeros(len(many) + 1, np.int64)
            np.cumsum(many, out=total[1:])
            start = 0
            while start < len(many):
                stop = max(start + 1, int(np.searchsorted(total, total[start] + STEP, "right")) - 1)
                for low in range(0, int(total[stop] - total[start]), STEP):  # one row may have more partners than that
                    flat = np.arange(low, min(low + STEP, int(total[stop] - total[start]))) + total[start]
                    i = np.searchsorted(total, flat, "right") - 1
                    j = stop_run[i] + flat - total[i]
                    need = (percent * (n[i] + n[j]) + 99 + percent) // (100 + percent)
                    ok = (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need) & ((x[i] == y[i]) | (salt[i] != salt[j]))
                    i, j = i[ok], j[ok]
                    if len(i):
                        a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                start = stop

    return run


def _full_sets(n: int, sketch: Broadcast, wanted: Broadcast):
    """The ordered sets of the nodes that a bit filter lets through, once each in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, bits = sketch.value, wanted.value
        seen: set[int] = set()
        for whole in batches:
            for batch in chunks(whole):
                x, edge = _ordered(*shingle_sets(*text_bytes(batch.column(0)), n), counts)
                node = _nodes(x, edge)
                place = (node.view(np.uint64) >> np.uint64(11)) & np.uint64(BITS - 1)
                hit = np.flatnonzero((bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 & (np.diff(edge) > 0))
                out = []
                for k in hit.tolist():
                    name = int(node[k])
                    if name not in seen:
                        seen.add(name)
                        out.append((name, x[edge[k] : edge[k + 1]].tobytes()))
                if len(seen) > 500_000:
                    seen.clear()
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], ["node", "tokens"])

    return run


def walk(probes: list[np.ndarray], members: list[tuple[int, np.ndarray]], percent: int) -> np.ndarray:
    """For each member (number of its probe, ordered set): whether it links with its probe.

    The members of each probe are a trie: sorted, with the length that each shares with the one before. The walk
    goes down all tries level by level. A subtree looks its shingle up once and has one partial overlap. It is pruned
    once what remains of its longest member, or of the probe behind the last hit, can't lift the overlap to what its
    least demanding member needs; a member leaves it once it links or ends.
    """
    linked = np.zeros(len(members), bool)
    if not members:
        return linked
    order = sorted(range(len(members)), key=lambda k: (members[k][0], members[k][1].astype(">u8").tobytes()))
    group = np.array([members[k][0] for k in order])
    size = np.array([len(members[k][1]) for k in order])
    off = np.zeros(len(order) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    tokens = np.concatenate([members[k][1] for k in order])
    # Shared lengths of neighbours.
    shared = np.zeros(len(order), np.int64)
    if len(order) > 1:
        both = np.where(group[1:] == group[:-1], np.minimum(size[1:], size[:-1]), 0)
        edge = np.zeros(len(both) + 1, np.int64)
        np.cumsum(both, out=edge[1:])
        pair = np.repeat(np.arange(len(both)), both)
        k = np.arange(edge[-1]) - edge[pair]
        differ = tokens[off[pair] + k] != tokens[off[pair + 1] + k]
        at = np.flatnonzero(differ)
        first = np.searchsorted(at, edge[:-1])
        stop = np.where(first < len(at), at[np.minimum(first, max(len(at) - 1, 0))] if len(at) else 0, edge[-1])
        shared[1:] = np.minimum(stop - edge[:-1], both)
    probe_size = np.array([len(p) for p in probes])
    keys = mix64(np.concatenate(probes) + np.repeat(np.arange(len(probes), dtype=np.uint64), probe_size) * _K1)
    ranks = np.argsort(keys)
    keys = keys[ranks]
    ranks = ranks - np.repeat(np.cumsum(probe_size) - probe_size, probe_size)[ranks]  # places within their probes
    need = (percent * (size + probe_size[group]) + 99 + percent) // (100 + percent)
    slack = size - need  # shingles that a member may have and its probe not

    live = np.flatnonzero(np.minimum(size, probe_size[group]) >= need)
    same = _shared_of(shared, live)
    depth = 0
    # A subtree is a run of live members on one path; it has one overlap, and the place of the probe's last hit.
    runs = np.flatnonzero(np.r_[True, group[live[1:]] != group[live[:-1]]]) if len(live) else live
    overlap, last = np.zeros(len(runs), np.int64), np.full(len(runs), -1)
    while len(live):
        lead = np.flatnonzero(np.r_[True, same[1:] <= depth])
        up = np.searchsorted(runs, lead, "right") - 1
        runs, overlap, last = lead, overlap[up], last[up]
        probe = group[live[lead]]
        x = mix64(tokens[off[live[lead]] + depth] + probe.astype(np.uint64) * _K1)
        place = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        hit = keys[place] == x
        overlap = overlap + hit
        last = np.where(hit, ranks[place], last)
        depth += 1
        least = np.minimum.reduceat(need[live], runs)
        # What is left of a subtree's longest member, or of the probe behind its last hit, can no longer suffice.
        cut = (depth - overlap > np.maximum.reduceat(slack[live], runs)) | (overlap + probe_size[probe] - last - 1 < least)
        leave = cut | (overlap >= least) | (np.minimum.reduceat(size[live], runs) <= depth)
        if leave.any():
            count = np.diff(np.append(runs, len(live)))
            each, seen = np.repeat(overlap, count), np.repeat(last, count)
            done = each >= need[live]
            linked[live[done]] = True
            stay = np.flatnonzero(~(done | np.repeat(cut, count) | (size[live] <= depth)))
            live, each, seen = live[stay], each[stay], seen[stay]
            same = _shared_of(shared, live)
            runs = np.flatnonzero(np.r_[True, same[1:] < depth]) if len(live) else live
            overlap, last = each[runs], seen[runs]
    out = np.zeros(len(members), bool)
    out[np.array(order)] = linked
    return out


def _shared_of(shared: np.ndarray, live: np.ndarray) -> np.ndarray:
    """What each live member shares with the live one before it."""
    if len(live) < 2:
        return np.zeros(len(live), np.int64)
    low = np.minimum.reduceat(shared[: live[-1] + 1], live[:-1] + 1)
    return np.concatenate([[0], low])


def _may_link(percent: int):
    """Pairs whose histograms leave room for the common part that a link needs (a bin at its limit bounds nothing)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
            both = common_at_most(*(batch.column(c).to_pylist() for c in ("x", "y")))
            room = both >= (percent * (n + m) + 99 + percent) // (100 + percent)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(room)) for c in ("a", "b")], ["a", "b"])

    return run


def _bounded(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their histograms do not rule out."""
    ends = materialise(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "ends")
    bins = rows.select("node", "n_shingles", "bins").join(few(ends), "node", "left_semi").groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("bins").alias("bins"))
    bins = materialise(bins, "bins")
    left = bins.select(F.col("node").alias("a"), "n", F.col("bins").alias("x"))
    right = bins.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("bins").alias("y"))
    out = materialise(pairs.join(left, "a").join(right, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(_may_link(percent), "a long, b long"), "bounded")
    release(ends, bins)
    return out


def _sets_of(docs: DataFrame, pairs: DataFrame, n: int, sketch: Broadcast) -> DataFrame:
    """node and tokens (the ordered set) of all nodes in ``pairs``."""
    ends = materialise(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "ends")
    wanted = docs.sparkSession.sparkContext.broadcast(_bits_of(ends))
    sets = docs.select("text").mapInArrow(_full_sets(n, sketch, wanted), "node long, tokens binary")
    sets = materialise(sets.join(few(ends), "node", "left_semi").groupBy("node").agg(F.first("tokens").alias("tokens")), "tokens")
    release(ends)
    return sets


def _verify_blocks(percent: int):
    """Rows (a, part, b, tokens) come block by block; b is null for the probe itself, which comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes: list[np.ndarray] = []
        members: list[tuple[int, np.ndarray]] = []
        pairs: list[tuple[int, int]] = []
        block, total = None, 0

        def links() -> pa.RecordBatch:
            ok = np.flatnonzero(walk(probes, members, percent)).tolist()
            return pa.RecordBatch.from_arrays([pa.array([pairs[k][c] for k in ok], pa.int64()) for c in (0, 1)], ["a", "b"])

        for batch in batches:
            for a, part, b, tokens in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "b", "tokens")), strict=True):
                x = np.frombuffer(tokens, np.uint64)
                if b is None:
                    if total > 1 << 19:
                        yield links()
                        probes, members, pairs, total = [], [], [], 0
                    probes.append(x)
                    block = (a, part)
                elif block == (a, part):
                    members.append((len(probes) - 1, x))
                    pairs.append((a, b))
                else:
                    raise ValueError("a comparison block has no probe")
                total += len(x)
        if members:
            yield links()

    return run


def _verified(docs: DataFrame, pairs: DataFrame, n: int, percent: int, sketch: Broadcast) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    sets = _sets_of(docs, pairs, n, sketch)
    degree = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("parts"))
    dealt = pairs.join(degree, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    dealt = materialise(dealt, "pairs")
    members = dealt.join(sets.select(F.col("node").alias("b"), "tokens"), "b").select("a", "part", "b", "tokens")
    probes = dealt.select("a", "part").distinct().join(sets.select(F.col("node").alias("a"), "tokens"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "tokens")
    rows = members.unionByName(probes)
    parts = max(8, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(parts, "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    links = materialise(rows.mapInArrow(_verify_blocks(percent), "a long, b long"), "verified")
    release(sets, dealt)
    return links


def _bits_of(nodes: DataFrame) -> np.ndarray:
    """A bit filter on nodes: bytes of set bits, or-ed by place; at most BITS / 8 rows reach the driver."""
    place = F.shiftrightunsigned("node", 11).bitwiseAND(F.lit(BITS - 1))
    rows = nodes.select(place.alias("place")).select(F.expr("cast(place div 8 as int)").alias("byte"), F.expr("shiftleft(1, cast(place % 8 as int))").alias("bit"))
    rows = rows.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITS // 8, np.uint8)
    out[rows.column("byte").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint8)
    return out


def _salted(dealt: DataFrame) -> DataFrame:
    """``dealt`` with the salts that the rows of each token's bucket ask for.

    A cell of the sketch counts all its shingles, so in a large corpus every cell is hot and most buckets are small.
    The buckets of hot cells are counted (where the rows are, first); those of more than HOT rows are salted.
    """
    hot = dealt.where("salts > 1").groupBy("token").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > HOT)
    hot = materialise(hot.select("token", F.expr(f"cast(m div {HOT} + 1 as int)").alias("_salts")), "hot")
    return dealt.join(few(hot), "token", "left").withColumn("salts", F.coalesce("_salts", F.lit(1))).drop("_salts")


def _components(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, node, comp and component_id of each row."""
    spark = docs.sparkSession
    bound_batches(spark)
    sketch = spark.sparkContext.broadcast(sketch_counts(docs, n))
    kind = "doc_id long, n_shingles long, node long, prefix array<long>, salts array<int>, bins binary"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_describe(n, percent, sketch), kind)
    rows = materialise(rows, "sets")

    # A bucket's rows: one for each node, shingle of its prefix and salt. Copies fall together before the shuffle.
    nodes = rows.where("node is not null").groupBy("node").agg(*[F.first(c).alias(c) for c in ("n_shingles", "prefix", "salts")])
    dealt = nodes.select("node", F.col("n_shingles").cast("int").alias("n"), "salts", F.posexplode("prefix").alias("pos", "token"))
    dealt = dealt.withColumn("salts", F.coalesce(F.get("salts", F.col("pos")), F.lit(1)))
    if int(sketch.value.max()) >= HOT:  # else no cell, so no shingle, is hot
        dealt = _salted(dealt)
    dealt = dealt.select("token", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), "salts", "node", "n", "pos")
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.repartition(parts, "token", "salt").sortWithinPartitions("token", "salt", "pos", "n", "node")
    shared = dealt.mapInArrow(_lead, "token long, salts int, node long, n int, pos int, leader long, leader_n int, leader_pos int")
    shared = materialise(shared, "shared")

    can_link = F.least(F.col("n") - F.col("pos"), F.col("leader_n") - F.col("leader_pos")) >= F.expr(f"({percent} * (n + leader_n) + {99 + percent}) div {100 + percent}")
    stars = shared.where((F.col("node") != F.col("leader")) & can_link).select(F.col("leader").alias("a"), F.col("node").alias("b"))
    leaders = shared.where("salts > 1").select("token", F.col("leader").alias("b")).distinct()
    firsts = leaders.groupBy("token").agg(F.min("b").alias("a"))  # leaders of a salted shingle's parts meet here
    stars = stars.unionByName(leaders.join(firsts, "token").where("a <> b").select("a", "b"))
    tried = materialise(stars.distinct(), "stars")

    near = _bounded(tried, rows, percent)
    links = _verified(docs, near, n, percent, sketch)
    release(near)
    label = materialise(components(links), "label")
    placed = shared.select("token", "salts", "node", "n", "pos").join(few(label), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = materialise(placed, "placed")
    release(shared)
    mixed = materialise(placed.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("token"), "mixed")
    # A salted bucket's rows go to each cell that their salt is part of, so no task holds more than two salts' rows.
    open_ = placed.join(few(mixed), "token").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    open_ = open_.select("token", "salt", "comp", "node", "n", "pos", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("_s"))
    open_ = open_.select("token", F.least("salt", "_s").alias("x"), F.greatest("salt", "_s").alias("y"), "salt", "comp", "node", "n", "pos")
    open_ = open_.repartition(parts, "token", "x", "y").sortWithinPartitions("token", "x", "y", "comp", "node")
    more = open_.mapInArrow(_cross(percent), "a long, b long").distinct()
    known = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = materialise(more.join(known, ["a", "b"], "left_anti"), "more")
    release(placed, mixed, tried)
    near = _bounded(more, rows, percent)
    release(more)
    if not near.isEmpty():
        again = _verified(docs, near, n, percent, sketch)
        release(label)
        label = materialise(components(links.unionByName(again)), "label")
        release(again)
    release(near, links)

    out = rows.select("doc_id", "n_shingles", "node").join(few(label), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    out = materialise(out, "labelled")
    release(rows, label)
    ids = out.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("_n"))
    # Most components have one row: only the others are looked up.
    ids = materialise(ids.where("_n > 1").select("comp", "component_id", F.lit(True).alias("_many")), "ids")
    own = F.when(F.col("_many"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    return out.join(few(ids), "comp", "left").select("doc_id", "n_shingles", "node", "comp", own)


def join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links lead to) of each row, and set_id (equal sets share it)."""
    return _components(docs, n, percent).select("doc_id", "n_shingles", "component_id", F.col("node").alias("set_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest ``doc_id``; all rows without words stay.

    Of a component's rows that repeat this id, that of the smallest set name stays, and of rows that repeat both that
    of the smallest hash of the whole row.
    """
    found = materialise(_components(docs, n, percent), "found")
    kept = found.where(F.col("comp").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id"), F.col("node").alias("_node"), F.col("comp").alias("_comp"))
    kept = materialise(kept, "kept")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_d"))
    # An id that all of its rows repeat, kept or not, does not tell which row to keep.
    repeated = materialise(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").select("doc_id"), "repeated")
    if kept.join(few(repeated), F.col("_id").eqNullSafe(F.col("doc_id")), "left_semi").isEmpty():
        return rows.join(few(kept.select("_id")), F.col("_d") == F.col("_id"), "left_semi").select("_row.*")
    sketch = docs.sparkSession.sparkContext.broadcast(np.zeros(CELLS, np.uint32))
    named = _with_nodes(rows.select("_row", "_d", F.col("_row.text").alias("text")), n, sketch)
    least = kept.where("_comp is not null").groupBy("_comp").agg(F.min(F.struct(F.col("_id"), F.col("_node"))).alias("x")).select(F.col("x._id").alias("_id"), F.col("x._node").alias("_m"))
    chosen = named.where("_node is not null").join(few(materialise(least, "least")), (F.col("_node") == F.col("_m")) & F.col("_d").eqNullSafe(F.col("_id")), "left_semi")
    chosen = chosen.groupBy("_node").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row"))
    return chosen.select("_row.*").unionByName(named.where("_node is null").select("_row.*"))


def _with_nodes(rows: DataFrame, n: int, sketch: Broadcast) -> DataFrame:
    from pyspark.sql import types as T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                x, edge = _ordered(*shingle_sets(*text_bytes(batch.column(2)), n), sketch.value)
                node = pa.array(_nodes(x, edge), pa.int64(), mask=np.diff(edge) == 0)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), node], ["_row", "_d", "_node"])

    schema = T.StructType([rows.schema["_row"], rows.schema["_d"], T.StructField("_node", T.LongType())])
    return rows.mapInArrow(run, schema)

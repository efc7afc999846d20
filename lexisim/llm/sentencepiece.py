"""SentencePiece encoding by forward filtering and backward sampling, and its decoding.

The piece lattice of a text falls apart into units that no piece spans (a run
of spaces with the word after it; a line end), so each different unit is
filtered forward once, the new units of a chunk of texts side by side, and every
occurrence is sampled backward from its unit's lattice. A worker keeps the
lattices it has met, up to ``ARCS`` arcs, then starts anew. A lattice is a
function of its unit alone and the draws are one of the row's key, the seed and
the occurrence's number in its text: the same row always gets the same
segmentation, on any cluster.

The pieces come from a model file that is read, never trained. Its merge ranks
r stand for log-probabilities by Zipf's law, ``-ln(r + SHIFT) - ln(ln V)``,
sharpened by ``alpha`` (0: uniform over segmentations; large: the best one).
Encoding puts one space marker in front, as the model does; characters without
a piece, and marker characters in the text itself, are encoded as bytes, so
decoding gives back every text exactly.

Defined cases: a null text has null ids, an empty one has none; any key
(null too) is a key; repeated rows get equal ids; very long texts and very
long words are encoded whole (some 150 bytes of memory for each of a text's
characters, beyond ``PIECE`` of them); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisim.llm.common import bound_batches, chunks, mix64

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA, SEED, SHIFT = 1.0, 29, 2.7
#: Text bytes that are encoded side by side; arcs of lattices (of 13 bytes) that a worker keeps.
PIECE, ARCS = 1 << 18, 1 << 22
MARK = 0x2581  # stands for a space in pieces
_ESCAPED = 0x110000  # a marker character of the text itself, while encoding
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The lattice's view of a model: piece hashes, log-probabilities and the bytes each id stands for."""

    def __init__(self, model: bytes, alpha: float = ALPHA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.vocab_size()
        texts = [sp.id_to_piece(k) for k in range(n)]
        special = [sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k) for k in range(n)]
        self.byte_ids = np.full(256, -1, np.int64)
        self.bytes_of: list[bytes] = []
        real = []
        for k, text in enumerate(texts):
            if sp.is_byte(k):
                self.byte_ids[int(text[3:5], 16)] = k
                self.bytes_of.append(bytes([int(text[3:5], 16)]))
            else:
                self.bytes_of.append(b"" if special[k] else text.replace(chr(MARK), " ").encode())
                if not special[k]:
                    real.append(k)
        if any(chr(MARK) in texts[k].lstrip(chr(MARK)) or "\n" in texts[k] for k in real):
            raise ValueError("a piece spans units; this model's lattice does not fall apart at spaces")
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte pieces")
        self.longest = max(len(texts[k]) for k in real)
        rank = np.argsort(np.argsort([-sp.get_score(k) for k in real], kind="stable"), kind="stable")
        logp = -np.log(rank + SHIFT) - np.log(np.log(n))
        # Hash tables by piece length; a byte of a character without a piece counts as the rarest piece.
        self.byte_logp = float(alpha * logp.min())
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for size in range(1, self.longest + 1):
            own = [(k, lp) for k, lp in zip(real, logp, strict=True) if len(texts[k]) == size]
            codes = np.frombuffer("".join(texts[k] for k, _ in own).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(-1, size)
            h = np.zeros(len(own), np.uint64)
            for c in range(size):
                h = _extend(h, codes[:, c])
            order = np.argsort(h)
            few = np.zeros(1 << 16, bool)
            few[(h >> np.uint64(48)).astype(np.int64)] = True
            self.tables.append((h[order], np.array([k for k, _ in own], np.int32)[order], alpha * np.array([lp for _, lp in own])[order], few))
        self.forget()

    def forget(self) -> None:
        """Drops the lattices: units (hash, first node, nodes), nodes (first arc) and arcs (cumulative share, length, piece)."""
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.base, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.first, self.n_nodes, self.n_arcs = np.zeros(0, np.int32), 0, 0
        self.cum, self.length, self.ident = np.zeros(0), np.zeros(0, np.int8), np.zeros(0, np.int32)

    def slots(self, h: np.ndarray, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Places in ``base`` and ``size`` of different units, given by hash (in order) and by their characters."""
        at = np.minimum(np.searchsorted(self.known, h), max(0, len(self.known) - 1))
        new = np.flatnonzero(self.known[at] != h) if len(self.known) else np.arange(len(h))
        if not len(new):
            return self.slot[at]
        first, cum, length, ident = _lattice(self, codes, start[new], size[new])
        if self.n_arcs + len(cum) > ARCS and len(self.known):
            self.forget()
            return self.slots(h, codes, start, size)
        self.first = _stored(self.first, self.n_nodes, (first + self.n_arcs).astype(np.int32))
        self.cum, self.length, self.ident = (_stored(x, self.n_arcs, y) for x, y in ((self.cum, cum), (self.length, length), (self.ident, ident)))
        base = self.n_nodes + np.cumsum(size[new]) - size[new]
        self.n_nodes, self.n_arcs = self.n_nodes + len(first), self.n_arcs + len(cum)
        known, slot = np.append(self.known, h[new]), np.append(self.slot, len(self.base) + np.arange(len(new)))
        order = np.argsort(known, kind="stable")
        self.known, self.slot = known[order], slot[order]
        self.base, self.size = np.append(self.base, base), np.append(self.size, size[new])
        return self.slot[np.searchsorted(self.known, h)]


def _stored(held: np.ndarray, n: int, more: np.ndarray) -> np.ndarray:
    """``held`` (of which n entries count) with ``more`` behind them; grown by half where there is no room."""
    if n + len(more) > len(held):
        held = np.concatenate([held[:n], np.empty((n + len(more)) * 3 // 2 - n, held.dtype)])
    held[n : n + len(more)] = more
    return held


def _extend(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The hash of a string with one more character."""
    x = (h ^ (code + np.uint64(1))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)


_models: dict[tuple[int, float], Pieces] = {}


def _pieces(model: bytes, alpha: float) -> Pieces:
    key = (hash(model), alpha)
    if key not in _models:
        _models[key] = Pieces(model, alpha)
    return _models[key]


def _lattice(p: Pieces, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Arcs into each node of the units given by ``start`` and ``size``, with cumulative conditional probabilities.

    Nodes are numbered unit by unit, 1 to size each. Gives the first arc of each node, and each arc's cumulative
    probability within its node, length and piece (negative: -1 - character).
    """
    base = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=base[1:])
    total = int(base[-1])
    unit = np.repeat(np.arange(len(size)), size)
    place = np.arange(total) - base[unit]  # of a node's last character within its unit
    text = codes[start[unit] + place].astype(np.uint64)
    left = size[unit] - place  # characters from here to the unit's end
    nodes, lengths, ids, logs = [], [], [], []
    live, h = np.arange(total), np.zeros(total, np.uint64)
    for n in range(1, p.longest + 1):
        keep = left[live] >= n
        live, h = live[keep], h[keep]
        if not len(live):
            break
        h = _extend(h, text[live + n - 1])
        hashes, own, logp, few = p.tables[n - 1]
        maybe = np.flatnonzero(few[(h >> np.uint64(48)).astype(np.int64)]) if len(hashes) else np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(hashes, h[maybe]), len(hashes) - 1)
        hit = hashes[at] == h[maybe] if len(maybe) else np.zeros(0, bool)
        maybe, at = maybe[hit], at[hit]
        nodes.append((live[maybe] + n - 1).astype(np.int32))
        lengths.append(np.full(len(maybe), n, np.int8))
        ids.append(own[at])
        logs.append(logp[at])
        if n == 1:
            bare = np.ones(total, bool)
            bare[live[maybe]] = False
            bare = np.flatnonzero(bare)
            code = text[bare].astype(np.int64)
            n_bytes = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
            n_bytes[code == _ESCAPED] = 3
            nodes.append(bare.astype(np.int32))
            lengths.append(np.ones(len(bare), np.int8))
            ids.append((-1 - code).astype(np.int32))
            logs.append(p.byte_logp * n_bytes)
    node, length, ident, logp = (np.concatenate(x) for x in (nodes, lengths, ids, logs))
    del nodes, lengths, ids, logs
    order = np.argsort(node.astype(np.int64) * 64 + 63 - length, kind="stable")  # the longest piece first: as a rule the likeliest
    node, length, ident, logp = node[order], length[order], ident[order], logp[order]
    del order
    first = np.searchsorted(node, np.arange(total + 1))

    # Forward: the mass of a node is the sum over its arcs of the mass they come from times p. All units move on
    # together by place. Paths of a unit are scaled alike (e**4 a character, and now and then to stay in range),
    # which leaves the conditional probabilities as they are.
    weight = np.exp(logp + 4.0 * length)
    share, value, origin = np.empty(len(node)), np.zeros(total), np.ones(len(size))
    at_place = place[node]
    by_place = np.argsort(at_place, kind="stable")
    edges = np.searchsorted(at_place[by_place], np.arange(int(size.max(initial=0)) + 1))
    for e in range(len(edges) - 1):
        arcs = by_place[edges[e] : edges[e + 1]]
        at, span = node[arcs], length[arcs]
        w = weight[arcs] * np.where(span == e + 1, origin[unit[at]], value[at - span])
        share[arcs] = w
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        here, sums = at[starts], np.add.reduceat(w, starts)
        value[here] = sums
        if e % 4 == 3:
            big = here[(sums > 1e50) | (sums < 1e-50)]
            if len(big):
                factor = value[big].copy()
                back = big[:, None] - np.arange(p.longest)
                inside = back >= base[unit[big]][:, None]
                value[back[inside]] /= np.broadcast_to(factor[:, None], back.shape)[inside]
                if e < p.longest:  # later no arc comes from a unit's start
                    origin[unit[big]] /= factor
    # Cumulative shares within each node, arc by arc, so that they do not depend on what else is in the chunk.
    n_arcs = np.diff(first)
    share /= np.repeat(_node_sums(share, first), n_arcs)
    for k in range(1, int(n_arcs.max(initial=0))):
        at = first[:-1][n_arcs > k] + k
        share[at] += share[at - 1]
    share[first[1:] - 1] = 1.0
    return first[:-1], share, length, ident


def _node_sums(share: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over each node's arcs."""
    return np.add.reduceat(share, first[:-1]) if len(share) else share


def encode_chunk(p: Pieces, texts: list[str], keys: np.ndarray, seed: int) -> list[np.ndarray]:
    """Piece ids of each text."""
    n = len(texts)
    marked = [" " + t if t else "" for t in texts]
    sizes = np.array([len(t) for t in marked], np.int64)
    off = np.zeros(n + 1, np.int64)
    np.cumsum(sizes, out=off[1:])
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    if not len(codes):
        return [np.zeros(0, np.int32)] * n
    codes[codes == MARK] = _ESCAPED
    space, line = codes == 32, codes == 10
    codes[space] = MARK
    # A unit starts at a text's start, at a space after something else, and before and after a line end.
    new = line.copy()
    new[1:] |= line[:-1] | (space[1:] & ~space[:-1])
    new[off[:-1][sizes > 0]] = True
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(codes)))

    # Different units, by hash of their characters.
    h = _unit_hashes(mix64(codes.astype(np.uint64) + np.uint64(1)), start, size)
    distinct, pick, which = np.unique(h, return_index=True, return_inverse=True)
    which = p.slots(distinct, codes, start[pick], size[pick])[which]
    first, cum, length, ident = p.first, p.cum, p.length, p.ident

    # Backward: every occurrence steps from its last node to its unit's start.
    doc = np.searchsorted(off, start, "right") - 1
    # Empty texts share an offset with the next text; "right" picks the last of them, which is the one with characters.
    number = np.arange(len(start)) - np.searchsorted(start, off[doc])
    state = mix64(keys[doc] + mix64(number.astype(np.uint64) * _GOLDEN + np.uint64(seed)))
    occ, at, floor = np.arange(len(start)), p.base[which] + p.size[which] - 1, p.base[which]
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    while len(occ):
        state = mix64(state + _GOLDEN)
        u = (state >> np.uint64(11)).astype(np.float64) / (1 << 53)
        arc = first[at]
        later = np.flatnonzero(u >= cum[arc])
        while len(later):  # a node's last arc has a cumulative share of 1
            arc[later] += 1
            later = later[u[later] >= cum[arc[later]]]
        steps.append((occ, ident[arc]))
        at = at - length[arc]
        keep = at >= floor
        occ, at, floor, state = occ[keep], at[keep], floor[keep], state[keep]

    # Pieces stand last to first; characters without a piece become their bytes.
    counts = np.zeros(len(start), np.int64)
    for occ, ids in steps:
        counts[occ] += np.where(ids < 0, _n_bytes(-1 - ids), 1)
    stop = np.cumsum(counts)
    out, cursor = np.empty(int(stop[-1]), np.int32), stop.copy()
    for occ, ids in steps:
        plain = ids >= 0
        o = occ[plain]
        cursor[o] -= 1
        out[cursor[o]] = ids[plain]
        for o, code in zip(occ[~plain].tolist(), (-1 - ids[~plain]).tolist(), strict=True):
            raw = chr(MARK if code == _ESCAPED else code).encode("utf-8", "surrogatepass")
            cursor[o] -= len(raw)
            out[cursor[o] : cursor[o] + len(raw)] = p.byte_ids[list(raw)]
    edge = np.r_[0, stop][np.searchsorted(start, off)]
    return [out[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _n_bytes(code: np.ndarray) -> np.ndarray:
    n = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
    return np.where(code == _ESCAPED, 3, n)


def _unit_hashes(x: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Order-dependent 64-bit hashes of the units: a polynomial over prefix sums."""
    base = 0x9FB21C651E98DF25
    up, down = np.full(len(x) + 1, base, np.uint64), np.full(len(x) + 1, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * up[:-1], out=sums[1:])
    return mix64((sums[start + size] - sums[start]) * down[start] + size.astype(np.uint64) * _GOLDEN)


def decode_ids(p: Pieces, ids) -> bytes:
    """The text, in UTF-8, that ``ids`` encode."""
    return b"".join(map(p.bytes_of.__getitem__, ids))[1:]


def encode(docs: DataFrame, key: str = "doc_id", model: str = MODEL, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """The key, n_pieces, ids (array<int>) and lossless (decoding gives the text again) of each row of ``docs``.

    The model file is read by the driver and broadcast; it does not grow with the data.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    with open(model, "rb") as f:
        proto = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _pieces(proto.value, alpha)
        for whole in batches:
            for batch in chunks(whole, "text", PIECE):
                said = batch.column(1).to_pylist()
                keys = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                ids = encode_chunk(p, [t or "" for t in said], keys, seed)
                off = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=off[1:])
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                same = [None if t is None else decode_ids(p, x.tolist()) == t.encode("utf-8", "surrogatepass") for t, x in zip(said, ids, strict=True)]
                mask = pa.array([t is None for t in said])
                lists = pa.ListArray.from_arrays(pa.array(off), pa.array(flat, pa.int32()), mask=mask)
                count = pa.array([None if t is None else len(x) for t, x in zip(said, ids, strict=True)], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), count, lists, pa.array(same, pa.bool_())], ["key", "n_pieces", "ids", "lossless"])

    rows = docs.select(F.col(key).cast("long").alias("key"), "text", F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("null"))).alias("h"))
    return rows.mapInArrow(run, "key long, n_pieces long, ids array<int>, lossless boolean").withColumnRenamed("key", key)


def decode(rows: DataFrame, key: str = "doc_id", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """The key and text that each row's ``ids`` encode; null ids give null."""
    spark = rows.sparkSession
    bound_batches(spark)
    with open(model, "rb") as f:
        proto = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _pieces(proto.value, ALPHA)
        for batch in batches:
            texts = [None if x is None else decode_ids(p, x).decode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    return rows.select(F.col(key).cast("long").alias("key"), ids).mapInArrow(run, "key long, text string").withColumnRenamed("key", key)

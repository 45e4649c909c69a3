"""Suffix-array deduplication: byte strings that an earlier document already holds are cut out.

A byte goes if some string of `length` bytes that covers it also starts in a document with a smaller id.

1. Anchors. Every stretch of `length` bytes picks one of its grams by a rule of its bytes alone, its anchor, so two
   equal stretches have their anchors at the same place. An anchor stands for its read: the bytes of all stretches that
   contain it.
2. Equal reads are one row of what follows: they are collapsed where they are found, first within a task and then by
   anchor. Only a read's smallest document matters to others; all other holders lose what it holds, the whole read.
   A group of copies sends one row a task.
3. Reads that share an anchor but differ can still have stretches in common. Shards of such reads get Burrows-Wheeler
   transforms of their own; these are merged by iterative interleave refinement: a pass of stable sorting by symbol
   extends the order of all suffixes by one symbol, without sorting any suffix anew, and the blocks that a pass does
   not split are the intervals of suffixes with that common prefix. After `length` passes they are the repeated
   stretches, and the smallest document of an interval keeps its own.
   An anchor of more than `many` different reads is dealt out by stretch instead: equal stretches are collapsed in
   each cell of documents, so that a stretch sends one row a cell, and the merge decides between the cells.
4. Documents meet what they lose, and bytes covered by any of it are cut.

What travels is packed by destination: anchors by a hash of their gram (bucket), findings and texts by a hash of the
document (cell). The number of buckets and cells grows with the bytes of the table, so each fits a task.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import cut

_R = np.random.default_rng(77)
BYTE = _R.integers(1, 1 << 63, 256, dtype=np.uint64)
FACTOR = np.uint64(0x9E3779B97F4A7C15 | 3)
REPEATED = 1 << 31
BLOCK = 2_000_000


def gram_of(length: int) -> tuple[int, int]:
    """Bytes of an anchor and of the short grams that choose it. Long anchors agree by chance less often; the short
    grams' places, taken modulo the number of anchors of a stretch, keep long anchors as sparse as short ones."""
    anchor = length * 29 // 50
    return anchor, 4 + (anchor - 4) % (length - anchor + 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(e: int) -> np.uint64:
    return np.uint64(pow(int(FACTOR), e, 1 << 64))


def _grams(b: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of the width bytes from every place at which so many are left."""
    h, size, out, done = BYTE[b], 1, None, 0
    while True:
        if width & size:
            rest = len(b) - width + 1
            out = h[:rest].copy() if out is None else out[:rest] * _power(size) + h[done : done + rest]
            done += size
        if done == width:
            return out
        h = h[: len(h) - size] * _power(size) + h[size:]
        size *= 2


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[i : i + width] for every i."""
    size = 1
    while size < width:
        step = min(size, width - size)
        x = np.minimum(x[:-step], x[step:])
        size += step
    return x


def anchors(b: np.ndarray, edges: np.ndarray, length: int) -> np.ndarray:
    """Places of the anchors of the documents b[edges[i] : edges[i + 1]]."""
    n = len(b)
    if n < length:
        return np.zeros(0, np.int64)
    gram, short = gram_of(length)
    # The least short gram of a stretch, the first of equal ones: hash above, place below.
    key = (_mix(_grams(b, short)) & np.uint64(0xFFFFFFFF00000000)) | np.arange(n - short + 1, dtype=np.uint64)
    least = (_least(key, length - short + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = np.arange(n - length + 1)
    inside = np.ones(n - length + 1, bool)
    for e in edges[1:-1].tolist():
        inside[max(0, e - length + 1) : e] = False
    at = at[inside]
    marked = np.zeros(n, bool)
    marked[at + (least[inside] - at) % (length - gram + 1)] = True
    return np.flatnonzero(marked)


def reads(b: np.ndarray, edges: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each anchor's gram and of its read (with the anchor's place in it)."""
    gram, _ = gram_of(length)
    reach = length - gram
    doc = np.searchsorted(edges, place, "right") - 1
    start, end = np.maximum(edges[doc], place - reach), np.minimum(edges[doc + 1], place + gram + reach)
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(b), FACTOR)]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[b] * power[:-1])])
    # Divided by the power of the place: equal bytes have equal hashes wherever they are.
    back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(b), np.uint64(pow(int(FACTOR), -1, 1 << 64)))]))
    of = lambda s, e: (sums[e] - sums[s]) * back[s]
    return _mix(of(place, place + gram)), _mix(_mix(of(start, end)) + (place - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (end - start).astype(np.uint64))


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where sorted rows begin a new key."""
    if not len(keys[0]):
        return np.zeros(0, bool)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def squeeze(x: np.ndarray) -> bytes:
    """An array of integers as compressed planes of the bytes of its differences."""
    u = np.ascontiguousarray(x).view(f"u{x.dtype.itemsize}")
    d = np.diff(u, prepend=u.dtype.type(0))
    return zstandard.ZstdCompressor(level=1).compress(d.view(np.uint8).reshape(len(d), -1).T.tobytes())


def release(block: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8)
    u = np.dtype(f"u{np.dtype(kind).itemsize}")
    d = np.ascontiguousarray(planes.reshape(u.itemsize, -1).T).view(u).reshape(-1)
    return np.cumsum(d, dtype=u).view(kind)


def frame(*blocks: bytes) -> bytes:
    return struct.pack(f"<{len(blocks)}I", *map(len, blocks)) + b"".join(blocks)


def unframe(row: bytes, n: int) -> list[bytes]:
    at, out = 4 * n, []
    for size in struct.unpack_from(f"<{n}I", row):
        out.append(row[at : at + size])
        at += size
    return out


def pack(doc: np.ndarray, th: np.ndarray, *more: np.ndarray) -> bytes:
    """Rows ordered by document as one block: documents once, with the number of their rows."""
    first = np.flatnonzero(_firsts(doc, th))
    counts = np.diff(np.append(first, len(doc))).astype(np.uint32)
    return frame(squeeze(doc[first]), squeeze(th[first]), squeeze(counts), *map(squeeze, more))


def unpack(block: bytes, *kinds: type) -> list[np.ndarray]:
    doc, th, counts, *more = unframe(block, 3 + len(kinds))
    counts = release(counts, np.uint32)
    return [np.repeat(release(doc, np.int64), counts), np.repeat(release(th, np.int32), counts), *(release(m, k) for m, k in zip(more, kinds, strict=True))]


def joined(parts: list[list[np.ndarray]], *kinds: type) -> list[np.ndarray]:
    return [np.concatenate([np.zeros(0, k), *(p[i] for p in parts)]) for i, k in enumerate((np.int64, np.int32, *kinds))]


def dealt(to: np.ndarray, n: int, *keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The rows of each destination below n that has any, ordered by keys (the last one counts most)."""
    order = np.lexsort((*keys, to)) if keys else np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(n + 1))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        yield k, order[cuts[k] : cuts[k + 1]]


def cell_of(doc: np.ndarray, cells: int) -> np.ndarray:
    return (_mix(doc.astype(np.uint64)) % np.uint64(cells)).astype(np.int64)


class Gatherer:
    """Anchors of the documents of a task, equal reads collapsed, as one binary row a bucket."""

    def __init__(self, length: int, buckets: int, most_bytes: int):
        self.length, self.buckets, self.most = length, buckets, most_bytes
        self.held: list[tuple[int, int, bytes]] = []
        self.size = 0

    def add(self, doc: int, text_hash: int, raw: bytes) -> Iterator[tuple[int, bytes]]:
        if len(raw) >= self.length:
            self.held.append((doc, text_hash, raw))
            self.size += len(raw)
        if self.size >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[tuple[int, bytes]]:
        if not self.held:
            return
        self.held.sort(key=lambda x: x[:2])
        found = []
        edge, part, size = 0, [], 0
        for i, (_, _, r) in enumerate(self.held):
            part.append(r)
            size += len(r)
            if size >= BLOCK or i + 1 == len(self.held):
                b = np.frombuffer(b"".join(part), np.uint8)
                edges = np.cumsum([0, *map(len, part)])
                place = anchors(b, edges, self.length)
                doc = np.searchsorted(edges, place, "right") - 1
                found.append((*reads(b, edges, place, self.length), (doc + edge).astype(np.uint32), (place - edges[doc]).astype(np.uint32)))
                edge, part, size = i + 1, [], 0
        a, f, doc, pos = (np.concatenate(c) for c in zip(*found, strict=True))
        ids, hashes = np.array([d for d, _, _ in self.held], np.int64), np.array([h for _, h, _ in self.held], np.int32)
        self.held, self.size = [], 0
        # Rows come ordered by document; one goes on a read and document, marked if the document holds the read again.
        row = np.argsort(f, kind="stable")
        new = _firsts(f[row], doc[row])
        first = np.flatnonzero(new)
        again = np.diff(np.append(first, len(new))) > 1
        row = row[new]
        pos[row[again]] |= np.uint32(REPEATED)
        # The smallest document of a read goes on; larger ids lose it already, equal ids go on too.
        lead = np.flatnonzero(_firsts(f[row]))
        sent = np.zeros(len(f), bool)
        sent[row] = ids[doc[row]] == np.repeat(ids[doc[row[lead]]], np.diff(np.append(lead, len(row))))
        row.sort()
        to = ((a[row] >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)
        for k, at in dealt(to, self.buckets):
            at = row[at]
            go = at[sent[at]]
            yield k, frame(pack(ids[doc[at]], hashes[doc[at]], pos[at], sent[at].astype(np.uint8)), a[go].astype(np.uint32).tobytes(), f[go].view(np.uint8).reshape(-1, 8)[:, 2:].tobytes())


def _sent(row: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Rows that go on (doc, th, pos, anchor, read) and rows that are lost already (doc, th, pos)."""
    block, a, f = unframe(row, 3)
    *cols, sent = unpack(block, np.uint32, np.uint8)
    wide = np.zeros((len(f) // 6, 8), np.uint8)
    wide[:, 2:] = np.frombuffer(f, np.uint8).reshape(-1, 6)
    go = sent.astype(bool)
    return [c[go] for c in cols] + [np.frombuffer(a, np.uint32), wide.view(np.uint64).reshape(-1)], [c[~go] for c in cols]


#: kind 0: documents lose the reads of these anchors; 1: these reads are wanted, with anchor and whether it has many;
#: 2: anchors with the start of a stretch of their read that is lost; 3: reads to compare.
PACKED = "kind int, dest int, payload binary"
_FORM = pa.schema([("kind", pa.int32()), ("dest", pa.int32()), ("payload", pa.binary())])


def packed(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, _FORM.types, strict=True)], schema=_FORM)


def to_cells(kind: int, cells: int, doc: np.ndarray, th: np.ndarray, *more: np.ndarray) -> list[tuple[int, int, bytes]]:
    return [(kind, k, pack(doc[at], th[at], *(m[at] for m in more))) for k, at in dealt(cell_of(doc, cells), cells, more[0], th, doc)]


def resolve(rows: pa.Table, cells: int, many: int) -> pa.Table:
    """Of one bucket: who loses a read whole, and which differing reads of one anchor must be compared."""
    parts = [_sent(x.as_py()) for x in rows.column("payload")]
    doc, th, pos, a, f = joined([p for p, _ in parts], np.uint32, np.uint32, np.uint64)
    lost = joined([p for _, p in parts], np.uint32)
    order = np.lexsort((doc, f, a))
    a, f, doc, th, pos = a[order], f[order], doc[order], th[order], pos[order]
    lead = np.flatnonzero(_firsts(a, f))
    size = np.diff(np.append(lead, len(a)))
    whole = doc > np.repeat(doc[lead], size)
    # Anchors with several reads, and documents of several ids among those that go on.
    head = np.flatnonzero(_firsts(a[lead]))
    kinds = np.diff(np.append(head, len(lead)))
    several = (np.minimum.reduceat(doc[lead], head) < np.maximum.reduceat(doc[lead], head)) & (kinds > 1) if len(head) else np.zeros(0, bool)
    # Every row of a read's smallest id: rows of one id can have different texts.
    spread = lambda x: np.repeat(np.repeat(x, kinds), size)
    wanted = spread(several) & ~whole
    # Within a bucket 32 bits of an anchor's hash are enough: two anchors taken for one only make a comparison more.
    gid = a[wanted].astype(np.int64) | np.int64(rows.column("bucket")[0].as_py()) << np.int64(32)
    out = to_cells(0, cells, *(np.concatenate([x[whole], y]) for x, y in zip((doc, th, pos), lost, strict=True)))
    return packed(out + to_cells(1, cells, doc[wanted], th[wanted], pos[wanted], gid, spread(kinds > many)[wanted].astype(np.uint8)))


def transform(texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform, two symbols a suffix (those before it, the nearer one low), and suffix order of a
    shard: rows of symbols, each ended (and padded) by 0.

    Suffixes are ordered as far as their row goes; equal ones keep the order of their rows."""
    rows, width = texts.shape
    bits = 8 if texts.dtype == np.uint8 else 16
    wide = np.concatenate([texts, np.zeros((rows, 3), texts.dtype)], 1).astype(np.int64)
    k = 3
    rank = ((wide[:, :width] << 2 * bits) | (wide[:, 1 : width + 1] << bits) | wide[:, 2 : width + 2]).reshape(-1)
    rank = np.unique(rank, return_inverse=True)[1]
    column = np.tile(np.arange(width), rows)
    while k < width:
        later = np.zeros_like(rank)
        later[:-k] = rank[k:] + 1
        later[column + k >= width] = 0
        rank = np.unique(rank * (len(rank) + 2) + later, return_inverse=True)[1]
        k *= 2
    order = np.argsort(rank, kind="stable")
    pair = np.uint16 if bits == 8 else np.uint32
    before = (np.roll(texts, 2, axis=1).astype(pair) << pair(bits) | np.roll(texts, 1, axis=1)).reshape(-1)
    return before[order], order


def merge(shards: list[tuple[np.ndarray, np.ndarray]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge the transforms of shards: shard and suffix at each place of the joint order, and its interval.

    A pass leaves the suffixes ordered by two symbols more (the first by one, if length is odd): it deals the rows of
    the last order out by the symbols before them, keeping their order. Two neighbours stay in one interval while they
    got the same symbols from one interval, which is their having so many symbols in common. No suffix is compared
    with another."""
    z = np.repeat(np.arange(len(shards), dtype=np.uint8 if len(shards) < 256 else np.uint16), [len(s[0]) for s in shards])
    both = np.concatenate([s[0] for s in shards])
    single = both & (both.dtype.type(0xFF) if both.dtype == np.uint16 else both.dtype.type(0xFFFF))
    n = len(z)
    interval = np.zeros(n, np.int32)
    symbol = np.empty(n, both.dtype)
    for step in [1] * (length % 2) + [2] * (length // 2):
        symbol[np.argsort(z, kind="stable")] = single if step == 1 else both
        order = np.argsort(symbol, kind="stable")
        z, c, from_interval = z[order], symbol[order], interval[order]
        interval = np.cumsum(_firsts(c, from_interval), dtype=np.int32)
    suffix = np.empty(n, np.int64)
    suffix[np.argsort(z, kind="stable")] = np.concatenate([s[1] for s in shards])
    return z, suffix, interval


def repeated(texts: list[bytes], docs: np.ndarray, length: int, shard_reads: int = 500) -> list[tuple[int, int]]:
    """(read, offset) of every stretch of `length` bytes that a read of a smaller document also holds."""
    width = max(map(len, texts)) + 1
    size = np.array([len(t) for t in texts])
    flat = np.frombuffer(b"".join(texts), np.uint8)
    # 0 ends a read. Bytes of UTF-8 stay below 255, others need wider symbols.
    kind = np.uint8 if flat.max(initial=0) < 255 else np.uint16
    base = np.zeros((len(texts), width), kind)
    base[np.arange(width) < size[:, None]] = flat.astype(kind) + kind(1)
    starts = list(range(0, len(texts), shard_reads))
    shards = [transform(base[s : s + shard_reads]) for s in starts]
    z, suffix, interval = merge(shards, length)
    read, offset = np.array(starts)[z] + suffix // width, suffix % width
    real = offset + length <= size[read]
    read, offset, interval = read[real], offset[real], interval[real]
    if not len(read):
        return []
    head = np.flatnonzero(_firsts(interval))
    least = np.repeat(np.minimum.reduceat(docs[read], head), np.diff(np.append(head, len(read))))
    lost = docs[read] > least
    return list(zip(read[lost].tolist(), offset[lost].tolist(), strict=True))


def stretches(raw: bytes, at: np.ndarray, length: int) -> np.ndarray:
    """Hash of the stretch from each place."""
    return np.array([xxhash.xxh3_64_intdigest(raw[s : s + length]) for s in at.tolist()], np.uint64)


def pick(texts: pa.Table, asked: pa.Table, length: int, cells: int) -> pa.Table:
    """Of one cell: the wanted reads, by group; of anchors with many reads their stretches, equal ones collapsed."""
    gram, _ = gram_of(length)
    reach = length - gram
    parts = [unpack(x.as_py(), np.uint32, np.int64, np.uint8) for x in asked.column("payload")]
    doc, th, pos, gid, hot = joined(parts, np.uint32, np.int64, np.uint8)
    order = np.lexsort((pos, th, doc))
    doc, th, pos, gid, hot = doc[order], th[order], pos[order], gid[order], hot[order].astype(bool)
    at = (pos & np.uint32(REPEATED - 1)).astype(np.int64)
    start = np.maximum(0, at - reach)
    first = np.flatnonzero(_firsts(doc, th))
    where = {(d, t): (s, e) for d, t, s, e in zip(doc[first].tolist(), th[first].tolist(), first.tolist(), np.append(first, len(doc))[1:].tolist(), strict=True)}
    got: list[bytes] = [b""] * len(doc)
    many: list[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]] = []
    for _, d, t, raw in documents(texts):
        s, e = where.pop((d, t), (0, 0))  # rows repeated under one id have the same reads
        for i in range(s, e):
            if not hot[i]:
                got[i] = raw[start[i] : at[i] + gram + reach]
        for i in (np.flatnonzero(hot[s:e]) + s).tolist():
            span = np.arange(start[i], min(at[i] + gram + reach, len(raw)) - length + 1)
            many.append((np.full(len(span), i), span, stretches(raw, span, length), [raw[x : x + length] for x in span.tolist()]))
    plain = np.flatnonzero(~hot)
    row, left, key, read = plain, at[plain] - start[plain], gid[plain], [got[i] for i in plain.tolist()]
    lost: list[tuple[int, int, bytes]] = []
    if many:
        i, span, h = (np.concatenate(c) for c in list(zip(*many, strict=True))[:3])
        text = [x for m in many for x in m[3]]
        order = np.lexsort((doc[i], h))
        lead = np.flatnonzero(_firsts(h[order]))
        least = np.repeat(doc[i][order][lead], np.diff(np.append(lead, len(order))))
        gone, on = order[doc[i][order] > least], order[doc[i][order] == least]
        lost = to_cells(2, cells, doc[i[gone]], th[i[gone]], pos[i[gone]], span[gone])
        row, left, key = np.concatenate([row, i[on]]), np.concatenate([left, at[i[on]] - span[on]]), np.concatenate([key, h[on].view(np.int64)])
        read += [text[x] for x in on.tolist()]
    # Findings of the cell itself travel with the reads of one of its groups.
    out = [(2, k, frame(struct.pack("<I", k), p)) for _, k, p in lost]
    for k, r in dealt(cell_of(key, cells), cells, doc[row]):
        mine = [read[x] for x in r.tolist()]
        out.append((3, k, frame(pack(doc[row[r]], th[row[r]], pos[row[r]], key[r], left[r], np.array(list(map(len, mine)), np.uint32)), zstandard.ZstdCompressor(level=1).compress(b"".join(mine)))))
    return packed(out)


def compare(rows: pa.Table, length: int, cells: int, batch_reads: int = 4_000) -> pa.Table:
    """Stretches lost by the reads of one group of anchors. Reads of one anchor stay together; anchors are taken in
    order, so many as make about batch_reads reads, which a merge takes at a time."""
    kind = rows.column("kind").to_pylist()
    out = [(2, unframe(p.as_py(), 2)) for k, p in zip(kind, rows.column("payload"), strict=True) if k == 2]
    out = [(2, struct.unpack("<I", at)[0], p) for _, (at, p) in out]
    parts, text = [], []
    for k, p in zip(kind, rows.column("payload"), strict=True):
        if k == 3:
            block, raw = unframe(p.as_py(), 2)
            parts.append(unpack(block, np.uint32, np.int64, np.int64, np.uint32))
            raw, ends = zstandard.ZstdDecompressor().decompress(raw), np.cumsum(parts[-1][-1]).tolist()
            text += [raw[s:e] for s, e in zip([0, *ends], ends, strict=False)]
    doc, th, pos, gid, left, _ = joined(parts, np.uint32, np.int64, np.int64, np.uint32)
    gram, _ = gram_of(length)
    half = -(-(length - gram) // 2)
    # A common stretch holds at least half of its rest on one side of the anchor: others can't have one.
    sides = [np.array([xxhash.xxh3_64_intdigest(t[max(0, p - half) : p + gram] if side == 0 else t[p : p + gram + half]) for t, p in zip(text, left.tolist(), strict=True)], np.uint64) for side in (0, 1)]
    keep = np.zeros(len(gid), bool)
    for h in sides:
        order = np.lexsort((h, gid))
        head = np.flatnonzero(_firsts(gid[order], h[order]))
        size = np.diff(np.append(head, len(order)))
        keep[order] |= np.repeat(size > 1, size)
    order = np.flatnonzero(keep)
    order = order[np.argsort(gid[order], kind="stable")]
    head = np.flatnonzero(_firsts(gid[order]))
    lost: list[tuple[int, int]] = []
    s = 0
    while s < len(order):
        nxt = head[np.searchsorted(head, s + batch_reads)] if s + batch_reads <= (head[-1] if len(head) else 0) else len(order)
        part = order[s:nxt]
        lost += [(int(part[r]), o) for r, o in repeated([text[i] for i in part], doc[part], length)]
        s = nxt
    if lost:
        r, o = (np.array(c) for c in zip(*lost, strict=True))
        out += to_cells(2, cells, doc[r], th[r], pos[r], (pos[r] & np.uint32(REPEATED - 1)).astype(np.int64) - left[r] + o)
    return packed(out)


def lost_bytes(raw: bytes, whole: np.ndarray, stretches: tuple[np.ndarray, np.ndarray], length: int) -> np.ndarray:
    """Mask of the bytes to cut: whole reads at their anchors, and single stretches (anchor, start)."""
    gram, _ = gram_of(length)
    n, reach = len(raw), length - gram
    step = np.zeros(n + 1, np.int32)

    def cover(start: np.ndarray, end: np.ndarray) -> None:
        np.add.at(step, start, 1)
        np.add.at(step, end, -1)

    pos, start = (stretches[0] & np.uint32(REPEATED - 1)).astype(np.int64), stretches[1]
    at = (whole & np.uint32(REPEATED - 1)).astype(np.int64)
    if (whole >= REPEATED).any() or (stretches[0] >= REPEATED).any():  # the same reads again in this document
        edges = np.array([0, n])
        b = np.frombuffer(raw, np.uint8)
        place = anchors(b, edges, length)
        key = dict(zip(place.tolist(), reads(b, edges, place, length)[1].tolist(), strict=True))
        again: dict[int, list[int]] = {}
        for p, k in key.items():
            again.setdefault(k, []).append(p)
        at = np.array(sorted({q for p in at.tolist() for q in again[key[p]]}), np.int64)
        more = [(q, q + s - p) for p, s in zip(pos.tolist(), start.tolist(), strict=True) for q in again[key[p]]]
        start = np.array([s for _, s in more], np.int64)
    if len(at):
        cover(np.maximum(0, at - reach), np.minimum(n, at + gram + reach))
    if len(start):
        cover(start, start + length)
    return np.cumsum(step[:-1]) > 0


def documents(texts: pa.Table) -> Iterator[tuple[bool, int, int, bytes]]:
    """known, id, text hash and bytes of the texts of a cell."""
    for row in texts.column("payload"):
        known, doc, th, size, raw = unframe(row.as_py(), 5)
        ends = np.cumsum(release(size, np.int64)).tolist()
        raw = zstandard.ZstdDecompressor().decompress(raw)
        for k, d, t, s, e in zip(release(known, np.uint8).tolist(), release(doc, np.int64).tolist(), release(th, np.int32).tolist(), [0, *ends], ends, strict=False):
            yield bool(k), d, t, raw[s:e]


class Sorter:
    """Texts of a task, as one binary row a cell."""

    def __init__(self, cells: int, most_bytes: int):
        self.cells, self.most = cells, most_bytes
        self.held: list[tuple[int | None, int, bytes]] = []
        self.size = 0

    def add(self, doc: int | None, text_hash: int, raw: bytes) -> Iterator[tuple[int, bytes]]:
        self.held.append((doc, text_hash, raw))
        self.size += len(raw) + 50
        if self.size >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[tuple[int, bytes]]:
        known = np.array([d is not None for d, _, _ in self.held], np.uint8)
        doc, th = np.array([d or 0 for d, _, _ in self.held], np.int64), np.array([h for _, h, _ in self.held], np.int32)
        size = np.array([len(r) for _, _, r in self.held], np.int64)
        squeezer = zstandard.ZstdCompressor(level=1)
        for k, at in dealt(cell_of(doc, self.cells), self.cells, doc):
            raw = squeezer.compress(b"".join(self.held[i][2] for i in at.tolist()))
            yield k, frame(squeeze(known[at]), squeeze(doc[at]), squeeze(th[at]), squeeze(size[at]), raw)
        self.held, self.size = [], 0


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, bytes]]:
    for b in batches:
        for d, h, t in zip(b.column(0), b.column(1), b.column(2), strict=True):
            yield d.as_py(), h.as_py(), t.as_buffer().to_pybytes()


def finish(texts: pa.Table, losses: pa.Table, length: int, keep_text: bool) -> pa.Table:
    """Of one cell: its documents without what they lose."""
    of: dict[int, list[list[np.ndarray]]] = {0: [], 2: []}
    for k, p in zip(losses.column("kind").to_pylist(), losses.column("payload"), strict=True):
        of[k].append(unpack(p.as_py(), np.uint32, *([np.int64] if k else [])))
    found: list[tuple[dict, list[np.ndarray]]] = []
    for k, kinds in ((0, (np.uint32,)), (2, (np.uint32, np.int64))):
        cols = joined(of[k], *kinds)
        order = np.lexsort((cols[1], cols[0]))
        cols = [c[order] for c in cols]
        first = np.flatnonzero(_firsts(cols[0], cols[1]))
        stop = np.append(first, len(order))[1:]
        found.append(({(d, t): (s, e) for d, t, s, e in zip(cols[0][first].tolist(), cols[1][first].tolist(), first.tolist(), stop.tolist(), strict=True)}, cols[2:]))
    out: list[tuple] = []
    for known, doc, th, raw in documents(texts):
        kept, removed, spans = raw, 0, 0
        (s, e), (u, v) = (at.get((doc, th), (0, 0)) if known else (0, 0) for at, _ in found)
        if s < e or u < v:
            mask = lost_bytes(raw, found[0][1][0][s:e], (found[1][1][0][u:v], found[1][1][1][u:v]), length)
            removed = int(mask.sum())
            spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
            kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
        out.append((doc if known else None, len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, OUT_TYPES, strict=True)], ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


OUT_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50, bucket_bytes: int = 24 << 20, task_bytes: int = 32 << 20, many: int = 2000, keep_text: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with keep_text also kept (binary).

    Null and empty texts have 0 bytes, those below `length` lose nothing; very long texts are held whole by one task, a
    few times over. Rows repeated under one id don't cut each other; each is judged against smaller ids. A null id takes
    no part and keeps its text. Ties need no rule: equal strings differ by document only. An empty table gives no rows;
    other columns are not read. `length` is at least 20. Anchors of more than `many` different reads are dealt out by
    stretch.
    """
    if length < 20:
        raise ValueError("length below 20")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.hash(text_col).alias("th"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = max(8, -(-total // bucket_bytes))

    def by(make: type, *args: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sink = make(*args, task_bytes)
            form = lambda got: pa.RecordBatch.from_arrays([pa.array([got[0]], pa.int32()), pa.array([got[1]], pa.binary())], ["dest", "payload"])
            for row in _rows(batches):
                yield from map(form, sink.add(*row))
            yield from map(form, sink.flush())

        return run

    scanned = rows.where("doc IS NOT NULL").where(F.octet_length("text") >= length).mapInArrow(by(Gatherer, length, cells), "dest int, payload binary")
    found = cut(scanned.withColumnRenamed("dest", "bucket").groupBy("bucket").applyInArrow(lambda t: resolve(t, cells, many), PACKED))
    texts = rows.mapInArrow(by(Sorter, cells), "dest int, payload binary").groupBy("dest")
    asked = found.where("kind = 1").groupBy("dest")
    # Cells without a wanted read have nothing to pick, those without texts nothing to give.
    picked = texts.cogroup(asked).applyInArrow(lambda t, a: pick(t, a, length, cells), PACKED)
    split = picked.groupBy("dest").applyInArrow(lambda t: compare(t, length, cells), PACKED)
    losses = found.where("kind = 0").union(split).groupBy("dest")
    done = texts.cogroup(losses).applyInArrow(lambda t, x: finish(t, x, length, keep_text), "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return (done if keep_text else done.drop("kept")).withColumnRenamed("doc", id_col)

"""Suffix-array dedup: removes bytes of strings that already start in a document with a smaller id.

Candidate search, exact for every string of LENGTH bytes: each window of LENGTH bytes is assigned to its
least anchor hash (ANCHOR bytes), so equal windows share an anchor; a maximal run of windows with one
anchor is a context. Only contexts whose anchor occurs in several documents go on.

Matching: contexts with the same anchor meet in one bucket, where equal contexts are one: they are found by
a hash and compared byte by byte. Where an anchor has several different contexts, their Burrows-Wheeler transform is expanded: from the interval of the
empty string, intervals are extended backwards, breadth first, so common prefixes come out by increasing
value; a boundary is set once, at its value, and expansion stops at LENGTH. What then has no boundary in
between shares LENGTH bytes or more. The smallest document of such a class owns its window.

Documents are dealt to parts by a hash of their id; three passes over the same dealt parts find anchors,
send contexts, and apply the marks. Documents, anchors and contexts travel as packed blocks; texts and the
bytes of contexts (which overlap, about five bytes for each byte of repeated text) are compressed in them,
since what they take of the disk grows faster than the input. An anchor that is common (many parts, or many times in a part) is split further: its windows meet by their own hash, one
row for each part at most, and are compared byte by byte too. Different strings of one hash would be an
error, not a match.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.llm.arrowtext import give_back, offsets_of, raw_utf8, spans_index
from nearfold.llm.common import as_docs, shuffle_parts, text_volume
from nearfold.llm.words import mix

LENGTH, ANCHOR = 50, 16
#: Text bytes of a part and of an anchor bucket, about; positions hashed at once; symbols of one transform.
PART_BYTES, BUCKET_BYTES, CHUNK, TRANSFORM = 6 << 20, 64 << 20, 1 << 17, 1 << 19
#: Text bytes behind a task, at most about: more text than that in each of Spark's shuffle partitions takes more of them.
TASK_BYTES = 64 << 20
#: An anchor in more parts, or more often in one part, is split by its windows.
COMMON_PARTS, COMMON_HERE = 1024, 256
#: Compression of blocks, which leaves two thirds of what Spark's own leaves of prose, and bytes of rows that are packed at once.
ZSTD, PACK_BYTES = 3, 32 << 20
_LAST = np.iinfo(np.int64).max
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * _A) ^ (b + _B)
    h ^= h >> np.uint64(29)
    h *= _B
    h ^= h >> np.uint64(32)
    return h


def _hash8(body: np.ndarray) -> np.ndarray:
    """Eight bytes from each position, as they are; zeros follow the end."""
    padded = np.concatenate((body, np.zeros(8 + (-len(body)) % 8, np.uint8)))
    return np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(body),), (1,)).copy()


class Contexts:
    """Contexts of some documents: document index, first byte, count of windows, anchor key and content hash."""

    def __init__(self, body: np.ndarray, off: np.ndarray, buckets: int):
        self.body, self.off = body, off
        docs, starts, counts, keys, hashes = [], [], [], [], []
        for at in range(0, len(body), CHUNK):
            stop = min(len(body), at + CHUNK)
            part = body[at : stop + LENGTH - 1]
            first, last = int(np.searchsorted(off, at, side="right")) - 1, int(np.searchsorted(off, stop, side="left"))
            edge = np.clip(off[first : last + 1], at, stop)
            doc = np.repeat(np.arange(first, last), np.diff(edge))
            window = np.flatnonzero(np.repeat(off[first + 1 : last + 1], np.diff(edge)) - np.arange(at, stop) >= LENGTH)
            if not len(window):
                continue
            h8 = _hash8(part)
            tail = np.zeros(64, np.uint64)
            h8 = np.concatenate((h8, tail))
            n = len(part)
            h16 = _join(h8[:n], h8[8 : n + 8])
            least, span = h16, 1
            while span * 2 <= LENGTH - ANCHOR + 1:
                least = np.minimum(least[: len(least) - span], least[span:])
                span *= 2
            more = LENGTH - ANCHOR + 1 - span
            least = np.minimum(least[: len(least) - more], least[more:])[window]
            own = doc[window]
            fresh = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (own[1:] != own[:-1]))))
            count = np.diff(np.append(fresh, len(window)))
            begin = window[fresh]
            docs.append(own[fresh])
            starts.append(begin + at)
            counts.append(count)
            keys.append(anchor_key(least[fresh], buckets))
            wide = np.concatenate((h16, tail))
            code = lambda p: _join(_join(wide[p], wide[p + 16]), _join(wide[p + 32], wide[p + 34]))  # noqa: E731, B023
            hashes.append(_join(_join(code(begin), code(begin + count - 1)), count.astype(np.uint64)))
        none = [np.zeros(0, np.int64)]
        self.doc, self.start, self.count = (np.concatenate(x or none) for x in (docs, starts, counts))
        self.key, self.hash = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (keys, hashes))
        import xxhash

        for i in np.flatnonzero(self.count > LENGTH).tolist():  # the two ends don't cover it: hash the whole
            self.hash[i] = xxhash.xxh3_64_intdigest(body[self.start[i] : self.start[i] + self.count[i] + LENGTH - 1].tobytes())

    def windows(self, chosen: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The single windows of some contexts: context number, first byte, key and hash."""
        context = np.repeat(chosen, self.count[chosen])
        start = spans_index(self.start[chosen], self.count[chosen])
        code = np.zeros(len(start), np.uint64)
        for a in range(0, len(start), CHUNK):
            rows = self.body[start[a : a + CHUNK, None] + np.arange(LENGTH + 6)[None, :].clip(max=LENGTH - 1)]
            rows[:, LENGTH:] = 0
            words = np.ascontiguousarray(rows).view(np.uint64)
            h = np.zeros(len(words), np.uint64)
            for k in range(words.shape[1]):
                h = _join(h + np.uint64(k), words[:, k])
            code[a : a + CHUNK] = h
        return context, start, anchor_key(mix(code), buckets), code


def anchor_key(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the high word, 32 further bits in the low one. Keys that collide only meet in vain."""
    return ((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))


def _cut_by_bucket(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Bucket, start and end of each bucket's stretch of sorted keys."""
    bucket = keys >> np.uint64(32)
    at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(keys) else np.zeros(1, int)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield int(bucket[a]), a, b


def _groups(ordered: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values, and the length."""
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True]))) if len(ordered) else np.zeros(1, int)


def _same_bytes(body: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> None:
    """Raises unless the strings that start at a[i] and b[i] are equal on length[i] bytes."""
    ends = offsets_of(length)
    at = 0
    while at < len(a):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + (CHUNK << 2), side="right")) - 1)
        if not np.array_equal(body[spans_index(a[at:stop], length[at:stop])], body[spans_index(b[at:stop], length[at:stop])]):
            raise RuntimeError("two different strings have one hash")
        at = stop


def equal_windows(body: np.ndarray, off: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``length`` bytes of several strings, ordered by class: their first bytes in ``body``, and
    the starts of the classes. Threshold-bounded interval expansion on the Burrows-Wheeler transform."""
    sizes = np.diff(off)
    alphabet = np.flatnonzero(np.bincount(body, minlength=256))
    dense = np.zeros(256, np.int64)
    dense[alphabet] = np.arange(1, len(alphabet) + 1)
    n = len(body) + len(sizes)
    text = np.zeros(n, np.int64)  # 0 separates the strings and belongs to none
    where = spans_index(off[:-1] + np.arange(len(sizes)), sizes)
    text[where] = dense[body]
    suffixes, rank = _suffix_order(text, len(alphabet) + 1, length + 1)
    before = np.where(suffixes > 0, suffixes - 1, n - 1)
    bwt, back = text[before], rank[before]
    head = text[suffixes]
    edge = np.zeros(n + 1, bool)
    edge[[0, n]] = True
    low, high = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for _ in range(length):
        width = high - low
        rows = spans_index(low, width)
        own = np.repeat(np.arange(len(low)), width)
        inside = bwt[rows] > 0
        to = np.sort(back[rows[inside]] << np.int64(31) | own[inside])
        if not len(to):
            break
        place, own = to >> np.int64(31), to & np.int64((1 << 31) - 1)
        fresh = np.concatenate(([True], (own[1:] != own[:-1]) | (place[1:] != place[:-1] + 1) | (head[place[1:]] != head[place[:-1]])))
        first = np.flatnonzero(fresh)
        low, high = place[first], place[np.append(first[1:], len(place)) - 1] + 1
        new = ~edge[high]
        low, high = low[new], high[new]
        edge[high] = True
        if not len(low):
            break
    valid = np.zeros(n, bool)
    full = np.maximum(0, sizes - length + 1)
    valid[spans_index(off[:-1] + np.arange(len(sizes)), full)] = True
    ok = valid[suffixes]
    rows = np.flatnonzero(ok)
    breaks = edge[rows].copy()
    breaks[1:] |= rows[1:] != rows[:-1] + 1
    if len(breaks):
        breaks[0] = True
    position = np.zeros(n, np.int64)
    position[where] = np.arange(len(body))
    return position[suffixes[rows]], np.flatnonzero(breaks)


def _suffix_order(text: np.ndarray, symbols: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes by their first ``depth`` symbols at least (ties by place), and the inverse: rank doubling."""
    n = len(text)
    bits = max(1, int(symbols - 1).bit_length())
    take = max(1, 42 // bits)
    key = np.zeros(n, np.int64)
    for k in range(take):
        key = key << bits
        key[: n - k] |= text[k:]
    places = max(1, int(n - 1).bit_length())
    packed = places <= 21
    done = take
    while True:
        if packed:
            both = np.sort(key << np.int64(places) | np.arange(n))
            order, ordered = both & np.int64((1 << places) - 1), both >> np.int64(places)
        else:
            order = np.argsort(key, kind="stable")
            ordered = key[order]
        rank = np.zeros(n, np.int64)
        if done >= depth:
            rank[order] = np.arange(n)
            return order, rank
        rank[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
        key = rank << np.int64(places)
        key[: n - done] |= rank[done:]
        if not packed:
            key = rank << np.int64(31)
            key[: n - done] |= rank[done:]
        done *= 2


def _squeezed(x: np.ndarray) -> bytes:
    """Compressed values after their size in bytes."""
    raw = x.tobytes()
    return len(raw).to_bytes(8, "little") + (pa.Codec("zstd", ZSTD).compress(raw, asbytes=True) if raw else b"")


def _raw_size(x: pa.Scalar) -> int:
    return int.from_bytes(x.as_buffer()[:8].to_pybytes(), "little")


def _stretched(x: pa.Scalar, kind) -> np.ndarray:
    size = _raw_size(x)
    return np.frombuffer(pa.Codec("zstd", ZSTD).decompress(x.as_buffer()[8:], size) if size else b"", kind)


def _pack_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one part as compressed blocks: ``part, rows``. Batches wait for each other, so that blocks aren't small."""
    how = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", ZSTD))

    def packed(waiting: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.concat_batches(waiting)
        part = batch.column("part").to_numpy()
        order = np.argsort(part, kind="stable")
        edge = _groups(part[order]).tolist()
        docs, blocks = batch.drop_columns(["part"]), []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, docs.schema, options=how) as out:
                out.write_batch(docs.take(pa.array(order[a:b])))
            blocks.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(part[order][edge[:-1]], pa.int64()), pa.array(blocks, pa.binary())], ["part", "rows"])

    give_back()
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(b.get_total_buffer_size() for b in waiting) >= PACK_BYTES:
            yield packed(waiting)
            waiting = []
    if any(b.num_rows for b in waiting):
        yield packed(waiting)


def _part_docs(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """A part's rows by id, their ids (null: above all), bytes and offsets."""
    give_back()
    table = pa.concat_tables(pa.ipc.open_stream(x.as_buffer()).read_all() for x in table.column("rows"))
    ids = pc.fill_null(table.column("doc_id"), _LAST).to_numpy()
    order = np.argsort(ids, kind="stable")
    table = table.take(pa.array(order)).combine_chunks()
    text = pc.fill_null(table.column("text"), "").combine_chunks()
    text = text if isinstance(text, pa.Array) else pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], pa.string())
    body, off = raw_utf8(text)
    return table, ids[order], body, off


def _find_anchors(buckets: int, common_here: int):
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        _, _, body, off = _part_docs(table)
        found = Contexts(body, off, buckets)
        order = np.argsort(found.key, kind="stable")
        keys, docs = found.key[order], found.doc[order]
        edge = _groups(keys)
        first, last = edge[:-1], edge[1:] - 1
        flag = np.where(edge[1:] - edge[:-1] > common_here, 2, docs[first] != docs[last]).astype(np.uint8) if len(keys) else np.zeros(0, np.uint8)
        unique = keys[first]
        rows = [(part, b, unique[x:y].astype("<u4").tobytes(), flag[x:y].tobytes()) for b, x, y in _cut_by_bucket(unique)]
        return _table(rows, ("part", "bucket", "keys", "flags"), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))

    return run


def _table(rows: list[tuple], names: tuple[str, ...], kinds: tuple[pa.DataType, ...]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, cols, kinds, strict=True)})


def _judge_anchors(common_parts: int):
    """For each part's anchors of a bucket: 0 in one document only, 1 in several, 2 common."""

    def run(table: pa.Table) -> pa.Table:
        parts, blocks = table.column("part").to_pylist(), [np.frombuffer(x.as_buffer(), "<u4") for x in table.column("keys")]
        flags = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("flags")])
        sizes = [len(b) for b in blocks]
        keys = np.concatenate(blocks)
        order = np.argsort(keys, kind="stable")
        edge = _groups(keys[order])
        count, top = np.diff(edge), np.maximum.reduceat(flags[order], edge[:-1])
        code = np.where((count > common_parts) | (top == 2), 2, (count > 1) | (top == 1)).astype(np.uint8)
        out = np.zeros(len(keys), np.uint8)
        out[order] = np.repeat(code, count)
        bucket = table.column("bucket")[0].as_py()
        ends = np.cumsum(sizes)
        rows = [(p, bucket, out[e - s : e].tobytes()) for p, s, e in zip(parts, sizes, ends.tolist(), strict=True)]
        return _table(rows, ("part", "bucket", "codes"), (pa.int64(), pa.int64(), pa.binary()))

    return run


_SENT = ("bucket", "part", "keys", "hashes", "counts", "docs", "kinds", "bytes")
_SENT_TYPES = (pa.int64(), pa.int64(), *[pa.binary()] * 6)


def _send_contexts(buckets: int):
    """Contexts of repeated anchors, each once a part with the part's smallest document."""

    def run(table: pa.Table, codes: pa.Table) -> pa.Table:
        if not table.num_rows or not codes.num_rows:
            return _table([], _SENT, _SENT_TYPES)
        part = table.column("part")[0].as_py()
        _, ids, body, off = _part_docs(table)
        found = Contexts(body, off, buckets)
        order = np.argsort(found.key, kind="stable")
        edge = _groups(found.key[order])
        by_bucket = dict(zip(codes.column("bucket").to_pylist(), codes.column("codes"), strict=True))
        judged = np.concatenate([np.frombuffer(by_bucket[b].as_buffer(), np.uint8) for b in sorted(by_bucket)])
        if len(judged) != len(edge) - 1:
            raise RuntimeError("a part's documents changed between two reads")
        code = np.zeros(len(order), np.uint8)
        code[order] = np.repeat(judged, np.diff(edge))
        sent = np.flatnonzero(code)
        key, value, count, doc, start = (x[sent] for x in (found.key, found.hash, found.count, ids[found.doc], found.start))
        kind = (code[sent] == 2).astype(np.uint8)
        if kind.any():  # a common anchor's contexts go as their windows, and without bytes as a mark
            context, w_start, w_key, w_hash = found.windows(sent[kind == 1], buckets)
            key, value = np.concatenate((key, w_key)), np.concatenate((value, w_hash))
            doc, start = np.concatenate((doc, ids[found.doc[context]])), np.concatenate((start, w_start))
            count, kind = np.concatenate((count, np.ones(len(w_key), np.int64))), np.concatenate((kind, np.full(len(w_key), 2, np.uint8)))
        order = np.lexsort((doc, value, key))
        key, value, kind, doc, start, count = key[order], value[order], kind[order], doc[order], start[order], count[order]
        once = np.concatenate(([True], (key[1:] != key[:-1]) | (value[1:] != value[:-1]) | (kind[1:] != kind[:-1]))) if len(key) else np.zeros(0, bool)
        again = np.flatnonzero(~once)
        _same_bytes(body, start[again], start[again - 1], np.maximum(count[again], count[again - 1]) + LENGTH - 1)
        key, value, kind, doc, start, count = key[once], value[once], kind[once], doc[once], start[once], count[once]
        rows = []
        for b, x, y in _cut_by_bucket(key):
            size = np.where(kind[x:y] == 1, 0, count[x:y] + LENGTH - 1)
            packed = (count[x:y].astype("<i4"), doc[x:y], kind[x:y], body[spans_index(start[x:y], size)])
            rows.append((b, part, key[x:y].astype("<u4").tobytes(), value[x:y].tobytes(), *map(_squeezed, packed)))
        return _table(rows, _SENT, _SENT_TYPES)

    return run


_MARKS = ("part", "keys", "hashes", "kinds", "sizes", "masks")
_MARK_TYPES = (pa.int64(), *[pa.binary()] * 5)
#: Kinds of a mark: all windows, some (bits in masks), or look up the windows.
ALL, SOME, SPLIT = 0, 1, 2


def _match_contexts(table: pa.Table) -> pa.Table:
    """Marks for each part's contexts of one bucket."""
    give_back()
    load = lambda c, kind: [np.frombuffer(x.as_buffer(), kind) for x in table.column(c)]
    unpack = lambda c, kind: [_stretched(x, kind) for x in table.column(c)]
    keys_, hashes_, counts_, docs_, kinds_ = load("keys", "<u4"), load("hashes", "<u8"), unpack("counts", "<i4"), unpack("docs", "<i8"), unpack("kinds", np.uint8)
    sizes = [len(k) for k in keys_]
    key, value, count, doc, kind = (np.concatenate(x) for x in (keys_, hashes_, counts_, docs_, kinds_))
    count = count.astype(np.int64)
    length = np.where(kind == 1, 0, count + LENGTH - 1)
    at = offsets_of(np.array([_raw_size(x) for x in table.column("bytes")]))
    base = np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(np.add.reduceat(length, offsets_of(np.array(sizes))[:-1]))[:-1]]), sizes)
    start = offsets_of(length)[:-1] + base
    body = np.empty(int(at[-1]), np.uint8)
    for a, x in zip(at.tolist(), table.column("bytes"), strict=False):
        body[a : a + _raw_size(x)] = _stretched(x, np.uint8)
    real = np.flatnonzero(kind != 1)
    order = real[np.lexsort((doc[real], value[real], key[real]))]
    same = np.zeros(len(order), bool)
    same[1:] = (key[order][1:] == key[order][:-1]) & (value[order][1:] == value[order][:-1]) & (count[order][1:] == count[order][:-1])
    again = np.flatnonzero(same)
    _same_bytes(body, start[order[again]], start[order[again - 1]], length[order[again]])
    first = np.flatnonzero(~same)
    cls = np.cumsum(~same) - 1
    owner = doc[order][first] if len(first) else np.zeros(0, np.int64)
    lead = order[first]  # the row that stands for a context, from its smallest document
    mark = np.full(len(key), 255, np.uint8)
    mark[order[doc[order] > owner[cls]]] = ALL
    mark[kind == 1] = SPLIT
    masks: dict[int, np.ndarray] = {}
    # anchors with several contexts: expand the transform of those contexts
    lead_key = key[lead]
    edge = _groups(lead_key)
    many = np.flatnonzero(np.diff(edge) > 1)
    weight = np.add.reduceat(length[lead], edge[:-1]) if len(lead) else np.zeros(0, np.int64)
    batch: list[int] = []
    size = 0
    for g in many.tolist():
        batch.append(g)
        size += int(weight[g])
        if size >= TRANSFORM:
            _expand(batch, edge, lead, owner, start, count, length, body, masks)
            batch, size = [], 0
    if batch:
        _expand(batch, edge, lead, owner, start, count, length, body, masks)
    has = np.zeros(len(lead), bool)
    has[list(masks)] = True
    partial = np.flatnonzero(has[cls] & (doc[order] == owner[cls]))
    bits: dict[int, np.ndarray] = {}
    for k in partial.tolist():
        row = int(order[k])
        mark[row] = SOME
        bits[row] = masks[int(cls[k])]
    parts, rows, ends = table.column("part").to_pylist(), [], np.cumsum(sizes).tolist()
    bucket = np.uint64(table.column("bucket")[0].as_py() << 32)
    for p, s, e in zip(parts, sizes, ends, strict=True):
        chosen = np.flatnonzero(mark[e - s : e] != 255) + e - s
        if len(chosen):
            flat = [bits[i] for i in chosen[mark[chosen] == SOME].tolist()]
            mask = np.packbits(np.concatenate(flat)).tobytes() if flat else b""
            size = np.where(mark[chosen] == SOME, count[chosen], 0).astype("<i4")
            rows.append((p, (bucket | key[chosen].astype(np.uint64)).tobytes(), value[chosen].tobytes(), mark[chosen].tobytes(), size.tobytes(), mask))
    return _table(rows, _MARKS, _MARK_TYPES)


def _expand(groups: list[int], edge: np.ndarray, lead: np.ndarray, owner: np.ndarray, start: np.ndarray, count: np.ndarray, length: np.ndarray, body: np.ndarray, masks: dict[int, np.ndarray]) -> None:
    """Masks of the windows that a smaller document owns, for contexts of some anchors."""
    g = np.array(groups)
    contexts = spans_index(edge[g], edge[g + 1] - edge[g])
    rows = lead[contexts]
    off = offsets_of(length[rows])
    places, first = equal_windows(body[spans_index(start[rows], length[rows])], off)
    context = np.searchsorted(off, places, side="right") - 1
    own = owner[contexts]
    least = np.repeat(np.minimum.reduceat(own[context], first), np.diff(np.append(first, len(places))))
    smaller = least < own[context]
    window = offsets_of(count[rows])
    flags = np.zeros(int(window[-1]), bool)
    flags[(window[context] + places - off[context])[smaller]] = True
    for i in np.unique(context[smaller]).tolist():
        masks[int(contexts[i])] = flags[window[i] : window[i + 1]]


def _before(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many flags are set before each offset."""
    return np.concatenate(([0], np.cumsum(flags, dtype=np.int32)))[off].astype(np.int64) if len(flags) < 1 << 31 else np.concatenate(([0], np.cumsum(flags)))[off]


def _apply_marks(buckets: int, with_text: bool):
    """Marked windows to removed bytes, and what is left of each document."""

    def run(table: pa.Table, marks: pa.Table) -> pa.Table:
        table, ids, body, off = _part_docs(table)
        found = Contexts(body, off, buckets)
        cover = np.zeros(len(body) + 1, np.int32)

        def add(start: np.ndarray, count: np.ndarray) -> None:
            np.add.at(cover, start, 1)
            np.add.at(cover, start + count + LENGTH - 1, -1)

        where = _lookup(marks)
        everything = np.arange(len(found.key))
        local, kind, mask_at = _resolve(found.key, found.hash, ids[found.doc] if len(ids) else found.doc, where)
        whole = local | (kind == ALL)
        add(found.start[whole], found.count[whole])
        some = everything[~local & (kind == SOME)]
        for i in some.tolist():
            hit = np.flatnonzero(where[3][mask_at[i] : mask_at[i] + found.count[i]]) + found.start[i]
            add(hit, np.ones(len(hit), np.int64))
        split = everything[~local & (kind == SPLIT)]
        if len(split):
            context, start, key, value = found.windows(split, buckets)
            local, kind, mask_at = _resolve(key, value, ids[found.doc[context]], where)
            hit = local | (kind == ALL)
            part = np.flatnonzero(~local & (kind == SOME))
            hit[part] = where[3][mask_at[part]]
            add(start[hit], np.ones(int(hit.sum()), np.int64))
        gone = np.cumsum(cover[:-1], out=cover[:-1]) > 0
        del cover
        removed = _before(gone, off)
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        edges = off[:-1][off[:-1] < off[1:]]
        begins[edges] = gone[edges]
        spans = _before(begins, off)
        left = memoryview(np.ascontiguousarray(body[~gone]))
        cut = (off - removed).tolist()
        kept = [left[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        cols = {"n_bytes": pa.array(np.diff(off)), "n_removed": pa.array(np.diff(removed)), "n_spans": pa.array(np.diff(spans)), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())}
        if with_text:  # a character that loses a byte goes whole
            known = table.column("text").is_valid().to_pylist()
            cols["kept_text"] = pa.array([bytes(k).decode("utf-8", "ignore") if ok else None for k, ok in zip(kept, known, strict=True)], pa.string())
        out = table.drop_columns(["text"])
        for name, col in cols.items():
            out = out.append_column(name, col)
        return out

    return run


def _lookup(marks: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All marks of a part, sorted by key and hash: those, kinds, starts in the bits, the bits."""
    if not marks.num_rows:
        return np.zeros(0, _CODE), np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, bool)
    load = lambda c, kind: [np.frombuffer(x.as_buffer(), kind) for x in marks.column(c)]
    keys, hashes, kinds, packed = load("keys", "<u8"), load("hashes", "<u8"), load("kinds", np.uint8), load("masks", np.uint8)
    sizes = load("sizes", "<i4")
    starts, bits, at = [], [], 0
    for size, mask in zip(sizes, packed, strict=True):
        ends = offsets_of(size.astype(np.int64))
        starts.append(at + ends[:-1])
        bits.append(np.unpackbits(mask, count=int(ends[-1])).astype(bool))
        at += int(ends[-1])
    code = _code(np.concatenate(keys), np.concatenate(hashes))
    order = np.argsort(code["mixed"], kind="stable")
    return code[order], np.concatenate(kinds)[order], np.concatenate(starts)[order], np.concatenate(bits)


#: A context's key and hash, and both mixed, by which they are sorted.
_CODE = np.dtype([("mixed", "<u8"), ("key", "<u8"), ("value", "<u8")])


def _code(key: np.ndarray, value: np.ndarray) -> np.ndarray:
    out = np.zeros(len(key), _CODE)
    out["mixed"], out["key"], out["value"] = _join(key, value), key, value
    return out


def _alike(a: np.ndarray, b: np.ndarray) -> None:
    if ((a["key"] != b["key"]) | (a["value"] != b["value"])).any():
        raise RuntimeError("two different strings have one hash")


def _resolve(key: np.ndarray, value: np.ndarray, doc: np.ndarray, where: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For contexts: is there an equal one in a smaller document of this part; the mark's kind (255: none); its first bit."""
    code = _code(key, value)
    order = np.lexsort((doc, code["mixed"]))
    sorted_ = code[order]
    edge = _groups(sorted_["mixed"])
    local = np.zeros(len(code), bool)
    if len(code):
        lead = np.repeat(edge[:-1], np.diff(edge))
        _alike(sorted_, sorted_[lead])
        local[order] = doc[order] > doc[order][lead]
    kind, bit = np.full(len(code), 255, np.uint8), np.zeros(len(code), np.int64)
    if len(where[0]) and len(code):
        at = np.minimum(np.searchsorted(where[0]["mixed"], code["mixed"]), len(where[0]) - 1)
        hit = where[0]["mixed"][at] == code["mixed"]
        _alike(where[0][at[hit]], code[hit])
        kind[hit], bit[hit] = where[1][at[hit]], where[2][at[hit]]
    return local, kind, bit


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: tuple[str, ...] = (), with_text: bool = False, common: tuple[int, int] = (COMMON_PARTS, COMMON_HERE)) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``more`` columns; with
    ``with_text`` also ``kept_text``, where a character that loses one of its bytes goes whole).

    Removed is each byte covered by a LENGTH-byte string that also starts in a document with a smaller id;
    strings are judged on the input. Null counts as empty (and stays null as ``kept_text``); shorter texts
    keep all bytes. Rows that repeat an id don't affect each other; a null id is the same as the largest
    long, above all others. An empty table gives no rows.
    """
    docs = as_docs(df, id_col, text_col, *more)
    spark = docs.sparkSession
    _, volume = text_volume(docs)
    parts = max(2 * shuffle_parts(spark), volume // PART_BYTES)
    buckets = max(shuffle_parts(spark), volume // BUCKET_BYTES)
    tasks = volume // TASK_BYTES
    spread = lambda df, by: df.repartition(tasks, by) if tasks > shuffle_parts(spark) else df
    dealt = docs.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("long")).mapInArrow(_pack_docs, "part long, rows binary")
    dealt = spread(dealt, "part")
    grouped = dealt.groupBy("part")
    anchors = grouped.applyInArrow(_find_anchors(buckets, common[1]), "part long, bucket long, keys binary, flags binary")
    judged = spread(anchors, "bucket").groupBy("bucket").applyInArrow(_judge_anchors(common[0]), "part long, bucket long, codes binary")
    sent = grouped.cogroup(judged.groupBy("part")).applyInArrow(_send_contexts(buckets), "bucket long, part long, keys binary, hashes binary, counts binary, docs binary, kinds binary, bytes binary")
    marks = spread(sent, "bucket").groupBy("bucket").applyInArrow(_match_contexts, "part long, keys binary, hashes binary, kinds binary, sizes binary, masks binary")
    extra = "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in more)
    schema = f"doc_id long{extra}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    return grouped.cogroup(marks.groupBy("part")).applyInArrow(_apply_marks(buckets, with_text), schema)

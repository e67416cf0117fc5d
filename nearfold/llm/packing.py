"""Packing: token windows by Karmarkar-Karp multiway differencing.

Documents are cut at the window size; what is left over is cut into grains and dealt to windows by
largest differencing: of all partial partitions, the two with the largest differences are merged so that
their imbalances oppose, until one is left. The windows come out nearly equal; if one exceeds the
capacity, the window count rises and differencing starts again.

Partitions pack their own documents. The last run of a partition, where it would leave windows short, goes
to a second round, in which GROUP neighbouring partitions pack their last runs together.
"""

from __future__ import annotations

import heapq
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.llm.arrowtext import text_slices
from nearfold.llm.common import as_docs, saved
from nearfold.llm.tokens import encoder, vocabulary

VOCABULARY = "byte_bpe_50k.json"
CAPACITY = 2048
END_ID = 1
#: Longest left-over piece; smaller grains balance better and cut more.
GRAIN = 512
#: Left-over pieces of one differencing run.
BLOCK = 2048
#: Partitions whose last runs meet in the second round, and the part of their windows that a last run must fill to stay.
GROUP, FILLED = 64, 0.99
_COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: deal items to k sets with nearly equal sums; returns item numbers by set."""
    if not sizes:
        return [[] for _ in range(k)]
    if k == 1:
        return [list(range(len(sizes)))]
    # a partial partition: slots (sum, age, items as a tree) by rising sum; slots without items are implicit zeros
    age = len(sizes)
    heap: list[tuple[int, int, list]] = [(-s, i, [(s, i, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        shared = len(a) + len(b) - k
        if len(b) == 1 and shared == 1:
            low, item = a.pop(0), b[0]
            age += 1
            insort(a, (low[0] + item[0], age, (low[2], item[2])))
            merged = a
        elif len(b) == 1:
            insort(a, b[0])
            merged = a
        elif shared <= 0:
            merged = sorted(a + b)
        else:
            # the largest sums of one meet the smallest of the other
            merged = a[shared:] + b[shared:]
            for x, y in zip(reversed(a[:shared]), b[:shared], strict=True):
                age += 1
                merged.append((x[0] + y[0], age, (x[2], y[2])))
            merged.sort()
        if len(merged) == k and (least := merged[0][0]):
            merged = [(s - least, g, items) for s, g, items in merged]
        age += 1
        heapq.heappush(heap, (-(merged[-1][0] - (merged[0][0] if len(merged) == k else 0)), age, merged))
    out = []
    for _, _, tree in heap[0][2]:
        items, stack = [], [tree]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += node
            else:
                items.append(node)
        out.append(sorted(items))
    return out + [[] for _ in range(k - len(out))]


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Sets of items of at most ``capacity`` each; every item must fit."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        sets = differencing(sizes, k)
        if all(sum(sizes[i] for i in s) <= capacity for s in sets):
            return [s for s in sets if s]
        k += 1


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], list(names))


def _dealt(pieces: list[tuple], number: int, capacity: int) -> list[tuple]:
    """Pieces (id, start, length, crc, tokens) in windows that are numbered from ``number`` on."""
    done = []
    for chosen in windows([p[2] for p in pieces], capacity):
        at = 0
        for i in chosen:
            done.append((*pieces[i], number, at))
            at += pieces[i][2]
        number += 1
    return done


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, grain: int = GRAIN, block: int = BLOCK) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its ids and ``end_id``; null and empty texts are that id alone, repeated rows are packed
    one by one, a null id stays null. Each id lies in one piece. Sequences hold at most ``capacity`` ids,
    without gaps. Each partition packs its own documents, in runs of ``block`` left-over pieces; only last
    runs (less than ``block`` pieces a partition) are shuffled. Sequence ids count within a partition, or a
    group of the second round, whose number is in their high bits. An empty table gives no rows.
    """
    path = vocabulary(VOCABULARY, path)
    names = (*_COLUMNS, "part", "place")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        number = part << 33
        encode = encoder(path)
        rest: list[tuple] = []
        for rows, text in text_slices(batches, keep=True):
            ids, off = encode(text)
            n = len(off) - 1
            ends = off[1:] + np.arange(1, n + 1)
            flat = np.full(int(ends[-1]), end_id, "<u4")
            mask = np.ones(len(flat), bool)
            mask[ends - 1] = False
            flat[mask] = ids
            view, out = memoryview(flat).cast("B"), []
            for doc, a, b in zip(rows.column("doc_id").to_pylist(), np.concatenate(([0], ends[:-1])).tolist(), ends.tolist(), strict=True):
                total = b - a
                whole = total - total % capacity
                for s in range(0, whole, capacity):
                    out.append((doc, s, capacity, crc32(view[4 * (a + s) : 4 * (a + s + capacity)]), total, number, 0))
                    number += 1
                for s in range(whole, total, grain):
                    size = min(grain, total - s)
                    rest.append((doc, s, size, crc32(view[4 * (a + s) : 4 * (a + s + size)]), total))
                if len(rest) >= block:
                    done = _dealt(rest, number, capacity)
                    number = done[-1][5] + 1
                    out += done
                    rest = []
            if out:
                yield _batch([(*x, part, 0) for x in out], names)
        if rest:
            done = _dealt(rest, number, capacity)
            used = done[-1][5] + 1 - number
            if sum(p[2] for p in rest) < FILLED * used * capacity:
                done = [(*p, None, 0) for p in rest]
            yield _batch([(*x, part, i) for i, x in enumerate(done)], names)

    def pack_rest(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("place", "ascending")])
        number = 1 << 61 | table.column("part")[0].as_py() // GROUP << 33
        pieces = list(zip(*(table.column(c).to_pylist() for c in _COLUMNS[:5]), strict=True))
        out: list[tuple] = []
        for at in range(0, len(pieces), block):
            out += _dealt(pieces[at : at + block], number, capacity)
            number = out[-1][5] + 1
        return pa.Table.from_batches([_batch(out, _COLUMNS)])

    schema = ", ".join(f"{c} long" for c in _COLUMNS)
    pieces = saved(as_docs(df, id_col, text_col).mapInArrow(pack, schema + ", part long, place long"), "pieces")
    last = pieces.where(F.col("sequence_id").isNull()).groupBy(F.floor(F.col("part") / GROUP)).applyInArrow(pack_rest, schema)
    return pieces.where(F.col("sequence_id").isNotNull()).select(*_COLUMNS).unionByName(last)

"""Token-ID files: shards of documents in ascending id order, each compressed by its own Re-Pair grammar.

Documents are encoded where they lie and meet by ranges of their ids; a range is cut into shards of about
SHARD_IDS ids. Bounds of the ranges come from a sample of the ids, drawn by a hash with a chance that
grows with the text's bytes, so a range holds about as many bytes as another; ids and files don't depend on it.

A shard's binary form (little endian): magic, counts, the rules (pairs of symbols) with their expansion
lengths, per document its id and the ends of its symbols and of its ids, and the symbols. Symbols below
``base`` are token ids, the others nonterminals. Expansion lengths let a reader find any span of a document
without decoding what precedes it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.llm.arrowtext import give_back, offsets_of, spans_index, text_slices
from nearfold.llm.common import as_docs, prefix_sums, saved, shuffle_parts, text_volume
from nearfold.llm.tokens import crc_rows, encoder, vocabulary

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
#: Ids that a shard should hold, about.
SHARD_IDS = 1 << 21
#: UTF-8 bytes of text of a range of ids: least, and most that one task holds, about. A bound is 8 bytes of each task's closure.
RANGE_BYTES = (6 << 20, 64 << 20)
#: Sampled ids of a range; the driver gets these, 8 bytes each, for each RANGE_BYTES of text.
SAMPLES = 8
#: Number of the first range of ids; below are the partitions' documents without id.
FIRST_RANGE = 1 << 30
MAGIC, HEAD = b"RPG2", "<4sIIIQQQ"
#: New rules of a round of replacement, and the least count of a pair worth a rule.
RULES_A_ROUND, LEAST_COUNT = 8192, 16


def repair(ids: np.ndarray, ends: np.ndarray, base: int, per_round: int = RULES_A_ROUND, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grammar of one shard: symbols, each document's end in them, and the rules (n x 2).

    Each round counts the pairs that lie inside a document, takes the most frequent ones (ties by pair)
    and replaces their occurrences from left to right. Rounds go on until no pair is frequent.
    """
    symbols, last = ids.astype(np.uint32), np.zeros(len(ids), bool)
    last[ends[ends > 0] - 1] = True
    rules: list[np.ndarray] = []
    top = base
    new = 0  # only pairs with a symbol from here on can be frequent: a round leaves no occurrence of what it replaces
    while len(symbols) > 1:
        inner = ~last[:-1]
        if new:
            young = symbols >= new
            inner &= young[:-1] | young[1:]
        wide, deep = np.uint64(int(top - 1).bit_length()), np.uint64(len(symbols).bit_length())
        if 2 * wide + deep > 64:
            raise ValueError("a shard has too many ids")
        # a pair and its place in one number, sorted in place
        code = symbols[:-1][inner].astype(np.uint64)
        code <<= wide
        code |= symbols[1:][inner]
        code <<= deep
        code |= np.flatnonzero(inner).view(np.uint64)
        code.sort()
        pair = code >> deep
        edge = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1], [True]))) if len(pair) else np.zeros(1, int)
        count = np.diff(edge)
        often = np.flatnonzero(count >= least)
        if not len(often):
            break
        new = top
        if len(often) > per_round:
            often = np.sort(often[np.argsort(-count[often], kind="stable")[:per_round]])
            new = 0
        chosen, many = pair[edge[often]], count[often]
        at = (code[spans_index(edge[often], many)] & ((np.uint64(1) << deep) - np.uint64(1))).view(np.int64)
        del code, pair, edge, count
        at <<= 32
        at |= np.repeat(np.arange(len(often)), many)
        at.sort()
        at, found = at >> 32, at & 0xFFFFFFFF
        # of overlapping occurrences every second one is replaced, from the left
        run = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1] + 1)))
        taken = ((np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) & 1) == 0
        at, found = at[taken], found[taken]
        rules.append(np.stack((chosen >> wide, chosen & ((np.uint64(1) << wide) - np.uint64(1))), axis=1).astype(np.uint32))
        symbols[at] = top + found
        last[at] |= last[at + 1]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, last = symbols[keep], last[keep]
        top += len(chosen)
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    done = np.zeros(len(ends), np.int64)
    filled = np.diff(ends, prepend=0) > 0
    done[filled] = np.flatnonzero(last) + 1
    return symbols, np.maximum.accumulate(done) if len(done) else done, table


def write_shard(doc_ids: np.ndarray, ids: np.ndarray, ends: np.ndarray, base: int, nulls: int = 0) -> bytes:
    """Binary form of a shard; ``ends`` are the documents' ends in ``ids``, the first ``nulls`` documents have no id."""
    symbols, done, rules = repair(ids, ends, base)
    sizes = _expansions(rules, base)
    wide = max(2, (int(base + len(rules) - 1).bit_length() + 7) // 8)
    head = struct.pack(HEAD, MAGIC, wide, base, len(rules), len(doc_ids), nulls, len(symbols))
    body = symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :wide]
    return b"".join((head, rules.astype("<u4").tobytes(), sizes.astype("<u4").tobytes(), doc_ids.astype("<i8").tobytes(), done.astype("<i8").tobytes(), ends.astype("<i8").tobytes(), body.tobytes()))


def _expansions(rules: np.ndarray, base: int) -> np.ndarray:
    """Expansion length of every rule. A rule uses earlier rules only."""
    sizes = np.zeros(len(rules), np.int64)
    todo = np.arange(len(rules))
    while len(todo):
        part = rules[todo].astype(np.int64) - base
        known = np.where(part < 0, 1, sizes[np.maximum(part, 0)])
        ready = (known > 0).all(axis=1)
        sizes[todo[ready]] = known[ready].sum(axis=1)
        todo = todo[~ready]
    return sizes


class Shard:
    """Reader of one shard's bytes."""

    def __init__(self, data: bytes):
        magic, wide, self.base, rules, docs, self.nulls, symbols = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = struct.calcsize(HEAD)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.rules = take("<u4", 2 * rules).reshape(-1, 2)
        self.sizes = take("<u4", rules).astype(np.int64)
        self.doc_ids, self.symbol_ends, self.ends = take("<i8", docs), take("<i8", docs), take("<i8", docs)
        body = np.zeros((symbols, 4), np.uint8)
        body[:, :wide] = take("u1", symbols * wide).reshape(symbols, wide)
        self.symbols = body.view("<u4").ravel()
        if len(data) != at:
            raise ValueError("shard has a wrong length")
        self._flat: np.ndarray | None = None

    def _expanded(self) -> tuple[np.ndarray, np.ndarray]:
        """All rules written out, end to end, and where each starts."""
        start = offsets_of(self.sizes)
        if self._flat is None:
            flat = np.repeat(np.arange(len(self.rules), dtype=np.int64) + self.base, self.sizes)
            where = spans_index(np.zeros(len(self.rules), np.int64), self.sizes)
            while (open_ := np.flatnonzero(flat >= self.base)).size:
                rule = flat[open_] - self.base
                left, right = self.rules[rule, 0].astype(np.int64), self.rules[rule, 1].astype(np.int64)
                first = np.where(left < self.base, 1, self.sizes[np.maximum(left - self.base, 0)])
                inside = where[open_] < first
                flat[open_] = np.where(inside, left, right)
                where[open_] -= np.where(inside, 0, first)
            self._flat = flat.astype(np.uint32)
        return self._flat, start

    def decode(self, symbols: np.ndarray | None = None) -> np.ndarray:
        """Ids of all documents, or of some symbols."""
        s = (self.symbols if symbols is None else symbols).astype(np.int64)
        if not len(self.rules):
            return s.astype(np.uint32)
        flat, start = self._expanded()
        table = np.concatenate((flat, np.arange(self.base, dtype=np.uint32)))
        rule = s - self.base
        ruled = rule >= 0
        at = np.where(ruled, start[np.maximum(rule, 0)], len(flat) + s)
        return table[spans_index(at, np.where(ruled, self.sizes[np.maximum(rule, 0)], 1))]

    def span(self, doc: int, start: int, length: int) -> np.ndarray:
        """Ids ``start`` .. ``start + length`` of the doc-th document; only the symbols that cover them are expanded."""
        a, b = int(self.symbol_ends[doc - 1]) if doc else 0, int(self.symbol_ends[doc])
        s = self.symbols[a:b].astype(np.int64)
        ends = np.cumsum(np.where(s < self.base, 1, self.sizes[np.maximum(s - self.base, 0)] if len(self.sizes) else 1))
        first, last = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, start + length, side="left")
        skip = start - (int(ends[first - 1]) if first else 0)
        return self.decode(s[first : last + 1])[skip : skip + length]


def _range_edges(docs: DataFrame, size: int, bounds: tuple[int, int]) -> np.ndarray:
    """First ids of all ranges but the first, for texts of ``size`` bytes in all."""
    low, high = bounds
    each = min(high, max(low, size // (4 * shuffle_parts(docs.sparkSession))))
    ranges = size // each
    if ranges < 2:
        return np.zeros(0, np.int64)
    chance = F.octet_length("text") * F.lit(SAMPLES * ranges / size)
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30)) < chance
    ids = np.sort(docs.where(drawn & F.col("doc_id").isNotNull()).select("doc_id").toArrow().column("doc_id").to_numpy())
    return np.unique(ids[SAMPLES::SAMPLES])


def write_token_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS, range_bytes: tuple[int, int] = RANGE_BYTES) -> DataFrame:
    """``shard, first_id, n_docs, n_tokens, data``: shards in ascending id order, null ids first.

    Shard numbers ascend with the ids. Rows that repeat an id lie in one range, and next to each other. Null
    and empty texts are the end id alone; null ids have ranges of their own, dealt by the partition that
    holds them. An empty table gives no shards.
    """
    path = vocabulary(VOCABULARY, path)
    docs = as_docs(df, id_col, text_col)
    edges = _range_edges(docs, text_volume(docs)[1], range_bytes)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(path, True)
        unnamed = TaskContext.get().partitionId()
        for rows, text in text_slices(batches, keep=True):
            ids, off = encode(text)
            doc = rows.column("doc_id")
            own = pc.fill_null(doc, 0).to_numpy()
            where = np.where(doc.is_null().to_numpy(zero_copy_only=False), unnamed, FIRST_RANGE + np.searchsorted(edges, own, side="right"))
            # rows of a range travel as one block: ids as 2 bytes, all documents end to end
            kind = np.uint16 if not len(ids) or ids.max() < 1 << 16 else np.uint32
            order = np.argsort(where, kind="stable")
            sizes = np.diff(off)
            used, at = np.unique(where[order], return_index=True)
            out = []
            for s, part in zip(used.tolist(), np.split(order, at[1:]), strict=True):
                out.append((s, own[part].astype("<i8").tobytes(), sizes[part].astype("<i8").tobytes(), kind().itemsize, ids[spans_index(off[:-1][part], sizes[part])].astype(kind).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary()), strict=True)], ["range", "docs", "sizes", "width", "ids"])

    def build(table: pa.Table) -> pa.Table:
        give_back()
        number = table.column("range")[0].as_py()
        docs_, sizes, ids = [], [], []
        for d, s, w, i in zip(*(table.column(c) for c in ("docs", "sizes", "width", "ids")), strict=True):
            docs_.append(np.frombuffer(d.as_buffer(), "<i8"))
            sizes.append(np.frombuffer(s.as_buffer(), "<i8"))
            ids.append(np.frombuffer(i.as_buffer(), f"<u{w.as_py()}"))
        doc, size, flat = np.concatenate(docs_), np.concatenate(sizes), np.concatenate(ids)
        start = offsets_of(size)[:-1]
        order = np.argsort(doc, kind="stable")
        again = np.flatnonzero(doc[order][1:] == doc[order][:-1])
        if len(again):  # repeated ids: by size and content, so that retries agree
            order = np.array(sorted(order.tolist(), key=lambda i: (doc[i], size[i], flat[start[i] : start[i] + size[i]].tobytes())))
        doc, size, start = doc[order], size[order], start[order]
        cut = np.flatnonzero(np.diff(np.cumsum(size + 1) // shard_ids, prepend=0)) if len(size) else []
        edge = sorted({0, len(doc), *(int(c) for c in cut)})
        out = []
        for k, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
            ends = np.cumsum(size[a:b] + 1)
            own = np.full(int(ends[-1]), end_id, np.uint32)
            own[spans_index(ends - size[a:b] - 1, size[a:b])] = flat[spans_index(start[a:b], size[a:b])]
            nulls = b - a if number < FIRST_RANGE else 0
            out.append(((number << 12) + k, None if nulls else int(doc[a]), b - a, len(own), write_shard(doc[a:b], own, ends, base, nulls)))
        cols = zip(*out, strict=True)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("shard", "first_id", "n_docs", "n_tokens", "data"), cols, kinds, strict=True)})

    base = _vocabulary_size(path)
    blocks = docs.mapInArrow(tokens, "range long, docs binary, sizes binary, width int, ids binary")
    return blocks.groupBy("range").applyInArrow(build, "shard long, first_id long, n_docs long, n_tokens long, data binary")


def _vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab().values()) + 1


def read_token_shards(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the shards' bytes."""
    starts = prefix_sums(shards.select("shard", "n_tokens"), [], "shard", {"before": "n_tokens"}, 1 << 22)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column("shard"), batch.column("data"), strict=True):
                shard = Shard(data.as_buffer().to_pybytes())
                ids, off = shard.decode(), np.concatenate(([0], shard.ends))
                null = np.arange(len(shard.ends)) < shard.nulls
                yield pa.RecordBatch.from_arrays([pa.array([number.as_py()] * len(null), pa.int64()), pa.array(shard.doc_ids, mask=null), pa.array(off[:-1]), pa.array(np.diff(off)), pa.array(crc_rows(ids, off), pa.int64())], ["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = shards.select("shard", "data").mapInArrow(read, "shard long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(starts.select("shard", "before"), "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write the shards as a table in the shared folder and read it back: see ``read_token_shards``."""
    return read_token_shards(saved(write_token_shards(df, id_col, text_col, path), "token-shards"))

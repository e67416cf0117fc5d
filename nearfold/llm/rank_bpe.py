"""Byte-level BPE by a hierarchical-bitmap rank queue.

Linked-list positions wait in a bucket for each merge rank. A two-level bitmap marks the ranks whose
buckets hold entries; find-first-set on the summary word, then on the word below it, gives the next
rank in constant time. Entries whose pair has changed since are stale and are skipped when they surface.
A piece of n bytes takes n entries and at most 2n more, so very long pieces stay near linear.

Pieces share a queue in batches of about BATCH_BYTES: their lists never touch, so the order of merges
between pieces is free, and each bucket is drained from left to right in one go.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nearfold.llm.arrowtext import offsets_of, spans_index, text_slices
from nearfold.llm.common import as_docs
from nearfold.llm.tokens import ChunkEncoder, encoder, piece_pattern, vocabulary

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bits of a bitmap word, as a power of two.
WORD = 8
#: Bytes of the pieces that one queue serves at once, about (a longer piece has a queue of its own).
BATCH_BYTES = 1 << 18


def read_ranks(path: str) -> dict[bytes, int]:
    """Merge ranks of a rank file: base64 bytes and a rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class RankQueue:
    """Buckets by rank under a two-level bitmap."""

    __slots__ = ("buckets", "summary", "words")

    def __init__(self, ranks: np.ndarray) -> None:
        """Holds every position whose rank is not negative."""
        at = np.flatnonzero(ranks >= 0)
        at = at[np.argsort(ranks[at], kind="stable")]
        values, first = np.unique(ranks[at], return_index=True)
        places, edges = at.tolist(), [*first.tolist(), len(at)]
        self.buckets: dict[int, list[int]] = {}
        self.words: dict[int, int] = {}
        self.summary = 0
        for k, rank in enumerate(values.tolist()):
            self.open(rank, places[edges[k] : edges[k + 1]])

    def open(self, rank: int, positions: list[int]) -> None:
        """Start the bucket of a rank that has none."""
        self.buckets[rank] = positions
        word = rank >> WORD
        self.words[word] = self.words.get(word, 0) | 1 << (rank & (1 << WORD) - 1)
        self.summary |= 1 << word

    def take(self) -> tuple[int, list[int]]:
        """The least rank and its bucket from left to right, taken out; the queue must not be empty."""
        word = (self.summary & -self.summary).bit_length() - 1
        bits = self.words[word]
        low = bits & -bits
        bits ^= low
        self.words[word] = bits
        if not bits:
            self.summary ^= 1 << word
        rank = word << WORD | low.bit_length() - 1
        bucket = self.buckets.pop(rank)
        bucket.sort()
        return rank, bucket


class RankMerger:
    """Encodes pre-tokens by merge ranks."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.single = np.array([ranks.get(bytes((b,)), -1) for b in range(256)], np.int32)
        self.double = np.full(1 << 16, -1, np.int32)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.double[token[0] << 8 | token[1]] = rank

    def __call__(self, pieces: Sequence[bytes]) -> list[list[int]]:
        """Ids of each piece; bytes that the ranks lack raise KeyError."""
        ids, sizes = self.flat(pieces)
        flat, at = ids.tolist(), offsets_of(sizes).tolist()
        return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def flat(self, pieces: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces end to end, and how many each has."""
        ranks = self.ranks
        whole = np.fromiter((ranks.get(p, -1) if p else -2 for p in pieces), np.int64, len(pieces))
        sizes = (whole != -2).astype(np.int64)
        parts: list[tuple[list[int], np.ndarray]] = []
        batch: list[int] = []
        held = 0
        for k in np.flatnonzero(whole == -1).tolist():
            if batch and held + len(pieces[k]) > BATCH_BYTES:
                parts.append((batch, self._merge([pieces[i] for i in batch], sizes, batch)))
                batch, held = [], 0
            batch.append(k)
            held += len(pieces[k])
        if batch:
            parts.append((batch, self._merge([pieces[i] for i in batch], sizes, batch)))
        ends = offsets_of(sizes)
        ids = np.zeros(int(ends[-1]), np.int64)
        ids[ends[:-1][whole >= 0]] = whole[whole >= 0]
        for own, merged in parts:
            ids[spans_index(ends[own], sizes[own])] = merged
        return ids, sizes

    def _merge(self, pieces: list[bytes], counts: np.ndarray, at: list[int]) -> np.ndarray:
        """Ids of all pieces end to end; their numbers go to ``counts``. Every piece is followed by one closing position."""
        data = b"\0".join(pieces) + b"\0"
        body = np.frombuffer(data, np.uint8)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        closing = np.cumsum(sizes + 1) - 1
        kind = np.int32 if len(data) < 1 << 31 else np.int64
        code = "i" if kind is np.int32 else "q"
        follow = np.arange(1, len(data) + 1, dtype=kind)
        follow[closing] = 0  # what ends before it starts is no token
        back = np.arange(-1, len(data) - 1, dtype=kind)
        back[closing - sizes] = -1
        first = np.full(len(data), -1, np.int32)
        first[:-1] = self.double[body[:-1].astype(np.int32) << 8 | body[1:]]
        first[closing], first[closing - 1] = -2, -1
        queue = RankQueue(first)
        after = array(code, follow.tobytes())  # end of the part that starts here, and so the next part's start
        before = array(code, back.tobytes())
        pair = array("i", first.tobytes())  # rank of this part with the next one; -1: none, -2: no part starts here
        token = array("i", self.single[body].tobytes())
        buckets, get = queue.buckets, self.ranks.get
        while queue.summary:
            rank, bucket = queue.take()
            for k, i in enumerate(bucket):
                if pair[i] != rank:
                    continue  # stale
                gone = after[i]
                end = after[gone]
                after[i], before[end], pair[gone], token[i] = end, i, -2, rank
                pair[i] = least = new = get(data[i : after[end]], -1)
                if new >= 0:
                    if new in buckets:
                        buckets[new].append(i)
                    else:
                        queue.open(new, [i])
                left = before[i]
                if left >= 0:
                    new = get(data[left:end], -1)
                    pair[left] = new
                    if new >= 0:
                        if new in buckets:
                            buckets[new].append(left)
                        else:
                            queue.open(new, [left])
                        if new < least or least < 0:
                            least = new
                if 0 <= least < rank and k + 1 < len(bucket):  # that pair comes before the rest of this bucket
                    queue.open(rank, bucket[k + 1 :])
                    break
        starts = np.frombuffer(pair, np.int32) != -2
        ids = np.frombuffer(token, np.int32)[starts]
        if len(ids) and ids.min() < 0:
            raise KeyError(int(body[starts][ids < 0][0]))
        counts[at] = np.add.reduceat(starts.astype(np.int64), closing - sizes)
        return ids


class DecimalEncoder(ChunkEncoder):
    """Also holds each id in decimal, and its bytes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        merge, pieces = RankMerger(ranks), piece_pattern().findall
        super().__init__(lambda ps: merge.flat([p.encode() for p in ps]), pieces, False, pieces)
        by_id = sorted(ranks.items(), key=lambda x: x[1])
        size = by_id[-1][1] + 1
        self.sizes = np.zeros(size, np.int64)
        for token, i in by_id:
            self.sizes[i] = len(token)
        self.at = offsets_of(self.sizes)[:-1]
        self.bytes = np.frombuffer(b"".join(token for token, _ in by_id), np.uint8)
        width = len(str(size))
        digits = [f"{i} ".encode() for i in range(size)]
        self.digits = np.frombuffer(b"".join(d.ljust(width + 1) for d in digits), np.uint8).reshape(size, width + 1)
        self.shown = np.arange(width + 1) < np.array([len(d) for d in digits])[:, None]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids, end to end."""
        return self.bytes[spans_index(self.at[ids], self.sizes[ids])]

    def decimal(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids in decimal, each with a space behind it, and the ends of each."""
        shown = self.shown[ids]
        return self.digits[ids][shown], offsets_of(shown.sum(axis=1))


def rank_encoder(path: str, words: bool = False) -> DecimalEncoder:
    return DecimalEncoder(read_ranks(path))


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, ids`` (array of int) of whole texts. Null and empty texts have no ids; repeated rows stay."""
    path = vocabulary(VOCABULARY, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, make=rank_encoder)
        for rows, text in text_slices(batches, keep=True):
            ids, off = encode(text)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.ListArray.from_arrays(off.astype(np.int32), ids.astype(np.int32))], ["doc_id", "ids"])

    return as_docs(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def _digests(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """SHA-256 of spans of some bytes."""
    view = memoryview(np.ascontiguousarray(body))
    return [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def encoding_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: digests of the ids in decimal, and of the bytes that
    the ids decode to. Null and empty texts have 0 tokens and the digests of nothing; repeated rows stay."""
    path = vocabulary(VOCABULARY, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, make=rank_encoder)
        for rows, text in text_slices(batches, keep=True):
            ids, ends = encode(text)
            plain, cut = encode.decode(ids), offsets_of(encode.sizes[ids])[ends]
            shown, edge = encode.decimal(ids)
            edge = edge[ends]
            shas = _digests(shown, edge[:-1], np.maximum(edge[1:] - 1, edge[:-1]))  # without the last space
            texts = _digests(plain, cut[:-1], cut[1:])
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(ends)), pa.array(shas, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return as_docs(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

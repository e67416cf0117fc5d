"""Whole-text tokenisation at corpus speed: texts are cut where the vocabulary's own pre-tokeniser always
cuts, distinct chunks are cut into pieces by byte classes, every distinct piece is encoded once by the
tokenizer library while it stays in a bounded table, and ids are gathered by numpy.

The result equals encoding the whole text. Cutting is safe where a single white space stands between two
other characters; texts in which white space runs occur, or control characters that libraries class
differently, take a slower path that cuts at each match of the pre-tokeniser's pattern. Chunks with
characters beyond Latin, apostrophes or inner white space are cut by that pattern too.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from nearfold.llm.arrowtext import held, offsets_of, raw_utf8, spans_index

#: Unicode white space as the pre-tokenisers' engines define it (a fixed value).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Texts with a run of white space, or characters that not all engines class alike, in RE2's spelling.
ODD_RUNS = r"[\t-\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}\x{3000}\x{feff}]{2}"
ODD_CHARS = r"[\x00-\x08\x0e-\x1f\x{85}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}\x{3000}\x{feff}]"
#: Splitting pattern of the word-end vocabulary (a fixed value), applied to lower-case ASCII chunks only.
WORD_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Pieces that the table may hold before it is thinned out, and their bytes and ids.
CACHE_PIECES, CACHE_BYTES, CACHE_IDS = 250_000, 1 << 23, 1 << 22
#: Classes of bytes; ROUGH ones send their chunk to the pattern.
ROUGH, LETTER, NUMBER, MARK, BLANK, LINE = range(6)
#: First code point that the class tables don't cover (two bytes of UTF-8 reach further).
COVERED = 0x250


def vocabulary(name: str, path: str | None = None) -> str:
    """Path of a public vocabulary file; an explicit path wins."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_pattern():
    """The public splitting pattern with white space spelt out, so that every engine reads it alike."""
    import public_tokenizers
    import regex

    text = public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{SPACE}\\p{{L}}\\p{{N}}]")
    return regex.compile(text.replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))


def _class_of(c: str) -> int:
    kind = unicodedata.category(c)[0]
    if c.isspace() or c == "'" or kind in "CZ" and c != "­":
        return LINE if c == "\n" else BLANK if c == " " else ROUGH
    return {"L": LETTER, "N": NUMBER}.get(kind, MARK)


def class_table() -> np.ndarray:
    """Class of each covered code point."""
    return np.array([_class_of(chr(c)) for c in range(COVERED)], np.uint8)


def lower_table(classes: np.ndarray) -> np.ndarray:
    """Lower case of each covered code point that has one of as many bytes; others with a case, and characters
    that composition changes, become rough in ``classes``."""
    out = np.arange(COVERED)
    for c in range(128, COVERED):
        low = chr(c).lower()
        if len(low) != 1 or not 128 <= ord(low) < COVERED or not unicodedata.is_normalized("NFC", chr(c)):
            classes[c] = ROUGH
        else:
            out[c] = ord(low)
    return out


class Cutter:
    """Cuts distinct chunks into pieces; ``words`` is the word-end vocabularies' way, else a leading blank
    belongs to its piece. ``rough`` cuts the chunks that the classes can't."""

    def __init__(self, rough: Callable[[str], list[str]], words: bool):
        self.rough, self.words = rough, words
        self.classes = class_table()
        self.lower = lower_table(self.classes) if words else None
        self.first = np.where(np.arange(256) < 128, np.resize(self.classes[:128], 256), ROUGH).astype(np.uint8)

    def __call__(self, chunks: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
        """All pieces, chunk after chunk, each chunk's number of pieces, and the chunks' order in both."""
        body, off = raw_utf8(chunks)
        n = len(chunks)
        order = np.arange(n)
        if not n:
            return pa.array([], pa.string()), np.zeros(0, np.int64), order
        kind = self.first[body]
        wide = np.flatnonzero((body >= 0xC2) & (body <= 0xC9))
        if len(wide):
            code = (body[wide].astype(np.int64) & 0x1F) << 6 | body[wide + 1] & 0x3F
            wide, code = wide[code < COVERED], code[code < COVERED]
            kind[wide] = kind[wide + 1] = self.classes[code]
            if self.lower is not None:
                body, code = body.copy(), self.lower[code]
                body[wide], body[wide + 1] = 0xC0 | code >> 6, 0x80 | code & 0x3F
        bad = np.flatnonzero(kind == ROUGH)
        rough = np.zeros(n, bool)
        rough[np.searchsorted(off, bad, side="right") - 1] = True
        begin = np.ones(len(body), bool)
        begin[1:] = kind[1:] != kind[:-1]
        begin[1:] &= kind[:-1] != BLANK
        if self.words:  # every number is a piece of its own
            begin |= (kind == NUMBER) & ((body & 0xC0) != 0x80)
        begin[off[:-1][off[:-1] < off[1:]]] = True
        if not rough.any():
            at = np.flatnonzero(begin)
            return _strings(body, np.append(at, len(body))), np.diff(np.searchsorted(at, off)), order
        plain, rest = np.flatnonzero(~rough), np.flatnonzero(rough)
        kept = np.repeat(~rough, np.diff(off))
        begin = begin[kept]
        at = np.flatnonzero(begin)
        cut = [self.rough(c) for c in chunks.take(pa.array(rest)).to_pylist()]
        pieces = pa.concat_arrays([_strings(body[kept], np.append(at, len(begin))), pa.array([p for ps in cut for p in ps], pa.string())])
        counts = np.concatenate((np.diff(np.searchsorted(at, offsets_of(np.diff(off)[plain]))), np.array([len(ps) for ps in cut], np.int64)))
        return pieces, counts, np.concatenate((plain, rest))


def _strings(body: np.ndarray, off: np.ndarray) -> pa.StringArray:
    """Strings by their offsets in one run of bytes."""
    return pa.StringArray.from_buffers(len(off) - 1, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(body)))


class ChunkEncoder:
    """Encodes Arrow string arrays; ``encode`` gives the ids of distinct pieces end to end and how many each has,
    ``rough`` cuts a chunk that the byte classes can't, ``whole`` an odd text.

    ``words`` says that white space is dropped (word-end vocabularies); else a leading space belongs to
    its chunk. The table of pieces is bounded by pieces, bytes and ids; a full one keeps what recurs.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[Sequence[int], Sequence[int]]], rough: Callable[[str], list[str]], words: bool, whole: Callable[[str], list[str]]):
        self.encode, self.words, self.whole = encode, words, whole
        self.cut = Cutter(rough, words)
        self.reset()

    def reset(self) -> None:
        self.names = pa.array([], pa.string())
        self.starts, self.lengths, self.hits = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint32)

    def _append(self, names: pa.StringArray, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.starts = np.concatenate((self.starts, len(self.flat) + offsets_of(sizes)[:-1]))
        self.lengths = np.concatenate((self.lengths, sizes))
        self.hits = np.concatenate((self.hits, np.zeros(len(names), np.int32)))
        self.flat = np.concatenate((self.flat, ids))
        self.names = pa.concat_arrays([self.names, names])

    def _numbers(self, names: pa.StringArray) -> np.ndarray:
        """Table numbers of distinct pieces; new ones are encoded."""
        found = pc.index_in(names, value_set=self.names) if len(self.names) else pa.nulls(len(names), pa.int32())
        at = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = names.take(pa.array(missing))
            ids, sizes = self.encode(new.to_pylist())
            at[missing] = len(self.names) + np.arange(len(missing))
            self._append(new, np.asarray(sizes, np.int64), np.asarray(ids, np.uint32))
        self.hits[at] += 1
        return at

    def full(self) -> bool:
        return len(self.names) > CACHE_PIECES or self.names.get_total_buffer_size() > CACHE_BYTES or len(self.flat) > CACHE_IDS

    def thin_out(self) -> None:
        """Keep the most frequent pieces of those that came up in more than one call, up to half of a full table."""
        again = np.flatnonzero(self.hits > 1)
        again = again[np.argsort(-self.hits[again], kind="stable")]
        sizes, room = self.lengths[again], pc.binary_length(self.names).to_numpy(zero_copy_only=False)[again].astype(np.int64)
        fits = (np.arange(1, len(again) + 1) <= CACHE_PIECES // 2) & (np.cumsum(sizes) <= CACHE_IDS // 2) & (np.cumsum(room) <= CACHE_BYTES // 4)
        kept, sizes = again[fits], sizes[fits]
        names, ids = self.names.take(pa.array(kept)), self.flat[spans_index(self.starts[kept], sizes)]
        self.reset()
        self._append(names, sizes, ids)
        self.hits[:] = 1

    def _plain(self, text: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
        """Distinct chunks of texts without odd runs, the chunks of all texts by number, and their counts."""
        if self.words:
            lists = pc.utf8_split_whitespace(pc.ascii_lower(text))
        else:
            lists = pc.split_pattern(pc.replace_substring(text, "\n", " \n "), " ")
        off = lists.offsets.to_numpy().astype(np.int64)
        coded = pc.dictionary_encode(lists.values.slice(off[0], off[-1] - off[0]))
        codes, names = coded.indices.to_numpy(), coded.dictionary
        off = off - off[0]
        if self.words:
            return names, codes, np.diff(off)
        line = codes == pc.index(names, "\n").as_py()
        bare = line.copy()
        bare[1:] |= line[:-1]
        bare[off[:-1][off[:-1] < off[1:]]] = True
        keys = codes * 2 + bare
        used = np.flatnonzero(np.bincount(keys, minlength=1))
        at = np.zeros(2 * len(names), np.int32)
        at[used] = np.arange(len(used))
        # the chunk's bytes after a blank, unless it is bare
        body, edge = raw_utf8(names)
        own, blank = used >> 1, 1 - (used & 1)
        sizes = np.diff(edge)[own]
        ends = offsets_of(sizes + blank)
        out = np.full(int(ends[-1]), 32, np.uint8)
        out[spans_index(ends[:-1] + blank, sizes)] = body[spans_index(edge[:-1][own], sizes)]
        return _strings(out, ends), at[keys], np.diff(off)

    def chunks(self, text: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The texts as chunks: numbers of the chunks in order, each text's count of them, and the distinct chunks'
        pieces: where each chunk's begin, how many there are, and the pieces' table numbers, which hold until the next call."""
        if self.full():
            self.thin_out()
        odd = pc.match_substring_regex(text, ODD_CHARS if self.words else ODD_RUNS).to_numpy(zero_copy_only=False)
        rest = np.flatnonzero(odd)
        if len(rest):
            plain = np.flatnonzero(~odd)
            cut = [self.whole(t) for t in text.take(pa.array(rest)).to_pylist()]
            slow = pc.dictionary_encode(pa.array([p for ps in cut for p in ps], pa.string()))
            names, codes, count = self._plain(text.take(pa.array(plain)))
        else:
            names, codes, count = self._plain(text)
        pieces, sizes, order = self.cut(names)
        if len(rest):  # pieces of odd texts are chunks of one piece
            counts, own = np.zeros(len(text), np.int64), np.array([len(ps) for ps in cut], np.int64)
            counts[plain], counts[rest] = count, own
            out, to = np.zeros(len(codes) + len(slow), np.int64), offsets_of(counts)[:-1]
            out[spans_index(to[plain], count)] = codes
            out[spans_index(to[rest], own)] = len(names) + slow.indices.to_numpy()
            order = np.concatenate((order, len(names) + np.arange(len(slow.dictionary))))
            pieces, sizes = pa.concat_arrays([pieces, slow.dictionary]), np.concatenate((sizes, np.ones(len(slow.dictionary), np.int64)))
            codes, count = out, counts
        coded = pc.dictionary_encode(pieces)
        numbers = self._numbers(coded.dictionary)[coded.indices.to_numpy()]
        begin, many = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        begin[order], many[order] = offsets_of(sizes)[:-1], sizes
        return codes, count, begin, many, numbers

    def lengths_of(self, text: pa.StringArray) -> np.ndarray:
        """Numbers of ids of the texts."""
        codes, count, begin, many, numbers = self.chunks(text)
        total = offsets_of(self.lengths[numbers])
        return np.diff(offsets_of((total[begin + many] - total[begin])[codes])[offsets_of(count)])

    def __call__(self, text: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end (uint32), and n + 1 offsets of the texts."""
        codes, count, begin, many, numbers = self.chunks(text)
        sizes = self.lengths[numbers]
        ids, total = self.flat[spans_index(self.starts[numbers], sizes)], offsets_of(sizes)
        first = total[begin]
        size = total[begin + many] - first
        own = size[codes]
        return ids[spans_index(first[codes], own)], offsets_of(own)[offsets_of(count)]


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself,
    the other bytes take the code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def library_encoder(path: str, words: bool) -> ChunkEncoder:
    """By the ``tokenizers`` library; special tokens' strings in a text are ordinary text.

    Pieces go straight to the library's merge model, which is what the whole pipeline does to them after
    its pre-tokeniser; pieces that a normaliser could change go through the whole pipeline.
    """
    import regex
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    merge, alphabet = tokenizer.model.tokenize, byte_alphabet()

    if words:
        cut = regex.compile(WORD_PIECES).findall
        classes = class_table()
        lower = lower_table(classes)
        known = {chr(c) for c in range(COVERED) if classes[c] in (LETTER, NUMBER, MARK) and lower[c] == c and chr(c).lower() == chr(c)} | {"'"}

        def pieces_of(chunk: str) -> list[str]:
            """The pattern's pieces of a chunk that the normaliser leaves as it is, else the chunk."""
            return cut(chunk) if known.issuperset(chunk) else [chunk]

        def encode(pieces: list[str]) -> tuple[list[int], list[int]]:
            whole = [p for p in pieces if not known.issuperset(p)]
            slow = dict(zip(whole, tokenizer.encode_batch_fast(whole, add_special_tokens=False), strict=True)) if whole else {}
            ids, sizes = [], []
            for p in pieces:
                if p in slow:
                    own = slow[p].ids
                else:
                    own = [t.id for t in merge(p if p.isascii() else "".join([alphabet[b] for b in p.encode()]))]
                ids += own
                sizes.append(len(own))
            return ids, sizes

        # a slow text is one chunk, which only the library's own pre-tokeniser cuts
        return ChunkEncoder(encode, pieces_of, True, lambda t: [t] if t else [])
    find, blank = piece_pattern().findall, alphabet[32]

    def encode_bytes(pieces: list[str]) -> tuple[list[int], list[int]]:
        ids, sizes = [], []
        for p in pieces:
            plain = p.isascii() and p.isprintable()
            own = [t.id for t in merge(p.replace(" ", blank) if plain else "".join([alphabet[b] for b in p.encode()]))]
            ids += own
            sizes.append(len(own))
        return ids, sizes

    return ChunkEncoder(encode_bytes, find, False, find)


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, words: bool = False, make: Callable[[str, bool], ChunkEncoder] = library_encoder) -> ChunkEncoder:
    """The worker process's encoder of this vocabulary; one of another vocabulary is dropped."""
    key = (path, words, make.__name__)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = make(path, words)
    if _ENCODERS.clear not in held:
        held.append(_ENCODERS.clear)
    return _ENCODERS[key]


def crc_rows(ids: np.ndarray, off: np.ndarray) -> list[int]:
    """Unsigned CRC-32 of each row's ids as little-endian unsigned 32-bit integers."""
    import zlib

    view = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    return [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


__all__ = ["ChunkEncoder", "crc_rows", "encoder", "library_encoder", "piece_pattern", "vocabulary"]

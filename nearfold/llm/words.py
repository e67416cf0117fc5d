"""Word hashes of whole texts: words are cut by Arrow, each distinct word of a slice is hashed once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_GOLDEN, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(31))
    h *= _MIX
    h ^= h >> np.uint64(29)
    h *= _GOLDEN
    h ^= h >> np.uint64(32)
    return h


def word_hashes(text: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts and n + 1 offsets. A-Z count as a-z; words lie between bytes 32
    and 9 to 13."""
    codes, names, off = _coded(text)
    return _hashes(names)[codes] if len(codes) else np.zeros(0, np.uint64), off


def cleaned_words(text: pa.StringArray, clean: Callable[[str], str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``word_hashes``, of words that ``clean`` rewrites. Words that it empties are left out; the third array
    has each other word's number in its text, all words counted."""
    codes, names, off = _coded(text)
    names = [clean(w) for w in names]
    number = np.arange(len(codes)) - np.repeat(off[:-1], np.diff(off))
    kept = np.fromiter(map(bool, names), bool, len(names))[codes] if len(codes) else np.zeros(0, bool)
    return _hashes(names)[codes[kept]], np.concatenate(([0], np.cumsum(kept)))[off], number[kept]


def _coded(text: pa.StringArray) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Numbers of all words in order, the distinct words by number, and n + 1 offsets."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text))
    off = lists.offsets.to_numpy().astype(np.int64)
    coded = pc.dictionary_encode(lists.values.slice(off[0], off[-1] - off[0]))
    codes, names, off = coded.indices.to_numpy(), coded.dictionary.to_pylist(), off - off[0]
    if "" in names:  # the cutter leaves one at white space on a text's edge
        kept = codes != names.index("")
        codes, off = codes[kept], np.concatenate(([0], np.cumsum(kept)))[off]
    return codes, names, off


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside a text, and n + 1 offsets. A text with fewer words, but
    some, gives its whole sequence as one; a text without words gives none. Repeats stay."""
    sizes = np.diff(off)
    count = np.where(sizes >= width, sizes - width + 1, np.minimum(sizes, 1))
    out_off = np.concatenate(([0], np.cumsum(count)))
    start = np.repeat(off[:-1] - out_off[:-1], count) + np.arange(int(out_off[-1]))
    padded = np.concatenate((words, np.zeros(width, np.uint64)))
    h = np.zeros(len(start), np.uint64)
    short = np.repeat(sizes < width, count)
    room = np.repeat(off[1:], count)[short] - start[short]
    for k in range(width):
        w = padded[start + k]
        if short.any():
            w[short] = np.where(room > k, w[short], np.uint64(0))
        h = mix(h * _GOLDEN + w + np.uint64(k + 1)) if k in (1, width - 1) else h * _GOLDEN + w + np.uint64(k + 1)
    if short.any():
        h[short] ^= mix(np.repeat(sizes, count)[short].astype(np.uint64) + np.uint64(77))
    return h, out_off

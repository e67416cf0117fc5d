"""Language ID: nearest centroid over normalised TF-IDF vectors of hashed character n-grams.

Every language has several centroids, found by spherical clustering of a bounded sample of its labelled
documents. A text takes the language of the centroid with the largest cosine; it is rejected when its
distance to that centroid is far beyond the distances of the centroid's own members.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from nearfold.llm.arrowtext import raw_utf8, text_slices
from nearfold.llm.common import as_docs

#: Hashed n-gram dimensions, and centroids of a language.
DIMS, CENTROIDS, ITERATIONS = 4096, 4, 10
#: Bound of the training sample: distinct texts of one language, the first by their hash.
SAMPLE_PER_LANGUAGE = 500
#: Texts that pass the bound on hashes, as a multiple of the sample: far above its chance and the count's error.
OVERSAMPLE = 2
#: A text is rejected if its best cosine is below this part of the least one of that centroid's members. A
#: text with few n-grams is far from every centroid by nature, about as the root of their number, so cosines
#: are compared after division by that root (relative to the members' median number).
REJECT_PART = 0.5
UNKNOWN = "und"
_DOCS_AT_ONCE = 512


def _fold_table() -> np.ndarray:
    """Letters in lower case, bytes above 127 as they are, everything else a space."""
    table = np.full(256, 32, np.uint8)
    table[128:] = np.arange(128, 256)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    return table


_FOLD = _fold_table()


def ngram_counts(text: pa.StringArray) -> np.ndarray:
    """Counts of hashed byte bigrams and trigrams of whole texts (rows x DIMS); runs of other characters are one space."""
    body, off = raw_utf8(text)
    n = len(text)
    if not len(body):
        return np.zeros((n, DIMS), np.float32)
    plain = _FOLD[body]
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(off))
    blank = plain == 32
    first = np.concatenate(([True], row[1:] != row[:-1]))
    keep = ~(blank & (first | np.concatenate(([True], blank[:-1]))))
    plain, row = plain[keep].astype(np.uint32), row[keep]
    out = np.zeros(n * DIMS, np.int64)
    for size, factor in ((2, 0x9E3779B1), (3, 0x85EBCA77)):
        if len(plain) < size:
            continue
        gram = plain[: len(plain) - size + 1].copy()
        for k in range(1, size):
            gram = gram << np.uint32(8) | plain[k : len(plain) - size + 1 + k]
        inside = row[: len(gram)] == row[size - 1 :]
        slot = (gram * np.uint32(factor)) >> np.uint32(20)
        out += np.bincount((row[: len(gram)].astype(np.int64) * DIMS + slot)[inside], minlength=n * DIMS)
    return out.reshape(n, DIMS).astype(np.float32)


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors with logarithmic term frequency; texts without n-grams stay zero."""
    v = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0).astype(np.float32) * idf
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


@dataclass(frozen=True)
class CentroidModel:
    """Centroids (rows, unit length), the language of each, the least adjusted cosine it accepts, its members'
    median number of distinct n-grams, and the IDF weights."""

    languages: tuple[str, ...]
    centroids: np.ndarray
    floors: np.ndarray
    typical: np.ndarray
    idf: np.ndarray

    def rejects(self, best: np.ndarray, cosine: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Whether texts with these best centroids, cosines and numbers of n-grams are too far away."""
        return cosine < self.floors[best] * richness(grams, self.typical[best])


def richness(grams: np.ndarray, typical: np.ndarray) -> np.ndarray:
    """Expected size of a cosine, by the number of distinct n-grams."""
    return np.sqrt(np.minimum(1, grams / np.maximum(typical, 1)))


def cluster(vectors: np.ndarray, k: int, iterations: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spherical k-means from spread-out seeds; returns unit centroids, and each one's least adjusted member
    cosine and median number of n-grams."""
    chosen = [int(np.argmax(vectors @ vectors.mean(axis=0)))]
    near = vectors @ vectors[chosen[0]]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, vectors @ vectors[chosen[-1]])
    centres = vectors[chosen].copy()
    for _ in range(iterations):
        own = np.argmax(vectors @ centres.T, axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                mean = vectors[own == c].mean(axis=0)
                centres[c] = mean / max(float(np.linalg.norm(mean)), 1e-9)
    cosine = vectors @ centres.T
    own = np.argmax(cosine, axis=1)
    used = [c for c in range(len(centres)) if (own == c).any()]
    grams = (vectors > 0).sum(axis=1)
    typical = np.array([np.median(grams[own == c]) for c in used])
    least = [(cosine[own == c, c] / richness(grams[own == c], t)).min() for c, t in zip(used, typical, strict=True)]
    return centres[used], np.array(least), typical


def fit(docs: DataFrame, labelled: Column, label_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, k: int = CENTROIDS) -> CentroidModel:
    """Train on at most ``per_language`` distinct texts of each label for which ``labelled`` holds; copies count once.

    Only the bounded sample's vectors come to the driver, as sparse counts. Rows without label or text are
    left out; without any labelled row, or where no text has an n-gram, the model has no centroids.
    """
    rows = docs.where(labelled & F.col(label_col).isNotNull() & F.col("text").isNotNull())
    rows = rows.select("text", F.col(label_col).alias("lang"), F.xxhash64("text").alias("h"))
    # hashes are uniform, so the first ones of a label lie below a bound that follows from its number of distinct texts
    known = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("distinct"))
    low = float(-(1 << 63))
    near = (F.col("h").cast("double") - F.lit(low)) * F.col("distinct") < F.lit(OVERSAMPLE * per_language * 2.0**64)
    # labels are few: the driver holds several centroids of each
    some = rows.join(F.broadcast(known), "lang").where(near).dropDuplicates(["lang", "h"])
    order = W.partitionBy("lang").orderBy("h")  # about OVERSAMPLE * per_language rows of a label, whatever the corpus
    sample = some.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language).select("text", "lang")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, text in text_slices(batches):
            for a in range(0, len(text), _DOCS_AT_ONCE):
                counts = ngram_counts(text.slice(a, _DOCS_AT_ONCE))
                used = [np.flatnonzero(c) for c in counts]
                cols = [[u.astype("<u2").tobytes() for u in used], [c[u].astype("<u4").tobytes() for c, u in zip(counts, used, strict=True)]]
                yield pa.RecordBatch.from_arrays([part.column("lang").slice(a, _DOCS_AT_ONCE), *[pa.array(c, pa.binary()) for c in cols]], ["lang", "slots", "counts"])

    table = sample.mapInArrow(vectors, "lang string, slots binary, counts binary").toArrow()
    pairs = sorted(zip(*(table.column(c).to_pylist() for c in ("lang", "slots", "counts")), strict=True))
    if not pairs:
        return CentroidModel((), np.zeros((0, DIMS), np.float32), np.zeros(0), np.zeros(0), np.ones(DIMS, np.float32))
    seen = np.bincount(np.concatenate([np.frombuffer(slots, "<u2") for _, slots, _ in pairs]), minlength=DIMS)
    idf = (np.log((1 + len(pairs)) / (1 + seen)) + 1).astype(np.float32)
    names, centres, floors, typical = [], [], [], []
    for lang, group in groupby(pairs, key=lambda p: p[0]):  # one label's dense vectors at a time
        own = [(np.frombuffer(slots, "<u2"), np.frombuffer(counts, "<u4")) for _, slots, counts in group]
        dense = np.zeros((len(own), DIMS), np.float32)
        for row, (slots, counts) in zip(dense, own, strict=True):
            row[slots] = counts
        own = weigh(dense, idf)
        own = own[own.any(axis=1)]
        if len(own):
            c, least, size = cluster(own, k, ITERATIONS)
            names += [str(lang)] * len(c)
            centres.append(c)
            floors.append(least * REJECT_PART)
            typical.append(size)
    if not names:
        return CentroidModel((), np.zeros((0, DIMS), np.float32), np.zeros(0), np.zeros(0), idf)
    return CentroidModel(tuple(names), np.concatenate(centres), np.concatenate(floors), np.concatenate(typical), idf)


def identify(docs: DataFrame, model: CentroidModel, more: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` of whole texts, and the columns in ``more``; only the text is an input.

    Null texts and texts without a letter are ``und`` with score 0 and rejected. ``score`` is the cosine
    to the best centroid (ties: the first language in order). Repeated rows stay.
    """

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, text in text_slices(batches):
            letters = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
            for a in range(0, len(text), _DOCS_AT_ONCE):
                own = text.slice(a, _DOCS_AT_ONCE)
                known = letters[a : a + _DOCS_AT_ONCE]
                if model.languages:
                    counts = ngram_counts(own)
                    cosine = weigh(counts, model.idf) @ model.centroids.T
                    best = np.argmax(cosine, axis=1)
                    score = np.clip(cosine[np.arange(len(own)), best].astype(np.float64), 0, 1)
                    rejected = ~known | model.rejects(best, score, (counts > 0).sum(axis=1))
                    names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), known.tolist(), strict=True)]
                else:
                    score, rejected, names = np.zeros(len(own)), np.ones(len(own), bool), [UNKNOWN] * len(own)
                carried = [part.column(c).slice(a, _DOCS_AT_ONCE) for c in ("doc_id", *more)]
                yield pa.RecordBatch.from_arrays([*carried, pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(rejected)], ["doc_id", *more, "lang_pred", "score", "rejected"])

    extra = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in more)
    return docs.select("doc_id", *more, *(() if "text" in more else ("text",))).mapInArrow(predict, f"doc_id long{extra}, lang_pred string, score double, rejected boolean")


def training_rows(id_col: str = "doc_id") -> Column:
    """Four fifths of the documents: the CRC-32 of the id as text, modulo 5, is not 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0


def identify_languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """Fit on the training fifths and predict every row: ``doc_id, held_out, lang_pred, score, rejected``.
    A null id counts as held out. An empty table gives no rows."""
    docs = as_docs(df, id_col, text_col, label_col)
    model = fit(docs, training_rows(), label_col)
    return identify(docs, model).select("doc_id", F.coalesce(~training_rows(), F.lit(True)).alias("held_out"), "lang_pred", "score", "rejected")

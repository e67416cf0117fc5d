"""MinHash near-dedup with sequential Bayesian verification.

1. Documents with the same shingle set are one class, whose smallest id stands for it.
2. Banding of the MinHash signatures gives buckets. First, each class meets the least class it shares a
   bucket with; then, inside buckets that still hold several components, the pairs that join different
   components.
3. A candidate pair's signatures are compared batch by batch. It is dropped as soon as the posterior
   probability that its similarity reaches the threshold falls below the miss probability.
4. Survivors are verified on their full shingle sets; components of the verified links are the answer.
   Pairs inside one component add nothing to the answer and are not verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.llm.arrowtext import text_slices
from nearfold.llm.common import as_docs, discard, rows_a_batch, saved, shuffle_parts
from nearfold.llm.components import connected_components
from nearfold.llm.words import mix, shingle_hashes, word_hashes

WIDTH = 5
#: A link needs at least this similarity, in hundredths.
PERCENT = 75
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Hashes of one comparison batch, and the chosen probability of missing a true pair at a batch's end.
BATCH, MISS = 32, 1e-7
#: Members of a bucket that one task compares; larger buckets are cut into pairs of such blocks, but for pairs of
#: blocks of the bucket's largest component.
BLOCK = 512
#: Rows with whole texts or shingle sets that go to a Python worker at once.
WIDE_ROWS = 2000
_FACTORS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def shingle_sets(text: pa.StringArray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and n + 1 offsets."""
    h, off = shingle_hashes(*word_hashes(text), width)
    sets = [np.unique(h[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    return (np.concatenate(sets) if sets else h), np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)


def minhash(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Signatures (texts x HASHES, uint32) of non-empty sets."""
    out = np.zeros((len(off) - 1, HASHES), np.uint32)
    at = 0
    while at < len(off) - 1:  # blocks that stay in the processor's cache
        stop = max(at + 1, int(np.searchsorted(off, off[at] + 16_384, side="right")) - 1)
        block, starts = sets[off[at] : off[stop]], off[at:stop] - off[at]
        for k in range(HASHES):
            out[at:stop, k] = np.minimum.reduceat((block * _FACTORS[k] >> np.uint64(32)).astype(np.uint32), starts)
        at = stop
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band (texts x BANDS)."""
    rows = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    h = np.zeros(rows.shape[:2], np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k] + np.uint64(1))
    return h.view(np.int64)


@lru_cache
def least_matches(n: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """Fewest matches of n hashes at which P(similarity >= threshold | matches) is still ``miss`` or more.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose tail is a binomial sum.
    """
    t = percent / 100
    tail = 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n


def survives(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two signature tables are not pruned: batch after batch, on those that are left."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for done in range(BATCH, HASHES + 1, BATCH):
        matches[alive] += (a[alive, done - BATCH : done] == b[alive, done - BATCH : done]).sum(axis=1)
        alive = alive[matches[alive] >= least_matches(done)]
    return alive


def _signature_table(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, text in text_slices(batches):
            sets, off = shingle_sets(text)
            sizes = np.diff(off)
            full = np.flatnonzero(sizes)
            sig = minhash(sets, np.append(off[:-1][full], off[-1]))
            keys = band_keys(sig)
            none: list = [None] * len(sizes)
            digest, blob, bands = none.copy(), none.copy(), none.copy()
            for k, i in enumerate(full.tolist()):
                digest[i] = xxhash.xxh3_128_digest(sets[off[i] : off[i + 1]].tobytes())
                blob[i], bands[i] = sig[k].tobytes(), keys[k]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(digest, pa.binary()), pa.array(sizes), pa.array(blob, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "digest", "n_shingles", "sig", "bands"])

    return docs.mapInArrow(run, "doc_id long, digest binary, n_shingles long, sig binary, bands array<long>")


def _unpack(column: pa.Array, kind) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures survive and that reach the threshold on their full shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig_a, sig_b = (np.stack(_unpack(batch.column(c), np.uint32)) for c in ("sig_a", "sig_b"))
            set_a, set_b = (_unpack(batch.column(c), np.uint64) for c in ("shingles_a", "shingles_b"))
            good = [i for i in survives(sig_a, sig_b).tolist() if _linked(set_a[i], set_b[i])]
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    own = lambda c: sets.select(F.col("doc_id").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("shingles").alias(f"shingles_{c}"))
    joined = pairs.join(own("b"), "b").join(own("a"), "a")
    return joined.select("a", "b", "sig_a", "sig_b", "shingles_a", "shingles_b").mapInArrow(run, "a long, b long")


def _short(shingles: np.ndarray) -> np.ndarray:
    """The set's hashes cut to 32 bits, sorted."""
    return np.sort((shingles >> np.uint64(32)).astype(np.uint32))


def _cross_pairs(members: DataFrame, forest: bool) -> DataFrame:
    """Pairs of different components inside each bucket block that survive and agree on their cut sets.

    ``members(key, at, side, other, doc_id, label, sig, cut)`` is sorted by key; a block's key is a pair of
    sides, and pairs are taken between the sides, or inside one where both are the same. A pair counts
    in its first common band only. With ``forest``, pairs that the pairs before them connect already are
    left out, so a block of n members gives fewer than n pairs.
    """

    def block_pairs(at: int, cross: bool, doc: np.ndarray, label: np.ndarray, side: np.ndarray, sig: np.ndarray, cut: list[np.ndarray]) -> list[tuple[int, int]]:
        out, part = [], label.copy()
        bands = sig.reshape(len(sig), BANDS, ROWS)
        for i in range(len(doc) - 1):
            later = np.arange(i + 1, len(doc))
            later = later[part[later] != part[i]]
            if cross:
                later = later[side[later] != side[i]]
            if not len(later):
                continue
            later = later[survives(np.broadcast_to(sig[i], (len(later), HASHES)), sig[later])]
            later = later[(bands[later] == bands[i]).all(axis=2).argmax(axis=1) == at]
            for j in later[np.argsort(-(sig[later] == sig[i]).sum(axis=1), kind="stable")].tolist():
                if part[j] != part[i] and _linked(cut[i], cut[j]):
                    out.append((min(int(doc[i]), int(doc[j])), max(int(doc[i]), int(doc[j]))))
                    if forest:
                        part[part == part[j]] = part[i]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def emit(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            one = pa.Table.from_batches(parts)
            num = lambda c: one.column(c).to_numpy()
            keys, at, doc, label, side, other = map(num, ("key", "at", "doc_id", "label", "side", "other"))
            edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))).tolist()
            pairs: list[tuple[int, int]] = []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if (label[a:b] != label[a]).any():
                    sig = np.stack(_unpack(one.column("sig").slice(a, b - a), np.uint32))
                    pairs += block_pairs(int(at[a]), bool((side[a:b] != other[a:b]).any()), doc[a:b], label[a:b], side[a:b], sig, _unpack(one.column("cut").slice(a, b - a), np.uint32))
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy()
            before = np.flatnonzero(keys != keys[-1])
            last = int(before[-1]) + 1 if len(before) else 0  # the rows of the last key may go on
            if last or (held and held[-1].column("key")[-1].as_py() != keys[0]):
                yield emit([*held, batch.slice(0, last)] if last else held)
                held = []
            held.append(batch.slice(last))
        if held:
            yield emit(held)

    return members.mapInArrow(run, "a long, b long")


def near_links(sigs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``node, label``: components of the classes' verified links. ``sigs`` is the signature table,
    ``classes(digest, rep)`` has the document that stands for each set, ``docs`` the texts."""
    spark = docs.sparkSession
    reps = sigs.join(classes.withColumnRenamed("rep", "doc_id"), ["digest", "doc_id"], "left_semi")
    banded = reps.select("doc_id", F.posexplode("bands").alias("at", "band"))
    # tables of buckets are saved before they are joined, so that Spark can split the members of a hot one
    buckets = saved(banded.groupBy("band").agg(F.min("doc_id").alias("leader"), F.count(F.lit(1)).alias("size")).where(F.col("size") > 1), "buckets")
    members = saved(banded.join(buckets, "band"), "bucket-members")
    discard(buckets)
    candidates = members.select("doc_id").distinct()

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, text in text_slices(batches):
            sets, off = shingle_sets(text)
            edges = list(zip(off[:-1].tolist(), off[1:].tolist(), strict=True))
            if len(edges) and (np.diff(off) == 0).any():  # a repeated id with a wordless text
                kept = np.flatnonzero(np.diff(off))
                rows, edges = rows.take(pa.array(kept)), [edges[i] for i in kept.tolist()]
            sig = minhash(sets, np.array([a for a, _ in edges] + [len(sets)], np.int64))
            cols = [[s.tobytes() for s in sig], [sets[a:b].tobytes() for a, b in edges], [_short(sets[a:b]).tobytes() for a, b in edges]]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *[pa.array(c, pa.binary()) for c in cols]], ["doc_id", "sig", "shingles", "cut"])

    # the texts meet their candidate ids by a merge join at every size
    sets = docs.join(candidates.hint("merge"), "doc_id", "left_semi").mapInArrow(sets_of, "doc_id long, sig binary, shingles binary, cut binary")
    sets = saved(sets, "candidate-sets")
    # first round: each class and the least leader of its buckets
    star = members.where(F.col("doc_id") != F.col("leader")).groupBy(F.col("doc_id").alias("b")).agg(F.min("leader").alias("a"))
    links = saved(_verify(star.select("a", "b"), sets), "star-links")
    labels = connected_components(links)
    # second round: buckets that hold several components
    labelled = members.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("band", "at", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    parts = labelled.groupBy("band", "label").agg(F.count(F.lit(1)).alias("c"))
    mixed = parts.groupBy("band").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("labels")).where(F.col("labels") > 1)
    mixed = saved(mixed, "mixed-buckets")
    # a large bucket is cut into blocks of its largest component, which never meet each other, and of the rest
    many, rest = F.ceil(F.col("top.c") / BLOCK).cast("int"), F.ceil((F.col("n") - F.col("top.c")) / BLOCK).cast("int")
    main, small = F.col("label") == F.col("top.label"), F.col("n") <= BLOCK
    h = F.xxhash64("doc_id")
    own = F.when(small, 0).when(main, F.pmod(h, many)).otherwise(many + F.pmod(h, rest)).cast("int")
    others = F.when(small, F.sequence(F.lit(0), F.lit(0))).otherwise(F.sequence(F.when(main, many).otherwise(0), many + rest - 1))
    rows = labelled.join(mixed, "band").withColumn("side", own).withColumn("other", F.explode(others))
    rows = rows.withColumn("key", F.when(small, F.col("band")).otherwise(F.xxhash64("band", F.least("side", "other"), F.greatest("side", "other"))))
    rows = rows.join(sets.select("doc_id", "sig", "cut"), "doc_id").select("key", "at", "side", "other", "doc_id", "label", "sig", "cut")
    rows = rows.repartition(shuffle_parts(spark), "key").sortWithinPartitions("key", "doc_id")
    cross = saved(_cross_pairs(rows, True), "cross-pairs")
    if cross.count():
        more = saved(_verify(cross.distinct(), sets), "cross-links")
        if more.count() < cross.distinct().count():  # a cut set misled the forest: take every pair
            discard(more)
            more = saved(_verify(_cross_pairs(rows, False).distinct(), sets), "cross-links")
        labels = connected_components(links.unionByName(more))
        discard(more)
    discard(members, mixed, sets, links, cross)
    return labels


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Words are runs of bytes other than 32 and 9 to 13, with A-Z as a-z; a set holds the distinct runs of
    five words, or the whole sequence of a shorter text. Sets are linked when 100 * intersection >= 75 *
    union. Null, empty and wordless texts have 0 shingles and no links: their component is their own id.
    Rows that repeat an id share its component. An empty table gives no rows.
    """
    docs = as_docs(df, id_col, text_col)
    with rows_a_batch(docs.sparkSession, WIDE_ROWS):
        sigs = saved(_signature_table(docs), "signatures")
        classes = saved(sigs.where(F.col("n_shingles") > 0).groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
        labels = near_links(sigs, classes, docs)
    # a table of its own, so that Spark can split the rows of a hot digest below
    classes = saved(classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("label", "rep").alias("label")), "class-labels")
    out = sigs.select("doc_id", "digest", "n_shingles").join(classes, "digest", "left")
    component = F.coalesce("label", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))

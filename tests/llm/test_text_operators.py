"""Each operator against brute force, the public libraries or a round trip, on small texts with edge cases."""

from __future__ import annotations

import collections
import glob
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearfold.llm import exact_dedup, language_id, licenses, media, near_dedup, packing, rank_bpe, suffix_dedup, token_counts, token_files, tokens
from nearfold.llm.tokens import encoder, library_encoder, vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, part int, sig string"
OPERATORS = {
    "lengths": lambda d: token_counts.length_histogram(token_counts.token_lengths(d)),
    "media": lambda d: media.media_features(media.encode_media(d)),
    "language": language_id.identify_languages,
    "licenses": licenses.scan_licenses,
    "files": token_files.token_files,
    "packing": packing.pack_documents,
    "suffix": suffix_dedup.remove_repeats,
    "exact": exact_dedup.exact_duplicates,
    "bpe": rank_bpe.encoding_digests,
    "near": near_dedup.near_duplicates,
}


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdeinorst"), rng.integers(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(11)
    out = [words(rng, int(n)) for n in rng.integers(1, 120, 40)]
    passage = words(rng, 60)
    out += [words(rng, 20) + " " + passage + " " + words(rng, 20) for _ in range(5)]
    near = passage.split()
    out += [" ".join(near[:i] + ["changed"] + near[i + 1 :]) for i in (1, 20, 58)] + [out[3], out[3], passage.upper()]
    out += [None, "", " ", "\n\n", "a", "é" * 60, "x" * 300, "the. " * 80, "Ünï\tcode　text  two", "Released under the MIT License.\n" + words(rng, 9), "<|endoftext|>", "1 2 3 !!", words(rng, 6000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3, t, [None, "en", "de"][i % 3], "s", len(t or ""), 1, 2, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).persist()


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_edges(spark, docs, name):
    """Empty tables, all-null texts, repeated rows and null ids run and keep one row per document."""
    f = OPERATORS[name]
    assert f(docs.where("doc_id < 0")).count() == 0
    nulls = docs.withColumn("text", F.lit(None).cast("string"))
    n = f(nulls).count()
    assert n == (1 if name == "lengths" else 0 if name == "licenses" else docs.count())
    twice = docs.limit(8).unionByName(docs.limit(8)).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    if name not in ("lengths", "licenses", "packing"):
        assert f(twice).count() == 17


def collected(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_token_counts(spark, docs, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    sizes = [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]
    hist = token_counts.length_histogram(token_counts.token_lengths(docs))
    rows = collected(hist, "n_tokens")
    assert {k: r["n_docs"] for k, r in rows.items()} == collections.Counter(sizes)
    for k, r in rows.items():
        assert r["kept_tokens"] == sum(min(k, s) for s in sizes) and r["docs_longer"] == sum(s > k for s in sizes)
    assert token_counts.truncated_total(hist, 50).first()["kept_tokens"] == sum(min(50, s) for s in sizes)
    q = collected(token_counts.length_quantiles(hist, (0.1, 0.5, 1.0)), "q")
    assert [q[x]["n_tokens"] for x in (0.1, 0.5, 1.0)] == [sorted(sizes)[int(np.ceil(x * len(sizes))) - 1] for x in (0.1, 0.5, 1.0)]


def test_media(spark, docs, texts):
    got = collected(media.media_features(media.encode_media(docs)))
    for i, t in enumerate(texts):
        body = (t or "").encode()
        payload = body.ljust(max(1, -(-len(body) // 192)) * 192, b" ")
        r = got[i * 3]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def test_media_query_reads_stored_bytes(spark, tmp_path):
    """The query's media column lies in the shared folder, with the features of what is stored."""
    from nearfold.llm.queries import QUERIES

    spark.range(20).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    where = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    old = set(glob.glob(f"{where}/nearfold/media-*"))
    got = sorted(QUERIES["op2_jpeg_media"](spark, str(tmp_path)).collect())
    (new,) = set(glob.glob(f"{where}/nearfold/media-*")) - old
    assert len(got) == 20 and got == sorted(media.media_features(spark.read.parquet(new)).collect())


def test_media_opens_in_another_decoder(spark):
    """Java's image reader gives the payload as the grey level of each block; several frames follow each other."""
    payloads = [("äöü " * 700).encode(), b"x", bytes(range(256)) * 30]
    java = spark._jvm
    for body in payloads:
        rows = -(-len(body) // media.UNIT)
        payload = np.frombuffer(body.ljust(rows * media.UNIT, b" "), np.uint8)
        (data,) = media.encode_payloads(payload, np.array([rows]))
        image = java.javax.imageio.ImageIO.read(java.java.io.ByteArrayInputStream(bytearray(data)))
        assert (image.getWidth(), image.getHeight()) == (8 * media.UNIT, 8 * rows)
        raster = image.getRaster()
        for k in np.random.default_rng(0).integers(0, len(payload), 40).tolist():
            x, y = 8 * (k % media.UNIT) + k % 8, 8 * (k // media.UNIT) + 7 - k % 8
            assert raster.getSample(x, y, 0) == payload[k]


def test_media_of_several_frames(spark, monkeypatch):
    """Payloads beyond one frame are cut into frames and read back as one; all columns follow from the stored bytes."""
    monkeypatch.setattr(media, "FRAME_ROWS", 3)
    rng = np.random.default_rng(3)
    rows = np.array([1, 3, 4, 11])
    payload = rng.integers(0, 256, int(rows.sum()) * media.UNIT).astype(np.uint8)
    at = 0
    for data, n in zip(media.encode_payloads(payload, rows), rows.tolist(), strict=True):
        frames = media.parse_frames(data)
        assert [f.height // 8 for f in frames] == [3] * (n // 3) + [n % 3] * bool(n % 3)
        image = np.concatenate(media.decode_thumbnails(np.frombuffer(data, np.uint8), frames))
        assert (image.ravel() == payload[at : at + n * media.UNIT]).all()
        at += n * media.UNIT


def test_media_of_a_long_text(spark):
    """A text over several frames and slices keeps its digests; stored size, digest and dimensions are those of the media column."""
    body = "Wörter und mehr. " * 200_000
    stored = media.encode_media(spark.createDataFrame([(1, body), (2, "short")], "doc_id long, text string")).collect()
    got = collected(media.media_features(spark.createDataFrame(stored)))
    for r in stored:
        text = body if r["doc_id"] == 1 else "short"
        raw = text.encode()
        payload = raw.ljust(-(-len(raw) // 192) * 192, b" ")
        g, lines = got[r["doc_id"]], len(payload) // 192
        assert (g["payload_sha256"], g["media_bytes"], g["media_sha256"]) == (hashlib.sha256(payload).hexdigest(), len(r["media"]), hashlib.sha256(r["media"]).hexdigest())
        image = np.frombuffer(payload, np.uint8).reshape(lines, 192).astype(int)
        edge_r, edge_c = np.linspace(0, lines, 9).astype(int), np.linspace(0, 192, 10).astype(int)
        bits = np.zeros((8, 8), bool)
        cells = [[image[a:b, c:d].sum() for c, d in zip(edge_c[:-1], edge_c[1:])] for a, b in zip(edge_r[:-1], edge_r[1:]) if b > a]  # noqa: B905
        bits[: len(cells)] = [[x < y for x, y in zip(row, row[1:])] for row in cells]  # noqa: B905
        assert g["feature"].split(":")[0] == f"1536x{8 * lines}"
        if lines >= 8:
            assert g["feature"].split(":")[1] == np.packbits(bits).tobytes().hex()
    assert stored[0]["media"].count(b"\xff\xd8") >= 3 or len(body.encode()) < 3 * media.FRAME_ROWS * 192


def test_general_jpeg():
    """A two-component image with AC terms, subsampling and one interval, written by hand."""
    rng = np.random.default_rng(2)
    blocks = rng.integers(-30, 30, 4 * 4 + 4)  # 2 x 2 units of 4 luma blocks and 1 chroma block
    dc, ac = media._codes(media.DC_BITS, media.DC_VALUES), media._codes((0, 2, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0), (0x00, 0x01, 0xF0, 0x32))
    bits = ""
    put = lambda code, n: format(code, f"0{n}b") if n else ""
    before = {0: 0, 1: 0}
    at = 0
    for _ in range(4):
        for c in (0, 0, 0, 0, 1):
            d = int(blocks[at]) - before[c]
            before[c] = int(blocks[at])
            s = abs(d).bit_length()
            bits += put(*dc[s]) + put(d if d > 0 else d + (1 << s) - 1, s)
            bits += put(*ac[0x01]) + "1" + put(*ac[0xF0]) + put(*ac[0x32]) + "10" + put(*ac[0x00])
            at += 1
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    seg = media._segment
    data = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, bytes((0, *[16] * 64))) + seg(0xC0, b"\x08\x00\x20\x00\x20\x02" + bytes((1, 0x22, 0, 2, 0x11, 0)))
    data += seg(0xC4, bytes((0x00, *media.DC_BITS, *media.DC_VALUES))) + seg(0xC4, bytes((0x10, 0, 2, 2, *[0] * 13, 0x00, 0x01, 0xF0, 0x32)))
    data += seg(0xDA, bytes((2, 1, 0, 2, 0, 0, 63, 0))) + scan + b"\xff\xd9"
    frame = media.parse_frames(data)
    assert (frame[0].width, frame[0].height) == (32, 32)
    thumb = media.decode_thumbnails(np.frombuffer(data, np.uint8), frame)[0]
    want = np.zeros((4, 4), int)
    for u in range(4):
        for k in range(4):
            want[u // 2 * 2 + k // 2, u % 2 * 2 + k % 2] = blocks[u * 5 + k] * 2 + 128
    assert (thumb == want).all()
    for broken in (data[:-2], data[2:], data.replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises(ValueError):
            media.parse_frames(broken)


def test_language(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify_languages(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    model = language_id.fit(d.select("doc_id", "text", "lang"), language_id.training_rows())
    odd = spark.createDataFrame([(1, "Привет как дела это русский текст и он не из наших языков"), (2, "12 34"), (3, None), (4, "The is of and to in that was.")], "doc_id long, text string")
    got = collected(language_id.identify(odd, model))
    assert got[1]["rejected"] and not got[4]["rejected"] and got[4]["lang_pred"] == "en"
    assert [got[i]["lang_pred"] for i in (2, 3)] == ["und", "und"] and got[2]["score"] == 0


def test_language_against_brute_force(spark):
    """N-grams, TF-IDF weights, cosines, ties and rejection by plain Python, from the model's numbers."""
    rng = np.random.default_rng(12)
    own = [words(rng, int(n)) for n in rng.integers(1, 40, 30)] + ["", "12 !?", "Żółć ąę", "ab", "A  b--c", None]
    train = spark.createDataFrame([(i, words(rng, 25), "xx" if i % 2 else "yy") for i in range(40)], "doc_id long, text string, lang string")
    model = language_id.fit(train, F.lit(True), per_language=15, k=3)
    assert set(model.languages) == {"xx", "yy"} and len(model.languages) <= 6
    got = collected(language_id.identify(spark.createDataFrame(list(enumerate(own)), "doc_id long, text string"), model))

    def grams(text):
        folded = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in text.encode())
        folded = re.sub(rb" +", b" ", folded).lstrip(b" ")
        count = collections.Counter()
        for size, factor in ((2, 0x9E3779B1), (3, 0x85EBCA77)):
            for k in range(len(folded) - size + 1):
                count[(int.from_bytes(folded[k : k + size], "big") * factor & 0xFFFFFFFF) >> 20] += 1
        return count

    for i, text in enumerate(own):
        r, count = got[i], grams(text or "")
        if not re.search("[^\\W\\d_]", text or ""):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        v = np.zeros(language_id.DIMS)
        for slot, n in count.items():
            v[slot] = (1 + np.log(n)) * model.idf[slot]
        v /= np.linalg.norm(v) or 1
        cosine = model.centroids @ v
        best = int(np.argmax(cosine))
        assert cosine[best] - r["score"] == pytest.approx(0, abs=1e-5)
        others = [c for c, lang in zip(cosine, model.languages, strict=True) if lang != model.languages[best]]
        assert r["lang_pred"] == model.languages[best] or cosine[best] - max(others) < 1e-5
        floor = model.floors[best] * np.sqrt(min(1, len(count) / max(model.typical[best], 1)))
        assert r["rejected"] == (cosine[best] < floor) or abs(cosine[best] - floor) < 1e-5
    # equal centroids: the first language in order
    twin = language_id.CentroidModel(("aa", "bb"), np.repeat(model.centroids[:1], 2, axis=0), model.floors[:2], model.typical[:2], model.idf)
    assert {r["lang_pred"] for r in language_id.identify(train, twin).collect()} == {"aa"}


def test_language_without_letters_or_labels(spark):
    """Labelled texts without any n-gram, or no labelled text: no centroids, every text is unknown."""
    for lang in ("en", None):
        d = spark.createDataFrame([(1, " ", lang), (2, "", lang)], "doc_id long, text string, lang string")
        model = language_id.fit(d, F.lit(True))
        assert model.languages == () and {r["lang_pred"] for r in language_id.identify(d, model).collect()} == {"und"}


def test_language_sample_counts_distinct_texts(spark):
    """Copies, also under one id, leave the fitted model as it is, and the bound counts distinct texts."""
    rng = np.random.default_rng(8)
    rows = [(i, words(rng, 30), "en") for i in range(60)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    (first,) = plain.orderBy(F.xxhash64("text")).limit(1).collect()
    hot = plain.union(spark.createDataFrame([(1000 + i // 2, first["text"], "en") for i in range(200)] + [tuple(first)] * 5, plain.schema))
    a, b = (language_id.fit(d, F.lit(True), per_language=40) for d in (plain, hot))
    assert (a.idf == b.idf).all() and (a.centroids == b.centroids).all() and (a.floors == b.floors).all()


def test_licenses(spark):
    line = licenses.TEMPLATES["gpl-3.0-line"]
    notice = licenses.TEMPLATES["mit-grant"].upper()
    rows = [(1, "some words here " + line + " and more"), (2, notice.replace("FREE OF CHARGE,", "")), (3, "Licensed cats under the bed."), (4, f"{line} x y z " * 2), (5, None)]
    got = [tuple(r)[:2] + (r["word_start"], r["word_end"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    n = len(line.split())
    assert (1, "gpl-3.0-line", 3, 3 + n) in got and (2, "mit-grant") in [g[:2] for g in got]
    assert [g for g in got if g[0] == 4] == [(4, "gpl-3.0-line", 0, n), (4, "gpl-3.0-line", n + 3, 2 * n + 3)]
    assert not [g for g in got if g[0] in (3, 5)]


def test_licenses_on_consecutive_lines_and_around_insertions(spark):
    """Copies of short lines that lie closer than the band are all found; parts around a long insertion count together."""
    rng = np.random.default_rng(4)
    line, notice, gap = licenses.TEMPLATES["mit-line"], licenses.TEMPLATES["mit-grant"].split(), words(rng, 40)
    half, n = len(notice) // 2, len(notice)
    rows = [
        (1, f"{line}\n" * 4),
        (2, "Licensed under CC BY-NC 4.0.\n" * 300),
        (3, " ".join([*notice[:half], gap, *notice[half:]])),
        (4, " ".join([*notice[:half], words(rng, 40 * n), *notice[half:]])),
        (5, " ".join([*notice[:half], gap, *notice[:half]])),
        (6, " ".join([gap, *notice[:half], gap, *notice[half:], *notice, line, line])),
    ]
    got = collections.defaultdict(list)
    for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["doc_id"]].append((r["template"], r["word_start"], r["word_end"], r["coverage"]))
    spans = lambda d, t: sorted(x[1:3] for x in got[d] if x[0] == t)
    assert spans(1, "mit-line") == [(5 * i, 5 * i + 5) for i in range(4)]
    assert spans(2, "cc-by-nc-4.0-line") == [(5 * i, 5 * i + 5) for i in range(300)]
    assert got[3] == [("mit-grant", 0, n + 40, 1.0)]
    assert got[4] == [] and got[5] == []
    assert spans(6, "mit-grant") == [(40, 80 + n), (80 + n, 80 + 2 * n)]
    assert spans(6, "mit-line") == [(80 + 2 * n, 85 + 2 * n), (85 + 2 * n, 90 + 2 * n)]


def test_license_spans_count_all_words(spark):
    """Words of punctuation alone take no part in a match, but count in its place."""
    rows = [(1, " * * * Released under -- the MIT License. * "), (2, "-- Released under the MIT License.\n//\nReleased under the MIT License."), (None, "x Released under the MIT License.")]
    got = sorted((r["doc_id"] or 0, r["word_start"], r["word_end"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 1, 6), (1, 3, 9), (2, 1, 6), (2, 7, 12)]


def test_banded_alignment_against_brute_force():
    """A band over all diagonals gives the score of the full local alignment; the span holds what was matched."""
    rng = np.random.default_rng(6)
    for _ in range(60):
        doc, want = rng.integers(0, 4, rng.integers(1, 14)), rng.integers(0, 4, rng.integers(1, 9))
        score, best = np.zeros((len(doc) + 1, len(want) + 1), int), 0
        for i in range(1, len(doc) + 1):
            for j in range(1, len(want) + 1):
                score[i, j] = max(0, score[i - 1, j - 1] + (2 if doc[i - 1] == want[j - 1] else -1), score[i - 1, j] - 1, score[i, j - 1] - 1)
        best = score.max()
        n, s, e, ts, te = licenses.banded_alignment(doc, want, -len(want), len(doc))
        if not best:
            assert n == 0
            continue
        # matched words score 2, each other word of the spans costs 1, a mismatched pair once
        assert 2 * n - max(e - s, te - ts) + n == best or 2 * n - ((e - s - n) + (te - ts - n)) <= best <= 2 * n
        assert 0 <= s < e <= len(doc) and 0 <= ts < te <= len(want) and score[e, te] == best and n <= min(e - s, te - ts)


@pytest.mark.parametrize("name, end", [("word_bpe_49k.json", 2), ("byte_bpe_50k.json", None)])
def test_whole_text_ids(texts, name, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    t.encode_special_tokens = True
    own = [x or "" for x in texts]
    ids, off = encoder(vocabulary(name), end == 2)(pa.array(own))
    for i, x in enumerate(own):
        assert ids[off[i] : off[i + 1]].tolist() == t.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("name, end", [("word_bpe_49k.json", 2), ("byte_bpe_50k.json", None)])
def test_chunks_of_every_class(name, end):
    """Apostrophes, cases, digits, marks, scripts and white space at every place, against the library."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    t.encode_special_tokens = True
    own = ["it's we'll DON'T I'M 'S", "a\tb c\td", "É È Äß ÀÉ'S", "naïve Ŝ ſ İ ŉ ǰ Ⱥ ǅ x", "x² ½ 3¼4 １２", "😀 a😀b 漢字 テスト", "a\u00a0b c\u2003d", "\n a\nb", "\na", "a\n", "a ", "", " ", "a\u0301b cafe\u0301", "a\u00adb", "Ω Ωω Σς ΑΣ", "x'", "'' ' '", "it's\nwe're", "\x85a", "a\u200bb", " lead", "tab\tend\t", "123 4567 89a1b2", "ⅷ Ⅷ", " ª º µ ×÷ ¡¿", "Ǆǅǆ Ȿ Ɀ ɐ Ɐ", "x" * 70_000, "1" * 300]
    own += [chr(c) + "a " + chr(c) for c in range(0x20, 0x2A0)]
    ids, off = encoder(vocabulary(name), end == 2)(pa.array(own))
    assert (encoder(vocabulary(name), end == 2).lengths_of(pa.array(own)) == np.diff(off)).all()
    for i, x in enumerate(own):
        assert ids[off[i] : off[i + 1]].tolist() == t.encode(x, add_special_tokens=False).ids, x[:50]


@pytest.mark.parametrize("name, words, make", [("byte_bpe_50k.json", False, library_encoder), ("word_bpe_49k.json", True, library_encoder), (rank_bpe.VOCABULARY, False, rank_bpe.rank_encoder)])
@pytest.mark.parametrize("limit", ["CACHE_PIECES", "CACHE_BYTES", "CACHE_IDS"])
def test_full_caches(monkeypatch, texts, name, words, make, limit):
    """Caches that fill up in every call give the same ids."""
    own = [x or "" for x in texts * 2]
    want, off = make(vocabulary(name), words)(pa.array(own))
    monkeypatch.setattr(tokens, limit, 40)
    encode = make(vocabulary(name), words)
    for a in range(0, len(own), 4):
        got, _ = encode(pa.array(own[a : a + 4]))
        assert (got == want[off[a] : off[min(a + 4, len(own))]]).all()


def test_rank_merges_with_inversions():
    """Random ranks, also such that a merge makes an earlier rank possible, against repeated least-pair merges."""
    rng = np.random.default_rng(5)
    word = lambda a, b: bytes(rng.choice([97, 98, 99], rng.integers(a, b)).tolist())
    for _ in range(60):
        longer = sorted({word(2, 6) for _ in range(40)})
        rng.shuffle(longer)
        ranks = {token: k for k, token in enumerate([b"a", b"b", b"c", *longer])}
        pieces, want = [word(1, 40) for _ in range(30)], []
        for piece in pieces:
            parts = [piece] if piece in ranks else [piece[k : k + 1] for k in range(len(piece))]
            while found := [(ranks[x + y], k) for k, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in ranks]:  # noqa: B905
                k = min(found)[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            want.append([ranks[p] for p in parts])
        assert rank_bpe.RankMerger(ranks)(pieces) == want
    with pytest.raises(KeyError):
        rank_bpe.RankMerger({b"a": 0})([b"ab"])
    assert rank_bpe.RankMerger({b"a": 0})([b"", b"a", b"aa"]) == [[], [0], [0, 0]]


def test_token_files(spark, docs, texts):
    ids, off = encoder(vocabulary("word_bpe_49k.json"), True)(pa.array([t or "" for t in texts]))
    got, start = collected(token_files.token_files(docs)), 0
    for i in range(len(texts)):
        own = np.append(ids[off[i] : off[i + 1]], 2).astype("<u4")
        assert (got[i * 3]["start"], got[i * 3]["n_tokens"], got[i * 3]["ids_crc32"]) == (start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)


def test_token_shards_follow_ranges_and_sizes(spark, docs, texts):
    """Several ranges and several shards a range, null, smallest and repeated ids: files ascend and read back whole."""
    low = np.iinfo(np.int64).min
    more = spark.createDataFrame([(None, "no id"), (None, "none"), (low, "lowest"), (low, "again lowest"), (6, "repeated id")], "doc_id long, text string")
    d = docs.select("doc_id", "text").unionByName(more)
    shards = token_files.write_token_shards(d, shard_ids=3000, range_bytes=(4000, 4000)).persist()
    rows = sorted(shards.collect(), key=lambda r: r["shard"])
    assert len({r["shard"] >> 12 for r in rows if r["first_id"] is not None}) > 3 and len({r["shard"] & 4095 for r in rows}) > 1
    firsts = [r["first_id"] for r in rows]
    assert firsts[0] is None and [f for f in firsts if f is not None] == sorted(f for f in firsts if f is not None)
    got = sorted(token_files.read_token_shards(shards).collect(), key=lambda r: r["start"])
    shards.unpersist()
    assert len(got) == len(texts) + 5 and [r["doc_id"] for r in got[:4]] == [None, None, low, low]
    assert [r["doc_id"] for r in got[2:]] == sorted(r["doc_id"] for r in got[2:])
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert at == sum(r["n_tokens"] for r in rows)


def test_repair_against_brute_force():
    """Rules applied one by one in their order give the symbols, and expand to the ids; counts are ties and runs too."""
    rng = np.random.default_rng(9)
    for top, n in ((2, 300), (4, 900), (1, 120)):
        ids, ends = rng.integers(0, top, n).astype(np.uint32), np.array([n // 3, n // 3, n])
        symbols, done, rules = token_files.repair(ids, ends, 10, per_round=1, least=3)
        parts = [ids[: n // 3].tolist(), [], ids[n // 3 :].tolist()]
        for k, (a, b) in enumerate(rules.tolist()):
            count = collections.Counter()
            for p in parts:
                count.update(zip(p, p[1:], strict=False))
            assert count[(a, b)] == max(count.values()) >= 3
            for j, p in enumerate(parts):
                out = []
                for x in p:  # from left to right; a replaced pair takes no part in the next
                    if out and (out[-1], x) == (a, b):
                        out[-1] = 10 + k
                    else:
                        out.append(x)
                parts[j] = out
        assert [symbols[a:b].tolist() for a, b in zip([0, *done[:-1]], done, strict=True)] == parts
        shard = token_files.Shard(token_files.write_shard(np.arange(3), ids, ends, 10))
        assert (shard.decode() == ids).all() and shard.nulls == 0


def test_repair_random_access():
    rng = np.random.default_rng(1)
    ids, ends = rng.integers(0, 5, 4000).astype(np.uint32), np.array([0, 0, 900, 901, 4000])
    shard = token_files.Shard(token_files.write_shard(np.arange(5), ids, ends, 10))
    assert len(shard.rules) and len(shard.symbols) < 4000 and (shard.decode() == ids).all()
    for start, n in ((0, 1), (5, 700), (3000, 99)):
        assert (shard.span(4, start, n) == ids[901 + start : 901 + start + n]).all()


def test_repair_leaves_no_frequent_pair():
    """Many copies of a passage collapse to about a symbol each, and no pair that could be replaced stays frequent."""
    rng = np.random.default_rng(2)
    passage = rng.integers(0, 900, 500)
    own = [np.append(passage if i % 2 else rng.integers(0, 900, 40), 999) for i in range(400)]
    ids, ends = np.concatenate(own).astype(np.uint32), np.cumsum([len(x) for x in own])
    symbols, done, rules = token_files.repair(ids, ends, 1000)
    inner = np.ones(len(symbols) - 1, bool)
    inner[done[:-1] - 1] = False
    pairs = collections.Counter(zip(symbols[:-1][inner].tolist(), symbols[1:][inner].tolist(), strict=True))
    assert max(pairs.values()) < token_files.LEAST_COUNT and len(rules)
    assert done[1] - done[0] <= 2 and len(symbols) < 200 * 41 + 200 * 2
    shard = token_files.Shard(token_files.write_shard(np.arange(400), ids, ends, 1000))
    assert (shard.decode() == ids).all() and (shard.span(1, 100, 300) == passage[100:400]).all()


def test_packing(spark, docs, texts):
    ids, off = encoder(vocabulary("byte_bpe_50k.json"))(pa.array([t or "" for t in texts]))
    rows = packing.pack_documents(docs, capacity=64, grain=16).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for i in range(len(texts)):
        own, at = np.append(ids[off[i] : off[i + 1]], 1).astype("<u4"), 0
        for r in sorted(by_doc[i * 3], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(own)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    sums = [sum([4, 5, 6, 7, 8][i] for i in s) for s in packing.differencing([4, 5, 6, 7, 8], 2)]
    assert sorted(sums) == [14, 16]


def test_packing_fills_windows_over_many_partitions(spark):
    """Last runs of 211 small partitions meet in a second round."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = packing.pack_documents(d.repartition(211)).groupBy("sequence_id").agg(F.sum("length").alias("n")).toPandas()
    assert rows["n"].max() <= 2048 and rows["n"].sum() / len(rows) / 2048 > 0.98


@pytest.mark.parametrize("common", [(1024, 256), (1, 2)])
def test_suffix(spark, docs, texts, common):
    owner, got = {}, collected(suffix_dedup.remove_repeats(docs, with_text=True, common=common))
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if owner.setdefault(b[p : p + 50], i) < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        r = got[i * 3]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact(spark, docs, texts, keep):
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i * 3)
    got = collected(exact_dedup.exact_duplicates(docs, keep=keep))
    for t, own in groups.items():
        for i in own:
            best = max(own) if keep == "largest" else min(own)
            assert tuple(got[i])[1:] == (best, len(own), i == best, hashlib.sha256(t.encode()).hexdigest())


def test_exact_rounds_and_slices(spark):
    """Three rounds over 70 partitions, null ids and the smallest id, against a count."""
    assert exact_dedup.slice_bits(600 * 100_000, 600) == [2, 5, 8, 10, 11] and exact_dedup.slice_bits(0, 1) == [0]
    low = np.iinfo(np.int64).min
    d = spark.range(0, 3000, 1, 70).select(F.when(F.col("id") % 500 != 499, F.col("id")).alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 700).cast("string")).alias("text"))
    d = d.unionByName(spark.createDataFrame([(low, "only"), (None, "only"), (None, "nameless"), (None, "nameless")], "doc_id long, text string"))
    groups = collections.defaultdict(list)
    for r in d.collect():
        groups[r["text"]].append(r["doc_id"])
    got = exact_dedup.exact_duplicates(d)
    n = 0
    for r in got.join(d, "doc_id").collect():
        if r["text_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest():
            own = groups[r["text"]]
            best = max(x for x in own if x is not None)
            assert (r["keep_id"], r["group_size"], r["kept"]) == (best, len(own), r["doc_id"] == best)
            n += 1
    assert n == 3000 - 6 + 1 and got.count() == d.count()
    assert sorted(r["kept"] for r in got.where("doc_id is null and group_size = 2").collect()) == [False, True, True]


def test_rank_bpe(spark, docs, texts):
    import public_tokenizers
    import tiktoken

    ranks = rank_bpe.read_ranks(vocabulary(rank_bpe.VOCABULARY))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got, ids = collected(rank_bpe.encoding_digests(docs)), collected(rank_bpe.encode_texts(docs))
    for i, t in enumerate(texts):
        want = library.encode_ordinary(t or "")
        assert ids[i * 3]["ids"] == want and got[i * 3]["n_tokens"] == len(want)
        assert got[i * 3]["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert got[i * 3]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_rank_bpe_on_very_long_pieces(spark):
    """Pre-tokens of up to half a million letters, against the library."""
    import public_tokenizers
    import tiktoken

    ranks = rank_bpe.read_ranks(vocabulary(rank_bpe.VOCABULARY))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(14)
    own = ["".join(rng.choice(list("abcdeinorst"), n)) for n in (300, 20_000, 500_000)] + ["ab" * 30_000, "é" * 9_000 + " x", "7" * 5_000 + "!" * 3_000]
    got = collected(rank_bpe.encode_texts(spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")))
    for i, t in enumerate(own):
        assert got[i]["ids"] == library.encode_ordinary(t)


def test_texts_beyond_a_slice(spark):
    """A text longer than what one step holds, between short ones: lengths, files and pieces stay whole."""
    from tokenizers import Tokenizer

    rng = np.random.default_rng(15)
    own = ["short one", words(rng, 4000) * 200, None, "last"]
    assert len(own[1]) > 4 << 20
    d = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").coalesce(1)
    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = [np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for x in own]
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_lengths(d).collect()} == {i: len(w) - 1 for i, w in enumerate(want)}
    for r in packing.pack_documents(d).collect():
        assert r["ids_crc32"] == zlib.crc32(want[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(want[r["doc_id"]])
    w = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    for r in token_files.token_files(d).collect():
        assert r["ids_crc32"] == zlib.crc32(np.array([*w.encode(own[r["doc_id"]] or "", add_special_tokens=False).ids, 2], "<u4").tobytes())


def test_repeated_rows_count_each_time(spark, docs):
    """Every row of a table that holds each row twice counts: lengths, matches and packed ids double."""
    twice = docs.unionByName(docs)
    one, two = (collected(token_counts.length_histogram(token_counts.token_lengths(d)), "n_tokens") for d in (docs, twice))
    assert {k: 2 * r["n_docs"] for k, r in one.items()} == {k: r["n_docs"] for k, r in two.items()}
    one, two = (collections.Counter(map(tuple, licenses.scan_licenses(d).collect())) for d in (docs, twice))
    assert one and {k: 2 * n for k, n in one.items()} == dict(two)
    one, two = (packing.pack_documents(d, capacity=64, grain=16) for d in (docs, twice))
    total = lambda d: d.agg(F.sum("length")).first()[0]
    assert 2 * total(one) == total(two) and two.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 64


def test_near(spark, docs, texts):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(fold))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    got = collected(near_dedup.near_duplicates(docs))
    assert [(got[i * 3]["n_shingles"], got[i * 3]["component_id"]) for i in range(len(texts))] == [(len(s), 3 * c) for s, c in zip(sets, label, strict=True)]


def test_near_on_the_fixture(spark):
    """All components of the fixture's documents, against all pairs of sets."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = collections.defaultdict(list)
    for r in sorted(d.select("doc_id", "text").collect()):
        w = re.findall("[^\x20\x09-\x0d]+", (r["text"] or "").translate(fold))
        own[frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else r["doc_id"]].append(r["doc_id"])
    sets = [s for s in own if isinstance(s, frozenset)]
    where = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for shingle in s:
            where[shingle].append(k)
    label = {k: min(own[s]) for k, s in enumerate(sets)}
    links = []
    for k, s in enumerate(sets):
        both = collections.Counter(j for shingle in s for j in where[shingle] if j < k)
        links += [(j, k) for j, n in both.items() if 100 * n >= 75 * (len(s) + len(sets[j]) - n)]
    for _ in sets:
        before = dict(label)
        for j, k in links:
            label[j] = label[k] = min(label[j], label[k])
        if before == label:
            break
    want = {i: label[k] for k, s in enumerate(sets) for i in own[s]} | {i: i for s, ids in own.items() if not isinstance(s, frozenset) for i in ids}
    got = {i: r["component_id"] for i, r in collected(near_dedup.near_duplicates(d)).items()}
    assert links and got == want


def test_near_buckets_with_one_large_component(spark, monkeypatch):
    """Buckets cut into blocks: the large component's blocks don't meet each other, and no link is lost."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = np.random.default_rng(7)
    base, rows, sets = [f"w{i}" for i in range(50)], [], []
    for i in range(120):
        w = list(base)
        if i >= 90:  # far enough from the others to be apart, near enough to share buckets
            w[int(rng.integers(0, 25))] = f"y{i}"
            w[int(rng.integers(25, 50))] = f"z{i}"
        elif i:
            w[int(rng.integers(0, 50))] = f"x{rng.integers(0, 6)}"
        rows.append((i, " ".join(w)))
        sets.append({tuple(w[k : k + 5]) for k in range(46)})
    label, changed = list(range(120)), True
    pairs = [(i, j) for i in range(120) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in pairs:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    got = collected(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[i]["component_id"] for i in range(120)] == label and len(set(label)) > 1


def test_near_large_group(spark):
    """A family of copies around the threshold: blocks, residual rounds and the forest agree with brute force."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(60)]
    rows, sets = [], []
    for i in range(150):
        w = list(base)
        for k in rng.integers(0, 60, rng.integers(0, 4)):
            w[k] = f"x{rng.integers(0, 5)}"
        rows.append((i, " ".join(w)))
        sets.append({tuple(w[k : k + 5]) for k in range(56)})
    label, changed = list(range(150)), True
    pairs = [(i, j) for i in range(150) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in pairs:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    got = collected(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[i]["component_id"] for i in range(150)] == label


PIPELINE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd_documents(spark, texts):
    """Texts with nulls, repeated ids, repeated rows, null ids, and columns with clashing names."""
    rows = [(i, t, ["en", "de", None][i % 3], "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [(1, "another text of the same id, with some words to it", "en", "s", 50), (1, texts[1], "en", "s", 1), (2, texts[2], "en", "s", 1), (2, texts[2], "en", "s", 1)]
    rows += [(None, "a text without an id, with some words to it", "en", "s", 1), (None, texts[3], "en", "s", 1), (None, None, None, None, None)]
    d = spark.createDataFrame(rows, PIPELINE_SCHEMA)
    for c in ("kept", "keep_id", "text_sha256", "label", "sig", "part", "__id", "component_id"):
        d = d.withColumn(c, F.lit(1))
    return d.repartition(4).persist()


def stage_named(name):
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)[name]


def kept_rows(df):
    return collections.Counter((r["doc_id"], r["text"]) for r in df.collect())


@pytest.mark.parametrize("name", ["language_id", "exact_dedup", "near_dedup", "suffix_dedup", "packing"])
def test_stages_on_edges(spark, odd_documents, name):
    stage, columns = stage_named(name), PIPELINE_SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    empty = stage(spark, odd_documents.where("doc_id < -5"), "")
    assert empty.count() == 0 and (name == "packing" or empty.columns == columns)
    nulls = stage(spark, odd_documents.withColumn("text", F.lit(None).cast("string")), "")
    want = {"language_id": 0, "exact_dedup": 1}.get(name, odd_documents.count())
    assert nulls.count() == want
    out = stage(spark, odd_documents, "")
    assert name == "packing" or out.columns == columns


def test_exact_stage_against_brute_force(spark, odd_documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    best = {}
    for i, t in rows:
        if i is not None:
            best[t or ""] = max(i, best.get(t or "", i))
    want = collections.Counter((i, t) for i, t in rows if (t or "") not in best or i == best[t or ""])
    assert kept_rows(stage_named("exact_dedup")(spark, odd_documents, "")) == want


def test_near_stage_against_brute_force(spark, odd_documents):
    """Rows are judged by their own text, also where ids repeat or are null."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def first_of_components(docs):
        rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
        sets = []
        for _, t in rows:
            w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(fold))
            sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
        label = list(range(len(rows)))
        for _ in range(4):
            for i, a in enumerate(sets):
                for j, b in enumerate(sets[:i]):
                    if a and b and 100 * len(a & b) >= 75 * len(a | b):
                        label[i] = label[j] = min(label[i], label[j])
        return collections.Counter(r for k, r in enumerate(rows) if label[k] == k)

    unique = odd_documents.where("doc_id > 5")
    assert unique.count() == unique.select("doc_id").distinct().count()
    for d in (odd_documents, unique):
        assert kept_rows(stage_named("near_dedup")(spark, d, "")) == first_of_components(d)


def test_suffix_stage_against_brute_force(spark, docs, texts):
    owner, got = {}, {r["doc_id"]: r for r in stage_named("suffix_dedup")(spark, docs.select(*PIPELINE_SCHEMA.replace(" long", "").replace(" string", "").split(", ")), "").collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if owner.setdefault(b[p : p + 50], i) < i:
                gone[p : p + 50] = b"\1" * 50
        left = bytes(c for c, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore") if t is not None else None
        assert got[i * 3]["text"] == left and got[i * 3]["n_chars"] == (len(left) if left is not None else 0)


def test_run_is_its_stages(spark, tmp_path):
    """run() gives what the stages give one after another."""
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    pieces = lambda d: sorted(map(tuple, d.select(key).collect()))
    assert pieces(corpus_pipeline.run(spark, "/root/testdata/sf0.001")) == pieces(docs)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    frames = [d]
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, frames[-1], "/root/testdata/sf0.001").write.parquet(out)
        frames.append(spark.read.parquet(out))
    for f in frames[1:-1]:
        assert f.columns == d.columns and f.dtypes == d.dtypes
    lang, exact, near, suffix, packed = frames[1:]
    assert lang.count() >= 0.99 * d.count()
    assert exact.count() == lang.select("text").distinct().count()
    comps = near_dedup.near_duplicates(exact)
    assert near.count() == comps.select("component_id").distinct().count()
    assert suffix.count() == near.count() and suffix.agg(F.sum("n_chars")).first()[0] < near.agg(F.sum(F.length("text"))).first()[0]
    assert packed.select("doc_id").distinct().count() == suffix.count()
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() == packed.count()


def test_suffix_blocks_are_compressed():
    """What documents and overlapping contexts take on the way between tasks, on prose that repeats once, and what comes of it."""
    rng = np.random.default_rng(3)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(300)]
    once = [" ".join(words[i] for i in rng.zipf(1.3, 400) % 300) for _ in range(100)]
    text = pa.array(once * 2, pa.string())
    docs = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), text, pa.array(np.zeros(200, np.int64))], ["doc_id", "text", "part"])
    packed = pa.Table.from_batches(suffix_dedup._pack_docs([docs.slice(0, 150), docs.slice(150)]))
    judged = suffix_dedup._judge_anchors(1024)(suffix_dedup._find_anchors(1, 1 << 30)(packed))
    sent = suffix_dedup._send_contexts(1)(packed, judged)
    volume = sum(map(len, once)) * 2
    assert packed.num_rows == 1 and packed.column("rows").nbytes < 0.6 * volume
    assert sent.nbytes < 1.3 * volume  # each context once, in raw form about five times its share of the text
    out = suffix_dedup._apply_marks(1, True)(packed, suffix_dedup._match_contexts(sent)).sort_by("doc_id")
    assert out.column("n_bytes").to_pylist() == [len(t) for t in text.to_pylist()]
    assert out.column("n_removed").to_pylist()[100:] == out.column("n_bytes").to_pylist()[100:]
    assert set(out.column("kept_text").to_pylist()[100:]) == {""}


def test_near_dedup_hands_texts_over_in_small_batches(spark, monkeypatch):
    """Rows of a batch that the signature stage gets at most, which bounds what the JVM and a worker hold of whole texts."""
    seen, own = [], near_dedup._signature_table

    def watched(docs):
        seen.append(int(docs.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))
        return own(docs)

    monkeypatch.setattr(near_dedup, "_signature_table", watched)
    docs = spark.createDataFrame([(i, f"word{i} and some more words of a text") for i in range(20)], "doc_id long, text string")
    assert near_dedup.near_duplicates(docs).count() == 20 and seen == [near_dedup.WIDE_ROWS]

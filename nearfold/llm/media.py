"""Media columns: baseline JPEG. Payload bytes are the DC-only luminance samples of a valid JPEG; the reader
parses markers, Huffman-decodes every scan and rebuilds the DC-only thumbnail in numpy.

Restart intervals are decoded side by side, one numpy lane each, so the bit-serial part is vectorised.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from nearfold.llm.arrowtext import offsets_of, raw_utf8, spans_index, text_slices
from nearfold.llm.common import as_docs, saved

#: Samples in a thumbnail row, and so bytes in a payload unit.
UNIT = 192
#: Thumbnail rows of one frame: 65,535 lines of 8-line blocks. A longer payload takes several frames.
FRAME_ROWS = 8191
#: Fixed values of the baseline format: counts of codes by length, and their symbols (categories of DC differences; end of block).
DC_BITS, DC_VALUES = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), tuple(range(12))
AC_BITS, AC_VALUES = (1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0), (0x00, 0x01)
#: With this step the DC term of a flat block is its sample less 128.
DC_STEP = 8
TEXT_SLICE = 2 << 20


def _codes(bits: tuple[int, ...], values: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """Canonical code and length of each symbol."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out[values[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """For differences -255..255: DC code, magnitude bits and end of block as one bit string, and its length."""
    dc, (eob, eob_len) = _codes(DC_BITS, DC_VALUES), _codes(AC_BITS, AC_VALUES)[0]
    value, length = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = dc[size]
        extra = d if d > 0 else d + (1 << size) - 1
        value[d + 255], length[d + 255] = (code << size | (extra if size else 0)) << eob_len | eob, n + size + eob_len
    return value, length


_VALUE, _LENGTH = _difference_codes()


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def _header(rows: int) -> bytes:
    """All markers up to the scan of a frame with ``rows`` thumbnail rows of UNIT samples."""
    table = lambda kind, bits, values: bytes((kind, *bits, *values))
    size = (8 * rows).to_bytes(2, "big") + (8 * UNIT).to_bytes(2, "big")
    return b"\xff\xd8" + b"".join((
        _segment(0xDB, bytes((0, *[DC_STEP] * 64))),
        _segment(0xC0, b"\x08" + size + bytes((1, 1, 0x11, 0))),
        _segment(0xC4, table(0x00, DC_BITS, DC_VALUES) + table(0x10, AC_BITS, AC_VALUES)),
        _segment(0xDD, UNIT.to_bytes(2, "big")),
        _segment(0xDA, bytes((1, 1, 0x00, 0, 63, 0))),
    ))


def encode_payloads(payload: np.ndarray, rows: np.ndarray) -> list[bytes]:
    """JPEG bytes of several payloads that lie end to end in ``payload``, each of ``rows[i]`` * UNIT bytes.

    One restart interval per thumbnail row; frames of at most FRAME_ROWS rows follow each other.
    """
    lanes = int(rows.sum())
    samples = payload.reshape(lanes, UNIT).astype(np.int16) - 128
    diff = np.diff(samples, axis=1, prepend=np.int16(0)) + 255
    length = _LENGTH[diff]
    bits = length.sum(axis=1)
    size = (bits + 7) // 8
    start = offsets_of(size)
    at = (np.cumsum(length, axis=1) - length + 8 * start[:-1, None]).ravel()
    length, value = length.ravel(), _VALUE[diff.ravel()]
    pads = 8 * size - bits
    at, length = np.concatenate((at, 8 * start[:-1] + bits)), np.concatenate((length, pads))
    value = np.concatenate((value, (np.uint64(1) << pads.astype(np.uint64)) - np.uint64(1)))
    word = at >> 5
    wide = value << (64 - length - (at & 31)).astype(np.uint64) if len(at) else value
    wide[length == 0] = 0
    n = int(start[-1] // 4 + 2)
    low = wide & np.uint64(0xFFFFFFFF)
    over = np.flatnonzero(low)
    sums = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), n) + np.bincount(word[over] + 1, low[over].astype(np.float64), n)
    body = sums.astype(">u4").view(np.uint8)[: start[-1]]
    # byte stuffing, and a restart marker behind every interval (the last one of a frame is cut off again)
    full = body == 0xFF
    lane = np.repeat(np.arange(lanes), size)
    to = np.arange(len(body)) + np.cumsum(full) - full + 2 * lane
    stuffed = np.concatenate(([0], np.cumsum(full)))[start[1:]]
    ends = start[1:] + stuffed + 2 * np.arange(lanes)
    out = np.zeros(len(body) + int(full.sum()) + 2 * lanes, np.uint8)
    out[to] = body
    first = offsets_of(rows)
    number = np.arange(lanes) - np.repeat(first[:-1], rows)
    out[ends], out[ends + 1] = 0xFF, 0xD0 + (number % FRAME_ROWS) % 8
    scan, done = out.tobytes(), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        frames = []
        for k in range(a, b, FRAME_ROWS):
            stop = min(b, k + FRAME_ROWS)
            frames += [_header(stop - k), scan[ends[k - 1] + 2 if k else 0 : ends[stop - 1]], b"\xff\xd9"]
        done.append(b"".join(frames))
    return done


@dataclass
class Frame:
    """What the markers of one frame say; ``scan`` is where its entropy-coded bytes lie."""

    width: int = 0
    height: int = 0
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantisation table
    steps: dict[int, int] = field(default_factory=dict)  # table -> DC step
    tables: dict[int, tuple[tuple[int, ...], tuple[int, ...]]] = field(default_factory=dict)
    order: list[tuple[int, int, int]] = field(default_factory=list)  # component index, DC table, AC table
    restart: int = 0
    scan: tuple[int, int] = (0, 0)


def parse_frames(data: bytes) -> list[Frame]:
    """Frames of concatenated baseline JPEG images with one scan each; anything else raises ValueError."""
    view, at, frames = np.frombuffer(data, np.uint8), 0, []
    marks = np.flatnonzero((view[:-1] == 0xFF) & (view[1:] != 0) & ((view[1:] < 0xD0) | (view[1:] > 0xD7)) & (view[1:] != 0xFF)) if len(view) > 1 else np.zeros(0, int)
    while at < len(data):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        frame, at = Frame(), at + 2
        while True:
            if at + 4 > len(data) or data[at] != 0xFF:
                raise ValueError("broken marker")
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    frame.steps[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC0:
                if body[0] != 8:
                    raise ValueError("only 8-bit samples")
                frame.height, frame.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                frame.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("only baseline frames")
            elif marker == 0xC4:
                while body:
                    bits = tuple(body[1:17])
                    frame.tables[body[0]] = bits, tuple(body[17 : 17 + sum(bits)])
                    body = body[17 + sum(bits) :]
            elif marker == 0xDD:
                frame.restart = int.from_bytes(body, "big")
            elif marker == 0xDA:
                ids = [p[0] for p in frame.parts]
                frame.order = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                break
        k = int(np.searchsorted(marks, at))
        if k == len(marks):
            raise ValueError("scan without end")
        frame.scan, at = (at, int(marks[k])), int(marks[k])
        if data[at + 1] != 0xD9:
            raise ValueError("only one scan a frame")
        frames.append(frame)
        at += 2
    return frames


def _lookup(bits: tuple[int, ...], values: tuple[int, ...]) -> np.ndarray:
    """By the next 16 bits: code length * 256 + symbol; 0 where no code fits."""
    out = np.zeros(65536, np.uint16)
    for symbol, (code, n) in _codes(bits, values).items():
        out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | symbol
    return out


def decode_thumbnails(data: np.ndarray, frames: list[Frame]) -> list[np.ndarray]:
    """DC-only luminance thumbnails (one sample a block) of frames whose scans lie in ``data``."""
    out: list[np.ndarray] = [np.zeros((0, 0), np.uint8)] * len(frames)
    kinds: dict[tuple, list[int]] = {}
    for i, f in enumerate(frames):
        kinds.setdefault((tuple(f.parts), tuple(sorted(f.tables.items())), tuple(f.order)), []).append(i)
    for chosen in kinds.values():
        for i, thumb in zip(chosen, _decode_alike(data, [frames[i] for i in chosen]), strict=True):
            out[i] = thumb
    return out


def _decode_alike(data: np.ndarray, frames: list[Frame]) -> list[np.ndarray]:
    """Frames with the same components and tables: all restart intervals in step."""
    f0 = frames[0]
    tall, broad = max(p[2] for p in f0.parts), max(p[1] for p in f0.parts)
    single = len(f0.order) == 1
    blocks = [(c, dc, ac) for c, dc, ac in f0.order for _ in range(1 if single else f0.parts[c][1] * f0.parts[c][2])]
    luts = {(k << 4 | n): _lookup(*f0.tables[k << 4 | n]) for _, dc, ac in f0.order for k, n in ((0, dc), (1, ac))}
    across = [-(-f.width // (8 if single else 8 * broad)) for f in frames]
    down = [-(-f.height // (8 if single else 8 * tall)) for f in frames]
    units = np.array([a * d for a, d in zip(across, down, strict=True)], np.int64)
    # intervals: cut at restart markers, drop them and the stuffed zeros
    spans = np.array([f.scan for f in frames], np.int64).reshape(-1, 2)
    size = spans[:, 1] - spans[:, 0]
    scan = data[spans_index(spans[:, 0], size)]
    edge = offsets_of(size)
    ahead = np.append(scan[1:], 0)
    mark = (scan == 0xFF) & (ahead >= 0xD0) & (ahead <= 0xD7)
    behind = np.concatenate(([False], scan[:-1] == 0xFF))
    behind[edge[:-1][edge[:-1] < len(scan)]] = False
    drop = mark | (behind & ((scan == 0) | np.concatenate(([False], mark[:-1]))))
    kept = np.concatenate(([0], np.cumsum(~drop)))
    per = np.array([f.restart or max(1, int(u)) for f, u in zip(frames, units, strict=True)], np.int64)
    lanes_of = np.maximum(1, -(-units // per))
    points = np.flatnonzero(mark)
    owner = np.searchsorted(edge, points, side="right") - 1
    if (np.bincount(owner, minlength=len(frames)) != lanes_of - 1).any():
        raise ValueError("restart markers don't fit the frame")
    starts = np.sort(np.concatenate((edge[:-1], points)), kind="stable")
    pos = kept[starts] * 8
    lane_frame = np.repeat(np.arange(len(frames)), lanes_of)
    lane_no = np.arange(len(lane_frame)) - np.repeat(offsets_of(lanes_of)[:-1], lanes_of)
    todo = np.minimum(per[lane_frame], units[lane_frame] - lane_no * per[lane_frame])
    clean = np.concatenate((scan[~drop], np.full(8, 0xFF, np.uint8))).astype(np.uint32)
    window = clean[:-3] << 24 | clean[1:-2] << 16 | clean[2:-1] << 8 | clean[3:]
    order = np.argsort(-todo, kind="stable")
    pos, todo, lanes = pos[order], todo[order], order
    steps = int(todo[0]) if len(todo) else 0
    luma = [i for i, b in enumerate(blocks) if b[0] == 0]
    values = np.zeros((len(lanes), steps, len(luma)), np.int16)
    before = {c: np.zeros(len(lanes), np.int32) for c, _, _ in blocks}
    active = np.searchsorted(-todo, -np.arange(steps), side="left")
    limit = len(window) * 8 - 1
    for step in range(steps):
        n = int(active[step])
        p = pos[:n]
        for b, (c, dc, ac) in enumerate(blocks):
            got = luts[dc][window[p >> 3] >> (16 - (p & 7)).astype(np.uint32) & 0xFFFF]
            p = p + (got >> 8)
            s = (got & 0xFF).astype(np.int64)
            raw = (window[p >> 3] << (p & 7).astype(np.uint32)).astype(np.int64) & 0xFFFFFFFF
            raw >>= 32 - s
            half = (np.int64(1) << s) >> 1
            before[c][:n] += np.where(raw < half, raw - 2 * half + 1, raw).astype(np.int32)
            p = p + s
            if c == 0:
                values[:n, step, luma.index(b)] = before[c][:n]
            # the 63 other terms only move the position
            k, at = np.ones(n, np.int64), None
            while True:
                q = p if at is None else p[at]
                np.minimum(q, limit, out=q)
                got = luts[16 | ac][window[q >> 3] >> (16 - (q & 7)).astype(np.uint32) & 0xFFFF]
                run, s = got >> 4 & 15, got & 15
                q = q + (got >> 8) + s
                if at is None and not (got & 0xFF).any():
                    p = q
                    break
                end = (s == 0) & (run < 15)
                step_k = np.where(end, 64, run.astype(np.int64) + 1)
                if at is None:
                    p, k = q, k + step_k
                    at = np.flatnonzero(k < 64)
                else:
                    p[at] = q
                    k[at] += step_k
                    at = at[k[at] < 64]
                if not len(at):
                    break
        pos[:n] = p
    back = np.empty_like(lanes)
    back[lanes] = np.arange(len(lanes))
    out, first = [], offsets_of(lanes_of)
    h, v = (1, 1) if single else f0.parts[0][1:3]
    for i, f in enumerate(frames):
        own = back[first[i] : first[i + 1]]
        flat = values[own].reshape(-1, len(luma))
        sizes = todo[own]
        if (sizes != steps).any():
            flat = np.concatenate([values[j, :n] for j, n in zip(own.tolist(), sizes.tolist(), strict=True)])
        grid = flat.reshape(down[i], across[i], v, h).transpose(0, 2, 1, 3).reshape(down[i] * v, across[i] * h)
        rows, cols = -(-(-(-f.height * v // (1 if single else tall))) // 8), -(-(-(-f.width * h // (1 if single else broad))) // 8)
        level = np.rint(grid[:rows, :cols].astype(np.float64) * f.steps[f.parts[0][3]] / 8) + 128
        out.append(np.clip(level, 0, 255).astype(np.uint8))
    return out


def thumbnail_hash(image: np.ndarray) -> str:
    """64-bit difference hash of a thumbnail: means of 8 x 9 cells, each compared with its right neighbour."""
    if not image.size:
        return "0" * 16
    rows = np.unique(np.linspace(0, image.shape[0], 9).astype(int)[:-1])
    cols = np.linspace(0, image.shape[1], 10).astype(int)[:-1]
    sums = np.add.reduceat(np.add.reduceat(image, rows, axis=0, dtype=np.int64), cols, axis=1) if image.shape[1] >= 9 else np.zeros((len(rows), 9), np.int64)
    bits = np.zeros((8, 8), bool)
    bits[: len(sums)] = sums[:, :-1] < sums[:, 1:]
    return np.packbits(bits).tobytes().hex()


def encode_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: each text's UTF-8 bytes, padded with bytes 32 to a positive multiple of
    UNIT, as the DC samples of a baseline JPEG. Null counts as empty; repeated rows stay."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, text in text_slices(batches, TEXT_SLICE):
            body, off = raw_utf8(text)
            size = np.diff(off)
            units = np.maximum(1, -(-size // UNIT))
            padded = np.full(int(units.sum()) * UNIT, 32, np.uint8)
            padded[spans_index(offsets_of(units)[:-1] * UNIT, size)] = body
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(size), pa.array(encode_payloads(padded, units), pa.binary())], ["doc_id", "n_bytes", "media"])

    return as_docs(df, id_col, text_col).mapInArrow(encode, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Reads the stored JPEG bytes back: payload digests, stored size and digest, dimensions and thumbnail hash.

    A null or broken ``media`` value raises; frames of one value are stacked into one thumbnail.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, sizes = 0, np.cumsum(pc.binary_length(batch.column("media")).to_numpy(zero_copy_only=False).astype(np.int64))
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + 2 * TEXT_SLICE, side="right")))
                yield read(batch.slice(at, stop - at))
                at = stop

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        stored = batch.column("media").to_pylist()
        frames, count, base = [], [], 0
        for data in stored:
            own = parse_frames(data)
            for f in own:
                f.scan = (f.scan[0] + base, f.scan[1] + base)
            frames += own
            count.append(len(own))
            base += len(data)
        thumbs = decode_thumbnails(np.frombuffer(b"".join(stored), np.uint8), frames)
        cols: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        at = 0
        for data, n in zip(stored, count, strict=True):
            image = thumbs[at] if n == 1 else np.concatenate(thumbs[at : at + n])
            payload = image.tobytes()
            cols["payload_bytes"].append(len(payload))
            cols["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            cols["tail_crc32"].append(zlib.crc32(payload[-16:]))
            cols["media_bytes"].append(len(data))
            cols["media_sha256"].append(hashlib.sha256(data).hexdigest())
            cols["feature"].append(f"{8 * image.shape[1]}x{8 * image.shape[0]}:{thumbnail_hash(image)}")
            at += n
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *map(pa.array, cols.values())], ["doc_id", "n_bytes", *cols])

    return media.mapInArrow(features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def stored_features(df: DataFrame) -> DataFrame:
    """Write the media column as a table in the shared folder and compute the features of the bytes read back."""
    return media_features(saved(encode_media(df), "media"))

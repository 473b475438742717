"""Media columns (operator 2): baseline JPEG in numpy.

`decode_dc` parses the markers of a baseline stream, Huffman-decodes its scans (all restart intervals of many pictures
step by step together) and keeps the DC coefficients of the luminance: a thumbnail of one sample for each 8x8 block.
`encode_rows` stores bytes losslessly in JPEG's own unit: a byte is the quantised DC coefficient of one block, 64 blocks
a row, one restart interval a row; the quantiser 8 makes each block a square of exactly that sample. A payload of more
than 8,191 rows goes to several pictures, one after the other.

Defined results: a null text is an empty one; an empty text is one row of 64 zero bytes; equal texts have equal media;
rows are kept as they are, repeated ones too, with any doc_id or none; a very long text is one picture after the other, all
of them in memory for that text alone; an empty table gives no rows; other columns are ignored, whatever their names.
"""

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_text, table, written

ACROSS, MOST_ROWS = 64, 8191
#: Our Huffman tables: counts of codes of 1 to 16 bits, and the symbols. DC: sizes 3 to 7 in 3 bits, the others in 4. AC: the end of the block in 1 bit.
DC_COUNTS, DC_SYMBOLS = bytes([0, 0, 5, 4] + [0] * 12), bytes([3, 4, 5, 6, 7, 0, 1, 2, 8])
AC_COUNTS, AC_SYMBOLS = bytes([1] + [0] * 15), bytes([0])


def _codes(counts: bytes, symbols: bytes):
    """(symbol, length, code) of a table, in its order."""
    code, k = 0, 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            yield symbols[k], bits, code
            code, k = code + 1, k + 1
        code <<= 1


@lru_cache(maxsize=256)
def lookup(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits ahead: length of the code that they begin with (0: none), and its symbol."""
    lengths, values = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    for symbol, bits, code in _codes(counts, symbols):
        lo = code << (16 - bits)
        lengths[lo : lo + (1 << (16 - bits))] = bits
        values[lo : lo + (1 << (16 - bits))] = symbol
    return lengths, values


@lru_cache(maxsize=64)
def whole_blocks(dc: tuple[bytes, bytes], ac: tuple[bytes, bytes]) -> np.ndarray:
    """For each 16 bits ahead that hold a whole block without other coefficients: (difference + 32768) * 32 + bits; else 0."""
    (dc_len, dc_val), (ac_len, ac_val) = lookup(*dc), lookup(*ac)
    peek = np.arange(1 << 16)
    length, size = dc_len.astype(np.int64), dc_val.astype(np.int64)
    fits = (length > 0) & (length + size < 16)
    size = np.where(fits, size, 0)
    extra = (peek >> (16 - length - size).clip(0)) & ((1 << size) - 1)
    step = np.where((size > 0) & (2 * extra < 1 << size), extra - (1 << size) + 1, extra)
    rest = (peek << (length + size)) & 0xFFFF
    used = length + size + ac_len[rest]
    return np.where(fits & (ac_len[rest] > 0) & (ac_val[rest] == 0) & (used <= 16), (step + 32768) * 32 + used, 0).astype(np.int32)


@lru_cache(maxsize=1)
def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for a block whose DC differs by -255 to 255 from the one before: size, difference, end."""
    code = {s: (bits, c) for s, bits, c in _codes(DC_COUNTS, DC_SYMBOLS)}
    value, n = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        bits, c = code[size]
        extra = d if d >= 0 else d + (1 << size) - 1
        value[d + 255], n[d + 255] = ((c << size) | extra) << 1, bits + size + 1
    return value, n


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int, note: bytes) -> bytes:
    quant = _segment(0xDB, bytes([0]) + bytes([8] * 64))
    frame = _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, ACROSS * 8, 1) + bytes([1, 0x11, 0]))
    tables = _segment(0xC4, bytes([0x00]) + DC_COUNTS + DC_SYMBOLS + bytes([0x10]) + AC_COUNTS + AC_SYMBOLS)
    return b"\xff\xd8" + _segment(0xFE, note) + quant + frame + tables + _segment(0xDD, struct.pack(">H", ACROSS)) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def encode_rows(payloads: list[bytes], notes: list[bytes]) -> list[bytes]:
    """A stream of pictures for each payload of a multiple of 64 bytes; the note goes to the comment."""
    value, bits = _block_codes()
    grid = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ACROSS).astype(np.int16)
    step = np.empty_like(grid)
    step[:, 0] = grid[:, 0] - 128 + 255
    step[:, 1:] = grid[:, 1:] - grid[:, :-1] + 255
    n = bits[step]
    ends = np.cumsum(n, axis=1)
    row_bytes = (ends[:, -1] + 7) // 8
    row_end = np.cumsum(row_bytes)
    at = ends - n + ((row_end - row_bytes) * 8)[:, None]
    word = (value[step] << (24 - n - (at & 7)).astype(np.uint32)).ravel()  # at most 13 + 7 bits
    first = (at >> 3).ravel()
    total = int(row_end[-1])
    data = np.zeros(total + 2)
    for k, shift in enumerate((16, 8, 0)):
        data[k : k + total] += np.bincount(first, (word >> np.uint32(shift)) & np.uint32(255), total)[:total]
    data = data[:total].astype(np.uint8)
    data[row_end - 1] |= ((1 << (-ends[:, -1] % 8)) - 1).astype(np.uint8)

    rows = [len(p) // ACROSS for p in payloads]
    first_row = np.concatenate([[0], np.cumsum(rows)])
    within = np.arange(len(grid)) - np.repeat(first_row[:-1], rows)
    last = np.zeros(len(grid), bool)
    last[first_row[1:] - 1] = True
    last |= within % MOST_ROWS == MOST_ROWS - 1
    marked = np.flatnonzero(~last)
    extra = (data == 255).astype(np.int64)  # a zero after each FF
    stuffed = extra[row_end[marked] - 1].copy()
    extra[row_end[marked] - 1] += 2
    upto = np.cumsum(extra + 1)
    out = np.zeros(int(upto[-1]), np.uint8)
    start = upto - extra - 1
    out[start] = data
    mark = start[row_end[marked] - 1] + 1 + stuffed
    out[mark] = 255
    out[mark + 1] = 0xD0 + (within[marked] % MOST_ROWS) % 8
    row_stop = upto[row_end - 1]
    streams = []
    for i, note in enumerate(notes):
        parts, r = [], int(first_row[i])
        while r < first_row[i + 1]:
            to = min(r + MOST_ROWS, int(first_row[i + 1]))
            lo = int(row_stop[r - 1]) if r else 0
            parts += [_header(to - r, note), out[lo : int(row_stop[to - 1])].tobytes(), b"\xff\xd9"]
            r = to
        streams.append(b"".join(parts))
    return streams


class Picture:
    """What the markers of one picture say; scan: the bytes of its only scan."""

    def __init__(self):
        self.quant, self.huff, self.comps, self.interval, self.notes = {}, {}, [], 0, []


def parse(data: bytes) -> list[Picture]:
    """The pictures of a stream. Only baseline ones with one interleaved scan, or one component."""
    found, i = [], 0
    while i < len(data):
        if data[i : i + 2] != b"\xff\xd8":
            raise ValueError("not a JPEG stream")
        p, i = Picture(), i + 2
        while True:
            if data[i] != 0xFF:
                raise ValueError("a marker is missing")
            while data[i + 1] == 0xFF:
                i += 1
            m = data[i + 1]
            size = struct.unpack_from(">H", data, i + 2)[0]
            body, i = data[i + 4 : i + 2 + size], i + 2 + size
            if m == 0xDB:
                while body:
                    wide = body[0] >> 4
                    p.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8)
                    body = body[65 + 64 * wide :]
            elif m == 0xC4:
                while body:
                    n = sum(body[1:17])
                    p.huff[body[0]] = (body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif m == 0xC0:
                p.height, p.width = struct.unpack_from(">HH", body, 1)
                p.comps = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
            elif m in (0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF):
                raise ValueError("not a baseline picture")
            elif m == 0xDD:
                p.interval = struct.unpack(">H", body)[0]
            elif m == 0xFE:
                p.notes.append(body)
            elif m == 0xDA:
                p.tables = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])}
                break
        if set(p.tables) != {c[0] for c in p.comps}:
            raise ValueError("several scans")
        end = data.find(b"\xff", i)
        while data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
            end = data.find(b"\xff", end + 2)
            if end < 0:
                raise ValueError("the scan has no end")
        p.scan, i = data[i:end], end
        if data[i : i + 2] != b"\xff\xd9":
            raise ValueError("the picture has no end")
        i += 2
        if len(p.comps) == 1:  # not interleaved: a unit is a block
            p.comps = [(p.comps[0][0], 1, 1, p.comps[0][3])]
        p.hmax, p.vmax = max(c[1] for c in p.comps), max(c[2] for c in p.comps)
        p.across, p.down = -(-p.width // (8 * p.hmax)), -(-p.height // (8 * p.vmax))
        found.append(p)
    return found


def _lanes(scans: list[bytes]):
    """Scans without stuffing and markers: the bytes, where each restart interval starts, and its scan."""
    raw = np.frombuffer(b"".join(scans), np.uint8)
    size = np.fromiter(map(len, scans), np.int64, len(scans))
    after = np.flatnonzero(raw[:-1] == 255)
    kind = raw[after + 1]
    drop = np.zeros(len(raw), bool)
    drop[after[kind == 0] + 1] = True
    marks = after[(kind >= 0xD0) & (kind <= 0xD7)]
    drop[marks] = drop[marks + 1] = True
    start = np.sort(np.concatenate([np.cumsum(size) - size, marks + 2]))
    kept = np.concatenate([[0], np.cumsum(~drop)])
    return raw[~drop], kept[start], np.searchsorted(np.cumsum(size), start, side="right")


def _decode(words: np.ndarray, bit: np.ndarray, units: np.ndarray, pattern: list, out: np.ndarray, to: np.ndarray) -> None:
    """Decodes all lanes together, block by block. pattern: (component, whole blocks, DC table, AC table) of a unit's blocks, the luminance first. out[to[lane] + i] gets the i-th luminance DC of the lane."""
    lanes, last = np.arange(len(bit)), {p[0]: np.zeros(len(bit), np.int64) for p in pattern}
    to, luma = to.copy(), pattern[0][0]

    def ahead(at):
        return ((words[at >> 3].astype(np.uint64) << np.uint64(32)) | words[(at >> 3) + 4]) << (at & 7).astype(np.uint64)

    for unit in range(int(units.max(initial=0))):
        if not (more := units[lanes] > unit).all():
            lanes = lanes[more]
        for comp, quick, (dc_len, dc_val), (ac_len, ac_val) in pattern:
            at = bit[lanes]
            peek = (words[at >> 3] >> (16 - (at & 7)).astype(np.uint32)) & np.uint32(0xFFFF)
            if (fast := quick[peek]).all():
                last[comp][lanes] += (fast >> 5) - 32768
                bit[lanes] = at + (fast & 31)
                if comp == luma:
                    out[to[lanes]] = last[comp][lanes]
                    to[lanes] += 1
                continue
            w = ahead(at)
            peek = (w >> np.uint64(48)).astype(np.int64)
            length, size = dc_len[peek].astype(np.uint64), dc_val[peek].astype(np.uint64)
            extra = ((w << length) >> np.uint64(1) >> (np.uint64(63) - size)).astype(np.int64)
            low = np.int64(1) << size.astype(np.int64)
            last[comp][lanes] += np.where((size > 0) & (2 * extra < low), extra - low + 1, extra)
            peek = ((w << (length + size)) >> np.uint64(48)).astype(np.int64)
            if comp == luma:
                out[to[lanes]] = last[comp][lanes]
                to[lanes] += 1
            symbol = ac_val[peek]
            bit[lanes] = at + (length + size).astype(np.int64) + ac_len[peek]
            rest = np.flatnonzero(symbol != 0)
            if not len(rest):
                continue
            go, s, k = lanes[rest], symbol[rest].astype(np.int64), np.ones(len(rest), np.int64)
            while True:  # coefficients that are not kept, up to the end of each block
                bit[go] += s & 15
                k += (s >> 4) + 1
                going = k < 64
                if not going.any():
                    break
                go, k = go[going], k[going]
                peek = (ahead(bit[go]) >> np.uint64(48)).astype(np.int64)
                s = ac_val[peek].astype(np.int64)
                bit[go] += ac_len[peek]
                on = s != 0
                go, s, k = go[on], s[on], k[on]
                if not len(go):
                    break


def decode_dc(streams: list[bytes]) -> list[list[tuple[Picture, np.ndarray]]]:
    """For each stream its pictures with their luminance thumbnails: one sample (0 to 255) for each 8x8 block."""
    parsed = [parse(s) for s in streams]
    flat = [p for ps in parsed for p in ps]
    like: dict[tuple, list[int]] = {}
    for i, p in enumerate(flat):
        like.setdefault((tuple(sorted(p.huff.items())), tuple(p.tables[c[0]] + c[1:3] for c in p.comps)), []).append(i)
    thumbs: list = [None] * len(flat)
    for same in like.values():
        head = flat[same[0]]
        tables = {c[0]: (head.huff[head.tables[c[0]][0]], head.huff[16 + head.tables[c[0]][1]]) for c in head.comps}
        pattern = [(c[0], whole_blocks(*tables[c[0]]), *(lookup(*t) for t in tables[c[0]])) for c in head.comps for _ in range(c[1] * c[2])]
        data, start, scan = _lanes([flat[i].scan for i in same])
        b = np.concatenate([data, np.full(16, 255, np.uint8)]).astype(np.uint32)
        words = (b[:-3] << np.uint32(24)) | (b[1:-2] << np.uint32(16)) | (b[2:-1] << np.uint32(8)) | b[3:]
        total = np.array([flat[i].across * flat[i].down for i in same])
        interval = np.array([flat[i].interval for i in same])
        interval = np.where(interval > 0, interval, total)
        nth = np.arange(len(start)) - np.searchsorted(scan, scan)
        units = np.minimum(interval[scan], total[scan] - nth * interval[scan])
        per = head.comps[0][1] * head.comps[0][2]
        base = np.concatenate([[0], np.cumsum(total * per)])
        out = np.zeros(int(base[-1]), np.int64)
        _decode(words, start.astype(np.int64) * 8, units, pattern, out, base[scan] + nth * interval[scan] * per)
        for n, i in enumerate(same):
            p, (h, v) = flat[i], head.comps[0][1:3]
            dc = out[base[n] : base[n + 1]].reshape(p.down, p.across, v, h).transpose(0, 2, 1, 3).reshape(p.down * v, p.across * h)
            thumb = np.clip(np.floor_divide(dc * int(p.quant[p.comps[0][3]][0]) + 4, 8) + 128, 0, 255).astype(np.uint8)
            thumbs[i] = thumb[: -(-p.height * v // (8 * p.vmax)), : -(-p.width * h // (8 * p.hmax))]
    pairs = iter(zip(flat, thumbs, strict=True))
    return [[next(pairs) for _ in ps] for ps in parsed]


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64 bits: which of 8x8 areas are lighter than their mean."""
    r = np.linspace(0, thumb.shape[0], 9).astype(int)[:8]
    c = np.linspace(0, thumb.shape[1], 9).astype(int)[:8]
    sums = np.add.reduceat(np.add.reduceat(thumb.astype(np.int64), r, axis=0), c, axis=1)
    n = np.maximum(np.diff([*r, thumb.shape[0]]), 1)[:, None] * np.maximum(np.diff([*c, thumb.shape[1]]), 1)[None, :]
    means = sums * 1.0 / n
    return np.packbits(means > means.mean()).tobytes().hex()


def with_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes and media of docs: the text's bytes, padded to rows of 64, as JPEG."""

    def encode(texts):
        media = encode_rows([t + bytes(-len(t) % ACROSS if t else ACROSS) for t in texts], [str(len(t)).encode() for t in texts])
        return {"n_bytes": np.array([len(t) for t in texts], np.int64), "media": media}

    return per_text(docs, ["doc_id"], encode, "n_bytes long, media binary", text)


def media_features(media: DataFrame) -> DataFrame:
    """What the stored bytes say: payload, dimensions and thumbnail hash."""
    added = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, thumb_hash string"

    def read(streams):
        rows = []
        for stream, pictures in zip(streams, decode_dc(streams), strict=True):
            thumb = pictures[0][1] if len(pictures) == 1 else np.concatenate([t for _, t in pictures])
            payload, p, mark = thumb.tobytes(), pictures[0][0], thumbnail_hash(thumb)
            high = sum(q.height for q, _ in pictures)
            rows.append((int(p.notes[0]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stream), hashlib.sha256(stream).hexdigest(), f"{p.width}x{high}:{mark}", p.width, high, mark))
        got = dict(zip((x.split()[0] for x in added.split(", ")), zip(*rows, strict=True), strict=True))
        return got | {k: np.array(got[k], np.int32) for k in ("width", "height")}

    return per_text(media, ["doc_id"], read, added, "media")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return media_features(written(with_media(docs), "media"))

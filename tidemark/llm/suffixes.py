"""Suffix-array dedup (operator 1): the collection's Burrows-Wheeler transform, built column by column.

`Columns` indexes a collection of short strings: each round inserts one symbol of every string, from its last to its first,
at the place that the transform's own last-to-first mapping gives, and updates the common prefixes of neighbours. Runs of
neighbours that share `size` bytes are the equal substrings of that size.

A document is cut so that such a collection fits a task: every window of `size` bytes belongs to its least 20-gram (by
hash), and windows in a row with the same one form a segment. Equal windows have equal 20-grams, so segments meet by the
hash of theirs. Segments alike as a whole are settled by the least doc_id alone, before the shuffle and after it; segments
that share a 20-gram but differ are cut at it into halves, meet again by the 35 or 36 bytes that a half's windows share, are
cut twice more there in the same way, and what still differs goes, bucket by bucket, into a column-wise index. Only hashes,
places and the differing halves move.

The index lives in memory, bucket by bucket (a bucket answers to 4 MB of text); what lies between the stages is in files
of the shared folder, written and read in sequence.

Defined results: a null text is an empty one; a text of fewer than `size` bytes keeps all; a byte goes if a smaller doc_id
has the substring, so that rows that repeat a doc_id do not remove each other, and a null doc_id is the least; a very long
text is cut like any other; an empty table gives no rows; other columns are ignored, whatever their names.
"""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, as_bytes, dropped, grouped, mix64, powers, table, written
from .common import _BYTE as BYTE
from .packed import _split, n_buckets, row_key

SIZE, GRAM = 50, 20
LEFT = (SIZE - GRAM) // 2
SPANS = "bucket int, rows binary, who binary, spans binary"
SEGMENTS = f"{SPANS}, ids binary, grams binary, whole binary"
HALVES = f"{SPANS}, ids binary, grams binary, heads binary, data binary, sizes binary"
NO_ID = -(2**63)
#: Times that halves are cut again within their bucket before they are indexed.
CUTS = 2
#: Text bytes for each bucket: with 16 MB a Python worker took up to 582 MB, and an executor 3 GB.
BUCKET_BYTES = 4_000_000
#: Bytes of text at once, and segments that a task holds before it packs them.
HALF_GROUP, HELD = 1_000_000, 500_000
SPAN_COLUMNS = ["bucket", "rows", "who", "spans"]


class Prefix:
    """Hashes of any stretches of bytes."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = powers(len(data) + 1)
        self.total = np.empty(len(data) + 1, U64)
        self.total[0] = 0
        np.cumsum(BYTE[data] * power[: len(data)], out=self.total[1:])

    def hashes(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mix64((self.total[start + size] - self.total[start]) * self.inverse[start] + size.astype(U64))


class Columns:
    """The index of strings data[begin:end]. After build(): string and left (bytes from there to its end) of each suffix in
    order, and common (bytes shared with the suffix before, the strings' ends being all different)."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray):
        self.data, self.begin, self.end = data, begin, end

    def build(self) -> "Columns":
        k, size = len(self.begin), self.end - self.begin
        symbol = np.where(size > 0, self.data[np.maximum(self.end - 1, 0)].astype(np.uint16) + 1, 0).astype(np.uint16)
        common, string, left = np.zeros(k, np.uint8), np.arange(k, dtype=np.uint32), np.zeros(k, np.uint8)
        place = np.arange(k)
        for length in range(1, int(size.max(initial=0)) + 1):
            active = np.flatnonzero(size >= length)
            at = place[active]
            order = np.argsort(symbol, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            ended = len(symbol) - np.count_nonzero(symbol)
            mine = rank[at]
            new = k + mine - ended
            # the neighbours with the same first symbol, and what is common with them
            c, last = symbol[at], len(order) - 1
            before, after = order[np.maximum(mine - 1, 0)], order[np.minimum(mine + 1, last)]
            has_before, has_after = (mine > 0) & (symbol[before] == c), (mine < last) & (symbol[after] == c)
            least = self._least(common)
            with_before = np.where(has_before, 1 + least(np.where(has_before, before + 1, at), at).astype(np.int64), 0)
            with_after = np.where(has_after, 1 + least(np.where(has_after, at + 1, at), np.where(has_after, after, at)).astype(np.int64), 0)
            n = len(symbol) + len(active)
            old = np.ones(n, bool)
            old[new] = False
            next_symbol = np.where(size[active] > length, self.data[np.maximum(self.end[active] - length - 1, 0)].astype(np.uint16) + 1, 0)
            parts = []
            for have, add in ((symbol, next_symbol), (common, with_before), (string, active), (left, length)):
                to = np.empty(n, have.dtype)
                to[old] = have
                to[new] = add
                parts.append(to)
            symbol, common, string, left = parts
            inside = new + 1 < n
            common[new[inside] + 1] = with_after[inside]
            place[active] = new
        self.common, self.string, self.left = common, string, left
        return self

    @staticmethod
    def _least(values: np.ndarray):
        """Least of values[lo..hi], for many ranges."""
        levels = [values]

        def ask(lo, hi):
            power = np.frexp((hi - lo + 1).astype(float))[1] - 1
            while len(levels) <= power.max(initial=0):
                half = 1 << (len(levels) - 1)
                levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
            out = np.empty(len(lo), values.dtype)
            for p in np.unique(power):
                i = np.flatnonzero(power == p)
                out[i] = np.minimum(levels[p][lo[i]], levels[p][hi[i] + 1 - (1 << p)])
            return out

        return ask

    def smaller(self, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(string, place in it) of the windows of size bytes that a string of smaller id has too."""
        group = np.flatnonzero(self.common < size)
        least = np.minimum.reduceat(ids[self.string], group) if len(group) else ids[:0]
        found = np.flatnonzero((self.left >= size) & (ids[self.string] > np.repeat(least, np.diff(np.append(group, len(self.string))))))
        s = self.string[found]
        return s, (self.end - self.begin)[s] - self.left[found]


def segments_of(texts: list[bytes], size: int = SIZE, gram: int = GRAM):
    """For each segment: its text, place in it, windows, place of its gram in it, the gram's hash and that of the whole."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    n = len(buf)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    if n < size:
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, U64),) * 2
    begin = np.cumsum(lengths) - lengths
    prefix = Prefix(buf)
    total, inverse = prefix.total, prefix.inverse
    grams = mix64((total[gram:] - total[:-gram]) * inverse[: n - gram + 1])
    bits = U64(max(24, n.bit_length()))
    key = ((grams >> bits) << bits) | np.arange(len(grams), dtype=U64)
    span, low = size - gram + 1, key
    have = 1
    while have < span:  # least of `span` neighbours by doubling
        step = min(have, span - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    at = (low & ((U64(1) << bits) - U64(1))).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), lengths)[: len(at)]
    ok = np.arange(len(at)) + size <= (begin + lengths)[doc]
    first = ok.copy()
    first[1:] &= ~ok[:-1] | (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(first)
    upto = np.concatenate([[0], np.cumsum(ok)])
    windows = np.diff(np.append(upto[start], upto[-1]))
    stop = start + windows + size - 1
    whole = mix64((total[stop] - total[start]) * inverse[start] + windows.astype(U64))
    return doc[start], start - begin[doc[start]], windows, at[start] - start, grams[at[start]], whole


def _pack(rows, spans, bucket, buckets, **more) -> list[dict]:
    out = []
    for b, i in _split(bucket, buckets):
        i = i[np.argsort(rows[i], kind="stable")]
        names, who = np.unique(rows[i], return_inverse=True)
        out.append({"bucket": b, "rows": names.tobytes(), "who": who.astype(np.uint32).tobytes(), "spans": spans[i].tobytes()} | {k: v[i].tobytes() for k, v in more.items()})
    return out


def _unpack(pdf: pd.DataFrame, **kinds) -> list[np.ndarray]:
    rows = [np.frombuffer(r, U64)[np.frombuffer(w, np.uint32)] for r, w in zip(pdf["rows"], pdf["who"], strict=True)]
    return [np.concatenate([np.empty(0, U64), *rows])] + [np.frombuffer(b"".join(pdf[k]), d) for k, d in kinds.items()]


def settle(grams, whole, ids) -> tuple[np.ndarray, np.ndarray]:
    """Of segments alike as a whole those of larger ids (gone), and those left whose gram other segments have too (open)."""
    order = np.lexsort((ids, whole, grams))
    g, w, d = grams[order], whole[order], ids[order]
    new = np.append(True, (g[1:] != g[:-1]) | (w[1:] != w[:-1]))[: len(g)]
    start = np.flatnonzero(new)
    least = np.repeat(d[start], np.diff(np.append(start, len(g))))
    gone = d > least
    kinds, which = np.unique(g, return_inverse=True)
    many = np.bincount(which, new, len(kinds)) > 1
    return order[gone], order[~gone & many[which]]


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> U64(20)) % U64(buckets)).astype(np.int64)


def by_row(rows: np.ndarray, buckets: int) -> np.ndarray:
    return (rows % U64(buckets)).astype(np.int64)


def _span(packed: np.ndarray) -> np.ndarray:
    """place and windows, without the gram's place between."""
    return (packed >> U64(16)) << U64(8) | packed & U64(255)


def find_segments(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed segments of docs(id, row, text) by gram; those settled in their task by row, without grams."""

    def flush(parts):
        rows, spans, ids, grams, whole = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((ids, whole, grams))
        g, w, d = grams[order], whole[order], ids[order]
        start = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (w[1:] != w[:-1]))[: len(g)])
        gone = order[d > np.repeat(d[start], np.diff(np.append(start, len(g))))]
        out = _pack(rows[gone], _span(spans[gone]), by_row(rows[gone], buckets), buckets)
        keep = np.ones(len(rows), bool)
        keep[gone] = False
        out += _pack(rows[keep], spans[keep], _bucket(grams[keep], buckets), buckets, ids=ids[keep], grams=grams[keep], whole=whole[keep])
        return pd.DataFrame(out, columns=[*SPAN_COLUMNS, "ids", "grams", "whole"])

    def find(batches):
        parts, held = [], 0
        for b in batches:
            texts, rows, ids = as_bytes(b["text"]), b["row"].to_numpy(np.int64).view(U64), b["id"].to_numpy(np.int64)
            for lo, hi in grouped(texts, HALF_GROUP):
                doc, place, windows, gram_at, grams, whole = segments_of(texts[lo:hi])
                if len(doc):
                    parts.append((rows[lo:hi][doc], (place << 16 | gram_at << 8 | windows).astype(U64), ids[lo:hi][doc], grams, whole))
                    held += len(doc)
                if held >= HELD:
                    yield flush(parts)
                    parts, held = [], 0
        if parts:
            yield flush(parts)

    return docs.mapInPandas(find, SEGMENTS)


def settle_segments(found: DataFrame, buckets: int) -> DataFrame:
    """Of packed segments, by row: those gone (no grams), and those still open (with grams)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        keyed = pdf["grams"].map(lambda x: x is not None and len(x) > 0)
        rows, spans, ids, grams, whole = _unpack(pdf[keyed], spans=U64, ids=np.int64, grams=U64, whole=U64)
        gone, open_ = settle(grams, whole, ids)
        done = _unpack(pdf[~keyed], spans=U64)
        rows0, spans0 = np.concatenate([done[0], rows[gone]]), np.concatenate([done[1], _span(spans[gone])])
        out = _pack(rows0, spans0, by_row(rows0, buckets), buckets) + _pack(rows[open_], spans[open_], by_row(rows[open_], buckets), buckets, grams=grams[open_])
        return pd.DataFrame(out, columns=[*SPAN_COLUMNS, "grams"])

    return found.groupBy("bucket").applyInPandas(one, f"{SPANS}, grams binary")


def open_halves(docs: DataFrame, open_segments: DataFrame, buckets: int) -> DataFrame:
    """The halves of open segments with their bytes, packed by what their windows share."""

    def one(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        rows, spans = _unpack(found, spans=U64)
        order = np.argsort(rows, kind="stable")
        rows, spans = rows[order], spans[order].astype(np.int64)
        texts = texts.drop_duplicates("row")
        own = texts["row"].to_numpy(np.int64).view(U64)
        lo, hi = np.searchsorted(rows, own), np.searchsorted(rows, own, side="right")
        some = np.flatnonzero(hi > lo)
        raw, ids = as_bytes(texts["text"].iloc[some]), texts["id"].to_numpy(np.int64)[some]
        parts = []
        for a, z in grouped(raw, HALF_GROUP):
            mine = [spans[lo[k] : hi[k]] for k in some[a:z]]
            doc, packed = np.repeat(np.arange(z - a), list(map(len, mine))), np.concatenate(mine)
            place, gram_at, windows = packed >> 16, packed >> 8 & 255, packed & 255
            data = np.frombuffer(b"".join(raw[a:z]), np.uint8)
            sizes = np.fromiter(map(len, raw[a:z]), np.int64, z - a)
            at = (np.cumsum(sizes) - sizes)[doc] + place
            total = Prefix(data)
            # windows that begin LEFT bytes or more before the gram share those and the gram; the others the gram and LEFT + 1 after it
            n_left = np.clip(gram_at - LEFT + 1, 0, windows)
            for first, n, head, width in ((np.zeros_like(place), n_left, gram_at - LEFT, LEFT + GRAM), (n_left, windows - n_left, gram_at - n_left, GRAM + LEFT + 1)):
                i = np.flatnonzero(n > 0)
                begin = (at + first)[i]
                shared = total.hashes(begin + head[i], np.full(len(i), width))
                whole = data.tobytes()
                parts.append((own[some[a:z]][doc[i]], ((place + first)[i] << 8 | n[i]).astype(U64), ids[a:z][doc[i]], shared, (head[i] << 1 | (width > LEFT + GRAM)).astype(np.uint8), [whole[s:e] for s, e in zip(begin.tolist(), (begin + n[i] + SIZE - 1).tolist(), strict=True)]))
        if not parts:
            return pd.DataFrame(columns=[*SPAN_COLUMNS, "ids", "grams", "heads", "data", "sizes"])
        rows, spans, ids, grams, heads = (np.concatenate(x) for x in list(zip(*parts, strict=True))[:5])
        pieces = [x for p in parts for x in p[5]]
        out = []
        for b, i in _split(_bucket(grams, buckets), buckets):
            names, who = np.unique(rows[i], return_inverse=True)
            mine = [pieces[j] for j in i.tolist()]
            out.append({"bucket": b, "rows": names.tobytes(), "who": who.astype(np.uint32).tobytes(), "spans": spans[i].tobytes(), "ids": ids[i].tobytes(), "grams": grams[i].tobytes(), "heads": heads[i].tobytes(), "data": b"".join(mine), "sizes": np.fromiter(map(len, mine), np.uint8, len(mine)).tobytes()})
        return pd.DataFrame(out)

    return docs.groupBy("bucket").cogroup(open_segments.groupBy("bucket")).applyInPandas(one, HALVES)


def index_halves(halves: DataFrame, buckets: int) -> DataFrame:
    """Packed spans, by row, of the windows in the halves that a smaller id has too: by a column-wise index for each bucket."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, spans, ids, grams, heads, data, sizes = _unpack(pdf, spans=U64, ids=np.int64, grams=U64, heads=np.uint8, data=np.uint8, sizes=np.uint8)
        total, stop = Prefix(data), np.cumsum(sizes.astype(np.int64))
        at, place, n = stop - sizes, (spans >> U64(8)).astype(np.int64), (spans & U64(255)).astype(np.int64)
        head, width = (heads >> 1).astype(np.int64), LEFT + GRAM + (heads & 1).astype(np.int64)
        got = []
        for cut in range(CUTS + 1):
            gone, open_ = settle(grams, total.hashes(at, n + SIZE - 1), ids)
            got.append((rows[gone], (place[gone] << 8 | n[gone]).astype(U64)))
            rows, ids, grams, at, place, n, head, width = (x[open_] for x in (rows, ids, grams, at, place, n, head, width))
            if cut == CUTS:
                break
            # what is left of a window beside the shared bytes lies, by half at least, before or after them: cut once more
            more = SIZE - width
            before = (more + 1) // 2
            n_left = np.clip(head - before + 1, 0, n)
            left, right = np.flatnonzero(n_left > 0), np.flatnonzero(n > n_left)
            both = np.concatenate([left, right])
            skip = np.concatenate([np.zeros(len(left), np.int64), n_left[right]])
            head = np.concatenate([(head - before)[left], (head - n_left)[right]])
            width = np.concatenate([(width + before)[left], (width + more - before + 1)[right]]).clip(max=SIZE)
            n = np.concatenate([n_left[left], (n - n_left)[right]])
            rows, ids, at, place = rows[both], ids[both], at[both] + skip, place[both] + skip
            grams = total.hashes(at + head, width)
        # pieces of one shared key stay together; an index holds about a bucket's share
        order = np.argsort(grams, kind="stable")
        for lo, hi in _runs(grams[order], (n + SIZE - 1)[order]):
            i = order[lo:hi]
            index = Columns(data, at[i], at[i] + n[i] + SIZE - 1).build()
            s, where = index.smaller(ids[i], SIZE)
            got.append((rows[i][s], ((place[i][s] + where) << 8 | 1).astype(U64)))
        rows, spans = (np.concatenate(x) for x in zip(*got, strict=True))
        return pd.DataFrame(_pack(rows, spans, by_row(rows, buckets), buckets), columns=SPAN_COLUMNS)

    return halves.groupBy("bucket").applyInPandas(one, SPANS)


def _runs(keys: np.ndarray, sizes: np.ndarray, limit: int = 1_000_000):
    """Ranges of about limit bytes that do not part equal keys."""
    if not len(keys):
        return
    ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
    upto, lo, held = np.cumsum(sizes.astype(np.int64)), 0, 0
    for e in ends.tolist():
        if upto[e - 1] - held >= limit or e == len(keys):
            yield lo, e
            lo, held = e, upto[e - 1]


def remove_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes), kept_sha256 for docs(doc_id, text)."""
    buckets = n_buckets(docs, BUCKET_BYTES)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text", row_key().alias("row"))
    rows = rows.withColumn("bucket", F.expr(f"cast(cast(row as decimal(20,0)) + if(row < 0, 18446744073709551616, 0) as decimal(20,0)) % {buckets}").cast("int"))
    settled = written(settle_segments(find_segments(rows.select("id", "row", "text"), buckets), buckets), "settled")
    halves = open_halves(rows.select("id", "row", "text", "bucket"), settled.filter("grams IS NOT NULL").select(*SPAN_COLUMNS), buckets)
    halves = written(halves, "halves")
    indexed = written(index_halves(halves, buckets), "indexed")
    dropped(halves)
    gone = settled.filter("grams IS NULL").select(*SPAN_COLUMNS).unionByName(indexed)

    def cut(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        names, spans = _unpack(found, spans=U64)
        order = np.argsort(names, kind="stable")
        names, spans = names[order], spans[order].astype(np.int64)
        own = texts["row"].to_numpy(np.int64).view(U64)
        lo, hi = np.searchsorted(names, own), np.searchsorted(names, own, side="right")
        out = []
        for text, a, z in zip(as_bytes(texts["text"]), lo.tolist(), hi.tolist(), strict=True):
            removed = spans_ = 0
            kept = text
            if z > a:
                place, windows = spans[a:z] >> 8, spans[a:z] & 255
                edge = np.bincount(place, minlength=len(text) + 1) - np.bincount(place + windows + SIZE - 1, minlength=len(text) + 1)
                gone_here = np.cumsum(edge[:-1]) > 0
                removed = int(gone_here.sum())
                spans_ = int(gone_here[0]) + int((gone_here[1:] & ~gone_here[:-1]).sum())
                kept = np.frombuffer(text, np.uint8)[~gone_here].tobytes()
            out.append((len(text), removed, spans_, kept, hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]).assign(doc_id=texts["doc_id"].to_numpy())[["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]]

    return rows.select("doc_id", "text", "row", "bucket").groupBy("bucket").cogroup(gone.groupBy("bucket")).applyInPandas(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_substrings(table(spark, sf_dir, "documents")).drop("kept")


OP1_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
least_ AS (SELECT k, min(doc_id) AS m FROM win GROUP BY 1),
hit AS (SELECT doc_id, i FROM win JOIN least_ USING (k) WHERE m < doc_id),
b AS (SELECT doc_id, p, substr(h, 2 * p + 1, 2) AS x FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS p FROM d)),
c AS (SELECT b.doc_id, p, x, max(i) OVER (PARTITION BY b.doc_id ORDER BY p ROWS 49 PRECEDING) IS NOT NULL AS gone FROM b LEFT JOIN hit ON hit.doc_id = b.doc_id AND hit.i = b.p),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS begins FROM c),
r AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(x, '' ORDER BY p) FILTER (NOT gone) AS kept FROM e GROUP BY 1)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
"""

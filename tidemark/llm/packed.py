"""Exchanges of many small records as packed arrays, dealt to as many buckets as the text has blocks of 16 MB.

A record has a key (64 bits), a row (64 bits that name a row of documents: its hash of doc_id and text) and a place
(32 bits). A task packs its records by bucket, so that Spark moves a few large rows instead of many millions. A key that
a task holds twice is told to the key's bucket once, without its records: these go straight to their rows' buckets. So a
bucket gets from each task at most one record of a key, however hot the key is.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U64, U32 = np.uint64, np.uint32
#: Text bytes for each bucket.
BUCKET_BYTES = 16_000_000
#: Records that a task holds before it packs them.
HELD = 3_000_000
ROWS = "bucket int, rows binary, who binary, places binary"
KEYS = f"{ROWS}, keys binary, known binary"
EMPTY = b""


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def n_buckets(docs: DataFrame, each: int = BUCKET_BYTES) -> int:
    """By the size of the texts, of all of them."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(12, -(-int(total) // each))


def _split(bucket: np.ndarray, buckets: int):
    """Indices of each bucket that has any."""
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(ends)):
        yield int(b), order[ends[b] : ends[b + 1]]


def pack_rows(rows: np.ndarray, places: np.ndarray, buckets: int) -> list[dict]:
    """Places dealt by their rows."""
    out = []
    for b, i in _split((rows % U64(buckets)).astype(np.int64), buckets):
        names, who = np.unique(rows[i], return_inverse=True)
        out.append({"bucket": b, "rows": names.tobytes(), "who": who.astype(U32).tobytes(), "places": places[i].astype(U32).tobytes(), "keys": EMPTY, "known": EMPTY})
    return out


def pack_keys(keys: np.ndarray, rows: np.ndarray, places: np.ndarray, buckets: int) -> pd.DataFrame:
    """Records dealt by their keys, those of keys held twice by their rows."""
    order = np.argsort(keys, kind="stable")
    keys, rows, places = keys[order], rows[order], places[order]
    same = keys[1:] == keys[:-1]
    twice = (np.append(same, False) | np.append(False, same))[: len(keys)]
    out = pack_rows(rows[twice], places[twice], buckets)
    known = np.unique(keys[twice])
    by = dict(_split((known >> U64(20)).astype(np.int64) % buckets, buckets))
    keys, rows, places = keys[~twice], rows[~twice], places[~twice]
    single = dict(_split((keys >> U64(20)).astype(np.int64) % buckets, buckets))
    for b in sorted({*by, *single}):
        i = single.get(b, np.empty(0, np.int64))
        i = i[np.argsort(rows[i], kind="stable")]
        names, who = np.unique(rows[i], return_inverse=True)
        out.append({"bucket": b, "rows": names.tobytes(), "who": who.astype(U32).tobytes(), "places": places[i].astype(U32).tobytes(), "keys": keys[i].tobytes(), "known": known[by[b]].tobytes() if b in by else EMPTY})
    return pd.DataFrame(out, columns=["bucket", "rows", "who", "places", "keys", "known"])


def unpack_rows(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows, places = [np.empty(0, U64)], [np.empty(0, U32)]
    for r, w, p in zip(pdf["rows"], pdf["who"], pdf["places"], strict=True):
        rows.append(np.frombuffer(r, U64)[np.frombuffer(w, U32)])
        places.append(np.frombuffer(p, U32))
    return np.concatenate(rows), np.concatenate(places)


def repeated(records: DataFrame, buckets: int) -> DataFrame:
    """Of packed records those whose key occurs more than once in all, packed by their rows."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        keyed = pdf["keys"].map(len) > 0
        rows, places = unpack_rows(pdf[keyed])
        keys = np.frombuffer(b"".join(pdf["keys"][keyed]), U64)
        known = np.frombuffer(b"".join(pdf["known"]), U64)
        names, which, n = np.unique(np.concatenate([keys, known, known]), return_inverse=True, return_counts=True)
        again = n[which[: len(keys)]] > 1
        done = unpack_rows(pdf[~keyed])
        out = pack_rows(np.concatenate([rows[again], done[0]]), np.concatenate([places[again], done[1]]), buckets)
        return pd.DataFrame(out, columns=["bucket", "rows", "who", "places"])

    return records.groupBy("bucket").applyInPandas(one, ROWS)


class Held:
    """Records of a task, packed when there are many."""

    def __init__(self, buckets: int):
        self.buckets, self.n, self.parts = buckets, 0, []

    def add(self, keys: np.ndarray, rows: np.ndarray, places: np.ndarray):
        self.parts.append((keys, rows, places))
        self.n += len(keys)
        if self.n >= HELD:
            yield self.flush()

    def flush(self) -> pd.DataFrame:
        got = [np.concatenate(x) for x in zip(*self.parts, strict=True)] if self.parts else [np.empty(0, U64), np.empty(0, U64), np.empty(0, U32)]
        self.n, self.parts = 0, []
        return pack_keys(*got, self.buckets)


def places_of(pdf: pd.DataFrame, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted places of a bucket, and for each given row where its own begin and end."""
    names, places = unpack_rows(pdf)
    order = np.lexsort((places, names))
    names, places = names[order], places[order].astype(np.int64)
    return places, np.searchsorted(names, rows), np.searchsorted(names, rows, side="right")

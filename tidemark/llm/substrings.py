"""Substring dedup by difference-cover anchors (operator 8).

A set of residues is a difference cover of a period v if every difference modulo v is one of two of its members. Windows
of n - v + 1 words are hashed only where the position modulo v lies in the cover: two equal runs of n words, wherever
they start, then share an anchor at the same distance from their starts. Anchors that occur more than once are extended:
every window of n words that holds one is hashed, and windows that occur more than once are the repeated ones.

Only hashes, rows and places move; texts are joined to them by bucket. Windows are told apart by 64-bit hashes.

Defined results: a null text has no words; a text of fewer than n words keeps all; rows that repeat a doc_id are
documents of their own, so that a repeated row of n words or more loses its words; a null doc_id is a document like any
other; a very long text is read whole; an empty table gives no rows; other columns are ignored, whatever their names.
"""

import hashlib
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, as_bytes, grouped, table, written
from .packed import KEYS, Held, n_buckets, places_of, repeated, row_key

PERIOD = 21


def difference_cover(period: int) -> list[int]:
    """The smallest set of residues, the first in order, whose differences are all residues of the period."""
    size = 1
    while True:
        for rest in combinations(range(1, period), size - 1):
            cover = (0, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return list(cover)
        size += 1


def anchors(docs: DataFrame, n: int, period: int, buckets: int) -> DataFrame:
    """The packed anchors of docs(row, text)."""
    cover, size = np.isin(np.arange(period), difference_cover(period)), n - period + 1

    def find(batches):
        held = Held(buckets)
        for b in batches:
            texts, rows = as_bytes(b["text"]), b["row"].to_numpy(np.int64).view(np.uint64)
            for lo, hi in grouped(texts):
                w = Words(texts[lo:hi])
                h = w.window_hashes(w.hashes(), size)
                place = np.arange(len(w.starts)) - w.first[:-1][w.doc]
                at = np.flatnonzero(cover[place % period] & (place + size <= w.count[w.doc]) & (w.count[w.doc] >= n))
                yield from held.add(h[at], rows[lo:hi][w.doc[at]], place[at].astype(np.uint32))
        yield held.flush()

    return docs.mapInPandas(find, KEYS)


def with_texts(docs: DataFrame, found: DataFrame, one, schema: str) -> DataFrame:
    """one(documents, packed rows) for each bucket."""
    return docs.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInPandas(one, schema)


def repeated_windows(docs: DataFrame, n: int, period: int, buckets: int) -> DataFrame:
    """Packed starts of the windows of n words that occur more than once in docs(row, text, bucket)."""
    again = written(repeated(anchors(docs.select("row", "text"), n, period, buckets), buckets), "anchors")

    def extend(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        held = Held(buckets)
        rows = texts["row"].to_numpy(np.int64).view(np.uint64)
        places, lo, hi = places_of(found, rows)
        some = np.flatnonzero(hi > lo)
        texts, out = as_bytes(texts["text"].iloc[some]), []
        for a, z in grouped(texts):
            w = Words(texts[a:z])
            h = w.window_hashes(w.hashes(), n)
            # +1 where the windows of an anchor begin, -1 after its last
            edge = np.zeros(len(w.starts) + 1, np.int64)
            for i, k in enumerate(some[a:z]):
                p = places[lo[k] : hi[k]]
                np.add.at(edge, w.first[i] + np.maximum(p - (period - 1), 0), 1)
                np.add.at(edge, w.first[i] + p + 1, -1)
            place = np.arange(len(w.starts)) - w.first[:-1][w.doc]
            at = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (place + n <= w.count[w.doc]))
            out += held.add(h[at], rows[some[a:z]][w.doc[at]], place[at].astype(np.uint32))
        return pd.concat([*out, held.flush()])

    return written(repeated(with_texts(docs, again, extend, KEYS), buckets), "windows")


def remove_repeats(docs: DataFrame, n: int = 35, period: int = PERIOD) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text), kept_sha256 for docs(doc_id, text): words in repeated windows go."""
    buckets = n_buckets(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("row"))
    # as packed rows are dealt: the key as an unsigned number, modulo the buckets
    rows = rows.withColumn("bucket", F.expr(f"cast(cast(row as decimal(20,0)) + if(row < 0, 18446744073709551616, 0) as decimal(20,0)) % {buckets}").cast("int"))
    windows = repeated_windows(rows, n, period, buckets)

    def cut(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        keys = texts["row"].to_numpy(np.int64).view(np.uint64)
        places, lo, hi = places_of(found, keys)
        raw, out = as_bytes(texts["text"]), []
        for a, z in grouped(raw):
            w = Words(raw[a:z])
            edge = np.zeros(len(w.starts) + 1, np.int64)
            for i, k in enumerate(range(a, z)):
                if hi[k] > lo[k]:
                    p = places[lo[k] : hi[k]]
                    np.add.at(edge, w.first[i] + p, 1)
                    np.add.at(edge, w.first[i] + p + n, -1)
            keep = np.cumsum(edge[:-1]) <= 0
            kept = np.bincount(w.doc[keep], minlength=z - a)
            # the bytes of kept words, each with the one that follows it, made a space
            buf, inside = w.buf.copy(), np.zeros(len(w.buf) + 1, np.int64)
            np.add.at(inside, w.starts[keep], 1)
            np.add.at(inside, w.ends[keep] + 1, -1)
            buf[w.ends[keep]] = 32
            mask = np.cumsum(inside[:-1]) > 0
            data, upto = buf[mask].tobytes(), np.concatenate([[0], np.cumsum(mask)])[w.begin]
            texts_kept = [data[s : max(s, e - 1)] for s, e in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
            out.append(pd.DataFrame({"n_words": w.count, "n_removed": w.count - kept, "kept": [t.decode("utf-8", "replace") for t in texts_kept], "kept_sha256": [hashlib.sha256(t).hexdigest() for t in texts_kept]}))
        out = pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["n_words", "n_removed", "kept", "kept_sha256"])
        return out.assign(doc_id=texts["doc_id"].to_numpy())[["doc_id", "n_words", "n_removed", "kept", "kept_sha256"]]

    return with_texts(rows, windows, cut, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 34], ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS s FROM d WHERE len(w) >= 35)),
rep AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY k) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 34)) AS p FROM rep),
word AS (SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS p FROM d),
kept AS (SELECT word.doc_id, string_agg(word.x, ' ' ORDER BY word.p) AS t FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY 1),
n AS (SELECT doc_id, count(*) AS c FROM gone GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.c, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

"""N-gram Jaccard join with adaptive multi-match prefixes (operator 7).

A document's set holds the hashes of its word n-grams. With the sets in one global order, two sets that are alike share l
of their members in prefixes of n - ceil(t n) + l. Frequent members come last in the order. A document whose prefix still
holds frequent members may take a longer one: l is where the estimated cost of reading and verifying its candidates is
least, and a candidate must share as many prefix members as the smaller l of the two before it is verified.

Texts with equal sets form a class, and classes are joined. A list (the classes that have a member in their prefixes) is cut
where a class is too large to link with the one before it; a class that is left alone goes. Components need not every link. A
list with SMALL classes or fewer gives all its pairs at once, packed; they are counted where their first class is dealt to, and
only those that share enough lists become rows. A longer one gives in each round the pairs of some of its classes
(pivots, four times as many as in the round before) with all others; these classes then leave the list, their links there
being decided. A list whose classes have come into one component is closed. What is open after ROUNDS rounds (classes that
share frequent members but are not alike) is cut in blocks: each block of classes outside a list's largest component
meets each block of the list in a task, which compares them and returns links that span what it found. So no link
between different components is lost, and a list of near copies closes after one or two rounds, at a few pairs for each class.

A class has a sketch: parities of how many of its members hash to each of so many places, at least PARITIES and as many as it
has members, a power of two, at most WIDEST. A wider one is folded to meet a narrower one. Sets differ in at least as many
members as their sketches in bits, so that sketches rule pairs out, and never wrongly. For what is left texts move, compressed
(a set of hashes is longer than its text), and not with each pair: pairs of classes that are next to one another are dealt to one
place, a text goes to each place once, and sets are made again and compared there. Blocks are compared by sketches first, and then
by the sets of those classes that may have a link on their list.

Defined results: a text without words has an empty set, links with nothing and is a component of its own; fewer than n words
are one n-gram; a null doc_id never names a component that has another; rows that repeat a doc_id are joined by their own
texts; equal texts are one class; a very long text is one set, read whole; an empty table gives no rows; other columns are
ignored by `jaccard_components` and kept as they are by `keep_one`, whatever their names. Members and classes are told
apart by 64-bit hashes.
"""

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Words, as_bytes, dropped, grouped, mix64, per_text, table, unused, written
from .packed import _split, n_buckets, row_key

#: A member is frequent from this share of the documents on (so at most 1 / FREQUENT times the mean set size are), and in FREQUENT_LEAST documents.
FREQUENT, FREQUENT_LEAST = 0.0002, 50
MOST_SHARED, VERIFY = 16, 0.05
#: Lists up to which all pairs are made; pivots of a longer list in the first round; classes of a list that one task pairs with the pivots.
SMALL, PIVOTS, SALTED = 8, 2, 1000
#: Rounds of pivots; set members in a block of classes that are compared in one task after that.
ROUNDS, BLOCK = 3, 500_000
#: Parities in a sketch, of a small set and of a very large one; classes in a block whose sketches are compared in one task.
PARITIES, WIDEST, SKETCHED = 512, 1 << 15, 4000
#: Bytes of text handled at once in a task; text bytes for each bucket; members that a task holds before it counts or packs them.
AT_ONCE, BUCKET_BYTES, HELD = 500_000, 4_000_000, 1_000_000
#: Rows of (class, row) that may be broadcast.
BROADCAST_ROWS = 500_000
#: Pairs beside one another that are compared in one place.
TOGETHER = 500


class Texts(NamedTuple):
    """Where the sets of classes come from: docs(text), rows(row, cid) of them, words of a member, and how many texts a task may hold."""

    docs: DataFrame
    rows: DataFrame
    n: int
    at_once: int


def compressed(arrays: dict) -> dict[str, bytes]:
    """Arrays or bytes, compressed, each behind its length."""
    out = {}
    for k, x in arrays.items():
        x = x if isinstance(x, bytes) else x.tobytes()
        out[k] = len(x).to_bytes(8, "little") + pa.compress(x, codec="zstd", asbytes=True) if x else b""
    return out


def expanded(x: bytes) -> bytes:
    return pa.decompress(x[8:], int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True) if x else b""


def shingle_sets(texts: list[bytes], n: int):
    """(document, member) of the sets, ordered, and the sizes."""
    w = Words(texts, lower=True)
    word = w.hashes()
    short = np.flatnonzero((w.count > 0) & (w.count < n))
    h = w.window_hashes(word, n)
    at = np.flatnonzero(np.arange(len(h)) + n <= w.first[1:][w.doc[: len(h)]])
    doc, member = [w.doc[at]], [h[at]]
    for i in short.tolist():  # the whole as one
        x = np.array([w.count[i]], U64)
        for v in word[w.first[i] : w.first[i + 1]]:
            x = mix64(x * U64(3) + v)
        doc.append(np.array([i]))
        member.append(x)
    doc, member = np.concatenate(doc), np.concatenate(member)
    order = np.lexsort((member, doc))
    doc, member = doc[order], member[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (member[1:] != member[:-1]))[: len(doc)]
    doc, member = doc[new], member[new]
    return doc, member, np.bincount(doc, minlength=len(texts))


def class_ids(doc: np.ndarray, member: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each whole set."""
    upto = np.concatenate([np.zeros(1, U64), np.cumsum(mix64(member ^ U64(0x5DEECE66D)))])
    ends = np.cumsum(size)
    return mix64(upto[ends] - upto[ends - size] + mix64(size.astype(U64)))


def widths(size: np.ndarray) -> np.ndarray:
    """How many parities the sketch of a set of each size has."""
    return np.clip(1 << np.frexp(np.maximum(size, 1) - 0.5)[1].astype(np.int64), PARITIES, WIDEST)


def parities(doc: np.ndarray, member: np.ndarray, width: np.ndarray) -> np.ndarray:
    """For each set, one after another, its parities, as 64-bit integers."""
    place = (mix64(member ^ U64(0x3C6EF372FE94F82B)) % width.astype(U64)[doc]).astype(np.int64)
    return np.packbits(np.bincount((np.cumsum(width) - width)[doc] + place, minlength=int(width.sum())).astype(np.uint8) & 1).view(np.int64)


def sketches_of(doc: np.ndarray, member: np.ndarray, docs: int) -> np.ndarray:
    """For each set its parities, PARITIES for all."""
    return parities(doc, member, np.full(docs, PARITIES)).reshape(docs, PARITIES // 64)


def describe(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, row (hash of doc_id and text), n_shingles, cid, sketch for each row of docs; and for each task a row of its often-met members (many) with counts."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_shingles", pa.int64()), ("cid", pa.int64()), ("sketch", pa.list_(pa.int64())), ("members", pa.binary()), ("counts", pa.binary())])

    def one(batches):
        seen, held, docs_here = [], 0, 0
        counted: tuple = (np.empty(0, U64), np.empty(0, np.int64))

        def fold():
            new, c = np.unique(np.concatenate([counted[0][:0], *seen]), return_counts=True)
            m, which = np.unique(np.concatenate([counted[0], new]), return_inverse=True)
            return m, np.bincount(which, np.concatenate([counted[1], c]), len(m)).astype(np.int64)

        for b in batches:
            texts = as_bytes(b.column("text"))
            for lo, hi in grouped(texts, AT_ONCE):
                doc, member, size = shingle_sets(texts[lo:hi], n)
                seen.append(member)
                held += len(member)
                docs_here += hi - lo
                if held > HELD:  # what is rare so far is let go: only the order of members depends on these counts
                    m, c = fold()
                    counted, seen, held = (m[c > 1], c[c > 1]), [], 0
                ids = [b.column(c).slice(lo, hi - lo) for c in ("doc_id", "row")]
                width = widths(size)
                sketch = pa.ListArray.from_arrays(np.append(0, np.cumsum(width // 64)).astype(np.int32), parities(doc, member, width))
                yield pa.RecordBatch.from_arrays([*ids, pa.array(size.astype(np.int64)), pa.array(class_ids(doc, member, size).view(np.int64)), sketch, *[pa.nulls(hi - lo, pa.binary())] * 2], schema=schema)
        m, c = fold()
        often = c >= max(3, FREQUENT * docs_here)
        yield pa.RecordBatch.from_pylist([{"row": 0, "n_shingles": -1, "cid": 0, "members": m[often].tobytes(), "counts": c[often].tobytes()}], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("row")).mapInArrow(one, "doc_id long, row long, n_shingles long, cid long, sketch array<long>, members binary, counts binary")


def frequent_members(described: DataFrame, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent members, in order, and how frequent (log2 of their counts)."""

    def unpack(batches):
        for b in batches:
            for m, c in zip(b["members"], b["counts"], strict=True):
                yield pd.DataFrame({"member": np.frombuffer(m, np.int64), "n": np.frombuffer(c, np.int64)})

    counts = described.filter("n_shingles < 0").select("members", "counts").mapInPandas(unpack, "member long, n long").groupBy("member").agg(F.sum("n").alias("n"))
    got = counts.filter(F.col("n") >= max(FREQUENT_LEAST, FREQUENT * n_docs)).toPandas()
    member, n = got["member"].to_numpy(np.int64).view(U64), got["n"].to_numpy(np.int64)
    order = np.argsort(member)
    return member[order], n[order]


def prefixes(doc, member, size, t: int, frequent: np.ndarray, counts: np.ndarray):
    """Which (document, member) are in the documents' prefixes, in the global order, and the l of each document."""
    place = np.minimum(np.searchsorted(frequent, member), max(len(frequent) - 1, 0))
    df = np.where(frequent[place] == member, counts[place], 1) if len(frequent) else np.ones(len(member), np.int64)
    order = np.lexsort((member, np.where(df > 1, np.frexp(df.astype(float))[1], 0), doc))
    doc, member, df = doc[order], member[order], df[order]
    first = np.cumsum(size) - size
    base = size - (t * size + 99) // 100
    ls = np.arange(1, MOST_SHARED + 1)
    cost = (base[:, None] + ls) * (1 + VERIFY * size[:, None] / ls)
    level = np.minimum(1 + np.argmin(np.where(ls <= np.maximum(size - base, 1)[:, None], cost, np.inf), axis=1), size)
    nth = np.arange(len(doc)) - first[doc]
    busy = np.unique(doc[(nth < (base + level)[doc]) & (df > 1)])
    for i in busy.tolist():
        most = int(min(MOST_SHARED, size[i] - base[i]))
        met = np.cumsum(df[first[i] : first[i] + base[i] + most])
        ls = np.arange(1, most + 1)
        met = met[base[i] + ls - 1]
        level[i] = 1 + int(np.argmin(met * (1 + VERIFY * size[i] / ls)))
    inside = nth < (base + level)[doc]
    return doc[inside], member[inside], level


def postings(docs: DataFrame, n: int, t: int, frequent, counts, buckets: int) -> DataFrame:
    """member, cid, n, l: the lists, longer than SMALL, of prefix members that several classes of like sizes have; and in rows
    with a bucket the pairs of the others, packed, and the classes of the longer ones (loose), each in its first class's bucket."""
    small, pair_buckets = SMALL, buckets // 8 + 1
    kinds = [*zip(("member", "cid", "n", "l", "bucket"), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True), *((c, pa.binary()) for c in ("a", "b", "need", "loose"))]
    schema = pa.schema(kinds)

    def find(batches):
        done: set[int] = set()
        parts, held = [], 0

        def flush():
            member, cid, size, level = (np.concatenate(x) for x in zip(*parts, strict=True))
            return pd.DataFrame([{"bucket": b, "member": member[i].tobytes(), "cid": cid[i].tobytes(), "n": size[i].tobytes(), "l": level[i].tobytes()} for b, i in _split(((member >> U64(20)) % U64(buckets)).astype(np.int64), buckets)])

        for b in batches:
            texts = as_bytes(b["text"])
            for lo, hi in grouped(texts, AT_ONCE):
                doc, member, size = shingle_sets(texts[lo:hi], n)
                cid = class_ids(doc, member, size)
                new = np.zeros(hi - lo, bool)
                for i, c in enumerate(cid.tolist()):
                    if c not in done:
                        done.add(c)
                        new[i] = True
                doc, member, level = prefixes(doc, member, size, t, frequent, counts)
                keep = new[doc]
                doc, member = doc[keep], member[keep]
                parts.append((member, cid[doc], size[doc].astype(np.uint32), level[doc].astype(np.uint8)))
                held += len(doc)
                if held > HELD // 2:
                    yield flush()
                    parts, held = [], 0
        if parts:
            yield flush()

    def meet(rows: pa.Table) -> pa.Table:
        member, cid, size, level = (np.frombuffer(b"".join(rows[k].to_pylist()), d) for k, d in (("member", U64), ("cid", U64), ("n", np.uint32), ("l", np.uint8)))
        size = size.astype(np.int64)
        order = np.lexsort((cid, size, member))
        member, cid, size, level = member[order], cid[order], size[order], level[order]
        new = np.append(True, (member[1:] != member[:-1]) | (cid[1:] != cid[:-1]))[: len(member)]
        member, cid, size, level = member[new], cid[new], size[new], level[new]
        # a list ends where the next size is out of reach
        start = np.flatnonzero(np.append(True, (member[1:] != member[:-1]) | (100 * size[:-1] < t * size[1:]))[: len(member)])
        m = np.diff(np.append(start, len(member)))
        nth = np.arange(len(member)) - np.repeat(start, m)
        name, m = np.repeat(mix64(member[start] ^ mix64(size[start].astype(U64))), m), np.repeat(m, m)
        pairs = []
        for d in range(1, small):
            i = np.flatnonzero((m <= small) & (nth + d < m))
            i = i[100 * size[i] >= t * size[i + d]]
            pairs.append((np.minimum(cid[i], cid[i + d]), np.maximum(cid[i], cid[i + d]), np.minimum(level[i], level[i + d])))
        first, second, need = (np.concatenate(x) for x in zip((cid[:0], cid[:0], level[:0]), *pairs, strict=True))
        long = m > max(small, 1)
        loose = cid[long]
        of_pair, of_loose = (dict(_split(((x >> U64(20)) % U64(pair_buckets)).astype(np.int64), pair_buckets)) for x in (first, loose))
        none = np.empty(0, np.int64)
        packs = []
        for k in sorted({*of_pair, *of_loose}):
            i, j = of_pair.get(k, none), of_loose.get(k, none)
            i = i[np.lexsort((second[i], first[i]))]
            packs.append({"bucket": k} | compressed({"a": first[i], "b": second[i], "need": need[i], "loose": loose[j]}))
        lists = {"member": name[long].view(np.int64), "cid": loose.view(np.int64), "n": size[long], "l": level[long].astype(np.int32)}
        lists = [pa.array(lists[f.name]) if f.name in lists else pa.nulls(len(loose), f.type) for f in schema]
        return pa.concat_tables([pa.Table.from_arrays(lists, schema=schema), pa.Table.from_pylist(packs, schema=schema)])

    packed = docs.select("text").mapInPandas(find, "bucket int, member binary, cid binary, n binary, l binary")
    return packed.groupBy("bucket").applyInArrow(meet, "member long, cid long, n long, l int, bucket int, a binary, b binary, need binary, loose binary")


def of_short_lists(lists: DataFrame, longer: DataFrame) -> DataFrame:
    """Pairs (a, b) packed by postings() that share enough lists, or may with the longer ones that both stand on."""

    def tally(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, need, loose = (np.frombuffer(b"".join(map(expanded, pdf[k])), d) for k, d in (("a", U64), ("b", U64), ("need", np.uint8), ("loose", U64)))
        order = np.lexsort((b, a))
        a, b, need = a[order], b[order], need[order]
        start = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)])
        shared = np.diff(np.append(start, len(a)))
        a, b, need = a[start], b[start], np.minimum.reduceat(need, start).astype(np.int64) if len(start) else need
        cid, n = np.unique(loose, return_counts=True)
        at = np.minimum(np.searchsorted(cid, a), max(len(cid) - 1, 0))
        more = np.where(cid[at] == a, n[at], 0) if len(cid) else np.zeros(len(a), np.int64)
        i = np.flatnonzero(shared + more >= need)
        return pd.DataFrame({"a": a[i].view(np.int64), "b": b[i].view(np.int64), "short": need[i].astype(np.int64) - shared[i]})

    pairs = written(lists.filter("bucket IS NOT NULL").select("bucket", "a", "b", "need", "loose").groupBy("bucket").applyInPandas(tally, "a long, b long, short long"), "shared")
    loose = longer.groupBy(F.col("cid").alias("b")).agg(F.count("*").alias("loose"))
    both = pairs.filter("short > 0").join(loose, "b").filter("loose >= short")
    out = pairs.filter("short <= 0").select("a", "b").unionByName(both.select("a", "b"))
    out.written_at = pairs.written_at
    return out


def components(links: DataFrame) -> DataFrame:
    """node, comp (the least node reached) of the links (a, b): least labels over the links, then over the labels' own labels, until none changes."""
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.least("comp", "near").alias("to"), F.col("comp").alias("was"))
        own = labels.select(F.col("node").alias("to"), F.col("comp").alias("further"))
        new = written(step.join(own, "to", "left").select("node", "was", F.least("to", F.coalesce("further", "to")).alias("comp")), "labels")
        old, labels = labels, new.select("node", "comp")
        labels.written_at = new.written_at
        dropped(old)
        if new.filter("comp <> was").isEmpty():
            dropped(both)
            return labels


def near_enough(t: int) -> Column:
    """Whether the sketches of a and b differ in no more bits than sets that are alike may differ in members."""

    def narrow(x: str, other: str) -> Column:
        half = (F.size(x) / 2).cast("int")
        both = F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) > F.size(other), both).otherwise(F.col(x))

    a, b = narrow("sketch_a", "sketch_b"), narrow("sketch_b", "sketch_a")
    bits = F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, k: n + k)
    return (F.size(a) != F.size(b)) | ((100 + t) * bits <= (100 - t) * (F.col("n_a") + F.col("n_b")))


def likely(pairs: DataFrame, sketches: DataFrame, t: int) -> DataFrame:
    """Those of pairs(a, b) whose sketches are near enough."""
    for x in ("a", "b"):
        pairs = pairs.join(sketches.select(F.col("cid").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")), x)
    return pairs.filter(near_enough(t)).select("a", "b")


def places(pairs: DataFrame, at_once: int) -> DataFrame:
    """a, b, place of pairs(a, b); written. Those around the same classes have one place, but TOGETHER of them at most; then they are dealt
    by the end that has fewer pairs, so that a class with many pairs goes to many places and the others to few."""
    spark, ends = pairs.sparkSession, pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.select("b", "a"))
    per = ends.groupBy("x").agg(F.count("*").alias("pairs"), F.least("x", F.min("y")).alias("least"))
    for k in ("a", "b"):
        pairs = pairs.join(per.select(F.col("x").alias(k), F.col("pairs").alias(f"pairs_{k}"), F.col("least").alias(f"least_{k}")), k)
    near = pairs.select("a", "b", F.least("least_a", "least_b").alias("near"), F.when(F.col("pairs_a") < F.col("pairs_b"), F.col("a")).otherwise(F.col("b")).alias("fewer"))
    near = written(near, "near")
    sizes = near.groupBy("near").agg(F.count("*").alias("m")).filter(F.col("m") > TOGETHER)  # few
    part = F.pmod(F.xxhash64("fewer"), F.coalesce(F.ceil(F.col("m") / TOGETHER), F.lit(1)))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * near.count() // at_once + 1)
    out = written(near.join(sizes, "near", "left").select("a", "b", F.pmod(F.xxhash64("near", part), F.lit(n)).cast("int").alias("place")), "places")
    dropped(near)
    return out


def similar(pairs: DataFrame, texts: Texts, t: int) -> DataFrame:
    """Those of pairs(a, b) whose sets are alike, but those that join what others in their place join already; written. Each text goes once to each place of its class."""
    dealt = places(pairs, texts.at_once)
    wanted = dealt.select(F.col("a").alias("cid"), "place").union(dealt.select("b", "place")).distinct()
    rep = texts.rows.join(wanted.select("cid").distinct(), "cid", "left_semi").groupBy("cid").agg(F.min("row").alias("row"))
    rep = written(rep.join(wanted, "cid").select("row", "cid", "place"), "reps")
    zstd = lambda rows, keep: per_text(rows, keep, lambda x: {"packed": [compressed({"": b})[""] for b in x]}, "packed binary", limit=AT_ONCE)
    docs = texts.docs.select("text", row_key().alias("row"))
    if rep.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        found = zstd(docs.join(F.broadcast(rep), "row"), ["place", "cid"])
    else:
        found = zstd(docs, ["row"]).join(rep, "row").select("place", "cid", "packed")
    n = texts.n

    def compare(theirs: pa.Table, asked: pa.Table) -> pa.Table:
        of = dict(zip(theirs["cid"].to_pylist(), theirs["packed"].to_pylist(), strict=True))  # a row may stand in docs more than once
        held, sets = [expanded(x) for x in of.values()], {}
        named = np.fromiter(of, np.int64, len(of))
        for lo, hi in grouped(held, AT_ONCE):
            doc, member, size = shingle_sets(held[lo:hi], n)
            ends = np.cumsum(size)
            for i in np.flatnonzero(class_ids(doc, member, size).view(np.int64) == named[lo:hi]).tolist():
                sets[int(named[lo + i])] = member[ends[i] - size[i] : ends[i]]
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        out = []
        for a, b in sorted(zip(asked["a"].to_pylist(), asked["b"].to_pylist(), strict=True)):
            x, y = find(a), find(b)
            if x != y and a in sets and b in sets:
                size = len(sets[a]) + len(sets[b])
                shared = size - len(np.union1d(sets[a], sets[b]))
                if 100 * shared >= t * (size - shared):
                    root[x] = y
                    out.append((a, b))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    out = written(found.groupBy("place").cogroup(dealt.groupBy("place")).applyInArrow(compare, "a long, b long"), "alike")
    dropped(dealt, rep)
    return out


def alike_sizes(t: int, a: str = "na", b: str = "nb"):
    return (F.col(a) * 100 >= F.col(b) * t) & (F.col(b) * 100 >= F.col(a) * t)


def set_of_each(docs: DataFrame, rows: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """cid, members of the classes, each read from the text of one of its rows."""
    rep = written(rows.join(classes, "cid", "left_semi").groupBy("cid").agg(F.min("row").alias("row")), "reps")

    def make(batches):
        for b in batches:
            texts = as_bytes(b["text"])
            for lo, hi in grouped(texts, AT_ONCE):
                doc, member, size = shingle_sets(texts[lo:hi], n)
                cid, ends = class_ids(doc, member, size).view(np.int64), np.cumsum(size)
                ok = np.flatnonzero(cid == b["cid"].iloc[lo:hi].to_numpy(np.int64)).tolist()
                yield pd.DataFrame({"cid": cid[ok], "members": [member[ends[i] - size[i] : ends[i]].view(np.int64) for i in ok]})

    few = rep.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found = docs.select("text", row_key().alias("row")).join(F.broadcast(rep) if few else rep, "row").select("text", "cid")
    sets = written(found.mapInPandas(make, "cid long, members array<long>"), "sets")
    if sets.count() > rep.count():  # some of these rows stand in docs more than once
        every, sets = sets, written(sets.dropDuplicates(["cid"]), "sets")
        dropped(every)
    dropped(rep)
    return sets


def one_round(held: DataFrame, k: int) -> DataFrame:
    """held(member, cid, n, l, comp) of lists that join different components, with what this round does: pivot (paired with
    all others of its list), settled (the list ends with this round), salts; written."""
    most = PIVOTS * 4**k
    per = held.groupBy("member", "comp").agg(F.count("*").alias("m")).groupBy("member").agg(F.sum("m").alias("all"), F.max(F.struct("m", "comp")).alias("top"), F.count("*").alias("comps")).filter("comps > 1")
    per = written(per.select("member", "all", F.col("top.comp").alias("top"), (F.col("all") - F.col("top.m")).alias("others")), "per")  # its shuffle files go before the rows move
    small, drawn = F.col("all") <= SMALL, F.pmod(F.xxhash64(F.lit(k), "cid"), F.lit(1 << 30)) * F.col("others") < most * (1 << 30)
    pivot = small | ((F.col("comp") != F.col("top")) & ((F.col("others") <= most) | drawn))
    settled = small | (F.col("others") <= most)
    out = written(held.join(per, "member").select("member", "cid", "n", "l", "comp", pivot.alias("pivot"), settled.alias("settled"), F.ceil(F.col("all") / SALTED).cast("int").alias("salts")), "held")
    dropped(per)
    return out


def candidates(held: DataFrame, t: int, sketches: DataFrame | None) -> DataFrame:
    """Pairs (a, b) of one_round's classes that may be alike: of different components and like sizes, sharing enough lists, or
    so many that those on which neither is a pivot may be the rest. With sketches, classes carry theirs, and only pairs that are
    near enough are made."""
    loose = held.filter("NOT settled AND NOT pivot").groupBy("cid").agg(F.count("*").alias("loose"))
    own, near_by = ["cid", "n", "l", "comp"], F.lit(True)
    if sketches is not None:
        held, own, near_by = held.join(sketches.select("cid", "sketch"), "cid"), [*own, "sketch"], near_enough(t)
    a = held.filter("pivot").select("member", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *[F.col(c).alias(f"{c}_a") for c in own])
    b = held.select("member", F.pmod(F.xxhash64("cid"), F.col("salts")).cast("int").alias("salt"), "pivot", *[F.col(c).alias(f"{c}_b") for c in own])
    met = a.join(b, ["member", "salt"]).filter((F.col("comp_a") != F.col("comp_b")) & (~F.col("pivot") | (F.col("cid_a") < F.col("cid_b"))) & alike_sizes(t, "n_a", "n_b") & near_by)
    pair = (F.least("cid_a", "cid_b").alias("a"), F.greatest("cid_a", "cid_b").alias("b"))
    met = met.groupBy(*pair).agg(F.count("*").alias("shared"), F.min(F.least("l_a", "l_b")).alias("need"))
    for x in ("a", "b"):  # of pairs, which are fewer than rows of lists
        met = met.join(loose.select(F.col("cid").alias(x), F.col("loose").alias(f"loose_{x}")), x, "left")
    return met.filter("shared + least(coalesce(loose_a, 0), coalesce(loose_b, 0)) >= need").select("a", "b")


def spanning(left: pd.DataFrame, right: pd.DataFrame, t: int) -> list[tuple[int, int]]:
    """Links between classes of two blocks (cid, comp, members) whose sets are alike, but those that would join what others join already."""
    members = np.concatenate([np.empty(0, np.int64), *right["members"]])
    owner = np.repeat(np.arange(len(right)), right["members"].map(len))
    order = np.argsort(members, kind="stable")
    members, owner = members[order], owner[order]
    size, comp, cid = right["members"].map(len).to_numpy(), right["comp"].to_numpy(), right["cid"].to_numpy()
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    out = []
    for a, group, own in zip(left["cid"].tolist(), left["comp"].tolist(), left["members"], strict=True):
        lo, hi = np.searchsorted(members, own), np.searchsorted(members, own, side="right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        shared = np.bincount(owner[at], minlength=len(right))
        for j in np.flatnonzero((comp != group) & (100 * shared >= t * (len(own) + size - shared))).tolist():
            x, y = find(group), find(int(comp[j]))
            if x != y:
                root[x] = y
                out.append((a, int(cid[j])))
    return out


def near(n: np.ndarray, comp: np.ndarray, sketch: np.ndarray, left: np.ndarray, right: np.ndarray, t: int) -> np.ndarray:
    """Which of the classes have a sketch as alike as in likely() with one of another component in the other block; left and right are their places."""
    found, step = np.zeros(len(n), bool), max(1, 1_600_000 // max(len(right) * sketch.shape[1], 1))
    for lo in range(0, len(left), step):
        own = left[lo : lo + step]
        bits = np.bitwise_count(sketch[own][:, None] ^ sketch[right][None]).sum(axis=2, dtype=np.int64)
        alike = ((100 + t) * bits <= (100 - t) * (n[own][:, None] + n[right])) & (comp[own][:, None] != comp[right])
        found[own] |= alike.any(axis=1)
        found[right] |= alike.any(axis=0)
    return found


def near_of_any_width(n: np.ndarray, comp: np.ndarray, sketches: np.ndarray, mine: np.ndarray, t: int) -> np.ndarray:
    """near() of classes whose sketches are arrays of several widths; mine: which are of the left block."""
    width, found = np.fromiter(map(len, sketches), np.int64, len(n)), np.zeros(len(n), bool)
    for u in np.unique(width[mine]).tolist():
        for v in np.unique(width[~mine]).tolist():
            both = [np.flatnonzero(mine & (width == u)), np.flatnonzero(~mine & (width == v))]
            folded = np.zeros((len(n), min(u, v)), U64)
            for i in both:  # places that are the same, modulo the lesser width, are added
                folded[i] = np.bitwise_xor.reduce(np.stack(sketches[i].tolist()).view(U64).reshape(len(i), -1, min(u, v)), axis=1)
            found |= near(n, comp, folded, *both, t)
    return found


def near_classes(held: DataFrame, sketches: DataFrame, t: int, buckets: int) -> DataFrame:
    """The rows of held(member, cid, n, comp) that, by sketches, may link with a class of another component on their list; by blocks; written."""
    per = held.groupBy("member", "comp").agg(F.count("*").alias("m")).groupBy("member").agg(F.sum("m").alias("all"), F.max(F.struct("m", "comp")).alias("top"), F.count("*").alias("comps")).filter("comps > 1")
    blocks = lambda x: F.ceil(x / SKETCHED).cast("int")
    per = per.select("member", F.col("top.comp").alias("top"), blocks(F.col("all")).alias("rights"), blocks(F.col("all") - F.col("top.m")).alias("lefts"))
    rows = held.join(per, "member").join(sketches.select("cid", "sketch"), "cid")
    nth = lambda salt, k: F.pmod(F.xxhash64(F.lit(salt), "cid"), F.col(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    own = ["member", "cid", "n", "comp", "sketch"]
    left = rows.filter("comp <> top").select(*own, nth(1, "lefts").alias("i"), each("rights").alias("j"), F.lit(True).alias("is_left"))
    right = rows.select(*own, nth(2, "rights").alias("j"), each("lefts").alias("i"), F.lit(False).alias("is_left"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["member", "i", "j"], ignore_index=True)
        member, i, j, n, comp, mine = (pdf[k].to_numpy() for k in ("member", "i", "j", "n", "comp", "is_left"))
        sketch = pdf["sketch"].to_numpy()
        start = np.flatnonzero(np.append(True, (member[1:] != member[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        found = np.zeros(len(pdf), bool)
        for lo, hi in zip(start.tolist(), [*start[1:].tolist(), len(pdf)], strict=True):
            found[lo:hi] = near_of_any_width(n[lo:hi], comp[lo:hi], sketch[lo:hi], mine[lo:hi], t)
        return pdf.loc[found, ["member", "cid"]]

    bucket = F.pmod(F.xxhash64("member", "i", "j"), F.lit(4 * buckets)).alias("bucket")  # many lists at a time
    found = left.unionByName(right).groupBy(bucket).applyInPandas(compare, "member long, cid long").distinct()
    return written(held.join(found, ["member", "cid"], "left_semi"), "near")


def blockwise(held: DataFrame, docs: DataFrame, rows: DataFrame, n: int, t: int) -> DataFrame:
    """Links (a, b) of the lists in held(member, cid, n, comp) that join different components, by blocks; written."""
    per = held.groupBy("member", "comp").agg(F.sum("n").alias("n"), F.count("*").alias("m")).groupBy("member").agg(F.sum("n").alias("all"), F.max(F.struct("m", "comp", "n")).alias("top"), F.count("*").alias("comps")).filter("comps > 1")
    blocks = lambda x: F.ceil(x / BLOCK).cast("int")
    per = per.select("member", F.col("top.comp").alias("top"), blocks(F.col("all")).alias("rights"), blocks(F.col("all") - F.col("top.n")).alias("lefts"))
    open_ = written(held.join(per, "member").select("member", "cid", "comp", "top", "rights", "lefts"), "open")
    sets = set_of_each(docs, rows, open_.select("cid").distinct(), n)
    nth = lambda salt, k: F.pmod(F.xxhash64(F.lit(salt), "cid"), F.col(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    left = open_.filter("comp <> top").select("member", "cid", "comp", nth(1, "lefts").alias("i"), each("rights").alias("j"), F.lit(True).alias("is_left"))
    right = open_.select("member", "cid", "comp", nth(2, "rights").alias("j"), each("lefts").alias("i"), F.lit(False).alias("is_left"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        mine = pdf["is_left"].to_numpy(bool)
        return pd.DataFrame(spanning(pdf[mine], pdf[~mine], t), columns=["a", "b"])

    out = left.unionByName(right).join(sets, "cid").groupBy("member", "i", "j").applyInPandas(compare, "a long, b long")
    out = written(out.distinct(), "alike")
    dropped(open_, sets)
    return out


def merged(comps: DataFrame | None, alike: DataFrame) -> DataFrame:
    """node, comp after the links alike(a, b), given those before."""
    if comps is None:
        return components(alike)
    # between the components so far, the new links join some; each class takes its component's new name
    named = comps.withColumnRenamed("node", "_n").withColumnRenamed("comp", "_c")
    for end in ("a", "b"):
        alike = alike.join(named, F.col(end) == F.col("_n"), "left").withColumn(end, F.coalesce("_c", end)).drop("_n", "_c")
    joined = components(alike.filter("a <> b"))
    renamed = comps.join(joined.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    out = written(renamed.union(joined.join(comps.select("node"), "node", "left_anti").select("node", "comp")), "comps")
    dropped(comps, joined)
    return out


def jaccard_components(docs: DataFrame, n: int = 4, t: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, row, comp for docs(doc_id, text); alike: 100 shared >= t in all."""
    buckets = n_buckets(docs, BUCKET_BYTES)
    described = written(describe(docs, n), "described")
    rows = described.filter("n_shingles >= 0").select("doc_id", "row", "n_shingles", "cid")
    sketches = written(described.filter("n_shingles > 0").select("cid", F.col("n_shingles").alias("n"), "sketch").dropDuplicates(["cid"]), "sketches")
    n_docs = max(rows.count(), 1)
    texts = Texts(docs, rows, n, -(-n_docs // buckets))
    frequent, counts = frequent_members(described, n_docs)
    lists = written(postings(docs, n, t, frequent, counts, buckets), "lists")

    def joined(comps: DataFrame | None, pairs: DataFrame) -> DataFrame | None:
        """The components after those of pairs, written, that are alike."""
        if not pairs.isEmpty():
            alike = similar(pairs, texts, t)
            comps = merged(comps, alike)
            dropped(alike)
        dropped(pairs)
        return comps

    def named_by(comps: DataFrame | None, held: DataFrame) -> DataFrame:
        if comps is None:
            return held
        return held.join(comps.withColumnRenamed("node", "cid").withColumnRenamed("comp", "to"), "cid", "left").select("member", "cid", "n", "l", F.coalesce("to", "comp").alias("comp"))

    before = written(lists.filter("bucket IS NULL").select("member", "cid", "n", "l", F.col("cid").alias("comp")), "longer")
    shared = of_short_lists(lists, before)
    dropped(lists)
    comps = joined(None, written(likely(shared, sketches, t), "likely"))
    dropped(shared)
    held = before
    for k in range(ROUNDS):
        if comps is not None:  # each step's shuffle files go before the next step
            held = written(named_by(comps, held), "named")
            dropped(before)
            before = held
        now = one_round(held, k)
        dropped(before)
        pairs = candidates(now, t, sketches if k else None)
        comps = joined(comps, written(pairs if k else likely(pairs, sketches, t), "pairs"))  # at first sketches are fetched for the pairs only
        held, before = now.filter("NOT settled AND NOT pivot").select("member", "cid", "n", "l", "comp"), now
        if held.isEmpty():
            break
    else:
        left = near_classes(named_by(comps, held), sketches, t, buckets)
        alike = blockwise(left, docs, rows, n, t)
        comps = merged(comps, alike)
        dropped(left, alike)
    dropped(before, sketches)

    per_class = rows.groupBy("cid").agg(F.min("doc_id").alias("least"))
    if comps is None:
        comps = docs.sparkSession.createDataFrame([], "node long, comp long")
    named = per_class.join(comps.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    names = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = written(named.join(names, "comp").select("cid", "comp", "component_id"), "named")
    out = rows.join(named, "cid")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "row", "comp")


def keep_one(docs: DataFrame, n: int = 5, t: int = 80) -> DataFrame:
    """The rows of docs of which each component keeps one, that of its least doc_id; rows without words all stay, but once."""
    joined = jaccard_components(docs.select("doc_id", "text"), n, t)
    group = F.when(F.col("n_shingles") > 0, F.col("comp")).otherwise(F.col("row"))
    kept = joined.groupBy(group.alias("g"), (F.col("n_shingles") > 0).alias("some")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    name = unused("_row", docs)
    kept = written(kept.select(F.col("first.row").alias(name)), "kept")
    rows = docs.withColumn(name, row_key())
    return rows.join(kept, name, "left_semi").dropDuplicates([name]).drop(name)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).drop("row", "comp")


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 85 * (nx.n + ny.n - k)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY 1) c USING (doc_id)
"""

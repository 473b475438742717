"""SimHash near-duplicates by bit-sliced comparison (operator 11).

A text's fingerprint has a bit where over half of the hashes of its word shingles have it. Equal fingerprints are one; of two
that differ in at most r bits, at least one of r + 1 parts of the 64 bits is equal, so fingerprints meet in groups by each part.
A group with more than GROUP fingerprints is parted again by r + 1 parts of the bits that its members need not share,
until no group is larger: members that share all but 12 bits are no more than GROUP, so that ends, and nothing is cut.

Within a task the members of many groups stand in bit planes (word w of plane b holds bit b of 64 members). The distances of
a member to 64 others are counted at once: each plane's differences are added to vertical counters with carry-save logic,
which start so that the highest carry means "over the radius". A block of 64 is left as soon as all its distances are over it.
Links within a task become links to the least of their local component, at most one for each member and group.

Defined results: a null text is an empty one; without words the fingerprint is zero and links like any other; fewer words than
a shingle are one shingle; a very long text is hashed whole; rows that repeat an id or a text each come back, with the fingerprint
of their own text; a null doc_id never names a component that has another; other columns are ignored, whatever their names; an
empty table gives no rows."""

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Words, dropped, per_text, table, written
from .jaccard import components

#: Members of a group that one task compares; 2^12, so that groups that share all but 12 bits need no parting.
GROUP = 4096
#: Shingles whose bits are counted at once; blocks of 64 distances that are counted at once; members in a task's batch.
SHINGLES, BLOCKS, BATCH = 200_000, 60_000, 60_000
#: Bits after which blocks that are over the radius are left.
STRIDE = 8
#: Rows (one for each large group, or fingerprint) that may be broadcast.
BROADCAST_ROWS = 500_000
SEED = 42


def fingerprints(texts: list[bytes], n: int = 3) -> np.ndarray:
    """64 bits of each text."""
    w = Words(texts, lower=True)
    size = w.ends - w.starts
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    joined = np.full(int(ends[-1]) + 1 if len(ends) else 0, 32, np.uint8)
    inside = np.ones(len(joined), bool)
    inside[ends] = False
    joined[inside] = w.buf[np.repeat(w.starts - starts, size) + np.flatnonzero(inside)]
    first = np.minimum(np.repeat(w.first[:-1], w.count), np.arange(len(size)))
    # a shingle begins at each word but a text's last n - 1 ones; a text of fewer words has one
    last = w.first[1:][w.doc] - 1 if len(size) else np.empty(0, np.int64)
    at = np.flatnonzero((np.arange(len(size)) + n - 1 <= last) | (np.arange(len(size)) == first) & (w.count[w.doc] < n))
    until = np.minimum(at + n - 1, last[at])
    data, h = joined.tobytes(), xxhash.xxh64_intdigest
    ones, total = np.zeros((len(texts), 64), np.int64), np.bincount(w.doc[at], minlength=len(texts))
    for lo in range(0, len(at), SHINGLES):
        i, j = at[lo : lo + SHINGLES], until[lo : lo + SHINGLES]
        got = np.array([h(data[a:b], SEED) for a, b in zip(starts[i].tolist(), ends[j].tolist(), strict=True)], U64)
        bits = np.unpackbits(got.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        doc = w.doc[i]
        edge = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        ones[doc[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view(U64).ravel()


def link_pairs(fp: np.ndarray, size: np.ndarray, bits: list[int], radius: int):
    """Arrays of places (i, j) in fp, i before j in the same group (size members each, one group after the other), of fingerprints
    that differ in at most `radius` of these bits."""
    words = -(-size // 64)
    first_word, first = np.cumsum(words) - words, np.cumsum(size) - size
    group = np.repeat(np.arange(len(size)), size)
    nth = np.arange(len(fp)) - first[group]
    word, place = first_word[group] + nth // 64, (nth % 64).astype(U64)
    start_of_word = np.repeat(first, words) + 64 * (np.arange(words.sum()) - np.repeat(first_word, words))
    members = np.minimum(64, np.repeat(first + size, words) - start_of_word)
    absent = np.where(members == 64, U64(0), ~U64(0) << np.minimum(members, 63).astype(U64))
    edges = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    planes = {b: np.bitwise_or.reduceat(((fp >> U64(b)) & U64(1)) << place, edges) for b in bits}
    wide = (radius + 1).bit_length() if radius & (radius + 1) else radius.bit_length()
    bias = (1 << wide) - 1 - radius
    ahead = first_word[group] + words[group] - word  # blocks from a member's own on
    upto = np.concatenate([[0], np.cumsum(ahead)])
    lo = 0
    while lo < len(fp):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + BLOCKS, side="right")) - 1)
        one = np.repeat(np.arange(lo, hi), ahead[lo:hi])
        block = np.arange(upto[lo], upto[hi]) - upto[one] + word[one]
        # members up to the own place in the own block are not looked at
        over = absent[block] | np.where(block == word[one], ~U64(0) >> (U64(63) - place[one]), U64(0))
        count = [np.full(len(one), ~U64(0) if bias >> c & 1 else U64(0)) for c in range(wide)]
        lo = hi
        for k, b in enumerate(bits):
            if k % STRIDE == 0:
                live = np.flatnonzero(over != ~U64(0))
                if len(live) < len(over):
                    one, block, over, count = one[live], block[live], over[live], [c[live] for c in count]
                if not len(one):
                    break
            carry = planes[b][block] ^ (U64(0) - ((fp[one] >> U64(b)) & U64(1)))
            for c in range(wide):
                count[c], carry = count[c] ^ carry, count[c] & carry
            over |= carry
        if len(one):
            found, where = np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield one[found], start_of_word[block[found]] + where


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least labels of components after the links (i, j) are added."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def parts_of(mask: int, n: int) -> list[int]:
    """`mask` and one of n parts of the other bits, for each part."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * k // n for k in range(n + 1)]
    return [mask | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def local_links(members: DataFrame, radius: int) -> DataFrame:
    """a, b: links of members(mask, key, fp), all groups small: each member with the least of its component in its group."""

    def linked(mask: np.ndarray, key: np.ndarray, fp: np.ndarray):
        for m in np.unique(mask):
            at = mask == m
            own, k = fp[at], key[at]
            edges = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            size = np.diff(np.append(edges, len(k)))
            if size.max() < 2:
                continue
            several = np.repeat(size > 1, size)
            own, size = own[several], size[size > 1]
            label = np.arange(len(own))
            for i, j in link_pairs(own, size, [b for b in range(64) if not int(m) >> b & 1], radius):
                label = merge(label, i, j)
            moved = np.flatnonzero(label != np.arange(len(own)))
            yield pa.RecordBatch.from_arrays([pa.array(own[x].view(np.int64)) for x in (moved, label[moved])], names=["a", "b"])

    def run(batches):
        held = [np.empty(0, U64)] * 3
        for b in batches:
            new = [b.column(c).to_numpy(zero_copy_only=False).view(U64) for c in ("mask", "key", "fp")]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            if len(held[0]) >= BATCH:
                start = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
                cut = int(start[-1]) + 1 if len(start) else 0  # the last group may go on in the next batch
                yield from linked(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if len(held[0]):
            yield from linked(*held)

    ordered = members.repartition("mask", "key").sortWithinPartitions("mask", "key")
    return ordered.mapInArrow(run, "a long, b long")


def near_links(prints: DataFrame, radius: int = 2) -> list[DataFrame]:
    """Tables of links (a, b) that join all of prints(fp), each there once, that differ in at most `radius` bits into components."""
    spark = prints.sparkSession
    links, masks, rest = [], [], None
    while True:
        if links:
            steps = [(signed(m), [signed(p) for p in parts_of(m, radius + 1)]) for m in masks]
            parts = F.broadcast(spark.createDataFrame(steps, "mask long, parts array<long>"))  # (radius + 1)^k rows in step k
            open_ = rest.join(parts, "mask")
        else:
            open_ = prints.withColumn("parts", F.lit([signed(p) for p in parts_of(0, radius + 1)]).cast("array<long>"))
        keyed = open_.select(F.explode("parts").alias("mask"), "fp").withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        keyed = written(keyed, "keyed")
        large = written(keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP).select("mask", "key"), "large")
        n = large.limit(BROADCAST_ROWS + 1).count()
        hint = F.broadcast(large) if n <= BROADCAST_ROWS else large
        small = keyed.join(hint, ["mask", "key"], "left_anti") if n else keyed
        links.append(written(local_links(small, radius), "links"))
        before = rest
        rest = written(keyed.join(hint, ["mask", "key"], "left_semi").select("fp", "mask"), "open") if n else None
        masks = [r["mask"] & (1 << 64) - 1 for r in large.select("mask").distinct().collect()]  # of those known above
        dropped(keyed, large, before)
        if rest is None:
            return links


def simhash_components(docs: DataFrame, n: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint, component_id of docs(doc_id, text)."""
    rows = written(per_text(docs, ["doc_id"], lambda texts: {"fp": fingerprints(texts, n).view(np.int64)}, "fp long"), "fingerprints")
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    links = near_links(prints.select("fp"), radius)
    comps = components(reduce(DataFrame.union, links))
    dropped(*links)
    comp = F.coalesce("comp", "fp")
    named = prints.join(comps.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", comp.alias("comp"))
    names = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = written(named.join(names, "comp").select("fp", "component_id"), "named")
    dropped(prints, comps)
    few = named.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    out = rows.join(F.broadcast(named) if few else named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))

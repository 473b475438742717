"""LM scoring (operator 10): online logistic context mixing over the bits of a text's words.

Words are counted over all training documents. The HEAD most frequent ones, the end of a text and an escape are the leaves of
a Huffman tree, and a token is the bits on the way to its leaf. Each bit has three predictors: the node's own counts, and
hashed contexts of node and word before, and of node and two words before (so contexts cross words). Their logits are added with weights that a gate picks by how often the contexts were met; an adaptive probability
map refines the sum. All training documents are read in order by their tasks, which predict each block of bits, learn
weights and map from it, and only then count it; the tasks' counts are added and their weights averaged. When a text is
scored, its weights start there and go on learning along it. A word behind the escape has its counted share of such words or,
with the weight that Good and Turing give to unseen ones, is spelled: the bits of its bytes are predicted in the same way from
hashed contexts (place, one, two and three bytes, whole beginning) counted over all distinct words. A token's log10
probabilities add up; over the text's bytes they give bits per byte.

What is broadcast is bounded: HEAD words and their codes, SLOTS and BYTE_SLOTS slots for each context. Words behind the
escape go, with the rows that they stand in, to the bucket that holds their counts, and sums go back to the rows' buckets,
packed. Tables of counts are added by a tree of groups of FOLD. Words are told apart by 64-bit hashes.

Defined results: a null text is an empty one, of the end token only; a null doc_id is a training one; repeated rows have
equal scores; ties of counts go by the words' hashes; a very long text is scored whole, in blocks; without training tokens
base is log10(1 / 1.1) for each; an empty table gives no rows; other columns are ignored, whatever their names.
"""

import heapq

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Words, as_bytes, crc_mod, grouped, mix64, table, written
from .packed import _split, n_buckets, row_key

HEAD = 1 << 17
SLOTS, BYTE_SLOTS = 1 << 20, 1 << 17
#: Arrays added at once; text bytes that one task counts contexts of.
FOLD, COUNTED_BYTES = 32, 100_000_000
#: Words that are spelled, and bytes of text whose bits are predicted, at once in a task.
SPELLED, AT_ONCE = 10_000, 800_000
PACKS = "bucket int, h binary, words binary, which binary, rows binary, who binary, docs binary"
NO_ID = -(2**63)
_DOC = np.dtype([("row", "<u8"), ("doc_id", "<i8"), ("n_tokens", "<i8"), ("n_known", "<i8"), ("base", "<f8"), ("score", "<f8"), ("n_bytes", "<i8")])
_SUM = np.dtype([("row", "<u8"), ("n_known", "<i8"), ("base", "<f8"), ("score", "<f8")])


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U64(20)) % U64(buckets)).astype(np.int64)


def count_words(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, h, c, words: the distinct words of docs(text) and their counts, packed."""

    def find(batches):
        known, counts, words = np.empty(0, U64), np.empty(0, np.int64), np.empty(0, object)
        for b in batches:
            texts = as_bytes(b["text"])
            for lo, hi in grouped(texts):
                w = Words(texts[lo:hi], lower=True)
                h, first, n = np.unique(w.hashes(), return_index=True, return_counts=True)
                place = np.searchsorted(known, h)
                old = np.zeros(len(h), bool)
                inside = place < len(known)
                old[inside] = known[place[inside]] == h[inside]
                counts[place[old]] += n[old]
                data, new = w.buf.tobytes(), ~old
                text = np.empty(int(new.sum()), object)
                text[:] = [data[s:e] for s, e in zip(w.starts[first[new]].tolist(), w.ends[first[new]].tolist(), strict=True)]
                order = np.argsort(np.concatenate([known, h[new]]), kind="stable")
                known, counts, words = (np.concatenate(x)[order] for x in ((known, h[new]), (counts, n[new]), (words, text)))
        yield pd.DataFrame([{"bucket": k, "h": known[i].tobytes(), "c": counts[i].tobytes(), "words": b" ".join(words[i])} for k, i in _split(bucket_of(known, buckets), buckets)], columns=["bucket", "h", "c", "words"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        h, c = np.frombuffer(b"".join(pdf["h"]), U64), np.frombuffer(b"".join(pdf["c"]), np.int64)
        words = b" ".join(pdf["words"]).split(b" ")
        h, first, which = np.unique(h, return_index=True, return_inverse=True)
        c = np.bincount(which, c, len(h)).astype(np.int64)
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "h": [h.tobytes()], "c": [c.tobytes()], "words": [b" ".join([words[i] for i in first.tolist()])]})

    schema = "bucket int, h binary, c binary, words binary"
    return docs.select("text").mapInPandas(find, schema).groupBy("bucket").applyInPandas(add, schema)


def bit_slots(words: list[bytes]):
    """For each byte of the words (each with a space at its end) the slots (contexts, bits) and values of its bits, and the word of each bit."""
    data = np.frombuffer(b"".join(w + b" " for w in words), np.uint8)
    sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), sizes)
    nth = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    back = [np.where(nth >= k, np.append(np.zeros(k, np.uint8), data)[: len(data)], 0).astype(U64) for k in (1, 2, 3)]
    total = np.append(U64(0), np.cumsum(mix64(data.astype(U64) + U64(1) + (nth.astype(U64) << U64(9)))))[:-1]
    begun = total - np.repeat(total[np.cumsum(sizes) - sizes], sizes)
    contexts = [np.minimum(nth, 3).astype(U64), back[0], back[0] | back[1] << U64(8), back[0] | back[1] << U64(8) | back[2] << U64(16), begun]
    contexts = np.stack([mix64(c + (U64(k + 1) << U64(40))) for k, c in enumerate(contexts)])
    bits = np.unpackbits(data.reshape(-1, 1), axis=1).T
    slots, part = np.empty((len(contexts), 8, len(data)), np.int32), np.ones(len(data), np.int64)
    for k in range(8):
        slots[:, k] = (mix64(contexts + part.astype(U64)[None, :] * U64(0x9E3779B1)) >> U64(64 - 17)).astype(np.int32)
        part = part * 2 + bits[k]
    return slots.reshape(len(contexts), -1), bits.ravel(), np.tile(word, 8)


class Online:
    """Hashed-context predictors of bits and how they are mixed: counts of zeros and ones in each slot, weights and a map of
    refined probabilities for each gate. The gate is how often the last two contexts were met, in four steps each."""

    #: RATE scales Newton's steps by single weights; LEARNED: what a gate's start counts for, in bits; BLOCK: bits that are learned from at once.
    RATE, GATES, STEPS, LEARNED, BLOCK = 0.15, 16, 33, 500.0, 1 << 16

    def __init__(self, contexts: int, slots: int, fixed: int = 0):
        self.counts = np.zeros((contexts, slots, 2), np.uint32)
        inputs = contexts + fixed + 1
        # a start: the last two contexts as far as they were met, the others for the rest, the longer ones more
        self.weights = np.zeros((self.GATES, inputs), np.float32)
        far, last = np.repeat(np.arange(4), 4), np.tile(np.arange(4), 4)
        self.weights[:, -3], self.weights[:, -2] = 0.13 * far, 0.17 * last
        share = 2.0 ** np.arange(inputs - 3)
        self.weights[:, :-3] = (1 - self.weights[:, -3] - self.weights[:, -2])[:, None] * share / share.sum()
        self.map = np.tile((1 / (1 + np.exp(-(np.arange(self.STEPS) - 16) / 2.0))).astype(np.float32), (self.GATES, 1))
        self.bend = np.ones((self.GATES, inputs))  # mean of x x p (1 - p)
        self.seen, self.coded, self.waiting = 0.0, 0.0, []
        self.code()

    def code(self) -> None:
        """Each slot's logit (in sixteenths) and how often it was met, in 16 bits."""
        n = self.counts.astype(np.float32)
        logit = np.log((n[..., 1] + 0.3) / (n[..., 0] + 0.3))
        met = n[..., 0] + n[..., 1]  # a sum over so short an axis takes many times as long
        step = (met > 0).astype(np.uint16) + (met > 3) + (met > 30)
        self.codes = (np.clip(np.round(logit * 16) + 512, 0, 1023).astype(np.uint16) << np.uint16(2)) | step.astype(np.uint16)

    def inputs(self, slots: np.ndarray, fixed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        codes = [self.codes[c].take(slots[c]) for c in range(len(slots))]
        x, k = np.empty((len(slots) + (fixed is not None) + 1, slots.shape[1]), np.float32), 0
        if fixed is not None:
            x[0], k = fixed, 1
        for i, v in enumerate(codes, k):
            x[i] = v >> 2
        x[k:-1] -= np.float32(512)
        x[k:-1] *= np.float32(1 / 16)
        x[-1] = 1
        return x, ((codes[-2] & 3) << 2 | codes[-1] & 3).astype(np.uint8)

    def mixed(self, x: np.ndarray, gate: np.ndarray, weights: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of a one for each bit: of the mixture, and refined, with the step of the map."""
        z = np.zeros(len(gate), np.float32)
        row = gate if at is None else at
        for i in range(len(x)):
            z += x[i] * np.ascontiguousarray(weights[:, i]).take(row)
        p, step = self.squashed(z)
        refined = self.map.ravel().take(gate * np.int64(self.STEPS) + step)
        refined += p
        refined *= np.float32(0.5)
        return p, refined, step

    def squashed(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of a one, and the step of the map; z, float32, is used up."""
        np.clip(z, -12, 12, out=z)
        step = np.clip(z * np.float32(2) + np.float32(16.5), 0, self.STEPS - 1).astype(np.uint8)
        np.negative(z, out=z)
        np.exp(z, out=z)
        z += np.float32(1)
        return np.reciprocal(z, out=z), step

    def learn(self, slots: np.ndarray, bits: np.ndarray, fixed: np.ndarray | None = None) -> None:
        """Blocks of bits: each is predicted, learned from, and only then counted."""
        hi = 0
        while hi < len(bits):
            lo, hi = hi, hi + int(min(self.BLOCK, max(1024, self.seen / 4)))  # small blocks at first
            part, b = slots[:, lo:hi], bits[lo:hi]
            x, gate = self.inputs(part, None if fixed is None else fixed[lo:hi])
            order = np.argsort(gate, kind="stable")
            gate, value = gate[order], b[order]
            x, ends = x.take(order, axis=1), np.searchsorted(gate, np.arange(self.GATES + 1))
            gates = np.flatnonzero(np.diff(ends)).tolist()
            z = np.empty(len(value), np.float32)
            for g in gates:
                np.dot(self.weights[g], x[:, ends[g] : ends[g + 1]], out=z[ends[g] : ends[g + 1]])
            p, step = self.squashed(z)
            n, ones = (np.bincount(gate * np.int64(self.STEPS) + step, w, self.map.size).reshape(self.map.shape) for w in (None, value))
            self.map += ((ones - n * self.map) / (n + 300)).astype(np.float32)
            err, square, free = value - p, x * x, p * (1 - p)
            for g in gates:
                own = slice(ends[g], ends[g + 1])
                bend, size = square[:, own] @ free[own], ends[g + 1] - ends[g]
                self.weights[g] = np.clip(self.weights[g] + self.RATE * (x[:, own] @ err[own]) / (bend + self.LEARNED * self.bend[g]), -0.5, 1.5)
                self.bend[g] = (self.bend[g] * self.LEARNED + bend) / (self.LEARNED + size)
            self.waiting.append(part * np.int32(2) + b)
            self.seen += len(b)
            grown = self.seen > (1.25 if self.seen > 1e6 else 1.6) * self.coded
            if grown or len(self.waiting) > 32:
                self.count()
                if grown:
                    self.coded = self.seen
                    self.code()

    def count(self) -> None:
        """Adds the bits that wait to the counts."""
        if self.waiting:
            for c, at in enumerate(np.concatenate(self.waiting, axis=1)):
                self.counts[c].ravel()[:] += np.bincount(at, minlength=self.counts[c].size).astype(np.uint32)
        self.waiting = []

    def rows(self, task: int, parts: int = 16) -> list[dict]:
        """What a task found, to be added to what others did."""
        self.count()
        flat = np.array_split(self.counts.ravel(), parts)
        own = np.concatenate([[self.seen], *(x.ravel() * self.seen for x in (self.weights, self.map, self.bend))])
        return [{"task": task, "part": k, "n": x.tobytes(), "own": own.tobytes() if k == 0 else b""} for k, x in enumerate(flat)]

    def total(self, found: DataFrame, tasks: int) -> "Online":
        """Adds the rows of all tasks, by a tree, so that no group holds more than FOLD of them."""

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("order")  # sums of fractions depend on it
            n = np.minimum(np.sum([np.frombuffer(x, np.uint32) for x in pdf["n"]], axis=0, dtype=np.uint64), 2**32 - 1).astype(np.uint32)
            own = np.sum([np.frombuffer(x, np.float64) for x in pdf["own"]], axis=0)
            return pd.DataFrame({"task": pdf["to"].iloc[:1].astype(np.int32), "part": pdf["part"].iloc[:1], "n": [n.tobytes()], "own": [own.tobytes() if pdf["part"].iloc[0] == 0 else b""]})

        schema = "task int, part int, n binary, own binary"
        while True:
            tasks = -(-tasks // FOLD)
            to = found.select("part", F.pmod("task", F.lit(tasks)).cast("int").alias("to"), F.col("task").alias("order"), "n", "own")
            found = to.groupBy("part", "to").applyInPandas(add, schema)
            if tasks == 1:
                break
            found = written(found, "folded")
        got = found.toPandas().sort_values("part")
        if len(got):
            own = np.frombuffer(got["own"].iloc[0], np.float64)
            if own[0]:
                self.seen, rest = own[0], own[1:] / own[0]
                w, m = self.weights.size, self.map.size
                self.weights, self.map = rest[:w].reshape(self.weights.shape).astype(np.float32), rest[w : w + m].reshape(self.map.shape).astype(np.float32)
                self.bend = rest[w + m :].reshape(self.bend.shape)
                self.counts = np.concatenate([np.frombuffer(x, np.uint32) for x in got["n"]]).reshape(self.counts.shape)
        self.code()
        self.counts = np.zeros((len(self.counts), 0, 2), np.uint32)  # the codes are all that predictions need
        return self


def log10_of(bits: np.ndarray, p: np.ndarray) -> np.ndarray:
    """log10 of what each bit was given."""
    got = np.abs((bits ^ 1) - p)
    return np.log(np.maximum(got, np.float32(1e-6), out=got), out=got) * np.float32(1 / np.log(10))


def dealt(rows: DataFrame, parts: int, by: str) -> DataFrame:
    """rows in so many partitions and in an order that do not depend on how they were read, so that what is learned along them does not.
    A cluster that deals them to more partitions than asked for gets them back in so many tasks, each of which gives whole tables."""
    return rows.repartition(parts, by).sortWithinPartitions(by).coalesce(parts)


def learned_spelling(counts: DataFrame, parts: int) -> Online:
    """Predictors of the bits of words' bytes, from all distinct words."""

    def find(batches):
        own = Online(5, BYTE_SLOTS)
        for b in batches:
            for blob in b["words"]:
                words = blob.split(b" ")
                for lo in range(0, len(words), SPELLED):
                    slots, bits, _ = bit_slots(words[lo : lo + SPELLED])
                    own.learn(slots, bits)
        yield pd.DataFrame(own.rows(TaskContext.get().partitionId()))

    return Online(5, BYTE_SLOTS).total(dealt(counts.select("bucket", "words"), parts, "bucket").mapInPandas(find, "task int, part int, n binary, own binary"), parts)


def spelled(model: Online, words: list[bytes]) -> np.ndarray:
    """log10 probability of each word's bits, its end among them."""
    out = np.zeros(len(words))
    for lo in range(0, len(words), SPELLED):
        slots, bits, word = bit_slots(words[lo : lo + SPELLED])
        x, gate = model.inputs(slots)
        _, p, _ = model.mixed(x, gate, model.weights)
        out[lo : lo + SPELLED] = np.bincount(word, log10_of(bits, p))
    return out


class Tree:
    """Huffman's code of symbols by their counts: for each symbol the nodes and bits on the way to it, and each node's logit."""

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        heap = [(int(c), i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        up, bit, weight = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.uint8), np.zeros(2 * n)
        weight[:n] = counts
        made = n
        while len(heap) > 1:
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            up[i], up[j], bit[j], weight[made] = made, made, 1, a + b
            heapq.heappush(heap, (a + b, made))
            made += 1
        root = made - 1
        live, at = np.arange(n), np.arange(n)
        symbol, node, value = [], [], []
        while len(live := live[at != root]):
            at = at[at != root]
            symbol.append(live)
            node.append(up[at] - n)
            value.append(bit[at])
            at = up[at]
        if not symbol:
            symbol, node, value = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint8)]
        symbol, node, value = (np.concatenate(x) for x in (symbol, node, value))
        order = np.argsort(symbol, kind="stable")
        self.node, self.bit = node[order].astype(np.int32), value[order]
        self.size = np.bincount(symbol, minlength=n)
        self.first = np.cumsum(self.size) - self.size
        ones = np.zeros(max(made - n, 1))
        child = np.flatnonzero(bit[:made] == 1)
        ones[up[child] - n] = weight[child]
        whole = weight[n:made] if made > n else np.ones(1)
        self.logit = np.log((ones + 0.05) / (whole - ones + 0.05)).astype(np.float32)

    def bits(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """token, node and value of each bit."""
        size = self.size[symbols]
        token = np.repeat(np.arange(len(symbols)), size)
        at = np.repeat(self.first[symbols] - (np.cumsum(size) - size), size)
        at += np.arange(len(at))
        return token, self.node.take(at), self.bit.take(at)


class Model:
    """What the corpus gave: totals, the frequent words with their code, the predictors of the code's bits, and of bytes."""

    def __init__(self, counts: DataFrame, train: DataFrame, train_docs: int, train_bytes: int):
        def totals(batches):
            for b in batches:
                for c in b["c"]:
                    c = np.frombuffer(c, np.int64)
                    level, n = np.unique(np.floor(8 * np.log2(c)).astype(int), return_counts=True)
                    per = np.bincount(np.searchsorted(level, np.floor(8 * np.log2(c)).astype(int)), c)
                    yield pd.DataFrame({"level": level, "n": n, "tokens": per.astype(np.int64), "once": np.where(level == 0, n, 0)})

        got = counts.select("c").mapInPandas(totals, "level int, n long, tokens long, once long").groupBy("level").agg(*[F.sum(x).alias(x) for x in ("n", "tokens", "once")]).orderBy(F.desc("level")).toPandas()
        self.tokens = int(got["tokens"].sum()) + train_docs
        self.distinct = int(got["n"].sum()) + (train_docs > 0)
        self.ends = train_docs
        # words met once stand behind the escape, as unseen ones will, so that contexts learn when it is due
        fits = (got["n"].cumsum() <= HEAD) & (got["level"] > 0)
        least = int(got["level"][fits].min()) if fits.any() else 64 * 8

        def head(batches):
            for b in batches:
                for h, c in zip(b["h"], b["c"], strict=True):
                    h, c = np.frombuffer(h, U64), np.frombuffer(c, np.int64)
                    i = np.flatnonzero(np.floor(8 * np.log2(c)) >= least)
                    yield pd.DataFrame({"h": h[i].view(np.int64), "c": c[i]})

        known = counts.select("h", "c").mapInPandas(head, "h long, c long").toPandas()
        h, c = known["h"].to_numpy(np.int64).view(U64), known["c"].to_numpy(np.int64)
        order = np.argsort(h)
        self.head, self.c = h[order], c[order]
        # words behind the escape: their tokens, and the share of unseen ones among them
        self.behind = max(self.tokens - train_docs - int(self.c.sum()), 0)
        self.unseen = min(0.9, max(int(got["once"].sum()), 1) / max(self.behind, 2))
        self.end, self.escape = len(self.head), len(self.head) + 1
        self.tree = Tree(np.concatenate([self.c, [max(train_docs, 1), max(self.behind, 1)]]))
        parts = max(12, -(-train_bytes // COUNTED_BYTES))
        self.spelling = learned_spelling(counts, parts)

        def learn(batches):
            own = Online(2, SLOTS, fixed=1)
            for b in batches:
                texts = as_bytes(b["text"])
                for lo, hi in grouped(texts, AT_ONCE):
                    _, _, node, bit, slots, _ = self.slots(Words(texts[lo:hi], lower=True))
                    own.learn(slots, bit, self.tree.logit.take(node))
            yield pd.DataFrame(own.rows(TaskContext.get().partitionId()))

        found = dealt(train.select(row_key().alias("row"), "text"), parts, "row").mapInPandas(learn, "task int, part int, n binary, own binary")
        self.mix = Online(2, SLOTS, fixed=1).total(found, parts)

    def slots(self, w: Words, at: np.ndarray | None = None, blocks: bool = False):
        """For texts' words and ends: the text of each token, the token of each bit, its node, value and slots, and where the
        bits of each block end. Blocks: each text's first 32 tokens, its next 64, and so on; else all is one."""
        h = w.hashes()
        at = lookup(self.head, h) if at is None else at
        n, per = len(w.count), w.count + 1
        ends = np.cumsum(per) - 1  # where each text's end stands among all tokens
        total = len(h) + n
        inside = np.ones(total, bool)
        inside[ends] = False
        symbol, value = np.full(total, self.end), np.zeros(total, U64)
        symbol[inside], value[inside] = np.where(at < 0, self.escape, at), h
        doc, first = np.repeat(np.arange(n), per), ends + 1 - per
        one = np.append(U64(0), value[:-1])[:total]
        one[first] = U64(1)
        two = np.append(U64(0), one[:-1])[:total]
        two[first] = U64(2)
        contexts = [(mix64(v + U64(c << 60)) >> U64(32)).astype(np.uint32) for c, v in enumerate((one, one * U64(3) + two), 1)]
        upto = [total]
        if blocks:
            place = np.arange(total) - np.repeat(first, per)
            block = (np.frexp((place // 32 + 1).astype(np.float32))[1] - 1).astype(np.uint8)
            order = np.argsort(block, kind="stable")
            symbol, doc, contexts = symbol[order], doc[order], [v[order] for v in contexts]
            upto = np.cumsum(np.bincount(block))
        token, node, bit = self.tree.bits(symbol)
        spread = node.view(np.uint32) * np.uint32(0x9E3779B1)
        shift = np.uint32(32 - (SLOTS.bit_length() - 1))
        slots = np.stack([(((v.take(token) ^ spread) * np.uint32(0x85EBCA6B)) >> shift).view(np.int32) for v in contexts])
        return doc, token, node, bit, slots, np.searchsorted(token, upto)

    def score(self, w: Words, at: np.ndarray) -> np.ndarray:
        """log10 probability of each text's tokens up to what lies behind an escape; the weights go on learning along each text,
        block by block."""
        doc, token, node, bit, slots, upto = self.slots(w, at, blocks=True)
        n, mix, out, lo = len(w.count), self.mix, np.zeros(len(w.count)), 0
        weights, bend = np.tile(mix.weights, (n, 1)), np.tile(mix.bend + 1e-6, (n, 1))
        for hi in upto.tolist():
            of, b = doc.take(token[lo:hi]), bit[lo:hi]
            x, gate = mix.inputs(slots[:, lo:hi], self.tree.logit.take(node[lo:hi]))
            row = of * np.int64(mix.GATES) + gate
            p, refined, _ = mix.mixed(x, gate, weights, row)
            out += np.bincount(of, log10_of(b, refined), n)
            if hi < len(token):
                err, most = b - p, int(of.max(initial=0)) + 1
                met = np.bincount(row, minlength=most * mix.GATES) + mix.LEARNED
                for c in range(len(x)):
                    weights[: len(met), c] += (mix.RATE * np.bincount(row, err * x[c], len(met)) / (met * bend[: len(met), c])).astype(np.float32)
            lo = hi
        return out

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))

    def behind_escape(self, c: np.ndarray, words: list[bytes]) -> np.ndarray:
        """log10 probabilities of words with counts c among those behind the escape."""
        return np.log10((1 - self.unseen) * c / max(self.behind, 1) + self.unseen * 10.0 ** spelled(self.spelling, words) + 1e-300)


def lookup(head: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place in head, sorted, of each hash; -1: not there."""
    if not len(head):
        return np.full(len(h), -1)
    first = np.zeros((1 << 18) + 1, np.int32)
    np.cumsum(np.bincount((head >> U64(46)).astype(np.int64), minlength=1 << 18), out=first[1:])
    top = (h >> U64(46)).astype(np.int64)
    at, upto = first.take(top), first.take(top + 1)
    out, live = np.full(len(h), -1), np.flatnonzero(at < upto)
    while len(live):  # what has not been met goes on to the next of its few
        i = at[live]
        met = head.take(i) == h.take(live)
        out[live[met]] = i[met]
        live = live[~met]
        at[live] += 1
        live = live[at[live] < upto[live]]
    return out


def score_texts(docs: DataFrame, counts: DataFrame, model: Model, buckets: int) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score, n_bytes for each row of docs(doc_id, text)."""
    head, head_base, ends = model.head, model.base(model.c), model.ends
    end_base = float(model.base(np.array([ends]))[0])

    def read(batches):
        parts, held = [], 0

        def flush():
            h, row = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            words = [x for p in parts for x in p[2]]
            kinds = np.concatenate([p[3] for p in parts])  # the hash of each of words
            out = []
            kind_by = dict(_split(bucket_of(kinds, buckets), buckets))
            for k, i in _split(bucket_of(h, buckets), buckets):
                names, first = np.unique(kinds[kind_by[k]], return_index=True)
                rows, who = np.unique(row[i], return_inverse=True)
                out.append({"bucket": k, "h": names.tobytes(), "words": b" ".join([words[j] for j in kind_by[k][first].tolist()]), "which": np.searchsorted(names, h[i]).astype(np.uint32).tobytes(), "rows": rows.tobytes(), "who": who.astype(np.uint32).tobytes(), "docs": b""})
            return pd.DataFrame(out)

        for b in batches:
            texts, keys = as_bytes(b["text"]), b["row"].to_numpy(np.int64).view(U64)
            ids = b["id"].to_numpy(np.int64)
            for lo, hi in grouped(texts, AT_ONCE):
                w = Words(texts[lo:hi], lower=True)
                h = w.hashes()
                at = lookup(head, h)
                there = at >= 0
                doc = np.zeros(hi - lo, _DOC)
                doc["row"], doc["doc_id"], doc["n_bytes"], doc["n_tokens"] = keys[lo:hi], ids[lo:hi], w.lengths, w.count + 1
                doc["n_known"] = np.bincount(w.doc[there], minlength=hi - lo) + (ends > 0)
                doc["base"] = np.bincount(w.doc[there], head_base[at[there]], hi - lo) + end_base
                doc["score"] = model.score(w, at)
                yield pd.DataFrame({"bucket": [int(keys[lo] % U64(buckets))], "h": b"", "words": b"", "which": b"", "rows": b"", "who": b"", "docs": [doc.tobytes()]})
                i = np.flatnonzero(~there)
                names, first = np.unique(h[i], return_index=True)
                data = w.buf.tobytes()
                parts.append((h[i], keys[lo:hi][w.doc[i]], [data[s:e] for s, e in zip(w.starts[i[first]].tolist(), w.ends[i[first]].tolist(), strict=True)], names))
                held += len(i)
                if held > 500_000:
                    yield flush()
                    parts, held = [], 0
        if held:
            yield flush()

    def meet(packs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        """Sums over each row's words behind the escape, packed for the rows' buckets; and what is known of the rows, passed on."""
        own = np.frombuffer(b"".join(packs["docs"]), _DOC)
        out = [{"bucket": k, "docs": own[i].tobytes(), "sums": b""} for k, i in _split((own["row"] % U64(buckets)).astype(np.int64), buckets)]
        packs = packs[packs["which"].map(len) > 0]
        if len(packs):
            names = [np.frombuffer(x, U64) for x in packs["h"]]
            words = [w for x in packs["words"] for w in x.split(b" ")]
            every, first, at = np.unique(np.concatenate(names), return_index=True, return_inverse=True)
            c = np.zeros(len(every), np.int64)
            for h, n in zip(known["h"], known["c"], strict=True):
                h, n = np.frombuffer(h, U64), np.frombuffer(n, np.int64)
                place = np.minimum(np.searchsorted(h, every), len(h) - 1)
                c = np.where(h[place] == every, n[place], c)
            base, score = model.base(c), model.behind_escape(c, [words[i] for i in first.tolist()])
            start = np.cumsum([0, *map(len, names)])
            row = np.concatenate([np.frombuffer(r, U64)[np.frombuffer(w, np.uint32)] for r, w in zip(packs["rows"], packs["who"], strict=True)])
            kind = at[np.concatenate([s + np.frombuffer(w, np.uint32) for s, w in zip(start, packs["which"], strict=False)])]
            rows, which = np.unique(row, return_inverse=True)
            sums = np.zeros(len(rows), _SUM)
            sums["row"], sums["n_known"] = rows, np.bincount(which, c[kind] > 0, len(rows))
            sums["base"], sums["score"] = np.bincount(which, base[kind], len(rows)), np.bincount(which, score[kind], len(rows))
            out += [{"bucket": k, "docs": b"", "sums": sums[i].tobytes()} for k, i in _split((rows % U64(buckets)).astype(np.int64), buckets)]
        return pd.DataFrame(out, columns=["bucket", "docs", "sums"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        """One row for each row of documents. Rows alike in doc_id and text came m times, and so did their words."""
        docs, sums = np.frombuffer(b"".join(pdf["docs"]), _DOC), np.frombuffer(b"".join(pdf["sums"]), _SUM)
        rows, which = np.unique(docs["row"], return_inverse=True)
        m, at = np.bincount(which, minlength=len(rows)), np.searchsorted(rows, sums["row"])
        more = {k: np.bincount(at, sums[k], len(rows)) / np.maximum(m, 1) for k in ("n_known", "base", "score")} if len(rows) else {}
        out = {k: docs[k] for k in ("doc_id", "n_tokens", "n_bytes")}
        out |= {"n_known": docs["n_known"] + np.round(more["n_known"][which]).astype(np.int64), "base_score": docs["base"] + more["base"][which], "score": docs["score"] + more["score"][which]} if len(rows) else {"n_known": docs["n_known"], "base_score": docs["base"], "score": docs["score"]}
        return pd.DataFrame(out)[["doc_id", "n_tokens", "n_known", "base_score", "score", "n_bytes"]]

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text", row_key().alias("row"))
    packs = rows.mapInPandas(read, PACKS)
    sums = written(packs.groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInPandas(meet, "bucket int, docs binary, sums binary"), "sums")
    out = sums.groupBy("bucket").applyInPandas(add, "doc_id long, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for each row of docs(doc_id, text)."""
    docs = docs.select("doc_id", "text")
    buckets = n_buckets(docs)
    train = docs.filter(F.coalesce(crc_mod("doc_id", 10) != 0, F.lit(True)))
    counts = written(count_words(train, buckets), "words")
    n, size = train.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    model = Model(counts, train, n, size)
    scored = score_texts(docs, counts, model, buckets).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
    bits = -F.col("score") * F.lit(float(np.log2(10))) / F.greatest("n_bytes", F.lit(1))
    return scored.withColumn("held_out", F.coalesce(crc_mod("doc_id", 10) == 0, F.lit(False))).withColumn("bits_per_byte", bits)


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")

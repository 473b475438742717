"""Toxicity (operator 6): Levenshtein automata intersected with a lexicon trie.

The lexicon is learned: words, and beginnings of words, that stand in training documents labelled toxic far more often than
in the others, by an exact test and at least 8 times as often (near copies count once). Its trie is intersected with the Levenshtein automaton of one edit; the product is
made deterministic and run over the bytes of all words side by side. A hit counts as quoted if a quotation mark opens
within CONTEXT words before it and one closes within as many after it. A logistic model over hits (exact, beginnings, misspelled,
quoted, the densest window), cross-fitted on all sampled training documents, gives the score.

Defined results: a null text is an empty one; an empty text has no hits and gets the model's score for none; without labels of both
classes every score is the share of label 1 (0 without any); repeated rows have equal scores; of several labels of a doc_id the
greatest counts, of several texts that of the least hash; a null doc_id is a row like any other and is not held out; a very long
text is scored whole; an empty table gives no rows; other columns are ignored by the scores, and kept as they are, whatever
their names, by `drop_toxic`.
"""

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, as_bytes, grouped, mix64, per_text, table, unused
from .labelled import held_out, logistic, sigmoid, training_sample

#: Labelled training documents of each class to learn from, at most.
SAMPLE = 3000
#: Near copies share so much of their words; false terms among those of the lexicon; parts for cross-fitting.
ALIKE, RATE, FOLDS = 0.8, 0.05, 4
CONTEXT, WINDOW = 8, 25
#: Bytes of training text whose features are taken at once.
AT_ONCE = 500_000
#: Bytes that do not belong to words: ASCII but letters and digits.
PARTS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
QUOTES = (b'"', "“".encode(), "”".encode(), "«".encode(), "»".encode(), "„".encode())


def leaders(sets: list[np.ndarray]) -> np.ndarray:
    """For each set of word numbers the first set that is ALIKE (Jaccard) or more like it and is a leader itself; -1 for an
    empty one. Candidates share a band of a signature of 64 least hashes (at 0.8 one in 5,000 pairs shares none); each is verified."""
    seeds = mix64(np.arange(1, 65, dtype=np.uint64))[:, None]
    first: dict[int, tuple[int, ...]] = {}
    out = np.full(len(sets), -1)
    for i, ids in enumerate(sets):
        if not len(ids):
            continue
        least = np.min([mix64(mix64(part.astype(np.uint64) + np.uint64(1)) ^ seeds).min(axis=1) for part in np.array_split(ids, len(ids) // 4096 + 1)], axis=0)
        bands = mix64(mix64(least * seeds[:, 0]).reshape(16, 4).sum(axis=1, dtype=np.uint64)).tolist()
        for j in sorted({j for band in bands for j in first.get(band, ())}):
            both = len(np.intersect1d(ids, sets[j], assume_unique=True))
            if both >= ALIKE * (len(ids) + len(sets[j]) - both):
                out[i] = j
                break
        else:
            out[i] = i
            for band in bands:
                first[band] = (*first.get(band, ()), i)
    return out


def significant(clean: np.ndarray, toxic: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """Which terms, in so many clean and toxic texts of n0 and n1, stand in toxic ones more often than chance allows: Fisher's
    exact test, one-sided, with a share of RATE false ones among those chosen (Benjamini and Hochberg) of the terms that
    could be significant at all, being in enough texts (Tarone)."""
    if not (n0 and n1 and len(toxic)):
        return np.zeros(len(toxic), bool)
    fact = np.append(0, np.cumsum(np.log(np.arange(1, n0 + n1 + 1))))
    choose = lambda n, k: fact[n] - fact[k] - fact[n - k]

    def tail(k: int, n: int) -> float:
        x = np.arange(k, min(n, n1) + 1)
        x = x[n - x <= n0]
        return min(1.0, float(np.exp(choose(n1, x) + choose(n0, n - x) - choose(n0 + n1, n)).sum()))

    size = n0 + n1 + 1
    kinds, which = np.unique(toxic * size + clean + toxic, return_inverse=True)
    p = np.array([tail(k // size, k % size) for k in kinds.tolist()])[which]
    best = {n: tail(min(n, n1), n) for n in np.unique(kinds % size).tolist()}
    best = np.array([best[n] for n in (kinds % size).tolist()])[which]
    k = np.arange(1, len(p) + 1)
    tests = k[np.argmax(np.searchsorted(np.sort(best), RATE / k, side="right") <= k)]
    able = np.flatnonzero(best <= RATE / tests)
    held = np.sort(p[able])
    under = np.flatnonzero(held <= RATE * np.arange(1, len(held) + 1) / max(len(held), 1))
    out = np.zeros(len(p), bool)
    out[able] = p[able] <= held[under[-1]] if len(under) else False
    return out


class Terms:
    """Words, and beginnings of words (4 to 8 bytes), of labelled texts, and in how many texts of each fold and label they stand
    (per_word, per_start; n has all texts with words). Near copies are in one fold, and those of a class are one text with the words of all."""

    def __init__(self, texts: list[bytes], labels: np.ndarray):
        gaps = bytes(32 if p else i for i, p in enumerate(PARTS))
        number: dict[bytes, int] = {}
        sets = []
        for text in texts:
            words = set(Words([text], PARTS, lower=True).buf.tobytes().translate(gaps).split())
            sets.append(np.array(sorted(number.setdefault(w, len(number)) for w in words), np.int32))
        self.words, leader = list(number), leaders(sets)
        del number
        self.fold = (mix64(np.where(leader < 0, np.arange(len(texts)), leader).astype(np.uint64)) % np.uint64(FOLDS)).astype(np.int64)
        starts: dict[bytes, int] = {}
        self.start_of = np.full((len(self.words), 5), -1, np.int32)
        for i, w in enumerate(self.words):
            for n in range(4, min(9, len(w))):
                self.start_of[i, n - 4] = starts.setdefault(w[:n], len(starts))
        self.starts = list(starts)
        del starts
        self.n, self.per_word, self.per_start = (np.zeros((FOLDS, 2, *size), np.int32) for size in ((), (len(self.words),), (len(self.starts),)))
        copies: dict[tuple[int, int], list[int]] = {}
        for i in np.flatnonzero(leader >= 0).tolist():
            copies.setdefault((int(leader[i]), int(labels[i])), []).append(i)
        for (first, y), group in copies.items():  # a text at a time: all its terms at once are many times the texts
            at = self.fold[first], y
            has = sets[group[0]] if len(group) == 1 else np.unique(np.concatenate([sets[i] for i in group]))
            begun = self.start_of[has]
            self.n[at] += 1
            self.per_word[at][has] += 1
            self.per_start[at][np.unique(begun[begun >= 0])] += 1  # beginnings of different lengths are different

    def lexicon(self, taken: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """Words and beginnings that mark toxic texts, by the texts of the folds that are taken."""
        (n0, n1), per_word, per_start = self.n[taken].sum(axis=0).tolist(), self.per_word[taken].sum(axis=0), self.per_start[taken].sum(axis=0)
        clean, toxic = (np.concatenate([per_word[y], per_start[y]]) for y in (0, 1))
        long = np.fromiter((len(w) >= 3 for part in (self.words, self.starts) for w in part), bool, len(clean))
        asked = np.flatnonzero(long & (toxic > 0))
        good = asked[significant(clean[asked], toxic[asked], n0, n1)]
        good = good[toxic[good] / max(n1, 1) >= 8 * (clean[good] + 0.5) / max(n0, 1)]
        # a beginning stands for at least four words; of nested ones with about the same support the longest counts
        of = self.start_of[per_word[1] > 0].ravel()
        forms = np.bincount(of[of >= 0], minlength=len(self.starts))
        begins = {self.starts[i]: i for i in (good[good >= len(self.words)] - len(self.words)).tolist()}
        nested = {w for w, i in begins.items() if any(per_start[1][begins[x]] >= 0.9 * per_start[1][i] for x in (w + bytes([c]) for c in range(33, 256)) if x in begins)}
        starts = sorted(w for w, i in begins.items() if forms[i] >= 4 and w not in nested)
        words = (self.words[i] for i in good[good < len(self.words)].tolist())
        return sorted(w for w in words if not any(w[:n] in starts for n in range(4, 9))), starts


class Automaton:
    """The trie of words and beginnings, intersected with one edit for words of five bytes or more, made deterministic.
    next[state, letter]; kind[state] at a word's end: 0 nothing, 1 one edit away, 2 exact; begun[state]: a beginning has just been read."""

    def __init__(self, words: list[bytes], starts: list[bytes]):
        letters = sorted({c for w in [*words, *starts] for c in w})
        self.letter = np.zeros(256, np.int64)
        self.letter[letters] = np.arange(1, len(letters) + 1)
        child: list[dict[int, int]] = [{}]
        ends, begins, fuzzy = set(), set(), {0}
        for w, kind in [(w, ends) for w in words] + [(w, begins) for w in starts]:
            at = 0
            for c in w:
                if c not in child[at]:
                    child.append({})
                    child[at][c] = len(child) - 1
                at = child[at][c]
                if kind is ends and len(w) >= 5:
                    fuzzy.add(at)
            kind.add(at)

        def close(states):  # an edit may skip a letter of the lexicon
            out = set(states)
            for node, edits in states:
                if edits == 0:
                    out |= {(to, 1) for to in child[node].values() if to in fuzzy}
            return frozenset(s for s in out if not (s[1] == 1 and (s[0], 0) in out))

        first = close({(0, 0)})
        number, queue, rows = {first: 1, frozenset(): 0}, [first], {0: [0] * (len(letters) + 1)}
        while queue:
            state = queue.pop()
            row = []
            for c in [None, *letters]:
                to = set()
                for node, edits in state:
                    if c in child[node]:
                        to.add((child[node][c], edits)) if edits == 0 or child[node][c] in fuzzy else None
                    if edits == 0:
                        to.add((node, 1)) if node in fuzzy else None
                        to |= {(x, 1) for x in child[node].values() if x in fuzzy}
                to = close(to)
                if to not in number:
                    number[to] = len(number)
                    queue.append(to)
                row.append(number[to])
            rows[number[state]] = row
        self.next = np.array([rows[i] for i in range(len(number))], np.int64)
        self.kind, self.begun = np.zeros(len(number), np.int8), np.zeros(len(number), bool)
        long_ends = {e for e in ends if e in fuzzy}
        for state, i in number.items():
            self.kind[i] = 2 if any(e == 0 and n in ends for n, e in state) else 1 if any(n in long_ends for n, _ in state) else 0
            self.begun[i] = any(e == 0 and n in begins for n, e in state)

    def run(self, w: Words) -> np.ndarray:
        """For each word 0 nothing, 1 misspelled, 2 exact, 3 begins like a toxic word."""
        out = np.zeros(len(w.starts), np.int8)
        alive = np.arange(len(w.starts))
        state = np.ones(len(alive), np.int64)
        at, ends = w.starts, w.ends
        while len(alive):
            state = self.next[state, self.letter[w.buf[at]]]
            at = at + 1
            began = self.begun[state]
            out[alive[began]] = 3
            done = at >= ends
            over = done & ~began
            out[alive[over]] = np.maximum(out[alive[over]], self.kind[state[over]])
            go = ~done & ~began & (state > 0)
            alive, state, at, ends = alive[go], state[go], at[go], ends[go]
        return out


def features(texts: list[bytes], automaton: Automaton) -> np.ndarray:
    w = Words(texts, PARTS, lower=True)
    kind = automaton.run(w)
    n = len(texts)
    hit = np.flatnonzero(kind)
    doc = w.doc[hit]
    # quoted: a mark among the bytes of the words before, and one among those after, in the same text
    data = w.buf.tobytes()
    lo = w.starts[np.maximum(hit - CONTEXT, w.first[doc])]
    hi = w.ends[np.minimum(hit + CONTEXT, w.first[doc + 1] - 1)] + 1
    quoted = np.array([any(q in data[a:b] for q in QUOTES) and any(q in data[c:d] for q in QUOTES) for a, b, c, d in zip((lo - 1).clip(0).tolist(), w.starts[hit].tolist(), w.ends[hit].tolist(), hi.tolist(), strict=True)], bool)
    out = [np.ones(n)]
    for k in (2, 3, 1):
        c = np.bincount(doc[(kind[hit] == k) & ~quoted], minlength=n)
        out += [c > 0, np.log1p(c)]
    out.append(np.log1p(np.bincount(doc[quoted], minlength=n)))
    # the most exact or begun hits in any window of WINDOW words
    sure = hit[(kind[hit] > 1) & ~quoted]
    upto = np.searchsorted(sure, np.minimum(sure + WINDOW, w.first[w.doc[sure] + 1]))
    most = np.zeros(n)
    np.maximum.at(most, w.doc[sure], upto - np.arange(len(sure)))
    out += [np.log1p(most), np.log1p(w.count) / 10, np.bincount(w.doc[sure], minlength=n) / np.maximum(w.count, 20)]
    return np.column_stack(out).astype(float)


class Toxicity:
    """Lexicon from all training documents. The logistic model's features of each come from a lexicon of the other FOLDS, so
    that no document is rated by terms it taught; near copies lie in one fold."""

    def __init__(self, texts: list[bytes], labels: np.ndarray):
        self.constant, self.automaton = float(labels.mean()) if len(labels) else 0.0, None
        if len(set(labels.tolist())) < 2:
            return
        terms = Terms(texts, labels)
        x = None
        for k in range(FOLDS):
            automaton, at = Automaton(*terms.lexicon(np.arange(FOLDS) != k)), np.flatnonzero(terms.fold == k)
            for lo, hi in grouped([texts[i] for i in at], AT_ONCE):
                part = features([texts[i] for i in at[lo:hi]], automaton)
                x = np.zeros((len(texts), part.shape[1])) if x is None else x
                x[at[lo:hi]] = part
        self.weight = logistic(x, labels.astype(float), ridge=0.3)
        self.words, self.starts = terms.lexicon(np.ones(FOLDS, bool))
        self.automaton = Automaton(self.words, self.starts)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.automaton is None:
            return np.full(len(texts), self.constant)
        return sigmoid(features(texts, self.automaton) @ self.weight)


def fit_toxicity(docs: DataFrame, labels: DataFrame, each: int = SAMPLE) -> Toxicity:
    rows = training_sample(docs, labels, "toxic", each).orderBy(F.xxhash64("doc_id")).select("text", "label").toArrow()
    texts, marks = as_bytes(rows["text"].combine_chunks()), rows["label"].to_numpy().astype(np.int64)
    del rows  # the driver holds the texts once
    return Toxicity(texts, marks)


def score_toxicity(docs: DataFrame, model: Toxicity, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The columns `keep` of docs with a score for each row."""
    return per_text(docs, list(keep), lambda texts: {name: model.score(texts)}, f"{name} double")


def drop_toxic(docs: DataFrame, model: Toxicity, least: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, that score below `least`."""
    name = unused("score", docs)
    return score_toxicity(docs, model, tuple(docs.columns), name).filter(F.col(name) < least).drop(name)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))

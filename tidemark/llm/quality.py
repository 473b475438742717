"""Quality classifier (operator 4): a linear-chain conditional random field over the lines of a document.

Each line is good or bad; its score looks at its own shape and at those of the lines before and after it. Marginals by
forward-backward, weighted by the lines' lengths, give a document's share of good text, and a logistic curve turns it into
the score. Fitted on at most SAMPLE labelled training documents of each class; every line begins with its document's
label, and lines of bad documents that the first fit finds clearly good are taken as good in the second.

Defined results: a null text is an empty one, of a single empty line; repeated rows have equal scores; without labels of
both classes every score is the share of label 1 (0.5 without any); of several labels of a doc_id the greatest counts, of
several texts that of the least hash; a null doc_id is a row like any other and is not held out; a very long text is scored
whole, at some 300 bytes a line; an empty table gives no rows; other columns are ignored, whatever their names.
"""

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, as_bytes, per_text, table
from .labelled import held_out, logistic, sigmoid, training_sample

#: Labelled documents of each class to fit on, at most.
SAMPLE = 600
_CLASS = np.zeros(256, np.int64)  # 0 others
_CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[32, 9, 13]] = 4
_CLASS[[ord(c) for c in ".,;:'\"-()?"]] = 5
_CLASS[ord("!")] = 6
_CLASS[ord("|")] = 7
_CLASS[[ord(c) for c in "#$%&*@^~=+_"]] = 8
_CLASS[[ord(c) for c in "<>{}[]\\/"]] = 9
N_OWN = 22


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features of all lines; their lengths; and the lines of each text."""
    w = Words(texts)
    stop = w.begin[1:] - 1
    ends = w.buf == 10
    ends[stop] = True
    at = np.flatnonzero(ends)
    n = len(at)
    size = np.diff(np.concatenate([[-1], at])) - 1
    line = np.cumsum(ends) - ends
    kinds = np.bincount(line * 10 + _CLASS[w.buf], minlength=n * 10).reshape(n, 10).astype(float)
    kinds[:, 4] -= np.isin(at, stop)  # the joint between texts
    word_line = line[w.starts]
    words = np.bincount(word_line, minlength=n).astype(float)
    h = w.hashes()
    again = np.append(False, h[1:] == h[:-1]) & np.append(False, word_line[1:] == word_line[:-1])
    again2 = np.append([False] * 2, (h[2:] == h[:-2]) & (word_line[2:] == word_line[:-2]))[: len(h)] if len(h) > 1 else np.zeros(len(h), bool)
    repeats = np.bincount(word_line, again | again2, n)
    # the words of a line that stood earlier in its document's lines, by pairs
    pair = np.append(h[:-1] * np.uint64(3) + h[1:], np.uint64(0))[: len(h)] + w.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, first, which = np.unique(pair, return_index=True, return_inverse=True)
    earlier = np.bincount(word_line, first[which] != np.arange(len(pair)), n)
    chars, some = np.maximum(size, 1), np.maximum(words, 1)
    letters = kinds[:, 1] + kinds[:, 2]
    upper, marks, bars, bangs = kinds[:, 2] / np.maximum(letters, 1), kinds[:, 8] / some, kinds[:, 7] / some, kinds[:, 6] / some
    own = np.column_stack([
        np.log1p(size) / 5, np.log1p(words) / 4, letters / chars, upper, upper > 0.5, kinds[:, 3] / chars, kinds[:, 5] / chars, bangs, bangs > 0.3,
        bars, bars > 0.2, marks, marks > 0.3, kinds[:, 9] / chars, repeats / some, repeats / some > 0.3, earlier / some, earlier / some > 0.5,
        letters / some / 10, size == 0, words == 1, kinds[:, 0] / chars,
    ])
    per = np.bincount(np.searchsorted(w.begin[1:], at, side="right"), minlength=len(texts))
    return own.astype(np.float32), chars.astype(np.float32), per


def neighbours(own: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What stands before and after each row of own in its text, nothing at its ends."""
    first = np.concatenate([[0], np.cumsum(per)])
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return before, after


def with_neighbours(own: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Features of all lines, own and neighbours', with a constant."""
    return np.column_stack([own, *neighbours(own, per), np.ones(len(own))]).astype(np.float32)


def line_scores(own: np.ndarray, per: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """with_neighbours(own, per) @ weight, without making it: a text of very many lines takes three numbers a line more."""
    n = own.shape[1]
    shares = own @ np.stack([weight[:n], weight[n : 2 * n], weight[2 * n : 3 * n]], axis=1)
    return shares[:, 0] + neighbours(shares[:, 1], per)[0] + neighbours(shares[:, 2], per)[1] + weight[-1]


class Chain:
    """Two states a line: bad and good. move[a, b]: score of b after a."""

    def __init__(self, weight: np.ndarray, move: np.ndarray):
        self.weight, self.move = weight, move

    def marginals(self, lines: np.ndarray, per: np.ndarray, pairs: bool = False):
        """For lines' scores: probability of good for each line; with pairs also the expected moves. Documents go side by side, the longest first."""
        x = lines
        score = np.zeros((len(x), 2))
        score[:, 1] = lines
        order = np.argsort(-per, kind="stable")
        first = (np.cumsum(per) - per)[order]
        length = per[order]
        most = int(length[0]) if len(length) else 0
        alive = [int(np.searchsorted(-length, -t, side="left")) for t in range(most)]
        alpha, beta, top = np.zeros((len(x), 2)), np.zeros((len(x), 2)), self.move

        def both(a, m):  # log-sum-exp over the state before
            v = a[:, :, None] + m
            hi = v.max(axis=1)
            return hi + np.log(np.exp(v - hi[:, None, :]).sum(axis=1))

        for t in range(most):
            i = first[: alive[t]] + t
            alpha[i] = score[i] if t == 0 else both(alpha[i - 1], top) + score[i]
        for t in range(most - 2, -1, -1):
            i = first[: alive[t + 1]] + t
            beta[i] = both(beta[i + 1] + score[i + 1], top.T)
        good = sigmoid((alpha + beta)[:, 1] - (alpha + beta)[:, 0])
        if not pairs:
            return good
        inner = np.ones(len(x), bool)
        inner[np.cumsum(per) - 1] = False
        i = np.flatnonzero(inner)
        v = alpha[i][:, :, None] + top + (score[i + 1] + beta[i + 1])[:, None, :]
        v = np.exp(v - v.max(axis=(1, 2), keepdims=True))
        return good, (v / v.sum(axis=(1, 2), keepdims=True)).sum(axis=0), i

    def shares(self, own, chars, per) -> np.ndarray:
        """Length-weighted share of good text of each document."""
        doc = np.repeat(np.arange(len(per)), per)
        return np.bincount(doc, self.marginals(line_scores(own, per, self.weight), per) * chars, len(per)) / np.bincount(doc, chars, len(per))


def fit_chain(x: np.ndarray, per: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 15, rate: float = 0.5) -> Chain:
    """Maximum likelihood of line labels y, from a logistic start, by gradient steps scaled by their running size."""
    chain = Chain(logistic(x, y, weight), np.zeros((2, 2)))
    norm_w, norm_m = np.zeros(x.shape[1]), np.zeros((2, 2))
    for k in range(steps):
        good, moves, i = chain.marginals(x @ chain.weight, per, pairs=True)
        seen = np.zeros((2, 2))
        np.add.at(seen, ((y[i] > 0.5).astype(int), (y[i + 1] > 0.5).astype(int)), 1)
        gw = (x.T @ (y - good) - 0.5 * chain.weight) / len(x)
        gm = (seen - moves - 0.5 * chain.move) / len(x)
        norm_w, norm_m = 0.8 * norm_w + 0.2 * gw**2, 0.8 * norm_m + 0.2 * gm**2
        chain.weight = chain.weight + rate * 0.9**k * 0.2 * gw / np.sqrt(norm_w + 1e-8)
        chain.move = chain.move + rate * 0.9**k * 0.2 * gm / np.sqrt(norm_m + 1e-8)
    return chain


class Quality:
    """The chain and the curve from share of good text to score; constant if there is nothing to tell apart."""

    def __init__(self, texts: list[bytes], labels: np.ndarray):
        self.constant = float(labels.mean()) if len(labels) else 0.5
        self.chain = None
        if len(set(labels.tolist())) < 2:
            return
        own, chars, per = line_features(texts)
        x = with_neighbours(own, per)
        doc = np.repeat(np.arange(len(per)), per)
        even = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (len(labels) - labels.sum())) * len(labels)
        weight = (chars / np.bincount(doc, chars)[doc]) * per[doc] * even[doc]
        y = labels[doc].astype(float)
        first = sigmoid(x @ logistic(x, y, weight))
        y = np.where((y == 0) & (first > 0.8), 1.0, y)
        self.chain = fit_chain(x, per, y, weight)
        self.curve = logistic(self._inputs(own, chars, per), labels.astype(float), ridge=0.1)

    def _inputs(self, own, chars, per):
        share = self.chain.shares(own, chars, per)
        return np.column_stack([np.ones(len(per)), np.clip(np.log(share + 1e-3) - np.log(1 - share + 1e-3), -6, 6), share])

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.chain is None:
            return np.full(len(texts), self.constant)
        return sigmoid(self._inputs(*line_features(texts)) @ self.curve)


def fit_quality(docs: DataFrame, labels: DataFrame, each: int = SAMPLE) -> Quality:
    rows = training_sample(docs, labels, "quality", each).toPandas().sort_values("doc_id")
    return Quality(as_bytes(rows["text"]), rows["label"].to_numpy(np.int64))


def score_quality(docs: DataFrame, model: Quality) -> DataFrame:
    """doc_id, score for each row of docs(doc_id, text)."""
    return per_text(docs, ["doc_id"], lambda texts: {"score": model.score(texts)}, "score double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

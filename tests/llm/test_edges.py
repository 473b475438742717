"""Every operator on rows with nulls, repeated rows, huge ids, empty and very long texts and clashing columns; and plain versions of what SQL cannot say."""

import itertools
import math
import random

import numpy as np
import pytest

from tidemark.llm import common, mixing_lm, quality, token_files, toxicity
from tidemark.llm.decontamination import contamination
from tidemark.llm.jaccard import jaccard_components, keep_one
from tidemark.llm.jpeg import media_features, with_media
from tidemark.llm.mixing import mix, mixed_rows
from tidemark.llm.mixing_lm import lm_scores
from tidemark.llm.substrings import remove_repeats
from tidemark.llm.suffixes import remove_substrings

ROWS = [
    (None, "No id here", "a"), (None, "No id here", "a"), (2**60 + 1, "one two three four five", "a"), (2**60 + 3, "one two three four six", "b"), (1, None, "b"), (2, "", None),
    (3, "same text of some words", "a"), (3, "same text of some words", "a"), (4, "same text of some words", "b"), (5, "long " * 60_000 + "\n" * 60_000, "b"), (6, "é 日本  x\ty\n", "a"), (3, "same id, other text", "b"),
]
CLASHES = ["row", "bucket", "start", "score", "cid", "comp", "member", "h", "words", "key", "shards", "_id", "_row", "_d", "_t", "at", "head", "whole", "label", "item", "media", "n_bytes", "copy", "shard"]


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.selectExpr("*", *[f"{i} AS `{c}`" for i, c in enumerate(CLASHES)])


def learned(kind):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["calm", "fair", "plain", "awfulword" if i % 2 else "kind"]) for _ in range(30)).encode() for i in range(60)]
    return kind(texts, np.array([i % 2 for i in range(60)]))


def files(docs):
    return token_files.read_token_files(token_files.write_token_files(docs, common.new_dir(docs.sparkSession, "tokens"), token_files.vocabulary()))


def op3(docs):
    return contamination(docs, docs.sparkSession.createDataFrame([(1, "same text of some words"), (None, None), (2, "")], "item_id long, text string")).drop("text_key")


OPERATORS = {
    "op1": lambda d: remove_substrings(d),
    "op2": lambda d: media_features(with_media(d)),
    "op3": op3,
    "op4": lambda d: quality.score_quality(d, learned(quality.Quality)),
    "op5": files,
    "op6": lambda d: toxicity.score_toxicity(d, learned(toxicity.Toxicity)),
    "op7": lambda d: jaccard_components(d),
    "op8": lambda d: remove_repeats(d),
    "op9": lambda d: mix(d),
    "op10": lambda d: lm_scores(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(spark, name):
    got = OPERATORS[name](table(spark, ROWS)).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((r[0] for r in ROWS), key=str)
    if name not in ("op5", "op9"):  # there each row has its own place or draw
        same = [tuple(x for k, x in r.asDict().items()) for r in got if r.doc_id is None]
        assert same[0] == same[1]
    assert OPERATORS[name](table(spark, [])).collect() == []


def test_stages_keep_rows_and_columns(spark):
    docs = table(spark, ROWS)
    kept = toxicity.drop_toxic(docs, learned(toxicity.Toxicity))
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    one = keep_one(docs)
    assert one.columns == docs.columns
    assert sorted((r.doc_id for r in one.collect()), key=str) == sorted([None, 2**60 + 1, 2**60 + 3, 1, 2, 3, 3, 5, 6], key=str)
    mixed = mixed_rows(docs)
    assert mixed.columns == docs.columns
    assert {r.doc_id for r in mixed.collect()} <= {r[0] for r in ROWS}


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5):
        score, move = rng.normal(size=n), rng.normal(size=(2, 2))
        weight, good = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(score[i] for i in range(n) if y[i]) + sum(move[y[i], y[i + 1]] for i in range(n - 1)))
            weight += w
            good += w * np.array(y)
        chain = quality.Chain(np.zeros(1), move)
        assert chain.marginals(score, np.array([n])) == pytest.approx(good / weight)
        assert quality.line_scores(np.ones((n, 1), np.float32), np.array([n]), np.array([1.0, 2.0, 4.0, 8.0])) == pytest.approx([9 + 2 * (i > 0) + 4 * (i < n - 1) for i in range(n)])


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_edit_distances():
    rng = random.Random(4)
    say = lambda lo, hi: "".join(rng.choice("abc") for _ in range(rng.randint(lo, hi))).encode()
    for _ in range(30):
        lexicon = sorted({say(3, 8) for _ in range(4)})
        words = [say(1, 9) for _ in range(200)] + lexicon
        found = toxicity.Automaton(lexicon, []).run(common.Words([b" ".join(words)], toxicity.PARTS))
        want = [2 if w in lexicon else 1 if any(len(x) >= 5 and edits(w, x) == 1 for x in lexicon) else 0 for w in words]
        assert found.tolist() == want


def test_lm_against_a_plain_mixer(spark):
    """The sum over bits of short texts, walked one by one; and words in another order score otherwise."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(words) for _ in range(25)) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = mixing_lm.written(mixing_lm.count_words(rows, 12), "words")
    model = mixing_lm.Model(counts, rows, len(texts), sum(map(len, texts)))
    asked = [texts[0].encode(), b" ".join(reversed(texts[0].encode().split())), b"w1", b""]
    w = common.Words(asked, lower=True)
    got = model.score(w, mixing_lm.lookup(model.head, w.hashes()))
    mixer, tree = model.mix, model.tree
    mask = (1 << 64) - 1

    def mixed(x):
        return int(common.mix64(np.array([x & mask], np.uint64))[0])

    hashes = {x: int(h) for x, h in zip(words, common.Words([x.encode() for x in words]).hashes(), strict=True)}
    for text, score in zip(asked, got, strict=True):
        tokens, total, before, two = [*text.decode().split(), None], 0.0, 1, 2
        for place, t in enumerate(tokens):
            h = 0 if t is None else hashes[t]
            symbol = model.end if t is None else int(np.flatnonzero(model.head == h)[0])
            for k in range(tree.first[symbol], tree.first[symbol] + tree.size[symbol]):
                node, bit = int(tree.node[k]), int(tree.bit[k])
                x, met = [float(tree.logit[node])], []
                for c, context in enumerate((before, before * 3 + two), 1):
                    top = mixed(context + (c << 60)) >> 32
                    slot = ((((top ^ (node * 0x9E3779B1 & 0xFFFFFFFF)) * 0x85EBCA6B) & 0xFFFFFFFF) >> (32 - (mixing_lm.SLOTS.bit_length() - 1)))
                    code = int(mixer.codes[c - 1][slot])
                    x.append(((code >> 2) - 512) / 16)
                    met.append(code & 3)
                gate = met[0] * 4 + met[1]
                z = max(-12.0, min(12.0, sum(a * float(b) for a, b in zip([*x, 1.0], mixer.weights[gate], strict=True))))
                p = (1 / (1 + math.exp(-z)) + float(mixer.map[gate, min(max(round(z * 2) + 16, 0), 32)])) / 2
                total += math.log10(max(p if bit else 1 - p, 1e-6))
            two, before = before, h
            if place == 0:
                two = 1
        assert score == pytest.approx(total, rel=1e-3)
    assert abs(got[0] - got[1]) > 1e-6

import random

import numpy as np
import pytest

from tidemark.llm import jaccard
from tidemark.llm.jaccard import jaccard_components


def shingles(text, n=4):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).split()
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(rows, t=85):
    sets, root = [shingles(x) for _, x in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= t * (len(sets[i]) + len(sets[j]) - k):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(least[r], d)
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def run(spark, rows, schema="doc_id long, text string"):
    return sorted((tuple(r)[:3] for r in jaccard_components(spark.createDataFrame(rows, schema)).collect()), key=str)


@pytest.mark.parametrize("small,rounds", [(1, 9), (8, 3), (0, 0), (1, 1)])
def test_against_brute_force(spark, monkeypatch, small, rounds):
    """With pivots from the start, a class a task, sets by shuffled joins; with short lists at once; by blocks only, and after a round."""
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard, "BLOCK", 200)
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "PIVOTS", 1)
    monkeypatch.setattr(jaccard, "SALTED", 2)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", max(small - 1, 0))
    monkeypatch.setattr(jaccard, "FREQUENT_LEAST", 5)
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    hot = [rng.choice(words) for _ in range(30)]
    rows = [(None, "a b c"), (1, None), (2, ""), (3, "One  two"), (4, "one two"), (5, "one"), (6, " \n "), (7, "a b c d"), (8, "A B C D")]
    for i in range(10, 110):
        if i % 3 == 0:
            t = [rng.choice(words) for _ in range(rng.randint(20, 60))] + hot
        else:
            t = rng.choice(rows[-5:])[1].split() if i > 20 else [rng.choice(words) for _ in range(40)]
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join(t)))
    assert run(spark, rows) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    rows = [(1, "a b c d e f", 9, 9), (2, "a b c d e f", 9, 9)]
    assert run(spark, rows, "doc_id long, text string, cid long, comp int") == [(1, 3, 1), (2, 3, 1)]


def test_words_that_a_polynomial_confuses_and_ids_beside_null(spark):
    """The word of Thue and Morse and its complement have equal polynomial hashes modulo 2**64, whatever the base."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(2**60 + 1, f"x y z {a}"), (2**60 + 3, f"x y z {b}"), (None, f"x y z {b}"), (2**60 + 5, "x y z " + "long" * 5000)]
    assert run(spark, rows) == sorted([(2**60 + 1, 1, 2**60 + 1), (2**60 + 3, 1, 2**60 + 3), (None, 1, 2**60 + 3), (2**60 + 5, 1, 2**60 + 5)], key=str)


def test_sketches_never_part_sets_that_are_alike():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, rng.integers(1, 900)).astype(np.uint64)) for _ in range(40)]
    for s in sets[:30]:  # near copies, some of them just as alike as a link asks for
        sets.append(np.unique(np.concatenate([s[: len(s) - rng.integers(0, len(s) // 6 + 1)], rng.integers(0, 2**63, rng.integers(0, 3)).astype(np.uint64)])))
    size = np.array([len(s) for s in sets])
    sketch = jaccard.sketches_of(np.repeat(np.arange(len(sets)), size), np.concatenate(sets), len(sets))
    every = np.arange(len(sets))
    alike = {(i, j) for i in range(len(sets)) for j in range(len(sets)) if i != j and 100 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (size[i] + size[j] - k)}
    near = {(i, j) for i in range(len(sets)) for j in every.tolist() if i != j and jaccard.near(size, every, sketch.view(np.uint64), every[i : i + 1], every[j : j + 1], 85)[[i, j]].all()}
    assert len(alike) > 20 and alike <= near
    assert len(near) < len(sets) * len(sets) / 10  # and most of the others are ruled out


def test_few_pairs_of_near_copies_that_are_not_alike(spark, monkeypatch):
    """600 texts that each change some words of one: they share frequent members, but few are alike. Pairs that move with their sets stay few."""
    moved = []
    similar = jaccard.similar
    monkeypatch.setattr(jaccard, "similar", lambda pairs, sets, t: moved.append(pairs.count()) or similar(pairs, sets, t))
    rng = random.Random(4)
    text = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(600):
        t = list(text)
        for _ in range(5):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    assert run(spark, rows) == brute(rows)
    assert sum(moved) < 2 * len(rows)


def test_long_texts_that_are_not_alike_move_no_sets(spark, monkeypatch):
    """60 texts of 3,000 words, each with a tenth of one text's words changed: a narrow sketch is full and rules none of them out."""
    moved = []
    similar = jaccard.similar
    monkeypatch.setattr(jaccard, "similar", lambda pairs, sets, t: moved.append(pairs.count()) or similar(pairs, sets, t))
    rng = random.Random(5)
    text = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(60):
        t = list(text)
        for k in rng.sample(range(3000), 300):
            t[k] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(t)))
    rows.append((60, rows[7][1] + " more"))
    assert run(spark, rows) == brute(rows)
    assert sum(moved) < 10


def shuffled(spark):
    """Bytes that this application has shuffled so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    executors = sc.statusStore().executorList(True)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


@pytest.mark.parametrize("copies,most", [(6, 1.5), (12, 4.5)])
def test_near_copies_of_all_texts_move_little(spark, copies, most):
    """All texts have near copies: on short lists, and on longer ones. Each text goes to one place, whatever its pairs, and pairs of lists are packed."""
    rng = random.Random(6)
    rows = []
    for i in range(720 // copies):
        t = [f"{rng.randrange(16**6):x}" for _ in range(500)]
        for k in range(copies):
            near = list(t)
            near[rng.randrange(500)] = f"copy{k}"
            rows.append((len(rows), " ".join(near)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if there were many more
    before = shuffled(spark)
    try:
        got = run(spark, rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = shuffled(spark) - before
    assert got == [(i, n, i // copies * copies) for i, n, _ in got] and len(got) == len(rows)
    assert moved < most * sum(len(x) for _, x in rows)


def test_classes_with_many_pairs_are_dealt_to_several_places(spark, monkeypatch):
    """A hub with 900 pairs beside a clique: pairs are dealt once each, the hub goes to several places, and others to one."""
    monkeypatch.setattr(jaccard, "TOGETHER", 100)
    star, clique = [(7, i) for i in range(100, 1000)], [(i, j) for i in range(10, 16) for j in range(i + 1, 16)]
    dealt = [tuple(r) for r in jaccard.places(spark.createDataFrame(star + clique, "a long, b long"), 50).collect()]
    assert sorted(x[:2] for x in dealt) == sorted(star + clique)
    of = lambda c: {p for a, b, p in dealt if c in (a, b)}
    assert len(of(7)) > 3 and all(len(of(c)) == 1 for c in [*range(10, 16), *range(100, 1000)])

import math
import random
import zlib
from collections import Counter

import pytest

from tidemark.llm import mixing_lm
from tidemark.llm.mixing_lm import lm_scores


def words(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()


def brute(rows):
    train = [x for x in rows if x[0] is None or zlib.crc32(str(x[0]).encode()) % 10]
    c = Counter(w for _, t in train for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    out = []
    for d, t in rows:
        k = [c[w] for w in [*words(t), None]]
        out.append((d, d is not None and zlib.crc32(str(d).encode()) % 10 == 0, len(k), sum(x > 0 for x in k), n, sum(math.log10((x + 0.1) / (n + 0.1 * (v + 1))) for x in k)))
    return sorted(out, key=str)


def test_base_and_counts(spark):
    rows = [(i, " ".join(["The", "cat", f"w{i % 7}", f"x{i}", "sat"] * (1 + i % 4))) for i in range(60)] + [(60, None), (61, ""), (62, "É b"), (62, "É b"), (None, "the  dog")]
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    want = brute(rows)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    for a, b in zip(got, want, strict=True):
        assert a[5] == pytest.approx(b[5], rel=1e-9)


SYLLABLES = ["ka", "to", "mi", "ren", "so", "lu", "vi", "pe", "gor", "ta", "ni", "dus"]


def test_nears_the_entropy_of_its_source(spark):
    """Words of 2 to 5 random syllables: no probabilities can beat the source's own on average, and the base, which gives
    every unseen word the share of a single one, is not a distribution over them. So the score is held to the source."""
    import random

    rng = random.Random(1)
    parts = [[rng.randint(2, 5) for _ in range(80)] for _ in range(200)]
    rows = [(i, " ".join("".join(rng.choice(SYLLABLES) for _ in range(k)) for k in ks)) for i, ks in enumerate(parts)]
    held = [r for r in lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    source = sum(math.log10(80 / 81 / 4) - k * math.log10(12) for r in held for k in parts[r.doc_id]) + len(held) * math.log10(1 / 81)
    assert 1.1 * source < sum(r.score for r in held) < 0.98 * source
    assert all(0 < r.bits_per_byte < 8 for r in held)


def test_beats_base_on_held_out_texts(spark):
    """Texts of four subjects, with words by Zipf's law."""
    import random

    rng = random.Random(2)
    subjects = [["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, 4))) for _ in range(800)] for _ in range(4)]
    weight = [1 / (i + 1) for i in range(800)]
    rows = [(i, " ".join(rng.choices(subjects[i % 4], weight, k=120))) for i in range(300)]
    held = [r for r in lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_empty_table(spark):
    assert lm_scores(spark.createDataFrame([], "doc_id long, text string, row int, h int")).collect() == []


def test_scores_do_not_depend_on_partitions(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choice(words[: 20 + i % 180]) for _ in range(rng.randint(1, 150)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = ({r.doc_id: (r.score, r.base_score) for r in mixing_lm.lm_scores(docs.repartition(n)).collect()} for n in (2, 7))
    assert one.keys() == two.keys()
    assert all(abs(a - b) <= 1e-9 * abs(a) for i in one for a, b in zip(one[i], two[i], strict=True))

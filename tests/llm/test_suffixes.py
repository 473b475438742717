import hashlib
import random

import numpy as np

from tidemark.llm import suffixes
from tidemark.llm.suffixes import Columns, remove_substrings

LONG = "the quick brown fox jumps over the lazy dog and runs away into the deep dark wood "


def brute(rows, size=50):
    """What remove_substrings returns, window by window."""
    least = {}
    texts = [(-(2**63) if i is None else i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for j in range(len(t) - size + 1):
            w = t[j : j + size]
            least[w] = min(least.get(w, i), i)
    out = []
    for (i, _), (key, t) in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for j in range(len(t) - size + 1):
            if least[t[j : j + size]] < key:
                gone[j : j + size] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        runs = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, rows, schema="doc_id long, text string"):
    got = remove_substrings(spark.createDataFrame(rows, schema)).drop("kept").collect()
    return [tuple(r) for r in got]


def key(rows):
    return sorted(rows, key=lambda r: tuple(str(x) for x in r))


def test_columns_sort_suffixes():
    rng = random.Random(1)
    for _ in range(20):
        reads = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 12))]
        data, n = np.frombuffer(b"".join(reads), np.uint8), np.array([len(r) for r in reads])
        c = Columns(data, np.cumsum(n) - n, np.cumsum(n)).build()
        order = [reads[s][len(reads[s]) - k :] for s, k in zip(c.string, c.left, strict=True)]
        assert order == sorted(order)
        ids = np.array([rng.randint(0, 3) for _ in reads])
        s, p = c.smaller(ids, 3)
        want = {(i, j) for i, r in enumerate(reads) for j in range(len(r) - 2) if any(ids[k] < ids[i] and r[j : j + 3] in q for k, q in enumerate(reads))}
        assert set(zip(s.tolist(), p.tolist(), strict=True)) == want


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    bases = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(6)]
    rows = [(None, LONG + "x"), (1, None), (2, ""), (3, LONG), (3, LONG), (4, LONG * 40), (5, "é" * 60), (6, "é" * 80), (7, LONG[:49]), (8, LONG[:50])]
    for i in range(10, 60):
        a, b = rng.choice(bases), rng.choice(bases)
        at = rng.randint(0, len(b))
        rows.append((i, a[: rng.randint(0, len(a))] + rng.choice("#%&") + b[at:] + rng.choice(words) + a[-rng.randint(1, 90) :]))
    assert key(run(spark, rows)) == key(brute(rows))


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    docs = spark.createDataFrame([(1, LONG, 1, 2, 3), (2, LONG, 1, 2, 3)], "doc_id long, text string, row int, bucket int, spans int")
    assert sorted((r.doc_id, r.n_removed) for r in remove_substrings(docs).collect()) == [(1, 0), (2, len(LONG))]


def test_a_bucket_answers_to_4_mb_of_text(spark, monkeypatch):
    """With 16 MB a Python worker took up to 582 MB, and an executor more than 3 GB."""
    asked = []
    find = suffixes.find_segments
    monkeypatch.setattr(suffixes, "find_segments", lambda docs, buckets: asked.append(buckets) or find(docs.limit(0), buckets))
    remove_substrings(spark.range(100).selectExpr("id AS doc_id", "repeat('x', 1000000) AS text"))
    assert asked == [25]

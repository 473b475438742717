"""SimHash components, centroids and vector codes against plain versions, also where numbers are large and groups are dense."""

import hashlib
import math
import random

import numpy as np
import pytest
import xxhash

from tidemark.llm import centroids, simhash, vector_codes, whole_vectors

ROWS = [
    (None, "No id here", "a"), (None, "No id here", "a"), (2**60 + 1, "one two three four five", "a"), (1, None, "b"), (2, "", None), (9, " \t\n", "a"),
    (3, "same Text  of\tsome words", "a"), (3, "same text of some words", "a"), (4, "same text of some words", "b"), (5, "long " * 60_000 + "\n" * 60_000, "b"), (6, "é 日本  x\ty\n", "a"), (7, "two words", "a"), (8, "x" * 5000 + " y z", "a"),
]


def plain_print(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, radius):
    """Least place of each component, by all pairs."""
    label = list(range(len(prints)))
    root = lambda i: i if label[i] == i else root(label[i])
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(prints))]


def test_simhash_on_edges(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string").selectExpr("*", "1 AS fp", "2 AS comp", "3 AS mask", "4 AS component_id")
    got = simhash.simhash_components(docs).collect()
    prints = [plain_print(t) for _, t, _ in ROWS]
    comp = plain_components(prints, 2)
    ids = {c: min((r[0] for r, x in zip(ROWS, comp, strict=True) if x == c and r[0] is not None), default=None) for c in comp}
    want = [(r[0], f"{p:016x}", ids[c]) for r, p, c in zip(ROWS, prints, comp, strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert simhash.simhash_components(docs.limit(0)).collect() == []


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4])
def test_pairs_by_planes_against_all_pairs(radius):
    rng = random.Random(radius)
    size = np.array([1, 2, 64, 65, 130, 3, 300])
    fp = []
    for n in size.tolist():
        base = rng.getrandbits(64)
        fp += [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) if rng.random() < 0.7 else rng.getrandbits(64) for _ in range(n)]
    found = {(int(i), int(j)) for a, b in simhash.link_pairs(np.array(fp, np.uint64), size, list(range(64)), radius) for i, j in zip(a, b, strict=True)}
    ends = np.cumsum(size).tolist()
    want = {(i, j) for lo, hi in zip([0, *ends], ends, strict=False) for i in range(lo, hi) for j in range(i + 1, hi) if (fp[i] ^ fp[j]).bit_count() <= radius}
    assert found == want


@pytest.mark.parametrize("group,blocks,batch", [(4096, 60_000, 60_000), (40, 7, 50)])
def test_links_of_dense_groups(spark, monkeypatch, group, blocks, batch):
    """Many prints around a few centres, and some that share all but a few bits: groups are parted until they are small."""
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(simhash, "BLOCKS", blocks)
    monkeypatch.setattr(simhash, "BATCH", batch)
    rng = random.Random(7)
    prints = {rng.getrandbits(64) for _ in range(200)} | {0xABC0 << 40 | x for x in range(7)}
    for centre in [rng.getrandbits(64) for _ in range(3)]:
        prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for _ in range(150)}
    prints = sorted(prints)
    rows = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    links = [tuple(x & (1 << 64) - 1 for x in r) for t in simhash.near_links(rows) for r in t.collect()]
    at = {p: i for i, p in enumerate(prints)}
    label = simhash.merge(np.arange(len(prints)), np.array([at[a] for a, _ in links]), np.array([at[b] for _, b in links]))
    assert label.tolist() == plain_components(prints, 2)


BAD = [None, [1.0] * 3, [float("nan")] * 4, [None, 1.0, 1.0, 1.0], [float("inf"), 0.0, 0.0, 0.0], []]


def vectors_of(spark, rows, label=False):
    kind = "vec_id long, embedding array<double>, label int"
    return spark.createDataFrame([(i, v, i % 3 if i is not None and i % 5 else None) for i, v in rows], kind).selectExpr("*", "1 AS k", "2 AS v", "3 AS l", "4 AS cluster", "5 AS block")


def plain_clusters(rows, factor, k, rounds):
    kept = [(i, [math.floor(factor * x) for x in v]) for i, v in rows if v and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, x), i) for i, x in enumerate(c))
    for _ in range(rounds):
        to = [near(v)[1] for _, v in kept]
        for g in range(len(c)):
            own = [v for (_, v), t in zip(kept, to, strict=True) if t == g]
            if own:
                c[g] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    done = [(i, *near(v)) for i, v in kept]
    fit = lambda x: x if x < 1 << 63 else None
    inertia = [sum(d for _, d, g in done if g == t) for t in range(len(c))]
    return [(i, g, fit(d), fit(inertia[g]), fit(sum(inertia)), hashlib.sha256(",".join(map(str, c[g])).encode()).hexdigest()) for i, d, g in done]


@pytest.mark.parametrize("scale", [1.0, 3e4, 1e8, 1e30])
def test_clusters_against_plain_ones(spark, scale):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) * (scale if i % 4 == 0 else 1) for _ in range(4)]) for i in range(60)] + [(100 + i, v) for i, v in enumerate(BAD)]
    rows += [(None, [0.5, 0.5, 0.5, 0.5]), (3, [0.25] * 4), (3, [0.25] * 4), (7, [-0.0001, 0.0, 0.0, 0.0])]
    got = centroids.cluster(vectors_of(spark, rows), length=4, k=5, rounds=4).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_clusters(rows, 1024, 5, 4), key=str)


def test_few_and_no_vectors(spark):
    assert centroids.cluster(vectors_of(spark, [(1, v) for v in BAD]), length=4).collect() == []
    two = centroids.cluster(vectors_of(spark, [(1, [0.0] * 4), (2, [1.0] * 4)]), length=4).collect()
    assert sorted((r.vec_id, r.distance) for r in two) == [(1, 0), (2, 0)] and len({r.cluster for r in two}) == 2
    assert vector_codes.compress(vectors_of(spark, [(1, v) for v in BAD[2:]]), parts=2).collect() == []
    assert sorted(r.code for r in vector_codes.compress(vectors_of(spark, [(2, [0.0] * 4), (1, [1.0] * 4)]), parts=2).collect()) == ["0000", "0101"]


def plain_codes(rows, factor, parts, entries, rounds):
    kept = [(i, [math.floor(factor * x) for x in v], lab) for i, v, lab in rows if v and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    w = 4 // parts
    part = lambda v, p: v[p * w : p * w + w]
    books = [[part(v, p) for _, v, _ in first] for p in range(parts)]
    near = lambda v, book: min((sum((x - y) ** 2 for x, y in zip(v, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            to = [near(part(v, p), books[p])[1] for _, v, _ in kept]
            books[p] = [[sum(x) // len(x) for x in zip(*own, strict=True)] if (own := [part(v, p) for (_, v, _), t in zip(kept, to, strict=True) if t == e]) else books[p][e] for e in range(len(books[p]))]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = [(i, "".join(f"{near(part(v, p), books[p])[1]:02x}" for p in range(parts)), sum(near(part(v, p), books[p])[0] for p in range(parts)), lab) for i, v, lab in kept]
    fit = lambda xs: sum(xs) if all(x < 1 << 63 for x in xs) and sum(xs) < 1 << 63 else None
    return [(i, c, fit([e]), fit([f for _, _, f, x in out if x == lab]), digest) for i, c, e, lab in out]


@pytest.mark.parametrize("scale", [1.0, 3e5, 1e9, 1e25])
def test_codes_against_plain_ones(spark, scale):
    rng = random.Random(11)
    rows = [(i, [rng.gauss(0, 1) * (scale if i % 4 == 0 else 1) for _ in range(4)]) for i in range(70)] + [(100 + i, v) for i, v in enumerate(BAD)]
    rows += [(None, [0.5, 0.5, 0.5, 0.5]), (3, [0.25] * 4), (3, [0.25] * 4), (7, [-0.0001, 0.0, 0.0, 0.0])]
    got = vector_codes.compress(vectors_of(spark, rows), parts=2, entries=6, rounds=3).collect()
    labelled = [(i, v, i % 3 if i is not None and i % 5 else None) for i, v in rows]
    assert sorted(map(tuple, got), key=str) == sorted(plain_codes(labelled, 4096, 2, 6, 3), key=str)


def test_screening_never_drops_the_nearest():
    """Entries so close that float32 cannot tell them apart, and ties."""
    rng = np.random.default_rng(5)
    base = rng.integers(1 << 22, 1 << 24, 8)
    book = whole_vectors.exact(np.stack([base + d for d in (3, -1, 1, -1, 0, 2)]))
    x = np.stack([base + rng.integers(-2, 3, 8) for _ in range(300)])
    to, far = vector_codes.nearest_entry(x, book)
    d = ((x[:, None, :].astype(object) - book[None]) ** 2).sum(axis=2)
    assert to.tolist() == [row.index(min(row)) for row in d.tolist()] and far.tolist() == [min(row) for row in d.tolist()]
    assert not vector_codes.overlapping(np.array([[1000] * 8]), whole_vectors.exact(np.array([[1000] * 8, [-1000] * 8])))[0, 1]

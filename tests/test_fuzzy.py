"""Likeness of strings and section finding against plain loops."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import fuzzy
from tidemark.functions import text as T
from tidemark.operators import sections


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def plain_partial(a, b):
    """Every stretch of the longer string that is as long as the shorter one, or shorter at an end."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    m, n = len(a), len(b)
    cuts = [(max(i, 0), min(i + m, n)) for i in range(1 - m, n)]
    best = max(200 * plain_lcs(a, b[lo:hi]) / (m + hi - lo) for lo, hi in cuts)
    return max(best, max(200 * plain_lcs(b, a[lo:hi]) / (m + hi - lo) for lo, hi in cuts)) if m == n else best


@settings(max_examples=200, deadline=None)
@given(st.text("abc é", max_size=30), st.text("abc é", max_size=60))
def test_ratios(a, b):
    assert fuzzy.lcs(a, b) == plain_lcs(a, b)
    assert abs(fuzzy.partial_ratio(a, b) - plain_partial(a, b)) < 1e-9
    bag = fuzzy.bags([a, b])
    assert min(len(a), len(b)) >= int(bag.min(axis=0).sum()) >= plain_lcs(a, b)


def test_long_probes():
    rng = random.Random(3)
    for m in (63, 64, 65, 80):
        probe = "".join(rng.choice("abcdef ") for _ in range(m))
        typos = "".join(c for i, c in enumerate(probe) if i % 17)
        context = "".join(rng.choice("abcdef ") for _ in range(300)) + typos + "".join(rng.choice("abcdef ") for _ in range(100))
        assert abs(fuzzy.partial_ratio(probe, context) - plain_partial(probe, context)) < 1e-9
    assert fuzzy.contains_anchor("Here The  anchor\nwas put, a bit wrng", "the anchor was put, a bit wrong")
    assert not fuzzy.contains_anchor("nothing like it at all 12345", "the anchor was put")
    assert not fuzzy.contains_anchor("x", None)


def test_names_meet_lines_as_in_all_pairs(spark):
    rng = random.Random(8)
    words = ["risk", "management", "of", "cargo", "holds", "safety", "duties", "crew", "x", "on"]
    names = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(25)]
    harm = lambda s: "".join(c for c in s if rng.random() > 0.06) + rng.choice(["", "", " q"])
    lines = [harm(rng.choice(names)).upper() if rng.random() < 0.6 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(150)] + ["", "  "]
    texts = spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, "\n".join(lines[:20]))], "doc_id long, text string")
    asked = spark.createDataFrame([(d, i, n) for d in (1, 2, 3) for i, n in enumerate(names)], "doc_id long, ord int, name string")
    got = sorted(map(tuple, sections.named_lines(sections.lines_of(texts), asked).distinct().collect()))
    want = []
    for d, own in ((1, lines), (3, lines[:20])):
        starts = [1 + sum(len(x) + 1 for x in own[:k]) for k in range(len(own))]
        for i, n in enumerate(names):
            begun = [(d, i, s) for s, x in zip(starts, own, strict=True) if x.lower().lstrip().startswith(n)]
            flat = [" ".join(x.lower().split()) for x in own]
            want += begun or [(d, i, s) for s, x in zip(starts, flat, strict=True) if x and 200 * plain_lcs(n, x) / (len(n) + len(x)) >= 85]
    assert got == sorted(want)


def test_sections_with_typos_and_failures(spark):
    text = "Intro\nTable of Contents\n1 Scope\n2 Duties\n\n1 Scope of it\n" + "word " * 150 + "\n2 Duties\n" + "deck crew works here. " * 10 + "\nRisk Mangement\n" + "hazards are met. " * 10
    rows = [(0, "1 Scope of it", None), (1, "2 Duties", "Deck crew wrks here"), (2, "Risk Management", None), (3, "Not There At All", None)]
    d = spark.createDataFrame([(7, o, n, f) for o, n, f in rows] + [(8, 0, "risk notes", None), (9, 0, "Not here", None), (9, 1, "Nor here", None)], "doc_id long, ord int, name string, first string")
    known = d.select("doc_id", "ord", "name", T.section_prefix(F.col("name")).alias("prefix"), T.anchor(F.col("first"), F.lit(None).cast("string"), F.col("name")).alias("anchor"))
    texts = spark.createDataFrame([(7, text), (8, "risk notes\nplain words only\n" + "more. " * 40), (9, "ABCD\nother words")], "doc_id long, text string")
    got, failed = sections.by_boundaries(texts, known)
    got = {r.name: r.content for r in got.collect()}
    assert set(got) == {"1 Scope of it", "2 Duties", "Risk Management"}
    assert got["2 Duties"].startswith("deck crew") and "hazards" not in got["2 Duties"] and got["Risk Management"].startswith("Risk Mangement\nhazards")
    assert sorted(tuple(r) for r in failed.collect()) == [(7, 4, 1, None), (8, 1, 1, "No heading candidates detected in document text"), (9, 2, 2, "Could not locate any section headings in document text")]


def test_a_text_moves_twice_at_most(spark):
    """Once for its windows and once to be cut; lines move no further than names may reach, and contents not at all."""
    rng = random.Random(9)
    body = lambda: "x " + " ".join(f"{rng.randrange(16**6):x}" for _ in range(1400))
    rows = [(i, f"1 One\n{body()}\n2 Two\n{body()}\nAnex of Trms\n{body()}") for i in range(60)]
    outline = [(i, o, n) for i, _ in rows for o, n in enumerate(["1 One", "2 Two", "Annex of Terms"])]
    d = spark.createDataFrame(outline, "doc_id long, ord int, name string")
    known = d.select("doc_id", "ord", "name", T.section_prefix(F.col("name")).alias("prefix"), T.anchor(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("name")).alias("anchor"))
    texts = spark.createDataFrame(rows, "doc_id long, text string")

    def moved():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty(30_000)
        executors = sc.statusStore().executorList(True)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if there were many more
    before = moved()
    try:
        got = sections.by_boundaries(texts, known)[0].collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    share = (moved() - before) / sum(len(x) for _, x in rows)
    want = {(i, o): x.split("\n")[1 + 2 * o] if o < 2 else "\n".join(x.split("\n")[4:]) for i, x in rows for o in range(3)}
    assert {(r.doc_id, r.ord): r.content for r in got} == want
    assert share < 2.5, share

"""Token files, media, mixing, decontamination, substrings, classifiers: edge cases and plain versions."""

import hashlib
import json
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import decontamination, jpeg, mixing, substrings, token_files, toxicity
from tidemark.llm.common import new_dir, written
from tidemark.llm.decontamination import contamination, drop_contaminated, proximity_matches
from tidemark.llm.jaccard import keep_one
from tidemark.llm.quality import fit_quality, score_quality

EDGES = [(None, "No id here"), (1, None), (2, ""), (3, "a"), (4, "same text"), (4, "same text"), (5, "same text"), (6, "long " * 30_000), (7, "é 日本  x\ty\n")]


def docs(spark, rows, more=False):
    if more:
        return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, bucket int, row string, start int")
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_token_files_hold_what_the_library_encodes(spark):
    from tokenizers import Tokenizer

    path = token_files.vocabulary()
    lib = Tokenizer.from_file(path)
    rows = EDGES + [(8, "don't  we'll 12 3!!  x\n\n  y "), (9, "a b 　 c  "), (10, " lead"), (11, "x,y.z;q (w) 'tis")]
    manifest = token_files.write_token_files(docs(spark, rows, True), new_dir(spark, "t"), path)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(manifest).collect()), key=lambda r: r[1])
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_added_tokens_are_encoded_as_in_whole_texts(spark):
    from tokenizers import Tokenizer

    path, end, rng = token_files.vocabulary(), "<|endoftext|>", random.Random(5)
    lib = Tokenizer.from_file(path)
    texts = [f"Hello there{end}Next one", end, end * 2, f"a  {end} {end}  b", f"{end} x", "x" + end[:7], end[7:] + "y", f"don't{end}'s {end}\n\n{end[:-1]} é{end}日", "<" + end + ">"]
    parts = [end, end, end, end[:4], " ", "  ", "\n", "a", "it's", "12", "!", "é", "<", "|", "word"]
    texts += ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(400)]
    rows = list(enumerate(texts))
    got = sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(token_files.write_token_files(docs(spark, rows), new_dir(spark, "t"), path)).collect())
    ids = [[*lib.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert got == [(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)]


def test_token_files_of_an_empty_table(spark):
    assert token_files.read_token_files(token_files.write_token_files(docs(spark, []), new_dir(spark, "t"), token_files.vocabulary())).collect() == []


def test_media_round_trip():
    payloads = [bytes(64), bytes(range(256)) * 3, b"\xff" * 640, b"\x00\xff" * 320, bytes(64 * 9000)]
    for p, pictures in zip(payloads, jpeg.decode_dc(jpeg.encode_rows(payloads, [b"1"] * 5)), strict=True):
        assert b"".join(t.tobytes() for _, t in pictures) == p


def bits_of(table, symbol):
    return next((n, c) for s, n, c in jpeg._codes(*table) if s == symbol)


def test_other_coefficients_and_colours_are_skipped():
    """A 16x16 picture of three components, the first sampled twice each way, with coefficients that a thumbnail leaves out."""
    dc, ac = (bytes([0, 2, 2] + [0] * 13), bytes([0, 2, 3, 5])), (bytes([0, 1, 3] + [0] * 13), bytes([0x00, 0x01, 0xF0, 0x23]))
    out = []

    def put(value, n):
        out.extend((value >> (n - 1 - k)) & 1 for k in range(n))

    def block(diff, extra):
        size = abs(diff).bit_length()
        put(bits_of(dc, size)[1], bits_of(dc, size)[0])
        put(diff if diff > 0 else diff + (1 << size) - 1, size)
        for symbol, value in extra:
            put(bits_of(ac, symbol)[1], bits_of(ac, symbol)[0])
            put(value, symbol & 15)
        put(bits_of(ac, 0)[1], bits_of(ac, 0)[0])

    for diff in (5, -3, 2, -20):
        block(diff, [(0x01, 1), (0xF0, 0), (0x23, 5)])
    block(2, [])
    block(-2, [(0x01, 0)])
    data = np.packbits(np.array(out + [1] * (-len(out) % 8), np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")
    head = b"\xff\xd8" + jpeg._segment(0xDB, bytes([0] + [16] * 64)) + jpeg._segment(0xC0, bytes([8, 0, 16, 0, 16, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    head += jpeg._segment(0xC4, b"\x00" + dc[0] + dc[1] + b"\x10" + ac[0] + ac[1]) + jpeg._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    ((_, thumb),) = jpeg.decode_dc([head + data + b"\xff\xd9"])[0]
    assert thumb.tolist() == [[128 + 10, 128 + 4], [128 + 8, 128 - 32]]


def test_media_features(spark):
    got = {(r.doc_id, r.n_bytes): r for r in jpeg.media_features(jpeg.with_media(docs(spark, EDGES, True))).collect()}
    for i, t in EDGES:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i, len(raw)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert jpeg.media_features(jpeg.with_media(docs(spark, []))).collect() == []


def test_split_tree_keeps_counts():
    out = mixing.split_tree(np.array([10, 0, 500, 3]), 8, 1)
    assert out.sum(axis=0).tolist() == [10, 0, 500, 3]
    assert max(out.sum(axis=1)) - min(out.sum(axis=1)) <= 3


def test_mix_follows_targets(spark):
    rng = random.Random(4)
    rows = [(i, f"s{min(i % 9, 4)}" if i % 9 != 5 else None, "w " * rng.randint(0, 40)) for i in range(1500)] + [(1500, "empty", None), (1500, "empty", "")]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(d, shards=4, block_words=50).toPandas()
    assert len(got) == len(rows)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight, total = {s: k % 3 + 1 for k, s in enumerate(names)}, sum(sizes.values())
    target, open_ = {}, set(names)
    while True:  # the plain way: share, cut off, share again
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 3 * sizes[s] for s in over}
        open_ -= over
    for s in names:
        rows_s = got[got["source"].isna()] if s is None else got[got["source"] == s]
        assert rows_s["target"].iloc[0] == pytest.approx(target[s])
        assert abs(rows_s["taken"].sum() - target[s]) <= 40
        assert (rows_s["taken"] <= 3 * rows_s["size"]).all()
    assert (got["shards"].map(len) == got["copies"]).all()
    again = mixing.mix(d, shards=4, block_words=50).toPandas()
    assert sorted(zip(got.doc_id, got.taken, strict=True)) == sorted(zip(again.doc_id, again.taken, strict=True))
    assert mixing.mix(d.limit(0)).collect() == []


def test_mixed_rows_are_drawn_each_for_itself(spark, tmp_path):
    """Rows without a doc_id, or with that of another source, follow their own source; token files keep the mix's order."""
    from collections import Counter

    rows = [(None if i % 3 == 0 else i // 2, f"s{i % 2}", f"t{i} " + "w " * 20) for i in range(600)] + [(7, "s0", "same " * 20)] * 200
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    plan = mixing.mix(d, shards=4, block_words=50).toPandas()
    for _, of in plan.groupby("source"):
        assert abs(of["taken"].sum() - of["target"].iloc[0]) <= 21
    got = [tuple(r) for r in mixing.mixed_rows(d, shards=4).collect()]
    copies = Counter(got)
    plan = mixing.mix(d, shards=4)
    assert Counter({k: n for k, n in plan.groupBy("source").agg({"copies": "sum"}).collect() if n}) == Counter(s for _, s, _ in got)
    assert set(copies) <= set(rows) and Counter(tuple(r) for r in mixing.mixed_rows(d, shards=4).collect()) == copies
    at = written(mixing.mixed_rows(d, shards=4), "mixed")
    ordered, order = token_files.in_file_order(at)
    want = [r.doc_id for r in ordered.orderBy(*order).collect()]
    files = token_files.read_token_files(token_files.write_token_files(ordered, new_dir(spark, "t"), token_files.vocabulary(), order=order)).orderBy("start").collect()
    assert [r.doc_id for r in files] == want == [i for i, _, _ in got] and want != sorted(want, key=lambda i: (i is not None, i or 0))


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c.isascii() and (c.isdigit() or c.islower()) or ord(c) > 127 else " " for c in low).split(" ")


@pytest.mark.parametrize("most", [0, 100_000])
def test_contamination(spark, monkeypatch, most):
    """Shuffled joins, and broadcast ones."""
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", most)
    rng = random.Random(3)
    vocabulary = ["the", "of"] + [f"w{i}" for i in range(40)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.randint(0, 25))) for i in range(12)] + [(12, "of the"), (13, None), (14, "..."), (15, "of the")]
    rows = EDGES + [(20 + i, say(30) + " " + (rng.choice(items)[1] or "") + ", " + say(30)) for i in range(25)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in contamination(docs(spark, rows, True), benchmark).drop("text_key").collect()), key=str)
    want = []
    for i, t in rows:
        w, hit, found = [x for x in plain_words(t) if x], set(), set()
        for item, text in items:
            q = [x for x in plain_words(text) if x]
            n = min(10, len(q))
            windows = {tuple(q[k : k + n]) for k in range(len(q) - n + 1)} if n else set()
            for s in range(len(w) - n + 1) if n else ():
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found.add(str(item))
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    assert got == sorted(want, key=str)
    kept = drop_contaminated(docs(spark, rows).selectExpr("*", "1 AS _d", "2 AS _t", "3 AS text_key"), benchmark)
    assert kept.columns == ["doc_id", "text", "_d", "_t", "text_key"]
    assert kept.count() == sum(not x[5] for x in want)
    assert contamination(docs(spark, []), benchmark).collect() == []


def test_proximity(spark):
    d = docs(spark, [(1, "zeta x x beta x gamma"), (2, "zeta " + "x " * 30 + "beta gamma"), (3, "beta")])
    got = proximity_matches(d, spark.createDataFrame([(7, "gamma beta zeta")], "item_id long, text string"), within=10).collect()
    assert [(r.item_id, r.doc_id) for r in got] == [(7, 1)]


def test_difference_cover():
    for v in (5, 7, 13, 21):
        c = substrings.difference_cover(v)
        assert {(a - b) % v for a in c for b in c} == set(range(v))


def test_substrings(spark):
    rng = random.Random(9)
    vocabulary = [f"W{i}" for i in range(50)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = [say(40) for _ in range(4)]
    rows = [(i, t) for i, t in EDGES if i is not None] + [(20 + i, "  ".join(say(rng.randint(0, 9)) + rng.choice(shared)[rng.randint(0, 8) :] + say(5))) for i in range(40)] + [(99, "loop " * 60)]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(docs(spark, rows, True)).collect())
    seen, words = {}, [(i, (t or "").replace("\t", " ").replace("\n", " ").split(" ")) for i, t in rows]
    words = [(i, [x for x in w if x]) for i, w in words]
    for _, w in words:
        for s in range(len(w) - 34):
            seen[tuple(w[s : s + 35])] = seen.get(tuple(w[s : s + 35]), 0) + 1
    want = []
    for i, w in words:
        gone = {k for s in range(len(w) - 34) if seen[tuple(w[s : s + 35])] > 1 for k in range(s, s + 35)}
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    assert got == sorted(want)
    assert substrings.remove_repeats(docs(spark, [])).collect() == []


def made(rng, i, kind):
    clean = [" ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 12))) + "." for _ in range(6)]
    if kind == "junk":
        clean[1:] = ["".join(rng.choice("#$%&!") for _ in range(12)) + " BUY " * 8 for _ in range(5)]
    return i, "\n".join(clean)


def test_quality_on_held_out_rows(spark):
    rng = random.Random(1)
    rows = [made(rng, i, "junk" if i % 3 == 0 else "prose") for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(240)], "doc_id long, quality int")
    d = docs(spark, rows + [(900, None), (901, "")])
    got = {r.doc_id: r.score for r in score_quality(d, fit_quality(d, labels)).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i] >= 0.5) == (i % 3 != 0) for i in held) >= 0.97 * len(held)
    assert 0 <= got[900] <= 1 and got[900] == got[901]
    none = fit_quality(d, labels.limit(0))
    assert {r.score for r in score_quality(d, none).collect()} == {0.5}
    assert score_quality(docs(spark, []), none).collect() == []


def test_levenshtein_automaton():
    a = toxicity.Automaton([b"wretch", b"bad"], [b"scoun"])
    words = ["wretch", "wrtch", "wreetch", "wretsh", "wretches", "bad", "bed", "scoundrel", "scou", "fine", "wetch", "xwretch"]
    kinds = a.run(toxicity.Words([w.encode() for w in words], toxicity.PARTS, lower=True)).tolist()
    assert kinds == [2, 1, 1, 1, 0, 2, 0, 3, 0, 0, 1, 1]


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(2)
    bad = ["wretch", "vermin", "fiend"]
    rows, labels = [], []
    for i in range(600):
        w = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(40)]
        y = int(i % 4 == 0)
        if y:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, y))
    d = docs(spark, rows + [(900, None), (901, "you wrettch, verrmin, fiendd wretcch " * 2)])
    model = toxicity.fit_toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(d, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i] >= 0.7) == (i % 4 == 0) for i in held) >= 0.98 * len(held)
    assert got[900] < 0.5
    assert toxicity.drop_toxic(d, model).count() == sum(s < 0.7 for s in got.values())


def test_toxic_terms_keep_their_support():
    """Texts that share common words count each, near copies once; rare terms and many terms are learned."""
    rng = random.Random(8)
    say = lambda n: ["".join(rng.choice("aeioulnrst") for _ in range(7)) for _ in range(n)]
    texts, labels = [], []
    for i in range(660):
        y = int(i % 11 == 0)
        texts.append(" ".join(["the", "and", "of", *say(20), *(["wretch"] if y and i < 88 else []), *(["vermin"] if y and i >= 88 else [])]).encode())
        labels.append(y)
    copied = say(30) + ["oddword"]
    for _ in range(30):
        texts.append(" ".join([*copied, *say(1)]).encode())
        labels.append(1)
    assert toxicity.Toxicity(texts, np.array(labels)).words == [b"vermin", b"wretch"]
    many = sorted({f"q{w}" for w in say(320)})
    for i in range(len(texts)):
        if labels[i]:
            texts[i] = " ".join([*say(30), *rng.sample(many, 80)]).encode()
    assert set(toxicity.Toxicity(texts, np.array(labels)).words) >= {w.encode() for w in many}


def test_keep_one(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(3, base), (2, base), (5, base + " more"), (6, "else entirely " * 4), (7, None), (8, ""), (2, base)]
    got = sorted((r.doc_id, r.text) for r in keep_one(docs(spark, rows)).collect())
    assert [i for i, _ in got] == [2, 6, 7, 8]


def test_pipeline(spark, tmp_path):
    """Every stage works on what the one before kept, and keeps the columns of documents."""
    import corpus_pipeline

    rng = random.Random(6)
    say = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    test = say(30)
    rows = [(i, say(40), "en", f"s{i % 3}", 1) for i in range(120)]
    rows += [(200, rows[0][1], "en", "s0", 1), (201, say(10) + " " + test, "en", "s1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, test)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        columns, d = d.columns, written(stage(spark, d, str(tmp_path)), name)
        kept[name] = [r.doc_id for r in d.select("doc_id").collect()]
        if name != "tokens":
            assert d.columns == columns
    assert len(kept["toxicity"]) == 122
    assert sorted(kept["near_duplicates"]) == [*range(120), 201]
    assert sorted(kept["decontamination"]) == list(range(120))
    assert sorted(kept["tokens"]) == sorted(kept["mixing"])
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES])

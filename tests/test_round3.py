"""Cases of the third round's findings."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.functions import fuzzy
from tidemark.operators import best, library, retrieval, sections, textprep
from tidemark.operators.keyword_index import KeywordIndex
from tidemark.sources.logged import LoggedTable

FOUND = pa.schema([("query_id", pa.int64()), ("node_id", pa.int64()), ("score", pa.float64())])


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_document_rows_have_their_mode(spark):
    nodes = spark.createDataFrame([("a", 1, "x", "1"), ("a", 2, "y", "1"), ("b", 3, "z", "2")], "doc_id string, node_id int, title string, section_id string")
    got = sorted(map(tuple, library.document_rows(nodes).select("doc_id", "nodes", "title", "sections", "mode").collect()))
    assert got == [("a", 2, "y", 1, "sync"), ("b", 1, "z", 1, "sync")]


def test_postings_need_no_shuffle(spark):
    nodes = spark.createDataFrame([(1, "t", "F", "b a b"), (2, "t", None, None), (3, None, "F", "Ä a")], "node_id int, tenant_id string, doc_type string, text string")
    got = retrieval.postings(nodes)
    assert "Exchange" not in plan_of(got)
    assert sorted((r.node_id, r.term, r.tf, r.tenant_id, r.doc_type) for r in got.collect()) == [(1, "a", 1, "t", "F"), (1, "b", 2, "t", "F"), (3, "a", 1, None, "F"), (3, "ä", 1, None, "F")]


def test_replaced_table_is_written_once(spark, tmp_path):
    t = LoggedTable(spark, str(tmp_path / "t"), "k long, v int", "k", buckets=4)
    t.append(spark.range(10).selectExpr("id AS k", "1 AS v"))
    n = t.replace(spark.range(3).selectExpr("id AS k", "2 AS v"))
    assert sorted(map(tuple, t.read().collect())) == [(0, 2), (1, 2), (2, 2)] and t.compacted() == n
    t.append(None, spark.range(1).toDF("k"))
    assert t.read().count() == 2 and t.compact() > 0 and t.read().count() == 2


def test_keyword_lists_move_only_asked_numbers(spark, tmp_path):
    nodes = spark.range(200).selectExpr("id AS node_id", "if(id % 3 = 0, 'shared', concat('t', id % 3)) AS tenant_id", "if(id % 2 = 0, 'FORM', 'Policy') AS doc_type", "concat_ws(' ', transform(sequence(0, id % 7), i -> concat('w', i * id % 5))) AS text")
    index = KeywordIndex(spark, str(tmp_path / "i"), buckets=4)
    index.rebuild(nodes)
    asked = spark.createDataFrame([(1, "w0 w1", "t1", None, 4), (2, "w2", None, ["form"], 3), (3, "none", None, None, 3), (4, "w1 w3 w4", None, None, None)], "query_id long, text string, tenant string, types array<string>, k int")
    got = sorted((r.query_id, r["rank"], r.node_id, r.score) for r in index.top_each(asked, 5).collect())
    want, held = [], nodes.collect()
    for q in asked.collect():
        rows = [(n.node_id, sum(n.text.split().count(t) for t in q.text.split())) for n in held if (q.tenant is None or n.tenant_id in ("shared", q.tenant)) and (q.types is None or n.doc_type == "FORM")]
        rows = sorted((-s, i) for i, s in rows if s)[: q.k or 5]
        want += [(q.query_id, j, i, round(-s * 0.1, 6)) for j, (s, i) in enumerate(rows, 1)]
    assert got == sorted(want)
    moved = plan_of(index.top_each(asked.select("query_id", "text"), 5)).split("MapInArrow")[1]
    assert "tenant_id" not in moved.split("Exchange")[0]


def test_best_terms_over_small_tiles(monkeypatch):
    """Tiles, blocks of pairs and cuts of candidates that are far smaller than the data; ties go to the first node."""
    for name, n in (("TILE", 40), ("HELD", 30), ("DENSE_TERMS", 2)):
        monkeypatch.setattr(best, name, n)
    rng = np.random.default_rng(5)
    rows = [(int(t), d, int(rng.integers(1, 4))) for d in range(60) for t in np.flatnonzero(rng.random(9) < [0.9, 0.7, 0.3, 0.2, 0.2, 0.1, 0.1, 0.1, 0.1])]
    batches = [pa.RecordBatch.from_pydict({"_t": [r[0] for r in rows[i : i + 7]], "node_id": [r[1] for r in rows[i : i + 7]], "tf": [r[2] for r in rows[i : i + 7]]}) for i in range(0, len(rows), 7)]
    asked = [{"query_id": q, "terms": sorted(set(rng.integers(0, 9, 4).tolist()))} for q in range(11)]
    groups = [[0, 11, None, None]]
    got = [tuple(r.values()) for b in best.by_terms(asked, [3] * 11, groups, 9, FOUND)(iter(batches)) for r in b.to_pylist()]
    want = []
    for q in asked:
        sums = {}
        for t, d, tf in rows:
            if t in q["terms"]:
                sums[d] = sums.get(d, 0) + tf
        want += [(q["query_id"], d, float(s)) for s, d in sorted(((s, d) for d, s in sums.items()), key=lambda x: (-x[0], x[1]))[:3]]
    assert sorted(got) == sorted(want)


def test_best_cosines_over_small_tiles(monkeypatch):
    for name, n in (("TILE", 16), ("HELD", 10)):
        monkeypatch.setattr(best, name, n)
    angle = np.arange(50) * 0.4
    x = np.stack([np.cos(angle), np.sin(angle)], 1)
    tenants = ["t1" if i % 2 else "shared" if i % 3 else None for i in range(50)]
    batches = [pa.RecordBatch.from_pydict({"node_id": list(range(i, i + 10)), "embedding": x[i : i + 10].tolist(), "tenant_id": tenants[i : i + 10]}) for i in range(0, 50, 10)]
    asked = [{"query_id": q, "vector": x[q].tolist(), "tenant": "t2" if q else None} for q in range(4)]
    asked, groups = best.groups_of(asked, "shared", retrieval.type_cases)
    got = [tuple(r.values()) for b in best.by_cosine(asked, [4] * 4, 0.2, groups, FOUND)(iter(batches)) for r in b.to_pylist()]
    want = []
    for q in asked:
        s = [(round(float(np.cos(angle[q["query_id"]] - a)), 6), i) for i, a in enumerate(angle) if q["tenant"] is None or tenants[i] == "shared"]
        want += [(q["query_id"], i, v) for v, i in sorted(s, key=lambda y: (-y[0], y[1]))[:4] if v > 0.2]
    assert sorted(got) == sorted(want)


def test_texts_are_not_shuffled_for_ranked_rows(spark):
    nodes = spark.range(50).selectExpr("id AS node_id", "'d' AS doc_id", "'1' AS section_id", "repeat('x', 50) AS text", "'' AS references")
    ranked = spark.createDataFrame([(1, 3, 0.5, 1), (1, 4, 0.4, 2)], "query_id int, node_id long, score double, rank int")
    asked = spark.createDataFrame([(1, "q")], "query_id int, text string")
    got = retrieval.reranked(ranked, asked, nodes, lambda q, x: F.length(x))
    assert "SortMergeJoin" not in plan_of(got) and got.count() == 2


def test_windows_of_many_pairs_at_once(monkeypatch):
    """Probes of all word widths, among them longer than their contexts, against every stretch compared by itself."""
    rng = np.random.default_rng(3)
    word = lambda n: "".join("abcé "[i] for i in rng.integers(0, 5, n))
    pairs = [(word(p), word(c)) for p in (0, 1, 15, 16, 17, 32, 33, 64, 65, 90) for c in (0, 1, 40, 90, 130)]

    def plain(a, b):
        a, b = (a, b) if len(a) <= len(b) else (b, a[:128])
        cuts = [b[max(0, i) : i + len(a)] for i in range(1 - len(a), len(b))]
        return max(fuzzy.ratio(a, x) for x in cuts) if a else 0.0 if b else 100.0

    want = [plain(*p) for p in pairs]
    for n in (1, 300, 1 << 14):
        monkeypatch.setattr(fuzzy, "AT_ONCE", n)
        assert fuzzy.best_windows(pairs) == want
    texts, anchors = [None, "The Anchor  here", "xx the anchr hree xx", "nothing"], [["a"], ["the anchor HERE", None], [None, "the anchor here"], ["the anchor here"]]
    assert fuzzy.anchored(texts, anchors) == [False, True, True, False] and fuzzy.anchored(["x"], [None]) == [False]


def test_lines_and_chunks_go_in_slices(spark, monkeypatch):
    """More texts than a slice has, empty ones and none among them."""
    rows = [(f"d{i}", None if i % 7 == 0 else "" if i % 7 == 1 else f"Contents\n1 One\n\nText {i}. More.") for i in range(30)]
    texts = spark.createDataFrame(rows, "doc_id string, text string").coalesce(1)
    monkeypatch.setattr(sections, "SLICE", 4)
    got = sorted((r.doc_id, r.start, r.line, r.head, r.heading, r.entry, r.contents, r.at) for r in sections.lines_of(texts).filter("head IS NOT NULL OR contents IS NOT NULL").collect())
    assert len(got) == 2 * sum(bool(t) for _, t in rows)
    assert [g[1:4] + g[6:] for g in got if g[0] == "d2"] == [(1, "Contents", None, 1, 1), (10, "1 One", "1", None, None)]
    assert sorted(map(tuple, textprep.chunk(texts.filter("doc_id = 'd2'"), 5, 0).collect())) == [("d2", 0, "Contents\n1 One\n\nText 2."), ("d2", 1, "More.")]

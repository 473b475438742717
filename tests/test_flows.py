"""Sticky chunks, refinement, attempts, pages, trees and contexts beyond what the SQL shows."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import batches, conversations, retrieval, trees
from tidemark.plans.refine import refined
from tidemark.streaming.sticky import decide, sticky_batch, sticky_stream
from tidemark.streaming.sync import watch_files

ASKED = "session_id long, id long, intent string, in_context boolean, shift string, chunks array<string>"


def test_sticky_precedence_and_limit():
    held = (3, True, ["a"])
    say = lambda state, *q: decide(state, *q)[1][:3]
    assert say(held, "clarification", True, "DIFFERENT", ["b"]) == (True, None, 4)
    assert say(held, "follow_up", False, "DIFFERENT", ["b"]) == (True, None, 3)
    assert say(held, "new_query", True, "DIFFERENT", ["b"]) == (False, "topic_change", 2)
    assert say(held, "new_query", True, "FOLLOWUP", ["b"]) == (True, None, 4)
    assert say((3, True, []), "clarification", True, "FOLLOWUP", ["b"]) == (False, None, 4)
    assert say((6, True, ["a"]), "clarification", True, None, ["b"]) == (False, "turn_limit", 2)
    assert decide((0, False, []), "new_query", True, None, [str(i) for i in range(50)])[0] == (2, True, [str(i) for i in range(40)])


def test_sticky_stream_is_the_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(s, i, rng.choice(["clarification", "follow_up", "new_query"]), rng.random() < 0.8, rng.choice(["DIFFERENT", "FOLLOWUP", None]), [f"{s}-{i}-{k}" for k in range(rng.randint(0, 3))]) for s in range(6) for i in range(15)]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for part in range(3):  # a session's questions come in several micro-batches
        spark.createDataFrame([r for r in rows if r[1] // 5 == part], ASKED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = sticky_stream(watch_files(spark, str(tmp_path / "in"), ASKED))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(str, sticky_batch(spark.createDataFrame(rows, ASKED)).collect())) and len(got) == 90


def test_refinement_keeps_the_best_and_stops(spark):
    calls = []
    values = {"a": 70, "b": 10, "b1": 40, "b12": 40, "c": 30, "c1": 20, "c12": 25, "d": 50}

    def search(q):
        calls.append(sorted(r.text for r in q.collect()))
        return q.select("query_id", F.coalesce(*[F.when(F.col("text") == k, v) for k, v in values.items()]).alias("confidence_pct")).filter("confidence_pct IS NOT NULL")

    rewrite = lambda low, i: low.filter("text <> 'd'").select("query_id", F.concat("text", F.lit(str(i))).alias("text"))
    q = spark.createDataFrame([(i, x) for i, x in enumerate("abcde")], "query_id long, text string")
    got = {r.query_id: (r.text, r.confidence_pct, r.attempt, r.attempts) for r in refined(q, search, rewrite).collect()}
    assert got == {0: ("a", 70, 1, 1), 1: ("b1", 40, 2, 3), 2: ("c", 30, 1, 3), 3: ("d", 50, 1, 1), 4: ("e", 0, 1, 3)}
    assert calls == [list("abcde"), ["b1", "c1", "e1"], ["b12", "c12", "e12"]]


def step(x):
    if x == "boom":
        raise RuntimeError("no")
    return {"n": len(x), "parse_error": "odd" if x == "odd" else None}


def test_attempts(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "boom"), (None, "odd"), (4, "xyz")], "k long, text string")
    done = batches.attempted(rows, step, "struct<n:int,parse_error:string>")
    assert [(r.k, r.result and r.result.n, r.error, r.ok) for r in done.collect()] == [(1, 1, None, True), (2, None, "no", False), (None, 3, "odd", False), (4, 3, None, True)]
    assert tuple(batches.outcome(done).first()) == (2, 2, 4)
    with pytest.raises(Exception, match="no"):
        batches.attempted(rows, step, "struct<n:int,parse_error:string>", fail_fast=True).collect()


def test_pages_while_rows_come_and_go(spark):
    rows = lambda *extra: spark.createDataFrame([(f"d{i % 3}", i) for i in range(25)] + list(extra), "doc_id string, node_id int")
    first, at = batches.page(rows(), ["doc_id", "node_id"], 10)
    second, at = batches.page(rows(("d0", -1), ("d2", 99)), ["doc_id", "node_id"], 10, at)  # one before the page, one after it
    third, end = batches.page(rows(("d0", -1), ("d2", 99)), ["doc_id", "node_id"], 10, at)
    got = [tuple(r) for p in (first, second, third) for r in p.orderBy("doc_id", "node_id").collect()]
    assert end is None and got == sorted([(f"d{i % 3}", i) for i in range(25)] + [("d2", 99)])
    assert sorted(tuple(r) for p in batches.pages(rows(), ["doc_id", "node_id"], 7) for r in p.collect()) == sorted(map(tuple, rows().collect()))
    assert [p.count() for p in batches.pages(rows().limit(14), ["doc_id", "node_id"], 7)] == [7, 7, 0]


def test_trees_of_odd_sections(spark):
    records = spark.createDataFrame([("t1", "a.b.pdf", "FORM", "T", None, ["1 One", "1 Again", "1.1 Sub", "2.1.1 Lost", "Notes", " ", None]), ("t2", "none.pdf", "X", None, None, []), ("t2", "bad.pdf", "X", None, "e", ["1 x"]), ("t0", "a.b.pdf", "OLD", "T", None, ["9 Nine"])], "tenant_id string, name string, doc_type string, title string, error string, sections array<string>")
    chunks = spark.createDataFrame([("n2", "a.b", "1"), ("n1", "a.b", "1"), ("n3", "a.b", None), ("n4", "zz", "1")], "node_id string, doc_id string, section_id string")
    tree, counts = trees.rebuild(records, chunks)
    got = {r.ord: (r.section_id, r.parent, r.path, r.chunk_ids) for r in tree.collect()}
    assert got == {0: ("1", None, [0], []), 1: ("1", None, [1], ["n1", "n2"]), 2: ("1.1", "1", [0, 2], []), 3: ("2.1.1", None, [3], []), 4: ("Notes", None, [4], [])}
    assert tuple(counts.first()) == (1, 2) and trees.available(tree)
    text = trees.printed(tree).first().text
    assert text == "Document: a.b\n" + "=" * 80 + "\n\n├─ 1: One [no chunks]\n  ├─ 1.1: Sub [no chunks]\n\n├─ 1: Again [2 chunks]\n\n├─ 2.1.1: Lost [no chunks]\n\n├─ Notes: Notes [no chunks]\n"
    assert "1.1: Sub" not in trees.printed(tree, 0).first().text


def test_saved_extractions_round_trip(spark):
    sections = spark.createDataFrame([("h", "f.txt", 1, "b", "two"), ("h", "f.txt", 0, "a", 'one "x"\n')], "hash string, file_name string, nth int, name string, content string")
    lines = conversations.saved_extractions(sections)
    assert '"doc_count":2' in lines.first().line
    uploads = spark.createDataFrame([("s", 1, "h"), ("s", 2, "gone")], "session_id string, file_id int, hash string")
    got = sorted(map(tuple, conversations.restored_uploads(lines, uploads).collect()), key=str)
    assert got == [("s", 1, 0, "a", 'one "x"\n'), ("s", 1, 1, "b", "two"), ("s", 2, None, None, None)]


def test_expansion_keeps_ranks_and_adds_at_most_three(spark):
    nodes = spark.createDataFrame([(i, "t1", "FORMS: r0, r1, r2, r3, far" if i == 0 else None) for i in range(8)], "node_id int, tenant_id string, references string")
    unit = lambda i: [1.0 if k == i else 0.0 for k in range(9)]
    vectors = spark.createDataFrame([(i, unit(i)) for i in range(8)], "node_id int, embedding array<double>")
    ranked = spark.createDataFrame([(5, 0, 0.9, 1), (5, 4, 0.8, 2)], "query_id int, node_id int, score double, rank int")
    embedded = spark.createDataFrame([(f"r{i}", unit(i + 4)) for i in range(4)] + [("far", [0.3] * 9), ("other", unit(1))], "ref string, vector array<double>")
    got = [(r.node_id, r.score, r.rank) for r in retrieval.expanded(ranked, nodes, vectors, embedded).orderBy("rank").collect()]
    assert got == [(0, 0.9, 1), (4, 0.8, 2), (5, 0.6, 3), (6, 0.6, 4), (7, 0.6, 5)]

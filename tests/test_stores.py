"""Logged tables, the keyword index, and retrieval on inputs that the test tables do not have."""

import pytest
from pyspark.sql import functions as F

from tidemark import session
from tidemark.functions import text as T
from tidemark.operators import conversations, dml, retrieval
from tidemark.operators.keyword_index import KeywordIndex
from tidemark.sources.logged import LoggedTable
from tidemark.streaming.sync import sync_library


def rows_of(table, buckets=None):
    return sorted(map(tuple, table.read(buckets).collect()), key=str)


def test_logged_table_and_what_a_crash_leaves(spark, tmp_path):
    kind = "k string, v int"
    make = lambda rows: spark.createDataFrame(rows, kind)
    t = LoggedTable(spark, str(tmp_path / "t"), kind, "k", buckets=3)
    assert rows_of(t) == [] and t.compact() == 0
    t.append(make([("a", 1), ("b", 2), ("b", 3)]))
    assert t.counts(make([("b", 0), ("c", 0)]), make([("a", 0), ("z", 0)])) == {"added": 1, "modified": 1, "deleted": 1}
    t.append(make([("b", 4), (None, 5)]), make([("a", 0)]))
    want = [("b", 4), (None, 5)]
    assert sorted(rows_of(t), key=str) == sorted(want, key=str)
    # a batch without its mark, and a base version without its mark
    make([("x", 9)]).withColumn("bucket", t.bucket()).write.partitionBy("bucket").parquet(f"{t.root}/log/batch=2/rows")
    make([("y", 9)]).withColumn("bucket", t.bucket()).withColumn("version", F.lit(1)).write.partitionBy("bucket", "version").parquet(f"{t.root}/base")
    assert sorted(rows_of(t), key=str) == sorted(want, key=str) and t.batches() == [0, 1]
    assert t.compact() > 0
    assert sorted(rows_of(t), key=str) == sorted(want, key=str)
    assert t.append(make([("x", 1)])) == 2 and sorted(rows_of(t), key=str) == sorted([*want, ("x", 1)], key=str)
    t.append(None, make([("x", 0), ("b", 0)]))
    t.compact()
    t.vacuum()
    assert rows_of(t) == [(None, 5)] and t.batches() == []
    assert t.append(make([("c", 1)])) == 4
    assert sorted(rows_of(t, t.buckets_of(["c"])), key=str)[:1] == [("c", 1)]


def test_buckets_that_no_change_touches_stay(spark, tmp_path):
    t = LoggedTable(spark, str(tmp_path / "t"), "k long", "k", buckets=8)
    t.append(spark.range(100).toDF("k"))
    t.compact()
    before = {b: t._numbers("version=", "base", f"bucket={b}") for b in range(8)}
    t.append(spark.createDataFrame([(1000,)], "k long"), spark.createDataFrame([(3,)], "k long"))
    assert t.compact() <= 2
    changed = [b for b in range(8) if t._numbers("version=", "base", f"bucket={b}") != before[b]]
    assert changed == t.touched([1]) and t.read().count() == 100


def test_index_reads_only_what_is_asked(spark, tmp_path):
    nodes = spark.createDataFrame([("n1", "t1", "FORM", "Fire drill fire"), ("n2", "t2", "POLICY", "fire"), ("n3", "shared", "Form", "no word of it"), ("n4", "t1", "FORM", None)], "node_id string, tenant_id string, doc_type string, text string")
    index = KeywordIndex(spark, str(tmp_path / "i"), "string", 8)
    assert index.rebuild(nodes) == 4
    assert [(r.node_id, r.score) for r in index.top("FIRE!", 5).collect()] == [("n1", 0.2), ("n2", 0.1)]
    assert [r.node_id for r in index.top("fire", 5, tenant="t1").collect()] == ["n1"]
    assert [r.node_id for r in index.top("fire word", 5, types=["form"]).collect()] == ["n1", "n3"]
    assert index.top("?", 5).collect() == []
    index.update(nodes.filter("node_id = 'n2'").withColumn("text", F.lit("")), nodes.filter("node_id = 'n3'"))
    assert [r.node_id for r in index.top("fire word", 5).collect()] == ["n1"]
    plan = index.top("fire", 5)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(term" in plan or "EqualTo(term" in plan


def test_sync_of_a_library(spark, tmp_path):
    kind = "name string, size long, mtime long"
    state = lambda *rows: spark.createDataFrame(list(rows), kind)
    snapshot = LoggedTable(spark, str(tmp_path / "s"), kind, "name", buckets=2)
    nodes = LoggedTable(spark, str(tmp_path / "n"), "node_id string, name string", "name", buckets=2)
    fails = {"bad"}

    def make(files):
        ok = files.filter(~F.col("name").isin(*fails)) if fails else files
        return {"nodes": ok.select(F.concat("name", F.lit(":"), F.col("size").cast("string")).alias("node_id"), "name")}

    run = lambda files: sync_library(files, snapshot, {"nodes": nodes}, make)
    assert run(state(("a", 1, 1), ("b", 1, 1), ("bad", 1, 1))) == {"added": 2, "modified": 0, "deleted": 0, "failed": 1}
    fails.clear()
    assert run(state(("a", 2, 1), ("c", 1, 1), ("bad", 1, 1))) == {"added": 2, "modified": 1, "deleted": 1, "failed": 0}
    assert sorted(r.node_id for r in nodes.read().collect()) == ["a:2", "bad:1", "c:1"]
    assert run(state(("a", 2, 1), ("c", 1, 1), ("bad", 1, 1))) == {"added": 0, "modified": 0, "deleted": 0, "failed": 0}


def test_vectors_with_text_ids_and_unusable_ones(spark):
    nodes = spark.createDataFrame([(n, "t1", "FORM", "A title") for n in "abcde"], "node_id string, tenant_id string, doc_type string, title string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [1.0]), ("e", [0.6, 0.8])], "node_id string, embedding array<float>")
    assert [(r.node_id, r.score) for r in retrieval.vector_top(nodes, vectors, [1.0, 0.0], 5).collect()] == [("a", 1.0), ("e", 0.6)]
    asked = spark.createDataFrame([("q1", [0.0, 1.0], "t1", ["form"], "title", 1), ("q2", [1.0, 0.0], "t9", None, None, 5), ("q3", [1.0, 0.0], None, ["Policy"], None, 5), ("q4", [1.0, 0.0], None, None, "none", 5)], "query_id string, vector array<double>, tenant string, types array<string>, title string, k int")
    got = retrieval.vector_top_each(nodes, vectors, asked).collect()
    assert [(r.query_id, r.node_id, r.score, r.rank) for r in got] == [("q1", "e", 0.8, 1)]


def test_questions_in_blocks(spark, monkeypatch):
    nodes = spark.range(40).selectExpr("id AS node_id", "'t1' AS tenant_id")
    vectors = nodes.select("node_id", F.array(F.sin("node_id"), F.cos("node_id")).alias("embedding"))
    asked = vectors.filter("node_id < 11").select(F.col("node_id").alias("query_id"), F.col("embedding").alias("vector"))
    whole = sorted(map(tuple, retrieval.vector_top_each(nodes, vectors, asked, 3).collect()))
    monkeypatch.setattr(retrieval, "QUESTIONS", 4)
    assert sorted(map(tuple, retrieval.vector_top_each(nodes, vectors, asked, 3).collect())) == whole and len(whole) == 33


def test_reranking_keeps_the_order_of_a_failed_question(spark):
    ranked = spark.createDataFrame([(1, 1, 0.9, 1), (1, 2, 0.8, 2), (2, 1, 0.9, 1), (2, 2, 0.8, 2)], "query_id int, node_id int, score double, rank int")
    questions, nodes = spark.createDataFrame([(1, "x"), (2, "bad")], "query_id int, text string"), spark.createDataFrame([(1, "a"), (2, "abc" * 1000)], "node_id int, text string")
    score = lambda q, x: F.when((q == "x") | (F.length(x) == 1), F.length(x))
    got = sorted((r.query_id, r.rank, r.node_id, r.score) for r in retrieval.reranked(ranked, questions, nodes, score).collect())
    assert got == [(1, 1, 2, 1000.0), (1, 2, 1, 1.0), (2, 1, 1, 0.9), (2, 2, 2, 0.8)]


def test_upload_names_are_free(spark):
    names = ["a.txt", "a (1).txt", "a.txt", "a.txt", "a (1).txt", ".rc", ".rc", "b.tar.gz", "b.tar.gz"]
    up = spark.createDataFrame([("s", n, 1, str(i), i) for i, n in enumerate(names)] + [("s", "a.txt", 1, "0", 99)], "session_id string, name string, size long, digest string, ord int")
    got = [r.display_name for r in conversations.add_uploads(up).orderBy("ord").collect()]
    assert got == ["a.txt", "a (1).txt", "a (2).txt", "a (3).txt", "a (1) (1).txt", ".rc", ".rc (1)", "b.tar.gz", "b.tar (1).gz"]
    assert conversations.add_uploads(up, 3).count() == 3


def test_keyed_changes(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "c", 1), (1, "b", 2), (2, "d", 1)], "k int, v string, at int")
    assert sorted(map(tuple, dml.upsert(old, new, "k", order="at").collect())) == [(1, "b"), (2, "d")]
    assert sorted(map(tuple, dml.upsert(old, new.drop("at"), "k").collect())) == [(1, "c"), (2, "d")]
    held = spark.createDataFrame([(1, None), (2, {"a": "x"}), (3, None)], "k int, metadata map<string,string>")
    changes = spark.createDataFrame([(1, {"b": "y"}), (2, {"a": "z"})], "k int, changes map<string,string>")
    assert {r.k: r.metadata for r in dml.merge_metadata(held, changes, "k").collect()} == {1: {"b": "y"}, 2: {"a": "z"}, 3: None}


@pytest.mark.parametrize("raw,want", [('{"a": "x, } y"}', '{"a": "x, } y"}'), ('```json\n{"a": [1,],}\n```', '{"a": [1]}'), ("no", None)])
def test_replies_are_mended_only_if_broken(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "x string").select(T.parse_json_reply(F.col("x"))).first()[0]
    assert got == want


def test_prose_keeps_its_dashes(spark):
    raw = "prose " + "-" * 60 + " x\n| a | :----: |\n| " + "y" * 201 + " | " + "z" * 60 + " |"
    got = spark.createDataFrame([(raw,)], "x string").select(T.markdown_rows(F.col("x"))).first()[0]
    assert got == "prose " + "-" * 60 + " x\n| a | :---: |\n| yyy | " + "z" * 60 + " |"


def test_anchors_of_titles(spark):
    rows = [("A guide to ships", "A guide to ships"), ("A. Guide to ships", "Guide to ships"), ("3.1 Use", None), ("3.1 Use of it", "Use of it")]
    got = spark.createDataFrame(rows, "t string, want string").select("want", T.anchor(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("t")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_scratch_is_cleared_unless_kept(spark):
    def there(at):
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)

    session.clear_scratch(spark)
    kept, gone = session.scratch(spark, "kept", keep=True), session.scratch(spark, "gone")
    for at in (kept, gone):
        spark.range(3).write.parquet(at)
    assert session.stored(spark.range(5), "more").count() == 5
    assert session.clear_scratch(spark) == 2 and there(kept) and not there(gone)
    session._SCRATCH.append(kept)
    assert session.clear_scratch(spark) == 1 and not there(kept)

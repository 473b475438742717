"""The engine's own operators: folds and edge cases that SQL does not show, and properties."""

import io
import zipfile

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark import queries
from tidemark.functions import text as T
from tidemark.operators import dml, retrieval, sections, textprep
from tidemark.sources.library import library_files, numbered, outline, read_records, read_texts
from tidemark.sources.logged import LoggedTable
from tidemark.streaming.sync import conversation_turns, sync, watch_files

SF = "/root/testdata/sf0.001"


def ranked(spark, scores):
    return spark.createDataFrame([(i, s, i + 1) for i, s in enumerate(scores)], "node_id long, score double, rank int")


@pytest.mark.parametrize("n,pct", [(1, 91), (2, 92), (5, 95), (10, 100), (12, 100)])
def test_confidence_of_equal_scores(spark, n, pct):
    assert retrieval.confidence(ranked(spark, [0.5] * n)).first()["confidence_pct"] == pct


def test_fusion_is_symmetric_and_complete(spark):
    a, b = ranked(spark, [3.0, 2.0]), ranked(spark, [1.0, 0.5, 0.2]).withColumn("node_id", F.col("node_id") + 1)
    one = {r.node_id: r.score for r in retrieval.fuse(a, b).collect()}
    two = {r.node_id: r.score for r in retrieval.fuse(b, a).collect()}
    assert one == two and set(one) == {0, 1, 2, 3}
    assert retrieval.fuse(a.limit(0), b).count() == 3


def test_no_foreign_tenant(spark):
    seen = retrieval.visible(queries.nodes(spark, SF), "t1").select("tenant_id").distinct().collect()
    assert {r.tenant_id for r in seen} == {"t1", "shared"}


def test_type_cases():
    assert retrieval.type_cases(["Port-State"]) == ["Port-State", "PORT-STATE"]


def test_clean_text(spark):
    raw = "a  b\r\n```\nx   y\n-----\n```\n| a  |  b |\n======\nwait......\nno!!!!\n\n\n\nend  "
    got = textprep.clean_text(spark.createDataFrame([(1, raw), (2, None)], "id long, text string")).orderBy("id").collect()
    assert got[0].text == "a b\n```\nx   y\n-----\n```\n| a | b |\n----\nwait.\nno!\n\nend"
    assert got[1].text == ""


def test_section_ids(spark):
    rows = [("3. X", "3", 1), ("3.1 X", "3.1", 2), ("3.1.2. X", "3.1.2", 3), ("APPENDIX", "APPENDIX", 1), ("", "", 1)]
    d = spark.createDataFrame(rows, "h string, i string, l int").select("i", "l", T.section_id(F.col("h")).alias("gi"), T.section_level(F.col("h")).alias("gl"))
    assert all((r.i, r.l) == (r.gi, r.gl) for r in d.collect())


def test_merge_empty(spark):
    long_ = "x" * 90
    rows = [(1, 0, "1", "One", ""), (1, 1, "1.1", "Part", ""), (1, 2, "1.2", "Rest", long_), (1, 3, "2", "Two", ""), (1, 4, "3", "Three", long_), (1, 5, "4", "Four", "")]
    got = sections.merge_empty(spark.createDataFrame(rows, "doc_id int, ord int, section_id string, name string, content string")).orderBy("ord").collect()
    assert [(r.section_id, r.name) for r in got] == [("1.2", "One: Part: Rest"), ("3", "Three")]


def test_upsert_twice_is_once(spark):
    old, new = spark.createDataFrame([(1, "a", "p"), (2, "b", "q")], "k int, x string, y string"), spark.createDataFrame([(2, "c", None), (3, "d", "s")], "k int, x string, y string")
    once = dml.upsert(old, new, "k", ["x"])
    assert sorted(map(tuple, once.collect())) == [(1, "a", "p"), (2, "c", "q"), (3, "d", "s")]
    assert sorted(map(tuple, dml.upsert(once, new, "k", ["x"]).collect())) == sorted(map(tuple, once.collect()))


def test_reply_parsing(spark):
    rows = [('```json\n{"a": 1,}\n```', '{"a": 1}'), ('Sure: {"a": [1, 2,]} ok', '{"a": [1, 2]}'), ("no", None), ("{broken", None)]
    d = spark.createDataFrame(rows, "x string, want string").select("want", T.parse_json_reply(F.col("x")).alias("got"))
    assert all((r.got or "").replace(" ", "") == (r.want or "").replace(" ", "") for r in d.collect())


@given(st.integers(1, 3000))
def test_letters_and_romans(n):
    letters = numbered("lowerLetter", n)
    assert sum((ord(c) - 96) * 26**k for k, c in enumerate(reversed(letters))) == n
    values = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    roman = [values[c] for c in numbered("lowerRoman", n)]
    assert sum(-v if v < max(roman[k:]) else v for k, v in enumerate(roman)) == n


def test_outline_and_parts():
    assert outline([1, 2, 2, 1, 3]) == ["1", "1.1", "1.2", "2", "2.1.1"]
    assert textprep.pack_sentences(["a b", "c d", "e f g"], 4, 2) == ["a b c d", "c d e f g"]


def office(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_library_sources(spark, tmp_path):
    w, x = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"', 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    p = lambda t, s="": f"<w:p>{s}<w:r><w:t>{t}</w:t></w:r></w:p>"
    head = '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>'
    (tmp_path / "a.docx").write_bytes(office({"word/document.xml": f"<w:document {w}><w:body>{p('Scope', head)}{p('Text')}<w:tbl><w:tr><w:tc>{p('k')}</w:tc><w:tc>{p('v')}</w:tc></w:tr></w:tbl></w:body></w:document>"}))
    sheet = f'<worksheet {x}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2</v></c></row><row><c r="A2"><v>5</v></c></row></sheetData></worksheet>'
    (tmp_path / "b.xlsx").write_bytes(office({"xl/workbook.xml": f'<workbook {x}><sheets><sheet name="S"/></sheets></workbook>', "xl/sharedStrings.xml": f"<sst {x}><si><t>name</t></si></sst>", "xl/worksheets/sheet1.xml": sheet}))
    (tmp_path / "c.txt").write_bytes(b"ok \xff!")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "e.csv").write_text("skip")
    got = {r.name: r.text for r in read_texts(spark, str(tmp_path)).collect()}
    assert got["a.docx"] == "1 Scope\nText\nk | v"
    assert got["b.xlsx"] == "[Sheet: S]\n| name | 2 |\n| --- | --- |\n| 5 |  |"
    assert got["c.txt"] == "ok !" and got["d.pdf"].startswith("[READ_ERROR]")
    assert {r.name for r in library_files(spark, str(tmp_path)).collect()} == {"a.docx", "b.xlsx", "c.txt", "d.pdf"}


def test_records_last_line_wins(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"k": "a", "v": 1}\nbroken\n{"v": 9}\n{"k": "a", "v": 2}\n')
    assert [tuple(r) for r in read_records(spark, str(tmp_path), "k string, v int", "k").collect()] == [("a", 2)]


def test_streaming_sync(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "node_id long, text string, at int, gone boolean"
    table = LoggedTable(spark, str(tmp_path / "out"), schema, "node_id", buckets=4)
    for k, rows in enumerate(([(1, "a", 1, False), (2, "old", 1, False), (2, "b", 2, False)], [(2, "c", 3, False), (3, "d", 3, False), (1, "a", 4, True)], [(3, "e", 5, None)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        sync(watch_files(spark, src, schema), table, str(tmp_path / "cp"), "at", "gone", compact_every=2).awaitTermination()
        assert table.batches() == list(range(k + 1)) and table.compacted() == (-1, 1, 1)[k]
    assert sorted((r.node_id, r.text) for r in table.read().collect()) == [(2, "c"), (3, "e")]


def test_rescoring_keeps_all_rows(spark):
    rows = spark.range(1500).selectExpr("id AS node_id", "CAST(id AS DOUBLE) AS score", "CAST(id + 1 AS INT) AS rank")
    assert retrieval.rescored(rows, F.lit(2.0)).count() == 1500


def test_clean_text_keeps_rows_apart_and_sees_tabs(spark):
    rows = [(1, "a\nb"), (1, "c\nd"), (2, "\t```\nx   y!!!!\n\t```\nz   z"), (3, "\t| a   ....... |")]
    got = sorted((r.id, r.text) for r in textprep.clean_text(spark.createDataFrame(rows, "id int, text string")).collect())
    assert got == [(1, "a\nb"), (1, "c\nd"), (2, "```\nx   y!!!!\n\t```\nz z"), (3, "| a ....... |")]


def test_sizes_round_ties_to_even(spark):
    rows = spark.createDataFrame([(512,), (1024 + 256,), (1024 + 768,), (3 * 2**30,)], "n long")
    assert [r[0] for r in rows.select(T.human_size(F.col("n"))).collect()] == ["512B", "1.2KB", "1.8KB", "3.0GB"]


def test_sentence_chunks_are_packed_with_overlap(spark):
    text = "One two three. Four five! Six seven eight nine? Ten."
    got = [r.text for r in textprep.chunk(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"), 5, 2).orderBy("doc_id", "chunk").collect()]
    assert got == ["One two three. Four five!", "Four five! Six seven eight nine?", "Ten."]


def test_tables_by_tenant(spark, tmp_path):
    rows = spark.createDataFrame([("t1", 1), ("t2", 2), ("t1", 3)], "tenant_id string, n int")
    dml.write_by_tenant(rows, str(tmp_path / "t"))
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "t/tenant_id=t1")).collect()) == [1, 3]


def test_conversation_state(spark, tmp_path):
    schema = "session_id long, id long, topic string"
    spark.createDataFrame([(1, i, "x" if i < 8 else "y") for i in range(10)], schema).write.parquet(str(tmp_path / "m"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = conversation_turns(watch_files(spark, str(tmp_path / "m"), schema)).writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.id, r.turn) for r in spark.read.parquet(str(tmp_path / "o")).collect())
    assert [t for _, t in got] == [1, 2, 3, 4, 5, 6, 1, 2, 1, 2]


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 20

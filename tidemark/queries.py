"""Registered queries of the engine's own operators over the test tables, each with the same computation in SQL."""

from pyspark.sql import functions as F

from .functions import text as T
from .operators import conversations as C
from .operators import dml as D
from .operators import library as B
from .operators import retrieval as R
from .operators import sections as S
from .operators import textprep as P
from .indexes import QUESTION, TERMS_SQL, index_of
from .operators.keyword_index import KeywordIndex
from .plans import answer as A
from .session import SQL as MAP
from .session import feedback, files, messages, nodes, scratch, table, vectors
from .sources import library as files_source
from .streaming.sync import event_windows

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
QUERY_VEC = 7
#: A tenant's keyword and vector lists, and their fusion.
LISTS = f"""{MAP['nodes']},
seen AS (SELECT * FROM nodes WHERE tenant_id IN ('t1', 'shared')),
kw0 AS (SELECT node_id, round(len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda t: t IN ('the', 'and', 'of'))) * 0.1, 6) AS score FROM seen),
kw AS (SELECT node_id, score, row_number() OVER (ORDER BY score DESC, node_id) AS rank FROM kw0 WHERE score > 0 QUALIFY rank <= 20),
q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = {QUERY_VEC}),
vec AS (SELECT vec_id AS node_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS score, row_number() OVER (ORDER BY round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) DESC, vec_id) AS rank
  FROM embeddings, q WHERE vec_id IN (SELECT node_id FROM seen) QUALIFY rank <= 20),
f0 AS (SELECT coalesce(vec.node_id, kw.node_id) AS node_id, vec.rank AS v, kw.rank AS w, round(coalesce(1.0::DOUBLE / (60 + vec.rank), 0) + coalesce(1.0::DOUBLE / (60 + kw.rank), 0), 9) AS score FROM vec FULL JOIN kw ON vec.node_id = kw.node_id),
fused AS (SELECT node_id, score, row_number() OVER (ORDER BY score DESC, v ASC NULLS LAST, w ASC NULLS LAST) AS rank FROM f0 QUALIFY rank <= 20)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _vector(spark, sf):
    return table(spark, sf, "embeddings").filter(F.col("vec_id") == QUERY_VEC).first()["embedding"]


def _fused(spark, sf):
    return A.retrieve(nodes(spark, sf), vectors(spark, sf), QUESTION, _vector(spark, sf), index_of(spark, sf), "t1")


@query(f"WITH {LISTS} SELECT node_id, score, CAST(rank AS INT) AS rank FROM kw")
def keyword_topk(spark, sf):
    return index_of(spark, sf).top(QUESTION, tenant="t1")


@query(f"WITH {LISTS} SELECT node_id, score, CAST(rank AS INT) AS rank FROM vec")
def vector_topk(spark, sf):
    return R.vector_top(R.filtered(nodes(spark, sf), "t1"), vectors(spark, sf), _vector(spark, sf))


@query(f"WITH {LISTS} SELECT node_id, score, CAST(rank AS INT) AS rank FROM fused")
def hybrid_fusion(spark, sf):
    return _fused(spark, sf)


_CONF = """, n AS (SELECT rank, CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 1.0 END AS s FROM fused),
c AS (SELECT 0.30 * avg(s) FILTER (rank <= 1) + 0.25 * avg(s) FILTER (rank <= 3) + 0.20 * avg(s) FILTER (rank <= 2) + 0.15 * (count(*) FILTER (rank <= 10 AND s > 0.7)) / least(count(*), 10) + 0.10 * least(count(*) / 10.0, 1.0) AS v FROM n)
SELECT CAST(floor(round(v * 100, 6)) AS INT) AS confidence_pct, CASE WHEN floor(round(v * 100, 6)) >= 75 THEN 'HIGH' WHEN floor(round(v * 100, 6)) >= 55 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM c"""


@query(f"WITH {LISTS}{_CONF}")
def hybrid_confidence(spark, sf):
    return R.confidence(_fused(spark, sf))


@query(f"""WITH {LISTS}, adj AS (SELECT f.node_id, f.rank AS was, round(f.score * CASE WHEN regexp_matches(text, '^[A-Z]\\.\\s+[A-Z]') THEN 1.5 WHEN regexp_matches(text, '^[A-Z]+:\\s*\\|') THEN 0.5 ELSE 1.0 END
  * CASE WHEN doc_type = 'Form' THEN 1.3 ELSE 1.0 END, 9) AS score FROM fused f JOIN nodes USING (node_id))
SELECT node_id, score, CAST(row_number() OVER (ORDER BY score DESC, was) AS INT) AS rank FROM adj""")
def boosted(spark, sf):
    n = nodes(spark, sf).select("node_id", "text", "doc_type")
    rows = F.broadcast(_fused(spark, sf)).join(n, "node_id")  # of 20 rows
    factor = R.section_factor(F.col("text")) * R.type_boost(F.col("doc_type"), "Form")
    return R.rescored(rows, factor).select("node_id", "score", "rank")


@query(f"WITH {LISTS} SELECT node_id, score, CAST(row_number() OVER (ORDER BY CASE WHEN rank = 1 THEN 0 ELSE 1 END, score DESC, rank) AS INT) AS rank FROM fused QUALIFY row_number() OVER (ORDER BY CASE WHEN rank = 1 THEN 0 ELSE 1 END, score DESC, rank) <= 8")
def diverse_topk(spark, sf):
    return R.diverse(_fused(spark, sf), 8)


@query(f"""WITH {MAP['nodes']}, s AS (SELECT node_id, title, round(len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda t: t IN ('the', 'and', 'of'))) * 0.1, 6) AS score FROM nodes WHERE doc_type IN ('FORM', 'Form', 'POLICY', 'Policy')),
t AS (SELECT *, row_number() OVER (ORDER BY score DESC, node_id) AS r FROM s WHERE score > 0 QUALIFY r <= 20)
SELECT node_id, score, CAST(row_number() OVER (ORDER BY score DESC, node_id) AS INT) AS rank FROM t WHERE contains(upper(title), 'TH') QUALIFY rank <= 10""")
def keyword_by_type_and_title(spark, sf):
    return index_of(spark, sf).top(QUESTION, 10, types=["Form", "POLICY"], title="th", titles=nodes(spark, sf))


@query(f"""WITH {MAP['nodes']}, q AS (SELECT item_id AS query_id, unnest({TERMS_SQL.format('text')}) AS term FROM benchmark),
p AS (SELECT node_id, term, count(*) AS tf FROM (SELECT node_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM nodes) GROUP BY ALL),
s AS (SELECT query_id, node_id, round(sum(tf) * 0.1, 6) AS score FROM p JOIN q USING (term) GROUP BY ALL)
SELECT query_id, node_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS INT) AS rank FROM s QUALIFY rank <= 10""")
def keyword_many_queries(spark, sf):
    return index_of(spark, sf).top_each(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 10)


@query(f"""WITH {MAP['nodes']}, now AS (SELECT node_id, CASE WHEN node_id % 5 = 0 THEN title ELSE text END AS text FROM nodes WHERE node_id % 7 <> 0),
q AS (SELECT item_id AS query_id, unnest({TERMS_SQL.format('text')}) AS term FROM benchmark),
p AS (SELECT node_id, term, count(*) AS tf FROM (SELECT node_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM now) GROUP BY ALL),
s AS (SELECT query_id, node_id, round(sum(tf) * 0.1, 6) AS score FROM p JOIN q USING (term) GROUP BY ALL)
SELECT query_id, node_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS INT) AS rank FROM s QUALIFY rank <= 10""")
def keyword_index_upkeep(spark, sf):
    """An index after additions, changed texts and deletions, one part of them compacted and one in the log."""
    n, index = nodes(spark, sf), KeywordIndex(spark, scratch(spark, "keyword"), buckets=8)
    index.update(n.filter("node_id % 3 <> 0"))
    index.update(n.filter("node_id % 3 = 0"), n.filter("node_id % 14 = 0"))
    index.table.compact()
    index.update(n.filter("node_id % 5 = 0").withColumn("text", F.col("title")))
    index.update(None, n.filter("node_id % 7 = 0"))
    return index.top_each(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 10)


_SYNC = f"""WITH {MAP['files']} SELECT coalesce(cur.name, snap.name) AS name, CASE WHEN snap.name IS NULL THEN 'new' WHEN cur.name IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM cur FULL JOIN snap ON cur.name = snap.name
WHERE snap.name IS NULL OR cur.name IS NULL OR cur.size <> snap.size OR cur.mtime <> snap.mtime"""


@query(_SYNC)
def sync_diff(spark, sf):
    return B.sync_diff(*files(spark, sf))


@query(f"""WITH {MAP['files']}, {MAP['nodes']}, ch AS (SELECT 'doc' || CAST(node_id % 50 AS VARCHAR) || '.txt' AS name, count(*) AS chunks FROM nodes GROUP BY 1)
SELECT cur.name, cur.size, coalesce(chunks, 0) AS chunks, CASE WHEN l.quality = 0 THEN 'error' WHEN l.quality = 1 THEN 'success' ELSE 'not_extracted' END AS status
FROM cur LEFT JOIN ch ON cur.name = ch.name LEFT JOIN (SELECT 'doc' || CAST(doc_id AS VARCHAR) || '.txt' AS name, quality FROM labels) l ON cur.name = l.name""")
def document_listing(spark, sf):
    name = lambda c: F.concat(F.lit("doc"), c.cast("string"), F.lit(".txt"))
    chunks = nodes(spark, sf).select(name(F.col("node_id") % 50).alias("name"))
    q = F.col("quality")
    extracted = table(spark, sf, "labels").select(name(F.col("doc_id")).alias("name"), F.when(q == 0, "failed").alias("error"), q.alias("sections"))
    return B.listing(files(spark, sf)[0].select("name", "size"), chunks, extracted)


@query(f"""WITH {MAP['nodes']} SELECT count(*) AS nodes, count(DISTINCT doc_id) AS docs, count(*) FILTER (tenant_id = 't2') AS tenant_nodes, count(DISTINCT doc_id) FILTER (tenant_id = 't2') AS tenant_docs,
CASE WHEN count(*) = 0 THEN 'empty' WHEN count(*) FILTER (tenant_id = 't2') = 0 THEN 'degraded' ELSE 'ok' END AS status FROM nodes""")
def system_status(spark, sf):
    return B.system_status(nodes(spark, sf), "t2")


@query(f"WITH {MAP['feedback']} SELECT id, confidence_pct FROM feedback WHERE feedback = 'incorrect' ORDER BY confidence_pct DESC, created_at DESC, id LIMIT 10")
def problem_queries(spark, sf):
    return B.problem_queries(feedback(spark, sf)).select("id", "confidence_pct")


@query("""WITH f AS (SELECT 'doc' || CAST(doc_id // 2 AS VARCHAR) || CASE WHEN doc_id % 3 = 0 THEN '.PDF' ELSE '.txt' END AS name FROM documents),
s AS (SELECT regexp_replace(name, '\\.[^.]*$', '') AS stem, count(*) AS n, array_to_string(list_sort(list(DISTINCT lower(regexp_extract(name, '\\.([^.]*)$', 1)))), ',') AS extensions FROM f GROUP BY 1) SELECT * FROM s WHERE n > 1""")
def duplicate_stems(spark, sf):
    d = F.col("doc_id")
    name = F.concat(F.lit("doc"), F.floor(d / 2).cast("string"), F.when(d % 3 == 0, ".PDF").otherwise(".txt"))
    return B.duplicate_stems(table(spark, sf, "documents").select(name.alias("name")))


@query("""WITH t AS (SELECT event_type AS stage, value AS seconds FROM events WHERE value IS NOT NULL),
g AS (SELECT stage, count(*) AS n, avg(seconds) AS a, median(seconds) AS m, stddev_samp(seconds) AS d, list_sort(list(seconds)) AS l, min(seconds) AS lo, max(seconds) AS hi, sum(seconds) AS t FROM t GROUP BY 1)
SELECT stage, n, round(a, 6) AS mean, round(m, 6) AS median, round(l[least(CAST(floor(n * 0.95) AS INT) + 1, n)], 6) AS p95, round(d, 6) AS deviation, round(lo, 6) AS least, round(hi, 6) AS most, round(100 * t / sum(t) OVER (), 4) AS share FROM g""")
def latency_statistics(spark, sf):
    return B.latency(table(spark, sf, "events").filter("value IS NOT NULL").select(F.col("event_type").alias("stage"), F.col("value").alias("seconds")))


@query("""WITH r AS (SELECT doc_id, lang AS title, source AS category FROM documents)
SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'fixed' WHEN doc_id % 6 = 1 THEN NULL ELSE title END AS title, CASE WHEN doc_id % 6 = 2 THEN 'moved' ELSE category END AS category, doc_id % 6 < 3 AS has_corrections FROM r""")
def corrections_overlay(spark, sf):
    d = F.col("doc_id")
    docs = table(spark, sf, "documents")
    fields = F.when(d % 6 == 0, F.create_map(F.lit("title"), F.lit("fixed"))).when(d % 6 == 1, F.create_map(F.lit("title"), F.lit(None).cast("string"))).when(d % 6 == 2, F.create_map(F.lit("category"), F.lit("moved")))
    return B.overlay(docs.select("doc_id", F.col("lang").alias("title"), F.col("source").alias("category")), docs.select("doc_id", fields.alias("fields")).filter("fields IS NOT NULL"), "doc_id", ["title", "category"])


@query("""WITH g AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(trim(regexp_replace(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '[^\\p{L}\\p{N}_ ]', '', 'g'), ' +', ' ', 'g'))), '\\s+'), lambda w: w <> '') AS rw FROM documents),
x AS (SELECT id, rw, list_filter(rw, lambda w, i: i % 10 <> 0) AS gw FROM g),
y AS (SELECT id, rw, gw, CASE WHEN len(rw) < 3 THEN CASE WHEN len(rw) > 0 THEN [array_to_string(rw, ' ')] ELSE [] END ELSE list_distinct(list_transform(generate_series(1, len(rw) - 2), lambda i: array_to_string(rw[i:i + 2], ' '))) END AS r,
  CASE WHEN len(gw) < 3 THEN CASE WHEN len(gw) > 0 THEN [array_to_string(gw, ' ')] ELSE [] END ELSE list_distinct(list_transform(generate_series(1, len(gw) - 2), lambda i: array_to_string(gw[i:i + 2], ' '))) END AS g FROM x),
z AS (SELECT id, CASE WHEN len(r) > 0 THEN len(list_intersect(r, g)) / len(r) ELSE 0 END AS c, CASE WHEN len(g) > 0 THEN (len(g) - len(list_intersect(r, g))) / len(g) ELSE 0 END AS h,
  CASE WHEN len(rw) > 0 THEN len(list_intersect(list_distinct(rw), list_distinct(gw))) / len(list_distinct(rw)) ELSE 0 END AS w, CASE WHEN len(rw) > 0 THEN len(gw) / len(rw) ELSE 0 END AS l FROM y)
SELECT id, round(c, 6) AS coverage, round(h, 6) AS hallucination, round(w, 6) AS word_coverage, round(l, 6) AS length_ratio, round(c, 6) >= 0.85 AND round(h, 6) <= 0.2 AS passed FROM z""")
def extraction_validation(spark, sf):
    docs = table(spark, sf, "documents")
    words = T.split_words(T.normalise_for_validation(F.col("text")))
    got = F.array_join(F.filter(words, lambda w, i: (i + 1) % 10 != 0), " ")
    return P.validate_extraction(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("raw"), got.alias("extracted")))


_HEAD = """h AS (SELECT doc_id, CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN '3. Scope' WHEN 1 THEN '3.' || CAST(doc_id % 7 AS VARCHAR) || ' Use' WHEN 2 THEN '2.1.' || CAST(doc_id % 5 AS VARCHAR) || '. Parts' ELSE 'ANNEX ' || lang END AS heading FROM documents)"""


@query(f"""WITH {_HEAD}, n AS (SELECT doc_id, heading, rtrim(regexp_extract(heading, '^([\\d.]+)\\.?\\s+.+$', 1), '.') AS num FROM h)
SELECT doc_id, CASE WHEN num <> '' THEN num ELSE heading END AS section_id, CAST(CASE WHEN num <> '' THEN len(num) - len(replace(num, '.', '')) + 1 ELSE 1 END AS INT) AS level, CASE WHEN num <> '' AND contains(num, '.') THEN regexp_replace(num, '\\.[^.]+$', '') END AS parent FROM n""")
def section_identifiers(spark, sf):
    d = F.col("doc_id")
    s = lambda n: (d % n).cast("string")
    heading = F.when(d % 4 == 0, "3. Scope").when(d % 4 == 1, F.concat(F.lit("3."), s(7), F.lit(" Use"))).when(d % 4 == 2, F.concat(F.lit("2.1."), s(5), F.lit(". Parts"))).otherwise(F.concat(F.lit("ANNEX "), "lang"))
    i = T.section_id(heading)
    return table(spark, sf, "documents").select("doc_id", i.alias("section_id"), T.section_level(heading).cast("int").alias("level"), T.parent_id(i).alias("parent"))


@query(r"""WITH d AS (SELECT doc_id AS id, string_split(replace(replace(replace(text, ' the ', ' ---------  the '), '. ', ' ....... !!!! '), ' of ', chr(10) || chr(9) || '| a  b ....  | ' || chr(10) || chr(9) || '``` ' || chr(10) || 'x   y!!!!  ' || chr(10) || '```' || chr(10)), chr(10)) AS l FROM documents),
y AS (SELECT id, unnest(l) AS s, generate_subscripts(l, 1) AS n FROM d),
z AS (SELECT *, starts_with(trim(s, chr(9) || ' '), '```') AS fence FROM y),
f AS (SELECT *, sum(CAST(fence AS INT)) OVER (PARTITION BY id ORDER BY n) % 2 = 1 AS code FROM z),
x AS (SELECT id, n, CASE WHEN fence OR code THEN s WHEN regexp_matches(trim(s, chr(9) || chr(13) || ' '), '^\|(.*\|)?$') THEN regexp_replace(s, '[ \t]+', ' ', 'g') ELSE
 regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '[ \t]+', ' ', 'g'), '[\-_=]{4,}', '----', 'g'), '\.{4,}', '...', 'g'),
 ',{3,}', ',', 'g'), '\.{3,}', '.', 'g'), ';{3,}', ';', 'g'), ':{3,}', ':', 'g'), '!{3,}', '!', 'g'), '\?{3,}', '?', 'g') END AS line FROM f)
SELECT id, regexp_replace(regexp_replace(string_agg(regexp_replace(line, '\s+$', ''), chr(10) ORDER BY n), '\n\s*\n\s*\n+', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM x GROUP BY 1""")
def text_cleaning(spark, sf):
    text = F.replace(F.replace("text", F.lit(" the "), F.lit(" ---------  the ")), F.lit(". "), F.lit(" ....... !!!! "))
    text = F.replace(text, F.lit(" of "), F.lit("\n\t| a  b ....  | \n\t``` \nx   y!!!!  \n```\n"))
    return P.clean_text(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), text.alias("text")))


_SEC = """sec AS (SELECT source AS doc_id, CASE CAST(doc_id % 6 AS INT) WHEN 0 THEN '1' WHEN 1 THEN '1.1' WHEN 2 THEN '1.1.2' WHEN 3 THEN '2' WHEN 4 THEN '2.3' ELSE '9.9.9' END AS section_id, doc_id AS ord, text FROM documents)"""


def _sections(spark, sf):
    d = F.col("doc_id")
    ids = F.element_at(F.array(*[F.lit(x) for x in ("1", "1.1", "1.1.2", "2", "2.3", "9.9.9")]), (d % 6 + 1).cast("int"))
    return table(spark, sf, "documents").select(F.col("source").alias("doc_id"), ids.alias("section_id"), d.alias("ord"), "text")


@query(f"""WITH {_SEC}, p AS (SELECT *, CASE WHEN contains(section_id, '.') THEN regexp_replace(section_id, '\\.[^.]+$', '') END AS up FROM sec)
SELECT doc_id, section_id, ord, CASE WHEN EXISTS (SELECT 1 FROM sec s WHERE s.doc_id = p.doc_id AND s.section_id = p.up) THEN up END AS parent FROM p""")
def section_tree(spark, sf):
    return S.build_tree(_sections(spark, sf)).select("doc_id", "section_id", "ord", "parent")


@query(f"""WITH {_SEC}, w AS (SELECT doc_id, section_id, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS own FROM sec GROUP BY ALL)
SELECT a.doc_id, a.section_id, CAST(a.own AS BIGINT) AS own, CAST(sum(b.own) AS BIGINT) AS total FROM w a JOIN w b ON a.doc_id = b.doc_id AND (b.section_id = a.section_id OR starts_with(b.section_id, a.section_id || '.')) GROUP BY ALL""")
def section_sizes(spark, sf):
    return S.rolled_up(_sections(spark, sf))


@query(f"""WITH {_SEC}, {MAP['nodes']}, s AS (SELECT DISTINCT doc_id, section_id FROM sec)
SELECT n.doc_id, n.section_id, node_id, CAST(row_number() OVER (PARTITION BY n.doc_id, n.section_id ORDER BY node_id) AS INT) AS nth FROM nodes n JOIN s ON n.doc_id = s.doc_id AND n.section_id = s.section_id""")
def chunk_mapping(spark, sf):
    return S.chunks_of_sections(nodes(spark, sf), _sections(spark, sf))


@query("""WITH s AS (SELECT doc_id, unnest([1, 41, 301]) AS start, text FROM documents), c AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), len(text) + 1) AS upto FROM s)
SELECT doc_id, start, substr(text, start, greatest(upto - start, 0)) AS content FROM c""")
def section_slices(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    starts = docs.select("doc_id", F.explode(F.array(F.lit(1), F.lit(41), F.lit(301))).alias("start"))
    return S.slices(docs, starts)


@query(f"WITH {MAP['messages']} SELECT session_id, count(*) AS messages, max(id) AS last FROM messages WHERE tenant_id = 't1' GROUP BY 1 ORDER BY last DESC, session_id DESC LIMIT 15")
def recent_sessions(spark, sf):
    return C.session_list(messages(spark, sf), "t1", 15)


@query(f"WITH {MAP['messages']} SELECT session_id, id, CAST((row_number() OVER (PARTITION BY session_id ORDER BY id) - 1) % 2 + 1 AS INT) AS turn FROM messages WHERE role = 'user'")
def conversation_turns(spark, sf):
    return C.turn_counts(messages(spark, sf), 2)


_KEYED = "SELECT doc_id, lang, source FROM documents"


def _old_new(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return d.filter("doc_id % 3 <> 0"), d.filter("doc_id % 2 = 0").withColumn("lang", F.lit("xx")).withColumn("source", F.lit("new"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN lang ELSE 'xx' END AS lang, CASE WHEN doc_id % 3 <> 0 THEN source ELSE 'new' END AS source FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0")
def insert_absent(spark, sf):
    return D.insert_absent(*_old_new(spark, sf), "doc_id", "source")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'xx' ELSE lang END AS lang, CASE WHEN doc_id % 3 <> 0 THEN source ELSE 'new' END AS source FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0")
def upsert_some_columns(spark, sf):
    return D.upsert(*_old_new(spark, sf), "doc_id", ["lang"])


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 2 <> 0")
def delete_keys(spark, sf):
    old, new = _old_new(spark, sf)
    return D.delete(old, new, "doc_id")


@query(f"WITH {MAP['nodes']}, t AS (SELECT CASE WHEN doc_id = 'src3' THEN 't9' ELSE tenant_id END AS tenant_id FROM nodes) SELECT tenant_id, count(*) AS n FROM t GROUP BY 1")
def ownership_transfer(spark, sf):
    return D.transfer(nodes(spark, sf), "t9", F.col("doc_id") == "src3").groupBy("tenant_id").agg(F.count("*").alias("n"))


@query(r"""SELECT doc_id, md5(text) AS digest, CASE WHEN n < 1024 THEN CAST(n AS VARCHAR) || 'B' WHEN n < 1048576 THEN format('{:.1f}KB', n / 1024) WHEN n < 1073741824 THEN format('{:.1f}MB', n / 1048576) ELSE format('{:.1f}GB', n / 1073741824) END AS size,
 CASE WHEN len(t) > 40 THEN substr(t, 1, 40) || '...' ELSE t END AS title FROM (SELECT doc_id, text, n_chars * (doc_id % 3 * 499 + 1) * (doc_id % 7 * 101 + 1) AS n, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)""")
def document_labels(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), T.human_size(F.col("n_chars") * (F.col("doc_id") % 3 * 499 + 1) * (F.col("doc_id") % 7 * 101 + 1)).alias("size"), T.short_title(F.col("text")).alias("title"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_counts(spark, sf):
    return event_windows(table(spark, sf, "events"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages""")
def page_texts(spark, sf):
    return table(spark, sf, "pages").select("page_id", files_source.page_text(F.col("html")).alias("text"))


@query()
def sentence_chunks(spark, sf):
    return P.chunk(table(spark, sf, "documents"), 200, 40)


from . import queries_data, queries_flows, queries_more, queries_text  # noqa: E402  (they add to the queries above)

for _part in (queries_data, queries_more, queries_text, queries_flows):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL

"""Registered queries: changes to keyed tables, sessions, uploads, listings and reports, each with the same computation in SQL."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import conversations as C
from .operators import dml as D
from .operators import library as B
from .operators import retrieval as R
from .operators.keyword_index import KeywordIndex
from .plans import answer as A
from .session import SQL as MAP
from .session import files, messages, nodes, scratch, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


_N = MAP["nodes"]
_COLS = "node_id, doc_id, tenant_id, section_id"


def _keyed(spark, sf):
    return nodes(spark, sf).select("node_id", "doc_id", "tenant_id", "section_id")


def _changed(spark, sf):
    """Half of the nodes with another section, their tenant in metadata or absent."""
    owner = F.when(F.col("node_id") % 4 == 2, F.create_map(F.lit("tenant_id"), F.lit("t8"))).otherwise(F.create_map().cast("map<string,string>"))
    return _keyed(spark, sf).filter("node_id % 2 = 0").withColumn("section_id", F.lit("9")).withColumn("metadata", owner)


@query(f"""WITH {_N} SELECT node_id, doc_id, CASE WHEN node_id % 3 <> 0 THEN tenant_id WHEN node_id % 4 = 2 THEN 't8' ELSE 't7' END AS tenant_id, CASE WHEN node_id % 2 = 0 THEN '9' ELSE section_id END AS section_id, node_id % 2 = 0 AS touched
FROM nodes WHERE node_id % 3 <> 0 OR node_id % 2 = 0""")
def bulk_upsert(spark, sf):
    old = _keyed(spark, sf).filter("node_id % 3 <> 0").withColumn("touched", F.lit(False))
    return D.bulk_upsert(old, _changed(spark, sf), "node_id", "t7", ["section_id"], F.lit(True))


@query(f"WITH {_N} SELECT node_id, doc_id, tenant_id, CASE WHEN node_id % 2 = 0 THEN '9' ELSE section_id END AS section_id FROM nodes WHERE node_id % 3 <> 0 OR node_id % 2 = 0")
def upsert_all_columns(spark, sf):
    return D.upsert(_keyed(spark, sf).filter("node_id % 3 <> 0"), _changed(spark, sf).drop("metadata"), "node_id")


@query(f"WITH {_N} SELECT node_id, tenant_id, CASE WHEN node_id = 14 THEN 'new' ELSE section_id END AS section_id FROM nodes")
def metadata_replacement(spark, sf):
    return D.replace_one(_keyed(spark, sf).select("node_id", "tenant_id", "section_id"), F.col("node_id") == 14, {"section_id": F.lit("new")})


@query(f"WITH {_N} SELECT {_COLS} FROM nodes WHERE NOT (tenant_id = 't2' OR doc_id IN ('src1', 'src4'))")
def delete_by_filter(spark, sf):
    rows = D.delete_where(_keyed(spark, sf), F.col("tenant_id") == "t2")
    return D.delete_where(rows, F.col("doc_id").isin("src1", "src4"))


@query(f"WITH {_N} SELECT CAST(count(*) AS BIGINT) AS num_nodes, count(DISTINCT doc_id) AS num_documents, 1024 AS chunk_size, 200 AS chunk_overlap, max(CAST(tenant_id = 't1' AS INT)) = 1 AS has_old FROM nodes WHERE node_id % 2 = 0")
def cache_replacement(spark, sf):
    rows, info = D.replaced(_keyed(spark, sf).filter("node_id % 2 = 0"), "doc_id", 1024, 200)
    return info.withColumn("has_old", F.lit(rows.filter("tenant_id = 't1'").limit(1).count() == 1))


@query(f"WITH {_N}, gone AS (SELECT DISTINCT doc_id FROM nodes WHERE node_id % 40 = 3) SELECT 'nodes' AS part, CAST(node_id AS VARCHAR) AS key FROM nodes WHERE doc_id NOT IN (SELECT doc_id FROM gone) UNION ALL SELECT 'files', doc_id FROM (SELECT DISTINCT doc_id FROM nodes) WHERE doc_id NOT IN (SELECT doc_id FROM gone)")
def document_deletion(spark, sf):
    n = _keyed(spark, sf)
    gone = n.filter("node_id % 40 = 3").select("doc_id").distinct()
    left = D.delete_documents({"nodes": n, "files": n.select("doc_id").distinct()}, gone, "doc_id")
    return left["nodes"].select(F.lit("nodes").alias("part"), F.col("node_id").cast("string").alias("key")).unionByName(left["files"].select(F.lit("files").alias("part"), F.col("doc_id").alias("key")))


@query("""WITH r AS (SELECT 'f' || CAST(doc_id % 100 AS VARCHAR) AS k, doc_id AS n, lang FROM documents), l AS (SELECT k, arg_max(lang, n) AS v FROM r GROUP BY 1) SELECT k, CASE WHEN k = 'f7' THEN 'fixed' ELSE v END AS v FROM l""")
def keyed_lines(spark, sf):
    rows = table(spark, sf, "documents").select(F.concat(F.lit("f"), (F.col("doc_id") % 100).cast("string")).alias("k"), F.col("doc_id").alias("n"), F.col("lang").alias("v"))
    last = D.last_of_each(rows, "k", "n").drop("n")
    one = spark.createDataFrame([("f7", "fixed")], "k string, v string")
    return D.upsert(last, one, "k")


@query(f"WITH {MAP['messages']}, s AS (SELECT DISTINCT session_id, tenant_id FROM messages) SELECT session_id, CASE WHEN session_id % 5 = 0 THEN 'named' END AS title FROM s WHERE session_id % 3 <> 1")
def session_changes(spark, sf):
    s = messages(spark, sf).select("session_id", "tenant_id").distinct().withColumn("title", F.lit(None).cast("string"))
    named = D.replace_one(s, F.col("session_id") % 5 == 0, {"title": F.lit("named")})
    return D.delete_where(named, F.col("session_id") % 3 == 1).select("session_id", "title")


@query(f"WITH {MAP['messages']}, m AS (SELECT session_id, tenant_id, id FROM messages UNION ALL SELECT session_id, 't1', 1000 FROM (SELECT DISTINCT session_id FROM messages) WHERE session_id % 3 = 1 AND session_id % 2 = 0) SELECT session_id, CAST(count(*) AS BIGINT) AS message_count, max(id) AS last_active FROM m GROUP BY 1")
def message_addition(spark, sf):
    m = messages(spark, sf).select("session_id", "tenant_id", "id")
    new = m.select("session_id").distinct().filter("session_id % 2 = 0").select("session_id", F.lit("t1").alias("tenant_id"), F.lit(1000).cast("long").alias("id"))
    return C.counters(C.added(m, new))


@query(f"WITH {MAP['messages']} SELECT session_id, id, role, upper(role) AS shown FROM messages WHERE tenant_id = 't2' AND session_id % 4 = 1")
def messages_of_sessions(spark, sf):
    m = messages(spark, sf).filter("session_id % 4 = 1")
    own = spark.createDataFrame([("t2",)], "tenant_id string").join(m.select("session_id", "tenant_id").distinct(), "tenant_id")
    flat = C.flattened(C.owned(m, own).withColumn("metadata", F.create_map(F.lit("shown"), F.upper("role"))), ["shown"])
    return flat.select("session_id", "id", "role", "shown")


@query(f"WITH {MAP['messages']} SELECT session_id, max(id) AS id, arg_max(substr(content, 1, 30), id) AS context FROM messages WHERE role = 'assistant' AND id % 2 = 1 GROUP BY 1")
def latest_context(spark, sf):
    m = messages(spark, sf).withColumn("context", F.when(F.col("id") % 2 == 1, F.substring("content", 1, 30)))
    return C.latest_context(m)


@query(f"WITH {_N}, want AS (SELECT unnest(range(0, 2000, 7)) AS node_id) SELECT CAST(count(nodes.node_id) AS BIGINT) AS found, CAST(count(*) - count(nodes.node_id) AS BIGINT) AS missing, CASE WHEN count(nodes.node_id) > 0 THEN 0.8 END AS score FROM want LEFT JOIN nodes USING (node_id)")
def restored_context(spark, sf):
    want = spark.range(0, 2000, 7).withColumnRenamed("id", "node_id")
    rows = C.restored(want, nodes(spark, sf))
    return rows.agg(F.count_if("found").alias("found"), F.count_if(~F.col("found")).alias("missing"), F.max("score").alias("score"))


@query("""WITH d AS (SELECT doc_id, list_transform(range(0, doc_id % 6), lambda i: CASE WHEN (doc_id + i) % 3 = 0 THEN source WHEN (doc_id + i) % 3 = 1 THEN lang ELSE 'unknown' END) AS s FROM documents) SELECT doc_id, array_to_string(s[1:3], '|') AS top_sources, CAST(len(s) AS INT) AS num_sources FROM d""")
def feedback_insertion(spark, sf):
    at = lambda i: (F.col("doc_id") + i) % 3
    one = lambda i: F.struct(F.when(at(i) == 0, F.col("source")).alias("source"), F.when(at(i) == 1, F.col("lang")).alias("title"))
    n = (F.col("doc_id") % 6).cast("int")
    sources = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), one)).otherwise(F.array().cast("array<struct<source:string,title:string>>"))
    rows = C.with_top_sources(table(spark, sf, "documents").select("doc_id", sources.alias("sources")))
    return rows.select("doc_id", F.array_join("top_sources", "|").alias("top_sources"), "num_sources")


@query("""SELECT doc_id, md5(text) || ':' || CAST(i AS VARCHAR) AS chunk_id, CAST(i AS INT) AS nth FROM (SELECT doc_id, text, unnest(range(0, doc_id % 4 + 1)) AS i FROM documents)""")
def upload_chunks(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.array_repeat(F.lit("x"), (F.col("doc_id") % 4 + 1).cast("int")).alias("chunks"))
    return C.numbered_chunks(d).select("doc_id", "chunk_id", "nth")


@query("""WITH u AS (SELECT CASE doc_id % 5 WHEN 0 THEN '../a/' || lang || CAST(doc_id AS VARCHAR) || '.pdf' WHEN 1 THEN '.hidden' WHEN 2 THEN 'c:\\x\\' || CAST(doc_id AS VARCHAR) || '.TXT' WHEN 3 THEN 'dir/' ELSE CAST(doc_id AS VARCHAR) || '.exe' END AS raw, doc_id FROM documents),
b AS (SELECT doc_id, regexp_extract(replace(raw, '\\', '/'), '([^/]*)$', 1) AS name FROM u) SELECT doc_id, name, CASE WHEN name = '' OR starts_with(name, '.') THEN 'rejected' WHEN lower(regexp_extract(name, '\\.([^.]*)$', 1)) NOT IN ('pdf', 'txt', 'docx') THEN 'unsupported' WHEN doc_id % 10 = 2 THEN 'duplicate' ELSE 'accepted' END AS outcome FROM b""")
def upload_checks(spark, sf):
    d, s = F.col("doc_id"), F.col("doc_id").cast("string")
    raw = F.when(d % 5 == 0, F.concat(F.lit("../a/"), "lang", s, F.lit(".pdf"))).when(d % 5 == 1, ".hidden").when(d % 5 == 2, F.concat(F.lit("c:\\x\\"), s, F.lit(".TXT"))).when(d % 5 == 3, "dir/").otherwise(F.concat(s, F.lit(".exe")))
    docs = table(spark, sf, "documents")
    there = docs.filter("doc_id % 10 = 2").select(F.concat(s, F.lit(".TXT")).alias("name"))
    return B.checked_uploads(docs.select("doc_id", raw.alias("raw")), there, ["pdf", "txt", "docx"]).select("doc_id", F.coalesce("name", F.regexp_extract(F.replace("raw", F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)).alias("name"), "outcome")


@query(f"""WITH {MAP['files']}, c AS (SELECT name, mtime + CASE WHEN size % 3 = 0 THEN 2 ELSE 0 END AS then_, CASE WHEN size % 5 = 0 THEN 'bad' END AS error FROM snap) SELECT cur.name, coalesce(abs(cur.mtime - then_) < 1 AND error IS NULL, false) AS valid FROM cur LEFT JOIN c ON cur.name = c.name""")
def cache_validity(spark, sf):
    cur, snap = files(spark, sf)
    cached = snap.select("name", (F.col("mtime") + F.when(F.col("size") % 3 == 0, 2).otherwise(0)).alias("mtime"), F.when(F.col("size") % 5 == 0, "bad").alias("error"))
    return B.cache_state(cur, cached)


@query(f"""WITH {MAP['files']}, ch AS (SELECT coalesce(cur.name, snap.name) AS name, cur.size AS size, CASE WHEN snap.name IS NULL THEN 'new' WHEN cur.name IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM cur FULL JOIN snap ON cur.name = snap.name
WHERE snap.name IS NULL OR cur.name IS NULL OR cur.size <> snap.size OR cur.mtime <> snap.mtime) SELECT name FROM ch WHERE change <> 'deleted' AND size % 2 = 0""")
def sync_targets(spark, sf):
    cur, snap = files(spark, sf)
    return B.to_process(B.sync_diff(cur, snap), cur.filter("size % 2 = 0"))


@query(f"""WITH {_N}, f AS (SELECT DISTINCT doc_id || '.txt' AS name, doc_type, length(title) AS size FROM nodes WHERE node_id % 6 < 2 AND contains(doc_id, '1')) SELECT name, size, doc_type FROM f WHERE upper(doc_type) = 'FORM'""")
def file_listing(spark, sf):
    f = nodes(spark, sf).filter("node_id % 6 < 2").select(F.concat("doc_id", F.lit(".TXT")).alias("name"), "doc_type", F.length("title").alias("size"))
    rows = B.listed(f.withColumn("name", F.lower("name")).distinct(), "1", "form", "size", True)
    return rows.select("name", F.col("size").cast("long").alias("size"), "doc_type")


@query("""WITH r AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'timeout' WHEN 3 THEN 'no sections' END AS error FROM documents) SELECT CAST(count(*) FILTER (error IS NULL) AS BIGINT) AS succeeded, CAST(count(*) FILTER (error IS NOT NULL) AS BIGINT) AS failed, count(*) AS total, round(100 * count(*) FILTER (error IS NULL) / CAST(greatest(count(*), 1) AS DOUBLE), 2) AS rate FROM r""")
def extraction_summary(spark, sf):
    return B.extraction_summary(_results(spark, sf))


def _results(spark, sf):
    d = F.col("doc_id")
    return table(spark, sf, "documents").select("doc_id", F.when(d % 7 == 0, "timeout").when(d % 7 == 3, "no sections").alias("error"))


@query("SELECT CASE doc_id % 7 WHEN 0 THEN 'timeout' WHEN 3 THEN 'no sections' END AS error, count(*) AS n FROM documents WHERE doc_id % 7 IN (0, 3) GROUP BY 1")
def extraction_failures(spark, sf):
    return B.extraction_failures(_results(spark, sf))


@query("""WITH f AS (SELECT 'doc' || CAST(doc_id // 2 AS VARCHAR) || CASE WHEN doc_id % 3 = 0 THEN '.PDF' ELSE '.txt' END AS name FROM documents),
s AS (SELECT regexp_replace(name, '\\.[^.]*$', '') AS stem, array_to_string(list_sort(list(DISTINCT lower(regexp_extract(name, '\\.([^.]*)$', 1)))), ',') AS extensions FROM f GROUP BY 1) SELECT extensions, count(*) AS stems FROM s GROUP BY 1""")
def extension_combinations(spark, sf):
    d = F.col("doc_id")
    name = F.concat(F.lit("doc"), F.floor(d / 2).cast("string"), F.when(d % 3 == 0, ".PDF").otherwise(".txt"))
    return B.extension_kinds(table(spark, sf, "documents").select(name.alias("name")))


@query(f"WITH {_N}, o AS (SELECT doc_id, min(tenant_id) AS tenant_id FROM nodes WHERE doc_id <> 'src1' GROUP BY 1) SELECT n.node_id, coalesce(o.tenant_id, 'shared') AS owner FROM nodes n LEFT JOIN o USING (doc_id)")
def file_owners(spark, sf):
    n = nodes(spark, sf)
    return B.with_owner(n.select("node_id", "doc_id"), n.filter("doc_id <> 'src1'").groupBy("doc_id").agg(F.min("tenant_id").alias("tenant_id")))


@query(f"WITH {_N} SELECT CAST(count(*) AS BIGINT) AS left_rows, CAST(count(*) FILTER (node_id % 10 <> 0) AS BIGINT) AS right_rows, abs(count(*) - count(*) FILTER (node_id % 10 <> 0)) > 5 AS differs FROM nodes")
def store_counts(spark, sf):
    n = nodes(spark, sf)
    return B.reconciled(n, n.filter("node_id % 10 <> 0"), 5)


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'title' END AS corrected, CASE WHEN doc_id % 3 = 0 THEN upper(lang) END AS value FROM documents WHERE doc_id % 6 IN (0, 3) """)
def corrections_read(spark, sf):
    d = table(spark, sf, "documents").filter("doc_id % 6 < 4").select("doc_id", F.create_map(F.lit("title"), F.when(F.col("doc_id") % 3 == 0, F.upper("lang"))).alias("fields"))
    got = D.corrections_of(d)
    return got.select("doc_id", F.map_keys("fields")[0].alias("corrected"), F.map_values("fields")[0].alias("value"))


@query("""WITH p AS (SELECT 't' || CAST(doc_id % 3 AS VARCHAR) AS tenant_id, 'f' || CAST(doc_id % 50 AS VARCHAR) AS name, doc_id AS n, lang FROM documents) SELECT tenant_id, name, arg_max(lang, n) AS lang FROM p GROUP BY ALL""")
def per_tenant_files(spark, sf):
    d = F.col("doc_id")
    rows = table(spark, sf, "documents").select(F.concat(F.lit("t"), (d % 3).cast("string")).alias("tenant_id"), F.concat(F.lit("f"), (d % 50).cast("string")).alias("name"), d.alias("n"), "lang")
    return D.merged_by_tenant(rows.filter("n % 2 = 0"), rows.filter("n % 2 = 1"), ["tenant_id", "name"], "n").drop("n")


@query("SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS INT) AS tokens, (SELECT count(*) FROM documents) AS rebuilt FROM documents")
def token_index(spark, sf):
    """How many tokens each node has in the stored index, and what its rebuilding returns."""
    n = nodes(spark, sf)
    index = KeywordIndex(spark, scratch(spark, "keyword"))
    rebuilt = index.rebuild(n)
    held = index.table.read().groupBy("node_id").agg(F.sum("tf").cast("int").alias("tokens"))
    return n.select("node_id").join(held, "node_id", "left").select(F.col("node_id").alias("doc_id"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.lit(rebuilt).alias("rebuilt"))


@query(f"WITH {_N} SELECT node_id, doc_id FROM nodes WHERE doc_id IN ('src4', 'src5') AND tenant_id IN ('t1', 'shared') UNION ALL SELECT node_id, doc_id FROM nodes WHERE node_id IN (5, 17, 100000)")
def node_scans(spark, sf):
    n = nodes(spark, sf)
    return R.scanned(n, docs=["src4", "src5"], tenant="t1").select("node_id", "doc_id").unionByName(R.scanned(n, ids=[5, 17, 100_000]).select("node_id", "doc_id"))


@query(f"WITH {MAP['messages']}, s AS (SELECT DISTINCT session_id FROM messages) SELECT 'sessions' AS part, session_id, CAST(NULL AS BIGINT) AS ord FROM s WHERE session_id % 4 <> 1 UNION ALL SELECT 'uploads', doc_id % 30, doc_id FROM documents WHERE doc_id % 30 % 4 <> 1 OR doc_id % 30 NOT IN (SELECT session_id FROM s)")
def session_deletion(spark, sf):
    s = messages(spark, sf).select("session_id").distinct()
    uploads = table(spark, sf, "documents").select((F.col("doc_id") % 30).alias("session_id"), F.col("doc_id").alias("ord"))
    left = D.delete_documents({"sessions": s, "uploads": uploads}, s.filter("session_id % 4 = 1"), "session_id")
    return left["sessions"].select(F.lit("sessions").alias("part"), "session_id", F.lit(None).cast("long").alias("ord")).unionByName(left["uploads"].select(F.lit("uploads").alias("part"), "session_id", "ord"))


@query(f"WITH {_N} SELECT doc_id AS name, min(tenant_id) AS tenant_id FROM nodes WHERE tenant_id <> 'shared' GROUP BY 1")
def first_owners(spark, sf):
    return B.first_owner(nodes(spark, sf).filter("tenant_id <> 'shared'").select(F.col("doc_id").alias("name"), "tenant_id"))


@query(f"""WITH {_N}, r AS (SELECT node_id % 50 AS query_id, row_number() OVER (PARTITION BY node_id % 50 ORDER BY node_id) AS rank, text, doc_id FROM nodes)
SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) FILTER (rank <= 15) AS context, (SELECT string_agg(doc_id, '|' ORDER BY first) FROM (SELECT doc_id, min(rank) AS first FROM r s WHERE s.query_id = r.query_id AND rank <= 10 GROUP BY 1)) AS sources FROM r GROUP BY 1""")
def answer_context(spark, sf):
    n = nodes(spark, sf)
    nth = F.row_number().over(Window.partitionBy(F.col("node_id") % 50).orderBy("node_id"))
    return A.context(n.select("node_id", (F.col("node_id") % 50).alias("query_id"), nth.alias("rank")), n).select("query_id", "context", F.array_join("sources", "|").alias("sources"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 25 WHEN 3 THEN NULL ELSE 20 END AS top_k FROM documents")
def nodes_by_scope(spark, sf):
    d = F.col("doc_id")
    scope = F.when(d % 4 == 0, "broad").when(d % 4 == 1, "focused").when(d % 4 == 2, "too_broad")
    return table(spark, sf, "documents").select("doc_id", A.top_k(scope).alias("top_k"))

"""Registered queries: stored tables as they change, searches in several steps, trees, pages and states, each with the same computation
in SQL."""

from pyspark.sql import functions as F

from .operators import administration as M
from .operators import batches, trees
from .operators import conversations as C
from .operators import retrieval as R
from .operators import sections as S
from .plans import answer as A
from .plans.refine import refined
from .indexes import TERMS_SQL, index_of
from .queries_more import pick
from .session import SQL as MAP
from .session import messages, nodes, scratch, table, vectors
from .sources.logged import LoggedTable
from .streaming.sticky import sticky_batch
from .streaming.sync import sync_library

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


_N = MAP["nodes"]
_TOK = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
_COS = "round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6)"


@query("""WITH a AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'xx' ELSE lang END AS lang, source FROM documents WHERE (doc_id % 3 <> 0 OR doc_id % 2 = 0) AND doc_id % 5 <> 0)
SELECT doc_id, lang, source FROM a WHERE doc_id % 10 <> 1 AND doc_id % 9 <> 0 UNION ALL SELECT doc_id, lang, 'b3' FROM documents WHERE doc_id % 10 = 1""")
def merged_table(spark, sf):
    """A table after three batches, the first two of them compacted."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    t = LoggedTable(spark, scratch(spark, "merged"), d.schema, "doc_id", buckets=8)
    t.append(d.filter("doc_id % 3 <> 0"))
    t.append(d.filter("doc_id % 2 = 0 AND doc_id % 5 <> 0").withColumn("lang", F.lit("xx")), d.filter("doc_id % 5 = 0"))
    t.compact()
    t.append(d.filter("doc_id % 10 = 1").withColumn("source", F.lit("b3")), d.filter("doc_id % 9 = 0"))
    return t.read()


def _synced(spark, sf):
    """Three runs of a library's sync: counts of each, and the table after them. Files of 13 fail until the third run."""
    d = F.col("doc_id")
    files = table(spark, sf, "documents").select(d.alias("n"), F.concat(F.lit("doc"), d.cast("string")).alias("name"), F.col("n_chars").alias("size"), (d * 10).alias("mtime"))
    snapshot = LoggedTable(spark, scratch(spark, "snapshot"), files.schema, "name", buckets=4)
    held = LoggedTable(spark, scratch(spark, "files"), "name string, node_id bigint, size bigint, run int", "name", buckets=4)
    later = files.filter("n % 7 <> 0").withColumn("size", F.when(F.col("n") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")))
    counts = []
    for run, (current, fails) in enumerate([(files.filter("n % 11 <> 0"), 13), (later, 13), (later, 0)], 1):
        make = lambda wanted: {"files": (wanted.filter(F.col("n") % fails != 0) if fails else wanted).select("name", F.col("n").alias("node_id"), "size", F.lit(run).alias("run"))}  # noqa: B023, E731
        counts.append((run, *sync_library(current, snapshot, {"files": held}, make).values()))
        if run == 1:
            held.compact()
    return counts, held.read()


@query("""SELECT 'doc' || CAST(doc_id AS VARCHAR) AS name, doc_id AS node_id, CASE WHEN doc_id % 5 = 0 THEN n_chars + 1 ELSE n_chars END AS size, CASE WHEN doc_id % 13 = 0 THEN 3 WHEN doc_id % 5 = 0 OR doc_id % 11 = 0 THEN 2 ELSE 1 END AS run FROM documents WHERE doc_id % 7 <> 0""")
def library_after_syncs(spark, sf):
    return _synced(spark, sf)[1]


@query("""WITH d AS (SELECT doc_id AS n FROM documents) SELECT 1 AS run, count(*) FILTER (n % 11 <> 0 AND n % 13 <> 0) AS added, CAST(0 AS BIGINT) AS modified, CAST(0 AS BIGINT) AS deleted, count(*) FILTER (n % 11 <> 0 AND n % 13 = 0) AS failed FROM d
UNION ALL SELECT 2, count(*) FILTER (n % 7 <> 0 AND n % 11 = 0 AND n % 13 <> 0), count(*) FILTER (n % 7 <> 0 AND n % 11 <> 0 AND n % 13 <> 0 AND n % 5 = 0), count(*) FILTER (n % 11 <> 0 AND n % 13 <> 0 AND n % 7 = 0), count(*) FILTER (n % 7 <> 0 AND n % 13 = 0) FROM d
UNION ALL SELECT 3, count(*) FILTER (n % 7 <> 0 AND n % 13 = 0), 0, 0, 0 FROM d""")
def sync_counts(spark, sf):
    return spark.createDataFrame(_synced(spark, sf)[0], "run int, added long, modified long, deleted long, failed long")


# every benchmark item as a sub-query with its own tenant, types, title and number of nodes
_SUB = f"""{_N}, q AS (SELECT item_id AS query_id, text, embedding AS e, CASE item_id % 3 WHEN 0 THEN 't1' WHEN 1 THEN 't2' END AS tenant, CASE item_id % 5 WHEN 0 THEN ['FORM', 'POLICY'] WHEN 1 THEN ['MANUAL'] END AS types, CASE item_id % 4 WHEN 1 THEN 'TH' WHEN 2 THEN 'A' END AS wanted, CAST(item_id % 6 + 3 AS INT) AS k FROM benchmark JOIN embeddings ON vec_id = item_id),
seen AS (SELECT query_id, node_id, title, wanted, k FROM nodes, q WHERE (tenant IS NULL OR tenant_id IN (tenant, 'shared')) AND (types IS NULL OR upper(doc_type) IN (SELECT unnest(types)))),
term AS (SELECT query_id, unnest({TERMS_SQL.format('text')}) AS term FROM q), post AS (SELECT node_id, term, count(*) AS tf FROM (SELECT node_id, unnest({_TOK.format('text')}) AS term FROM nodes) GROUP BY ALL),
ks AS (SELECT query_id, node_id, round(sum(tf) * 0.1, 6) AS s FROM post JOIN term USING (term) GROUP BY ALL),
k1 AS (SELECT query_id, node_id, s, title, wanted, k FROM ks JOIN seen USING (query_id, node_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, node_id) <= CASE WHEN wanted IS NULL THEN k ELSE 2 * k END),
kw AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, node_id) AS w FROM k1 WHERE wanted IS NULL OR contains(upper(title), wanted) QUALIFY w <= k),
vs AS (SELECT query_id, vec_id AS node_id, {_COS} AS s FROM embeddings, q),
v1 AS (SELECT query_id, node_id, s, title, wanted, k FROM vs JOIN seen USING (query_id, node_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, node_id) <= CASE WHEN wanted IS NULL THEN k ELSE 2 * k END),
vec AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, node_id) AS v FROM v1 WHERE wanted IS NULL OR contains(upper(title), wanted) QUALIFY v <= k),
f AS (SELECT query_id, node_id, v, w, round(coalesce(1.0::DOUBLE / (60 + v), 0) + coalesce(1.0::DOUBLE / (60 + w), 0), 9) AS score FROM vec FULL JOIN kw USING (query_id, node_id)),
fused AS (SELECT query_id, node_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, v ASC NULLS LAST, w ASC NULLS LAST) AS INT) AS rank FROM f JOIN q USING (query_id) QUALIFY rank <= k)"""


def _sub(spark, sf):
    b, i = table(spark, sf, "benchmark"), F.col("item_id")
    types = F.when(i % 5 == 0, F.array(F.lit("form"), F.lit("POLICY"))).when(i % 5 == 1, F.array(F.lit("Manual")))
    q = b.join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding"), "item_id")
    return q.select(i.alias("query_id"), "text", F.col("embedding").alias("vector"), F.when(i % 3 == 0, "t1").when(i % 3 == 1, "t2").alias("tenant"), types.alias("types"), F.when(i % 4 == 1, "th").when(i % 4 == 2, "a").alias("title"), (i % 6 + 3).cast("int").alias("k"))


@query(f"WITH {_SUB} SELECT * FROM fused")
def sub_query_retrieval(spark, sf):
    return R.hybrid_each(nodes(spark, sf), vectors(spark, sf), _sub(spark, sf), counted=index_of(spark, sf).table.read())


@query(f"""WITH {_SUB}, s AS (SELECT query_id, node_id, score, rank, CASE WHEN length(q.text) % 5 <> 3 OR length(substr(n.text, 1, 1000)) < 900 THEN CAST(length(substr(n.text, 1, 1000)) % 7 AS DOUBLE) END AS new FROM fused JOIN q USING (query_id) JOIN nodes n USING (node_id)),
t AS (SELECT *, bool_or(new IS NULL) OVER (PARTITION BY query_id) AS failed FROM s) SELECT query_id, node_id, CASE WHEN failed THEN score ELSE new END AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN failed THEN 0 ELSE new END DESC, rank) AS INT) AS rank FROM t QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN failed THEN 0 ELSE new END DESC, rank) <= 5""")
def sub_query_reranking(spark, sf):
    """With a model's place taken by the length of an excerpt; for some questions it fails."""
    n, q = nodes(spark, sf), _sub(spark, sf)
    ranked = R.hybrid_each(n, vectors(spark, sf), q, counted=index_of(spark, sf).table.read())
    return R.reranked(ranked, q, n, lambda question, excerpt: F.when((F.length(question) % 5 != 3) | (F.length(excerpt) < 900), F.length(excerpt) % 7), 5)


@query(f"""WITH n AS (SELECT vec_id AS node_id, embedding FROM embeddings WHERE vec_id % 2 = 1), q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0),
r AS (SELECT query_id, node_id, {_COS} AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {_COS} DESC, node_id) AS INT) AS rank FROM n, q QUALIFY rank <= 5),
refs AS (SELECT DISTINCT query_id, unnest([node_id * 3 % 400, node_id * 7 % 400]) AS ref FROM r WHERE rank <= 3), asked AS (SELECT vec_id AS ref, embedding AS e FROM embeddings WHERE vec_id IN (SELECT ref FROM refs)),
h AS (SELECT ref, node_id, {_COS} AS s FROM n, asked QUALIFY row_number() OVER (PARTITION BY ref ORDER BY {_COS} DESC, node_id) = 1),
b AS (SELECT query_id, node_id, max(s) AS s FROM refs JOIN h USING (ref) WHERE s > 0.3 GROUP BY ALL), m AS (SELECT b.*, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, node_id) AS place FROM b ANTI JOIN r USING (query_id, node_id) QUALIFY place <= 3)
SELECT query_id, node_id, score, rank FROM r UNION ALL SELECT query_id, node_id, round(s * 0.6, 6), CAST(place + (SELECT count(*) FROM r WHERE r.query_id = m.query_id) AS INT) FROM m""")
def reference_expansion(spark, sf):
    i = F.col("vec_id")
    e = table(spark, sf, "embeddings")
    refs = F.concat(F.lit("FORMS: v"), (i * 3 % 400).cast("string"), F.lit("| REGS: v"), (i * 7 % 400).cast("string"), F.lit(", "))
    n = e.filter(i % 2 == 1).select(i.alias("node_id"), F.lit("t1").alias("tenant_id"), refs.alias("references"))
    asked = e.filter(i % 50 == 0).select(i.alias("query_id"), F.col("embedding").alias("vector"))
    ranked = R.vector_top_each(n, vectors(spark, sf), asked, 5)
    return R.expanded(ranked, n, vectors(spark, sf), e.select(F.concat(F.lit("v"), i.cast("string")).alias("ref"), F.col("embedding").alias("vector")), least=0.3)


def _confidence_sql(i, text):
    return f"""t{i} AS (SELECT item_id AS query_id, {text} AS text FROM benchmark), m{i} AS (SELECT query_id, unnest({TERMS_SQL.format('text')}) AS term FROM t{i}),
s{i} AS (SELECT query_id, node_id, round(sum(tf) * 0.1, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(tf) * 0.1, 6) DESC, node_id) AS rank FROM post JOIN m{i} USING (term) GROUP BY query_id, node_id QUALIFY rank <= 10),
n{i} AS (SELECT query_id, rank, CASE WHEN max(score) OVER o > min(score) OVER o THEN (score - min(score) OVER o) / (max(score) OVER o - min(score) OVER o) ELSE 1.0 END AS s FROM s{i} WINDOW o AS (PARTITION BY query_id)),
c{i} AS (SELECT query_id, CAST(floor(round(100 * (0.30 * avg(s) FILTER (rank <= 1) + 0.25 * avg(s) FILTER (rank <= 3) + 0.20 * avg(s) FILTER (rank <= 2) + 0.15 * (count(*) FILTER (rank <= 10 AND s > 0.7)) / least(count(*), 10) + 0.10 * least(count(*) / 10.0, 1.0)), 6)) AS INT) AS c FROM n{i} GROUP BY 1)"""


_HALF = "array_to_string(string_split(text, ' ')[1:len(string_split(text, ' ')) // 2 + 1], ' ')"
_THREE = "array_to_string(string_split(text, ' ')[1:3], ' ')"


@query(f"""WITH post AS (SELECT node_id, term, count(*) AS tf FROM (SELECT doc_id AS node_id, unnest({_TOK.format('text')}) AS term FROM documents) GROUP BY ALL), {_confidence_sql(1, 'text')}, {_confidence_sql(2, _HALF)}, {_confidence_sql(3, _THREE)},
a AS (SELECT query_id, 1 AS attempt, text, coalesce(c, 0) AS c FROM t1 LEFT JOIN c1 USING (query_id)), b AS (SELECT query_id, 2 AS attempt, t2.text, coalesce(c2.c, 0) AS c FROM t2 JOIN a USING (query_id) LEFT JOIN c2 USING (query_id) WHERE a.c < 72 AND query_id % 4 > 0),
d AS (SELECT query_id, 3 AS attempt, t3.text, coalesce(c3.c, 0) AS c FROM t3 JOIN b USING (query_id) LEFT JOIN c3 USING (query_id) WHERE b.c < 72 AND query_id % 4 > 0), u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM d)
SELECT query_id, attempt, CAST(max(attempt) OVER (PARTITION BY query_id) AS INT) AS attempts, text, c AS confidence_pct FROM u QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c DESC, attempt) = 1""")
def refined_questions(spark, sf):
    """All benchmark items, asked again in half their words and then in three while they are under 72, but for every fourth."""
    index = index_of(spark, sf)
    search = lambda q: R.confidence(index.top_each(q, 10), by="query_id")
    words = F.split("text", " ")

    def rewrite(low, attempt):
        short = F.slice(words, F.lit(1), F.floor(F.size(words) / 2).cast("int") + 1) if attempt == 1 else F.slice(words, 1, 3)
        return low.filter("query_id % 4 > 0").select("query_id", F.array_join(short, " ").alias("text"))

    return refined(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"), search, rewrite, 72)


_ASKED = """m AS (SELECT conv_id, turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, (['clarification', 'follow_up', 'new_query', 'new_query', 'new_query'])[CAST((conv_id * 7 + turn * 3) % 5 AS INT) + 1] AS intent, (conv_id + turn) % 9 > 0 AS ctx,
 CASE (turn * 5 + conv_id) % 3 WHEN 0 THEN 'DIFFERENT' WHEN 1 THEN 'FOLLOWUP' END AS shift, list_transform(range(0, turn % 3), lambda i: 'c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) || '-' || CAST(i AS VARCHAR)) AS found FROM conversations)"""


@query(f"""WITH RECURSIVE {_ASKED}, r(conv_id, n, id, turn, held, reuse, reset, chunks) AS (SELECT conv_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0, CAST([] AS VARCHAR[]), false, CAST(NULL AS VARCHAR), CAST([] AS VARCHAR[]) FROM (SELECT DISTINCT conv_id FROM m)
UNION ALL SELECT conv_id, n, id, CASE WHEN ctx THEN (CASE WHEN NOT reuse AND turn = 0 THEN 1 ELSE turn END) + 1 ELSE turn END, CASE WHEN ctx AND NOT reuse THEN found ELSE held END, reuse, reset, CASE WHEN reuse THEN held ELSE found END FROM (
 SELECT conv_id, n, id, ctx, found, CASE WHEN ctx AND turn >= 6 THEN 0 ELSE turn END AS turn, CASE WHEN ctx AND turn >= 6 THEN [] ELSE held END AS held, reuse AND NOT (ctx AND turn >= 6) AS reuse, CASE WHEN ctx AND turn >= 6 THEN 'turn_limit' ELSE reset END AS reset FROM (
  SELECT conv_id, n, id, ctx, found, CASE WHEN away THEN 0 ELSE turn END AS turn, CASE WHEN away THEN [] ELSE held END AS held, sticky OR coalesce(on_ AND shift = 'FOLLOWUP' AND len(held) > 0, false) AS reuse, CASE WHEN away THEN 'topic_change' END AS reset FROM (
   SELECT *, coalesce(on_ AND shift = 'DIFFERENT', false) AS away FROM (SELECT m.conv_id, m.n, m.id, m.ctx, m.found, m.shift, r.turn, r.held, m.intent IN ('clarification', 'follow_up') AND len(r.held) > 0 AS sticky, NOT (m.intent IN ('clarification', 'follow_up') AND len(r.held) > 0) AND m.ctx AND r.turn > 0 AND m.n > 1 AS on_ FROM r JOIN m ON m.conv_id = r.conv_id AND m.n = r.n + 1)))))
SELECT conv_id AS session_id, id, reuse, reset, turn, array_to_string(chunks, ',') AS chunks FROM r WHERE n > 0""")
def sticky_chunks(spark, sf):
    return sticky_batch(_asked(spark, sf)).withColumn("chunks", F.array_join("chunks", ","))


def _asked(spark, sf):
    c, t = F.col("conv_id"), F.col("turn")
    shift = F.when((t * 5 + c) % 3 == 0, "DIFFERENT").when((t * 5 + c) % 3 == 1, "FOLLOWUP")
    found = F.transform(F.slice(F.sequence(F.lit(0), F.lit(2)), F.lit(1), (t % 3).cast("int")), lambda i: F.concat_ws("-", F.concat(F.lit("c"), c.cast("string")), t.cast("string"), i.cast("string")))
    intent = pick(["clarification", "follow_up", "new_query", "new_query", "new_query"], c * 7 + t * 3)
    return table(spark, sf, "conversations").select(c.alias("session_id"), t.alias("id"), intent.alias("intent"), ((c + t) % 9 > 0).alias("in_context"), shift.alias("shift"), found.alias("chunks"))


_SECTIONS = ["1 One", "1.1 Part", "1.1.1 Deep", "2 Two", "  ", "3.1 Alone", "Annex"]
_TREE = f"""rec AS (SELECT 't' || CAST(doc_id % 3 AS VARCHAR) AS tenant_id, 'f' || CAST(doc_id // 3 AS VARCHAR) AS doc_id, doc_id AS n, lang FROM documents), last AS (SELECT doc_id, max(n) AS n, arg_max(lang, n) AS title FROM rec GROUP BY 1),
l AS (SELECT doc_id, n, title, list_filter(([{", ".join(f"'{s}'" for s in _SECTIONS)}])[CAST(n % 3 AS INT) + 1:CAST(n % 3 + n % 7 AS INT)], lambda x: trim(x) <> '') AS s FROM last), ok AS (SELECT * FROM l WHERE n % 11 <> 0 AND len(s) > 0),
t AS (SELECT doc_id, title, unnest(s) AS name, generate_subscripts(s, 1) - 1 AS ord FROM ok), i AS (SELECT *, CASE WHEN name = 'Annex' THEN name ELSE split_part(name, ' ', 1) END AS section_id FROM t),
p AS (SELECT i.*, u.section_id AS parent, u.ord AS up, w.ord AS upup FROM i LEFT JOIN i u ON u.doc_id = i.doc_id AND contains(i.section_id, '.') AND u.section_id = regexp_replace(i.section_id, '\\.[^.]+$', '') LEFT JOIN i w ON w.doc_id = u.doc_id AND contains(u.section_id, '.') AND w.section_id = regexp_replace(u.section_id, '\\.[^.]+$', '')),
ch AS (SELECT 'f' || CAST(doc_id % 300 AS VARCHAR) AS doc_id, (['1', '1.1', '2', 'Annex', ''])[CAST(doc_id % 5 AS INT) + 1] AS section_id, list(doc_id ORDER BY doc_id) AS chunk_ids FROM documents GROUP BY ALL),
tree AS (SELECT p.doc_id, title, CAST(ord AS INT) AS ord, p.section_id, name, parent, list_filter([upup, up, ord], lambda x: x IS NOT NULL) AS path, coalesce(chunk_ids, []) AS chunk_ids FROM p LEFT JOIN ch ON ch.doc_id = p.doc_id AND ch.section_id = p.section_id)"""


def _trees(spark, sf):
    d = F.col("doc_id")
    names = F.slice(F.array(*[F.lit(s) for s in _SECTIONS]), (d % 3 + 1).cast("int"), (d % 7).cast("int"))
    records = table(spark, sf, "documents").select(F.concat(F.lit("t"), (d % 3).cast("string")).alias("tenant_id"), F.concat(F.lit("f"), F.floor(d / 3).cast("string"), F.lit(".pdf")).alias("name"), F.lit("FORM").alias("doc_type"), F.col("lang").alias("title"), F.when(d % 11 == 0, "bad").alias("error"), names.alias("sections"))
    chunks = table(spark, sf, "documents").select(d.alias("node_id"), F.concat(F.lit("f"), (d % 300).cast("string")).alias("doc_id"), pick(["1", "1.1", "2", "Annex", ""], d).alias("section_id"))
    return trees.rebuild(records, chunks)


@query(f"WITH {_TREE} SELECT doc_id, title, ord, section_id, name, parent, array_to_string(path, '.') AS path, array_to_string(chunk_ids, ',') AS chunk_ids FROM tree")
def rebuilt_trees(spark, sf):
    """Trees of all tenants' last records, saved and loaded again."""
    at = scratch(spark, "trees")
    trees.save(_trees(spark, sf)[0], at)
    return trees.load(spark, at).select("doc_id", "title", "ord", "section_id", "name", "parent", F.array_join("path", ".").alias("path"), F.array_join("chunk_ids", ",").alias("chunk_ids"))


@query(f"WITH {_TREE} SELECT (SELECT count(*) FROM ok) AS built, (SELECT count(*) FROM last) - (SELECT count(*) FROM ok) AS skipped")
def rebuilt_counts(spark, sf):
    return _trees(spark, sf)[1]


@query(f"""WITH {_TREE}, x AS (SELECT doc_id, path, CASE WHEN len(path) = 1 AND row_number() OVER (PARTITION BY doc_id ORDER BY path) > 1 THEN chr(10) ELSE '' END || repeat('  ', len(path) - 1) || '├─ ' || section_id || ': ' || CASE WHEN name = 'Annex' THEN name ELSE split_part(name, ' ', 2) END || CASE WHEN len(chunk_ids) > 0 THEN ' [' || CAST(len(chunk_ids) AS VARCHAR) || ' chunks]' ELSE ' [no chunks]' END AS line FROM tree)
SELECT doc_id, 'Document: ' || doc_id || chr(10) || repeat('=', 80) || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY path) || chr(10) AS text FROM x GROUP BY 1""")
def printed_trees(spark, sf):
    return trees.printed(_trees(spark, sf)[0])


def _step(text):
    if len(text or "") % 5 == 0:
        raise ValueError(f"bad length {len(text or '')}")
    return (text or "")[:10].upper()


@query("SELECT doc_id, CASE WHEN length(text) % 5 > 0 THEN upper(substr(text, 1, 10)) END AS result, CASE WHEN length(text) % 5 = 0 THEN 'bad length ' || CAST(length(text) AS VARCHAR) END AS error, length(text) % 5 > 0 AS ok FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^ -~]', 'x', 'g') AS text FROM documents)")
def attempted_rows(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~]", "x").alias("text"))
    return batches.attempted(d, _step, "string").drop("text")


@query("SELECT CAST(count(*) FILTER (length(text) % 5 > 0) AS BIGINT) AS succeeded, CAST(count(*) FILTER (length(text) % 5 = 0) AS BIGINT) AS failed, count(*) AS total FROM documents")
def attempted_counts(spark, sf):
    return batches.outcome(batches.attempted(table(spark, sf, "documents").select("doc_id", "text"), _step, "string"))


@query(f"WITH {_N} SELECT node_id, CAST((row_number() OVER (ORDER BY doc_id, node_id) - 1) // 100 AS INT) AS page FROM nodes")
def node_pages(spark, sf):
    return batches.page_of_each(nodes(spark, sf).select("doc_id", "node_id"), ["doc_id", "node_id"], 100).select("node_id", "page")


@query(f"""WITH {MAP['messages']}, a AS (SELECT session_id, max(id) AS id FROM messages WHERE role = 'assistant' GROUP BY 1), c AS (SELECT session_id, id, unnest(range(0, id * 30, 7)[1:40]) + session_id AS node_id FROM a), h AS (SELECT session_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS node_ids, count(doc_id) AS found, count(*) - count(doc_id) AS missing FROM c LEFT JOIN documents ON doc_id = node_id GROUP BY 1)
SELECT a.session_id, 'topic' || CAST(a.session_id % 5 AS VARCHAR) AS topic, CASE WHEN a.id % 2 = 0 THEN 'broad' ELSE 'focused' END AS scope, CAST(a.id AS INT) AS turn_count, coalesce(node_ids, '') AS node_ids, CAST(coalesce(found, 0) AS BIGINT) AS found, CAST(coalesce(missing, 0) AS BIGINT) AS missing FROM a LEFT JOIN h USING (session_id)""")
def session_switches(spark, sf):
    """Contexts saved with the assistant's messages, and what every session goes on with."""
    s, i = F.col("session_id"), F.col("id")
    ids = F.when(i > 0, F.transform(F.sequence(F.lit(0), i * 30 - 1, F.lit(7)), lambda x: x + s)).otherwise(F.array().cast("array<bigint>"))
    rows = messages(spark, sf).withColumns({"topic": F.concat(F.lit("topic"), (s % 5).cast("string")), "scope": F.when(i % 2 == 0, "broad").otherwise("focused"), "turn": i.cast("int"), "chunks": ids})
    return C.switched(C.with_snapshot(rows), nodes(spark, sf)).withColumn("node_ids", F.array_join("node_ids", ","))


@query("""SELECT 's' || CAST(doc_id % 20 AS VARCHAR) AS session_id, doc_id AS file_id, CAST(i AS INT) AS nth, CASE WHEN i IS NOT NULL THEN 'p' || CAST(i AS VARCHAR) END AS name, CASE i WHEN 0 THEN text WHEN 1 THEN lang END AS content
FROM (SELECT *, unnest(CASE WHEN doc_id % 6 = 0 OR doc_id % 8 = 0 THEN [NULL] ELSE [0, 1] END) AS i FROM documents)""")
def upload_restoration(spark, sf):
    """Sections saved as lines of JSON and restored for uploads; some have no line, some a broken one."""
    d = F.col("doc_id")
    docs = table(spark, sf, "documents").withColumn("hash", F.md5(d.cast("string").cast("binary")))
    parts = F.explode(F.array(F.struct(F.lit(0).alias("nth"), F.lit("p0").alias("name"), F.col("text").alias("content")), F.struct(F.lit(1).alias("nth"), F.lit("p1").alias("name"), F.col("lang").alias("content"))))
    sections = docs.filter(d % 6 != 0).select("hash", F.concat(d.cast("string"), F.lit(".txt")).alias("file_name"), parts.alias("s")).select("hash", "file_name", "s.*")
    lines = C.saved_extractions(sections).join(docs.select("hash", "doc_id"), "hash")
    lines = lines.select("hash", F.when(d % 8 == 0, "{broken").otherwise(F.col("line")).alias("line"))
    uploads = docs.select(F.concat(F.lit("s"), (d % 20).cast("string")).alias("session_id"), d.alias("file_id"), "hash")
    return C.restored_uploads(lines, uploads)


@query(f"""WITH {_N}, q AS (SELECT item_id AS query_id, unnest({TERMS_SQL.format('text')}) AS term FROM benchmark), post AS (SELECT node_id, term, count(*) AS tf FROM (SELECT node_id, unnest({_TOK.format('text')}) AS term FROM nodes) GROUP BY ALL),
s AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(tf) * 0.1, 6) DESC, node_id) AS rank FROM post JOIN q USING (term) GROUP BY query_id, node_id QUALIFY rank <= 4),
own AS (SELECT query_id, rank, n.node_id, n.doc_id, CASE WHEN n.node_id % 4 = 3 THEN '' ELSE n.section_id END AS section_id FROM s JOIN nodes n USING (node_id)), n2 AS (SELECT node_id, doc_id, CASE WHEN node_id % 4 = 3 THEN '' ELSE section_id END AS section_id, text FROM nodes),
w AS (SELECT doc_id, section_id, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS own FROM n2 WHERE doc_id <> 'src2' GROUP BY ALL), tot AS (SELECT a.doc_id, a.section_id, sum(b.own) AS total FROM w a JOIN w b ON a.doc_id = b.doc_id AND (b.section_id = a.section_id OR starts_with(b.section_id, a.section_id || '.')) GROUP BY ALL),
refs AS (SELECT query_id, doc_id, section_id, min(rank) AS first FROM own WHERE section_id <> '' GROUP BY ALL), k AS (SELECT query_id, doc_id, section_id, first, sum(total) OVER (PARTITION BY query_id ORDER BY first) AS upto FROM refs JOIN tot USING (doc_id, section_id)),
kept AS (SELECT * FROM k WHERE upto <= 12000), found AS (SELECT query_id, n.node_id, n.section_id, min(first) AS first FROM n2 n JOIN kept k ON n.doc_id = k.doc_id AND (n.section_id = k.section_id OR starts_with(n.section_id, k.section_id || '.')) GROUP BY ALL)
SELECT query_id, node_id, section_id, CAST(first AS INT) AS first, true AS whole FROM found UNION ALL SELECT query_id, node_id, section_id, CAST(rank AS INT), false FROM own WHERE query_id NOT IN (SELECT query_id FROM found)""")
def hierarchical_many_queries(spark, sf):
    n = nodes(spark, sf).withColumn("section_id", F.when(F.col("node_id") % 4 == 3, "").otherwise(F.col("section_id")))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    sections = S.rolled_up(n.filter("doc_id <> 'src2'").select("doc_id", "section_id", "text")).select("doc_id", "section_id", "total")
    return R.hierarchical_each(index_of(spark, sf).top_each(asked, 4), n, sections, budget=12_000)


@query(f"WITH {MAP['messages']} SELECT count(DISTINCT session_id) AS sessions FROM messages WHERE tenant_id = 't1'")
def session_count(spark, sf):
    return M.session_counts(messages(spark, sf).select("session_id", "tenant_id").distinct(), "t1")


@query("""WITH u AS (SELECT c_custkey AS nth, CASE WHEN c_nationkey % 5 > 0 THEN 'n' || CAST(c_nationkey AS VARCHAR) ELSE '' END AS t, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS name FROM customer), x AS (SELECT t AS tenant_id, coalesce(arg_min(coalesce(name, t), nth), t) AS display_name FROM u WHERE t <> '' GROUP BY t)
SELECT 0 AS nth, 'shared' AS tenant_id, 'Shared (All Tenants)' AS display_name UNION ALL SELECT CAST(row_number() OVER (ORDER BY tenant_id) AS INT), tenant_id, display_name FROM x""")
def tenants(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    own = F.when(F.col("c_nationkey") % 5 > 0, F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).otherwise("")
    return M.tenant_list(c.select(k.alias("nth"), own.alias("tenant_id"), F.when(k % 3 > 0, F.col("c_name")).alias("name")))


_CODES = "c AS (SELECT CASE WHEN s_nationkey = 7 THEN 'shared' ELSE 'n' || CAST(s_nationkey AS VARCHAR) END AS tenant_id, 'C' || CAST(s_suppkey AS VARCHAR) AS code, CASE WHEN s_nationkey % 4 = 1 AND s_suppkey % 2 = 0 THEN NULL ELSE s_name END AS description FROM supplier WHERE s_nationkey % 3 > 0)"


def _categories(spark, sf):
    s = table(spark, sf, "supplier").filter("s_nationkey % 3 > 0")
    n, k = F.col("s_nationkey"), F.col("s_suppkey")
    return s.select(F.when(n == 7, "shared").otherwise(F.concat(F.lit("n"), n.cast("string"))).alias("tenant_id"), F.concat(F.lit("C"), k.cast("string")).alias("code"), F.when(~((n % 4 == 1) & (k % 2 == 0)), F.col("s_name")).alias("description"))


@query(f"""WITH {_CODES}, t AS (SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS tenant_id FROM nation), v AS (SELECT tenant_id, bool_and(description IS NOT NULL) AS ok FROM c GROUP BY 1),
s AS (SELECT t.tenant_id, CASE WHEN coalesce(ok, false) THEN t.tenant_id ELSE 'shared' END AS source FROM t LEFT JOIN v USING (tenant_id)) SELECT s.tenant_id, CASE WHEN source = 'shared' THEN 'shared' ELSE 'tenant' END AS level, code, description FROM s JOIN c ON c.tenant_id = source
UNION ALL SELECT tenant_id, 'default', code, description FROM s, (VALUES ('A', 'first'), ('B', 'second')) d(code, description) WHERE source = 'shared' AND NOT EXISTS (SELECT 1 FROM c WHERE tenant_id = 'shared')""")
def form_categories(spark, sf):
    names = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("tenant_id"))
    return M.category_maps(names, _categories(spark, sf), {"A": "first", "B": "second"})


@query(f"WITH {_CODES} SELECT * FROM c WHERE tenant_id <> 'n5' UNION ALL SELECT 'n5', 'X' || CAST(n_nationkey AS VARCHAR), n_name FROM nation")
def categories_saved(spark, sf):
    n = table(spark, sf, "nation")
    return M.replaced_categories(_categories(spark, sf), "n5", n.select(F.concat(F.lit("X"), F.col("n_nationkey").cast("string")).alias("code"), F.col("n_name").alias("description")))


@query("""WITH m AS (SELECT conv_id AS session_id, count(*) AS n FROM conversations GROUP BY 1) SELECT session_id, CASE WHEN session_id % 3 = 0 THEN 't0' ELSE 't5' END AS tenant_id, CASE WHEN session_id % 3 = 0 THEN 'old' WHEN session_id % 2 = 0 THEN 'Imported Session' ELSE 'named' END AS title, CAST(CASE WHEN session_id % 3 = 0 OR session_id % 5 = 0 THEN 7 ELSE n END AS BIGINT) AS message_count, CAST(CASE WHEN session_id % 4 = 0 OR session_id % 3 = 0 THEN 100 ELSE 200 END AS BIGINT) AS last_active, CAST(CASE WHEN session_id % 3 = 0 THEN 0 ELSE n END AS BIGINT) AS messages FROM m""")
def sessions_imported(spark, sf):
    m, s = messages(spark, sf), F.col("session_id")
    old = m.select("session_id").distinct().filter("session_id % 3 = 0").select("session_id", F.lit("t0").alias("tenant_id"), F.lit("old").alias("title"), F.lit(50).cast("long").alias("created_at"), F.lit(100).cast("long").alias("last_active"), F.lit(7).cast("long").alias("message_count"))
    new = m.select("session_id").distinct().select("session_id", F.when(s % 2 == 1, "named").alias("title"), F.lit(100).cast("long").alias("created_at"), F.when(s % 4 != 0, 200).cast("long").alias("last_active"), F.when(s % 5 == 0, 7).cast("long").alias("message_count"))
    said = m.select("session_id", "id", F.when(F.col("id") % 2 == 0, F.col("role")).alias("role"), "content", F.lit(None).cast("long").alias("timestamp"))
    sessions, all_ = M.imported_sessions(old, said.limit(0), new, said, "t5")
    return sessions.join(all_.groupBy("session_id").agg(F.count("*").alias("messages")), "session_id", "left").select("session_id", "tenant_id", "title", "message_count", "last_active", F.coalesce("messages", F.lit(0)).alias("messages"))


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 100 AS INT) ELSE 0 END AS confidence_pct, CASE WHEN doc_id % 3 = 0 THEN 'hybrid' ELSE 'unknown' END AS retriever_type, 1 AS attempts, false AS was_refined, 'shared' AS tenant_id FROM documents WHERE doc_id % 7 > 0""")
def feedback_imported(spark, sf):
    d = F.col("doc_id")
    own = F.concat(F.lit('{"query": "'), d.cast("string"), F.lit('"'), F.when(d % 2 == 0, F.concat(F.lit(', "confidence_pct": '), (d % 100).cast("string"))).otherwise(""), F.when(d % 3 == 0, ', "retriever_type": "hybrid"').otherwise(""), F.when(d % 7 > 0, "}").otherwise(""))
    rows = M.imported_feedback(table(spark, sf, "documents").select(own.alias("value")))
    return rows.select(F.col("query").cast("long").alias("id"), "confidence_pct", "retriever_type", "attempts", "was_refined", "tenant_id")


@query("SELECT (SELECT count(*) > 0 FROM documents) AS nodes, (SELECT count(*) > 0 FROM embeddings) AS vectors, (SELECT count(*) > 0 FROM documents) AND (SELECT count(*) > 0 FROM embeddings) AS connected")
def store_connection(spark, sf):
    return M.connection(nodes(spark, sf), vectors(spark, sf))


@query("""SELECT o_orderkey AS job_id, o_orderstatus AS status, CAST(o_orderkey % 9 AS BIGINT) AS current, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_custkey AS BIGINT) END AS total_files, CASE WHEN o_orderkey % 4 > 0 THEN CASE WHEN o_orderkey % 4 = 1 THEN CAST(o_custkey // 2 AS BIGINT) ELSE 0 END END AS successful, CASE WHEN o_orderkey % 4 > 0 THEN CAST(0 AS BIGINT) END AS failed FROM orders""")
def job_summaries(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    total = F.create_map(F.lit("total_files"), c.cast("double"))
    report = F.when(k % 4 == 1, F.map_concat(total, F.create_map(F.lit("successful"), F.floor(c / 2).cast("double")))).when(k % 4 > 1, total)
    jobs = table(spark, sf, "orders").select(k.alias("job_id"), F.lit("t1").alias("tenant_id"), F.col("o_orderstatus").alias("status"), F.lit("sync").alias("mode"), F.lit("x").alias("phase"), (k % 9).cast("long").alias("current"), F.lit(9).alias("total"), F.lit(None).cast("string").alias("error"), report.alias("report"))
    return M.job_reports(jobs).select("job_id", "status", "progress.current", "report_summary.total_files", "report_summary.successful", "report_summary.failed")


@query(f"""WITH {_SUB}, n AS (SELECT query_id, rank, CASE WHEN max(score) OVER o > min(score) OVER o THEN (score - min(score) OVER o) / (max(score) OVER o - min(score) OVER o) ELSE 1.0 END AS s FROM fused WINDOW o AS (PARTITION BY query_id)),
c AS (SELECT query_id, CAST(floor(round(100 * (0.30 * avg(s) FILTER (rank <= 1) + 0.25 * avg(s) FILTER (rank <= 3) + 0.20 * avg(s) FILTER (rank <= 2) + 0.15 * (count(*) FILTER (rank <= 10 AND s > 0.7)) / least(count(*), 10) + 0.10 * least(count(*) / 10.0, 1.0)), 6)) AS INT) AS pct FROM n GROUP BY 1),
x AS (SELECT query_id, substr(string_agg(text, chr(10) || chr(10) ORDER BY rank), 1, 200) AS answer FROM fused JOIN nodes USING (node_id) WHERE rank <= 15 GROUP BY 1), p AS (SELECT q.query_id // 3 AS question, q.query_id % 3 AS nth, coalesce(pct, 0) AS pct, coalesce(answer, '') AS answer FROM q LEFT JOIN c USING (query_id) LEFT JOIN x USING (query_id)),
d AS (SELECT query_id // 3 AS question, doc_id, min(query_id % 3 * 1000 + rank) AS met FROM fused JOIN nodes USING (node_id) WHERE rank <= 10 GROUP BY ALL), s AS (SELECT question, string_agg(doc_id, '|' ORDER BY met) AS sources FROM d GROUP BY 1),
a AS (SELECT question, CAST(sum(pct) // count(*) AS INT) AS pct, min(pct) AS lo, string_agg(CASE WHEN pct < 60 THEN CAST(nth AS VARCHAR) END, ',' ORDER BY nth) AS weak, string_agg('--- part ' || CAST(nth AS VARCHAR) || CASE WHEN nth = 1 THEN ' (REGULATORY STANDARD)' ELSE '' END || ' ---' || chr(10) || answer, chr(10) || chr(10) ORDER BY nth) AS answers FROM p GROUP BY 1)
SELECT a.question AS query_id, answers, pct AS confidence_pct, CASE WHEN pct >= 80 AND lo >= 60 THEN 'HIGH' WHEN pct >= 60 THEN 'MEDIUM' ELSE 'LOW' END AS level, CASE WHEN NOT (pct >= 80 AND lo >= 60) AND pct >= 60 THEN coalesce(weak, '') ELSE '' END AS weak, coalesce(sources, '') AS sources FROM a LEFT JOIN s USING (question)""")
def orchestrated_questions(spark, sf):
    """Three benchmark items make the parts of a question, each with its own filters."""
    i = F.col("query_id")
    parts = _sub(spark, sf).withColumns({"label": F.concat(F.lit("part "), (i % 3).cast("string")), "nth": (i % 3).cast("int"), "is_standard": i % 3 == 1}).withColumn("query_id", F.floor(i / 3))
    whole = A.orchestrated(parts, nodes(spark, sf), vectors(spark, sf), index_of(spark, sf).table.read())[1]
    return whole.select("query_id", "answers", "confidence_pct", "level", "weak", F.array_join("sources", "|").alias("sources"))


@query("""SELECT conv_id AS query_id, turn AS id, nth, part FROM (SELECT conv_id, turn, unnest(p) AS part, CAST(generate_subscripts(p, 1) - 1 AS INT) AS nth FROM (SELECT conv_id, turn, CASE WHEN len(x) > 0 THEN x[1:4] ELSE [text] END AS p FROM (SELECT conv_id, turn, text, list_filter(list_transform(string_split(text, '?'), lambda x: trim(x)), lambda x: x <> '') AS x FROM conversations)))""")
def question_parts(spark, sf):
    c = table(spark, sf, "conversations")
    parts = A.by_rules(c.select(F.struct("conv_id", "turn").alias("query_id"), "text"))
    return parts.select(F.col("query_id.conv_id").alias("query_id"), F.col("query_id.turn").alias("id"), "nth", F.col("text").alias("part"))

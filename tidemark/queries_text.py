"""Registered queries: texts and sections, payloads, plans, and retrieval for many questions, each with the same computation in SQL."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import retrieval as R
from .operators import sections as S
from .indexes import QUESTION, TERMS_SQL, index_of
from .session import nodes, stored, table, vectors
from .session import SQL as MAP

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


_N = MAP["nodes"]
_TOK = "regexp_extract_all(lower({}), '[\\\\p{{L}}\\\\p{{N}}]+')"


def _tok(x):
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+')"


# many questions at once: embeddings whose id is divisible by 50, with the words of that node's title
_MANY = f"""{_N}, q AS (SELECT vec_id AS query_id, embedding AS e, CASE WHEN vec_id % 100 = 0 THEN 't1' END AS tenant FROM embeddings WHERE vec_id % 50 = 0),
t AS (SELECT query_id, unnest({TERMS_SQL.format("title")}) AS term FROM q JOIN nodes ON node_id = query_id),
post AS (SELECT node_id, tenant_id, term, count(*) AS tf FROM (SELECT node_id, tenant_id, unnest({_tok("text")}) AS term FROM nodes) GROUP BY ALL),
kw AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, node_id) AS w FROM (SELECT query_id, node_id, round(sum(tf) * 0.1, 6) AS s FROM post JOIN t USING (term) JOIN q USING (query_id) WHERE tenant IS NULL OR tenant_id IN (tenant, 'shared') GROUP BY ALL) QUALIFY w <= 20),
vec AS (SELECT query_id, vec_id AS node_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) DESC, vec_id) AS v FROM embeddings JOIN nodes ON node_id = vec_id, q WHERE tenant IS NULL OR tenant_id IN (tenant, 'shared') QUALIFY v <= 20),
f AS (SELECT query_id, node_id, v, w, round(coalesce(1.0::DOUBLE / (60 + v), 0) + coalesce(1.0::DOUBLE / (60 + w), 0), 9) AS score FROM vec FULL JOIN kw USING (query_id, node_id)),
fused AS (SELECT query_id, node_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, v ASC NULLS LAST, w ASC NULLS LAST) AS INT) AS rank FROM f QUALIFY rank <= 20)"""


def _many(spark, sf):
    """Nodes, vectors, and the stated set of questions: embeddings whose id is divisible by 50, with the title of that node."""
    n, own = nodes(spark, sf), table(spark, sf, "embeddings").filter("vec_id % 50 = 0")
    tenant = F.when(F.col("vec_id") % 100 == 0, "t1").alias("tenant")
    asked = R.few(own).join(n.select(F.col("node_id").alias("vec_id"), F.col("title").alias("text")), "vec_id").select(F.col("vec_id").alias("query_id"), "text", F.col("embedding").alias("vector"), tenant)
    return n, vectors(spark, sf), stored(asked, "asked"), 20, index_of(spark, sf).table.read()


@query(f"WITH {_MANY} SELECT * FROM fused")
def hybrid_many_queries(spark, sf):
    return R.hybrid_each(*_many(spark, sf))


@query(f"""WITH {_MANY}, n AS (SELECT query_id, rank, CASE WHEN max(score) OVER o > min(score) OVER o THEN (score - min(score) OVER o) / (max(score) OVER o - min(score) OVER o) ELSE 1.0 END AS s FROM fused WINDOW o AS (PARTITION BY query_id)),
c AS (SELECT query_id, 0.30 * avg(s) FILTER (rank <= 1) + 0.25 * avg(s) FILTER (rank <= 3) + 0.20 * avg(s) FILTER (rank <= 2) + 0.15 * (count(*) FILTER (rank <= 10 AND s > 0.7)) / least(count(*), 10) + 0.10 * least(count(*) / 10.0, 1.0) AS v FROM n GROUP BY 1),
p AS (SELECT query_id, CAST(floor(round(v * 100, 6)) AS INT) AS confidence_pct FROM c) SELECT query_id, confidence_pct, CASE WHEN confidence_pct >= 75 THEN 'HIGH' WHEN confidence_pct >= 55 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM p""")
def confidence_many_queries(spark, sf):
    return R.confidence(R.hybrid_each(*_many(spark, sf)), by="query_id")


@query(f"""WITH {_MANY}, a AS (SELECT query_id, list(node_id) AS x FROM vec GROUP BY 1), b AS (SELECT query_id, list(node_id) AS y FROM fused GROUP BY 1)
SELECT query_id, CASE WHEN len(coalesce(x, [])) > 0 THEN len(list_intersect(x, coalesce(y, []))) / len(x) ELSE 1.0 END AS recall, CASE WHEN len(list_distinct(list_concat(coalesce(x, []), coalesce(y, [])))) > 0 THEN len(list_intersect(coalesce(x, []), coalesce(y, []))) / len(list_distinct(list_concat(coalesce(x, []), coalesce(y, [])))) ELSE 1.0 END AS jaccard FROM a FULL JOIN b USING (query_id)""")
def recall_many_queries(spark, sf):
    n, v, asked, k, counted = _many(spark, sf)
    by_vectors = stored(R.vector_top_each(n, v, asked, k), "vectors")
    return R.recall(R.hybrid_each(n, v, asked, k, counted, by_vectors), by_vectors)


_SEC = """sec AS (SELECT source AS doc_id, CASE WHEN doc_id % 10 = 0 THEN '1' ELSE '1.' || CAST(doc_id % 10 AS VARCHAR) END AS section_id, text FROM documents),
wd AS (SELECT doc_id, section_id, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS own FROM sec GROUP BY ALL),
tot AS (SELECT a.doc_id, a.section_id, sum(b.own) AS total FROM wd a JOIN wd b ON a.doc_id = b.doc_id AND (b.section_id = a.section_id OR starts_with(b.section_id, a.section_id || '.')) GROUP BY ALL)"""
_FIRST = f"""{_N}, {_SEC}, kw AS (SELECT node_id, CAST(row_number() OVER (ORDER BY round(len(list_filter({_tok("text")}, lambda t: t IN ('the', 'and', 'of'))) * 0.1, 6) DESC, node_id) AS INT) AS rank FROM nodes WHERE len(list_filter({_tok("text")}, lambda t: t IN ('the', 'and', 'of'))) > 0 QUALIFY rank <= 10),
refs AS (SELECT doc_id, section_id, min(rank) AS first FROM kw JOIN nodes USING (node_id) GROUP BY ALL)"""


@query(f"WITH {_FIRST} SELECT doc_id, section_id, first FROM refs")
def section_references(spark, sf):
    n = nodes(spark, sf)
    return R.section_refs(index_of(spark, sf).top(QUESTION, 10), n)


@query(f"""WITH {_FIRST}, k AS (SELECT doc_id, section_id, first, row_number() OVER (ORDER BY first) AS nth, sum(total) OVER (ORDER BY first) AS upto FROM refs JOIN tot USING (doc_id, section_id)),
kept AS (SELECT * FROM k WHERE nth <= 10 AND upto <= 50000) SELECT n.node_id, n.section_id, min(first) AS first FROM nodes n JOIN kept k ON n.doc_id = k.doc_id AND (n.section_id = k.section_id OR starts_with(n.section_id, k.section_id || '.')) GROUP BY ALL""")
def hierarchical_retrieval(spark, sf):
    n = nodes(spark, sf)
    return R.hierarchical(index_of(spark, sf).top(QUESTION, 10), n, S.rolled_up(n.select("doc_id", "section_id", "text")).select("doc_id", "section_id", "total"))


@query("""WITH s AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS rank, length(text) AS size FROM conversations), u AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY rank) AS upto FROM s WHERE rank <= 4)
SELECT conv_id, rank, CAST(size AS INT) AS size, CAST(upto AS BIGINT) AS upto FROM u WHERE upto <= 500""")
def budget_cut(spark, sf):
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    sizes = table(spark, sf, "conversations").select("conv_id", nth.alias("rank"), F.length("text").alias("size"))
    return R.within_budget(sizes, 500, 4, "conv_id")


_Q7 = "q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7), sim AS (SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS s FROM embeddings, q)"


def _seven(spark, sf):
    return table(spark, sf, "embeddings").filter("vec_id = 7").first()["embedding"]


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id < 50), r AS (SELECT query_id, vec_id AS node_id, vec_id AS was, round(0.7 * round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) + 0.3 * ((vec_id % 10) / 10), 7) AS score FROM embeddings JOIN q ON query_id = vec_id % 50)
SELECT query_id, node_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, was) AS INT) AS rank FROM r""")
def cached_rescoring(spark, sf):
    """Fifty cached lists, each against a vector of its own."""
    e, i = table(spark, sf, "embeddings"), F.col("vec_id")
    old = e.select((i % 50).alias("query_id"), i.alias("node_id"), (i % 10 / 10).alias("score"), i.alias("rank"))
    return R.blended(old, vectors(spark, sf), e.filter("vec_id < 50").select(i.alias("query_id"), F.col("embedding").alias("vector")))


@query(f"WITH {_Q7}, u AS (SELECT vec_id AS node_id, round(s * 1.5, 6) AS score, CAST(row_number() OVER (ORDER BY s DESC, vec_id) AS INT) AS rank FROM sim WHERE vec_id % 3 = 0 QUALIFY rank <= 10) SELECT * FROM u")
def upload_search(spark, sf):
    own = table(spark, sf, "embeddings").filter("vec_id % 3 = 0").select(F.col("vec_id").alias("node_id"), F.lit("shared").alias("tenant_id"))
    return R.vector_top(own, vectors(spark, sf), _seven(spark, sf), 10, factor=1.5)


@query(f"""WITH {_N}, c AS (SELECT node_id AS cid, md5(trim(regexp_replace(substr(text, 1, 500), '\\s+', ' ', 'g'))) AS h, doc_id, section_id FROM nodes WHERE node_id % 2 = 0), byh AS (SELECT h, min(cid) AS c1 FROM c GROUP BY 1), bys AS (SELECT doc_id, section_id, min(cid) AS c2 FROM c GROUP BY ALL)
SELECT node_id, coalesce(c1, c2) AS cached FROM (SELECT *, md5(trim(regexp_replace(substr(text, 1, 500), '\\s+', ' ', 'g'))) AS h FROM nodes) LEFT JOIN byh USING (h) LEFT JOIN bys USING (doc_id, section_id)""")
def cached_embeddings(spark, sf):
    n = nodes(spark, sf)
    return R.attached(n, n.filter("node_id % 2 = 0"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang WHEN 1 THEN source WHEN 2 THEN 'doc' ELSE '' END AS text, CASE WHEN doc_id % 4 = 1 THEN 'source,text' WHEN doc_id % 4 = 2 THEN 'document,source,text' ELSE 'source' END AS keys FROM documents""")
def payloads(spark, sf):
    d = F.col("doc_id")
    base = F.create_map(F.lit("source"), F.col("source"), F.lit("_node_content"), F.when(d % 4 == 0, F.concat(F.lit('{"text": "'), "lang", F.lit('"}'))).otherwise("{}"), F.lit("_node_type"), F.lit("t"), F.lit("doc_id"), F.lit("x"))
    more = F.when(d % 4 == 1, F.map_concat(base, F.create_map(F.lit("text"), F.col("source")))).when(d % 4 == 2, F.map_concat(base, F.create_map(F.lit("text"), F.lit(""), F.lit("document"), F.lit("doc")))).otherwise(base)
    rows = table(spark, sf, "documents").select("doc_id", more.alias("payload"))
    return rows.select("doc_id", T.payload_text(F.col("payload")).alias("text"), F.array_join(F.array_sort(F.map_keys(F.filter(F.array(T.own_metadata(F.col("payload"))), lambda m: m.isNotNull())[0])), ",").alias("keys"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'own' ELSE source END AS source, CASE WHEN doc_id % 3 = 2 THEN 's9' ELSE 's' || CAST(doc_id AS VARCHAR) END AS section_id FROM documents")
def node_rows(spark, sf):
    d = F.col("doc_id")
    raw = F.when(d % 3 == 0, '{"source": "own"}').when(d % 3 == 1, F.lit(None)).otherwise('{"section_id": "s9"}')
    meta = T.node_metadata(raw, F.col("source"), F.concat(F.lit("s"), d.cast("string")))
    return table(spark, sf, "documents").select("doc_id", meta["source"].alias("source"), meta["section_id"].alias("section_id"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'one' ELSE 'one, three' END AS sections, 'A > ' || source AS hierarchy, CASE WHEN doc_id % 3 = 0 THEN lang ELSE 'topic' END AS topic FROM documents""")
def extraction_metadata(spark, sf):
    d = F.col("doc_id")
    one = lambda n, c: F.struct(F.lit(n).cast("string").alias("name"), c.alias("content"))
    parts = F.array(one("one", F.lit("x")), one("two", F.lit("  ")), one("three", F.when(d % 2 == 1, "y")), one(None, F.lit("z")))
    base = T.base_metadata(F.when(d % 3 == 0, "").otherwise("topic"), F.col("lang"), F.array(F.lit("A"), F.col("source")), T.kept_sections(parts))
    return table(spark, sf, "documents").select("doc_id", base.alias("b")).select("doc_id", "b.sections", "b.hierarchy", "b.topic")


@query(f"""WITH {_N}, r AS (SELECT node_id % 40 AS query_id, row_number() OVER (PARTITION BY node_id % 40 ORDER BY node_id) AS rank, 'FORMS: ' || doc_id || ', x' || CAST(node_id % 5 AS VARCHAR) || '| REGS: ' || doc_type AS refs FROM nodes),
p AS (SELECT query_id, rank, unnest(string_split(refs, '|')) AS x, generate_subscripts(string_split(refs, '|'), 1) AS i FROM r WHERE rank <= 3), y AS (SELECT query_id, rank, i, unnest(string_split(x, ',')) AS y, generate_subscripts(string_split(x, ','), 1) AS j FROM p),
z AS (SELECT query_id, trim(regexp_extract(y, '([^:]*)$', 1)) AS ref, min(rank * 100 + i * 10 + j) AS met FROM y GROUP BY ALL) SELECT query_id, ref, CAST(row_number() OVER (PARTITION BY query_id ORDER BY met) AS INT) AS place FROM z WHERE ref <> '' QUALIFY place <= 7""")
def referenced_documents(spark, sf):
    refs = F.concat(F.lit("FORMS: "), "doc_id", F.lit(", x"), (F.col("node_id") % 5).cast("string"), F.lit("| REGS: "), "doc_type")
    nth = F.row_number().over(Window.partitionBy(F.col("node_id") % 40).orderBy("node_id"))
    return R.references_of(nodes(spark, sf).select((F.col("node_id") % 40).alias("query_id"), nth.alias("rank"), refs.alias("references")), most=7)


@query("""WITH p AS (SELECT conv_id, turn, CAST((turn * 37 + conv_id * 11) % 101 AS INT) AS pct FROM conversations), a AS (SELECT conv_id, CAST(sum(pct) // count(*) AS INT) AS confidence_pct, min(pct) AS lo, string_agg(CASE WHEN pct < 60 THEN CAST(turn AS VARCHAR) END, ',' ORDER BY turn) AS weak FROM p GROUP BY 1)
SELECT conv_id, confidence_pct, CASE WHEN confidence_pct >= 80 AND lo >= 60 THEN 'HIGH' WHEN confidence_pct >= 60 THEN 'MEDIUM' ELSE 'LOW' END AS level, CASE WHEN NOT (confidence_pct >= 80 AND lo >= 60) AND confidence_pct >= 60 THEN coalesce(weak, '') ELSE '' END AS weak FROM a""")
def answer_confidence(spark, sf):
    parts = table(spark, sf, "conversations").select("conv_id", "turn", ((F.col("turn") * 37 + F.col("conv_id") * 11) % 101).cast("int").alias("pct"))
    return R.overall_confidence(parts, "conv_id", "turn")


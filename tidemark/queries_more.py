"""Registered queries: reports, uploads, plans, texts and section boundaries, each with the same computation in SQL."""

from pyspark.sql import functions as F

from .functions import language as L
from .functions import text as T
from .operators import conversations as C
from .operators import dml as D
from .operators import library as B
from .operators import sections as S
from .plans import answer as A
from .session import QUERY_TYPES, feedback, messages, nodes, stored, table
from .session import SQL as MAP

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def pick(values, i):
    """One of some constants, by a number modulo their count."""
    return F.element_at(F.array(*[F.lit(x).cast("string") for x in values]), (i % len(values) + 1).cast("int"))


_N = MAP["nodes"]
_WORDS = "len(list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> ''))"
_H, _I, _HI, _LO = "feedback = 'helpful'", "feedback = 'incorrect'", "confidence_pct >= 75", "confidence_pct < 60"


def _n(a):
    return f"count(*) FILTER ({a})"


def _share(a, of):
    return f"round(100 * {_n(a)} / CAST(greatest({of}, 1) AS DOUBLE), 4)"


_REPORT = f"""WITH {MAP['feedback']}, report AS (SELECT count(*) AS total, {_share(_H, 'count(*)')} AS satisfaction, {_share(_I, 'count(*)')} AS incorrect,
 {_n(f'{_HI} AND {_H}')} AS high_helpful, {_n(f'{_HI} AND {_I}')} AS high_incorrect, {_n(f'{_LO} AND {_H}')} AS low_helpful, {_n(f'{_LO} AND {_I}')} AS low_incorrect,
 {_share(f'{_HI} AND {_I}', _n(f'{_HI} AND {_H}') + ' + ' + _n(f'{_HI} AND {_I}'))} AS overconfident, {_share(f'{_LO} AND {_H}', _n(f'{_LO} AND {_H}') + ' + ' + _n(f'{_LO} AND {_I}'))} AS underconfident,
 {_n('was_refined')} AS refined, {_share(f'was_refined AND {_H}', _n('was_refined'))} AS refined_helpful FROM feedback)"""


@query(f"{_REPORT} SELECT * FROM report")
def feedback_analytics(spark, sf):
    return B.feedback_report(feedback(spark, sf))


@query(f"""{_REPORT}, l AS (SELECT list_filter([CASE WHEN overconfident > 20 THEN 'raise_high_threshold' END, CASE WHEN underconfident > 30 THEN 'lower_high_threshold' END,
 CASE WHEN refined_helpful < 50 AND refined > 5 THEN 'disable_refinement' END, CASE WHEN incorrect > 15 THEN 'review_errors' END], lambda x: x IS NOT NULL) AS x FROM report) SELECT CAST(generate_subscripts(x, 1) - 1 AS INT) AS nth, unnest(x) AS recommendation FROM l""")
def feedback_recommendations(spark, sf):
    return B.recommendations(B.feedback_report(feedback(spark, sf)))


@query(f"""WITH {_N}, f AS (SELECT node_id, doc_id || '-' || CAST(node_id % 40 AS VARCHAR) AS doc_id, upper(doc_type) AS doc_type, CASE WHEN node_id % 3 <> 0 THEN 'a ' || CAST(node_id % 9 AS VARCHAR) END AS code,
 CASE WHEN node_id % 7 = 0 THEN '' WHEN node_id % 5 = 0 THEN 'A' || CAST(node_id % 9 AS VARCHAR) || 'x - ' || title WHEN node_id % 5 = 1 THEN 'my - A' || CAST(node_id % 9 AS VARCHAR) ELSE title END AS title FROM nodes),
o AS (SELECT doc_type, doc_id, arg_min(CASE WHEN title = '' THEN doc_id ELSE title END, node_id) AS title, arg_min(coalesce(code, ''), node_id) AS code FROM f GROUP BY ALL),
t AS (SELECT doc_type, doc_id, CASE WHEN doc_type = 'FORM' AND code <> '' AND NOT starts_with(upper(replace(trim(split_part(title, '-', 1)), ' ', '')), upper(replace(code, ' ', ''))) THEN code || ' - ' || title ELSE title END AS title FROM o)
SELECT doc_type, doc_id, title, CAST(row_number() OVER (PARTITION BY doc_type ORDER BY title, doc_id) AS INT) AS nth FROM t""")
def documents_by_type(spark, sf):
    i = F.col("node_id")
    s = (i % 9).cast("string")
    title = F.when(i % 7 == 0, "").when(i % 5 == 0, F.concat(F.lit("A"), s, F.lit("x - "), "title")).when(i % 5 == 1, F.concat(F.lit("my - A"), s)).otherwise(F.col("title"))
    code = F.when(i % 3 != 0, F.concat(F.lit("a "), s))
    return B.grouped_by_type(nodes(spark, sf).select("node_id", F.concat("doc_id", F.lit("-"), (i % 40).cast("string")).alias("doc_id"), "doc_type", title.alias("title"), code.alias("form_number")))


@query("""WITH s AS (SELECT CASE quality WHEN 1 THEN 'success' WHEN 0 THEN 'failed' ELSE 'pending' END AS a, CASE WHEN toxic = 1 THEN 'warning' ELSE 'success' END AS b FROM documents LEFT JOIN labels USING (doc_id))
SELECT CASE WHEN 'failed' IN (a, b) THEN 'failed' WHEN 'warning' IN (a, b) THEN 'warning' WHEN a = 'success' AND b = 'success' THEN 'success' ELSE 'pending' END AS status, count(*) AS n FROM s GROUP BY 1""")
def processing_report(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    a = F.when(F.col("quality") == 1, "success").when(F.col("quality") == 0, "failed").otherwise("pending")
    return B.status_counts(rows, F.array(a, F.when(F.col("toxic") == 1, "warning").otherwise("success")))


_EXTRACTED = """e AS (SELECT d.doc_id AS name, CASE doc_id % 6 WHEN 0 THEN 'Form' WHEN 1 THEN 'CHECKLIST' WHEN 2 THEN NULL ELSE 'POLICY' END AS doc_type, CASE WHEN doc_id % 21 < 20 THEN (doc_id % 21) / 20.0::DOUBLE END AS coverage,
 CASE doc_id % 8 WHEN 0 THEN 'Low Coverage found' WHEN 1 THEN 'bad' WHEN 2 THEN '' END AS error FROM documents d WHERE doc_id % 11 <> 0),
s AS (SELECT doc_id AS name, sid, CASE sid WHEN '1' THEN w ELSE w // 2 END AS tokens FROM (SELECT doc_id, """ + _WORDS.format("text") + """ AS w, unnest(['1', '1.1', '2']) AS sid FROM documents WHERE doc_id % 9 <> 0)), x AS (SELECT doc_id AS name, text FROM documents WHERE doc_id % 10 <> 0)"""


def _inspected(spark, sf):
    """files, sections with tokens, extractions and cached texts of the documents, each with some left out."""
    d, docs = F.col("doc_id"), table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    kind = F.when(d % 6 == 0, "Form").when(d % 6 == 1, "CHECKLIST").when(d % 6 > 2, "POLICY")
    error = F.when(d % 8 == 0, "Low Coverage found").when(d % 8 == 1, "bad").when(d % 8 == 2, "")
    extracted = docs.filter("doc_id % 11 <> 0").select(d.alias("name"), kind.alias("doc_type"), F.when(d % 21 < 20, (d % 21) / 20).alias("coverage"), error.alias("validation_error"))
    w = F.size(T.split_words(F.col("text")))
    ids = F.explode(F.array(*[F.lit(x) for x in ("1", "1.1", "2")])).alias("section_id")
    sections = docs.filter("doc_id % 9 <> 0").select(d.alias("name"), w.alias("w"), ids).select("name", "section_id", F.when(F.col("section_id") == "1", F.col("w")).otherwise(F.floor(F.col("w") / 2)).alias("tokens"))
    return docs.select(d.alias("name"), F.col("n_chars").alias("size")), sections, extracted, docs.filter("doc_id % 10 <> 0").select(d.alias("name"), "text")


@query(f"""WITH {_EXTRACTED}, p AS (SELECT d.doc_id AS name, concat_ws(',', (SELECT string_agg('mega_section ' || sid, ',' ORDER BY sid) FROM s WHERE s.name = d.doc_id AND tokens > 1000),
 CASE WHEN d.doc_id % 9 = 0 THEN 'no_tree' END, CASE WHEN e.name IS NULL THEN 'no_extraction' END, CASE WHEN e.name IS NOT NULL AND NOT coalesce(upper(e.doc_type) IN ('FORM', 'CHECKLIST'), false) AND coalesce(coverage, 0) < 0.85 THEN 'low_coverage' END,
 CASE WHEN error <> '' AND NOT (coalesce(upper(e.doc_type) IN ('FORM', 'CHECKLIST'), false) AND contains(lower(error), 'coverage')) THEN 'validation_error' END, CASE WHEN NOT EXISTS (SELECT 1 FROM x WHERE x.name = d.doc_id AND text <> '') THEN 'no_text' END) AS problems
 FROM documents d LEFT JOIN e ON e.name = d.doc_id) SELECT name, problems FROM p WHERE problems <> ''""")
def problem_documents(spark, sf):
    files, sections, extracted, texts = _inspected(spark, sf)
    return B.problem_documents(files, sections, extracted, texts, 1000)


@query(f"""WITH {_EXTRACTED} SELECT d.doc_id AS name, n_chars AS size, coalesce(length(x.text), 0) AS length, CASE WHEN d.doc_id % 9 <> 0 THEN 2 ELSE 0 END AS sections, d.doc_id % 4 AS chunks, coalesce(coverage, CASE WHEN e.name IS NOT NULL THEN 0.5 END, 0) AS coverage,
 CASE WHEN e.name IS NULL OR d.doc_id % 9 = 0 OR coalesce(x.text, '') = '' THEN 'failed' WHEN NOT coalesce(upper(e.doc_type) IN ('FORM', 'CHECKLIST'), false) AND coalesce(coverage, 0.5) < 0.85 THEN 'low' ELSE 'ok' END AS status
 FROM documents d LEFT JOIN e ON e.name = d.doc_id LEFT JOIN x ON x.name = d.doc_id""")
def document_metrics(spark, sf):
    files, sections, extracted, texts = _inspected(spark, sf)
    chunks = files.select("name", F.explode(F.sequence(F.lit(0), (F.col("name") % 4).cast("int"))).alias("i")).filter("i > 0")
    extracted = extracted.select("name", "doc_type", F.col("coverage").alias("ngram_coverage"), F.lit(0.5).alias("word_coverage"))
    return B.document_metrics(files, texts, sections, chunks, extracted)


@query(f"WITH {_N} SELECT doc_id, count(*) AS nodes, arg_max(title, node_id) AS title, count(DISTINCT section_id) AS sections, CASE WHEN count(*) > 0 THEN 'sync' ELSE 'rebuild' END AS mode FROM nodes WHERE tenant_id IN ('t3', 'shared') GROUP BY 1")
def documents_of_tenant(spark, sf):
    return B.document_rows(nodes(spark, sf).filter(F.col("tenant_id").isin("t3", "shared")))


@query("SELECT 't' || CAST(user_id AS VARCHAR) AS tenant_id, CASE WHEN user_id BETWEEN 1 AND 3 THEN 'sync' ELSE 'rebuild' END AS mode FROM (SELECT DISTINCT user_id FROM events)")
def processing_modes(spark, sf):
    """Of tenants named by users, those that have nodes are synced."""
    tenants = table(spark, sf, "events").select(F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("tenant_id")).distinct()
    return B.processing_mode(tenants, nodes(spark, sf))


@query("""SELECT doc_id AS name, CASE WHEN doc_id % 4 = 0 THEN 'fixed' ELSE lang END AS title, CASE WHEN doc_id % 4 = 1 THEN NULL ELSE 'FORM' END AS doc_type, source AS form_number, CASE WHEN doc_id % 3 = 0 THEN 'cat' WHEN doc_id % 4 = 2 THEN 'moved' ELSE lang END AS form_category_name,
 doc_id % 4 < 3 AS has_corrections, coalesce(CASE WHEN doc_id % 5 > 0 THEN 't1' END, 't9') AS owner, CAST(doc_id % 3 AS INT) AS section_count FROM documents""")
def effective_metadata(spark, sf):
    d = F.col("doc_id")
    one = lambda k, v: F.create_map(F.lit(k), F.lit(v).cast("string"))
    fixes = F.when(d % 4 == 0, one("title", "fixed")).when(d % 4 == 1, one("doc_type", None)).when(d % 4 == 2, one("category", "moved"))
    sections = F.when(d % 3 > 0, F.array_repeat(F.lit("s"), (d % 3).cast("int")))
    rows = table(spark, sf, "documents").select(d.alias("name"), F.when(d % 5 > 0, "t1").alias("tenant_id"), fixes.alias("corrections"), sections.alias("sections"), F.col("lang").alias("title"), F.lit("FORM").alias("doc_type"), F.col("source").alias("form_number"), F.when(d % 3 == 0, "cat").otherwise("").alias("form_category_name"), F.col("lang").alias("category"))
    return B.effective_metadata(rows, "t9").drop("corrections")


@query(f"""WITH {_N}, a AS (SELECT 'n' || CAST(node_id AS VARCHAR) AS k, 'upload' AS origin FROM nodes WHERE node_id % 3 = 0),
b AS (SELECT CASE WHEN node_id % 10 > 0 THEN 'n' || CAST(node_id AS VARCHAR) WHEN node_id % 20 > 0 THEN doc_id END AS k, node_id, 'library' AS origin FROM nodes WHERE node_id % 2 = 0),
c AS (SELECT *, row_number() OVER (PARTITION BY k) AS r FROM b WHERE k IS NOT NULL AND k NOT IN (SELECT k FROM a))
SELECT origin, k AS key, CAST(count(*) AS BIGINT) AS n FROM (SELECT origin, k FROM a UNION ALL SELECT origin, k FROM c WHERE r = 1 UNION ALL SELECT origin, NULL FROM b WHERE k IS NULL) GROUP BY ALL""")
def uploads_first(spark, sf):
    i, n = F.col("node_id"), nodes(spark, sf)
    name = F.concat(F.lit("n"), i.cast("string"))
    uploads = n.filter(i % 3 == 0).select(F.when(i % 2 == 0, name).alias("upload_chunk_id"), name.alias("node_id"), "doc_id", F.lit("upload").alias("origin"))
    library = n.filter(i % 2 == 0).select(F.when(i % 10 > 0, name).otherwise("").alias("node_id"), F.when(i % 20 > 0, F.col("doc_id")).alias("doc_id"), F.lit("library").alias("origin"))
    rows = C.first_sight(uploads, library, keys=["upload_chunk_id", "node_id", "doc_id"])
    key = F.coalesce("upload_chunk_id", F.nullif("node_id", F.lit("")), "doc_id")
    return rows.groupBy("origin", key.alias("key")).agg(F.count("*").alias("n"))


@query(f"""WITH {MAP['messages']}, b AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS back FROM messages QUALIFY back <= 3)
SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY id) AS INT) AS nth, role, CASE WHEN back = 1 AND session_id % 4 = 0 THEN content WHEN back = 1 THEN substr(content, 1, 60) ELSE substr(content, 1, 30) END AS content FROM b""")
def conversation_history(spark, sf):
    return C.history(messages(spark, sf), 3, 30, 60, F.col("session_id") % 4 == 0)


@query(f"WITH {MAP['messages']} SELECT session_id, id, CAST((row_number() OVER (PARTITION BY session_id ORDER BY id) - 1) // 2 + 1 AS INT) AS question FROM messages")
def question_numbers(spark, sf):
    return C.numbered_questions(messages(spark, sf)).select("session_id", "id", "question")


@query("SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN lang END AS a, CASE WHEN doc_id % 2 = 0 THEN 'changed' WHEN doc_id % 5 > 0 THEN source END AS b, CASE WHEN doc_id % 2 = 0 THEN 'added' END AS c FROM documents")
def metadata_merge(spark, sf):
    d = table(spark, sf, "documents")
    old = d.select("doc_id", F.when(F.col("doc_id") % 5 > 0, F.create_map(F.lit("a"), "lang", F.lit("b"), "source")).alias("metadata"))
    changes = d.filter("doc_id % 2 = 0").select("doc_id", F.create_map(F.lit("b"), F.lit("changed"), F.lit("c"), F.lit("added")).alias("changes"))
    return D.merge_metadata(old, changes, "doc_id").select("doc_id", *[F.try_element_at("metadata", F.lit(k)).alias(k) for k in "abc"])


#: Questions that the rules tell apart; every second conversation asks them, the others keep their own words.
QUESTIONS = [
    "hello there", "Good morning", "howdy", "see you", "take care", "which form is it?", "is this information current", "show me the check list for departure", "how to launch a lifeboat in an emergency",
    "what does chapter 4 say about drills?", "is there a user guide for the gyro compass", "our policy on visitors in port areas", "which requirement covers maintenance of alarms", "when is the next inspection of the pump room due",
    "company rules for shore leave", "what are hazards of cargo", "internal audit dates please now", "the convention on load lines says what", "how are you", "yo", "what's going on", "tell me more details about that",
    "please elaborate on the second point", "my favourite colour is blue", "where is the chief engineer today", "can you explain the second answer again", "could you sing a song?", "it rained all day long and everyone stayed in", "the port state asked us",
]
_ASKED = f"""asked AS (SELECT conv_id, turn, lower(trim(CASE WHEN conv_id % 2 = 0 THEN ([{", ".join("'" + q.replace("'", "''") + "'" for q in QUESTIONS)}])[CAST((conv_id + turn) % {len(QUESTIONS)} AS INT) + 1] ELSE text END)) AS t FROM conversations), w AS (SELECT *, {_WORDS.format("t")} AS n FROM asked)"""


def _asked(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.when(F.col("conv_id") % 2 == 0, pick(QUESTIONS, F.col("conv_id") + F.col("turn"))).otherwise(F.col("text")).alias("text"))


def _any(words):
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


_RULES = {
    "company": ["our company", "our policy", "our procedure", "company policy"],
    "regulatory": ["marpol", "solas", "imo", "mlc", "stcw", "regulation", "annex", "chapter"],
    "safety": ["emergency", "drill", "fire", "abandon", "lifeboat", "evacuation", "alarm"],
    "operational": ["operation", "procedure", "checklist", "maintenance", "inspection"],
}
_TYPES = {"Form": ["form"], "Checklist": ["checklist", "check list"], "Procedure": ["procedure", "how to", "steps"], "Policy": ["policy", "policies"], "Manual": ["manual", "guide"], "Regulation": ["regulation", "requirement"]}


@query(f"""WITH {_ASKED} SELECT conv_id, turn, CASE {" ".join(f"WHEN {_any(v)} THEN '{k}'" for k, v in _RULES.items())} ELSE 'general' END AS scope, CASE {" ".join(f"WHEN {_any(v)} THEN '{k}'" for k, v in _TYPES.items())} END AS preference,
 CASE WHEN t IN ('hi', 'hello', 'hey', 'good morning', 'good afternoon', 'good evening', 'howdy', 'hey there') OR (n <= 2 AND NOT contains(t, '?')) THEN 'greeting' WHEN t IN ('bye', 'goodbye', 'see you', 'take care') THEN 'goodbye' ELSE 'new_query' END AS intent FROM w""")
def question_rules(spark, sf):
    t = F.col("text")
    return _asked(spark, sf).select("conv_id", "turn", L.scope(t).alias("scope"), L.type_preference(t).alias("preference"), L.intent(t).alias("intent"))


@query(f"""WITH {_ASKED} SELECT conv_id, turn, CASE WHEN t IN ({", ".join("'" + x.replace("'", "''") + "'" for x in L.SMALL_TALK)}) OR n <= 3 THEN 'greeting' WHEN contains(t, 'what do you mean') OR contains(t, 'can you explain') OR contains(t, 'i don''t understand') OR contains(t, 'unclear') OR contains(t, 'elaborate') OR contains(t, 'more details') THEN 'clarification'
 WHEN {_any(L.MARITIME)} OR contains(t, '?') OR n > 5 THEN 'new_query' ELSE 'chitchat' END AS intent FROM w""")
def question_intents(spark, sf):
    return _asked(spark, sf).select("conv_id", "turn", L.heuristic_intent(F.col("text")).alias("intent"))


_UP = """up AS (SELECT 's' || CAST(doc_id % 9 AS VARCHAR) AS session_id, 'n' || CAST(doc_id % 20 AS VARCHAR) || CASE WHEN doc_id % 27 < 5 THEN ' (1).txt' ELSE '.txt' END AS name, doc_id AS ord, n_chars AS size, md5(CASE WHEN doc_id % 4 = 0 THEN 'same' ELSE text END) AS digest FROM documents),
fresh AS (SELECT session_id, name, size, digest, min(ord) AS ord FROM up GROUP BY ALL), capped AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ord) AS r FROM fresh QUALIFY r <= 50)"""


def _uploads(spark, sf):
    d, s = F.col("doc_id"), lambda n: (F.col("doc_id") % n).cast("string")
    name = F.concat(F.lit("n"), s(20), F.when(d % 27 < 5, " (1).txt").otherwise(".txt"))
    digest = F.md5(F.when(d % 4 == 0, "same").otherwise(F.col("text")).cast("binary"))
    return table(spark, sf, "documents").select(F.concat(F.lit("s"), s(9)).alias("session_id"), name.alias("name"), F.col("n_chars").alias("size"), d.alias("ord"), digest.alias("digest"))


@query(f"""WITH RECURSIVE {_UP}, fold(session_id, r, shown) AS (SELECT session_id, 0, CAST([] AS VARCHAR[]) FROM (SELECT DISTINCT session_id FROM capped) UNION ALL
SELECT c.session_id, s.r + 1, list_append(s.shown, list_filter(list_prepend(c.name, list_transform(range(1, 51), lambda i: replace(c.name, '.txt', ' (' || CAST(i AS VARCHAR) || ').txt'))), lambda x: NOT list_contains(s.shown, x))[1]) FROM fold s JOIN capped c ON c.session_id = s.session_id AND c.r = s.r + 1)
SELECT c.session_id, c.ord, s.shown[c.r] AS display_name FROM capped c JOIN fold s ON c.session_id = s.session_id AND c.r = s.r""")
def upload_addition(spark, sf):
    return C.add_uploads(_uploads(spark, sf)).select("session_id", "ord", "display_name")


@query(f"WITH {_UP} SELECT session_id, ord FROM capped WHERE session_id <> 's3' AND NOT (session_id = 's5' AND name = 'n5.txt')")
def upload_deletion(spark, sf):
    rows = C.add_uploads(_uploads(spark, sf))
    rows = D.delete_where(rows, (F.col("session_id") == "s5") & (F.col("name") == "n5.txt"))
    return D.delete_where(rows, F.col("session_id") == "s3").select("session_id", "ord")


@query(f"""WITH {MAP['feedback']} SELECT id, feedback, CASE WHEN id % 3 > 0 THEN confidence_pct ELSE 0 END AS confidence_pct, '' AS confidence_level, CASE WHEN id % 4 > 0 THEN CAST(id % 4 AS INT) ELSE 0 END AS num_sources, CASE WHEN id % 5 > 1 THEN 'hybrid' ELSE 'unknown' END AS retriever_type,
 CASE WHEN id % 2 = 0 THEN 'x' ELSE '' END AS correction, CASE WHEN id % 6 > 0 THEN CAST(id % 6 AS INT) ELSE 1 END AS attempts, coalesce(id % 7 > 0 AND was_refined, false) AS was_refined, CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS sources, CAST(row_number() OVER (ORDER BY created_at DESC, id) AS INT) AS nth
 FROM feedback WHERE tenant_id = 't1' QUALIFY nth <= 100""")
def feedback_listing(spark, sf):
    i = F.col("id")
    rows = feedback(spark, sf).withColumns({
        "confidence_pct": F.when(i % 3 > 0, F.col("confidence_pct")), "confidence_level": F.lit(None).cast("string"), "num_sources": F.when(i % 4 > 0, (i % 4).cast("int")), "retriever_type": F.when(i % 5 > 1, "hybrid").when(i % 5 == 1, ""),
        "correction": F.when(i % 2 == 0, "x"), "attempts": F.when(i % 2 == 0, (i % 6).cast("int")).when(i % 6 > 0, (i % 6).cast("int")), "was_refined": F.when(i % 7 > 0, F.col("was_refined")), "top_sources": F.when(i % 2 == 0, F.array(F.lit("s"))),
    })
    got = C.feedback_list(rows, 100, "t1")
    return got.select("id", "feedback", "confidence_pct", "confidence_level", "num_sources", "retriever_type", "correction", "attempts", "was_refined", F.size("top_sources").alias("sources"), "nth")


_NAMES = ["3.1 Use of", "12. Scope of it", "A. Parts list", "A guide to ships", "4x", "B."]


@query("""WITH d AS (SELECT doc_id, (['3.1 Use of', '12. Scope of it', 'A. Parts list', 'A guide to ships', '4x', 'B.'])[CAST(doc_id % 6 AS INT) + 1] AS name, CASE doc_id % 4 WHEN 0 THEN ' ' || text WHEN 1 THEN '' END AS fs, CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN '' END AS su FROM documents)
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '3.1' WHEN 1 THEN '12' END AS prefix, CASE WHEN fs <> '' THEN nullif(substr(trim(fs), 1, 200), '') WHEN su <> '' THEN nullif(substr(trim(su), 1, 200), '') ELSE CASE doc_id % 6 WHEN 0 THEN 'Use of' WHEN 1 THEN '. Scope of it' WHEN 2 THEN 'Parts list' WHEN 3 THEN 'A guide to ships' END END AS anchor FROM d""")
def section_anchors(spark, sf):
    d = F.col("doc_id")
    first = F.when(d % 4 == 0, F.concat(F.lit(" "), "text")).when(d % 4 == 1, "")
    summary = F.when(d % 5 == 0, F.col("text")).when(d % 5 == 1, "")
    return table(spark, sf, "documents").select("doc_id", T.section_prefix(pick(_NAMES, d)).alias("prefix"), T.anchor(first, summary, pick(_NAMES, d)).alias("anchor"))


def _refs_sql(label, letter, n, most):
    return f"CASE WHEN doc_id % {n} > 0 THEN '{label}: ' || array_to_string(list_transform(range(0, least(doc_id % {n}, {most})), lambda i: '{letter}' || CAST(i AS VARCHAR)), ', ') END"


@query(f"""SELECT doc_id, concat_ws('| ', {_refs_sql("FORMS", "F", 8, 5)}, {_refs_sql("REGS", "R", 5, 3)}, {_refs_sql("PROCS", "P", 6, 3)}, {_refs_sql("POLICIES", "O", 4, 3)}, {_refs_sql("REPORTS", "T", 7, 3)}, {_refs_sql("CHAPTERS", "C", 9, 3)}, {_refs_sql("SECTIONS", "S", 10, 5)}) AS refs,
'Title: ' || lang || chr(10) || 'Type: FORM' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'Form: F' || CAST(doc_id AS VARCHAR) || chr(10) ELSE '' END || 'Hierarchy: A > ' || source || chr(10) || 'Section: s' || chr(10) || '---' AS header FROM documents""")
def chunk_headers(spark, sf):
    d = F.col("doc_id")
    many = lambda letter, n: F.transform(F.slice(F.sequence(F.lit(0), (d % n).cast("int")), F.lit(1), (d % n).cast("int")), lambda i: F.concat(F.lit(letter), i.cast("string")))
    kinds = {"forms": many("F", 8), "regulations": many("R", 5), "procedures": many("P", 6), "policies": many("O", 4), "reports": many("T", 7), "chapters": many("C", 9), "sections": many("S", 10)}
    header = T.chunk_header(F.col("lang"), F.lit("FORM"), F.lit("s"), F.when(d % 2 == 0, F.concat(F.lit("F"), d.cast("string"))), F.array_join(F.array(F.lit("A"), F.col("source")), " > "))
    return table(spark, sf, "documents").select("doc_id", T.references_line(**kinds).alias("refs"), header.alias("header"))


@query("""WITH d AS (SELECT doc_id, lang, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'ab 1' END AS code, CASE doc_id % 7 WHEN 0 THEN 'AB1x - ' || text WHEN 1 THEN 'My - AB1' WHEN 2 THEN 'a b 1' ELSE substr(text, 1, 50) END AS title FROM documents)
SELECT doc_id, CASE WHEN coalesce(code, '') = '' OR starts_with(upper(replace(trim(split_part(title, '-', 1)), ' ', '')), 'AB1') THEN title ELSE code || ' - ' || title END AS title, strftime(make_timestamp(CAST(doc_id * 86461000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S') AS at, upper(substr(lang, 1, 1)) || lower(substr(lang, 2)) || ' Of It' AS upload FROM d""")
def titles_and_times(spark, sf):
    d = F.col("doc_id")
    code = F.when(d % 5 == 0, "").when(d % 5 > 1, "ab 1")
    title = F.when(d % 7 == 0, F.concat(F.lit("AB1x - "), "text")).when(d % 7 == 1, "My - AB1").when(d % 7 == 2, "a b 1").otherwise(F.substring("text", 1, 50))
    return table(spark, sf, "documents").select("doc_id", T.form_title(code, title).alias("title"), T.iso_time(d * 86461).alias("at"), T.upload_title(F.concat("lang", F.lit("_of_it.txt"))).alias("upload"))


@query("""SELECT doc_id, '| :--- | ---: | --- |' || chr(10) || ' | ' || CASE WHEN doc_id % 300 + 1 > 200 THEN 'xxx' ELSE repeat('x', CAST(doc_id % 300 + 1 AS INT)) END || ' | ' || replace(replace(text, '|', '/'), chr(10), ' ') || ' |' || chr(10) || 'prose ' || repeat('-', 60) || ' x | ----- |' AS rows FROM documents""")
def table_rows(spark, sf):
    wide = F.repeat(F.lit("x"), (F.col("doc_id") % 300 + 1).cast("int"))
    own = F.replace(F.replace("text", F.lit("|"), F.lit("/")), F.lit("\n"), F.lit(" "))
    text = F.concat(F.lit("|:-------|----:| ----- |\n | "), wide, F.lit(" | "), own, F.lit(" |\nprose " + "-" * 60 + " x | ----- |"))
    return table(spark, sf, "documents").select("doc_id", T.markdown_rows(text).alias("rows"))


@query("""WITH p AS (SELECT doc_id, lang, doc_id % 2 = 0 AS context, (['Greeting', ' chitchat', 'nonsense', 'follow_up', NULL, 'action_on_previous', 'clarification'])[CAST(doc_id % 7 AS INT) + 1] AS i, (['broad', 'TOO_BROAD', 'x'])[CAST(doc_id % 3 AS INT) + 1] AS s, (['multi_part', 'Compliance', 'simple', NULL, 'content_generation'])[CAST(doc_id % 5 AS INT) + 1] AS t FROM documents),
r AS (SELECT *, CASE WHEN i = 'Greeting' THEN 'greeting' WHEN i = ' chitchat' THEN 'off_topic' WHEN context AND i IN ('follow_up', 'clarification') THEN 'follow_up_same' WHEN context AND i = 'action_on_previous' THEN i ELSE 'new_query' END AS intent, coalesce(t IN ('multi_part', 'Compliance', 'content_generation') AND s <> 'TOO_BROAD', false) AS parts FROM p)
SELECT doc_id, intent, CASE s WHEN 'broad' THEN 'broad' WHEN 'TOO_BROAD' THEN 'too_broad' ELSE 'focused' END AS scope, parts, CASE t WHEN 'multi_part' THEN 'synthesize' WHEN 'Compliance' THEN 'compliance' WHEN 'content_generation' THEN 'generative' ELSE 'direct' END AS merge,
CASE WHEN t IN ('Compliance', 'content_generation') AND parts THEN 'filtered_parallel' WHEN doc_id % 4 = 1 THEN 'section' WHEN doc_id % 4 = 2 THEN 'filtered_parallel' ELSE 'chunk' END AS strategy, doc_id % 6 IN (1, 5) AS regulatory,
CASE WHEN doc_id % 3 = 0 THEN lang WHEN context AND intent IN ('follow_up_same', 'action_on_previous') THEN 'before' END AS topic, CASE WHEN doc_id % 100 >= 80 THEN 'direct' WHEN doc_id % 100 >= 60 THEN 'hedged' ELSE 'cautious' END AS tone FROM r""")
def plan_values(spark, sf):
    d = F.col("doc_id")
    scope, kind = L.one_of(pick(["broad", "TOO_BROAD", "x"], d), L.PLAN_SCOPES), L.one_of(pick(["multi_part", "Compliance", "simple", None, "content_generation"], d), L.QUERY_TYPES)
    strategy = L.one_of(pick(["chunk_level", "Section_Level", "filtered_parallel", "x"], d), L.STRATEGIES, L.STRATEGY_ALIASES)
    intent = L.plan_intent(pick(["Greeting", " chitchat", "nonsense", "follow_up", None, "action_on_previous", "clarification"], d), d % 2 == 0)
    parts, types = L.needs_parts(kind, scope), F.array(F.lit("FORM"), pick(["Form", "regulation", "POLICY", "Manual", "x", "vetting"], d))
    return table(spark, sf, "documents").select(
        "doc_id", intent.alias("intent"), scope.alias("scope"), parts.alias("parts"), L.merge_strategy(kind).alias("merge"), L.strategy_of(strategy, kind, parts).alias("strategy"), L.is_regulatory(types).alias("regulatory"),
        L.topic_of(F.when(d % 3 == 0, F.col("lang")).when(d % 3 == 1, ""), intent, d % 2 == 0, F.lit("before")).alias("topic"), L.answer_tone(d % 100).alias("tone"),
    )


@query("""SELECT conv_id, string_agg('--- ' || role || CASE WHEN turn % 2 = 0 THEN ' (REGULATORY STANDARD)' ELSE '' END || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS answers,
 CASE WHEN conv_id % 4 = 0 THEN 'generative' WHEN conv_id % 4 = 2 AND bool_or(turn % 2 = 0) THEN 'gap_analysis' WHEN conv_id % 4 = 2 THEN 'comparison' ELSE 'multi_part' END AS prompt FROM conversations GROUP BY 1""")
def answer_blocks(spark, sf):
    c = table(spark, sf, "conversations")
    parts = c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("nth"), F.col("role").alias("label"), "text", (F.col("turn") % 2 == 0).alias("is_standard"))
    merge = pick(["generative", "synthesize", "compliance", "direct"], F.col("query_id"))
    return A.joined_answers(parts).select(F.col("query_id").alias("conv_id"), "answers", L.prompt_kind(merge, F.col("has_standard")).alias("prompt"))


@query("""SELECT doc_id, doc_id % 3 = 0 AS has_table FROM documents""")
def table_detection(spark, sf):
    d = F.col("doc_id")
    text = F.concat(F.replace("text", F.lit("|"), F.lit("/")), F.when(d % 3 == 0, "\n| a | b |\n|---|:--:|\n| 1 | 2 |").when(d % 3 == 1, "\n| a | b |\ntext").otherwise("\na | b\n| c |\n| d |"))
    return table(spark, sf, "documents").select("doc_id", T.has_table(text).alias("has_table"))


@query("""SELECT doc_id, 'a' || lang AS text, CASE WHEN doc_id % 2 = 0 THEN 'sub-query' ELSE 'own' END AS label, CASE doc_id % 3 WHEN 0 THEN 'FORM,POLICY' WHEN 1 THEN 'VETTING,CIRCULAR' END AS types, doc_id % 4 = 1 AS is_standard FROM documents WHERE doc_id % 5 > 0""")
def sub_queries(spark, sf):
    d = F.col("doc_id")
    types = F.when(d % 3 == 0, '["form", "poem", "POLICY"]').when(d % 3 == 1, '["Vetting", "circular"]').otherwise('["poem"]')
    one = F.concat(F.lit('{"text": " a'), "lang", F.lit(' ", "source_label": "'), F.when(d % 2 == 0, "").otherwise(" own "), F.lit('", "doc_type_filter": '), types, F.when(d % 4 == 1, ', "is_standard": true').otherwise(""), F.lit("}"))
    raw = F.when(d % 5 == 0, "broken").otherwise(F.concat(F.lit("["), one, F.lit(', {"text": "  "}]')))
    rows = table(spark, sf, "documents").select("doc_id", F.explode(L.valid_parts(raw, QUERY_TYPES)).alias("p"))
    return rows.select("doc_id", "p.text", "p.label", F.array_join("p.types", ",").alias("types"), "p.is_standard")


@query("""WITH c AS (SELECT source AS doc_id, lang AS section_id, CAST(length(lang) AS INT) AS level, doc_id AS nth, CASE WHEN doc_id % 3 = 0 THEN 'Document: x' || chr(10) || '---' || chr(10) || text ELSE text END AS raw, text FROM documents)
SELECT doc_id, section_id, chr(10) || repeat('  ', level - 1) || repeat('#', level + 1) || ' ' || section_id || '. T' || chr(10) || repeat('  ', level - 1) || '[Source: ' || doc_id || ', Section ' || section_id || ']' || chr(10) || chr(10)
 || string_agg(repeat('  ', level - 1) || CASE WHEN starts_with(raw, 'Document: x') OR NOT contains(raw, chr(10) || '---' || chr(10)) THEN text ELSE substr(text, instr(text, chr(10) || '---' || chr(10)) + 5) END || chr(10), chr(10) ORDER BY nth) AS text FROM c GROUP BY doc_id, section_id, level""")
def sections_as_markdown(spark, sf):
    d = F.col("doc_id")
    text = F.when(d % 3 == 0, F.concat(F.lit("Document: x\n---\n"), "text")).otherwise(F.col("text"))
    return S.as_markdown(table(spark, sf, "documents").select(F.col("source").alias("doc_id"), F.col("lang").alias("section_id"), F.lit("T").alias("title"), F.length("lang").alias("level"), d.alias("nth"), text.alias("text")))


# numbered sections and one without a number, with a table of contents before them, made of each whole document
_BODY = r"""b AS (SELECT doc_id, regexp_replace(text, '[0-9A-Z\n.]', 'x', 'g') AS body FROM documents), t AS (SELECT doc_id, 'Contents' || chr(10) || '1 One' || chr(10) || '2 Two' || chr(10) || '2.1 Sub' || chr(10) AS toc, '1 One' || chr(10) || body || repeat('y', 600) || chr(10) AS s1, '2 Two' || chr(10) || 'ab' || chr(10) AS s2,
 '2.1 Sub' || chr(10) || 'The anchr hree ' || body || chr(10) AS s3, 'Anex of Trms and Notes' || chr(10) || body AS s4 FROM b)"""


def _texts(spark, sf):
    body = F.regexp_replace("text", r"[0-9A-Z\n.]", "x")
    text = F.concat(F.lit("Contents\n1 One\n2 Two\n2.1 Sub\n1 One\n"), body, F.lit("y" * 600), F.lit("\n2 Two\nab\n2.1 Sub\nThe anchr hree "), body, F.lit("\nAnex of Trms and Notes\n"), body)
    return table(spark, sf, "documents").select("doc_id", text.alias("text"))


def _outline(spark, sf):
    """Four sections that the texts have; every third document is said to have five more."""
    rows = [(0, "1 One", None), (1, "2 Two", None), (2, "2.1 Sub", "the  anchor here"), (3, "Annex of Terms and Notes", None)]
    one = lambda o, n, a: F.struct(F.lit(o).alias("ord"), F.lit(n).alias("name"), F.lit(a).cast("string").alias("first"))
    more = [one(4 + i, f"Zz{i} Qq{i} Vv{i} Jj{i} Kk{i}", None) for i in range(5)]
    known = F.concat(F.array(*[one(*r) for r in rows]), F.when(F.col("doc_id") % 3 == 0, F.array(*more)).otherwise(F.array().cast("array<struct<ord:int,name:string,first:string>>")))
    s = table(spark, sf, "documents").select("doc_id", F.explode(known).alias("s")).select("doc_id", "s.*")
    return s.select("doc_id", "ord", "name", T.section_prefix(F.col("name")).alias("prefix"), T.anchor(F.col("first"), F.lit(None).cast("string"), F.col("name")).alias("anchor"))


@query(f"WITH {_BODY} SELECT doc_id, CAST(1 AS BIGINT) AS toc_start, CAST(length(toc) + 1 AS BIGINT) AS toc_end FROM t")
def contents_range(spark, sf):
    texts = _texts(spark, sf)
    return S.contents_end(texts, S.lines_of(texts))


@query(f"WITH {_BODY} SELECT doc_id, 0 AS ord, length(toc) + 1 AS start FROM t UNION ALL SELECT doc_id, 1, length(toc) + length(s1) + 1 FROM t UNION ALL SELECT doc_id, 2, length(toc) + length(s1) + length(s2) + 1 FROM t UNION ALL SELECT doc_id, 3, length(toc) + length(s1) + length(s2) + length(s3) + 1 FROM t")
def section_positions(spark, sf):
    texts = _texts(spark, sf)
    lines = S.lines_of(texts)
    return S.located(texts, _outline(spark, sf), stored(S.contents_end(texts, lines), "contents"), lines=lines)


@query(rf"""WITH {_BODY}, c AS (SELECT doc_id, substr(regexp_replace(s1, '\s+$', ''), 7) AS c1, substr(regexp_replace(s3, '\s+$', ''), 9) AS c3, regexp_replace(s4, '\s+$', '') AS c4 FROM t)
SELECT doc_id, 0 AS ord, '1' AS section_id, '1 One' AS name, c1 AS content FROM c UNION ALL SELECT doc_id, 2, '2.1', '2 Two: 2.1 Sub', c3 FROM c WHERE length(trim(c3)) >= 80 UNION ALL SELECT doc_id, 3, 'Annex of Terms and Notes', 'Annex of Terms and Notes', c4 FROM c WHERE length(trim(c4)) >= 80""")
def boundary_sections(spark, sf):
    return S.by_boundaries(_texts(spark, sf), _outline(spark, sf))[0]


@query("SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 THEN 9 ELSE 4 END AS BIGINT) AS expected, CAST(CASE WHEN doc_id % 3 = 0 THEN 5 ELSE 0 END AS BIGINT) AS missing, CASE WHEN doc_id % 3 = 0 THEN 'Failed to extract 5/9 sections' END AS error FROM documents")
def section_failures(spark, sf):
    return S.by_boundaries(_texts(spark, sf), _outline(spark, sf))[1]


@query(r"""WITH l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS n FROM (SELECT doc_id, string_split(regexp_replace(text, '[.,] ', chr(10), 'g'), chr(10)) AS x FROM documents)),
r AS (SELECT *, coalesce(line = lag(line) OVER w AND line = lag(line, 2) OVER w AND line = lag(line, 3) OVER w, false) AS again FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY n)) SELECT doc_id, string_agg(line, ',' ORDER BY n) AS lines FROM r WHERE NOT again GROUP BY 1""")
def repeated_lines(spark, sf):
    lines = F.split(F.regexp_replace("text", "[.,] ", "\n"), "\n", -1)
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.limit_repeats(lines), ",").alias("lines"))

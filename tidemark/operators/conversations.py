"""Sessions and messages."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def session_list(messages: DataFrame, tenant: str, n: int) -> DataFrame:
    """A tenant's sessions with their message counts, those with the latest message first."""
    per = messages.filter(F.col("tenant_id") == tenant).groupBy("session_id").agg(F.count("*").alias("messages"), F.max("id").alias("last"))
    return per.orderBy(F.desc("last"), F.desc("session_id")).limit(n)


def history(messages: DataFrame, turns: int = 5, preview: int = 1000, last_preview: int = 2000, whole_last=None) -> DataFrame:
    """The last messages of each session, numbered, cut to a preview that is longer for the last. Where `whole_last` holds (a question
    that acts on the last answer) the last message is whole."""
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("id")))
    rows = messages.withColumn("back", back).filter(F.col("back") <= turns)
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy("id"))
    last = F.col("back") == 1
    whole = F.lit(False) if whole_last is None else last & F.coalesce(whole_last, F.lit(False))
    cut = F.when(whole, F.col("content")).when(last, F.substring("content", 1, last_preview)).otherwise(F.substring("content", 1, preview))
    return rows.select("session_id", nth.alias("nth"), "role", cut.alias("content"))


def first_sight(*parts: DataFrame, keys: list[str]) -> DataFrame:
    """The union of parts, of equal keys the row of the earliest part. A row's key is the first of `keys` that it has (neither null
    nor empty); a row that has none is like no other."""
    rows = None
    for i, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(i))
        rows = p if rows is None else rows.unionByName(p, allowMissingColumns=True)
    key = F.coalesce(*[F.nullif(F.col(k).cast("string"), F.lit("")) for k in keys])
    rows = rows.withColumn("_key", key)
    first = F.row_number().over(Window.partitionBy("_key").orderBy("_part"))
    own = rows.filter("_key IS NOT NULL").withColumn("_n", first).filter("_n = 1").drop("_n")
    return own.unionByName(rows.filter("_key IS NULL")).drop("_part", "_key")


def numbered_questions(messages: DataFrame) -> DataFrame:
    """messages with the number of the question that each belongs to: two messages a question."""
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy("id"))
    return messages.withColumn("question", (F.floor((nth - 1) / 2) + 1).cast("int"))


def turn_counts(messages: DataFrame, most: int = 6) -> DataFrame:
    """session_id, id, turn: user turns counted from 1, starting again after `most`."""
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy("id"))
    return messages.filter(F.col("role") == "user").select("session_id", "id", ((nth - 1) % most + 1).alias("turn"))


def owned(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Messages of sessions that the tenant owns."""
    return messages.join(sessions.select("session_id", "tenant_id"), ["session_id", "tenant_id"], "left_semi")


def added(messages: DataFrame, new: DataFrame) -> DataFrame:
    """messages and those of new whose session belongs to their tenant."""
    own = messages.select("session_id", "tenant_id").distinct()
    return messages.unionByName(new.join(own, ["session_id", "tenant_id"], "left_semi").select(*messages.columns))


def counters(messages: DataFrame) -> DataFrame:
    """session_id, message_count, last_active: what a session's row says of its messages."""
    return messages.groupBy("session_id").agg(F.count("*").alias("message_count"), F.max("id").alias("last_active"))


def flattened(messages: DataFrame, keys: list[str]) -> DataFrame:
    """messages(metadata map) in order with the metadata's keys as columns, over columns of that name."""
    kept = [c for c in messages.columns if c not in ("metadata", *keys)]
    return messages.select(*kept, *[F.try_element_at("metadata", F.lit(k)).alias(k) for k in keys]).orderBy("session_id", "id")


def latest_context(messages: DataFrame) -> DataFrame:
    """session_id, id, context: of each session the last message of the assistant that has a context."""
    own = messages.filter((F.col("role") == "assistant") & F.col("context").isNotNull())
    return own.groupBy("session_id").agg(F.max("id").alias("id"), F.max_by("context", "id").alias("context"))


def restored(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_id, found, score: chunks named by a saved context; those still there count 0.8."""
    there = wanted.join(nodes.select("node_id", F.lit(True).alias("there")), "node_id", "left")
    found = F.coalesce("there", F.lit(False))
    return there.select("node_id", found.alias("found"), F.when(found, F.lit(0.8)).alias("score"))


#: What stands for absent values of a feedback record (fixed values); false, zero and empty count as absent.
FEEDBACK = {"confidence_pct": 0, "confidence_level": "", "num_sources": 0, "retriever_type": "unknown", "correction": "", "attempts": 1, "was_refined": False}


def feedback_list(feedback: DataFrame, n: int, tenant: str | None = None) -> DataFrame:
    """A tenant's latest n records (of all tenants without one), with defaults for what is not there."""
    rows = feedback if tenant is None else feedback.filter(F.col("tenant_id") == tenant)
    order = [F.desc("created_at"), F.asc("id")]
    nth = F.row_number().over(Window.orderBy(*order))  # n rows
    rows = rows.orderBy(*order).limit(n).withColumn("nth", nth)
    one = lambda c, v: F.when(F.col(c).isNull() | (F.col(c) == type(v)()), F.lit(v)).otherwise(F.col(c))
    out = rows.withColumns({c: one(c, v) for c, v in FEEDBACK.items() if c in rows.columns})
    return out.withColumn("top_sources", F.coalesce("top_sources", F.array().cast("array<string>"))) if "top_sources" in rows.columns else out


def with_top_sources(answers: DataFrame, n: int = 3) -> DataFrame:
    """answers(sources) with the names of the first n (source, else title, else unknown; an empty one is a name) and how many there are."""
    name = lambda s: F.coalesce(s["source"], s["title"], F.lit("unknown"))
    return answers.withColumn("top_sources", F.slice(F.transform("sources", name), 1, n)).withColumn("num_sources", F.size("sources"))


def add_uploads(uploads: DataFrame, most: int = 50) -> DataFrame:
    """uploads(session_id, name, size, digest, ord) as they are kept: of equal name, size and digest the first, `most` a session, each
    shown under its name or, where that is shown already, the first free of `name (1).txt`, `name (2).txt` and so on."""
    fresh = uploads.groupBy("session_id", "name", "size", "digest").agg(F.min("ord").alias("ord"))
    capped = fresh.withColumn("_n", F.row_number().over(Window.partitionBy("session_id").orderBy("ord"))).filter(F.col("_n") <= most).drop("_n")
    rows = F.array_sort(F.collect_list(F.struct("ord", "name", "size", "digest")))  # `most` of a session
    ext = lambda x: F.regexp_extract(x, r"^\.*[^.].*(\.[^.]*)$", 1)
    numbered = lambda x, i: F.concat(F.substring(x, F.lit(1), F.length(x) - F.length(ext(x))), F.lit(" ("), i.cast("string"), F.lit(")"), ext(x))

    def show(shown, r):
        more = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda i: numbered(r["name"], i))
        free = F.get(F.filter(F.concat(F.array(r["name"]), more), lambda x: ~F.array_contains(shown, x)), F.lit(0))
        return F.concat(shown, F.array(free))

    per = capped.groupBy("session_id").agg(rows.alias("rows")).withColumn("shown", F.aggregate("rows", F.array().cast("array<string>"), show))
    out = per.select("session_id", F.explode(F.arrays_zip("rows", "shown")).alias("r"))
    return out.select("session_id", "r.rows.name", "r.rows.size", "r.rows.digest", "r.rows.ord", F.col("r.shown").alias("display_name"))


def numbered_chunks(uploads: DataFrame) -> DataFrame:
    """uploads(digest, chunks) by chunk: chunk_id is `digest:nth`."""
    rest = [c for c in uploads.columns if c != "chunks"]
    rows = uploads.select(*rest, F.posexplode("chunks").alias("nth", "chunk"))
    return rows.withColumn("chunk_id", F.concat_ws(":", "digest", F.col("nth").cast("string")))


def with_snapshot(messages: DataFrame, kept: int = 40) -> DataFrame:
    """messages(role, topic, scope, turn, chunks) with what an answer of the assistant saves for going on later: topic, scope, turn and
    the first chunk ids; null for other messages."""
    state = F.struct("topic", "scope", F.col("turn").alias("turn_count"), F.slice("chunks", 1, kept).alias("cached_chunk_ids"))
    return messages.withColumn("context", F.when(F.col("role") == "assistant", state))


def switched(messages: DataFrame, nodes: DataFrame) -> DataFrame:
    """session_id, topic, scope, turn_count, node_ids, found, missing: what sessions go on with, from the last saved context of each; its
    chunks as far as nodes still has them."""
    last = latest_context(messages).select("session_id", "context.*")
    rows = last.select("session_id", F.explode("cached_chunk_ids").alias("node_id"))
    held = rows.join(nodes.select("node_id", F.lit(True).alias("there")), "node_id", "left")
    per = held.groupBy("session_id").agg(F.array_sort(F.collect_list(F.when(F.col("there"), F.col("node_id")))).alias("node_ids"), F.count_if("there").alias("found"), F.count_if(F.col("there").isNull()).alias("missing"))
    none = F.array().cast(per.schema["node_ids"].dataType)
    out = last.drop("cached_chunk_ids").join(per, "session_id", "left")
    return out.withColumns({"node_ids": F.coalesce("node_ids", none), "found": F.coalesce("found", F.lit(0)), "missing": F.coalesce("missing", F.lit(0))})


def saved_extractions(sections: DataFrame) -> DataFrame:
    """hash, line: the sections(hash, file_name, nth, name, content) of each uploaded file as one line of JSON with their number."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("nth", "name", "content"))), lambda x: F.struct(x["name"].alias("name"), x["content"].alias("content")))  # of one file
    per = sections.groupBy("hash").agg(F.min("file_name").alias("file_name"), parts.alias("sections"))
    return per.select("hash", F.to_json(F.struct("hash", "file_name", F.size("sections").alias("doc_count"), "sections")).alias("line"))


def restored_uploads(lines: DataFrame, uploads: DataFrame) -> DataFrame:
    """session_id, file_id, nth, name, content of the sections that saved lines(hash, line) hold of uploads(session_id, file_id, hash); one row
    without a section for an upload that has no line, or a broken one: it has failed."""
    kind = "struct<sections:array<struct<name:string,content:string>>>"
    both = uploads.join(lines.select("hash", F.from_json("line", kind).alias("r")), "hash", "left")
    return both.select("session_id", "file_id", F.posexplode_outer("r.sections").alias("nth", "s")).select("session_id", "file_id", "nth", "s.name", "s.content")

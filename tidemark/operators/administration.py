"""Tenants, categories, imports of older stores, and what is there to connect to."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARED = "shared"
#: Where a tenant's categories come from.
LEVELS = ["tenant", SHARED, "default"]


def session_counts(sessions: DataFrame, tenant: str | None = None) -> DataFrame:
    """sessions: how many a tenant has, or all."""
    rows = sessions if tenant is None else sessions.filter(F.col("tenant_id") == tenant)
    return rows.agg(F.count("*").alias("sessions"))


def tenant_list(users: DataFrame) -> DataFrame:
    """nth, tenant_id, display_name of the tenants that users(nth, tenant_id, name) belong to: shared first, then by id, each under its first
    user's name (its id without one)."""
    named = users.filter("tenant_id <> ''").groupBy("tenant_id").agg(F.min_by(F.struct("name"), "nth").alias("u")).select("tenant_id", F.coalesce("u.name", "tenant_id").alias("display_name"))
    shared = users.sparkSession.createDataFrame([(SHARED, "Shared (All Tenants)", 0)], "tenant_id string, display_name string, part int")
    rows = shared.unionByName(named.withColumn("part", F.lit(1)))
    ordered = F.array_sort(F.collect_list(F.struct("part", "tenant_id", "display_name")))  # a library's tenants
    return rows.agg(ordered.alias("t")).select(F.posexplode("t").alias("nth", "t")).select("nth", "t.tenant_id", "t.display_name")


def category_maps(tenants: DataFrame, stored: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """tenant_id, level, code, description for each of tenants(tenant_id): its own categories if it has any and all are valid (none
    without a code or a description), else the shared ones, else the defaults (code: description). stored(tenant_id, code, description)."""
    whole = F.count_if(F.col("code").isNull() | F.col("description").isNull()) == 0
    held = stored.groupBy("tenant_id").agg(whole.alias("valid"))
    own = tenants.select("tenant_id").distinct().join(held, "tenant_id", "left")
    there = F.coalesce("valid", F.lit(False))
    level = F.when(there, F.col("tenant_id")).otherwise(F.lit(SHARED)).alias("source")
    shared = stored.filter(F.col("tenant_id") == SHARED)
    chosen = own.select("tenant_id", level)
    rows = chosen.join(stored.withColumnRenamed("tenant_id", "source"), "source")
    rows = rows.select("tenant_id", F.when(F.col("source") == F.col("tenant_id"), LEVELS[0]).otherwise(LEVELS[1]).alias("level"), "code", "description")
    rest = chosen.filter(F.col("source") == SHARED).join(shared.select(F.lit(SHARED).alias("source")).distinct(), "source", "left_anti")
    known = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(d).alias("description")) for c, d in defaults.items()])
    return rows.unionByName(rest.select("tenant_id", F.lit(LEVELS[2]).alias("level"), F.explode(known).alias("c")).select("tenant_id", "level", "c.code", "c.description"))


def replaced_categories(stored: DataFrame, tenant: str, new: DataFrame) -> DataFrame:
    """stored with a tenant's categories replaced, all of them, by new(code, description)."""
    return stored.filter(F.col("tenant_id") != tenant).unionByName(new.select(F.lit(tenant).alias("tenant_id"), "code", "description"))


def imported_sessions(sessions: DataFrame, messages: DataFrame, new: DataFrame, new_messages: DataFrame, tenant: str) -> tuple[DataFrame, DataFrame]:
    """sessions and messages with those of an older store that are not there yet, under a tenant. What new(session_id, title, created_at,
    last_active, message_count) lacks is filled in: a title, its creation as its last activity, the number of its messages; a message
    without a role is the user's, without a time the session's."""
    fresh = new.join(sessions.select("session_id"), "session_id", "left_anti")
    n = new_messages.groupBy("session_id").agg(F.count("*").alias("_n"))
    rows = fresh.join(n, "session_id", "left").select(
        "session_id", F.lit(tenant).alias("tenant_id"), F.coalesce("title", F.lit("Imported Session")).alias("title"), "created_at",
        F.coalesce("last_active", "created_at").alias("last_active"), F.coalesce("message_count", "_n", F.lit(0)).alias("message_count"),
    )
    own = new_messages.join(fresh.select("session_id", F.col("created_at").alias("_at")), "session_id")
    said = own.select("session_id", "id", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("content", F.lit("")).alias("content"), F.coalesce("timestamp", "_at").alias("timestamp"))
    return sessions.unionByName(rows), messages.unionByName(said)


#: What stands for absent fields of an imported feedback record (fixed values).
IMPORTED = {"query": "", "answer": "", "confidence_pct": 0, "confidence_level": "", "num_sources": 0, "retriever_type": "unknown", "feedback": "", "correction": "", "attempts": 1, "was_refined": False}


def imported_feedback(lines: DataFrame) -> DataFrame:
    """Feedback records of lines(value), JSON each, broken ones skipped, all shared, with defaults for absent fields."""
    kind = "query string, answer string, confidence_pct int, confidence_level string, num_sources int, top_sources array<string>, retriever_type string, feedback string, correction string, attempts int, was_refined boolean, timestamp string"
    rows = lines.filter(F.try_parse_json("value").isNotNull()).select(F.from_json("value", kind).alias("r")).select("r.*")
    filled = rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in IMPORTED.items()})
    return filled.withColumn("top_sources", F.coalesce("top_sources", F.array().cast("array<string>"))).withColumn("tenant_id", F.lit(SHARED))


def connection(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """nodes, vectors, connected: which of the two stores has any row; both must."""
    one = lambda t, name: t.limit(1).agg((F.count("*") > 0).alias(name))
    both = one(nodes, "nodes").withColumn("_k", F.lit(0)).join(one(vectors, "vectors").withColumn("_k", F.lit(0)), "_k").drop("_k")
    return both.withColumn("connected", F.col("nodes") & F.col("vectors"))


def job_reports(jobs: DataFrame) -> DataFrame:
    """What is shown of jobs(job_id, tenant_id, status, mode, phase, current, total, error, report map of numbers): progress, and of a report
    that is there its counts, zero where it lacks them."""
    at = lambda k: F.coalesce(F.try_element_at("report", F.lit(k)).cast("long"), F.lit(0)).alias(k)
    there = F.coalesce(F.size("report"), F.lit(0)) > 0
    summary = F.when(there, F.struct(at("total_files"), at("successful"), at("warnings"), at("failed"), F.try_element_at("report", F.lit("total_duration_sec")).alias("total_duration_sec")))
    return jobs.select("job_id", "tenant_id", "status", "mode", "phase", F.struct("current", "total").alias("progress"), summary.alias("report_summary"), "error")

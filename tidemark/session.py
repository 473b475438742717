"""Sessions, tables, and the engine's tables derived from the test tables."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Document types that sub-queries may ask for (fixed values).
QUERY_TYPES = ["REGULATION", "VETTING", "PROCEDURE", "POLICY", "FORM", "CHECKLIST", "MANUAL", "CIRCULAR"]
#: Document types of the nodes made from the test tables.
DOC_TYPES = ["FORM", "CHECKLIST", "PROCEDURE", "POLICY", "MANUAL", "REGULATION"]


def session(name: str = "tidemark") -> SparkSession:
    """A session with the settings that the engine relies on; the cluster's own settings stay."""
    return (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


_SCRATCH: list[str] = []
#: Spark's own setting: shuffle files go when the query that made them has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir; `clear_scratch` deletes it unless it is to be kept. Where that is not set: in local mode a temporary
    folder that goes with the driver; on a cluster it is an error, since no folder is known to be shared."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        made = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        where = f"file://{made}"
    at = f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not keep:
        _SCRATCH.append(at)
    return at


def clear_scratch(spark: SparkSession) -> int:
    """Deletes the folders that this driver has made and not kept; how many. For when nothing reads their tables any more."""
    n = len(_SCRATCH)
    while _SCRATCH:
        path = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    return n


def stored(rows: DataFrame, name: str) -> DataFrame:
    """rows, computed once and read back from a table in a folder of their own; the shuffle files of computing them go."""
    spark, at = rows.sparkSession, scratch(rows.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        rows.write.option("compression", "zstd").parquet(at)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(rows.schema).parquet(at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, doc_id, text, tenant_id, doc_type, title, section_id from documents."""
    i = F.col("doc_id")
    kind = F.element_at(F.array(*[F.lit(t) for t in DOC_TYPES]), (i % 6 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        i.alias("node_id"),
        F.col("source").alias("doc_id"),
        "text",
        F.when(i % 4 == 0, "shared").otherwise(F.concat(F.lit("t"), (i % 4).cast("string"))).alias("tenant_id"),
        F.when(i % 12 >= 6, F.initcap(kind)).otherwise(kind).alias("doc_type"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.when(i % 10 == 0, "1").otherwise(F.concat(F.lit("1."), (i % 10).cast("string"))).alias("section_id"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, embedding of the nodes that have one."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, tenant_id, id (order), role, content from conversations."""
    c = F.col("conv_id")
    return table(spark, sf_dir, "conversations").select(c.alias("session_id"), F.concat(F.lit("t"), (c % 3).cast("string")).alias("tenant_id"), F.col("turn").alias("id"), "role", F.col("text").alias("content"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, tenant_id, feedback, confidence_pct, was_refined, created_at from events."""
    e = F.col("event_id")
    kind = F.when(F.col("event_type") == "purchase", "helpful").when(F.col("event_type") == "error", "incorrect").otherwise("neutral")
    return table(spark, sf_dir, "events").select(e.alias("id"), F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"), kind.alias("feedback"), (e % 101).cast("int").alias("confidence_pct"), (F.col("user_id") % 3 == 0).alias("was_refined"), F.col("ts").alias("created_at"))


def files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The library's files now, and as a snapshot had them: name, size, mtime."""
    i = F.col("doc_id")
    now = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), i.cast("string"), F.lit(".txt")).alias("name"), F.col("n_chars").alias("size"), (i * 10).alias("mtime"), i.alias("n"))
    current = now.filter(F.col("n") % 11 != 0)
    then = now.filter(F.col("n") % 7 != 0).withColumn("size", F.when(F.col("n") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return current.drop("n"), then.drop("n")


#: The same tables for the SQL of the queries.
SQL = {
    "nodes": """nodes AS (SELECT doc_id AS node_id, source AS doc_id, text, CASE WHEN doc_id % 4 = 0 THEN 'shared' ELSE 't' || CAST(doc_id % 4 AS VARCHAR) END AS tenant_id,
  CASE WHEN doc_id % 12 >= 6 THEN (['Form','Checklist','Procedure','Policy','Manual','Regulation'])[CAST(doc_id % 6 AS INT) + 1] ELSE (['FORM','CHECKLIST','PROCEDURE','POLICY','MANUAL','REGULATION'])[CAST(doc_id % 6 AS INT) + 1] END AS doc_type,
  split_part(text, chr(10), 1) AS title, CASE WHEN doc_id % 10 = 0 THEN '1' ELSE '1.' || CAST(doc_id % 10 AS VARCHAR) END AS section_id FROM documents)""",
    "messages": "messages AS (SELECT conv_id AS session_id, 't' || CAST(conv_id % 3 AS VARCHAR) AS tenant_id, turn AS id, role, text AS content FROM conversations)",
    "feedback": """feedback AS (SELECT event_id AS id, 't' || CAST(user_id % 3 AS VARCHAR) AS tenant_id, CASE event_type WHEN 'purchase' THEN 'helpful' WHEN 'error' THEN 'incorrect' ELSE 'neutral' END AS feedback,
  CAST(event_id % 101 AS INT) AS confidence_pct, user_id % 3 = 0 AS was_refined, ts AS created_at FROM events)""",
    "files": """cur AS (SELECT 'doc' || CAST(doc_id AS VARCHAR) || '.txt' AS name, n_chars AS size, doc_id * 10 AS mtime FROM documents WHERE doc_id % 11 <> 0),
snap AS (SELECT 'doc' || CAST(doc_id AS VARCHAR) || '.txt' AS name, CASE WHEN doc_id % 5 = 0 THEN n_chars + 1 ELSE n_chars END AS size, doc_id * 10 AS mtime FROM documents WHERE doc_id % 7 <> 0)""",
}

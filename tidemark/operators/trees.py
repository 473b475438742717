"""Section trees of a library as stored tables: rebuilt from all tenants' extractions, loaded, printed."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import section_id, section_level, stem
from .sections import build_tree


def latest_records(records: DataFrame) -> DataFrame:
    """Of records(tenant_id, name, ...) of all tenants one for each file name: that of the last tenant, their order being by name."""
    row = F.struct(*records.columns)
    return records.groupBy("name").agg(F.max_by(row, "tenant_id").alias("r")).select("r.*")


def rebuild(records: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trees and counts of records(tenant_id, name, doc_type, title, error, sections array of names).

    Trees, a row for each section: doc_id (the name's stem), doc_type, title, ord, section_id, name, level, parent, path (places
    of the section and those above it, from the top), chunk_ids of chunks(node_id, doc_id, section_id) in order. A section whose parent
    is not there is at the top, and so is one without a number. Counts: built, skipped (an error, or no sections)."""
    own = latest_records(records).withColumn("sections", F.filter("sections", lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""))
    usable = F.col("error").isNull() & (F.coalesce(F.size("sections"), F.lit(0)) > 0)
    counts = own.agg(F.count_if(usable).alias("built"), F.count_if(~usable).alias("skipped"))
    doc = F.coalesce("title", "name").alias("title")
    rows = own.filter(usable).select(stem(F.col("name")).alias("doc_id"), "doc_type", doc, F.posexplode("sections").alias("ord", "name"))
    rows = rows.withColumn("section_id", section_id(F.col("name"))).withColumn("level", section_level(F.col("name")))
    numbered = F.regexp_like("section_id", F.lit(r"^[\d.]+$"))
    tree = build_tree(rows).withColumn("parent", F.when(numbered, F.col("parent")))
    tree = with_paths(tree)
    held = chunks.filter("section_id <> ''").groupBy("doc_id", "section_id").agg(F.array_sort(F.collect_list("node_id")).alias("chunk_ids"))  # of one section
    none = F.array().cast(held.schema["chunk_ids"].dataType)
    # of equal section ids the last holds the chunks
    last = F.row_number().over(Window.partitionBy("doc_id", "section_id").orderBy(F.desc("ord"))) == 1
    tree = tree.withColumn("_last", last).join(held, ["doc_id", "section_id"], "left")
    return tree.withColumn("chunk_ids", F.when(F.col("_last"), F.coalesce("chunk_ids", none)).otherwise(none)).drop("_last"), counts


def with_paths(tree: DataFrame) -> DataFrame:
    """tree(doc_id, ord, section_id, parent) with path: the places of the sections above, from the top, then its own; sections in the
    order of their paths are in the order of the tree. A parent is the first section with its id, and its id is a part shorter,
    so each document's sections resolve among themselves, a level at a time."""
    first = tree.groupBy("doc_id", "section_id").agg(F.min("ord").alias("up"), F.min_by("parent", "ord").alias("further"))
    known = tree.select("doc_id", "ord", "parent", F.array("ord").alias("path"))
    deepest = tree.agg(F.max(F.size(F.split("section_id", r"\.")))).first()[0] or 1
    for _ in range(deepest - 1):
        above = first.select("doc_id", F.col("section_id").alias("parent"), "up", "further")
        known = known.join(above, ["doc_id", "parent"], "left").select("doc_id", "ord", F.col("further").alias("parent"), F.when(F.col("up").isNull(), F.col("path")).otherwise(F.concat(F.array("up"), "path")).alias("path"))
    return tree.join(known.select("doc_id", "ord", "path"), ["doc_id", "ord"])


def printed(tree: DataFrame, depth: int = 5) -> DataFrame:
    """doc_id, text: the tree of each document, a line a section down to `depth` below the top, indented, with its number of chunks;
    an empty line after each section at the top."""
    n = F.size("chunk_ids")
    size = F.when(n > 0, F.concat(F.lit("["), n.cast("string"), F.lit(" chunks]"))).otherwise("[no chunks]")
    deep = F.size("path") - 1
    line = F.concat(F.repeat(F.lit("  "), deep), F.lit("├─ "), "section_id", F.lit(": "), heading(), F.lit(" "), size)
    rows = tree.filter(deep <= depth).select("doc_id", "path", line.alias("line"))
    held = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("path", "line"))).alias("l"))  # one document's sections
    # an empty line before each section at the top but the first
    body = F.transform("l", lambda x, i: F.concat(F.when((F.size(x["path"]) == 1) & (i > 0), "\n").otherwise(""), x["line"]))
    head = F.concat(F.lit("Document: "), "doc_id", F.lit("\n" + "=" * 80 + "\n\n"))
    return held.select("doc_id", F.concat(head, F.array_join(body, "\n"), F.lit("\n")).alias("text"))


def heading() -> Column:
    """A section's name without the number that is its id."""
    rest = F.trim(F.regexp_extract("name", r"^\s*[\d.]+\.?\s+(.+)$", 1))
    return F.when(rest != "", rest).otherwise(F.trim("name"))


def save(tree: DataFrame, path: str) -> None:
    """A table in which each document's sections lie together, in order."""
    tree.repartition("doc_id").sortWithinPartitions("doc_id", "ord").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, docs: list[str] | None = None) -> DataFrame:
    """Stored trees, or those of some documents only, which the scan picks."""
    rows = spark.read.parquet(path)
    return rows if docs is None else rows.filter(F.col("doc_id").isin(*docs))


def available(tree: DataFrame) -> bool:
    """Whether there is any tree: without one, sections cannot be retrieved."""
    return not tree.isEmpty()

"""Changes to keyed tables, as the table that follows: Parquet has no MERGE, so callers write the result beside the old one and swap."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n")


def insert_absent(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """old and those of new whose key it lacks; of equal keys in new the first."""
    return old.unionByName(first_of_each(new, key, order).join(old.select(key), key, "left_anti").select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, key: str, update: list[str] | None = None, order: str | None = None) -> DataFrame:
    """old with the rows of new; where the key is in both, the columns in update (all if None) are the new ones. Of rows of new with
    the same key the last by `order` counts, without one the greatest."""
    update = [c for c in old.columns if c != key] if update is None else update
    row = F.struct(*old.columns)
    n = new.groupBy(key).agg((F.max(row) if order is None else F.max_by(row, order)).alias("n"))
    both = old.select(key, row.alias("o")).join(n, key, "full")
    pick = lambda c: F.when(F.col("n").isNull(), F.col(f"o.{c}")).when(F.col("o").isNull(), F.col(f"n.{c}")).otherwise(F.col(f"n.{c}" if c in update else f"o.{c}"))
    return both.select(key, *[pick(c).alias(c) for c in old.columns if c != key])


def delete(old: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return old.join(keys.select(key).distinct(), key, "left_anti")


def merge_metadata(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """old(metadata map) with the entries of changes(key, changes map) over its own; a null map is an empty one."""
    own = F.coalesce("metadata", F.create_map().cast(old.schema["metadata"].dataType))
    merged = F.map_from_entries(F.concat(F.map_entries(F.map_filter(own, lambda k, _: ~F.map_contains_key("changes", k))), F.map_entries("changes")))
    return old.join(changes, key, "left").withColumn("metadata", F.when(F.col("changes").isNull(), F.col("metadata")).otherwise(merged)).drop("changes")


def transfer(old: DataFrame, owner: str, where) -> DataFrame:
    return old.withColumn("tenant_id", F.when(where, owner).otherwise(F.col("tenant_id")))


def last_of_each(rows: DataFrame, key, order: str) -> DataFrame:
    """Of rows with the same key the last in order."""
    keys = [key] if isinstance(key, str) else key
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), order).alias("_r")).select("_r.*")


def bulk_upsert(old: DataFrame, new: DataFrame, key: str, tenant: str, update: list[str], touched, order: str | None = None) -> DataFrame:
    """new(metadata map) into old: the tenant of a new row is the one in its metadata, else `tenant`; of known rows only `update`
    and the column `touched` change; of equal keys in new the last by `order`."""
    owner = F.coalesce(F.try_element_at("metadata", F.lit("tenant_id")), F.lit(tenant))
    rows = new.withColumn("tenant_id", owner).withColumn("touched", touched).drop("metadata")
    return upsert(old, rows.select(*dict.fromkeys([*old.columns, *([order] if order else [])])), key, [*update, "touched"], order)


def replace_one(old: DataFrame, where, values: dict) -> DataFrame:
    """Columns of the rows that `where` picks."""
    return old.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_where(old: DataFrame, where) -> DataFrame:
    """The rows that `where` does not pick; those it does not know stay."""
    return old.filter(~F.coalesce(where, F.lit(False)))


def delete_documents(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table without the rows of the documents in gone(key)."""
    return {name: delete(t, gone, key) for name, t in tables.items()}


def replaced(rows: DataFrame, document: str, chunk_size: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """The new content of a cleared table, and its one-row description."""
    info = rows.agg(F.count("*").alias("num_nodes"), F.count_distinct(document).alias("num_documents"))
    return rows, info.withColumn("chunk_size", F.lit(chunk_size)).withColumn("chunk_overlap", F.lit(overlap))


def corrections_of(records: DataFrame) -> DataFrame:
    """Records(fields map) with the corrections that are set; none: no row."""
    return records.withColumn("fields", F.map_filter("fields", lambda _, v: v.isNotNull())).filter(F.size("fields") > 0)


def merged_by_tenant(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of both, of equal keys the last: what is written with a partition for each tenant."""
    return last_of_each(old.unionByName(new), keys, order)


def write_by_tenant(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("tenant_id").parquet(path)

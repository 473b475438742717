"""Keyed tables that change: a base in buckets, a log of change batches over it, merged when they are read.

    root/log/batch=n/rows/bucket=b   rows of batch n, root/log/batch=n/gone its keys: all that the batch replaces or deletes
    root/base/bucket=b/version=n     a bucket's rows after batch n
    root/compacted/n                 the base holds all batches up to n

A batch counts once its DONE file is there, a compaction once its file in `compacted` is there; what a lost job leaves behind
is not read and is written anew by the next one. A table has one writer at a time and any number of readers."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

#: Keys of a log that may be broadcast against the base.
BROADCAST_KEYS = 2_000_000


class LoggedTable:
    """Rows with a `key` (that of what is replaced or deleted together), dealt to buckets by `spread` (the key, or what readers
    ask for)."""

    def __init__(self, spark: SparkSession, root: str, schema: str | StructType, key: str, spread: str | None = None, buckets: int = 16):
        self.spark, self.root, self.key, self.spread, self.buckets = spark, root.rstrip("/"), key, spread or key, buckets
        self.schema = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
        path = self._path("")
        self.fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *[p for p in parts if p]]))

    def _names(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        return [s.getPath().getName() for s in self.fs.listStatus(path)] if self.fs.exists(path) else []

    def _numbers(self, prefix: str, *parts: str) -> list[int]:
        return sorted(int(x.removeprefix(prefix)) for x in self._names(*parts) if x.startswith(prefix))

    def _touch(self, *parts: str) -> None:
        self.fs.create(self._path(*parts), True).close()

    def batches(self) -> list[int]:
        """Numbers of the whole batches in the log."""
        return [n for n in self._numbers("batch=", "log") if self.fs.exists(self._path("log", f"batch={n}", "DONE"))]

    def compacted(self) -> int:
        """The last batch that the base holds; -1 before the first compaction."""
        return max((int(x) for x in self._names("compacted") if x.isdigit()), default=-1)

    def bucket(self, value=None):
        return F.pmod(F.xxhash64(F.col(self.spread) if value is None else value), F.lit(self.buckets)).cast("int")

    def buckets_of(self, values: list) -> list[int]:
        """The buckets that hold some values of `spread`."""
        kind = self.schema[self.spread].dataType
        rows = self.spark.createDataFrame([(v,) for v in values], StructType().add("v", kind))
        return sorted({r[0] for r in rows.select(self.bucket(F.col("v"))).collect()})

    def _read(self, paths: list[str], schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _keys(self) -> StructType:
        return StructType([self.schema[self.key]])

    def _next(self) -> int:
        return max([*self.batches(), self.compacted()], default=-1) + 1

    def _write_base(self, rows: DataFrame, buckets, n: int) -> None:
        """Version n of some buckets, whole; then the base holds all batches up to n."""
        for b in range(self.buckets):
            self.fs.delete(self._path("base", f"bucket={b}", f"version={n}"), True)  # of a writer that was lost
        rows = rows.select(*self.schema.names, self.bucket().alias("bucket"), F.lit(n).alias("version"))
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "version", self.spread).write.mode("append").partitionBy("bucket", "version").parquet(f"{self.root}/base")
        for b in buckets:
            self.fs.mkdirs(self._path("base", f"bucket={b}", f"version={n}"))  # there too when no row is left
        self._touch("compacted", str(n))

    def replace(self, rows: DataFrame) -> int:
        """All rows anew, written once, to the base; what the log and the base held is not read any more. The number."""
        n = self._next()
        self._write_base(rows, range(self.buckets), n)
        return n

    def append(self, rows: DataFrame | None, gone: DataFrame | None = None, keys: DataFrame | None = None) -> int:
        """A further batch: `rows`, which replace all rows with their keys, and the keys in `gone`, whose rows go. Its number. A
        caller that has all of these keys gives them as `keys`, so that they are not looked for in the rows."""
        n = self._next()
        at = f"{self.root}/log/batch={n}"
        rows = self.spark.createDataFrame([], self.schema) if rows is None else rows.select(*self.schema.names)
        dealt = rows.withColumn("bucket", self.bucket()).hint("rebalance", "bucket").sortWithinPartitions("bucket", self.spread)
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/rows")
        if keys is None:
            keys = self._read([f"{at}/rows"], self.schema).select(self.key)
            keys = keys if gone is None else keys.unionByName(gone.select(self.key))
        keys.select(self.key).distinct().write.mode("overwrite").parquet(f"{at}/gone")
        self._touch("log", f"batch={n}", "DONE")
        return n

    def _base(self, upto: int, buckets: list[int]) -> list[str]:
        out = []
        for b in buckets:
            own = [v for v in self._numbers("version=", "base", f"bucket={b}") if v <= upto]
            if own:
                out.append(f"{self.root}/base/bucket={b}/version={own[-1]}")
        return out

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The table as it is now, or some of its buckets. The log's keys are broadcast if they are few."""
        wanted = range(self.buckets) if buckets is None else buckets
        upto = self.compacted()
        base_paths = self._base(upto, list(wanted))
        base = self._read(base_paths, self.schema)
        new = [n for n in self.batches() if n > upto]
        if not new:
            return base
        rows = base if base_paths else None
        for n in new:
            at = f"{self.root}/log/batch={n}"
            if rows is not None:  # what was there before loses this batch's keys
                keys = self._read([f"{at}/gone"], self._keys()).withColumnRenamed(self.key, "_key")
                few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
                rows = rows.join(F.broadcast(keys) if few else keys, F.col(self.key).eqNullSafe(F.col("_key")), "left_anti")
            own = [f"{at}/rows/bucket={b}" for b in self._numbers("bucket=", "log", f"batch={n}", "rows") if b in wanted]
            if own:
                more = self._read(own, self.schema)
                rows = more if rows is None else rows.unionByName(more)
        return base if rows is None else rows.select(*self.schema.names)

    def counts(self, rows: DataFrame, gone: DataFrame | None = None) -> dict[str, int]:
        """How many keys a batch of these would add, modify and delete."""
        asked = rows.select(self.key).withColumn("_new", F.lit(1))
        if gone is not None:
            asked = asked.unionByName(gone.select(self.key).withColumn("_new", F.lit(0)))
        asked = asked.groupBy(self.key).agg(F.max("_new").alias("_new"))
        there = self.read().select(F.col(self.key).alias("_key")).distinct().withColumn("_there", F.lit(True))
        both = asked.join(there, F.col(self.key).eqNullSafe(F.col("_key")), "left").withColumn("_there", F.coalesce("_there", F.lit(False)))
        new = F.col("_new") == 1
        row = both.agg(F.count_if(new & ~F.col("_there")).alias("added"), F.count_if(new & F.col("_there")).alias("modified"), F.count_if(~new & F.col("_there")).alias("deleted")).first()
        return row.asDict()

    def touched(self, new: list[int]) -> list[int]:
        """Buckets that batches put rows in or take rows from."""
        keys = self._read([f"{self.root}/log/batch={n}/gone" for n in new], self._keys()).distinct()
        if self.key == self.spread:
            return sorted(r[0] for r in keys.select(self.bucket()).distinct().collect())
        put = {b for n in new for b in self._numbers("bucket=", "log", f"batch={n}", "rows")}
        base = self._read(self._base(self.compacted(), list(range(self.buckets))), self.schema)
        gone = keys.withColumnRenamed(self.key, "_key")
        taken = base.join(gone, F.col(self.key).eqNullSafe(F.col("_key")), "left_semi").select(self.bucket()).distinct().collect()
        return sorted(put | {r[0] for r in taken})

    def compact(self) -> int:
        """Writes the buckets that the log touches anew, with the log in them; how many. Other buckets stay as they are."""
        upto = self.compacted()
        new = [n for n in self.batches() if n > upto]
        if not new:
            return 0
        n, buckets = new[-1], self.touched(new)
        self._write_base(self.read(buckets), buckets, n)
        return len(buckets)

    def vacuum(self) -> None:
        """Deletes what only readers of earlier states need: batches that the base holds, and earlier versions of buckets."""
        upto = self.compacted()
        for n in self.batches():
            if n <= upto:
                self.fs.delete(self._path("log", f"batch={n}"), True)
        for b in range(self.buckets):
            for v in [v for v in self._numbers("version=", "base", f"bucket={b}") if v <= upto][:-1]:
                self.fs.delete(self._path("base", f"bucket={b}", f"version={v}"), True)

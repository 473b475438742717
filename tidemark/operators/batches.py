"""Steps that may fail row by row (extraction, embedding), and scans in pages."""

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from ..session import stored


def attempted(rows: DataFrame, step: Callable, out: str, column: str = "text", fail_fast: bool = False) -> DataFrame:
    """rows with `result` (of type `out`), `error` and `ok` of step(value of column), row by row in the tasks that hold them. An exception
    becomes the row's error, and so does a result that is a dict with a parse_error; with fail_fast it ends the job. Nothing is
    reordered: a row keeps its own key."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches):
        for b in batches:
            results, errors = [], []
            for value in b.column(column).to_pylist():
                try:
                    got, error = step(value), None
                    if isinstance(got, dict) and got.get("parse_error"):
                        error = str(got["parse_error"])
                except Exception as e:
                    if fail_fast:
                        raise
                    got, error = None, str(e) or type(e).__name__
                results.append(got if error is None or isinstance(got, dict) else None)
                errors.append(error)
            made = [pa.array(results, kind), pa.array(errors, pa.string()), pa.array([e is None for e in errors])]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, "result", "error", "ok"])

    kind = to_arrow_type(_parse_datatype_string(out))
    return rows.mapInArrow(run, f"{fields}, result {out}, error string, ok boolean")


def outcome(done: DataFrame) -> DataFrame:
    """succeeded, failed, total of attempted rows."""
    return done.agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.count("*").alias("total"))


def page(rows: DataFrame, keys: list[str], size: int = 1000, after: tuple | None = None) -> tuple[DataFrame, tuple | None]:
    """The next rows in the order of keys (which tell rows apart and are never null) after those that end at `after`, and where they
    end; None after the last page. Rows put in or taken out elsewhere do not move a page: it begins after a key, not after a count."""
    if after is not None:
        later = F.lit(False)
        for i, k in enumerate(keys):
            same = F.lit(True)
            for j in range(i):
                same = same & (F.col(keys[j]) == F.lit(after[j]))
            later = later | (same & (F.col(k) > F.lit(after[i])))
        rows = rows.filter((F.col(keys[0]) >= F.lit(after[0])) & later)  # the first key alone reaches the scan
    found = rows.orderBy(*keys).limit(size)
    last = found.agg(F.count("*").alias("n"), F.max(F.struct(*keys)).alias("m")).first()
    return found, tuple(last["m"]) if last["n"] == size else None


def pages(rows: DataFrame, keys: list[str], size: int = 1000):
    """All pages, one after the other; each is read when it is asked for."""
    after = None
    while True:
        found, after = page(rows, keys, size, after)
        yield found
        if after is None:
            return


def page_of_each(rows: DataFrame, keys: list[str], size: int = 1000) -> DataFrame:
    """rows with the number of the page that each is on: rows are put in order by a range exchange, and the rows before each partition are
    counted, so no task sees them all."""
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_p", F.spark_partition_id())
    nth = stored(ordered.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(*keys))), "ordered")  # once: ranges are sampled
    counts = nth.groupBy("_p").agg(F.count("*").alias("_c"))
    before = counts.withColumn("_before", F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).select("_p", "_before")  # a row a partition
    return nth.join(F.broadcast(before), "_p").withColumn("page", F.floor((F.col("_before") + F.col("_n") - 1) / size).cast("int")).drop("_p", "_n", "_before")

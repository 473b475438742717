"""Streams: the library's incremental sync, and conversation state by session."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StructType

from ..operators.dml import last_of_each
from ..operators.library import sync_diff
from ..session import stored
from ..sources.logged import LoggedTable

TURNS = "session_id long, id long, turn int, topic string"


def watch_files(spark: SparkSession, root: str, schema: StructType | str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(root)


def sync(stream: DataFrame, table: LoggedTable, checkpoint: str, order: str, deleted: str | None = None, compact_every: int = 10):
    """Each micro-batch goes to the table's log: of each key the last row by `order`; rows whose `deleted` is true take theirs out.
    A batch that comes again after a failure says the same again. The log is compacted after every so many batches."""

    def apply(batch: DataFrame, n: int) -> None:
        last = last_of_each(batch, table.key, order)
        out = F.lit(False) if deleted is None else F.coalesce(F.col(deleted), F.lit(False))
        table.append(last.filter(~out), last.filter(out))
        if n % compact_every == compact_every - 1:
            table.compact()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sync_library(current: DataFrame, snapshot: LoggedTable, tables: dict[str, LoggedTable], make: Callable[[DataFrame], dict[str, DataFrame]]) -> dict[str, int]:
    """Brings tables, all keyed by file name, up to the files current(name, size, mtime, ...): how many were added, modified and
    deleted. `make` turns new and modified files into each table's rows; a file for which the first table gets none has
    failed: what is there of it stays, and the next run takes it up again, since only files that are done enter the snapshot.
    A run that is lost midway is repeated by the next: its batches say the same again."""
    changes = stored(sync_diff(current, snapshot.read()), "changes")
    wanted = changes.filter("change <> 'deleted'").select("name")
    made = {t: stored(rows, t) for t, rows in make(current.join(wanted, "name", "left_semi")).items()}
    done = made[next(iter(tables))].select("name").distinct()
    deleted = changes.filter("change = 'deleted'").select("name")
    for name, t in tables.items():
        t.append(made[name], deleted.unionByName(done))
    snapshot.append(current.join(done, "name", "left_semi"), deleted)
    n = changes.join(done.withColumn("done", F.lit(True)), "name", "left")
    ok = F.coalesce("done", F.lit(False))
    row = n.agg(F.count_if((F.col("change") == "new") & ok).alias("added"), F.count_if((F.col("change") == "modified") & ok).alias("modified"), F.count_if(F.col("change") == "deleted").alias("deleted"), F.count_if((F.col("change") != "deleted") & ~ok).alias("failed"))
    return row.first().asDict()


class TurnCounter(StatefulProcessor):
    """Counts a session's turns from 1, anew after `most` or when the topic changes."""

    def __init__(self, most: int = 6):
        self.most = most

    def init(self, handle) -> None:
        self.state = handle.getValueState("turn", "turn int, topic string")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        turn, topic = self.state.get() if self.state.exists() else (0, None)
        out = []
        for b in rows:
            for r in b.sort_values("id").itertuples(index=False):
                turn = 1 if turn >= self.most or (topic is not None and r.topic != topic) else turn + 1
                topic = r.topic
                out.append((key[0], r.id, turn, topic))
        self.state.update((turn, topic))
        yield pd.DataFrame(out, columns=["session_id", "id", "turn", "topic"])

    def close(self) -> None:
        pass


def conversation_turns(messages: DataFrame, most: int = 6) -> DataFrame:
    """session_id, id, turn, topic of a stream of messages(session_id, id, topic)."""
    return messages.groupBy("session_id").transformWithStateInPandas(TurnCounter(most), TURNS, "Append", "None")


def event_windows(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts of events(ts, event_type) in tumbling windows, late ones within `late`; for batches and streams."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")

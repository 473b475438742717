"""What the operators share: reading tables, the shared folder, and vectorised text helpers."""

import atexit
import hashlib
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Space and the five control characters \x09-\x0D part words in most contracts.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text handled at once in a task.
GROUP_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none: the warehouse, or, in local mode only, a
    temporary folder that goes with the driver."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tidemark.dir", None)
    if not where and spark.sparkContext.master.startswith("local["):
        made = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        where = f"file://{made}"
        spark.conf.set("spark.tidemark.dir", where)
    return (where or f"{spark.conf.get('spark.sql.warehouse.dir')}/tidemark").rstrip("/")


def unused(name: str, *tables: DataFrame) -> str:
    """A column name that no table has (Spark's names do not tell case apart)."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's own setting: shuffle files go when the query that made them has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, its lineage cut, safe against lost executors."""
    spark, at = df.sparkSession, new_dir(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(at)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(at)
    out.written_at = at
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Deletes written tables that nothing will read any more."""
    for t in tables:
        if t is not None:
            path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_at)
            path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def as_bytes(texts) -> list[bytes]:
    if isinstance(texts, pa.Array):
        texts = texts.cast(pa.binary()).to_pylist()
    return [b"" if t is None or t != t else t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") for t in texts]


def per_text(rows: DataFrame, keep: list[str], compute, added: str, text: str = "text", limit: int | None = None) -> DataFrame:
    """The columns `keep` of rows, untouched, and those of `added` ("name type, ..."), which compute(texts) gives as a dict of
    arrays for a list of texts. Batches stay in Arrow, so that ids of any kind, and null ones, come back as they were."""
    rows = rows.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])])
    names = [x.split()[0] for x in added.split(", ")]

    def run(batches):
        for b in batches:
            texts = as_bytes(b.column(text))
            for lo, hi in grouped(texts, limit or GROUP_BYTES):
                got = compute(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, hi - lo) for c in keep), *(pa.array(got[c]) for c in names)], names=[*keep, *names])

    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    return rows.mapInArrow(run, ", ".join([*fields, added]))


def grouped(texts: list[bytes], limit: int = GROUP_BYTES):
    """Index ranges of texts of about limit bytes, one text at least."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > limit:
            yield start, i
            start, held = i, 0
        held += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads all bits of uint64 values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Words beyond so many bytes are hashed whole, one by one.
LONG_WORD = 1024
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_M = 0x9E3779B97F4A7C15 | 5  # odd, 5 modulo 8: powers repeat only after 2**62
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * U64(0xD6E8FEB86659FD93))
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers modulo 2**64 of an odd base and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n + n // 4, 1 << 19)
        _POWERS[:] = []
        for base in (_M, pow(_M, -1, 1 << 64)):
            with np.errstate(over="ignore"):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                _POWERS.append(np.cumprod(x, dtype=np.uint64))
    return _POWERS[0][:n], _POWERS[1][:n]


class Words:
    """The words of several texts: starts and ends (byte positions in buf), doc (index of the text), first (index of each text's first word, and the total)."""

    def __init__(self, texts: list[bytes], parts: np.ndarray = SPACES, lower: bool = False):
        self.buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        if lower:
            self.buf = LOWER[self.buf]
        inside = np.empty(len(self.buf) + 1, bool)
        inside[0] = False
        np.logical_not(parts[self.buf], out=inside[1:])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begin = np.concatenate([[0], np.cumsum(self.lengths + 1)])
        self.first = np.searchsorted(self.starts, self.begin)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def hashes(self) -> np.ndarray:
        """64 bits of each word, well mixed; equal words, equal values. Eight bytes at a time, each mixed into what came before."""
        size = self.ends - self.starts
        padded = np.concatenate([self.buf, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(self.buf) + 1,), "<u8", padded, strides=(1,))
        out = mix64(size.astype(np.uint64) + U64(0x2545F4914F6CDD1D))
        live, at, left = np.arange(len(size)), self.starts, size
        long = np.flatnonzero(size > LONG_WORD)
        if len(long):
            data = self.buf.tobytes()
            for i in long.tolist():
                out[i] = int.from_bytes(hashlib.blake2b(data[self.starts[i] : self.ends[i]], digest_size=8).digest(), "little")
            live = np.flatnonzero(size <= LONG_WORD)
            at, left = at[live], left[live]
        while len(live):
            block = eight[at] & _MASKS[np.minimum(left, 8)]
            out[live] = mix64((out[live] ^ block) * U64(0x9E3779B97F4A7C15) + (block >> U64(32)))
            go = left > 8
            live, at, left = live[go], at[go] + 8, left[go] - 8
        return out

    def window_hashes(self, word: np.ndarray, k: int) -> np.ndarray:
        """64 bits of the k words from each word on; meaningless where fewer follow in its text."""
        n = len(word)
        if n < k:
            return np.empty(0, np.uint64)
        power, inverse = powers(n + 1)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(word * power[:n], out=total[1:])
        return mix64((total[k:] - total[:-k]) * inverse[: n - k + 1] + U64(k))


def crc_mod(column: str, m: int):
    """crc32 of an id as text, modulo m."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % m

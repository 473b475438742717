"""Token-ID / binary output (operator 5).

Documents are dealt into ranges of doc_id, encoded range by range, and each range becomes a shard of three flat files:
`.tok` (token ids as little-endian unsigned integers, 2 bytes while the vocabulary has at most 65,536 ids, else 4),
`.ids` (doc_id as int64) and `.off` (64-bit offsets of each document in the whole stream, and the end). A shard's base
is the prefix sum of the tokens of all shards before it. Readers map the files into memory.

Defined results: a null text is an empty one and has only the end id; null doc_ids come first; rows that repeat a
doc_id are all kept, ordered by the first 32 characters of the text and then by its hash, and may lie in several shards; a very
long text is encoded whole and its ids go to the file at once; an empty table gives no shards; other columns are ignored.
"""

import os
import re
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, as_bytes, grouped, new_dir, table, written

#: Stands for a null doc_id in the files.
NO_ID = -(2**63)
MANIFEST = "stem string, part int, first_id long, n_docs long, n_tokens long, width int"


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Encoded pieces that a worker keeps, and bytes of text that it encodes at once.
KEPT_PIECES, ENCODE_BYTES = 1 << 20, 2_000_000
#: Documents that are read back at once.
READ_DOCS = 20_000
#: Bytes that begin white space outside ASCII in UTF-8: no cut before a space that one of them follows.
_SPACE_LEAD = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
#: ASCII marks but the apostrophe, which begins contractions: always a piece of their own after a letter.
_MARK = np.isin(np.arange(256), [x for x in range(33, 127) if not chr(x).isalnum() and x != 39])


@lru_cache(maxsize=2)
def encoder(path: str) -> "Encoder":
    """The worker's own, which keeps its pieces from task to task."""
    return Encoder(path)


class Encoder:
    """Whole texts to ids by the tokenizers library. Byte-level BPE never merges over a space before a visible character,
    nor from a letter to a mark, so texts are cut there and each distinct piece is encoded once in a worker. The library takes the vocabulary's added
    tokens out of a text before all else, so each of them is a piece of its own. Pieces are told apart by 64-bit hashes, among those of one
    worker only (2^20 at most: two of them share a hash once in 30 million workers)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_padding()
        self.lib.no_truncation()
        self.line = self._ids("\n")[0]
        self.size = self.lib.get_vocab_size(with_added_tokens=True)
        added = [t for t in self.lib.get_added_tokens_decoder().values() if t.content]
        self.added = sorted((t.content.encode() for t in added), key=len, reverse=True)
        # other kinds look at their neighbours, or at changed text: a text that holds one stays whole
        self.alone = self.lib.normalizer is None and len({t.normalized for t in added}) < 2 and not any(t.lstrip or t.rstrip or t.single_word for t in added)
        self.find_added = re.compile(b"|".join(map(re.escape, self.added))).finditer
        self._forget()

    def _forget(self):
        self.known, self.flat, self.at, self.n = np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _ids(self, text: str) -> list[int]:
        return self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        """Encodes pieces; those without other white space many at a time, with line ends between."""
        ids: list = [None] * len(pieces)
        plain = [i for i, p in enumerate(pieces) if p and p[1:].isalpha() and p[:1] in b" abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" and not any(t in p for t in self.added)]
        for lo in range(0, len(plain), 2000):
            part = plain[lo : lo + 2000]
            got = np.array(self._ids("\n".join(pieces[i].decode() for i in part)), np.uint32)
            ends = np.flatnonzero(got == self.line)
            for i, x in zip(part, np.split(got, ends), strict=True):
                ids[i] = x[1:] if i != part[0] else x
        other = [i for i, x in enumerate(ids) if x is None]
        for lo in range(0, len(other), 1000):
            part = other[lo : lo + 1000]
            for i, e in zip(part, self.lib.encode_batch_fast([pieces[i].decode("utf-8", "surrogatepass") for i in part], add_special_tokens=False), strict=True):
                ids[i] = np.array(e.ids, np.uint32)
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        at = np.cumsum(n) - n + len(self.flat)
        self.flat = np.concatenate([self.flat, *ids])
        order = np.argsort(known := np.concatenate([self.known, hashes]))
        self.known, self.at, self.n = known[order], np.concatenate([self.at, at])[order], np.concatenate([self.n, n])[order]

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, and how many each has."""
        w = Words.__new__(Words)
        w.buf = buf = np.frombuffer(b"".join(texts), np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(lengths) - lengths
        cut = np.zeros(len(buf) + 1, bool)
        cut[: len(buf) - 1] = (buf[:-1] == 32) & (buf[1:] > 32) & (buf[1:] != 127) & ~_SPACE_LEAD[buf[1:]]
        cut[1 : len(buf)] |= _LETTER[buf[:-1]] & _MARK[buf[1:]]
        for i in [i for i, t in enumerate(texts) if any(x in t for x in self.added)]:
            lo, hi = int(begin[i]), int(begin[i] + lengths[i])
            if not self.alone:
                cut[lo:hi] = False
                continue
            edges = [(lo + m.start(), lo + m.end()) for m in self.find_added(texts[i])]
            for a, z in edges:
                # white space before a token is at its part's end, where none is left over for a next word
                cut[max(a - 1, lo) : z] &= (np.arange(max(a - 1, lo), z) < a) & (buf[max(a - 1, lo)] != 32)
            cut[[x for a, z in edges for x in (a, z) if x < hi]] = True
        cut[begin[lengths > 0]] = True
        w.starts = np.flatnonzero(cut)
        w.ends = np.append(w.starts[1:], len(buf)) if len(w.starts) else w.starts
        doc = np.searchsorted(begin[lengths > 0], w.starts, side="right") - 1
        h, first, which = np.unique(w.hashes(), return_index=True, return_inverse=True)
        if len(self.known) + len(h) > KEPT_PIECES:
            self._forget()
        place = np.searchsorted(self.known, h)
        new = np.ones(len(h), bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != h[inside]
        if new.any():
            whole = buf.tobytes()
            self._learn(h[new], [whole[a:z] for a, z in zip(w.starts[first[new]].tolist(), w.ends[first[new]].tolist(), strict=True)])
            place = np.searchsorted(self.known, h)
        n, at = self.n[place][which], self.at[place][which]
        total = np.zeros(len(texts), np.int64)
        if len(doc):
            total[lengths > 0] = np.bincount(doc, n, int((lengths > 0).sum())).astype(np.int64)
        # each piece's ids follow those of the pieces before it, and one end id for each text before
        text_of = np.flatnonzero(lengths > 0)[doc] if len(doc) else doc
        to = np.cumsum(n) - n + text_of
        out = np.full(int(total.sum()) + len(texts), end_id, np.uint32)
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(to, n) + step] = self.flat[np.repeat(at, n) + step]
        return out, total + 1


def _put(fs, path: str, data: np.ndarray) -> None:
    with fs.open_output_stream(path) as out:
        out.write(data.tobytes())


def mapped(uri: str, kind) -> np.ndarray:
    """A flat file as an array: memory-mapped where the file system is local, else read in one piece."""
    fs, path = pafs.FileSystem.from_uri(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.empty(0, kind)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def in_file_order(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs as read from one written table, with columns of where each row stands in it."""
    at = ["_file", "_row"]
    return docs.select("*", F.col("_metadata.file_name").alias(at[0]), F.col("_metadata.row_index").alias(at[1])), at


def write_token_files(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int = 2, order: list[str] | None = None) -> DataFrame:
    """Writes the shards of docs(doc_id, text), by doc_id or by the columns of `order`; returns their manifest with each
    shard's base. A lost task writes its shard again under another name; only names in the manifest count."""

    def shard(batches):
        enc, ids, lens = encoder(tokenizer), [], []
        width = 2 if max(enc.size, end_id + 1) <= 1 << 16 else 4
        stem = f"{out_dir}/shard-{uuid.uuid4().hex}"
        fs, path = pafs.FileSystem.from_uri(stem)
        fs.create_dir(os.path.dirname(path), recursive=True)
        with fs.open_output_stream(f"{path}.tok") as out:  # written as it is encoded: a task holds a few MB of tokens
            for b in batches:
                texts = as_bytes(b["text"])
                for lo, hi in grouped(texts, ENCODE_BYTES):
                    got, n = enc.encode(texts[lo:hi], end_id)
                    out.write(got.astype(f"<u{width}").tobytes())
                    lens.append(n)
                ids.append(b["doc_id"].to_numpy(np.int64))
        if not ids:
            fs.delete_file(f"{path}.tok")
            return
        ids, lens = np.concatenate(ids), np.concatenate(lens)
        _put(fs, f"{path}.ids", ids)
        _put(fs, f"{path}.len", lens)
        yield pd.DataFrame({"stem": [stem], "part": [TaskContext.get().partitionId()], "first_id": [ids[0]], "n_docs": [len(ids)], "n_tokens": [lens.sum()], "width": [width]})

    def offsets(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                fs, path = pafs.FileSystem.from_uri(r.stem)
                lens = np.asarray(mapped(f"{r.stem}.len", np.int64))
                _put(fs, f"{path}.off", r.base + np.concatenate([[0], np.cumsum(lens)]))
            yield b

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *[F.col(c).alias(f"order_{c}") for c in order or ()])
    by = [f"order_{c}" for c in order] if order else ["doc_id"]
    # rows that share a doc_id, or have none, are parted too, by their texts; equal ones by where they were read
    more = {"head": F.substring("text", 1, 32), "whole": F.xxhash64("text"), "at": F.monotonically_increasing_id()}
    ranged = rows.withColumns(more).repartitionByRange(*by, *more).sortWithinPartitions(*by, *more)
    shards = written(ranged.select("doc_id", "text").mapInPandas(shard, MANIFEST), "shards")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    based = shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return written(one_a_task(based, shards).mapInPandas(offsets, f"{MANIFEST}, base long"), "manifest")


def one_a_task(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """Few rows that stand for much work each, about one a task; a given number of partitions is not folded at run time."""
    return rows.repartition(max(1, shards.count()), "stem")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row for each document of the files: doc_id, start, n_tokens, ids_crc32."""

    def read(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                tok, ids, off = mapped(f"{r.stem}.tok", f"<u{r.width}"), mapped(f"{r.stem}.ids", np.int64), mapped(f"{r.stem}.off", np.int64)
                for lo in range(0, len(ids), READ_DOCS):
                    part = off[lo : lo + READ_DOCS + 1]
                    at = part - r.base
                    crc = [zlib.crc32(tok[a:z].astype("<u4").tobytes()) for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    yield pd.DataFrame({"doc_id": ids[lo : lo + READ_DOCS], "start": part[:-1], "n_tokens": np.diff(part), "ids_crc32": crc})

    out = one_a_task(manifest, manifest).mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_files(table(spark, sf_dir, "documents"), new_dir(spark, "tokens"), vocabulary())
    return read_token_files(manifest)

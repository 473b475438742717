"""Text preparation: cleaning for a model, validation of extractions, chunks."""

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.text import normalise_for_validation

#: What an extraction is measured by.
MEASURES = ["coverage", "hallucination", "word_coverage", "length_ratio"]

#: Texts that a task cuts into chunks at once.
SLICE = 200

#: White space but line ends, as Unicode has it.
BLANK = r"(?U)[^\S\n]"


def clean_lines(text):
    """Lines outside fences: table rows with single spaces, others with rulers, dot leaders and repeated marks cut short."""

    def one(line):
        single = F.regexp_replace(line, r"[ \t]+", " ")
        short = F.regexp_replace(F.regexp_replace(single, r"[\-_=]{4,}", "----"), r"\.{4,}", "...")
        short = F.regexp_replace(short, r"([,.;:!?])\1{2,}", "$1")
        return F.regexp_replace(F.when(F.regexp_like(line, F.lit(r"(?U)^\s*\|(.*\|)?\s*$")), single).otherwise(short), r"(?U)\s+$", "")

    return F.array_join(F.transform(F.split(text, "\n"), one), "\n")


def clean_text(docs: DataFrame) -> DataFrame:
    """docs(id, text) cleaned: line ends alike, fenced code left alone but for its ends, other lines by `clean_lines`; at most
    one empty line in a row; trimmed. Row by row, without a shuffle: rows that share an id stay apart."""
    unix = F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n")
    # each part but the first begins with a fence, which opens code in the odd ones and closes it in the even ones
    parts = F.split(F.concat(F.lit("\n"), unix), rf"\n(?={BLANK}*```)")
    ends = lambda x: F.regexp_replace(x, rf"(?m){BLANK}+$", "")
    head = lambda x: F.substring_index(x, "\n", 1)
    rest = lambda x: F.substring(x, F.length(head(x)) + 1, F.length(x))
    done = F.transform(parts, lambda x, i: F.when(i == 0, clean_lines(x)).when(i % 2 == 1, ends(x)).otherwise(F.concat(ends(head(x)), clean_lines(rest(x)))))
    text = F.regexp_replace(F.array_join(done, "\n"), r"(?U)\n\s*\n\s*\n+", "\n\n")
    return docs.select("id", F.regexp_replace(text, r"(?U)^\s+|\s+$", "").alias("text"))


def grams(words: list[str], n: int) -> set[tuple]:
    """Distinct n-grams; fewer words are one, none give none."""
    return set(zip(*(words[i:] for i in range(n)), strict=False)) if len(words) >= n else {tuple(words)} if words else set()


def validate_extraction(pairs: DataFrame, n: int = 3) -> DataFrame:
    """id, coverage, hallucination, word_coverage, length_ratio, passed for pairs(id, raw, extracted), by distinct n-grams: texts are
    normalised where they are read, their sets compared in Arrow batches."""

    def measure(batches):
        share = lambda a, b: a / b if b else 0.0
        for b in batches:
            out = []
            for raw, got in zip(b.column("raw").to_pylist(), b.column("extracted").to_pylist(), strict=True):
                rw, gw = raw.split(), got.split()
                r, g, words = grams(rw, n), grams(gw, n), set(rw)
                both = len(r & g)
                out.append((share(both, len(r)), share(len(g) - both, len(g)), share(len(words & set(gw)), len(words)), share(len(gw), len(rw))))
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(x, pa.float64()) for x in (zip(*out, strict=True) if out else [[]] * 4))], names=["id", *MEASURES])

    kind = pairs.schema["id"].dataType.simpleString()
    texts = pairs.select("id", *[normalise_for_validation(F.col(c)).alias(c) for c in ("raw", "extracted")])
    out = texts.mapInArrow(measure, f"id {kind}, " + ", ".join(f"{m} double" for m in MEASURES)).select("id", *[F.round(m, 6).alias(m) for m in MEASURES])
    return out.withColumn("passed", (F.col("coverage") >= 0.85) & (F.col("hallucination") <= 0.20))


def pack_sentences(sentences: list[str], size: int, overlap: int) -> list[str]:
    """Sentences in chunks of at most `size` words, each beginning with the last sentences of the one before up to `overlap` words."""
    out, held, n = [], [], 0
    for s in sentences:
        k = len(s.split())
        if held and n + k > size:
            out.append(" ".join(held))
            back, m = [], 0
            for p in reversed(held):
                m += len(p.split())
                if m > overlap:
                    break
                back.insert(0, p)
            held, n = back, sum(len(p.split()) for p in back)
        held.append(s)
        n += k
    return [*out, " ".join(held)] if held else out


def chunk(docs: DataFrame, size: int = 1024, overlap: int = 200) -> DataFrame:
    """doc_id, chunk, text: sentence-aware chunks of docs(doc_id, text), words standing for tokens."""
    schema = StructType([docs.schema["doc_id"], StructField("chunk", IntegerType()), StructField("text", StringType())])
    arrow = to_arrow_schema(schema)

    def cut(batches):
        for b in (whole.slice(i, SLICE) for whole in batches for i in range(0, len(whole), SLICE)):
            rows = [(d, i, c) for d, t in enumerate(b.column("text").to_pylist()) for i, c in enumerate(pack_sentences([s for s in re.split(r"(?<=[.!?])\s+", t or "") if s], size, overlap))]
            row, nth, text = zip(*rows, strict=True) if rows else [()] * 3
            ids = b.column("doc_id").take(pa.array(row, pa.int64())).cast(arrow.field(0).type)
            yield pa.RecordBatch.from_arrays([ids, pa.array(nth, pa.int32()), pa.array(text, arrow.field(2).type)], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(cut, schema)

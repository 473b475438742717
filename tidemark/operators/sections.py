"""Section trees of documents: ids, parents, sizes, slices, and what to do with empty sections."""

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..functions.fuzzy import alike, any_anchor
from ..functions.text import parent_id, split_words, without_header
from ..session import stored


def build_tree(sections: DataFrame) -> DataFrame:
    """sections(doc_id, section_id, ord) with parent: the first section of the document with the id one part shorter."""
    first = sections.groupBy("doc_id", "section_id").agg(F.min("ord").alias("parent_ord")).withColumnRenamed("section_id", "parent")
    want = sections.withColumn("parent", parent_id(F.col("section_id")))
    return want.join(first, ["doc_id", "parent"], "left").withColumn("parent", F.when(F.col("parent_ord").isNotNull(), F.col("parent"))).drop("parent_ord")


def chunks_of_sections(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """doc_id, section_id, node_id, nth: the chunks of sections, numbered within them."""
    own = chunks.join(sections.select("doc_id", "section_id").distinct(), ["doc_id", "section_id"], "left_semi")
    return own.select("doc_id", "section_id", "node_id", F.row_number().over(Window.partitionBy("doc_id", "section_id").orderBy("node_id")).alias("nth"))


def rolled_up(sections: DataFrame) -> DataFrame:
    """doc_id, section_id, own, total: words of a section, and of all sections whose dotted ids begin with its own."""
    words = sections.groupBy("doc_id", "section_id").agg(F.sum(F.size(split_words(F.col("text")))).alias("own"))
    parts = F.split("section_id", r"\.")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    above = words.select("doc_id", F.explode(ups).alias("section_id"), F.col("own").alias("below"))
    total = above.groupBy("doc_id", "section_id").agg(F.sum("below").alias("total"))
    return words.join(total, ["doc_id", "section_id"])


def slices(text: DataFrame, starts: DataFrame) -> DataFrame:
    """doc_id, start, content: the text from each of starts(doc_id, start) to the next, the last to its end; then further columns of
    starts. A text meets the sorted array of its starts once, and rows stay where their text is."""
    more = [c for c in starts.columns if c not in ("doc_id", "start")]
    per = starts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", *more))).alias("at"))
    upto = F.concat(F.slice(F.col("at.start"), F.lit(2), F.size("at")), F.array(F.length("text") + 1))
    cut = text.join(per, "doc_id").select("doc_id", "text", F.explode(F.arrays_zip(F.col("at"), upto.alias("upto"))).alias("c"))
    start = F.col("c.at.start")
    return cut.select("doc_id", start.alias("start"), F.substring("text", start, F.greatest(F.col("c.upto") - start, F.lit(0))).alias("content"), *[F.col(f"c.at.{c}").alias(c) for c in more])


def merge_empty(sections: DataFrame, least: int = 80) -> DataFrame:
    """Sections(doc_id, ord, section_id, name, content) shorter than `least` go into the next long one if its id begins with that of the
    first short one before it, their names joined to its own by `: `; else they are dropped."""
    order = Window.partitionBy("doc_id").orderBy("ord")
    long_ = F.length(F.trim("content")) >= least
    # a short one belongs to the next long one: the number of long ones before it
    group = sections.withColumn("long", long_).withColumn("g", F.coalesce(F.sum(long_.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per = group.groupBy("doc_id", "g").agg(
        F.array_sort(F.collect_list(F.when(~F.col("long"), F.struct("ord", "section_id", "name")))).alias("short"),
        F.max(F.when(F.col("long"), F.struct("ord", "section_id", "name", "content"))).alias("s"),
    )
    kept = per.filter("s IS NOT NULL")
    joined = (F.size("short") > 0) & F.startswith(F.col("s.section_id"), F.col("short")[0]["section_id"])
    name = F.when(joined, F.concat_ws(": ", F.transform("short", lambda x: x["name"]), F.col("s.name"))).otherwise(F.col("s.name"))
    return kept.select("doc_id", F.col("s.ord").alias("ord"), F.col("s.section_id").alias("section_id"), F.coalesce(name, F.col("s.name")).alias("name"), F.col("s.content").alias("content"))


#: What heads a table of contents, in order of precedence; what its entries and the first heading after it look like; what a line
#: begins with when it is numbered or lettered; what may be a heading at all, with its line end (fixed values).
CONTENTS = [r"table\s+of\s+contents", r"\bcontents\b", r"\bindex\b"]
ENTRY = r"\s*\d+\.?\d*\s+[A-Z]"
HEAD = r"\s*([0-9][0-9.]*|[A-Z]\.)"
HEADING = r"\s*(\d+(?:\.\d+)*\.?\s+.+|[A-Z]\.\s+.+|[A-Z][A-Z0-9\-\s]{4,})"
#: Characters of a line, and of a section's name, that are looked at for a name; a heading is no longer.
LINE, NAME = 2000, 1000
#: Texts that a task turns into lines at once.
SLICE = 200


def lines_of(texts: DataFrame) -> DataFrame:
    """doc_id, start, line, head, heading, entry, contents, at of the lines of texts(doc_id, text) that are not empty, stored once for the
    searches below. start counts characters from 1; line is the first LINE of them; head the number or letter that it
    begins with; heading whether it may be one; entry whether it looks like one of a table of contents; contents which of CONTENTS it holds first, at where."""

    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = _parse_datatype_string(f"doc_id {kind}, start long, line string, head string, heading boolean, entry boolean, contents int, at long")
    arrow = to_arrow_schema(schema)

    def cut(batches):
        marks, entry, head, heading = [re.compile(p) for p in CONTENTS], re.compile(ENTRY), re.compile(HEAD), re.compile(HEADING)
        any_mark = re.compile("contents|index")
        for b in (whole.slice(i, SLICE) for whole in batches for i in range(0, len(whole), SLICE)):
            out = []
            for row, text in enumerate(b.column("text").to_pylist()):
                start = 1
                for line in (text or "").split("\n"):
                    if line and not line.isspace():
                        rank = at = None
                        low = line.lower()
                        if any_mark.search(low):
                            got = next(((i, m) for i, m in enumerate(x.search(low) for x in marks) if m), None)
                            rank, at = (got[0], start + got[1].start()) if got else (None, None)
                        h = head.match(line)
                        out.append((row, start, line[:LINE], h.group(1) if h else None, bool(heading.match(f"{line}\n")), bool(entry.match(line)), rank, at))
                    start += len(line) + 1
            row, *rest = zip(*out, strict=True) if out else [()] * 8
            docs = b.column("doc_id").take(pa.array(row, pa.int64())).cast(arrow.field(0).type)
            yield pa.RecordBatch.from_arrays([docs, *(pa.array(x, f.type) for x, f in zip(rest, list(arrow)[1:], strict=True))], schema=arrow)

    rows = texts.select("doc_id", "text").mapInArrow(cut, schema)
    return stored(rows, "lines")


def positions(lines: DataFrame, sections: DataFrame) -> DataFrame:
    """doc_id, ord, start: the numbered lines that begin with the prefix of sections(doc_id, ord, prefix), whatever follows it."""
    heads = lines.filter("head IS NOT NULL")
    begins = F.transform(F.sequence(F.lit(1), F.length("head")), lambda i: F.substring("head", F.lit(1), i))
    begun = heads.select("doc_id", "start", F.explode(begins).alias("prefix"))
    return begun.join(sections.select("doc_id", "ord", "prefix"), ["doc_id", "prefix"]).select("doc_id", "ord", "start")


#: From this likeness on a line is taken for a name (fixed value).
LEAST = 85


def named_lines(lines: DataFrame, sections: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, ord, start: the numbered lines that begin with the name of sections(doc_id, ord, name), case aside; for a name without
    such a line those that are alike to it, at least `least` of 100 by insertions and deletions. Lines and names meet by
    document and length band: of the lengths of two strings that are alike, neither is more than (200 - least) / least times the other.
    No more of a line moves than the longest name may ask for."""
    flat = lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))
    names = sections.select("doc_id", "ord", F.substring(F.trim(F.lower("name")), 1, NAME).alias("begin"), F.substring(flat(F.col("name")), 1, NAME).alias("name")).filter("name <> ''")
    names = stored(names, "names")
    longest, longest_flat = (n or 0 for n in names.agg(F.max(F.length("begin")), F.max(F.length("name"))).first())
    lines = lines.select("doc_id", "start", F.substring(F.ltrim(F.lower("line")), 1, longest).alias("begin"), flat(F.col("line")).alias("line")).filter("line <> ''")
    keys = F.array_distinct(F.array(*[F.substring("begin", 1, i) for i in (1, 2, 3)]))
    keyed = lines.select("doc_id", "start", F.col("begin").alias("text"), F.explode(keys).alias("key"))
    begun = keyed.join(names.withColumn("key", F.substring("begin", 1, 3)), ["doc_id", "key"]).filter(F.startswith(F.col("text"), F.col("begin")))
    begun = stored(begun.select("doc_id", "ord", "start"), "begun")

    step = math.log((200 - least) / least)
    band = lambda x: F.floor(F.log(F.length(x)) / step).cast("int")
    left = names.join(begun.select("doc_id", "ord").distinct(), ["doc_id", "ord"], "left_anti")
    near = left.withColumn("band", F.explode(F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: band("name") + i)))
    held = near.groupBy("doc_id", "band").agg(F.collect_list(F.struct("ord", "name")).alias("names"))  # of one document and length

    def matches(batches):
        import pandas as pd

        for b in batches:
            out = []
            for doc, start, line, asked in zip(b["doc_id"], b["start"], b["line"], b["names"], strict=True):
                ok = alike(line, [x["name"] for x in asked], least)
                out += [(doc, x["ord"], start) for x, yes in zip(asked, ok, strict=True) if yes]
            yield pd.DataFrame(out, columns=["doc_id", "ord", "start"])

    kind = lambda t, c: t.schema[c].dataType.simpleString()
    short = lines.filter(F.length("line") * least <= (200 - least) * longest_flat).select("doc_id", "start", "line")
    met = short.withColumn("band", band("line")).join(held, ["doc_id", "band"]).select("doc_id", "start", "line", "names")
    return begun.unionByName(met.mapInPandas(matches, f"doc_id {kind(lines, 'doc_id')}, ord {kind(names, 'ord')}, start {kind(lines, 'start')}"))


def contents_end(texts: DataFrame, lines: DataFrame, gap: int = 500, reach: int = 5000) -> DataFrame:
    """doc_id, toc_start, toc_end for texts whose lines hold such a head: the table of contents ends before the first numbered line
    after it that has over `gap` characters to the next one; without such a line `reach` characters on, or with the text."""
    heads = lines.filter("contents IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("contents", "at")).alias("h")).select("doc_id", F.col("h.at").alias("toc_start"))
    own = lines.filter("entry").select("doc_id", "start").join(heads, "doc_id").filter(F.col("start") >= F.col("toc_start"))
    own = own.withColumn("next", F.lead("start").over(Window.partitionBy("doc_id").orderBy("start")))  # the numbered lines of one text
    ends = own.groupBy("doc_id").agg(F.min(F.when(F.col("next") - F.col("start") > gap, F.col("start"))).alias("end"))
    whole = texts.select("doc_id", (F.length("text") + 1).cast("long").alias("after"))
    return heads.join(ends, "doc_id", "left").join(whole, "doc_id").select("doc_id", "toc_start", F.coalesce("end", F.least(F.col("toc_start") + reach, F.col("after"))).alias("toc_end"))


def outside(found: DataFrame, toc: DataFrame | None) -> DataFrame:
    """found(doc_id, start) without what lies in its document's table of contents."""
    if toc is None:
        return found
    inside = (F.col("start") >= F.col("toc_start")) & (F.col("start") < F.col("toc_end"))
    return found.join(toc, "doc_id", "left").filter(~F.coalesce(inside, F.lit(False))).drop("toc_start", "toc_end")


def proven(texts: DataFrame, found: DataFrame, anchors: DataFrame, reach: int = 800) -> DataFrame:
    """doc_id, ord, start: of found(doc_id, ord, start) the first with one of anchors(doc_id, ord, anchors) in the `reach` characters from
    it on, exactly or approximately; if none has, the first. A text meets the array of its candidates with their anchors once, and is
    looked at where it is."""
    asked = found.join(anchors.select("doc_id", "ord", "anchors"), ["doc_id", "ord"])
    per = asked.groupBy("doc_id").agg(F.collect_list(F.struct("ord", "start", "anchors")).alias("c"))
    windows = texts.join(per, "doc_id").select("doc_id", "text", F.explode("c").alias("c"))
    windows = windows.select("doc_id", "c.ord", "c.start", F.substring("text", F.col("c.start"), F.lit(reach)).alias("window"), "c.anchors")
    sure = windows.withColumn("sure", any_anchor(F.col("window"), F.col("anchors")))
    return sure.groupBy("doc_id", "ord").agg(F.coalesce(F.min(F.when(F.col("sure"), F.col("start"))), F.min("start")).alias("start"))


def located(texts: DataFrame, sections: DataFrame, toc: DataFrame | None = None, reach: int = 800, lines: DataFrame | None = None) -> DataFrame:
    """doc_id, ord, start for sections(doc_id, ord, name, prefix, anchor): where they begin, outside the table of contents. A section
    with a prefix begins at a line that begins with it; without one, or without such a line, at a line with its name
    or much like it. What proves a line is the section's own anchor or the next section's."""
    following = F.lead("anchor").over(Window.partitionBy("doc_id").orderBy("ord"))
    anchors = sections.select("doc_id", "ord", F.array_compact(F.array("anchor", following)).alias("anchors"))
    lines = lines_of(texts) if lines is None else lines
    by_id = stored(outside(positions(lines, sections.filter("prefix IS NOT NULL")), toc), "by_id")
    rest = sections.join(by_id.select("doc_id", "ord").distinct(), ["doc_id", "ord"], "left_anti")
    by_name = outside(named_lines(lines, rest), toc)  # few sections have no number
    return proven(texts, by_id.unionByName(by_name), anchors, reach)


def by_boundaries(texts: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contents and failures of texts(doc_id, text) cut by sections(doc_id, ord, name, prefix, anchor), tables of contents left out.

    Contents: doc_id, ord, section_id, name, content: located, cut from start to start, without the line of the heading and
    the space around; sections that are nearly empty are merged into the next. Failures: doc_id, expected, missing and error of
    every document with sections: no line that may be a heading (then it has no contents either), no name found, or over half not found."""
    lines = lines_of(texts)
    headed = lines.filter("heading").select("doc_id").distinct()
    starts = located(texts, sections, stored(contents_end(texts, lines), "contents"), lines=lines)
    starts = stored(starts.join(headed, "doc_id", "left_semi"), "starts")
    named = starts.join(sections.select("doc_id", "ord", F.coalesce("prefix", "name").alias("section_id"), "name"), ["doc_id", "ord"])
    last = named.groupBy("doc_id", "start").agg(F.max(F.struct("ord", "section_id", "name")).alias("s")).select("doc_id", "start", "s.*")  # of equal starts the others are empty
    flat = lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))
    whole = F.regexp_replace("content", r"^\s+|\s+$", "")
    titled = F.startswith(flat(F.substring_index("content", "\n", 1)), flat(F.col("name")))
    rest = F.when(F.contains("content", F.lit("\n")), F.substring("content", F.length(F.substring_index("content", "\n", 1)) + 2, F.length("content"))).otherwise("")
    own = slices(texts, last).withColumn("content", whole).filter("content <> ''").withColumn("content", F.when(titled, rest).otherwise(F.col("content")))
    own = own.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("start")) - 1)
    wanted = sections.filter("name <> ''").select("doc_id", "name").distinct().join(own.select("doc_id", "name", F.lit(1).alias("there")).distinct(), ["doc_id", "name"], "left")
    n, gone = F.count("*"), F.count_if(F.col("there").isNull())
    failures = wanted.groupBy("doc_id").agg(n.alias("expected"), gone.alias("missing")).join(headed.withColumn("headed", F.lit(True)), "doc_id", "left")
    error = F.when(F.col("headed").isNull(), "No heading candidates detected in document text").when(F.col("missing") == F.col("expected"), "Could not locate any section headings in document text")
    error = error.when(F.col("missing") / F.col("expected") > 0.5, F.concat(F.lit("Failed to extract "), F.col("missing").cast("string"), F.lit("/"), F.col("expected").cast("string"), F.lit(" sections")))
    return merge_empty(own.drop("start")), failures.select("doc_id", "expected", "missing", error.alias("error"))


def as_markdown(chunks: DataFrame) -> DataFrame:
    """doc_id, section_id, text for chunks(doc_id, section_id, title, level, nth, text): a heading as deep as the section's level, its
    source, then its chunks without their headers, in order; all indented by two spaces a level below the first."""
    indent = F.repeat(F.lit("  "), F.col("level") - 1)
    per = chunks.groupBy("doc_id", "section_id", "title", "level").agg(F.array_sort(F.collect_list(F.struct("nth", "text"))).alias("c"))
    body = F.transform("c", lambda x: F.concat(indent, without_header(x["text"]), F.lit("\n")))
    heading = F.concat(F.lit("\n"), indent, F.repeat(F.lit("#"), F.col("level") + 1), F.lit(" "), "section_id", F.lit(". "), "title")
    source = F.concat(indent, F.lit("[Source: "), "doc_id", F.lit(", Section "), "section_id", F.lit("]\n"))
    return per.select("doc_id", "section_id", F.array_join(F.concat(F.array(heading, source), body), "\n").alias("text"))

"""Benchmark decontamination (operator 3), with DataFrame functions only.

A positional inverted index over the words of all documents is stored: (term, document, position), for the terms that test
windows look up. Each window is looked up by its rarest terms, counted over all documents. A posting is moved back by its
term's offset in the item: (document, item, shift) says where the item would begin. Where as many lists of an item meet on
one shift as its windows ask for, the document's words and the item's are compared one by one, so matches are exact.
Terms that no window looks up are never asked for, so their lists are not kept. `proximity_matches` takes from such an index
the places where an item's rarest terms stand close together.

Joins on terms and documents are broadcast while the small side is counted at BROADCAST_ROWS rows or fewer; beyond that
they are shuffled, by term and a salt so that a frequent term is parted.

Defined results: a null text has no words; an item without words has no windows; rows that repeat a doc_id, or have none, are each
judged by their own text; equal windows of several items count for each; ties of counts go by term, then by place; an empty
table gives no rows; a very long text is one row of words like any other; other columns are ignored, or kept as they are by
`drop_contaminated`, whatever their names.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, table, unused, written

PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
A_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of a table that may be broadcast (about 100 bytes each), and salts of a shuffled join on terms.
BROADCAST_ROWS, SALTS = 200_000, 32


def words(text) -> Column:
    """Lower-cased (A-Z only) words of a text."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), A_Z, A_Z.lower()), PARTS), "")


def text_key() -> Column:
    """With doc_id it names a row; rows alike in both get the same results."""
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")


def small(rows: DataFrame) -> bool:
    """Whether a written table is proven small enough to broadcast."""
    return rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def by_term(rows: DataFrame, asked: DataFrame, how: str = "inner") -> DataFrame:
    """rows (of many documents) joined with asked on term."""
    if small(asked):
        return rows.join(F.broadcast(asked), "term", how)
    salted = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, ["term", "salt"], how).drop("salt")


def by_row(rows: DataFrame, part: DataFrame, how: str) -> DataFrame:
    """rows joined with part on doc_id (null too) and text_key; part's are left out."""
    d, t = unused("_d", rows, part), unused("_t", rows, part)
    part = part.withColumnsRenamed({"doc_id": d, "text_key": t})
    return rows.join(F.broadcast(part) if small(part) else part, rows["doc_id"].eqNullSafe(part[d]) & (rows["text_key"] == part[t]), how).drop(d, t)


def test_items(benchmark: DataFrame) -> DataFrame:
    """item_id, item (a hash of its words), w (its words) for each item that has words."""
    return benchmark.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0).select("item_id", F.xxhash64("w").alias("item"), "w").distinct()


def term_counts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """term, count: how often each asked term stands in docs."""
    every = docs.select(F.explode(words(F.col("text"))).alias("term"))
    if small(asked):
        return every.join(F.broadcast(asked), "term", "left_semi").groupBy("term").count()
    return every.groupBy("term").count().join(asked, "term", "left_semi")


def lookups(items: DataFrame, counts: DataFrame, n: int, rarest: int) -> DataFrame:
    """term, item, place, need: by which of its terms an item is looked up, so that each window holds `rarest` of them (all, if
    it has fewer); at least `need` of them lie in any window. Windows with a term that no document holds occur nowhere."""
    places = items.select("item", "w").distinct().select("item", F.size("w").alias("size"), F.posexplode("w").alias("place", "term"))
    known = places.join(counts, "term", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    starts = F.sequence(F.greatest(F.col("place") - n + 1, F.lit(0)), F.least("place", F.greatest(F.col("size") - n, F.lit(0))))
    inside = known.withColumn("start", F.explode(starts))
    order = Window.partitionBy("item", "start").orderBy("count", "term", "place")
    rank = inside.withColumn("rank", F.row_number().over(order)).withColumn("least", F.min("count").over(Window.partitionBy("item", "start")))
    chosen = rank.filter((F.col("least") > 0) & (F.col("rank") <= rarest))
    need = chosen.groupBy("item", "start").count().groupBy("item").agg(F.min("count").alias("need"))
    return chosen.select("term", "item", "place").distinct().join(need, "item")


def postings(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """The index of docs(doc_id, text) for the asked terms: term, doc_id, text_key, pos."""
    return by_term(docs.select("doc_id", text_key(), F.posexplode(words(F.col("text"))).alias("pos", "term")), asked, "left_semi")


def phrase_matches(docs: DataFrame, items: DataFrame, n: int = 10, rarest: int = 2) -> DataFrame:
    """doc_id, text_key, item, w, start, windows: for each place where an item would begin (it may lie before the document) the
    offsets in the item of its windows that the document holds there, exactly; written."""
    counts = written(term_counts(docs, written(items.select(F.explode("w").alias("term")).distinct(), "terms")), "counts")
    look = written(lookups(items, counts, n, rarest), "lookups")
    index = written(postings(docs, written(look.select("term").distinct(), "asked")), "index")
    # each list moved back by its term's place in the item: where an item's lists meet, it may begin
    moved = by_term(index, look).select("doc_id", "text_key", "item", "need", (F.col("pos") - F.col("place")).alias("start"))
    met = moved.groupBy("doc_id", "text_key", "item", "start").agg(F.count("*").alias("found"), F.min("need").alias("need")).filter("found >= need")
    texts = items.select("item", "w").distinct()
    met = written(met.select("doc_id", "text_key", "item", "start"), "met")
    # the words there, compared one by one
    some = by_row(docs.select("doc_id", text_key(), "text"), written(met.select("doc_id", "text_key").distinct(), "some"), "left_semi")
    there = by_row(some.select("doc_id", "text_key", words(F.col("text")).alias("words")), met, "inner")
    there = there.join(F.broadcast(texts) if small(texts) else texts, "item")
    same = F.transform("w", lambda x, i: F.coalesce(F.get("words", F.col("start") + i) == x, F.lit(False)))
    seen = there.select("doc_id", "text_key", "item", "w", "start", same.alias("same"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0)))
    windows = F.filter(starts, lambda s: ~F.array_contains(F.slice("same", s + 1, n), False))
    found = written(seen.select("doc_id", "text_key", "item", "w", "start", windows.alias("windows")).filter(F.size("windows") > 0).distinct(), "matches")
    dropped(counts, look, index, met)
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs."""
    items = written(test_items(benchmark), "items")
    matches = phrase_matches(docs, items, n)
    reach = F.least(F.size("w"), F.lit(n))
    at = F.flatten(F.transform("windows", lambda s: F.sequence(F.col("start") + s, F.col("start") + s + reach - 1)))
    covered = matches.select("doc_id", "text_key", F.explode(F.array_distinct(at)).alias("p")).groupBy("doc_id", "text_key").agg(F.count_distinct("p").alias("n_hit"))
    names = items.select("item", "w", F.col("item_id").cast("string").alias("name")).distinct()
    held = matches.select("doc_id", "text_key", "item", "w").distinct().join(F.broadcast(names) if small(names) else names, ["item", "w"])
    held = held.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("name")).alias("items"))
    rows = docs.select("doc_id", text_key(), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    for name, part in (("covered", covered), ("held", held)):
        rows = by_row(rows, written(part, name), "left")
    n_hit, held = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return rows.select("doc_id", "text_key", "n_words", n_hit.alias("n_hit"), F.size(held).cast("long").alias("n_items"), F.sha2(F.array_join(held, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The rows of docs, with all their columns, that hold no window of a test item."""
    matches = phrase_matches(docs.select("doc_id", "text"), written(test_items(benchmark), "items"), n)
    hit = written(matches.select("doc_id", "text_key").distinct(), "hit")
    d, t = unused("_d", docs), unused("_t", docs)
    p = hit.withColumnsRenamed({"doc_id": d, "text_key": t})
    here = docs["doc_id"].eqNullSafe(p[d]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == p[t])
    return docs.join(F.broadcast(p) if small(p) else p, here, "left_anti")


def proximity_matches(docs: DataFrame, benchmark: DataFrame, terms: int = 3, within: int = 20) -> DataFrame:
    """item_id, doc_id, start: places where the item's rarest terms (all that the documents hold, at most so many) stand
    within so many words, in any order; start is where the first of them stands."""
    w = benchmark.select("item_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    counts = term_counts(docs, written(w.select("term").distinct(), "terms"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("count", "term"))
    look = written(w.join(counts, "term").withColumn("rank", rank).filter(F.col("rank") <= terms).select("term", "item_id"), "near")
    need = look.groupBy("item_id").agg(F.count("*").alias("need"))
    index = written(postings(docs, written(look.select("term").distinct(), "asked")), "index")
    # a stretch of `within` words lies in a bucket and the next: each posting goes to both
    bucket = F.floor(F.col("pos") / within)
    spread = by_term(index, look).select("item_id", "doc_id", "text_key", "pos", "term", F.explode(F.array(bucket, bucket - 1)).alias("bucket"))
    near = Window.partitionBy("item_id", "doc_id", "text_key", "bucket").orderBy("pos").rangeBetween(0, within - 1)
    seen = spread.withColumn("terms", F.size(F.collect_set("term").over(near))).join(need, "item_id").filter("terms >= need")
    return seen.groupBy("item_id", "doc_id").agg(F.min("pos").alias("start"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


OP3_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS k FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dk AS (SELECT doc_id, n, unnest(list_transform(generate_series(1, len(w) - n + 1), lambda s: {'s': s, 'k': array_to_string(w[s:s + n - 1], ' ')})) AS x FROM d, sizes WHERE len(w) >= n),
m AS (SELECT doc_id, x.s AS s, dk.n AS n, win.item_id AS item_id FROM dk JOIN win ON win.n = dk.n AND win.k = x.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM m) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

"""Library administration: listings, counts, sync, statuses, duplicates, feedback."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import extension, form_title, safe_name, stem


def listing(files: DataFrame, nodes: DataFrame, extracted: DataFrame) -> DataFrame:
    """files(name, size) with chunk counts from nodes(name) and the status of extracted(name, error, sections)."""
    counts = nodes.groupBy("name").agg(F.count("*").alias("chunks"))
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("sections") > 0, "success").otherwise("not_extracted")
    out = files.join(counts, "name", "left").join(extracted, "name", "left")
    return out.select("name", "size", F.coalesce("chunks", F.lit(0)).alias("chunks"), status.alias("status"))


def sync_diff(current: DataFrame, snapshot: DataFrame) -> DataFrame:
    """name, change: new, deleted or modified (size or mtime differ) between a snapshot and now."""
    c, s = current.select("name", F.struct("size", "mtime").alias("now")), snapshot.select("name", F.struct("size", "mtime").alias("then"))
    both = c.join(s, "name", "full")
    change = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("then"), "modified")
    return both.select("name", change.alias("change")).filter(F.col("change").isNotNull())


def system_status(nodes: DataFrame, tenant: str) -> DataFrame:
    """Totals and those of a tenant, in one pass."""
    own = F.col("tenant_id") == tenant
    out = nodes.agg(F.count("*").alias("nodes"), F.count_distinct("doc_id").alias("docs"), F.count_if(own).alias("tenant_nodes"), F.count_distinct(F.when(own, F.col("doc_id"))).alias("tenant_docs"))
    return out.withColumn("status", F.when(F.col("nodes") == 0, "empty").when(F.col("tenant_nodes") == 0, "degraded").otherwise("ok"))


def feedback_report(feedback: DataFrame) -> DataFrame:
    """Satisfaction, calibration of confidence (of answers judged helpful or incorrect, at 75 and above, and below 60) and
    refinement, per cent, in one pass."""
    good, bad = F.col("feedback") == "helpful", F.col("feedback") == "incorrect"
    high, low = F.col("confidence_pct") >= 75, F.col("confidence_pct") < 60
    share = lambda a, b: F.round(100 * F.count_if(a) / F.greatest(F.count_if(b), F.lit(1)), 4)
    every = F.lit(True)
    return feedback.agg(
        F.count("*").alias("total"),
        share(good, every).alias("satisfaction"),
        share(bad, every).alias("incorrect"),
        F.count_if(high & good).alias("high_helpful"),
        F.count_if(high & bad).alias("high_incorrect"),
        F.count_if(low & good).alias("low_helpful"),
        F.count_if(low & bad).alias("low_incorrect"),
        share(high & bad, high & (good | bad)).alias("overconfident"),
        share(low & good, low & (good | bad)).alias("underconfident"),
        F.count_if("was_refined").alias("refined"),
        share(F.col("was_refined") & good, F.col("was_refined")).alias("refined_helpful"),
    )


def problem_queries(feedback: DataFrame, kind: str = "incorrect", n: int = 10) -> DataFrame:
    """The most confident answers with this feedback, later ones first among equals."""
    return feedback.filter(F.col("feedback") == kind).orderBy(F.desc("confidence_pct"), F.desc("created_at"), "id").limit(n)


def duplicate_stems(files: DataFrame) -> DataFrame:
    """Stems that several files have, with their extensions."""
    per = files.groupBy(stem(F.col("name")).alias("stem")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(extension(F.col("name")))), ",").alias("extensions"))
    return per.filter("n > 1")


def at_ranks(rows: DataFrame, key: str, value: str, ranks: DataFrame, cuts: int = 1000) -> DataFrame:
    """key, name, value: of each key's values in order the one at each of ranks(key, name, rank, lo, hi). The range of a key
    (lo to hi) is cut in parts of equal width; only the parts that hold a rank are put in order."""
    width = F.greatest((F.col("hi") - F.col("lo")) / cuts, F.lit(1e-300))
    spans = F.broadcast(ranks.select(key, "lo", "hi").distinct())
    parted = rows.join(spans, key).withColumn("part", F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(cuts)).cast("int"))
    per = parted.groupBy(key, "part").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(key).orderBy("part"))  # cuts + 1 rows a key
    held = per.withColumn("before", upto - F.col("n")).join(ranks.select(key, "name", "rank"), key).filter((F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("before") + F.col("n")))
    asked = held.select(key, "part", "name", (F.col("rank") - F.col("before")).alias("nth"))
    inside = parted.join(F.broadcast(asked.select(key, "part").distinct()), [key, "part"])
    counts = inside.groupBy(key, "part", value).agg(F.count("*").alias("m"))
    order = Window.partitionBy(key, "part").orderBy(value)
    placed = counts.withColumn("upto", F.sum("m").over(order))
    found = placed.join(F.broadcast(asked), [key, "part"]).filter((F.col("upto") >= F.col("nth")) & (F.col("upto") - F.col("m") < F.col("nth")))
    return found.select(key, "name", value)


def latency(times: DataFrame) -> DataFrame:
    """Statistics of times(stage, seconds) and each stage's share of all; median and p95 exactly, by counts of values."""
    per = times.groupBy("stage").agg(
        F.count("*").alias("n"),
        F.round(F.avg("seconds"), 6).alias("mean"),
        F.round(F.stddev_samp("seconds"), 6).alias("deviation"),
        F.min("seconds").alias("lo"),
        F.max("seconds").alias("hi"),
        F.sum("seconds").alias("total"),
    )
    n = F.col("n")
    places = {"below": F.floor((n + 1) / 2), "above": F.floor(n / 2) + 1, "p95": F.least(F.floor(n * 0.95) + 1, n)}
    ranks = per.select("stage", "lo", "hi", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.cast("long").alias("rank")) for k, v in places.items()])).alias("r")).select("stage", "lo", "hi", "r.*")
    found = at_ranks(times, "stage", "seconds", ranks).groupBy("stage").agg(*[F.max(F.when(F.col("name") == k, F.col("seconds"))).alias(k) for k in places])
    share = F.round(100 * F.col("total") / F.sum("total").over(Window.partitionBy(F.lit(0))), 4)  # one row a stage
    out = per.withColumn("share", share).join(found, "stage")
    return out.select("stage", "n", "mean", F.round((F.col("below") + F.col("above")) / 2, 6).alias("median"), F.round("p95", 6).alias("p95"), "deviation", F.round("lo", 6).alias("least"), F.round("hi", 6).alias("most"), "share")


def grouped_by_type(nodes: DataFrame) -> DataFrame:
    """doc_type, doc_id, title, nth: each type's documents (types in capitals), once each, in order of their titles: that of the first
    node, or the document's name; a form's title begins with its number. nodes(node_id, doc_id, doc_type, title, form_number)."""
    kind = F.upper(F.coalesce("doc_type", F.lit("UNCATEGORIZED")))
    one = nodes.filter("doc_id <> ''").groupBy(kind.alias("doc_type"), "doc_id").agg(F.min_by(F.struct("title", "form_number"), "node_id").alias("n"))
    title = F.coalesce(F.nullif(F.col("n.title"), F.lit("")), F.col("doc_id"))
    rows = one.select("doc_type", "doc_id", F.when(F.col("doc_type") == "FORM", form_title(F.col("n.form_number"), title)).otherwise(title).alias("title"))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("doc_type").orderBy("title", "doc_id")))


def recommendations(report: DataFrame) -> DataFrame:
    """Of feedback_report's row what it calls for, in order."""
    said = F.array_compact(F.array(
        F.when(F.col("overconfident") > 20, "raise_high_threshold"),
        F.when(F.col("underconfident") > 30, "lower_high_threshold"),
        F.when((F.col("refined_helpful") < 50) & (F.col("refined") > 5), "disable_refinement"),
        F.when(F.col("incorrect") > 15, "review_errors"),
    ))
    return report.select(F.posexplode(said).alias("nth", "recommendation"))


def extraction_summary(results: DataFrame) -> DataFrame:
    """succeeded, failed, total, rate of results(name, error); the reasons are rows of `extraction_failures`."""
    bad = F.col("error").isNotNull()
    return results.agg(F.count_if(~bad).alias("succeeded"), F.count_if(bad).alias("failed"), F.count("*").alias("total"), F.round(100 * F.count_if(~bad) / F.greatest(F.count("*"), F.lit(1)), 2).alias("rate"))


def extraction_failures(results: DataFrame) -> DataFrame:
    return results.filter("error IS NOT NULL").groupBy("error").agg(F.count("*").alias("n"))


#: Document types that need no coverage (fixed values).
EXEMPT = ["FORM", "CHECKLIST"]


def exempt(doc_type) -> F.Column:
    """Whether a document's coverage is not looked at: forms and checklists consist of empty fields."""
    return F.coalesce(F.upper(doc_type).isin(*EXEMPT), F.lit(False))


def document_metrics(files: DataFrame, texts: DataFrame, sections: DataFrame, chunks: DataFrame, extracted: DataFrame) -> DataFrame:
    """name, size, length, sections (top level), chunks, coverage (by n-grams, else by words, else 0), status for files(name, size):
    failed without a text, a tree or an extraction, low for a coverage under 0.85 that matters, else ok. texts(name, text),
    sections(name, section_id), chunks(name), extracted(name, doc_type, ngram_coverage, word_coverage)."""
    tops = sections.groupBy("name").agg(F.count_distinct(F.when(~F.contains("section_id", F.lit(".")), F.col("section_id"))).alias("sections"))
    length = texts.groupBy("name").agg(F.sum(F.length("text")).alias("length"))
    own = files.join(length, "name", "left").join(tops, "name", "left").join(chunks.groupBy("name").agg(F.count("*").alias("chunks")), "name", "left")
    own = own.join(extracted.withColumn("there", F.lit(True)), "name", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    coverage = F.coalesce("ngram_coverage", "word_coverage", F.lit(0.0))
    failed = F.col("there").isNull() | F.col("sections").isNull() | (n("length") == 0)
    status = F.when(failed, "failed").when(~exempt(F.col("doc_type")) & (coverage < 0.85), "low").otherwise("ok")
    return own.select("name", "size", n("length").alias("length"), n("sections").alias("sections"), n("chunks").alias("chunks"), coverage.alias("coverage"), status.alias("status"))


def extension_kinds(files: DataFrame) -> DataFrame:
    """How many stems have which set of extensions."""
    per = files.groupBy(stem(F.col("name")).alias("stem")).agg(F.array_join(F.array_sort(F.collect_set(extension(F.col("name")))), ",").alias("extensions"))
    return per.groupBy("extensions").agg(F.count("*").alias("stems"))


def listed(files: DataFrame, needle: str, doc_type: str | None, by: str, descending: bool = False) -> DataFrame:
    """Files whose name holds needle, of the type (case aside; files without one drop out), in order of a column: numbers as
    such, texts in lower case."""
    rows = files.filter(F.contains(F.lower("name"), F.lit(needle.lower())))
    if doc_type is not None:
        rows = rows.filter(F.upper("doc_type") == doc_type.upper())
    key = F.lower(by) if dict(files.dtypes)[by] == "string" else F.col(by)
    return rows.orderBy(key.desc() if descending else key.asc(), "name")


def cache_state(files: DataFrame, cached: DataFrame) -> DataFrame:
    """name, valid: a cached record counts while the time differs by less than a second and no error is in it."""
    both = files.join(cached.select("name", F.col("mtime").alias("then"), "error"), "name", "left")
    return both.select("name", F.coalesce((F.abs(F.col("mtime") - F.col("then")) < 1) & F.col("error").isNull(), F.lit(False)).alias("valid"))


#: Stages of processing (fixed values).
STAGES = ["parsing", "extraction", "validation", "embedding"]


def overall_status(states) -> F.Column:
    """failed if any stage failed, else warning if any warned, else success if all succeeded, else pending."""
    has = lambda x: F.array_contains(states, x)
    return F.when(has("failed"), "failed").when(has("warning"), "warning").when(F.forall(states, lambda s: s == "success"), "success").otherwise("pending")


def overlay(records: DataFrame, corrections: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """records with the corrections whose keys are present, nulls too. corrections(key, fields map)."""
    c = corrections.select(key, "fields")
    fixed = [F.when(F.map_contains_key(F.coalesce("fields", F.create_map().cast("map<string,string>")), F.lit(x)), F.col("fields")[x]).otherwise(F.col(x)).alias(x) for x in columns]
    rest = [x for x in records.columns if x not in columns]
    return records.join(c, key, "left").select(*rest, *fixed, F.col("fields").isNotNull().alias("has_corrections"))


def problem_documents(docs: DataFrame, sections: DataFrame, extracted: DataFrame, texts: DataFrame, most_tokens: int = 15_000, least_coverage: float = 0.85) -> DataFrame:
    """name, problems of docs(name): sections(name, section_id, tokens) over a size, each by its id, or none at all; extracted(name,
    doc_type, coverage, validation_error): none, low coverage, a validation error (what is said of coverage does not count for
    forms and checklists); no texts(name, text)."""
    large = F.array_sort(F.collect_list(F.when(F.col("tokens") > most_tokens, F.concat(F.lit("mega_section "), "section_id"))))
    trees = sections.groupBy("name").agg(large.alias("large"))
    own = docs.select("name").distinct().join(trees, "name", "left").join(extracted.withColumn("there", F.lit(True)), "name", "left")
    own = own.join(texts.filter("text <> ''").select("name").distinct().withColumn("read", F.lit(True)), "name", "left")
    free, none = exempt(F.col("doc_type")), F.array().cast("array<string>")
    about = F.contains(F.lower("validation_error"), F.lit("coverage"))
    there = F.col("there").isNotNull()
    found = F.array(
        F.when(F.col("large").isNull(), "no_tree"),
        F.when(~there, "no_extraction"),
        F.when(there & ~free & (F.coalesce("coverage", F.lit(0.0)) < least_coverage), "low_coverage"),
        F.when(there & (F.coalesce("validation_error", F.lit("")) != "") & ~(free & about), "validation_error"),
        F.when(F.col("read").isNull(), "no_text"),
    )
    problems = F.concat(F.coalesce("large", none), F.array_compact(found))
    return own.select("name", F.array_join(problems, ",").alias("problems")).filter("problems <> ''")


def checked_uploads(uploads: DataFrame, existing: DataFrame, allowed: list[str]) -> DataFrame:
    """uploads(raw) with name (the path's last part) and outcome: rejected, unsupported, duplicate of existing(name), accepted."""
    rows = uploads.withColumn("name", safe_name(F.col("raw"))).join(existing.select("name", F.lit(True).alias("_there")).distinct(), "name", "left")
    outcome = F.when(F.col("name").isNull(), "rejected").when(~extension(F.col("name")).isin(*allowed), "unsupported").when(F.col("_there"), "duplicate").otherwise("accepted")
    return rows.withColumn("outcome", outcome).drop("_there")


def to_process(changes: DataFrame, succeeded: DataFrame) -> DataFrame:
    """name: new and modified files, of those that succeeded."""
    wanted = changes.filter("change = 'new'").select("name").union(changes.filter("change = 'modified'").select("name")).distinct()
    return wanted.intersect(succeeded.select("name"))


def document_rows(nodes: DataFrame) -> DataFrame:
    """doc_id, nodes, title (of the last node), sections, mode for each document that has nodes."""
    per = nodes.groupBy("doc_id").agg(F.count("*").alias("nodes"), F.max_by("title", "node_id").alias("title"), F.count_distinct("section_id").alias("sections"))
    return per.withColumn("mode", F.when(F.col("nodes") > 0, "sync").otherwise("rebuild"))


def processing_mode(tenants: DataFrame, nodes: DataFrame, force: bool = False) -> DataFrame:
    """tenant_id, mode for tenants(tenant_id): sync where the tenant has rows of its own, else, or if forced, rebuild."""
    held = nodes.select("tenant_id").distinct().withColumn("held", F.lit(not force))
    return tenants.join(held, "tenant_id", "left").select("tenant_id", F.when(F.coalesce("held", F.lit(False)), "sync").otherwise("rebuild").alias("mode"))


def status_counts(rows: DataFrame, states) -> DataFrame:
    """status, n of rows by the overall status of their stages."""
    return rows.groupBy(overall_status(states).alias("status")).agg(F.count("*").alias("n"))


def effective_metadata(records: DataFrame, tenant: str) -> DataFrame:
    """What is shown of records(name, tenant_id, corrections map, sections array, and the fields): corrections over fields, the raw
    corrections, whether there are any, the owner (else the caller) and the number of sections."""
    fields = ["title", "doc_type", "form_number", "form_category_name", "category"]
    own = F.coalesce("corrections", F.create_map().cast("map<string,string>"))
    pick = {c: F.when(F.map_contains_key(own, F.lit(c)), own[c]).otherwise(F.col(c)) for c in fields}
    name = F.coalesce(F.nullif(pick["form_category_name"], F.lit("")), pick["category"])
    return records.select("name", *[pick[c].alias(c) for c in fields[:3]], name.alias("form_category_name"), own.alias("corrections"), (F.size(own) > 0).alias("has_corrections"), F.coalesce("tenant_id", F.lit(tenant)).alias("owner"), F.coalesce(F.size("sections"), F.lit(0)).alias("section_count"))


def with_owner(rows: DataFrame, owners: DataFrame, key: str = "doc_id") -> DataFrame:
    """node_id, owner: the tenant of the row's file, shared if it has none."""
    return rows.join(owners.select(key, "tenant_id"), key, "left").select("node_id", F.coalesce("tenant_id", F.lit("shared")).alias("owner"))


def reconciled(a: DataFrame, b: DataFrame, most: int) -> DataFrame:
    """left_rows, right_rows and whether two stores differ by more than `most`."""
    sides = a.select(F.lit(0).alias("side")).unionByName(b.select(F.lit(1).alias("side")))
    both = sides.agg(F.count_if(F.col("side") == 0).alias("left_rows"), F.count_if(F.col("side") == 1).alias("right_rows"))
    return both.withColumn("differs", F.abs(F.col("left_rows") - F.col("right_rows")) > most)


def first_owner(files: DataFrame) -> DataFrame:
    """name, tenant_id: under which tenant a file is found first."""
    return files.groupBy("name").agg(F.min("tenant_id").alias("tenant_id"))

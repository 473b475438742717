"""A question from analysis to ranked context, with model steps as hooks that default to rules."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import answer_block
from ..operators import retrieval as R
from ..operators.keyword_index import KeywordIndex
from ..session import stored

#: Nodes asked for by scope (fixed values).
TOP_K = {"focused": 20, "broad": 25, "too_broad": 20}


def top_k(scope) -> F.Column:
    """How many nodes a question of this scope asks for; null for an unknown one."""
    out = F.lit(None).cast("int")
    for name, n in TOP_K.items():
        out = F.when(scope == name, n).otherwise(out)
    return out


def by_rules(questions: DataFrame, most: int = 4) -> DataFrame:
    """query_id, nth, text: questions(query_id, text) in parts without a model: one for each question mark, at most so many; one without
    words stays whole."""
    parts = F.filter(F.transform(F.split("text", r"\?"), F.trim), lambda x: x != "")
    own = F.when(F.size(parts) > 0, F.slice(parts, 1, most)).otherwise(F.array("text"))
    return questions.select("query_id", F.posexplode(own).alias("nth", "text"))


def retrieve(nodes: DataFrame, vectors: DataFrame, question: str, vector: list[float], index: KeywordIndex, tenant: str | None = None, types: list[str] | None = None, k: int = 20) -> DataFrame:
    """Keyword and vector lists of what the tenant sees, fused: node_id, score, rank."""
    seen = R.filtered(nodes, tenant, types)
    return R.fuse(R.vector_top(seen, vectors, vector, k), index.top(question, k, tenant, types), n=k)


def context(ranked: DataFrame, nodes: DataFrame, n: int = 15, sources: int = 10) -> DataFrame:
    """query_id, context, sources for ranked(query_id, node_id, rank): the first n nodes' texts in one, and the documents of the first
    so many nodes, each once, in order."""
    rows = R.few(ranked.filter(F.col("rank") <= max(n, sources))).join(nodes.select("node_id", "text", "doc_id"), "node_id")
    parts = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text", "doc_id"))).alias("p"))  # of n nodes
    texts = F.transform(F.filter("p", lambda x: x["rank"] <= n), lambda x: x["text"])
    docs = F.transform(F.filter("p", lambda x: x["rank"] <= sources), lambda x: x["doc_id"])
    return parts.select("query_id", F.array_join(texts, "\n\n").alias("context"), F.array_distinct(docs).alias("sources"))


def joined_answers(parts: DataFrame) -> DataFrame:
    """query_id, answers, has_standard for the few parts(query_id, nth, label, text, is_standard) of each question: labelled blocks in
    order, with an empty line between."""
    block = answer_block(F.col("label"), F.col("text"), F.col("is_standard"))
    rows = parts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("nth", block.alias("block")))).alias("p"), F.max("is_standard").alias("has_standard"))
    return rows.select("query_id", F.array_join(F.transform("p", lambda x: x["block"]), "\n\n").alias("answers"), "has_standard")


def orchestrated(parts: DataFrame, nodes: DataFrame, vectors: DataFrame, counted: DataFrame, answer=None, k: int = 20) -> tuple[DataFrame, DataFrame]:
    """Answers to questions that were taken apart, for all of them in one go.

    parts(query_id, nth, text, vector, label, is_standard, and as they have them tenant, types, title, k). answer(text, context) is a
    column function, such as a model's Pandas UDF; without one a part's answer is the beginning of its context. The first
    table has for each part what was found: query_id, nth, label, is_standard, context, sources, pct, text (the answer); a part that
    finds nothing has an empty context and 0. The second has for each question: answers (labelled blocks, in order), has_standard,
    confidence_pct, level, weak (parts under 60), sources of all parts in order, each once."""
    key = F.concat_ws(":", F.col("query_id").cast("string"), F.col("nth").cast("string"))
    own = [c for c in ("tenant", "types", "title", "k") if c in parts.columns]
    asked = parts.select(key.alias("query_id"), "text", "vector", *own)
    ranked = stored(R.hybrid_each(nodes, vectors, asked, k, counted), "ranked")
    known = parts.select(key.alias("_part"), "query_id", "nth", F.col("text").alias("question"), "label", "is_standard")
    found = context(ranked, nodes).withColumnRenamed("query_id", "_part")
    sure = R.confidence(ranked, by="query_id").select(F.col("query_id").alias("_part"), F.col("confidence_pct").alias("pct"))
    rows = known.join(found, "_part", "left").join(sure, "_part", "left")
    rows = rows.withColumns({"context": F.coalesce("context", F.lit("")), "pct": F.coalesce("pct", F.lit(0)), "sources": F.coalesce("sources", F.array().cast("array<string>"))})
    said = F.substring("context", 1, 200) if answer is None else answer(F.col("question"), F.col("context"))
    each = stored(rows.select("query_id", "nth", "label", "is_standard", "context", "sources", "pct", said.alias("text")), "parts")
    order = F.array_sort(F.collect_list(F.struct("nth", "sources")))  # a question's few parts
    sources = each.groupBy("query_id").agg(F.array_distinct(F.flatten(F.transform(order, lambda x: x["sources"]))).alias("sources"))
    return each, joined_answers(each).join(R.overall_confidence(each, "query_id", "nth"), "query_id").join(sources, "query_id")

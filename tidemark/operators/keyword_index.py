"""Keyword search over a stored inverted index: postings (term, node, count) dealt by term, with tenant and type beside them."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import query_terms
from ..sources.logged import LoggedTable
from .retrieval import SHARED, keyword_top_each, postings, type_cases


class KeywordIndex:
    """Kept up as nodes change: all postings of a node are replaced, or go, together."""

    def __init__(self, spark: SparkSession, root: str, node_id: str = "bigint", buckets: int = 16):
        schema = f"term string, node_id {node_id}, tenant_id string, doc_type string, tf bigint"
        self.table = LoggedTable(spark, root, schema, "node_id", "term", buckets)

    def update(self, nodes: DataFrame | None, gone: DataFrame | None = None) -> int:
        """Puts in new and changed nodes, takes out gone(node_id). A changed node that has no words any more is taken out too."""
        if nodes is None:
            return self.table.append(None, gone)
        left = nodes.select("node_id") if gone is None else nodes.select("node_id").unionByName(gone.select("node_id"))
        return self.table.append(postings(nodes), keys=left)

    def rebuild(self, nodes: DataFrame) -> int:
        """All postings anew, in the base; how many nodes there are."""
        self.table.replace(postings(nodes))
        self.table.vacuum()
        return nodes.count()

    def top(self, question: str, k: int = 20, tenant: str | None = None, types: list[str] | None = None, title: str | None = None, titles: DataFrame | None = None) -> DataFrame:
        """node_id, score, rank for one question: only the buckets of its terms are read, and in them only its terms. A tenth of a
        point for each occurrence of a term. A title filter, by titles(node_id, title), comes after the first 2 k."""
        terms = self.table.spark.createDataFrame([(question,)], "text string").select(query_terms(F.col("text"))).first()[0]
        rows = self.table.read(self.table.buckets_of(terms) if terms else []).filter(F.col("term").isin(*terms))
        if tenant is not None:
            rows = rows.filter(F.col("tenant_id").isin(tenant, SHARED))
        if types:
            rows = rows.filter(F.col("doc_type").isin(*type_cases(types)))
        scored = rows.groupBy("node_id").agg(F.round(F.sum("tf") * 0.1, 6).alias("score"))
        best = scored.orderBy(F.desc("score"), "node_id").limit(2 * k if title else k)
        if title:
            named = F.broadcast(best).join(titles.select("node_id", "title"), "node_id")
            best = named.filter(F.contains(F.upper("title"), F.lit(title.upper()))).orderBy(F.desc("score"), "node_id").limit(k)
        return best.select("node_id", "score", F.row_number().over(Window.orderBy(F.desc("score"), "node_id")).alias("rank"))  # k rows

    def top_each(self, questions: DataFrame, k: int = 20, titles: DataFrame | None = None) -> DataFrame:
        """query_id, node_id, score, rank for all of questions(query_id, text, and as they have them tenant, types, title, k) at once."""
        return keyword_top_each(self.table.read(), questions, k, titles)

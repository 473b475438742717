"""The stored keyword indexes of the registered queries."""

from pyspark.sql import SparkSession

from .operators.keyword_index import KeywordIndex
from .session import nodes, scratch

QUESTION = "The (and) of?"
#: Terms of a text of a question in SQL: what is kept of each word, cut into tokens.
TERMS_SQL = """list_distinct(regexp_extract_all(lower(array_to_string(list_transform(regexp_split_to_array({}, '\\s+'), lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}.\\-]', '', 'g')), ' ')), '[\\p{{L}}\\p{{N}}]+'))"""
_INDEXES: dict = {}


def index_of(spark: SparkSession, sf: str) -> KeywordIndex:
    """The stored keyword index of a folder's nodes, built once in an application, as an ingestion does."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        index = KeywordIndex(spark, scratch(spark, "keyword", keep=True))
        index.rebuild(nodes(spark, sf))
        _INDEXES[key] = index
    return _INDEXES[key]

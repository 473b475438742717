"""Asking again in other words while an answer's confidence is low: a set of questions at a time."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Confidence from which a question is not asked again, and how often it is asked at most (fixed values).
ENOUGH, ATTEMPTS = 65, 3


def refined(questions: DataFrame, search: Callable[[DataFrame], DataFrame], rewrite: Callable[[DataFrame, int], DataFrame], enough: int = ENOUGH, attempts: int = ATTEMPTS) -> DataFrame:
    """query_id, attempt, attempts, text, confidence_pct: for each of questions(query_id, text) its best attempt, the first of equals,
    and how many were made.

    search(questions) gives query_id and confidence_pct (a question for which it has no row is at 0); rewrite(questions,
    attempt) gives query_id and text for those that are asked again; one that it does not rewrite is done. Questions leave as they
    reach `enough`, so each round asks only what is open; a round is one plan over all of them."""
    open_, made = questions.select("query_id", "text"), None
    for i in range(1, attempts + 1):
        found = open_.join(search(open_).select("query_id", "confidence_pct"), "query_id", "left")
        tried = stored(found.select("query_id", F.lit(i).alias("attempt"), "text", F.coalesce("confidence_pct", F.lit(0)).cast("int").alias("confidence_pct")), "attempts")
        made = tried if made is None else made.unionByName(tried)
        low = tried.filter(F.col("confidence_pct") < enough).select("query_id", "text")
        if i == attempts or low.isEmpty():
            break
        open_ = rewrite(low, i).select("query_id", "text")
    best = F.max_by(F.struct("attempt", "text", "confidence_pct"), F.struct("confidence_pct", -F.col("attempt")))
    return made.groupBy("query_id").agg(best.alias("b"), F.max("attempt").alias("attempts")).select("query_id", "b.attempt", "attempts", "b.text", "b.confidence_pct")

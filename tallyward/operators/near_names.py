"""The closest known name of each word, for lists of any length: a symmetric-delete index.

Two words within ``limit`` edits have a string in common that both reach by deleting at most ``limit`` characters. So both
sides list what is left after such deletions, equal strings meet in an equi-join, and the edit distance of the pairs that
meet is computed exactly. No word is compared with the whole list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 2


def _one_less(word: Column) -> Column:
    """Each string that is left of ``word`` without one of its characters; none of an empty word."""
    n = F.length(word)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))


def deletions(word: Column, limit: int = LIMIT) -> Column:
    """The word and all strings that are left after deleting up to ``limit`` of its characters, each once."""
    every = level = F.array(word)
    for _ in range(limit):
        level = F.array_distinct(F.flatten(F.transform(level, _one_less)))
        every = F.array_union(every, level)
    return every


def nearest_names(words: DataFrame, names: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Rows (word, near): for each different ``word`` the other ``name`` with 1 to ``limit`` edits; ties go to the smaller name.

    Words without such a name, and null words and names, have no row. A word longer than every name by more than ``limit``
    cannot be near one and is not listed.
    """
    known = names.select("name").filter(F.col("name").isNotNull()).distinct()
    longest = known.agg(F.max(F.length("name"))).scalar()
    asked = words.select("word").filter(F.length("word") <= longest + limit).distinct()
    left = asked.select("word", F.explode(deletions(F.col("word"), limit)).alias("rest"))
    right = known.select("name", F.explode(deletions(F.col("name"), limit)).alias("rest"))
    met = left.join(right, "rest").filter(F.col("word") != F.col("name")).select("word", "name").distinct()
    edits = F.levenshtein("word", "name", limit)
    return (
        met.withColumn("edits", edits).filter(F.col("edits").between(1, limit))
        .groupBy("word").agg(F.min(F.struct("edits", "name"))["name"].alias("near"))
    )

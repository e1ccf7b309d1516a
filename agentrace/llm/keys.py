"""Row keys and joins shared by the operators.

A row of a document table is known by its id and a hash of its text, so two rows that share an id
but not a text stay apart, and repeated rows get the same result. Ids and texts may be null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("doc_id", "text_hash")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, text_hash, text; a null text becomes the empty one."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select(
        "doc_id", F.xxhash64("text").alias("text_hash"), "text"
    )


def null_safe(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join where nulls of the key columns are equal; the key columns are those of the left."""
    other = {c: f"_right_{c}" for c in on}
    right = right.withColumnsRenamed(other)
    match: Column = reduce(
        lambda a, b: a & b, (left[c].eqNullSafe(right[other[c]]) for c in on)
    )
    joined = left.join(right, match, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*other.values())

"""Whole rows under a hashed key, and texts packed for the way through a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from zstandard import ZstdCompressor, ZstdDecompressor

from agentrace.llm.batches import fields, map_slices

ROW = ("row1", "row2")


def row_keys(id_col: str, text_col: str):
    """128 hashed bits of an id and a text (a null text as the empty one), never null."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return [F.xxhash64(F.lit(seed), F.col(id_col), text).alias(k) for seed, k in enumerate(ROW)]


def rows_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns row1, row2, doc_id, text; equal rows have equal keys."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        *row_keys(id_col, text_col), F.col(id_col).alias("doc_id"), text.alias("text")
    )


def packed_texts(source: DataFrame) -> DataFrame:
    """``rows_of`` with the compressed text in place of the text."""
    schema = fields(source, *ROW, "doc_id", packed="binary")

    def pack(batch):
        squeeze = ZstdCompressor(level=3).compress
        columns = {name: batch.column(name) for name in (*ROW, "doc_id")}
        columns["packed"] = [squeeze(t.encode()) for t in batch.column("text").to_pylist()]
        return columns

    return map_slices(source, pack, schema, "text")


def unpacked(batch) -> list[bytes]:
    expand = ZstdDecompressor().decompress
    return [expand(p) for p in batch.column("packed").to_pylist()]

"""Nested JSON: canonical text, leaves with RFC 6901 pointers, pointer resolution."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def canonical(docs: pd.Series) -> pd.Series:
    """Compact JSON with sorted keys at every level; NULL for text that is not JSON.

    Key order inside nested values has no built-in function.
    """

    def one(text):
        try:
            return json.dumps(json.loads(text), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        except (TypeError, ValueError):
            return None

    return docs.map(one)


def leaves(df: DataFrame, doc: str, keys: list[str], max_depth: int | None = None) -> DataFrame:
    """(keys…, pointer, value) of every scalar leaf, through one recursive Arrow batch function.

    Documents are processed independently and rows stream out per batch. A null document and text
    that is not JSON give one row, whose pointer and value are NULL.
    """

    def walk(value, pointer):
        stack = [(value, pointer)]
        while stack:
            node, at = stack.pop()
            if isinstance(node, dict):
                stack.extend(
                    (v, f"{at}/{k.replace('~', '~0').replace('/', '~1')}") for k, v in reversed(node.items())
                )
            elif isinstance(node, list):
                stack.extend((v, f"{at}/{i}") for i, v in reversed(list(enumerate(node))))
            else:
                yield at, json.dumps(node, ensure_ascii=False)

    def read(text):
        try:
            return walk(json.loads(text), "")
        except (TypeError, ValueError):
            return [(None, None)]

    def batches(frames):
        for frame in frames:
            out = [
                (*row[:-1], pointer, value)
                for row in frame[[*keys, doc]].itertuples(index=False)
                for pointer, value in read(row[-1])
            ]
            yield pd.DataFrame(out, columns=[*keys, "pointer", "value"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)
    return df.select(*keys, doc).mapInPandas(batches, f"{fields}, pointer string, value string")


def resolve_pointer(doc: Column, pointer: str) -> Column:
    """Value at an RFC 6901 pointer, as text; NULL when nothing is there."""
    if pointer == "":
        return doc
    path = "$"
    for part in pointer.lstrip("/").split("/"):
        part = part.replace("~1", "/").replace("~0", "~")
        path += f"[{part}]" if part.isdigit() else f"['{part}']"
    return F.get_json_object(doc, path)

"""Turning computed arrays into rows.

For a plain ``explode`` or ``inline`` the optimizer adds a filter on the size of the array, and a
computed array is then evaluated twice. The outer forms are exempt; the one NULL row of an empty
array is dropped behind the generator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_once(df: DataFrame, array: Column, name: str, *carry) -> DataFrame:
    return df.select(*carry, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def inline_once(df: DataFrame, array: Column, present: str, *carry) -> DataFrame:
    """``present`` is a field that is never NULL in the array's structs."""
    return df.select(*carry, F.inline_outer(array)).filter(F.col(present).isNotNull())

"""Lookup joins: one row per key on the lookup's side."""

from __future__ import annotations

from pyspark.sql import DataFrame


class Lookup:
    """A keyed lookup table, one row per key.

    The join carries no hint and is the same for every size: Spark broadcasts a lookup that it measures to be
    small, and otherwise splits the fact's partitions of a busy key at run time (adaptive skew join), where a
    left join lets the fact's side be split.
    """

    def __init__(self, df: DataFrame, keys: list[str]):
        self.df = df
        self.keys = keys

    def attach(self, fact: DataFrame, how: str = "left") -> DataFrame:
        """Join on the lookup's key names. ``how`` is left, inner, left_semi or left_anti."""
        return fact.join(self.df, self.keys, how)

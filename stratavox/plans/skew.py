"""Joins with a table of groups whose sizes are known: large groups meet their rows by a broadcast of proven size, the others by a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group with more than this part of all rows is large; there are fewer large groups than this.
SHARE = 4096


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], n: str, keep_all: bool = False) -> DataFrame:
    """rows joined with the groups (keys, n rows each, more columns); with keep_all, rows without a group stay.

    Both should be cuts, as they are read several times. Keys must not be null, and one row of groups stands for each key.
    """
    total = groups.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    large = F.broadcast(groups.where(F.col(n) * SHARE > total))  # at most SHARE rows, as sizes add up to the total
    rest = rows.join(F.broadcast(large.select(*keys)), keys, "left_anti").join(groups.where(F.col(n) * SHARE <= total), keys, "left" if keep_all else "inner")
    return rows.join(large, keys).unionByName(rest)

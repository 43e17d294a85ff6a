"""Joins between job tables.

Hot keys need no code here: adaptive execution splits skewed partitions of inner and left joins from
measured sizes, and picks a broadcast only where the measured side is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(links: DataFrame, seen: list[DataFrame], key: str = "url") -> DataFrame:
    """Distinct links not in any of the seen tables. Both sides are reduced to keys first."""
    keys = None
    for table in seen:
        part = table.select(key).where(F.col(key).isNotNull()).distinct()
        keys = part if keys is None else keys.union(part)
    wanted = links.select(key).distinct()
    return wanted if keys is None else wanted.join(keys.distinct(), key, "left_anti")

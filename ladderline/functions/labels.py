"""Small classifications."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def result(own: Column, other: Column) -> Column:
    return F.when(own > other, "W").when(own < other, "L").otherwise("D")


def signed(change: Column) -> Column:
    """+n, = or -n."""
    text = change.cast("string")
    return F.when(change > 0, F.concat(F.lit("+"), text)).when(change == 0, "=").when(change < 0, text)


def movement(old_rank: Column, new_rank: Column) -> Column:
    """Lower rank numbers are better."""
    return F.when(new_rank < old_rank, "IMPROVED").when(new_rank > old_rank, "dropped").otherwise("unchanged")

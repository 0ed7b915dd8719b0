"""First and last rows of a group without sorting the rows.

An extreme over fixed-width numbers is a hash aggregation; one over texts or structs would sort all
rows by group. So the extreme number comes first, and other columns are taken from the few rows that
reach it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladderline.session import side

_WIDE = "decimal(38,0)"
_PER_INSTANT = 10 ** 19
_PER_SOURCE = 2 * 10 ** 18


def order_number(within: str | None = None) -> Column:
    """Match order (ts, src_rank, ord, and `within`, 0 or 1) as one number of fixed width.

    Holds for four sources (src_rank 0 to 3), ords below 10^18 and instants within 30,000 years of 1970.
    """
    last = F.col(within) if within else F.lit(0)
    low = F.col("src_rank").cast("long") * _PER_SOURCE + F.col("ord") * 2 + last
    return (F.unix_micros("ts").cast(_WIDE) * F.lit(str(_PER_INSTANT)).cast("decimal(20,0)") + low.cast(_WIDE)).cast(_WIDE)


def rows_at(rows: DataFrame, groups: DataFrame, key: str, reached: Column, label: str) -> DataFrame:
    """Rows of `rows` with their group's figures, where `reached` holds.

    `groups` has one row per `key` and is the side that is built.
    """
    return rows.join(side(groups, label), key).where(reached)

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def joined_in_order(order: Column, text: Column, separator: str = "") -> Column:
    """An aggregate: the texts joined by ``order``; null texts are left out."""
    rows = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct(order.alias("o"), text.alias("t")))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), separator)

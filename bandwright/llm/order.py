"""Row numbers over whole tables without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwright.llm.store import written


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` as a written table with ``name``: 0, 1, 2... in the given order.

    One range sort; each row's place in its partition plus the rows of the
    partitions before it, of which there is one number a partition. Rows that
    agree in ``order`` share a partition, so it should end in a column that
    tells rows apart.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    table = written(spread, "numbered")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    before, at = [(-1, 0)], 0
    for row in table.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row for each partition
        before.append((row.part, at))
        at += row["count"]
    offsets = df.sparkSession.createDataFrame(before, "_part int, _before long")
    return table.join(F.broadcast(offsets), part == F.col("_part")).withColumn(name, F.col("_before") + place).drop("_at", "_part", "_before")

"""Pages where groups decide how they flow: a group on a new page, and records a page by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwright.operators import breaks, present


def flowed(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], per_page: int | str, name: str = "page_no", in_group: str = "page_of_group") -> DataFrame:
    """Rows with their page where each group starts one, and their page within the group.

    ``order`` is of the report and keeps groups together; ``per_page`` is a number
    or a column that is the same within a group. The pages of the groups before
    come from a scan over one row a group, a row's page in its group from its number:
    a group of any size is dealt over tasks.
    """
    records = F.lit(per_page) if isinstance(per_page, int) else F.col(per_page)
    rows = present.numbered(df, order, "_no")
    groups = rows.groupBy(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group))).agg(F.min("_no").alias("_start"), F.ceil(F.count("*") / F.max(records)).cast("long").alias("_pages"))
    groups = breaks.running(groups, "_pages", "_upto", ["_start"])
    joined = rows.join(groups, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)])
    page = F.floor((F.col("_no") - F.col("_start")) / records)
    joined = joined.withColumn(in_group, (page + 1).cast("int")).withColumn(name, (page + F.col("_upto") - F.col("_pages") + 1).cast("int"))
    return joined.drop("_no", "_start", "_pages", "_upto", *(f"_g{i}" for i in range(len(group))))

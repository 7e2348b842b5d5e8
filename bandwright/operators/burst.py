"""Distribution: a report cut by recipient, resent safely."""

from __future__ import annotations

from collections.abc import Sequence
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwright.plans.model import ReportDef


MOST_TASKS = 20_000


def is_burst(report: ReportDef) -> bool:
    """Whether a report is made for distribution: by its parameters, or a formula or trigger that makes the file name."""
    names = {p.name.upper() for p in report.params}
    return bool(names & {"P_AS_PATH", "P_DISTRIBUTE"}) or any("P_AS_PATH" in x.body.upper() for x in (*report.formulas, *report.triggers))


def is_drill_through(report: ReportDef, forwarded: Sequence[str]) -> bool:
    """A linked child rather than a burst: another report forwards its parameters."""
    return bool({p.name.upper() for p in report.params} & {f.upper() for f in forwarded})


def burst_key(columns: Sequence[str], file_formula: str = "", params: Sequence[str] = ()) -> str:
    """The column the report is cut by: one the file name uses, else an id, number or key, else a name, else the first."""
    own = [c for c in columns if not re.match(r"(?i)(CF|CP|CS)_", c) and c.upper() not in {p.upper() for p in params}]
    used = [m.upper() for m in re.findall(r"[:<&]([A-Za-z_]\w*)", file_formula)]
    for c in own:
        if c.upper() in used:
            return c
    for pattern in (r"(?i)_(ID|NUM|KEY)$|^(ID|NUM|KEY)$|(?i:key)$", r"(?i)NAME"):
        for c in own:
            if re.search(pattern, c):
                return c
    return own[0]


def file_name(template: str, columns: Sequence[str]) -> Column:
    """A file name from literals and <COLUMN> tokens."""
    known = {c.lower(): c for c in columns}
    parts, at = [], 0
    for m in re.finditer(r"<([A-Za-z_]\w*)>", template):
        if m[1].lower() in known:
            parts += [F.lit(template[at : m.start()]), F.coalesce(F.col(known[m[1].lower()]).cast("string"), F.lit(""))]
            at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def recipients(rows: DataFrame, people: DataFrame, key: str, person_key: str, address: str) -> DataFrame:
    """One row a key with its address; keys without one are marked and never sent (fail closed)."""
    keys = rows.where(F.col(key).isNotNull()).select(key).distinct()
    joined = keys.join(people.select(F.col(person_key).alias("_k"), F.col(address).alias("address")), F.col(key) == F.col("_k"), "left").drop("_k")
    return joined.withColumn("can_send", F.col("address").isNotNull() & (F.length(F.trim("address")) > 0))


def pending(keys: DataFrame, history: DataFrame, key: str, tries: int = 3) -> DataFrame:
    """Keys that history has neither delivered nor given up on."""
    over = history.groupBy(key).agg(F.bool_or("delivered").alias("_done"), F.count("*").alias("_tries")).where(F.col("_done") | (F.col("_tries") >= tries))
    return keys.join(over.select(key), key, "left_anti")


def write(rows: DataFrame, path: str, key: str, format: str = "parquet", name: Column | None = None, rows_per_file: int = 1_000_000) -> DataFrame:
    """A folder of files a key, and their manifest: (key, file_name, n_rows, n_files), read from what was written.

    ``name`` is the file name that the report's template gives a key. A key of more
    than ``rows_per_file`` rows is dealt over as many tasks, by a hash of
    the row, so that no task writes a key alone. Rows without a key are not written.
    """
    rows = rows.where(F.col(key).isNotNull())
    sized = rows.groupBy(key).agg(F.count("*").alias("_n"), F.min(name if name is not None else F.col(key).cast("string")).alias("file_name"))
    parts = sized.select(F.col(key).alias("_k"), F.ceil(F.col("_n") / rows_per_file).alias("_parts"))
    dealt = rows.withColumn("_row", F.xxhash64("*", F.monotonically_increasing_id())).join(parts, F.col(key) == F.col("_k"))
    dealt = dealt.withColumn("_part", F.pmod("_row", "_parts")).drop("_k", "_row", "_parts")
    tasks = min(parts.agg(F.sum("_parts")).first()[0] or 1, MOST_TASKS)
    dealt.repartition(int(tasks), key, "_part").drop("_part").write.option("maxRecordsPerFile", rows_per_file).partitionBy(key).format(format).save(path)
    spark = rows.sparkSession
    written = spark.read.format(format).load(path) if format == "parquet" else spark.read.format(format).schema(rows.schema).load(path)
    files = written.select(key, F.input_file_name().alias("_file")).groupBy(key, "_file").count().groupBy(key).agg(F.sum("count").alias("n_rows"), F.count("*").alias("n_files"))
    return files.join(sized.select(F.col(key).alias("_k"), "file_name"), F.col(key) == F.col("_k").cast(files.schema[key].dataType)).select(key, "file_name", "n_rows", "n_files")

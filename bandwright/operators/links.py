"""Master-detail links: lookups and lists as joins, whatever the key's number of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType
from pyspark.sql.window import Window

from bandwright.operators.present import fixed

Pairs = Sequence[tuple[str, str]]


def _left(master: DataFrame, child: DataFrame, pairs: Pairs, null_safe: bool = False) -> DataFrame:
    """A left join on the pairs, without the child's key columns; NULL meets NULL only if ``null_safe``."""
    child = child.withColumnsRenamed({c: f"_k{i}" for i, (_, c) in enumerate(pairs)})
    same = Column.eqNullSafe if null_safe else Column.__eq__
    keys = [same(F.col(f"_m.{m}"), F.col(f"_k{i}")) for i, (m, _) in enumerate(pairs)]
    joined = master.alias("_m").join(child, keys, "left")
    return joined.drop(*(f"_k{i}" for i in range(len(pairs))))


def _keyed(child: DataFrame, pairs: Pairs) -> list[Column]:
    return [F.col(c) for _, c in pairs]


def lookup(master: DataFrame, child: DataFrame, pairs: Pairs, values: dict[str, str], order: Sequence[str]) -> DataFrame:
    """The first child row's values for each master row, NULL if there is none.

    ``order`` decides what is first; the values break its ties. One aggregation
    (with partial sums on the map side) and one join.
    """
    fields = [*order, *(v for v in values.values() if v not in order)]
    first = child.groupBy(*_keyed(child, pairs)).agg(F.min(F.struct(*fields)).alias("_first"))
    picked = first.select(*(c for _, c in pairs), *(F.col(f"_first.{v}").alias(n) for n, v in values.items()))
    return _left(master, picked, pairs)


def lookup_list(master: DataFrame, child: DataFrame, pairs: Pairs, value: str, name: str, order: Sequence[str], separator: str = "\n") -> DataFrame:
    """All child values in order as one text, NULL if there is none."""
    listed = child.groupBy(*_keyed(child, pairs)).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("string").alias("_v")))).alias("_l"))
    listed = listed.select(*(c for _, c in pairs), F.nullif(F.array_join(F.transform("_l", lambda x: x["_v"]), separator), F.lit("")).alias(name))
    return _left(master, listed, pairs)


def lookup_count(master: DataFrame, child: DataFrame, pairs: Pairs, name: str) -> DataFrame:
    counted = child.groupBy(*_keyed(child, pairs)).agg(F.count("*").alias(name))
    return _left(master, counted, pairs).withColumn(name, F.coalesce(name, F.lit(0)))


def subtotal(master: DataFrame, child: DataFrame, pairs: Pairs, aggregate: Column, name: str) -> DataFrame:
    """An aggregate over each master row's child rows, computed before the join."""
    return _left(master, child.groupBy(*_keyed(child, pairs)).agg(aggregate.alias(name)), pairs)


def merged(master: DataFrame, child: DataFrame, pairs: Pairs, aggregates: dict[str, Column], shown: dict[str, Column], null_safe: bool = False) -> DataFrame:
    """All that master rows show of their details, from one aggregation of the child and one join.

    ``aggregates`` are computed for each key under the names given; ``shown``
    are the columns that the master gets, from expressions over these names.
    """
    keys = [F.col(c).alias(f"_c{i}") for i, (_, c) in enumerate(pairs)]
    summed = child.groupBy(*keys).agg(*(a.alias(f"_a{i}") for i, a in enumerate(aggregates.values())))
    summed = summed.withColumnsRenamed({f"_a{i}": f"_v_{n}" for i, n in enumerate(aggregates)})
    return shows(master, summed, [(m, f"_c{i}") for i, (m, _) in enumerate(pairs)], shown, null_safe)


def shows(master: DataFrame, summed: DataFrame, pairs: Pairs, shown: dict[str, Column], null_safe: bool = False) -> DataFrame:
    """The master rows with columns made from one row a key, whose other columns go again."""
    keys = {c for _, c in pairs}
    return _left(master, summed, pairs, null_safe).withColumns(shown).drop(*(c for c in summed.columns if c not in keys))


def hops(master: DataFrame, chain: Sequence[tuple[DataFrame, Pairs, dict[str, str], Sequence[str]]]) -> DataFrame:
    """Lookups one after the other; each may use what the one before found."""
    for child, pairs, values, order in chain:
        master = lookup(master, child, pairs, values, order)
    return master


def first_fetch(master: DataFrame, child: DataFrame, pairs: Pairs, value: str, name: str, order: Sequence[Column]) -> DataFrame:
    """What a single-fetch cursor reads: the largest value among the child rows that come first in ``order``."""
    window = Window.partitionBy(*_keyed(child, pairs)).orderBy(*order)
    first = child.withColumn("_r", F.rank().over(window)).where("_r = 1").groupBy(*_keyed(child, pairs)).agg(F.max(value).alias(name))
    return _left(master, first, pairs)


def range_join(left: DataFrame, right: DataFrame, keys: Pairs, at: str, low: str, high: str) -> DataFrame:
    """Rows of the right side in force at the left side's time; the keys make it an equi-join with a range filter."""
    condition = [left[a] == right[b] for a, b in keys] + [left[at] >= right[low], left[at] <= right[high]]
    return left.join(right, condition)


def _number(c: Column, kind: str) -> Column:
    """A value of an ordered type as a double that grows with it."""
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return (F.unix_date(c) if kind == "date" else c).cast("double")


def interval_join(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, keys: Pairs = (), high_is_open: bool = False) -> DataFrame:
    """Rows of both sides where ``low <= at <= high`` (``at < high`` if open), each pair once; NULL bounds have no end.

    Without an equality key this would be a nested loop. Here an interval gets
    the bin width that is its length rounded up to a power of two, so it
    covers two or three bins, and a point has one bin of each width that there
    is (about fifty at most, found by one small query): an equi-join on (width, bin) whose
    candidates are at most a few times the pairs where points are dense, then the exact
    filter. Large bins are split by the skew join. Equality ``keys`` join too.
    """
    kind = dict(points.dtypes)[at]
    bounds = points.agg(F.min(at).alias("a"), F.max(at).alias("b")).first()
    if bounds.a is None:
        return points.crossJoin(intervals).where("false")
    a, b = (_number(F.lit(x), kind) for x in (bounds.a, bounds.b))
    from_, to = (F.coalesce(_number(intervals[c], dict(intervals.dtypes)[c]), end) for c, end in ((low, a), (high, b)))
    from_, to = F.greatest(from_, a), F.least(to, b)
    levelled = intervals.withColumn("_lo", from_).withColumn("_hi", to).where("_lo <= _hi")
    levelled = levelled.withColumn("_level", F.when(F.col("_hi") > F.col("_lo"), F.ceil(F.log2(F.col("_hi") - F.col("_lo")))).otherwise(-20).cast("int"))
    widths = [r[0] for r in levelled.select("_level").distinct().collect()]  # one for each power of two
    if not widths:
        return points.crossJoin(intervals).where("false")
    width = lambda c: F.pow(F.lit(2.0), c)
    bin_ = lambda v, c: F.floor(v / width(c))
    binned = levelled.withColumn("_bin", F.explode(F.sequence(bin_(F.col("_lo"), F.col("_level")), bin_(F.col("_hi"), F.col("_level")))))
    placed = points.withColumn("_plevel", F.explode(F.array(*(F.lit(w) for w in widths))))
    placed = placed.withColumn("_pbin", bin_(_number(F.col(at), kind), F.col("_plevel")))
    inside = F.coalesce(placed[at] >= binned[low], F.lit(True)) & F.coalesce(placed[at] < binned[high] if high_is_open else placed[at] <= binned[high], F.lit(True))
    on = [placed[x] == binned[y] for x, y in keys]
    joined = placed.join(binned, [F.col("_plevel") == F.col("_level"), F.col("_pbin") == F.col("_bin"), placed[at].isNotNull(), inside, *on])
    return joined.drop("_plevel", "_pbin", "_level", "_bin", "_lo", "_hi")


def adds_up(df: DataFrame, column: str) -> bool:
    """Whether sums of a column are exact, so that one is the difference of two others."""
    kind = df.schema[column].dataType
    return isinstance(kind, IntegralType) or isinstance(kind, DecimalType) and kind.precision <= 24


def are_ordered_alike(*kinds: str) -> bool:
    """Whether values of these types compare with each other as they do in one column of their common type."""
    numbers = all(k.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal") for k in kinds)
    return numbers or set(kinds) <= {"date", "timestamp_ntz"} or set(kinds) <= {"date", "timestamp"}


def _measures(rows: DataFrame, at: str, sums: Sequence[str]) -> DataFrame:
    """The place ``_x`` of each row, ``_n`` = 1, and for each summed column ``_n{i}``, whether it has a value, and ``_s{i}``, which."""
    out = [F.col(at).alias("_x"), F.lit(1).cast("bigint").alias("_n")]
    for i, c in enumerate(sums):
        kind = rows.schema[c].dataType
        out.append(F.col(c).isNotNull().cast("bigint").alias(f"_n{i}"))
        if adds_up(rows, c):
            out.append(F.coalesce(F.col(c), F.lit(0)).cast(f"decimal(27,{kind.scale if isinstance(kind, DecimalType) else 0})").alias(f"_s{i}"))
    return rows.select(*out)


def _prefix_sums(measured: DataFrame, asked: DataFrame, nulls_last: bool = False) -> DataFrame:
    """For each distinct ``_x`` of ``asked`` the sums over all rows up to it as the struct ``upto``, over those before it as ``below``.

    Rows of one place are added up before the sort, so that none is a large
    task; then a range sort, a window over each partition, and one row a
    partition for what the partitions before it have.
    """
    kinds = {n: f"decimal(37,{k.scale})" if isinstance(k := measured.schema[n].dataType, DecimalType) else "bigint" for n in measured.columns if n != "_x"}
    zeros = asked.select("_x").distinct().select("_x", *(F.lit(0).cast(measured.schema[n].dataType).alias(n) for n in kinds), F.lit(True).alias("_asked"))
    steps = measured.withColumn("_asked", F.lit(False)).unionByName(zeros).groupBy("_x").agg(*(F.sum(n).cast(k).alias(n) for n, k in kinds.items()), F.max("_asked").alias("_asked"))
    ordered = fixed(steps.orderBy(F.col("_x").asc_nulls_last() if nulls_last else F.col("_x").asc_nulls_first()))
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy("_p").agg(*(F.sum(n).alias(n) for n in kinds))
    parts = parts.select(F.col("_p").alias("_q"), *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).cast(k).alias(f"_b{n}") for n, k in kinds.items()))
    inner = Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ordered.select("*", *(F.sum(n).over(inner).cast(k).alias(f"_r{n}") for n, k in kinds.items())).where("_asked")
    summed = summed.join(F.broadcast(parts), F.col("_p") == F.col("_q"))  # a row for each partition
    upto = {n: (F.col(f"_r{n}") + F.col(f"_b{n}")).cast(k) for n, k in kinds.items()}
    below = {n: (u - F.col(n)).cast(kinds[n]) for n, u in upto.items()}
    return summed.select("_x", *(F.struct(*(c.alias(n) for n, c in x.items())).alias(name) for name, x in (("upto", upto), ("below", below))))


def _between(rows: DataFrame, sums: Sequence[str], more: str, less: str) -> list[Column]:
    """``_n``, and for each summed column ``_count{i}`` and ``_sum{i}``: what the struct ``more`` of prefix sums has over ``less``, in the types of count and sum."""
    over = lambda n: F.col(f"{more}.{n}") - F.col(f"{less}.{n}")
    out = [over("_n").alias("_n")]
    for i, c in enumerate(sums):
        kind = rows.schema[c].dataType
        wide = f"decimal({kind.precision + 10},{kind.scale})" if isinstance(kind, DecimalType) else "bigint"
        out.append(over(f"_n{i}").alias(f"_count{i}"))
        if adds_up(rows, c):
            out.append(F.when(over(f"_n{i}") > 0, over(f"_s{i}").cast(wide)).alias(f"_sum{i}"))
    return out


def _not_reversed(intervals: DataFrame, low: str, high: str) -> DataFrame:
    return intervals.where(F.coalesce(F.col(low) <= F.col(high), F.lit(True)))


def totals_of_intervals(intervals: DataFrame, points: DataFrame, at: str, low: str, high: str, sums: Sequence[str] = (), high_is_open: bool = False) -> DataFrame:
    """The intervals that hold a point, with ``_n`` points and the ``_count{i}`` and ``_sum{i}`` of the points' columns ``sums``.

    What ``interval_join`` pairs, added up without the pairs, of which there may
    be as many as the product of both sides: what is up to an interval's end
    less what is before its start. ``_sum{i}`` only for a column that ``adds_up``.
    """
    intervals, measured = _not_reversed(intervals, low, high), _measures(points.where(F.col(at).isNotNull()), at, sums)
    starts = _prefix_sums(measured, intervals.select(F.col(low).alias("_x"))).select(F.col("_x").alias("_start"), F.col("below").alias("_less"))
    ends = _prefix_sums(measured, intervals.select(F.col(high).alias("_x")), nulls_last=True).select(F.col("_x").alias("_end"), F.col("below" if high_is_open else "upto").alias("_more"))
    found = intervals.join(starts, F.col(low).eqNullSafe(F.col("_start"))).join(ends, F.col(high).eqNullSafe(F.col("_end")))
    return found.select(*(F.col(c) for c in intervals.columns), *_between(points, sums, "_more", "_less")).where("_n > 0")


def totals_at_points(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, sums: Sequence[str] = (), high_is_open: bool = False) -> DataFrame:
    """The distinct points within an interval, with ``_n`` intervals and the ``_count{i}`` and ``_sum{i}`` of the intervals' columns ``sums``.

    As ``totals_of_intervals``: the intervals that start up to a point less those that end before it.
    """
    intervals, asked = _not_reversed(intervals, low, high), points.select(F.col(at).alias("_x")).where("_x IS NOT NULL").distinct()
    begun = _prefix_sums(_measures(intervals, low, sums), asked).select(F.col("_x").alias("_begin"), F.col("upto").alias("_more"))
    ended = _prefix_sums(_measures(intervals, high, sums), asked, nulls_last=True).select(F.col("_x").alias("_end"), F.col("upto" if high_is_open else "below").alias("_less"))
    found = asked.join(begun, F.col("_x") == F.col("_begin")).join(ended, F.col("_x") == F.col("_end"))
    return found.select(F.col("_x").alias(at), *_between(intervals, sums, "_more", "_less")).where("_n > 0")


def infer_pairs(master: DataFrame, child_binds: Sequence[str], declared: Pairs = ()) -> list[tuple[str, str]]:
    """Declared pairs that both sides have; else master columns that the child names as binds."""
    names = {c.upper(): c for c in master.columns}
    valid = [(names[m.upper()], c) for m, c in declared if m.upper() in names]
    return valid or [(names[b.upper()], names[b.upper()]) for b in child_binds if b.upper() in names]

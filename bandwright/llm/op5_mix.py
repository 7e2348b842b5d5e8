"""Mixing sources to target weights, in DataFrame operations only.

1. Words of each document are counted once into a thin table. The documents of
   a source, in a pseudorandom order, form one stream of words that is cut into
   blocks of ``block`` words (prefix sums over buckets, so no source is one task).
2. Targets: weights share ``share`` of all words; a target stops at ``repeats``
   times its source and the excess is reshared by weight (water filling).
3. Every output shard draws its source counts from the multinomial of the
   targets, one hashed draw a slot. A source's slots are numbered through the
   shards; those beyond its target stay empty, and what the draws leave short
   of it fills closing shards.
4. Slot j of a source in pass j div N takes block perm(j mod N) of its N blocks,
   where perm is a keyed swap-or-not permutation of [0, N). The last slot takes
   only the words that the target still wants.
5. Slots and the documents' pieces are joined by (source, block).

So a pass takes each block once, no document is taken more than ``repeats``
times, a source's words differ from its target by less than one, and reruns
agree. The source list has one row a source and is small.

Defined results: ids may be of any type; a null or empty text has size 0 and takes 0; a null source is
a source of its own and comes last; rows that share an id are separate
documents (equal rows are interchangeable); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bandwright.llm.store import written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
BLOCK = 512
SHARD_SLOTS = 1024
BUCKETS = 4096
SLOTS_PER_TASK = 8192
MOST_TASKS = 32768
ROUNDS = 16
PRIME = 2147483647
WORD = r"[^\x20\x09-\x0D]+"


def _hash(x: str, a: int, b: int, c: int) -> str:
    """A value in [0, PRIME) for the SQL integer x."""
    y = f"pmod({x}, {PRIME})"
    return f"pmod(pmod(pmod({y} * {y}, {PRIME}) * {a}, {PRIME}) + pmod({y} * {b}, {PRIME}) + {c}, {PRIME})"


ORDER_KEY = (48271, 69621, 11)
DRAW_KEY = (16807, 39373, 5)


def permuted(x: str, n: str, source: str, turn: str, inverse: bool = False) -> Column:
    """The image of x under the keyed permutation of [0, n) for a source and pass (swap-or-not rounds)."""
    key = f"pmod({_hash(f'{source} * 7919 + {turn} * 104729 + r * 1299709', 40692, 52774, 29)}, {n})"
    other = f"pmod({key} - x, {n})"
    bit = f"{_hash(f'greatest(x, {other}) + r * 15485863', 45991, 22695, 17)} >= {PRIME // 2}"
    rounds = f"sequence({ROUNDS - 1}, 0)" if inverse else f"sequence(0, {ROUNDS - 1})"
    return F.expr(f"aggregate({rounds}, cast({x} as bigint), (x, r) -> if({bit}, {other}, x))")


def order_key(df: DataFrame, id_col: str) -> Column:
    """The pseudorandom place of a row in its source's stream; ids that are no whole numbers count by a hash of their text."""
    whole = dict(df.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint")
    number = f"`{id_col}`" if whole else f"xxhash64(cast(`{id_col}` as string))"
    return F.expr(_hash(f"coalesce(cast({number} as bigint), -1)", *ORDER_KEY))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, rank, source_size, target) from (source, source_size): water filling by weight."""
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(ordered).cast("long") - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    fill = Window.orderBy(F.col("source_size") * REPEATS / F.col("weight"), "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * SHARE - F.coalesce(F.sum(F.col("source_size") * REPEATS).over(before), F.lit(0))) / F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    levelled = ranked.withColumn("weight", weight).withColumn("level", level)
    target = F.least((F.col("source_size") * REPEATS).cast("double"), F.max("level").over(everything) * F.col("weight"))
    return levelled.select("source", "rank", "source_size", target.alias("target"))


def quotas(sources: DataFrame, block: int) -> DataFrame:
    """For each source: blocks, words of the last block, full passes, words of the last pass, slots."""
    plan = sources.where("source_size > 0").selectExpr("rank", "source_size", f"(source_size + {block - 1}) div {block} as n", f"pmod(source_size - 1, {block}) + 1 as last", f"least(cast(floor(target + 0.5D) as bigint), {REPEATS} * source_size) as words")
    plan = plan.selectExpr("*", "words div source_size as passes", "words - (words div source_size) * source_size as rest")
    plan = plan.withColumn("short_at", permuted("n - 1", "n", "rank", "passes", inverse=True))
    some = f"(rest + {block - 1}) div {block}"
    return plan.withColumn("slots", F.expr(f"passes * n + if(short_at >= {some}, {some}, (rest + {block} - last + {block - 1}) div {block})"))


def mix(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, slots, pieces).

    documents: id, source rank, size, source_size, target. slots: the mix, one
    row a slot (shard, rank, block, words). pieces: the documents' words of each
    block (rank, block, low, high), keyed by the row's start in its source.
    """
    spark = df.sparkSession
    sized = written(df.select(F.col(id_col).alias("id"), F.col(source).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    sources = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "sources")
    plan = written(quotas(sources, block), "quotas")

    placed = sized.join(sources.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named"))).drop("source", "named")
    placed = placed.withColumn("k", order_key(placed, "id")).withColumn("bucket", F.expr(f"k div {PRIME // BUCKETS + 1}"))
    inner = Window.partitionBy("rank", "bucket").orderBy("k", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("rank", "bucket").agg(F.sum("size").alias("total")).select("rank", "bucket", F.coalesce(F.sum("total").over(outer), F.lit(0)).alias("offset"))
    documents = placed.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(offsets, ["rank", "bucket"]).withColumn("start", F.col("offset") + F.col("within"))
    documents = documents.select("id", "rank", "size", "source_size", "target", "start")

    spread = documents.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    pieces = spread.selectExpr("*", f"greatest(start - block * {block}, 0) as low", f"least(start + size - block * {block}, {block}) as high")

    total = plan.agg(F.sum("slots")).first()[0] or 0
    upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    cell = PRIME // 4096 + 1
    chance = plan.select("rank", "slots", F.sum("slots").over(upto).alias("to")).selectExpr("rank", f"cast((to - slots) * {PRIME}D / {max(total, 1)} as bigint) as lo", f"cast(to * {PRIME}D / {max(total, 1)} as bigint) as hi")
    chance = chance.where("hi > lo").withColumn("cell", F.explode(F.expr(f"sequence(lo div {cell}, (hi - 1) div {cell})")))
    draws = spark.range(total).selectExpr(f"id div {SHARD_SLOTS} as shard", f"{_hash(_hash('id', *DRAW_KEY), *ORDER_KEY)} as u").withColumn("cell", F.expr(f"u div {cell}"))
    counts = draws.join(chance, "cell").where("u >= lo and u < hi").groupBy("rank", "shard").count().withColumn("part", F.expr(f"shard div {SHARD_SLOTS}"))
    counts = written(counts, "draws")
    parts = counts.groupBy("rank", "part").agg(F.sum("count").alias("n")).select("rank", "part", F.coalesce(F.sum("n").over(Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    inner = Window.partitionBy("rank", "part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    drawn = counts.withColumn("within", F.coalesce(F.sum("count").over(inner), F.lit(0))).join(parts, ["rank", "part"]).selectExpr("rank", "shard", "offset + within as first", "count")
    closing = plan.join(counts.groupBy("rank").agg(F.sum("count").alias("got")), "rank", "left").selectExpr("rank", f"{total} div {SHARD_SLOTS} + 1 + rank as shard", "coalesce(got, 0) as first", "slots - coalesce(got, 0) as count")
    ranges = drawn.unionByName(closing).join(plan, "rank").withColumn("end", F.expr("least(first + count, slots)")).where("first < end")
    ranges = ranges.repartition(min(MOST_TASKS, total // SLOTS_PER_TASK + 1), "rank", "shard")  # few thin rows become many slots: dealt out by slots
    slots = ranges.withColumn("j", F.explode(F.expr("sequence(first, end - 1)"))).selectExpr("*", "j div n as turn", "pmod(j, n) as q")
    slots = slots.withColumn("block", permuted("q", "n", "rank", "turn"))
    slots = slots.withColumn("full", F.expr(f"if(block = n - 1, last, {block})"))
    slots = slots.withColumn("words", F.expr(f"if(turn < passes, full, least(full, rest - (q * {block} - if(q > short_at, {block} - last, 0))))"))
    return documents, slots.select("shard", "rank", "block", "words"), pieces


def mixed(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(id, size, source_size, target, taken) for every row."""
    documents, slots, pieces = mix(df, id_col, text, source)
    hits = pieces.join(slots.select("rank", "block", "words").hint("merge"), ["rank", "block"], "left")  # both sides grow with the input
    took = hits.groupBy("rank", "start", "id", "size", "source_size", "target").agg(F.sum(F.expr("greatest(least(coalesce(words, 0), high) - low, 0)")).alias("taken"))
    none = documents.where("size = 0").select("id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return took.select("id", "size", "source_size", "target", "taken").unionByName(none).withColumnRenamed("id", id_col)

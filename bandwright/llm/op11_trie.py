"""The prefix trie of conversations by the Euler-tour technique.

Conversations are rebuilt: conversation c begins with the first h turns of
conversation ``c - c % FAMILY`` (h is a hash of c modulo ``HEADS``), then has its
own turns from number h + 1 on. Each distinct sequence of first d turns is a
node; the members of a node are the conversations that begin with it.

1. Turns get their number in the conversation from one range sort over all
   turns, so that a conversation of any length is dealt over tasks. A sequence
   of turns is known by 128 bits: two exclusive-ors of the hashes of (turn,
   number), running over pieces of ``PIECE`` turns with the earlier pieces' value.
   A node's parent is that value without the last turn's hash.
2. One aggregation a node gives its members' count, smallest member and so on. The
   nodes are numbered in (parent, node) order by a range sort, so children of one
   parent are neighbours, however many they are.
3. Every node has an enter and an exit arc. The arc after enter is the first
   child's enter or the own exit; the arc after exit is the next sibling's enter or
   the parent's exit.
4. ``list_rank`` ranks the tour: each round removes arcs with coin 1 after an arc
   with coin 0 (about a quarter of all, no two of them neighbours) and adds their
   weights to the arc before; the last ``LOCAL`` arcs are ranked in one task; the
   removed ones then get their place from the arc before, in reverse. Rows shrink
   by a quarter a round, so all rounds cost about four times the first; every round is a
   written table.
5. A node's leaves and savings are the prefix sum at its exit arc less the one
   at its enter arc: a maximum and a minimum over the two.

The ids that end at a node are hashed by reading them in order, piece by
piece: the hash of a node is one task's work, its memory is a piece.

Defined results: a null role or text is empty; turns with the same number are
taken in the order of their hashes; rows without a conversation id are left
out; a conversation without turns after rebuilding ends at the root; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bandwright.llm.order import numbered
from bandwright.llm.store import written

FAMILY = 100
HEADS = 6
PIECE = 1 << 14
LOCAL = 1 << 16


def _numbered_turns(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, d, a, b, size): each turn's number in its conversation, its 128-bit hash and length."""
    role_, text_ = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (role, text))
    digest = F.md5(F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_))
    half = lambda at: (F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long")
    rows = df.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("c"), F.col(turn).alias("turn"), half(1).alias("a"), half(17).alias("b"), F.length(text_).cast("long").alias("size"))
    placed = numbered(rows, [F.col("c"), F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")], "n")
    starts = placed.groupBy("c").agg(F.min("n").alias("start"))
    return placed.join(starts, "c").select("c", (F.col("n") - F.col("start") + 1).alias("d"), "a", "b", "size")


def rebuilt(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((c, d, a, b, size) of every rebuilt turn, (c, length) of every conversation)."""
    turns = written(_numbered_turns(df, conv, turn, role, text), "turns")
    sizes = turns.groupBy("c").agg(F.max("d").alias("own"))
    family = F.col("c") - F.col("c") % FAMILY
    convs = sizes.withColumns({"first": family, "h": (F.crc32(F.col("c").cast("string").cast("binary")) % HEADS).cast("long")})
    convs = convs.join(sizes.where(F.col("c") % FAMILY == 0).select(F.col("c").alias("first"), F.col("own").alias("theirs")), "first", "left")
    convs = convs.withColumn("head", F.least("h", F.coalesce("theirs", F.lit(0))))
    convs = written(convs.select("c", "first", "h", "head", (F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    heads = turns.where((F.col("c") % FAMILY == 0) & (F.col("d") < HEADS)).withColumnRenamed("c", "first")
    heads = convs.select("c", "first", "head").join(heads, "first").where("d <= head").select("c", "d", "a", "b", "size")
    tails = turns.join(convs.select("c", "h", "head"), "c").where("d > h").select("c", (F.col("d") - F.col("h") + F.col("head")).alias("d"), "a", "b", "size")
    return heads.union(tails), convs.select("c", "length")


def prefixes(turns: DataFrame) -> DataFrame:
    """(c, d, p, q, up, uq, size): the 128 bits of the first d turns, and of the first d - 1."""
    terms = written(turns.select("c", "d", "size", F.floor(F.col("d") / PIECE).alias("piece"), F.xxhash64("a", "d", "b").alias("x"), F.xxhash64("b", "a", "d", F.lit(1)).alias("y")), "terms")
    by_piece = terms.groupBy("c", "piece").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    earlier = Window.partitionBy("c").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # one row a piece
    before = by_piece.select("c", "piece", F.bit_xor("x").over(earlier).alias("bx"), F.bit_xor("y").over(earlier).alias("by")).where("piece > 0")
    running = Window.partitionBy("c", "piece").orderBy("d")
    rows = terms.select("*", F.bit_xor("x").over(running).alias("rx"), F.bit_xor("y").over(running).alias("ry")).join(before, ["c", "piece"], "left")
    p, q = (F.col(f"r{k}").bitwiseXOR(F.coalesce(f"b{k}", F.lit(0))) for k in "xy")
    return rows.select("c", "d", p.alias("p"), q.alias("q"), p.bitwiseXOR(F.col("x")).alias("up"), q.bitwiseXOR(F.col("y")).alias("uq"), "size")


NODE = ("d", "p", "q")


def end_hashes(ends: DataFrame) -> DataFrame:
    """(d, p, q, ends_sha256) of the nodes that conversations end at, from rows (d, p, q, c)."""
    placed = numbered(ends, [*map(F.col, NODE), F.col("c")], "n")
    pieces = placed.groupBy(*NODE, F.floor(F.col("n") / PIECE).alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key == node:
                    state.update(b"," + ids.encode())
                else:
                    if state is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256(ids.encode())
            yield _rows(out)
        if state is not None:
            yield _rows([(*node, state.hexdigest())])

    ordered = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece").select(*NODE, "piece", "ids")
    return ordered.mapInArrow(digest, "d long, p long, q long, ends_sha256 string")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [[]] * 4
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*NODE, "ends_sha256"])


def list_rank(arcs: DataFrame, weights: Sequence[str], local: int = LOCAL) -> DataFrame:
    """(arc, weights): for each arc of a list (arc, next, weights), the sums of the weights of all arcs before it.

    ``next`` is null for the last arc; arcs are longs and need not be dense.
    """
    arcs, rounds, n = written(arcs.select("arc", "next", *weights), "arcs"), [], 0
    coin = lambda x: F.xxhash64(x, F.lit(n)) % 2 == 0
    while arcs.count() > local:
        n += 1
        pairs = arcs.where(coin(F.col("arc")) & ~coin(F.col("next"))).select(F.col("next").alias("arc"), F.col("arc").alias("y"), *(F.col(w).alias(f"y_{w}") for w in weights))
        gone = written(pairs.join(arcs, "arc"), "gone")
        rounds.append(gone.select("arc", "y", *(F.col(f"y_{w}").alias(w) for w in weights)))
        over = gone.select(F.col("y").alias("arc"), F.lit(True).alias("over"), F.col("next").alias("far"), *(F.col(w).alias(f"x_{w}") for w in weights))
        kept = arcs.join(gone.select("arc"), "arc", "left_anti").join(over, "arc", "left")
        arcs = written(kept.select("arc", F.when(F.col("over"), F.col("far")).otherwise(F.col("next")).alias("next"), *((F.col(w) + F.coalesce(f"x_{w}", F.lit(0))).alias(w) for w in weights)), "arcs")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), None) if (batches := list(batches)) else None
        if table is None or not len(table):
            return
        arc = table["arc"].to_numpy()
        where = dict(zip(arc.tolist(), range(len(arc)), strict=True))
        after = [where.get(x, -1) for x in table["next"].to_pylist()]
        first = set(range(len(arc))) - set(after)
        order, at = [], first.pop() if first else -1
        while at >= 0:
            order.append(at)
            at = after[at]
        sums = [np.cumsum(table[w].to_numpy()[order]) - table[w].to_numpy()[order] for w in weights]
        yield pa.RecordBatch.from_arrays([pa.array(arc[order]), *map(pa.array, sums)], ["arc", *weights])

    ranks = arcs.repartition(1).mapInArrow(rank, f"arc long, {', '.join(f'{w} long' for w in weights)}")  # at most ``local`` rows
    for gone in reversed(rounds):
        ranks = written(ranks, "ranks")
        own = ranks.select(F.col("arc").alias("y"), *(F.col(w).alias(f"r_{w}") for w in weights))
        ranks = ranks.union(gone.join(own, "y").select("arc", *((F.col(w) + F.col(f"r_{w}")).alias(w) for w in weights)))
    return ranks


def tour(nodes: DataFrame) -> DataFrame:
    """The arcs (arc, next, place, n_leaves, saved_tokens) of nodes (node, parent, saved); nodes of one parent have neighbouring numbers."""
    children = nodes.where("parent is not null").groupBy("parent").agg(F.min("node").alias("child"))
    sibling = nodes.where("parent is not null").select((F.col("node") - 1).alias("node"), F.col("parent").alias("next_parent"))
    wide = nodes.join(children.withColumnRenamed("parent", "node"), "node", "left").join(sibling, "node", "left")
    leaf = F.col("child").isNull()
    enter = F.struct((2 * F.col("node")).alias("arc"), F.coalesce(2 * F.col("child"), 2 * F.col("node") + 1).alias("next"), F.lit(1).cast("long").alias("place"), leaf.cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    up = F.when(F.col("next_parent") == F.col("parent"), 2 * F.col("node") + 2).otherwise(2 * F.col("parent") + 1)
    leave = F.struct((2 * F.col("node") + 1).alias("arc"), up.alias("next"), F.lit(1).cast("long").alias("place"), F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    return wide.select(F.explode(F.array(enter, leave)).alias("x")).select("x.*")


def _same_node(left: str, right: str) -> Column:
    return (F.col(f"{left}.up") == F.col(f"{right}.p")) & (F.col(f"{left}.uq") == F.col(f"{right}.q")) & (F.col(f"{left}.d") == F.col(f"{right}.d") + 1)


def prefix_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", local: int = LOCAL) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, convs = rebuilt(df, conv, turn, role, text)
    none = F.lit(0).cast("long")
    root = convs.select("c", none.alias("d"), none.alias("p"), none.alias("q"), none.alias("up"), none.alias("uq"), none.alias("size"))
    rows = written(prefixes(turns).union(root).join(convs, "c").withColumn("is_end", F.col("d") == F.col("length")).drop("length"), "prefixes")
    nodes = rows.groupBy("d", "up", "uq", "p", "q").agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.min("size").alias("size"))
    nodes = numbered(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("size")), [F.col(x) for x in ("d", "up", "uq", "p", "q")], "node")
    above = nodes.select("d", "p", "q", F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.alias("n").join(above.alias("a"), _same_node("n", "a"), "left").select("n.*", "a.parent", "a.parent_conv_id")
    nodes = written(nodes, "nodes")
    ranks = list_rank(tour(nodes.select("node", "parent", "saved")), ("place", "n_leaves", "saved_tokens"), local)
    spans = ranks.groupBy(F.shiftright("arc", 1).alias("node")).agg(*((F.max(w) - F.min(w)).alias(w) for w in ("n_leaves", "saved_tokens")))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    ends = end_hashes(rows.where("is_end").select("d", "p", "q", "c"))
    done = nodes.join(spans, "node").join(children, "node", "left").join(ends, list(NODE), "left")
    empty = hashlib.sha256(b"").hexdigest()
    return done.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))

"""Joins of sequence intervals and connected components, for the near-duplicate operators.

A sorted sequence is cut into blocks; the directory of blocks carries a bounding box for each. `close_pairs` descends a
tree over that sequence (16 neighbouring nodes to a parent): pairs of nodes whose boxes are provably too far apart are
dropped with everything below them. Every step is an equi-join on (group, parent), never a cross join. What is left are
pairs of blocks, compared as packed arrays; from each only a spanning forest of its links leaves the task.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import durable, forget, join_hot, small_batches, tasks

FAN_BITS = 4
SQUARE_BITS = 3  # blocks a side of a square of pairs, as a power of two


def cut_blocks(frames: Iterator[pd.DataFrame], size: int, pack: Callable[[pd.DataFrame], dict]) -> Iterator[pd.DataFrame]:
    """Cut the sorted rows of a partition into blocks of one group (column grp) and at most `size` rows."""
    pid, seq, rest, out = TaskContext.get().partitionId(), 0, None, []
    for frame in frames:
        rest = frame if rest is None or not len(rest) else pd.concat([rest, frame], ignore_index=True)
        while len(rest):
            grp = rest["grp"].to_numpy()
            other = np.flatnonzero(grp != grp[0])
            n = min(size, other[0] if len(other) else len(rest))
            if n == len(rest) and n < size:
                break
            out.append({"grp": int(grp[0]), "pid": pid, "seq": seq, "n": n, **pack(rest.iloc[:n])})
            seq, rest = seq + 1, rest.iloc[n:].reset_index(drop=True)
            if len(out) >= 64:
                yield pd.DataFrame(out)
                out = []
    if rest is not None and len(rest):
        out.append({"grp": int(rest["grp"].iloc[0]), "pid": pid, "seq": seq, "n": len(rest), **pack(rest)})
    if out:
        yield pd.DataFrame(out)


def number_blocks(blocks: DataFrame) -> DataFrame:
    """Number the blocks densely in sequence order. The offsets have one row per partition, so they may be broadcast."""
    per = blocks.groupBy("pid").agg(F.count("*").alias("k"))
    first = per.select("pid", (F.sum("k").over(Window.orderBy("pid")) - F.col("k")).alias("first"))
    return blocks.join(F.broadcast(first), "pid").withColumn("blk", F.col("first") + F.col("seq")).drop("first", "pid", "seq")


def close_pairs(blocks: DataFrame, box: list[str], near: Callable[[Callable, Callable], Column]) -> DataFrame:
    """Pairs (grp, a, b), a <= b, of blocks whose boxes may hold links; box: names with lo_ and hi_ columns.

    near(x, y) gets two functions from a box column's name to its Column and tells whether two boxes may be linked.
    """
    ends = [f(f"{end}_{c}").alias(f"{end}_{c}") for c in box for end, f in (("lo", F.min), ("hi", F.max))]
    top = blocks.agg(F.max("blk")).first()[0] or 0
    levels = 0
    while top >> (FAN_BITS * levels) >= 1 << FAN_BITS:
        levels += 1

    def nodes(level: int) -> DataFrame:
        at = F.shiftright("blk", FAN_BITS * level)
        return blocks.groupBy("grp", at.alias("node")).agg(*ends).withColumn("up", F.shiftright("node", FAN_BITS))

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select([F.col(c).alias(f"{tag}_{c}") for c in df.columns])

    def fits() -> Column:
        return (F.col("x_node") <= F.col("y_node")) & near(lambda c: F.col(f"x_{c}"), lambda c: F.col(f"y_{c}"))

    def ends_only(df: DataFrame) -> DataFrame:
        return df.select(F.col("x_grp").alias("grp"), F.col("x_node").alias("a"), F.col("y_node").alias("b"))

    root = nodes(levels)  # at most 17 nodes a group
    pairs = durable(ends_only(side(root, "x").join(side(root, "y"), (F.col("x_grp") == F.col("y_grp")) & fits())), "close-nodes")
    for level in range(levels - 1, -1, -1):
        n, above = nodes(level), pairs
        x = above.join(side(n, "x"), (F.col("grp") == F.col("x_grp")) & (F.col("a") == F.col("x_up")))
        pairs = durable(ends_only(x.join(side(n, "y"), (F.col("grp") == F.col("y_grp")) & (F.col("b") == F.col("y_up")) & fits())), "close-nodes")
        forget(above)
    return pairs


def compare_pairs(pairs: DataFrame, blocks: DataFrame, payload: list[str], compare: Callable[[Any], pd.DataFrame | None], schema: str) -> DataFrame:
    """Run compare on each pair of blocks: an object with x_<payload> and y_<payload>, and same (a block with itself).

    Pairs are dealt in squares of 2^SQUARE_BITS neighbouring blocks a side, and a square gets each block it needs once, so
    a block travels once a square and not once a pair. A task holds one square's blocks at a time.
    """
    spark = pairs.sparkSession
    small_batches(spark)
    at = lambda c: F.shiftright(c, SQUARE_BITS)
    squares = pairs.groupBy("grp", at("a").alias("sa"), at("b").alias("sb")).agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("todo"))
    needs = F.array_distinct(F.concat("todo.a", "todo.b"))
    asked = squares.select("grp", "sa", "sb", "todo", F.posexplode(needs).alias("k", "blk"))
    asked = asked.select("grp", "sa", "sb", "blk", F.when(F.col("k") == 0, F.col("todo")).alias("todo"))
    load = blocks.select("grp", "blk", *payload)
    order = ["grp", "sa", "sb"]
    dealt = asked.join(load, ["grp", "blk"]).repartition(tasks(spark), *order).sortWithinPartitions(*order, "blk")
    names = ["same", *[f"{end}_{c}" for end in "xy" for c in payload]]
    box = namedtuple("Pair", names)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        square, held, todo = None, {}, None

        def done() -> Iterator[pd.DataFrame]:
            for a, b in todo if todo is not None else ():
                if (out := compare(box(a == b, *held[a], *held[b]))) is not None and len(out):
                    yield out

        for frame in frames:
            for row in frame.itertuples(index=False):
                if (row.grp, row.sa, row.sb) != square:
                    yield from done()
                    square, held, todo = (row.grp, row.sa, row.sb), {}, None
                held[row.blk] = [getattr(row, c) for c in payload]
                if row.todo is not None:
                    todo = [(p["a"], p["b"]) for p in row.todo]
        yield from done()

    return dealt.select(*order, "blk", "todo", *payload).mapInPandas(run, schema)


def local_roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of each of n nodes' component under the links i - j."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            return root
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while (root != root[root]).any():
            root = root[root]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v): root is the smallest node reachable.

    Alternating large-star and small-star steps, each a partial aggregate and an equi-join; every round is written to
    the shared folder, and nothing but a count and a checksum reaches the driver. A hub's edges are joined with its least
    neighbour by broadcast, so they don't meet in one task.
    """
    u, v = F.col("u"), F.col("v")
    e = durable(edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    state = None
    while True:
        found = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not found[0] or found == state:
            return e.select(u.alias("node"), v.alias("root")).union(e.select(v.alias("node"), v.alias("root"))).distinct()
        state = found
        both = e.union(e.select(v.alias("u"), u.alias("v")))
        least = durable(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")).withColumnRenamed("u", "of"), "least")
        star = join_hot(both.where(v > u), least, "u", "of", "n", 2 * found[0]).select(v.alias("u"), F.col("m").alias("v")).where(u != v).distinct()
        star = durable(star, "star")
        low = durable(star.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumnRenamed("u", "of"), "low")
        inner = join_hot(star, low, "u", "of", "n", star.count()).where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        before, e = e, durable(inner.union(low.select(F.col("of").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        forget(before, least, star, low)

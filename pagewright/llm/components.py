"""Connected components of a distributed list of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Links that a task contracts at a time.
CHUNK = 1 << 19


class Forest:
    """Union-find over numbers; join() says whether two trees met. The root of a tree is its least number."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        return True


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) to links (node, root) that connect the same, each node once for every CHUNK of links."""
    forest, held = Forest(), 0

    def told() -> pa.RecordBatch:
        nodes = list(forest.up)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(list(map(forest.root, nodes)), pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
            forest.join(a, b)
        held += batch.num_rows
        if held >= CHUNK:
            yield told()
            forest, held = Forest(), 0
    yield told()


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One star step. large: each node hands its larger neighbours to the smallest of its neighbourhood.
    small: each node hands itself and its smaller neighbours to the smallest of them.

    The smallest comes from a grouped minimum (summed before the shuffle) and goes back by a join, which
    Spark can split where one node has a large part of all links; no neighbourhood meets in one task.
    """
    if large:
        around = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = around.join(least, "a")
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _settled(links: DataFrame) -> bool:
    """Whether every node has one link only, to a root that has none."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 or up > 0 and root > 0").isEmpty()


def connected_components(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node long, root long) for every node of links (a long, b long); root is the smallest node of the component.

    Alternating large-star and small-star steps until all components are stars; before each, tasks contract the links that
    they hold. Every round ends in a table of the shared folder. No links give no rows; loops (a = b) and repeated links
    do no harm.
    """
    contract = lambda df: df.where("a <> b").select("a", "b").mapInArrow(_contracted, "a long, b long").distinct()
    now = written(contract(links), "links")
    for _ in range(most_rounds):
        if _settled(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        now = written(contract(_stars(_stars(now, True), False)), "stars")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")

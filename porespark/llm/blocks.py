"""Comparing the rows of large groups in pairs of bounded blocks.

Rows carry a group and a class, a whole number such that only rows of the same
or of neighbouring classes can match.  Each (group, class) is split into blocks
of bounded size by a hash of the row id, and each pair of blocks that can hold a
match goes to one task.  The rows that are shuffled grow with the rows times the
blocks of their group, never with pairs of rows, and no group is ever whole in a
task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from porespark.llm.common import width
from porespark.plans.lineage import cut


def deal(rows: DataFrame, group: Sequence[str], row_id: str, per_block: Column) -> DataFrame:
    """Rows with ``pair`` and ``side``, one copy for each pair their block is in.

    ``rows`` must be stored and have the columns ``group``, ``class`` and
    ``row_id``; ``per_block`` is the number of rows a block of a class may hold.
    A side is 0 or 1; a block that is paired with itself has side 2.
    """
    keys = [*group, "class"]
    sizes = (rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
             .withColumn("_blocks", F.ceil(F.col("_n") / per_block).cast("long")))
    one = sizes.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_block"))
    other = one.select(*group, F.col("class").alias("_class"), F.col("_block").alias("_other"))
    pairs = cut(one.join(other, list(group))
                .filter(((F.col("class") == F.col("_class")) & (F.col("_block") <= F.col("_other")))
                        | (F.col("class") + 1 == F.col("_class")))
                .withColumn("pair", F.monotonically_increasing_id()))
    itself = (F.col("class") == F.col("_class")) & (F.col("_block") == F.col("_other"))
    first = pairs.select(*keys, "_block", "pair", F.when(itself, 2).otherwise(0).alias("side"))
    second = (pairs.filter(~itself)
              .select(*group, F.col("_class").alias("class"), F.col("_other").alias("_block"), "pair", F.lit(1).alias("side")))
    placed = (rows.join(sizes.select(*keys, "_blocks"), keys)
              .withColumn("_block", F.pmod(F.xxhash64(row_id), F.col("_blocks"))).drop("_blocks"))
    dealt = placed.join(first.unionByName(second), [*keys, "_block"]).drop("_block")
    return dealt


def together(dealt: DataFrame) -> DataFrame:
    """Brings the rows of each pair into one task, one pair after another."""
    return dealt.repartition(width(dealt.sparkSession), "pair").sortWithinPartitions("pair")


def per_pair(compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]):
    """For ``mapInPandas`` on ``together``'s rows: calls ``compare`` with the two sides of each pair; they are one object when a block is paired with itself."""

    def sides(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        left, right, itself = (rows[rows["side"] == i] for i in (0, 1, 2))
        if len(itself):
            yield compare(itself, itself)
        elif len(left) and len(right):  # a block may have got no row
            yield compare(left, right)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        for batch in batches:
            starts = np.flatnonzero(np.diff(batch["pair"].to_numpy())) + 1
            for part in np.split(np.arange(len(batch)), starts) if len(batch) else []:
                rows = batch.iloc[part]
                if waiting and waiting[0]["pair"].iloc[0] != rows["pair"].iloc[0]:
                    yield from sides(pd.concat(waiting))
                    waiting = []
                waiting.append(rows)
        if waiting:
            yield from sides(pd.concat(waiting))

    return run


class Forest:
    """Union-find over ids; tells which links join what was apart."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(up, up)
            x = up
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
        return x != y

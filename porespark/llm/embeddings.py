"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine c or more are within squared distance 2 (1 - c).  After
a random rotation the coordinates are split into blocks; if every block of two
vectors differed by more than its proportional share of that budget, the whole
would exceed it.  So each true pair is within the share in at least one block.
Every block is joined on its own: vectors meet by the cell of the block's
leading coordinate (cells as wide as the block's radius, so only neighbours can
match), the block's distance is tested against its share, and the survivors are
verified exactly.  A pair counts at the first block that finds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from porespark.llm.blocks import Forest, deal, per_pair, together
from porespark.llm.common import width
from porespark.llm.components import components
from porespark.plans.lineage import cut

BLOCKS, BLOCK_ROWS = 4, 1024
_SLACK = 1e-9           # widens budgets so that rounding loses no pair; pairs are verified anyway


def rotation(dim: int, seed: int) -> np.ndarray:
    """Random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _edges(dim: int, blocks: int) -> np.ndarray:
    return np.linspace(0, dim, min(blocks, dim) + 1).astype(int)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # no overflow in the squares
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def _cells(cosine: float, blocks: int, seed: int):
    """One row per vector and block with the cell of the block's leading coordinate."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, rows in batch.groupby("dim"):
                turned = _unit(np.stack(rows["embedding"].to_numpy()).astype(np.float64)) @ rotation(dim, seed)
                edges = _edges(dim, blocks)
                for b, (lo, hi) in enumerate(zip(edges, edges[1:])):
                    radius = np.sqrt(2 * (1 - cosine) * (hi - lo) / dim) + _SLACK
                    yield pd.DataFrame({"vec_id": rows["vec_id"], "digest": rows["digest"], "label": rows["label"], "dim": dim, "block": b,
                                        "class": np.floor(turned[:, lo] / radius).astype(np.int64)})

    return run


def _verified(cosine: float, blocks: int, seed: int):
    """Links of two blocks of vectors: how many each vector has, and those that join what was apart."""

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        itself = left is right
        dim, block = int(left["dim"].iloc[0]), int(left["block"].iloc[0])
        x = _unit(np.stack(left["embedding"].to_numpy()).astype(np.float64))
        y = x if itself else _unit(np.stack(right["embedding"].to_numpy()).astype(np.float64))
        turn, edges, whole = rotation(dim, seed), _edges(dim, blocks), 2 * (1 - cosine)
        u, v = x @ turn, y @ turn

        def distance(b: int) -> np.ndarray:
            p, q = u[:, edges[b]:edges[b + 1]], v[:, edges[b]:edges[b + 1]]
            return np.einsum("ij,ij->i", p, p)[:, None] + np.einsum("ij,ij->i", q, q)[None, :] - 2 * (p @ q.T)

        share = lambda b: whole * (edges[b + 1] - edges[b]) / dim + _SLACK
        near = distance(block) <= share(block)
        if itself:
            near &= np.tri(len(x), k=-1, dtype=bool)
        i, j = np.nonzero(near)
        for b in range(block):  # found at an earlier block already
            gap = u[i, edges[b]:edges[b + 1]] - v[j, edges[b]:edges[b + 1]]
            later = np.einsum("ij,ij->i", gap, gap) > share(b)
            i, j = i[later], j[later]
        ids = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        good = (np.einsum("ij,ij->i", x[i], y[j]) >= cosine) & (ids[0][i] != ids[1][j])
        a, b = ids[0][i[good]], ids[1][j[good]]
        found, times = np.unique(np.concatenate([a, b]), return_counts=True)
        joined = Forest()
        links = [(p, q) for p, q in zip(a.tolist(), b.tolist()) if joined.join(p, q)]
        counts = pd.DataFrame({"a": found, "b": found, "n": times})
        return pd.concat([counts, pd.DataFrame({"a": [p for p, _ in links], "b": [q for _, q in links], "n": 0})]).astype("int64")

    return compare


def near_vectors(df: DataFrame, cosine: float = 0.93, blocks: int = BLOCKS, seed: int = 11) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``(vec_id, embedding, label)``.

    Vectors with equal labels and lengths link when their cosine in double
    precision is at least ``cosine``.  Null or empty vectors, zero vectors,
    vectors with null or non-finite components and vectors without a label link
    with nothing.  ``component_id`` is the smallest id reachable, ``kept`` marks
    it; a null id stays alone and is kept.  Rows that repeat an id with its
    vector and label are one vector, and an id never links with itself.  Other
    columns are ignored.
    """
    vectors = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & sound
                            & F.exists("embedding", lambda x: x != 0))
    usable = cut(usable.dropDuplicates(["vec_id", "label", "embedding"]).withColumn("dim", F.size("embedding"))
                 .withColumn("digest", F.xxhash64("label", "embedding")))
    label = usable.schema["label"].dataType.simpleString()
    cells = cut(usable.repartition(width(df.sparkSession)).mapInPandas(
        _cells(cosine, blocks, seed), f"vec_id long, digest long, label {label}, dim int, block int, class long"))
    dealt = deal(cells, ["label", "dim", "block"], "vec_id", F.lit(float(BLOCK_ROWS)))
    # the vectors themselves join last, so only ids travel while blocks are formed
    dealt = dealt.join(usable.select("vec_id", "digest", "embedding"), ["vec_id", "digest"])
    dealt = together(dealt.select("pair", "side", "vec_id", "dim", "block", "embedding"))
    found = cut(dealt.mapInPandas(per_pair(_verified(cosine, blocks, seed)), "a long, b long, n long"))
    degree = found.filter("n > 0").groupBy(F.col("a").alias("_id")).agg(F.sum("n").alias("n_links"))
    places = components(found.filter("n = 0").select("a", "b")).select(F.col("node").alias("_node"), "component")
    return (df.select(F.col("vec_id").cast("long").alias("vec_id"))
            .join(degree, F.col("vec_id") == F.col("_id"), "left").join(places, F.col("vec_id") == F.col("_node"), "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))

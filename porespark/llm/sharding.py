"""Shards along a Hilbert curve, with built-in functions only.

Several columns are quantised to a few bits each; their cell's index on a
Hilbert curve orders the rows, so that rows close on the curve are close in all
columns, and a shard is a run of that order.  A reader that filters on any of
the columns can then skip most shards by their minimum and maximum values.

The curve is walked by a state table (orientation of the sub-cube, by Hamilton
and Rau-Chaplin's formulation): per bit plane the state and the cell's corner
give the next digit of the index and the next state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from porespark.llm.common import ranked
from porespark.plans.lineage import cut


def curve_tables(n: int) -> tuple[list[int], list[int]]:
    """Digits and next states by ``state * 2^n + corner`` for the n-dimensional curve."""
    size, mask = 1 << n, (1 << n) - 1
    turn = lambda x, k: ((x >> k % n) | (x << (n - k % n))) & mask if k % n else x
    gray = lambda i: i ^ (i >> 1)
    rank = {gray(i): i for i in range(size)}

    def ones(i: int) -> int:  # trailing set bits
        return (~i & (i + 1)).bit_length() - 1

    digits, states = [], []
    for state in range(n * size):
        direction, start = divmod(state, size)
        for corner in range(size):
            w = rank[turn(corner ^ start, direction + 1)]
            first = 0 if w == 0 else gray(2 * ((w - 1) // 2))
            along = 0 if w == 0 else ones(w - 1) % n if w % 2 == 0 else ones(w) % n
            begin = start ^ turn(first, n - (direction + 1) % n)
            digits.append(w)
            states.append((direction + along + 1) % n * size + begin)
    return digits, states


def hilbert_index(cells: Sequence[Column], bits: int) -> Column:
    """Index on the curve of a cell, given as integers of ``bits`` bits each."""
    n = len(cells)
    digits, states = (F.array(*[F.lit(v) for v in t]) for t in curve_tables(n))
    state, index = F.lit(0), F.lit(0).cast("long")
    for level in range(bits - 1, -1, -1):
        corner = F.lit(0)
        for axis, cell in enumerate(cells):
            corner = corner.bitwiseOR(F.shiftleft(F.shiftright(cell, level).bitwiseAND(F.lit(1)), axis))
        at = state * F.lit(1 << n) + corner
        index = F.shiftleft(index, n).bitwiseOR(F.get(digits, at).cast("long"))
        state = F.get(states, at)
    return index


def ordinal_cells(df: DataFrame, column: str, cell: str, bits: int) -> DataFrame:
    """Adds the cell of a text column: its value's place among the distinct values, scaled; null last."""
    top = 1 << bits
    values = df.groupBy(F.col(column).alias("_v")).agg(F.lit(1).alias("_one")).drop("_one")
    placed = ranked(values, [F.col("_v").isNull(), F.col("_v")], "_place")
    n = placed.count()
    placed = placed.withColumn(cell, F.floor(F.col("_place") * F.lit(top) / F.lit(max(n, 1))).cast("int")).drop("_place")
    return df.join(placed, F.col(column).eqNullSafe(F.col("_v"))).drop("_v")


def _linear(value: Column, low: float, high: float, bits: int) -> Column:
    span = max(high - low, 1)
    return F.least(F.floor((value - F.lit(low)) * F.lit(1 << bits) / F.lit(span)).cast("int"), F.lit((1 << bits) - 1))


def shards(df: DataFrame, n_shards: int, bits: int = 5, text_col: str = "text", id_col: str = "doc_id",
           text_dims: Sequence[str] = ("lang", "source")) -> DataFrame:
    """Puts every row into one of ``n_shards`` runs of the curve, row counts at most one apart.

    Dimensions are ``text_dims`` (by their values' order), the size's logarithm
    and the id.  Returns ``doc_id, size`` (UTF-8 bytes of the text plus 8),
    ``text_crc32, law`` ('rows'), ``shard, slot`` (place in the shard from 0),
    ``grown_shard`` (null under this law), ``curve`` (the index).  Rows of equal
    index are ordered by checksum of the text and id; nulls in any dimension
    come last in it, a null text has size 8.  Repeated rows get slots of their
    own; other columns are ignored.  An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = cut(df.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
                         F.crc32(text).alias("text_crc32"), *[F.col(c).alias(f"_d{i}") for i, c in enumerate(text_dims)]))
    seen = slim.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n")).first()
    cells = [_linear(F.log2("size"), 3.0, 35.0, bits)]
    if seen["low"] is not None:
        top = F.lit((1 << bits) - 1)
        cells.append(F.coalesce(_linear(F.col("doc_id"), seen["low"], seen["high"] + 1, bits), top))
    placed = slim
    for i in range(len(text_dims)):
        placed = ordinal_cells(placed, f"_d{i}", f"_c{i}", bits)
        cells.append(F.col(f"_c{i}"))
    curve = placed.select("doc_id", "size", "text_crc32", hilbert_index(cells, bits).alias("curve"))
    n = max(seen["n"], 1)
    order = [F.col("curve"), F.col("text_crc32"), F.col("doc_id")]
    # exact: rank * shards and rows are whole numbers, so the first rank of shard s is ceil(s * n / shards)
    shard = F.expr(f"cast(_rank * {n_shards} div {n} as int)")
    begin = F.expr(f"(cast(_shard as bigint) * {n} + {n_shards - 1}) div {n_shards}")
    return (ranked(curve, order, "_rank").withColumn("_shard", shard)
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_shard").alias("shard"),
                    (F.col("_rank") - begin).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve"))

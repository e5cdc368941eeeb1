"""Throat-plane geometry: best-fit normals and projected footprint areas."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from porespark.operators.grid import AXES
from porespark.plans.packing import spread

TILE = 16.0

# The unit-cube corners.
CORNERS = np.array([[i, j, k] for i in (0.0, 1.0) for j in (0.0, 1.0) for k in (0.0, 1.0)])


def moment_columns() -> list:
    """Aggregates from which a covariance follows; exact while sums stay below 2^53."""
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    return ([F.sum(F.col(a).cast("decimal(20,0)")).alias(f"s{a}") for a in AXES]
            + [F.sum((F.col(a).cast("long") * F.col(b)).cast("decimal(20,0)")).alias(f"s{a}{b}") for a, b in pairs])


@F.arrow_udf(ArrayType(DoubleType()))
def plane_basis(n: pa.Array, m: pa.Array) -> pa.Array:
    """Unit normal and two in-plane axes (nine numbers) from moment sums.

    ``m`` holds n*S_ab - S_a*S_b for ab = xx, xy, xz, yy, yz, zz: n^2 times the
    covariance, whose smallest eigenvector is the normal.  Fewer than three
    points give (0, 0, 1).
    """
    xx, xy, xz, yy, yz, zz = (x.to_numpy(zero_copy_only=False) for x in m.flatten())
    cov = np.stack([np.stack([xx, xy, xz], -1), np.stack([xy, yy, yz], -1), np.stack([xz, yz, zz], -1)], -2)
    normal = np.linalg.eigh(cov)[1][:, :, 0]
    normal[n.to_numpy(zero_copy_only=False) < 3] = (0.0, 0.0, 1.0)
    ref = np.where(np.abs(normal[:, :1]) < 0.9, [[1.0, 0.0, 0.0]], [[0.0, 1.0, 0.0]])
    e1 = ref - (ref * normal).sum(1, keepdims=True) * normal
    e1 /= np.linalg.norm(e1, axis=1, keepdims=True)
    e2 = np.cross(normal, e1)
    e2 /= np.linalg.norm(e2, axis=1, keepdims=True)
    found = np.concatenate([normal, e1, e2], axis=1)
    return pa.ListArray.from_arrays(np.arange(0, found.size + 1, 9, dtype="int32"), found.ravel())


def with_plane(throats: DataFrame, count: str = "volume_voxels") -> DataFrame:
    """Add ``plane`` (normal, e1, e2) from the moment columns, then drop those."""
    n = F.col(count).cast("decimal(18,0)")
    terms = [(n * F.col(f"s{a}{b}") - F.col(f"s{a}") * F.col(f"s{b}")).cast("double").alias(f"{a}{b}")
             for a, b in [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]]
    out = throats.withColumn("plane", plane_basis(F.col(count), F.struct(*terms)))
    return out.drop(*[f"s{a}" for a in AXES], "sxx", "sxy", "sxz", "syy", "syz", "szz")


def _hull(points: np.ndarray) -> np.ndarray:
    """Convex hull of a few 2-D points, counter-clockwise."""
    pts = sorted(map(tuple, np.round(points, 12)))

    def half(seq):
        chain = []
        for p in seq:
            while len(chain) > 1 and ((chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1])
                                      - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0])) <= 1e-12:
                chain.pop()
            chain.append(p)
        return chain[:-1]
    return np.array(half(pts) + half(pts[::-1]))


def _chains(hull: np.ndarray):
    """Left and right boundary of a convex polygon as functions of the ordinate."""
    ys = np.unique(np.round(hull[:, 1], 12))
    left, right = np.empty(len(ys)), np.empty(len(ys))
    nxt = np.roll(hull, -1, axis=0)
    for k, y in enumerate(ys):
        at = []
        for (x0, y0), (x1, y1) in zip(hull, nxt):
            if min(y0, y1) - 1e-12 <= y <= max(y0, y1) + 1e-12:
                at += [x0, x1] if abs(y1 - y0) < 1e-12 else [x0 + (x1 - x0) * (y - y0) / (y1 - y0)]
        left[k], right[k] = min(at), max(at)
    return ys, left, right


def _covered(left: np.ndarray, right: np.ndarray, x0: float, x1: float) -> float:
    left, right = np.maximum(left, x0), np.minimum(right, x1)
    left, right = left[left < right], right[left < right]
    if not len(left):
        return 0.0
    order = np.argsort(left)
    lo, hi = left[order], np.maximum.accumulate(right[order])
    gaps = np.maximum(lo[1:] - hi[:-1], 0.0).sum()
    return float(hi[-1] - lo[0] - gaps)


def strip_union_area(px, py, e1, e2, y0: float, y1: float, x0: float = -np.inf, x1: float = np.inf) -> float:
    """Area inside y0..y1 and x0..x1 of the union of equal voxel shadows at (px, py).

    All shadows are translates of one convex polygon.  Between consecutive
    ordinates where a vertex lies or two boundaries cross, the sides x0 and x1
    among them, the covered length is linear, so the mid-point rule is exact there.
    """
    sides = np.array([s for s in (x0, x1) if np.isfinite(s)])
    hull = _hull(np.stack([CORNERS @ np.asarray(e1), CORNERS @ np.asarray(e2)], axis=1))
    ys, left, right = _chains(hull)
    # voxels stacked along the normal cast the same shadow
    px, py = np.unique(np.round(np.stack([px, py], axis=1).astype(float), 9), axis=0).T
    levels = np.unique(np.round(np.concatenate([(py[:, None] + ys[None, :]).ravel(), [y0, y1]]), 10))
    levels = levels[(levels >= y0) & (levels <= y1)]
    area = 0.0
    for a, b in zip(levels[:-1], levels[1:]):
        on = (py + ys[0] <= a + 1e-9) & (py + ys[-1] >= b - 1e-9)
        if b - a < 1e-12 or not on.any():
            continue
        x, y = px[on], py[on]

        def ends(level):
            return x + np.interp(level - y, ys, left), x + np.interp(level - y, ys, right)

        la, ra = ends(a + 1e-12)
        lb, rb = ends(b - 1e-12)
        ea, eb = np.concatenate([la, ra, sides]), np.concatenate([lb, rb, sides])
        da, db = ea[:, None] - ea[None, :], eb[:, None] - eb[None, :]
        cross = np.triu(da * db < 0, 1)
        t = da[cross] / (da[cross] - db[cross])
        cuts = np.unique(np.concatenate([[a], a + t * (b - a), [b]]))
        for c, d in zip(cuts[:-1], cuts[1:]):
            if d - c > 1e-13:
                area += (d - c) * _covered(*ends(0.5 * (c + d)), x0, x1)
    return area


@F.pandas_udf(DoubleType())
def _tile_area(px: pd.Series, py: pd.Series, plane: pd.Series) -> pd.Series:
    seen: dict = {}  # throats repeat a few shapes; one entry per shape and batch
    out = []
    for x, y, p in zip(px, py, plane):
        pts = np.unique(np.round(np.stack([x, y], axis=1), 9), axis=0)
        key = (pts.tobytes(), np.round(p, 9).tobytes())
        if key not in seen:
            seen[key] = strip_union_area(pts[:, 0], pts[:, 1], p[3:6], p[6:9], 0.0, TILE, 0.0, TILE)
        out.append(seen[key])
    return pd.Series(out, dtype=float)


@F.pandas_udf(ArrayType(DoubleType()))
def _shadow_range(plane: pd.Series) -> pd.Series:
    """Least and greatest offset of a shadow along both in-plane axes."""
    return pd.Series([[float(f(CORNERS @ p[a:a + 3])) for a in (3, 6) for f in (np.min, np.max)] for p in plane])


def footprint_areas(voxels: DataFrame, planes: DataFrame, keys: list[str]) -> DataFrame:
    """Union area of the voxel shadows on each throat plane.

    The plane is cut into tiles in both directions; a voxel goes to the few
    tiles its shadow meets, and the area of a (throat, tile) is the union clipped
    to the tile.  Such a group holds the voxels over one tile, whatever the
    throat's extent, so the cost is linear in shadows and a throat of any size
    spreads over many tasks.  Coordinates are taken from the throat centre
    ``tx, ty, tz`` of ``planes``.
    """
    basis = planes.select(*keys, "plane", "tx", "ty", "tz").withColumn("_span", _shadow_range("plane"))
    pts = (voxels.select(*keys, *AXES).distinct().join(basis, keys)
           .withColumn("px", sum(((F.col(a) - F.col(f"t{a}")) * F.element_at("plane", 4 + i) for i, a in enumerate(AXES)), F.lit(TILE / 2)))
           .withColumn("py", sum(((F.col(a) - F.col(f"t{a}")) * F.element_at("plane", 7 + i) for i, a in enumerate(AXES)), F.lit(TILE / 2))))

    def met(at: str, low: int):
        return F.sequence(*[F.floor((F.col(at) + F.element_at("_span", low + k)) / TILE) for k in (0, 1)])
    tiles = (pts.select(*keys, "px", "py", "plane", F.explode(met("px", 1)).alias("across"), met("py", 3).alias("_up"))
             .select(*keys, "px", "py", "plane", "across", F.explode("_up").alias("up")))
    # coordinates from the tile's corner: tiles of one pattern are alike
    tiles = tiles.withColumn("px", F.col("px") - F.col("across") * TILE).withColumn("py", F.col("py") - F.col("up") * TILE)
    grouped = spread(tiles, [*keys, "across", "up"]).groupBy(*keys, "across", "up").agg(
        F.collect_list(F.struct("px", "py")).alias("p"), F.first("plane").alias("plane"))
    areas = grouped.withColumn("area", _tile_area(F.col("p.px"), F.col("p.py"), F.col("plane")))
    return areas.groupBy(*keys).agg(F.sum("area").alias("footprint"))

"""Voxel-grid operators.

A voxel table has ``ms_id, x, y, z`` plus payload columns.  Stencils are line
windows (lead/lag along one axis), not self-joins: two shuffles of the plain
rows give all six neighbours, and no window group is longer than one grid line.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from porespark.plans.packing import spread

AXES = ("x", "y", "z")

# node ids pack (x, y, z) into 21 bits each, so they sort in C order.
_BITS = 21
STEP = {"x": 1 << (2 * _BITS), "y": 1 << _BITS, "z": 1}


def node_id(x="x", y="y", z="z") -> Column:
    top = (1 << _BITS) - 1
    wide = (F.col(y) > top) | (F.col(z) > top)  # would run into the next coordinate's bits
    first = F.when(wide, F.raise_error(F.lit(f"y and z must not exceed {top}"))).otherwise(F.col(x).cast("long"))
    return (F.shiftleft(first, 2 * _BITS)
            + F.shiftleft(F.col(y).cast("long"), _BITS) + F.col(z).cast("long"))


def node_coords(node: str = "node_id") -> list[Column]:
    mask = (1 << _BITS) - 1
    n = F.col(node)
    return [F.shiftright(n, 2 * _BITS).cast("int").alias("x"),
            F.shiftright(n, _BITS).bitwiseAND(F.lit(mask)).cast("int").alias("y"),
            n.bitwiseAND(F.lit(mask)).cast("int").alias("z")]


def voxels_from_flat(df: DataFrame, key: str, values: str, shape: tuple[int, int, int],
                     keep: Sequence[str] = ()) -> DataFrame:
    """Flat C-order array column -> one row per voxel."""
    _, ny, nz = shape
    pos = F.col("_pos")
    return (df.select(F.col(key).alias("ms_id"), *keep, F.posexplode(values).alias("_pos", "value"))
            .select("ms_id", *keep,
                    F.floor(pos / (ny * nz)).cast("int").alias("x"),
                    (F.floor(pos / nz).cast("int") % ny).alias("y"),
                    (pos % nz).cast("int").alias("z"), "value"))


def extents(vox: DataFrame) -> DataFrame:
    """Grid shape per sample."""
    return vox.groupBy("ms_id").agg(*[(F.max(a) + 1).alias(f"n{a}") for a in AXES])


def phase_mask(vox: DataFrame, phase_id: int) -> DataFrame:
    """Rows of one phase."""
    return vox.filter(F.col("phase") == phase_id)


def pore_mask(vox: DataFrame) -> DataFrame:
    """Rows carrying a body label."""
    return vox.filter(F.col("body") > 0)


def _line(axis: str) -> "Window":
    return Window.partitionBy("ms_id", *[a for a in AXES if a != axis]).orderBy(axis)


def with_neighbours(vox: DataFrame, values: Sequence[str], forward_only: bool = False) -> DataFrame:
    """Attach face neighbours as nullable structs ``xp,yp,zp`` (and ``xm,ym,zm``).

    y- and z-lines share one exchange on (ms_id, x); x-lines need a second.
    """
    out = vox.repartition("ms_id", "x")
    for axis in ("z", "y", "x"):
        w = _line(axis)
        payload = F.struct(F.col(axis).alias("c"), *[F.col(v) for v in values])
        sides = [("p", F.lead(payload), 1)] if forward_only else [
            ("p", F.lead(payload), 1), ("m", F.lag(payload), -1)]
        for suffix, shifted, step in sides:
            tmp = f"_{axis}{suffix}"
            out = out.withColumn(tmp, shifted.over(w))
            out = out.withColumn(f"{axis}{suffix}",
                                 F.when(F.col(f"{tmp}.c") == F.col(axis) + step, F.col(tmp)))
            out = out.drop(tmp)
    return out


def edges(pore: DataFrame) -> DataFrame:
    """Face-sharing voxel pairs ``(ms_id, u, v, axis)`` with u the lower end."""
    linked = with_neighbours(pore.select("ms_id", *AXES), [], forward_only=True)
    steps = F.array(*[F.when(F.col(f"{a}p").isNotNull(), F.lit(i)) for i, a in enumerate(AXES)])
    step = F.element_at(F.array(*[F.lit(STEP[a]) for a in AXES]), F.col("axis") + 1)
    return (linked.select("ms_id", node_id().alias("u"), F.explode(F.array_compact(steps)).alias("axis"))
            .select("ms_id", "u", (F.col("u") + step).alias("v"), F.col("axis").cast("byte").alias("axis")))


def degrees(pore: DataFrame) -> DataFrame:
    """Coordination of every pore voxel, zero included (A1)."""
    sides = [f"{a}{s}" for a in AXES for s in "pm"]
    linked = with_neighbours(pore.select("ms_id", *AXES), [])
    total = sum((F.col(s).isNotNull().cast("int") for s in sides[1:]),
                F.col(sides[0]).isNotNull().cast("int"))
    return linked.select("ms_id", *AXES, total.alias("degree"))


def degree_histogram(pore: DataFrame) -> DataFrame:
    """Degree -> number of voxels, per sample (A2)."""
    return degrees(pore).groupBy("ms_id", "degree").agg(F.count(F.lit(1)).alias("n_nodes"))


def on_face(axis: int, last: Column) -> tuple[Column, Column]:
    """Inlet/outlet predicates on the flow axis; ``last`` is n-1."""
    c = F.col(AXES[axis])
    return c == 0, c == last


def nodes(vox: DataFrame, phase_id: int, axis: int = 0, keep: Sequence[str] = ()) -> DataFrame:
    """Pore voxels as network nodes with face flags; the shape uses all voxels."""
    name = AXES[axis]
    last = vox.groupBy("ms_id").agg(F.max(name).alias("_last"))
    pore = phase_mask(vox, phase_id).select("ms_id", *AXES, *keep)
    inlet, outlet = on_face(axis, F.col("_last"))
    return (pore.join(last, "ms_id")
            .select("ms_id", node_id().alias("node_id"), *AXES, *keep,
                    inlet.alias("is_inlet"), outlet.alias("is_outlet")))


def boundary_voxels(vox: DataFrame, label: str = "body") -> DataFrame:
    """Labelled voxels with a differing face neighbour, solid included (P5)."""
    linked = with_neighbours(vox.select("ms_id", *AXES, label), [label])
    differs = F.lit(False)
    for a in AXES:
        for s in "pm":
            differs = differs | F.coalesce(F.col(f"{a}{s}.{label}") != F.col(label), F.lit(False))
    return linked.filter((F.col(label) > 0) & differs).select("ms_id", *AXES, label)


def interface_faces(vox: DataFrame, payload: Sequence[str] = ("edt",)) -> DataFrame:
    """One row per face between two labelled voxels of different bodies.

    Columns: lo, hi, axis, sign (+1 when the lower-index voxel is ``lo``), the
    coordinates of the lower-index voxel, and ``<p>_a``/``<p>_b`` payloads.
    """
    linked = with_neighbours(vox.select("ms_id", *AXES, "body", *payload),
                             ["body", *payload], forward_only=True)
    faces = F.array(*[F.struct(F.lit(i).alias("axis"), F.col(f"{a}p").alias("nb"))
                      for i, a in enumerate(AXES)])
    exploded = (linked.filter(F.col("body") > 0)
                .withColumn("_f", F.explode(faces))
                .filter((F.col("_f.nb.body") > 0) & (F.col("_f.nb.body") != F.col("body"))))
    return exploded.select(
        "ms_id", F.least("body", "_f.nb.body").alias("lo"), F.greatest("body", "_f.nb.body").alias("hi"),
        F.col("_f.axis").alias("axis"),
        F.when(F.col("body") < F.col("_f.nb.body"), 1.0).otherwise(-1.0).alias("sign"),
        *AXES,
        *[F.col(p).alias(f"{p}_a") for p in payload],
        *[F.col(f"_f.nb.{p}").alias(f"{p}_b") for p in payload])


def interfaces(vox_with_edt: DataFrame) -> DataFrame:
    """Per body pair: throat radius, face count, centroid of lower voxels."""
    faces = interface_faces(vox_with_edt)
    return faces.groupBy("ms_id", "lo", "hi").agg(
        F.max(F.least("edt_a", "edt_b")).alias("r_throat"),
        F.count(F.lit(1)).alias("voxel_count"),
        F.avg("x").alias("c0"), F.avg("y").alias("c1"), F.avg("z").alias("c2"))


def label_adjacency(vox: DataFrame) -> DataFrame:
    """Distinct touching label pairs, both directions."""
    pairs = interface_faces(vox, payload=()).select("ms_id", "lo", "hi").distinct()
    return pairs.select("ms_id", F.explode(F.array(
        F.struct(F.col("lo").alias("body"), F.col("hi").alias("other")),
        F.struct(F.col("hi").alias("body"), F.col("lo").alias("other")))).alias("p")).select(
        "ms_id", "p.body", "p.other")


def dilate(vox: DataFrame, mask: Column) -> DataFrame:
    """6-connected binary dilation of ``mask`` inside the image."""
    linked = with_neighbours(vox.withColumn("_m", mask), ["_m"])
    hit = F.col("_m")
    for a in AXES:
        for s in "pm":
            hit = hit | F.coalesce(F.col(f"{a}{s}._m"), F.lit(False))
    return linked.select("ms_id", *AXES, hit.alias("dilated"))


# --- exact Euclidean distance transform (K13) --------------------------------

def envelopes(coords: np.ndarray, values: np.ndarray) -> np.ndarray:
    """min over b of values[b] + (coords[a] - coords[b])^2 along each row; rows ascend and may end in inf.

    Every line keeps a stack of the parabolas of its lower envelope, with the place
    from which each is lowest.  Lines take a step together, and those that pop a
    parabola go on among themselves, so the work is linear in the line's length.
    """
    lines, n = coords.shape
    best = np.full((lines, n), np.inf)
    if not lines or not n:
        return best
    owner, since = np.zeros((lines, n), int), np.full((lines, n + 1), np.inf)
    top = np.full(lines, -1)
    lifted = values + coords * coords
    for q in range(n):
        row = np.flatnonzero(np.isfinite(values[:, q]))
        at = np.full(len(row), -np.inf)
        todo = np.flatnonzero(top[row] >= 0)
        while len(todo):
            r = row[todo]
            v = owner[r, top[r]]
            cross = (lifted[r, q] - lifted[r, v]) / (2 * (coords[r, q] - coords[r, v]))
            hidden = cross <= since[r, top[r]]
            at[todo] = np.where(hidden, -np.inf, cross)
            top[r[hidden]] -= 1
            todo = todo[hidden & (top[r] >= 0)]
        top[row] += 1
        owner[row, top[row]], since[row, top[row]] = q, at
    known = np.flatnonzero(top >= 0)
    since[known, top[known] + 1] = np.inf
    place = np.zeros(lines, int)
    for a in range(n):
        todo = known[np.isfinite(coords[known, a])]
        live = todo
        while len(todo):
            todo = todo[(place[todo] < top[todo]) & (since[todo, np.minimum(place[todo] + 1, n)] < coords[todo, a])]
            place[todo] += 1
        v = owner[live, place[live]]
        best[live, a] = values[live, v] + (coords[live, a] - coords[live, v]) ** 2
    return best


@F.arrow_udf(ArrayType(DoubleType()))
def _lower_envelope(coords: pa.Array, values: pa.Array) -> pa.Array:
    """``envelopes`` of a batch of grid lines in any order, each with its values in its own order."""
    n = coords.value_lengths().to_numpy(zero_copy_only=False)
    c, v = (np.full((len(n), int(n.max(initial=0))), np.inf) for _ in range(2))
    inside = np.arange(c.shape[1]) < n[:, None]
    c[inside], v[inside] = (x.flatten().to_numpy(zero_copy_only=False) for x in (coords, values))
    order = np.argsort(c, axis=1, kind="stable")
    found = np.empty_like(c)
    np.put_along_axis(found, order, envelopes(np.take_along_axis(c, order, 1), np.take_along_axis(v, order, 1)), 1)
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype("int32"), found[inside])


def _envelope_along(df: DataFrame, axis: str, keep: Sequence[str]) -> DataFrame:
    """One min-plus pass; a group is one grid line, so its size is the image edge."""
    keys = ["ms_id", *[a for a in AXES if a != axis]]
    packed = spread(df, keys).groupBy(*keys).agg(F.collect_list(F.struct(axis, "_d2", *keep)).alias("_line"))
    solved = packed.withColumn("_best", _lower_envelope(F.col(f"_line.{axis}"), F.col("_line._d2")))
    return (solved.select(*keys, F.explode(F.arrays_zip("_line", "_best")).alias("_e"))
            .select(*keys, F.col(f"_e._line.{axis}").alias(axis), F.col("_e._best").alias("_d2"),
                    *[F.col(f"_e._line.{k}").alias(k) for k in keep]))


def distance_transform(vox: DataFrame, pore: Column, keep: Sequence[str] = ()) -> DataFrame:
    """``edt``: distance of each voxel centre to the nearest non-pore voxel.

    The first axis uses two line windows; the other two are min-plus passes.
    NULL when a sample has no non-pore voxel.
    """
    solid_z = F.when(~pore, F.col("z"))
    back = _line("z").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = _line("z").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    gap = F.least(F.col("z") - F.last(solid_z, ignorenulls=True).over(back),
                  F.first(solid_z, ignorenulls=True).over(ahead) - F.col("z"))
    first = (vox.repartition("ms_id", "x")
             .select("ms_id", *AXES, *keep,
                     F.coalesce((gap * gap).cast("double"), F.lit(float("inf"))).alias("_d2")))
    out = _envelope_along(_envelope_along(first, "y", keep), "x", keep)
    return out.select("ms_id", *AXES, *keep,
                      F.when(F.col("_d2") != float("inf"), F.sqrt("_d2")).alias("edt"))


# --- summed-area table (W10) ---------------------------------------------------

def summed_area(vox: DataFrame, mask: Column, out: str = "sat") -> DataFrame:
    """Inclusive 3-D prefix counts: three running sums, each along one line."""
    df = vox.repartition("ms_id", "x").select("ms_id", *AXES, mask.cast("long").alias(out))
    for axis in ("z", "y", "x"):
        w = _line(axis).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        df = df.withColumn(out, F.sum(out).over(w))
    return df


def box_counts(boxes: DataFrame, sat: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mask count in inclusive boxes ``lo_*..hi_*``: eight signed look-ups each."""
    corners = []
    for cx, sx in (("hi_x", 1), ("lo_x", -1)):
        for cy, sy in (("hi_y", 1), ("lo_y", -1)):
            for cz, sz in (("hi_z", 1), ("lo_z", -1)):
                at = [F.col(c) - (1 if c.startswith("lo") else 0) for c in (cx, cy, cz)]
                corners.append(F.struct(at[0].alias("x"), at[1].alias("y"), at[2].alias("z"),
                                        F.lit(sx * sy * sz).alias("s")))
    probes = (boxes.select("ms_id", *keys, F.explode(F.array(*corners)).alias("c"))
              .select("ms_id", *keys, "c.*")
              .filter((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("z") >= 0)))
    return (probes.join(sat, ["ms_id", *AXES], "left")
            .groupBy("ms_id", *keys).agg(F.sum(F.col("s") * F.coalesce("sat", F.lit(0))).alias("n_inside")))


# --- small reports -------------------------------------------------------------

def porosity(vox: DataFrame, phase_id: int) -> DataFrame:
    """Pore count, voxel count and porosity per sample."""
    hit = (F.col("phase") == phase_id).cast("long")
    return vox.groupBy("ms_id").agg(F.sum(hit).alias("n_pore"), F.count(F.lit(1)).alias("n_voxels"),
                                    F.avg(hit.cast("double")).alias("porosity"))


def face_counts(vox: DataFrame, phase_id: int, axis: int = 0) -> DataFrame:
    """Pore voxels on the two faces; ``touches_both`` false means no transport."""
    flagged = nodes(vox, phase_id, axis)
    out = flagged.groupBy("ms_id").agg(F.count_if("is_inlet").alias("n_inlet"),
                                       F.count_if("is_outlet").alias("n_outlet"))
    return out.withColumn("touches_both", (F.col("n_inlet") > 0) & (F.col("n_outlet") > 0))


def mask_agreement(vox: DataFrame, phase_id: int) -> DataFrame:
    """Share of voxels where the phase mask and the body mask agree."""
    same = (F.col("phase") == phase_id) == (F.col("body") > 0)
    return vox.groupBy("ms_id").agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(~same).alias("n_disagree"),
        F.avg(same.cast("double")).alias("frac_agree"))


def projection(vox: DataFrame, value: Column, axis: int = 0) -> DataFrame:
    """Mean and maximum of ``value`` along ``axis``, one row per line of voxels."""
    kept = [a for i, a in enumerate(AXES) if i != axis]
    return vox.select("ms_id", *kept, value.alias("_v")).groupBy("ms_id", *kept).agg(
        F.avg("_v").alias("mean"), F.max("_v").alias("max"))


def plane_profile(vox: DataFrame, phase_id: int, axis: int = 0) -> DataFrame:
    """Pore fraction of each plane normal to ``axis``."""
    return vox.groupBy("ms_id", F.col(AXES[axis]).alias("plane")).agg(
        F.avg((F.col("phase") == phase_id).cast("double")).alias("pore_fraction"))

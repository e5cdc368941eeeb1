"""Column expressions shared by the operators."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Classification cuts.
NARROW_CUT = 0.85
BUSY_SHARE_OF_MAX = 0.25
IDLE_CUT = 0.005

# Floors of the series-resistance model.
MIN_LENGTH = 1e-8
MIN_AREA = 1e-16

# Throat-to-body area ratio above which a leg becomes a uniform pipe.
RATIO_LIMIT = 1.0


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm3(dx: Column, dy: Column, dz: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def distance3(a: Sequence[str], b: Sequence[str]) -> Column:
    return norm3(*[F.col(p) - F.col(q) for p, q in zip(a, b)])


def safe_inverse(x: Column | str) -> Column:
    """1/x, NULL for 0, NULL or NaN."""
    x = F.nanvl(col(x), F.lit(None).cast("double"))
    return F.try_divide(F.lit(1.0), x)


def nan_to_null(x: Column | str) -> Column:
    return F.nanvl(col(x), F.lit(None).cast("double"))


def equivalent_radius(volume: Column | str) -> Column:
    """Radius of the sphere of this volume."""
    return F.pow(F.lit(3.0 / (4.0 * math.pi)) * col(volume), F.lit(1.0 / 3.0))


def segment_resistance(length: Column | str, area: Column | str, sigma: float) -> Column:
    """L/(sigma A) with floors on both."""
    return F.greatest(col(length), F.lit(MIN_LENGTH)) / (sigma * F.greatest(col(area), F.lit(MIN_AREA)))


def classify(c: Column | str, f: Column | str, f_max: Column | str) -> Column:
    """bottleneck / geometric_only / highway / secondary_or_filler.

    A missing constriction ratio counts as not narrow, so a busy throat without
    an interface is a highway.
    """
    c, f, f_max = col(c), col(f), col(f_max)
    top = F.when(f_max > 0, f_max).otherwise(1.0)
    busy, idle = f >= BUSY_SHARE_OF_MAX * top, f < IDLE_CUT
    narrow = F.coalesce(c < NARROW_CUT, F.lit(False))
    return (F.when(narrow & idle, "geometric_only").when(narrow & busy, "bottleneck")
            .when(~narrow & busy, "highway").otherwise("secondary_or_filler"))


def top_count(n: Column | str, fraction: float, at_least: int) -> Column:
    """max(at_least, round-half-even(fraction * n)) (T5)."""
    return F.greatest(F.lit(at_least), F.bround(F.lit(fraction) * col(n), 0).cast("int"))


def size_class(name: Column | str) -> Column:
    """Leading word of ``<Word>_microstructure_<n>``, else ``unknown``."""
    hit = F.regexp_extract(col(name), r"^([A-Za-z]+)_microstructure_\d+", 1)
    return F.coalesce(F.nullif(hit, F.lit("")), F.lit("unknown"))


def size_order(c: Column | str) -> Column:
    """Coarse < Medium < Fine < anything else."""
    c = col(c)
    return F.when(c == "Coarse", 0).when(c == "Medium", 1).when(c == "Fine", 2).otherwise(3)


def drop_last_part(name: Column | str) -> Column:
    """Text before the last underscore."""
    return F.regexp_replace(col(name), "_[^_]*$", "")


@F.pandas_udf(StringType())
def before_after(before: pd.Series, after: pd.Series) -> pd.Series:
    """``{before:.4g}/{after:.4g}``; a missing ``after`` is ``failed``."""
    left = before.map(lambda v: "nan" if pd.isna(v) else f"{v:.4g}")
    right = after.map(lambda v: "failed" if pd.isna(v) else f"{v:.4g}")
    return left + "/" + right


def throat_equivalent_radius(volume: Column | str, length: Column | str) -> Column:
    """Radius of the cylinder with this volume and length, 0 without length."""
    length = col(length)
    return F.when(length > 0, F.sqrt(col(volume) / (math.pi * F.nullif(length, F.lit(0.0))))).otherwise(0.0)


def aspect_ratio(length: Column | str, radius: Column | str) -> Column:
    """Length over equivalent diameter, 0 without radius."""
    return F.coalesce(F.try_divide(col(length), 2 * col(radius)), F.lit(0.0))


def is_curved(curvature_ratio: Column | str) -> Column:
    return col(curvature_ratio) > 1.01

"""Output shape of the registered queries: one column spec for Spark and for SQL.

A spec is ``"name:type ..."`` with types l (BIGINT), s (text), b (boolean) and
dN (DOUBLE rounded to N digits).  Grids of 64 voxels give many exact halves at the
last digit, where sums in another order may fall on either side; a shift far
below the last digit sends them all the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _parts(spec: str) -> list[tuple[str, str]]:
    return [tuple(item.rsplit(":", 1)) for item in spec.split()]


def _shift(digits: int) -> float:
    return 3.0 * 10.0 ** -(digits + 5)


def shaped(df: DataFrame, spec: str) -> DataFrame:
    cols = []
    for name, kind in _parts(spec):
        c = F.col(f"`{name}`")
        if kind == "l":
            c = c.cast("long")
        elif kind == "s":
            c = c.cast("string")
        elif kind == "b":
            c = c.cast("boolean")
        else:
            digits = int(kind[1:])
            c = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
            c = F.round(c + F.lit(_shift(digits)), digits) + F.lit(0.0)
        cols.append(c.alias(name))
    return df.select(*cols)


def shaped_sql(with_clause: str, source: str, spec: str) -> str:
    cols = []
    for name, kind in _parts(spec):
        q = f'"{name}"'
        sql = {"l": f"CAST({q} AS BIGINT)", "s": f"CAST({q} AS VARCHAR)", "b": f"CAST({q} AS BOOLEAN)"}.get(
            kind) or f"round(CAST({q} AS DOUBLE) + {_shift(int(kind[1:]))!r}::DOUBLE, {kind[1:]}) + 0.0"
        cols.append(f"{sql} AS {q}")
    return f"{with_clause} SELECT {', '.join(cols)} FROM ({source}) AS q"

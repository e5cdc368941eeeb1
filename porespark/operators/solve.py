"""Kirchhoff solves on resistor networks (K2, K3).

Both networks reduce to one relation of links ``(ms_id, u, v, g, fixed)``:
an inner resistor has both ends, a resistor to a held potential has ``v`` NULL
and the potential in ``fixed``.  The matrix is symmetric positive definite on
every part that touches a held potential; other parts stay at zero.

Samples within the measured kernel bound are solved many at a time by one
block-diagonal conjugate-gradient run per pack; larger samples run the same
method as a loop of joins and aggregates.

A start vector comes as held links without conductance: they leave the system as it
is, and a solver takes their potential for the first guess of their node.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from porespark.plans.lineage import cut, release
from porespark.plans.packing import split_by_size

RELATIVE_TOL = 1e-13
_SOLVED = "node_id long, phi double, iterations long, residual double, converged boolean, started boolean"


def _pack_solver(tol: float):
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        guess = pdf[pdf["g"] == 0.0]
        pdf = pdf[pdf["g"] != 0.0]
        inner = pdf["v"].notna().to_numpy()
        sample, names = pd.factorize(pdf["ms_id"])
        u_raw = pdf["u"].to_numpy()
        v_raw = pdf["v"].fillna(0).astype("int64").to_numpy()
        owner_all = np.concatenate([sample, sample[inner]])
        node_all = np.concatenate([u_raw, v_raw[inner]])
        code = pd.DataFrame({"m": owner_all, "n": node_all}).groupby(["m", "n"], sort=False).ngroup().to_numpy()
        n = int(code.max()) + 1 if len(code) else 0
        owner, node = np.empty(n, dtype=int), np.empty(n, dtype="int64")
        owner[code], node[code] = owner_all, node_all
        u, v = code[:len(pdf)], code[len(pdf):]
        ui, g = u[inner], pdf["g"].to_numpy(float)
        gi, gb, ub = g[inner], g[~inner], u[~inner]
        held = pdf["fixed"].to_numpy(float)[~inner]
        diag = (np.bincount(u, g, n) + np.bincount(v, gi, n))
        b = np.bincount(ub, gb * held, n)
        k = len(names)

        def apply(p):
            return diag * p - np.bincount(ui, gi * p[v], n) - np.bincount(v, gi * p[ui], n)

        def dot(a, c):
            return np.bincount(owner, a * c, k)

        x, started = np.zeros(n), np.zeros(k, bool)
        if len(guess) and n:
            at = pd.Series(np.arange(n), index=pd.MultiIndex.from_arrays([np.asarray(names)[owner], node]))
            found = at.reindex(pd.MultiIndex.from_arrays([guess["ms_id"], guess["u"]])).to_numpy(float)
            known = ~np.isnan(found)
            x[found[known].astype(int)] = guess["fixed"].to_numpy(float)[known]
            x[np.bincount(owner, b * b, k)[owner] == 0] = 0.0  # nothing is held: zero it is
            started[owner[found[known].astype(int)]] = True
        r = b - apply(x)
        z = r / diag
        p = z.copy()
        rz, norm = dot(r, z), np.sqrt(dot(b, b))
        goal = tol * norm
        best = np.full(k, np.inf)
        rounds = np.zeros(k, "int64")
        stale = 0
        while True:
            err = np.sqrt(dot(r, r))
            live = err > goal
            improved = err < 0.5 * best
            best = np.where(improved, err, best)
            stale = 0 if (improved & live).any() else stale + 1
            # stop at the tolerance, or when rounding stops all further progress
            if not live.any() or stale > 50 + int(np.sqrt(n)):
                break
            rounds += live
            ap = apply(p)
            pap = dot(p, ap)
            alpha = np.where(live & (pap > 0), rz / np.where(pap > 0, pap, 1), 0.0)
            x += alpha[owner] * p
            r -= alpha[owner] * ap
            z = r / diag
            rz_new = dot(r, z)
            beta = np.where(live & (rz > 0), rz_new / np.where(rz > 0, rz, 1), 0.0)
            p = z + beta[owner] * p
            rz = rz_new
        left = b - apply(x)
        residual = np.sqrt(dot(left, left)) / np.where(norm > 0, norm, 1)
        return pd.DataFrame({"ms_id": names[owner], "node_id": node, "phi": x, "iterations": rounds[owner],
                             "residual": residual[owner], "converged": ~live[owner], "started": started[owner]})
    return solve


def _distributed(links: DataFrame, tol: float, max_rounds: int = 100_000) -> DataFrame:
    """Same conjugate-gradient method for samples beyond the kernel bound.

    Vectors are rows ``(ms_id, node_id, x, r, p, diag)``; a matrix-vector product
    is a join of arcs with ``p`` followed by a map-side combined sum.
    """
    links = cut(links.select("ms_id", "u", "v", "g", "fixed"))
    guess = links.filter("g = 0").select("ms_id", F.col("u").alias("node_id"), F.col("fixed").alias("x0"))
    links = links.filter("g <> 0")
    inner = links.filter("v is not null")
    arcs = cut(inner.select("ms_id", F.explode(F.array(
        F.struct(F.col("u").alias("node_id"), F.col("v").alias("nbr")),
        F.struct(F.col("v").alias("node_id"), F.col("u").alias("nbr")))).alias("a"), "g")
        .groupBy("ms_id", F.col("a.node_id").alias("node_id"), F.col("a.nbr").alias("nbr"))
        .agg(F.sum("g").alias("g")))
    held = links.filter("v is null").select("ms_id", F.col("u").alias("node_id"), "g",
                                            (F.col("g") * F.col("fixed")).alias("b"))
    terms = arcs.select("ms_id", "node_id", "g", F.lit(0.0).alias("b")).unionByName(held)
    key = ["ms_id", "node_id"]
    system = cut(terms.groupBy(*key).agg(F.sum("g").alias("diag"), F.sum("b").alias("b")))
    goal = cut(system.groupBy("ms_id").agg(F.sum(F.col("b") * F.col("b")).alias("bb")))
    first = cut(system.join(goal, "ms_id").join(guess.dropDuplicates(key), key, "left")
                .withColumn("started", F.col("x0").isNotNull())
                .withColumn("x", F.when(F.col("bb") > 0, F.col("x0")).otherwise(0.0)).drop("x0", "bb").fillna(0.0, "x"))
    pull = (arcs.join(first.select("ms_id", F.col("node_id").alias("nbr"), F.col("x").alias("xn")), ["ms_id", "nbr"])
            .groupBy(*key).agg(F.sum(F.col("g") * F.col("xn")).alias("s")))
    state = cut(first.join(pull, key, "left")
                .withColumn("r", F.col("b") - F.col("diag") * F.col("x") + F.coalesce("s", F.lit(0.0)))
                .select(*key, "diag", "x", "r", (F.col("r") / F.col("diag")).alias("p")))
    begun = first.groupBy("ms_id").agg(F.bool_or("started").alias("started"))

    def solved(after: DataFrame, rounds: int) -> DataFrame:
        record = after.join(goal, "ms_id").join(begun, "ms_id").select(
            "ms_id", F.lit(rounds).cast("long").alias("iterations"),
            F.coalesce(F.sqrt(F.try_divide("rr", "bb")), F.lit(0.0)).alias("residual"), F.lit(True).alias("converged"), "started")
        return state.select(*key, F.col("x").alias("phi")).join(record, "ms_id")

    rr = state.groupBy("ms_id").agg(F.sum(F.col("r") * F.col("r")).alias("rr"))
    if rr.join(goal, "ms_id").filter(F.col("rr") > F.col("bb") * (tol * tol)).isEmpty():
        return solved(rr, 0)
    for nth in range(1, max_rounds + 1):
        sums = (arcs.join(state.select("ms_id", F.col("node_id").alias("nbr"), F.col("p").alias("pn")),
                          ["ms_id", "nbr"])
                .groupBy(*key).agg(F.sum(F.col("g") * F.col("pn")).alias("s")))
        step = state.join(sums, key, "left").withColumn(
            "ap", F.col("diag") * F.col("p") - F.coalesce("s", F.lit(0.0))).drop("s")
        step = cut(step)
        scal = step.groupBy("ms_id").agg(
            F.sum(F.col("r") * F.col("r") / F.col("diag")).alias("rz"),
            F.sum(F.col("p") * F.col("ap")).alias("pap"))
        scal = scal.select("ms_id", "rz", F.coalesce(F.try_divide("rz", "pap"), F.lit(0.0)).alias("alpha"))
        moved = (step.join(scal, "ms_id")
                 .select(*key, "diag", (F.col("x") + F.col("alpha") * F.col("p")).alias("x"),
                         (F.col("r") - F.col("alpha") * F.col("ap")).alias("r"), "p", "rz"))
        moved = cut(moved)
        after = moved.groupBy("ms_id").agg(
            F.coalesce(F.try_divide(F.sum(F.col("r") * F.col("r") / F.col("diag")), F.max("rz")), F.lit(0.0)).alias("beta"),
            F.sum(F.col("r") * F.col("r")).alias("rr"))
        done = after.join(goal, "ms_id").filter(F.col("rr") > F.col("bb") * (tol * tol)).isEmpty()
        nxt = moved.join(after, "ms_id").select(
            *key, "diag", "x", "r", (F.col("r") / F.col("diag") + F.col("beta") * F.col("p")).alias("p"))
        nxt = cut(nxt)
        for old in (state, step, moved):
            release(old)
        state = nxt
        if done:
            rr = state.groupBy("ms_id").agg(F.sum(F.col("r") * F.col("r")).alias("rr"))
            return solved(rr, nth)
    raise RuntimeError(f"potentials did not converge to {tol} in {max_rounds} rounds")


def solve_potentials(links: DataFrame, tol: float = RELATIVE_TOL,
                     kernel_rows: int | None = None) -> DataFrame:
    """Potential of every node named by ``links``: ``(ms_id, node_id, phi)``."""
    return solve_recorded(links, tol, kernel_rows)[0]


def with_start(links: DataFrame, start: DataFrame) -> DataFrame:
    """``links`` with a first guess ``(ms_id, node_id, phi)``; guesses for other nodes and nulls are left aside."""
    nodes = (links.select("ms_id", F.explode(F.array("u", "v")).alias("node_id")).filter("node_id is not null").distinct())
    guess = start.filter("phi is not null").groupBy("ms_id", "node_id").agg(F.min("phi").alias("phi"))
    held = guess.join(nodes, ["ms_id", "node_id"], "left_semi").select(
        "ms_id", F.col("node_id").alias("u"), F.lit(None).cast("long").alias("v"), F.lit(0.0).alias("g"), F.col("phi").alias("fixed"))
    return links.select("ms_id", "u", "v", "g", "fixed").unionByName(held)


def solve_recorded(links: DataFrame, tol: float = RELATIVE_TOL, kernel_rows: int | None = None,
                   start: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(potentials, record)``; the record has one row per sample.

    ``iterations`` taken (of the loop a large sample was in), ``residual`` relative to
    the right-hand side, ``converged`` to ``tol`` and ``started`` from a guess.  Links
    without conductance are no links.
    """
    links = links.filter("g <> 0")
    if start is not None:
        links = with_start(links, start)
    links = cut(links.select("ms_id", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"),
                             F.col("g").cast("double").alias("g"), F.col("fixed").cast("double").alias("fixed")))
    ms_type = links.schema["ms_id"].dataType.simpleString()
    small, large = split_by_size(links, kernel_rows)
    parts = []
    if small is not None:
        parts.append(small.groupBy("pack").applyInPandas(
            _pack_solver(tol), f"ms_id {ms_type}, {_SOLVED}"))
    if large is not None:
        parts.append(_distributed(large, tol))
    if not parts:
        empty = links.sparkSession.createDataFrame([], f"ms_id {ms_type}, {_SOLVED}")
        parts.append(empty)
    out = cut(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))
    record = out.groupBy("ms_id").agg(F.max("iterations").alias("iterations"), F.max("residual").alias("residual"),
                                      F.bool_and("converged").alias("converged"), F.bool_or("started").alias("started"))
    return out.select("ms_id", "node_id", "phi"), record

"""Graph operators: components, reachability, path enumeration.

Loops run on whole tables of ``(ms_id, u, v)`` and cut lineage once per round.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from porespark.operators.grid import AXES, node_id
from porespark.plans.lineage import checkpoint_dir, cut, even
from porespark.plans.packing import PACK_ROWS

TILE_EDGE = 32


def _fingerprint(df: DataFrame) -> tuple:
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("ms_id", F.explode(F.array(
        F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select(
        "ms_id", "e.u", "e.v")


def components(edges: DataFrame) -> DataFrame:
    """Connected components ``(ms_id, node, component)``; label = smallest node (K1).

    Alternating large-star / small-star contraction (Kiveris et al., 2014): the
    edge set shrinks towards one star per component in O(log^2 n) rounds.
    Minima are map-side combined, so a hub costs no more than other nodes.
    """
    state = cut(edges.filter("u <> v").select("ms_id", F.greatest("u", "v").alias("u"),
                                              F.least("u", "v").alias("v")).distinct())
    mark = _fingerprint(state)
    while mark[0]:
        both = _both_ways(state)
        low = both.groupBy("ms_id", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.filter("v > u").join(even(low), ["ms_id", "u"])
                 .select("ms_id", F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("ms_id", "u").agg(F.min("v").alias("m"))
        small = (large.join(even(low), ["ms_id", "u"]).filter("v <> m")
                 .select("ms_id", F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("ms_id", "u", F.col("m").alias("v"))).distinct())
        state = cut(small)
        now = _fingerprint(state)
        if now == mark:
            break
        mark = now
    roots = state.select("ms_id", F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return state.select("ms_id", F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _tile_labeller(tile: int):
    """Components inside every tile of a pack, all tiles in one array pass."""
    side = tile + 1  # one empty layer keeps a step from reaching the next row or tile

    def label_tiles(pdf: pd.DataFrame) -> pd.DataFrame:
        which = pdf.groupby(["ms_id", "tx", "ty", "tz"], sort=False).ngroup().to_numpy().astype("int64")
        code = which
        for axis in AXES:
            code = code * side + pdf[axis].to_numpy() % tile
        order = np.argsort(code)
        code = code[order]
        u, v = [], []
        for step in (side * side, side, 1):
            at = np.searchsorted(code, code + step)
            hit = at < len(code)
            hit[hit] = code[at[hit]] == code[hit.nonzero()[0]] + step
            u.append(hit.nonzero()[0])
            v.append(at[hit])
        u, v = np.concatenate(u), np.concatenate(v)
        label = np.arange(len(code))
        while True:
            low = np.minimum(label[u], label[v])
            nxt = label.copy()
            np.minimum.at(nxt, label[u], low)
            np.minimum.at(nxt, label[v], low)
            nxt = nxt[nxt]
            if np.array_equal(nxt, label):
                break
            label = nxt
        out = pdf[["ms_id", *AXES, "node_id"]].iloc[order].copy()
        out["root"] = out["node_id"].to_numpy()[label]
        return out
    return label_tiles


def grid_components(pore: DataFrame, tile: int = TILE_EDGE) -> DataFrame:
    """Components of the 6-connected pore grid: ``(ms_id, node_id, component)``.

    Voxels are labelled inside fixed-size tiles first, so the work of a task is
    bounded by tiles, never by the sample: tiles are hashed to packs of about
    PACK_ROWS voxels.  Only tile-face contacts between the labels go through the
    distributed contraction.
    """
    ms_type = pore.schema["ms_id"].dataType.simpleString()
    tiles = [F.floor(F.col(a) / tile).cast("int").alias(f"t{a}") for a in AXES]
    packs = max(int(pore.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(pore.count() / PACK_ROWS))
    pack = F.pmod(F.xxhash64("ms_id", "tx", "ty", "tz"), F.lit(packs)).alias("pack")
    labelled = (pore.select("ms_id", *AXES, node_id().alias("node_id"), *tiles).select("*", pack)
                .repartition(packs, "pack").groupBy("pack")
                .applyInPandas(_tile_labeller(tile), f"ms_id {ms_type}, x int, y int, z int, node_id long, root long"))
    labelled = cut(labelled)
    contacts = None
    for axis in AXES:
        near = labelled.filter(F.col(axis) % tile == tile - 1).select(
            "ms_id", *[(F.col(a) + 1 if a == axis else F.col(a)).alias(a) for a in AXES],
            F.col("root").alias("u"))
        far = labelled.filter((F.col(axis) % tile == 0) & (F.col(axis) > 0)).select(
            "ms_id", *AXES, F.col("root").alias("v"))
        pair = near.join(even(far), ["ms_id", *AXES]).select("ms_id", "u", "v").distinct()
        contacts = pair if contacts is None else contacts.unionByName(pair)
    contacts = cut(contacts)
    if contacts.isEmpty():
        return labelled.select("ms_id", "node_id", F.col("root").alias("component"))
    merged = components(contacts).select("ms_id", F.col("node").alias("root"), "component")
    return (labelled.join(even(merged), ["ms_id", "root"], "left")
            .select("ms_id", "node_id", F.coalesce("component", "root").alias("component")))


def component_kinds(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """spanning / inlet_only / outlet_only / floating_disconnected per component."""
    per = (nodes.select("ms_id", "node_id", "is_inlet", "is_outlet")
           .join(labels, ["ms_id", "node_id"])
           .groupBy("ms_id", "component")
           .agg(F.count(F.lit(1)).alias("n_nodes"), F.bool_or("is_inlet").alias("has_inlet"),
                F.bool_or("is_outlet").alias("has_outlet")))
    kind = (F.when(F.col("has_inlet") & F.col("has_outlet"), "spanning")
            .when(F.col("has_inlet"), "inlet_only").when(F.col("has_outlet"), "outlet_only")
            .otherwise("floating_disconnected"))
    return per.withColumn("kind", kind)


def reachable(arcs: DataFrame, start: DataFrame) -> DataFrame:
    """Nodes reached from ``start`` along ``tail -> head`` arcs, start included.

    Frontier loop: each round joins only the newest nodes with the arcs and appends
    what is new to the visited nodes as a folder of its own, so the bytes written grow
    with the nodes, not with nodes times rounds.
    """
    spark = arcs.sparkSession
    arcs = cut(arcs.select("ms_id", "tail", "head").distinct())
    first = start.select("ms_id", "node").distinct()
    folder, schema = f"{checkpoint_dir(spark)}/visited-{uuid.uuid4().hex}", first.schema
    rounds: list[str] = []

    def visited(paths: list[str]) -> DataFrame:
        return spark.read.schema(schema).parquet(*paths)

    def append(new: DataFrame) -> DataFrame:
        rounds.append(f"{folder}/{len(rounds):06d}")
        new.write.parquet(rounds[-1])
        return visited(rounds[-1:])

    frontier = append(first)
    while not frontier.isEmpty():
        step = (arcs.join(even(frontier.withColumnRenamed("node", "tail")), ["ms_id", "tail"])
                .select("ms_id", F.col("head").alias("node")).distinct())
        frontier = append(step.join(even(visited(rounds)), ["ms_id", "node"], "left_anti"))
    return visited(rounds)


def prune_to_sink(dag: DataFrame) -> DataFrame:
    """Keep DAG edges whose head reaches the virtual sink (K8).

    ``dag`` has ``up, dn, kind``; kind 1 = source edge, 2 = sink edge.
    """
    sinks = dag.filter("kind = 2").select("ms_id", F.col("up").alias("node"))
    internal = dag.filter("kind = 0").select("ms_id", F.col("dn").alias("tail"), F.col("up").alias("head"))
    alive = reachable(internal, sinks)
    ends = dag.filter("kind <> 2").join(even(alive.withColumnRenamed("node", "dn")), ["ms_id", "dn"], "left_semi")
    return ends.select(*dag.columns).unionByName(dag.filter("kind = 2"))


def through_flow(arcs: DataFrame, inlets: DataFrame, outlets: DataFrame) -> DataFrame:
    """Nodes on a directed inlet -> outlet route (K9): forward AND backward reach."""
    forward = reachable(arcs, inlets)
    backward = reachable(arcs.select("ms_id", F.col("head").alias("tail"), F.col("tail").alias("head")), outlets)
    return forward.join(even(backward), ["ms_id", "node"], "left_semi")


def boundary_connected(links: DataFrame, bodies: DataFrame) -> DataFrame:
    """Iterative pre-solve filter (K10): ``(ms_id, body_id, active)``.

    Interior bodies need two active neighbours and a route to both sides;
    boundary bodies need one neighbour and a route to the other side.  A
    neighbour's component is the body's own, so routes are component flags.
    ``links``: i, j; ``bodies``: body_id, is_inlet, is_outlet.
    """
    alive = cut(bodies.select("ms_id", "body_id", "is_inlet", "is_outlet").distinct())
    links = cut(links.select("ms_id", "i", "j").filter("i <> j").distinct())
    while True:
        keep = even(alive.select("ms_id", "body_id"))
        live = (links.join(keep.withColumnRenamed("body_id", "i"), ["ms_id", "i"], "left_semi")
                .join(keep.withColumnRenamed("body_id", "j"), ["ms_id", "j"], "left_semi")
                .select("ms_id", F.col("i").alias("u"), F.col("j").alias("v")))
        live = cut(live)
        comp = components(live).withColumnRenamed("node", "body_id")
        degree = (_both_ways(live).distinct().groupBy("ms_id", F.col("u").alias("body_id"))
                  .agg(F.count(F.lit(1)).alias("n_nbr")))
        tagged = alive.join(even(comp), ["ms_id", "body_id"], "left").join(even(degree), ["ms_id", "body_id"], "left")
        flags = (tagged.filter("component is not null").groupBy("ms_id", "component")
                 .agg(F.bool_or("is_inlet").alias("in_c"), F.bool_or("is_outlet").alias("out_c")))
        tagged = tagged.join(even(flags), ["ms_id", "component"], "left")
        n = F.coalesce("n_nbr", F.lit(0))
        to_in, to_out = F.coalesce("in_c", F.lit(False)), F.coalesce("out_c", F.lit(False))
        ok = (F.when(F.col("is_inlet"), (n >= 1) & to_out)
              .when(F.col("is_outlet"), (n >= 1) & to_in)
              .otherwise((n >= 2) & to_in & to_out))
        nxt = cut(tagged.filter(ok).select("ms_id", "body_id", "is_inlet", "is_outlet"))
        if nxt.count() == alive.count():
            break
        alive = nxt
    return (bodies.select("ms_id", "body_id")
            .join(even(alive.select("ms_id", "body_id", F.lit(True).alias("active"))), ["ms_id", "body_id"], "left")
            .select("ms_id", "body_id", F.coalesce("active", F.lit(False)).alias("active")))

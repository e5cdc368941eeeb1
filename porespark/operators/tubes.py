"""Streamtube decomposition of a solved flow and its volume/tortuosity averages.

The flow is a relation of directed edges ``(ms_id, up, dn, flow, dphi, kind,
edge_id, seg_len, ord, seq, phi_up, thr)`` with a virtual source and sink; kind
0 = internal, 1 = source, 2 = sink.  ``(ord, seq)`` orders the edges that leave
one node.  The topological method is rounds of joins at every size.  The two greedy
ones take samples within the measured bound in grouped calls; beyond it the strongest
source first is rounds of joins, and the fullest inlet first one walk per sample off a
sorted file.  Path attributes are plain aggregations.
"""

from __future__ import annotations

import heapq
import os
import struct
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from porespark.config import VoxelConfig
from porespark.operators import graph
from porespark.plans.lineage import cut, even
from porespark.plans.packing import split_by_size, spread

SOURCE, SINK = -1, -2
LEDGER = 9  # kind of the one bookkeeping row per sample
UNDECOMPOSED = -1  # stuck traces in the ledger of a sample that the caller's own bound left out
DRAINED = 8  # kind of a row for current drained from an edge that leads nowhere

STEP_COLUMNS = ["ms_id", "path_id", "step", "up", "dn", "kind", "edge_id", "i_gamma", "seg_len", "dphi"]
DAG_COLUMNS = ["ms_id", "up", "dn", "flow", "dphi", "kind", "edge_id", "seg_len", "ord", "seq", "phi_up", "thr"]


# --- flow relations --------------------------------------------------------------

def voxel_dag(currents: DataFrame, phi: DataFrame, transport: DataFrame, cfg: VoxelConfig) -> DataFrame:
    """Directed, thresholded voxel flow with half-cell source and sink edges."""
    gb, half = 2.0 * cfg.conductance, 0.5 * cfg.link_length
    scale = F.greatest(F.coalesce("max_edge_current", F.lit(0.0)), F.coalesce("max_inlet_current", F.lit(0.0)),
                       F.lit(cfg.abs_current_tol))
    thr = transport.select("ms_id", F.greatest(F.lit(cfg.abs_current_tol), cfg.rel_current_tol * scale).alias("thr"))
    forward = F.col("current") > 0
    inner = currents.select(
        "ms_id", F.when(forward, F.col("u")).otherwise(F.col("v")).alias("up"),
        F.when(forward, F.col("v")).otherwise(F.col("u")).alias("dn"), F.abs("current").alias("flow"),
        F.abs(F.col("phi_u") - F.col("phi_v")).alias("dphi"), F.lit(0).alias("kind"), F.col("u").alias("edge_id"),
        F.lit(float(cfg.dx)).alias("seg_len"), (F.when(forward, 0).otherwise(3) + F.col("axis")).cast("int").alias("ord"),
        F.lit(0).cast("long").alias("seq"), F.greatest("phi_u", "phi_v").alias("phi_up"))

    def boundary(flag, up, dn, drop, kind, phi_up):
        return phi.filter(flag).select(
            "ms_id", up.cast("long").alias("up"), dn.cast("long").alias("dn"), (gb * drop).alias("flow"), drop.alias("dphi"),
            F.lit(kind).alias("kind"), F.lit(-1).cast("long").alias("edge_id"), F.lit(half).alias("seg_len"),
            F.lit(6).alias("ord"), F.col("node_id").alias("seq"), phi_up.alias("phi_up"))
    node = F.col("node_id")
    src = boundary("is_inlet", F.lit(SOURCE), node, cfg.inlet_value - F.col("phi"), 1, F.lit(float("inf")))
    snk = boundary("is_outlet", node, F.lit(SINK), F.col("phi") - cfg.outlet_value, 2, F.col("phi"))
    return (inner.unionByName(src).unionByName(snk).join(thr, "ms_id")
            .filter("flow > thr and dphi > 0").select(*DAG_COLUMNS))


def network_dag(currents: DataFrame, bodies: DataFrame, tot: DataFrame) -> DataFrame:
    """Same relation for throats; terminal edges carry the node's whole out/in flow."""
    t = currents.filter("i is not null").join(tot.select("ms_id", F.col("i_threshold").alias("thr")), "ms_id")
    forward = F.col("current") > 0
    inner = t.filter(F.abs("current") > F.col("thr")).select(
        "ms_id", F.when(forward, F.col("i")).otherwise(F.col("j")).cast("long").alias("up"),
        F.when(forward, F.col("j")).otherwise(F.col("i")).cast("long").alias("dn"), F.abs("current").alias("flow"),
        F.abs(F.col("phi_i") - F.col("phi_j")).alias("dphi"), F.lit(0).alias("kind"),
        F.col("throat_id").cast("long").alias("edge_id"),
        (F.col("l_body1") + F.col("l_throat") + F.col("l_body2")).alias("seg_len"),
        F.when(forward, 0).otherwise(1).alias("ord"), F.col("throat_id").cast("long").alias("seq"),
        F.greatest("phi_i", "phi_j").alias("phi_up"), "thr")

    def terminal(flag, end, kind):
        flow = inner.groupBy("ms_id", F.col(end).alias("node")).agg(F.sum("flow").alias("flow"), F.max("thr").alias("thr"))
        side = bodies.filter(flag).select("ms_id", F.col("body_id").cast("long").alias("node"), "phi")
        up, dn = (F.lit(SOURCE), F.col("node")) if kind == 1 else (F.col("node"), F.lit(SINK))
        return flow.join(side, ["ms_id", "node"]).filter("flow > thr").select(
            "ms_id", up.cast("long").alias("up"), dn.cast("long").alias("dn"), "flow", F.lit(0.0).alias("dphi"),
            F.lit(kind).alias("kind"), F.lit(-1).cast("long").alias("edge_id"), F.lit(0.0).alias("seg_len"),
            F.lit(2).alias("ord"), F.col("node").alias("seq"),
            (F.lit(float("inf")) if kind == 1 else F.col("phi")).alias("phi_up"), "thr")
    inner = cut(inner)
    return inner.unionByName(terminal("is_inlet", "up", 1)).unionByName(terminal("is_outlet", "dn", 2)).select(*DAG_COLUMNS)


# --- grouped decomposition --------------------------------------------------------

class _Flow:
    """Out-edge lists of one sample, pruned to edges whose head reaches the sink."""

    def __init__(self, up: list, dn: list, flow: list, thr: float):
        """Edges come sorted by tail, ord and seq."""
        self.up, self.dn, self.left, self.thr = up, dn, flow, thr
        self.drained = []
        into = {}
        for e, head in enumerate(self.dn):
            into.setdefault(head, []).append(e)
        alive, stack = {SINK}, [SINK]
        while stack:
            for e in into.get(stack.pop(), ()):
                if self.up[e] not in alive:
                    alive.add(self.up[e])
                    stack.append(self.up[e])
        self.out = {}
        for e, (tail, head) in enumerate(zip(self.up, self.dn)):
            if head in alive:
                self.out.setdefault(tail, []).append(e)

    def strongest(self, node, skip=()):
        best, top = None, self.thr
        for e in self.out.get(node, ()):
            if self.left[e] > top and self.dn[e] not in skip:
                best, top = e, self.left[e]
        return best


def _greedy(f: _Flow):
    """Strongest source first, strongest outgoing edge at every node."""
    paths, stuck, lost = [], 0, 0.0
    heap = [(-f.left[e], e) for e in f.out.get(SOURCE, ())]
    heapq.heapify(heap)
    while heap and -heap[0][0] > f.thr:
        first = heap[0][1]
        path, node = [first], f.dn[first]
        while node != SINK:
            e = f.strongest(node)
            if e is None:
                break
            path.append(e)
            node = f.dn[e]
        if node != SINK:
            stuck, lost = stuck + 1, lost + f.left[first]
            f.left[first] = 0.0
            heapq.heappop(heap)
            continue
        amount = min(f.left[e] for e in path)
        for e in path:
            rest = f.left[e] - amount
            f.left[e] = 0.0 if rest < f.thr else rest
        paths.append((amount, path))
        heapq.heapreplace(heap, (-f.left[first], first))
    return paths, (stuck, lost, 0.0)


def _inlet_greedy(f: _Flow):
    """Inlet node with the largest remaining outflow, then strongest unvisited successor."""
    inlets = [f.dn[e] for e in f.out.get(SOURCE, ())]
    outlets = {f.up[e] for e, head in enumerate(f.dn) if head == SINK}
    paths, stuck, lost = [], 0, 0.0

    def drain(e):
        nonlocal lost
        if f.left[e] > f.thr:
            f.drained.append((e, f.left[e]))
            lost += f.left[e]
        f.left[e] = 0.0

    while True:
        src, top = None, f.thr
        for n in inlets:
            total = sum(f.left[e] for e in f.out.get(n, ()) if f.dn[e] != SINK)
            if total > top:
                src, top = n, total
        if src is None:
            return paths, (stuck, lost, 0.0)
        path, node, seen = [], src, {src}
        while node not in outlets:
            e = f.strongest(node, seen)
            if e is None:
                break
            path.append(e)
            node = f.dn[e]
            seen.add(node)
        if node not in outlets:
            stuck += 1
            if path:
                drain(path[0])
            else:
                for e in f.out[src]:
                    f.left[e] = 0.0
            continue
        amount = min(f.left[e] for e in path)
        for e in path:
            f.left[e] = max(f.left[e] - amount, 0.0)
        paths.append((amount, path))


WALKS = {"greedy_fast": _greedy, "flow_decomposition": _inlet_greedy}
METHODS = (*WALKS, "topological")


def _pack_decomposer(method: str):
    run = WALKS[method]

    def decompose(pdf: pd.DataFrame) -> pd.DataFrame:
        # one sort and one output for the pack; samples are slices of its lists
        which, names = pd.factorize(pdf["ms_id"])
        order = np.lexsort((pdf["seq"], pdf["ord"], pdf["up"], which))
        order = order[which[order] >= 0]
        rows, which = pdf.iloc[order], which[order]
        up, dn, left = rows["up"].tolist(), rows["dn"].tolist(), rows["flow"].tolist()
        thr, bounds = rows["thr"].to_numpy(float), np.searchsorted(which, np.arange(len(names) + 1)).tolist()
        taken, numbers, lens, amounts, gone, gone_amounts, places, ledgers = [], [], [], [], [], [], [], []
        for lo, hi in zip(bounds, bounds[1:]):
            flow = _Flow(up[lo:hi], dn[lo:hi], left[lo:hi], float(thr[lo]))
            paths, ledger = run(flow)
            for number, (amount, path) in enumerate(paths):
                taken.extend([lo + e for e in path])
                numbers.append(number)
                lens.append(len(path))
                amounts.append(amount)
            gone.extend([lo + e for e, _ in flow.drained])
            gone_amounts.extend([a for _, a in flow.drained])
            places.extend(range(len(flow.drained)))
            ledgers.append(ledger)
        lens = np.array(lens, dtype=int)
        steps = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)

        def picked(at: list, path_id, step, amount, **columns) -> pd.DataFrame:
            found = rows.iloc[np.array(at, dtype=int)][["ms_id", "up", "dn", "kind", "edge_id", "seg_len", "dphi"]].reset_index(drop=True)
            return found.assign(path_id=path_id, step=step, i_gamma=np.array(amount, dtype=float), **columns)[STEP_COLUMNS]
        out = [picked(taken, np.repeat(np.array(numbers, dtype=int), lens), steps, np.repeat(np.array(amounts, dtype=float), lens)),
               picked(gone, -1, np.array(places, dtype=int), gone_amounts, kind=DRAINED),
               pd.DataFrame({"ms_id": names, "path_id": -1, "step": [n for n, _, _ in ledgers], "up": 0, "dn": 0, "kind": LEDGER, "edge_id": -1,
                             "i_gamma": [float(lost) for _, lost, _ in ledgers], "seg_len": 0.0, "dphi": [float(rest) for _, _, rest in ledgers]})]
        return pd.concat([part for part in out if len(part)], ignore_index=True)[STEP_COLUMNS] if ledgers else out[0]
    return decompose


# --- one path at a time, off a file ------------------------------------------------

STORED_EDGE = np.dtype([("up", "<i8"), ("dn", "<i8"), ("left", "<f8"), ("edge", "<i8")])
BLOCK_EDGES = 1024     # edges that are read at one time
BATCH_STEPS = 100_000  # path steps that are returned at one time


class _StoredFlow:
    """Edges of one sample in a nameless file, sorted by tail, ord and seq; memory holds the first tail of each block."""

    def __init__(self, block: int):
        self.file, self.block, self.size, self.marks = tempfile.TemporaryFile(), block, 0, []

    def append(self, rows: np.ndarray) -> None:
        self.marks.append(rows["up"][-self.size % self.block::self.block].copy())
        self.file.write(rows.tobytes())
        self.size += len(rows)

    def whole(self) -> _StoredFlow:
        self.file.flush()
        self.marks = np.concatenate(self.marks) if self.marks else np.empty(0, "int64")
        return self

    def leaving(self, node: int) -> Iterator[tuple[int, int, float, int]]:
        """``(place, head, what is left, edge)`` of the edges that leave ``node``, in order."""
        width = STORED_EDGE.itemsize
        for at in range(max(int(np.searchsorted(self.marks, node)) - 1, 0) * self.block, self.size, self.block):
            rows = np.frombuffer(os.pread(self.file.fileno(), self.block * width, at * width), STORED_EDGE)
            lo, hi = np.searchsorted(rows["up"], node, "left"), np.searchsorted(rows["up"], node, "right")
            yield from zip(range(at + lo, at + hi), rows["dn"][lo:hi].tolist(), rows["left"][lo:hi].tolist(), rows["edge"][lo:hi].tolist())
            if hi < len(rows):
                return

    def leave(self, place: int, left: float) -> None:
        os.pwrite(self.file.fileno(), struct.pack("<d", left), place * STORED_EDGE.itemsize + STORED_EDGE.fields["left"][1])

    def outflow(self, node: int) -> float:
        return sum(left for _, head, left, _ in self.leaving(node) if head != SINK)


def _inlet_walk(f: _StoredFlow, inlets: list[int], thr: float) -> Iterator[tuple[int, list[int], float]]:
    """The choices of ``_inlet_greedy``: ``(kind, edges, amount)`` of paths and drained edges, at last of the ledger."""
    place: dict[int, list[int]] = {}
    for k, n in enumerate(inlets):
        place.setdefault(n, []).append(k)
    totals = np.array([f.outflow(n) for n in inlets])
    stuck, lost = 0, 0.0
    while len(totals):
        first = int(np.argmax(totals))
        if not totals[first] > thr:
            break
        node, path, tails, arrived = inlets[first], [], [], False
        seen = {node}
        while True:
            best, top = None, thr
            for step in f.leaving(node):
                arrived = arrived or step[1] == SINK
                if step[2] > top and step[1] not in seen:
                    best, top = step, step[2]
            if arrived or best is None:
                break
            path.append(best)
            tails.append(node)
            node = best[1]
            seen.add(node)
        if arrived:
            amount = min(left for _, _, left, _ in path)
            for at, _, left, _ in path:
                f.leave(at, max(left - amount, 0.0))
            yield 0, [edge for *_, edge in path], amount
        elif path:
            at, _, left, edge = path[0]
            f.leave(at, 0.0)
            stuck, lost = stuck + 1, lost + left
            yield DRAINED, [edge], left
        else:
            for at, *_ in list(f.leaving(node)):
                f.leave(at, 0.0)
            stuck, tails = stuck + 1, [node]
        for n in tails:
            for k in place.get(n, ()):
                totals[k] = f.outflow(n)
    yield LEDGER, [stuck], lost


def _stored_walker(schema: pa.Schema, block: int = BLOCK_EDGES, most: int = BATCH_STEPS) -> Callable:
    """Samples of any size one after the other, off rows that are sorted by sample, tail, ord and seq."""
    def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        name = None
        for b in batches:
            names = b.column("ms_id").to_pylist()
            starts = [k for k in range(len(names)) if not k or names[k] != names[k - 1]]
            for lo, hi in zip(starts, [*starts[1:], len(names)]):
                part = b.slice(lo, hi - lo)
                if name is None or names[lo] != name:
                    if name is not None:
                        yield name, flow.whole(), inlets, thr
                    name, flow, inlets, thr = names[lo], _StoredFlow(block), [], part.column("thr")[0].as_py()
                rows = np.empty(hi - lo, STORED_EDGE)
                for c in STORED_EDGE.names:
                    rows[c] = part.column(c).to_numpy(zero_copy_only=False)
                inlets.extend(rows["dn"][rows["up"] == SOURCE].tolist())
                flow.append(rows[rows["up"] != SOURCE])
        if name is not None:
            yield name, flow.whole(), inlets, thr

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out.clear()
            return made
        for name, flow, inlets, thr in samples(batches):
            paths = drained = 0
            for kind, edges, amount in _inlet_walk(flow, inlets, thr):
                if kind == 0:
                    out.extend((name, paths, k, kind, e, amount) for k, e in enumerate(edges))
                    paths += 1
                elif kind == DRAINED:
                    out.append((name, -1, drained, kind, edges[0], amount))
                    drained += 1
                else:
                    out.append((name, -1, edges[0], kind, -1, amount))
                if len(out) >= most:
                    yield batch()
            flow.file.close()
        if out:
            yield batch()
    return run


def _inlet_stored(dag: DataFrame) -> DataFrame:
    """Fullest inlet first for samples of any size; same choices as the grouped version.

    One path after another is the definition, so a sample is one task.  Its edges stay in a
    file of the task, of which memory holds a block, a path and the inlets' outflows.
    """
    edges = cut(graph.prune_to_sink(dag).withColumn("edge", F.monotonically_increasing_id()))
    schema = edges.select("ms_id").schema.add("path_id", "long").add("step", "integer").add("kind", "integer").add("edge", "long").add("i_gamma", "double")
    rows = (spread(edges.select("ms_id", "up", "dn", F.col("flow").alias("left"), "thr", "ord", "seq", "edge"), ["ms_id"])
            .sortWithinPartitions("ms_id", "up", "ord", "seq", "edge"))
    walked = cut(rows.mapInArrow(_stored_walker(to_arrow_schema(schema)), schema))
    terms = edges.select("edge", "up", "dn", F.col("kind").alias("_kind"), "edge_id", "seg_len", "dphi")
    steps = walked.filter(F.col("kind") != LEDGER).join(even(terms), "edge").withColumn(
        "kind", F.when(F.col("kind") == DRAINED, F.col("kind")).otherwise(F.col("_kind")))
    # a sample whose edges all lead nowhere has no walk
    ends = walked.filter(F.col("kind") == LEDGER).select("ms_id", F.col("step").alias("n"), F.col("i_gamma").alias("lost"))
    ends = dag.select("ms_id").distinct().join(ends, "ms_id", "left")
    return steps.select(*STEP_COLUMNS).unionByName(_ledger(ends, F.coalesce("n", F.lit(0)), F.coalesce("lost", F.lit(0.0))))


# --- decomposition by rounds of joins ----------------------------------------------

def _greedy_rounds(dag: DataFrame) -> DataFrame:
    """One path per sample and round; same choices as the grouped version."""
    edges = cut(graph.prune_to_sink(dag).withColumn("left", F.col("flow")))
    key = ["ms_id", "up", "ord", "seq"]
    carry = ["dn", "kind", "edge_id", "seg_len", "dphi", "left", "ord", "seq"]
    found, ledgers, number = [], [], 0
    while True:
        open_ = edges.filter("left > thr")
        rank = F.struct("left", -F.col("ord"), -F.col("seq"))
        best = cut(open_.groupBy("ms_id", "up").agg(F.max_by(F.struct(*carry), rank).alias("b")).select("ms_id", "up", "b.*"))
        at = cut(best.filter(F.col("up") == SOURCE).withColumn("step", F.lit(0)))
        if at.isEmpty():
            break
        trail = [at]
        while True:
            nxt = (at.filter(F.col("dn") != SINK).select("ms_id", F.col("dn").alias("up"), (F.col("step") + 1).alias("step"))
                   .join(best, ["ms_id", "up"]))
            at = cut(nxt.select(*trail[0].columns))
            if at.isEmpty():
                break
            trail.append(at)
        walk = trail[0]
        for piece in trail[1:]:
            walk = walk.unionByName(piece)
        walk = cut(walk)
        ends = walk.groupBy("ms_id").agg(F.min("left").alias("amount"), F.bool_or(F.col("dn") == SINK).alias("whole"))
        taken = walk.join(ends, "ms_id")
        stuck = taken.filter("not whole and step = 0")
        strip = cut(taken.filter("whole").select(*key, "amount").unionByName(
            stuck.select(*key, F.col("left").alias("amount"))))
        found.append(cut(taken.filter("whole").select(
            "ms_id", F.lit(number).alias("path_id"), "step", "up", "dn", "kind", "edge_id",
            F.col("amount").alias("i_gamma"), "seg_len", "dphi")))
        ledgers.append(cut(stuck.select("ms_id", F.col("left").alias("lost"))))
        rest = F.col("left") - F.coalesce("amount", F.lit(0.0))
        edges = cut(edges.join(strip, key, "left").withColumn("left", F.when(rest < F.col("thr"), 0.0).otherwise(rest)).drop("amount"))
        number += 1
    return _collect_rounds(dag, found, ledgers)


def _topological_rounds(dag: DataFrame) -> DataFrame:
    """One pass from high to low potential, all ready nodes at once (K5).

    Flow moves in packets.  A node's packets, first come first served, fill its edges
    in order: the match is an overlap of two running sums.  A packet is a row that names
    the packet it came from; what moves between rounds has no path in it.  Paths are
    rebuilt at the end by pointer doubling.
    """
    edges = cut(graph.prune_to_sink(dag))
    thr = edges.select("ms_id", "thr").distinct()
    level, last = _levels(edges)
    head = level.select("ms_id", F.col("node").alias("dn"), F.col("level").alias("next"))
    wire = ["up", "dn", "kind", "edge_id", "seg_len", "dphi"]
    # what does not change from round to round is made once: the share of its node's flow that an edge takes, and when
    w = Window.partitionBy("ms_id", "up").orderBy("ord", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slots = (edges.filter("kind <> 1").withColumn("e_hi", F.sum("flow").over(w)).withColumn("e_lo", F.col("e_hi") - F.col("flow"))
             .join(even(level.withColumnRenamed("node", "up")), ["ms_id", "up"]).join(even(head), ["ms_id", "dn"], "left")
             .select("ms_id", *wire, "thr", "phi_up", "e_lo", "e_hi", "next", "level"))
    slots = cut(slots.sortWithinPartitions("level"))
    first = cut(edges.filter("kind = 1").join(even(head), ["ms_id", "dn"], "left").select(
        "ms_id", *wire, F.col("flow").alias("amount"), F.lit(float("inf")).alias("phi_from"), F.lit(SOURCE).cast("long").alias("from"),
        F.col("seq").cast("double").alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("born"), F.monotonically_increasing_id().alias("rid"),
        F.lit(None).cast("int").alias("pborn"), F.lit(None).cast("long").alias("prid"), "next"))
    going = ["ms_id", "node", "amount", "phi_from", "from", "at", "depth", "born", "rid", "next"]
    packets = first.withColumnRenamed("dn", "node").select(*going)
    log = [first]
    # a running sum streams through its task, so a node that all packets pass costs time there, not memory
    queue = (Window.partitionBy("ms_id", "node").orderBy(F.col("phi_from").desc(), F.col("from").asc(), F.col("at").asc())
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    for now in range(last + 1):
        here = packets.filter(F.col("next") == now).withColumn("hi", F.sum("amount").over(queue))
        here = here.withColumn("lo", F.col("hi") - F.col("amount"))
        both = (here.select("ms_id", F.col("node").alias("up"), "lo", "hi", F.col("depth"), F.col("born").alias("pborn"), F.col("rid").alias("prid"))
                .join(slots.filter(F.col("level") == now).drop("level"), ["ms_id", "up"]))
        part = F.least("hi", "e_hi") - F.greatest("lo", "e_lo")
        sent = cut(both.withColumn("part", part).filter("part > thr").select(
            "ms_id", *wire, F.col("part").alias("amount"), F.col("phi_up").alias("phi_from"), F.col("up").alias("from"),
            F.greatest("lo", "e_lo").alias("at"), (F.col("depth") + 1).alias("depth"), F.lit(len(log)).alias("born"),
            F.monotonically_increasing_id().alias("rid"), "pborn", "prid", "next"))
        log.append(sent)
        moved = sent.filter(F.col("dn") != SINK).withColumnRenamed("dn", "node").select(*going)
        packets = cut(packets.filter(F.col("next") > now).unionByName(moved))
    sent = log[0]
    for piece in log[1:]:
        sent = sent.unionByName(piece)
    sent = cut(sent)
    # path numbers only need to be unique within a sample
    done = cut(sent.filter(F.col("dn") == SINK).select("ms_id", "amount", "depth", "born", "rid", F.monotonically_increasing_id().alias("path_id")))
    steps = (_ancestors(done, sent).join(sent.select("ms_id", "born", "rid", *wire), ["ms_id", "born", "rid"])
             .select("ms_id", "path_id", (F.col("depth") - F.col("back")).cast("int").alias("step"), "up", "dn", "kind", "edge_id",
                     F.col("amount").alias("i_gamma"), "seg_len", "dphi"))
    injected = edges.filter("kind = 1").groupBy("ms_id").agg(F.sum("flow").alias("src"))
    out = done.groupBy("ms_id").agg(F.sum("amount").alias("got"))
    ledger = thr.join(injected, "ms_id", "left").join(out, "ms_id", "left").select(
        "ms_id", (F.coalesce("src", F.lit(0.0)) - F.coalesce("got", F.lit(0.0))).alias("lost"))
    return steps.unionByName(_ledger(ledger, F.lit(0), F.col("lost")))


def _levels(edges: DataFrame) -> tuple[DataFrame, int]:
    """``(ms_id, node, level)``, the round in which all flow into a node is known, and the last round.

    Only node pairs and counts take part in this loop, no flow; rows leave it with their nodes.
    """
    arcs = cut(edges.filter("kind = 0").select("ms_id", "up", "dn"))
    heads = arcs.groupBy("ms_id", F.col("dn").alias("node")).agg(F.count(F.lit(1)).alias("wait"))
    waiting = cut(edges.filter(F.col("up") != SOURCE).select("ms_id", F.col("up").alias("node")).distinct()
                  .join(even(heads), ["ms_id", "node"], "left").select("ms_id", "node", F.coalesce("wait", F.lit(0)).alias("wait")))
    found = []
    while True:
        left, free = waiting.agg(F.count(F.lit(1)), F.count_if(F.col("wait") == 0)).first()
        if found and not left:
            break
        if left and not free:
            raise RuntimeError("flow relation is not acyclic")
        ready = waiting.filter("wait = 0").select("ms_id", "node")
        found.append(ready.withColumn("level", F.lit(len(found))))
        freed = (arcs.join(ready.withColumnRenamed("node", "up"), ["ms_id", "up"], "left_semi")
                 .groupBy("ms_id", F.col("dn").alias("node")).agg(F.count(F.lit(1)).alias("n")))
        waiting = cut(waiting.filter("wait > 0").join(freed, ["ms_id", "node"], "left")
                      .select("ms_id", "node", (F.col("wait") - F.coalesce("n", F.lit(0))).alias("wait")))
    level = found[0]
    for piece in found[1:]:
        level = level.unionByName(piece)
    return cut(level), len(found) - 1


def _ancestors(done: DataFrame, sent: DataFrame) -> DataFrame:
    """``done`` once for each packet of its path, ``back`` packets before the last.

    Each round doubles the distance that a pointer spans and the part of the paths that
    is known, so a path of n packets takes log2(n) rounds.
    """
    key = ["ms_id", "born", "rid"]
    jump = sent.filter("pborn is not null").select(*key, "pborn", "prid")
    known = done.withColumn("back", F.lit(0))
    span = 1
    while not jump.isEmpty():
        older = known.join(jump, key).select("ms_id", "amount", "depth", F.col("pborn").alias("born"), F.col("prid").alias("rid"), "path_id",
                                             (F.col("back") + span).alias("back"))
        known = cut(known.unionByName(older))
        far = jump.select("ms_id", F.col("born").alias("pborn"), F.col("rid").alias("prid"), F.col("pborn").alias("_b"), F.col("prid").alias("_r"))
        jump = cut(jump.join(far, ["ms_id", "pborn", "prid"]).select(*key, F.col("_b").alias("pborn"), F.col("_r").alias("prid")))
        span *= 2
    return known


def _ledger(df: DataFrame, stuck, lost) -> DataFrame:
    zero = F.lit(0).cast("long")
    return df.select("ms_id", F.lit(-1).cast("long").alias("path_id"), stuck.cast("int").alias("step"), zero.alias("up"),
                     zero.alias("dn"), F.lit(LEDGER).alias("kind"), F.lit(-1).cast("long").alias("edge_id"),
                     lost.alias("i_gamma"), F.lit(0.0).alias("seg_len"), F.lit(0.0).alias("dphi"))


def _collect_rounds(dag: DataFrame, found: list[DataFrame], ledgers: list[DataFrame]) -> DataFrame:
    base = dag.select("ms_id").distinct()
    lost = base.withColumn("lost", F.lit(None).cast("double"))
    for piece in ledgers:
        lost = lost.unionByName(piece)
    lost = lost.groupBy("ms_id").agg(F.count("lost").alias("n"), F.coalesce(F.sum("lost"), F.lit(0.0)).alias("lost"))
    out = _ledger(lost, F.col("n"), F.col("lost"))
    for piece in found:
        out = out.unionByName(piece.select(*STEP_COLUMNS))
    return out


def decompose(dag: DataFrame, method: str = "greedy_fast", kernel_rows: int | None = None) -> DataFrame:
    """Path steps of every sample (K4, K5, K6), plus one ledger row per sample.

    ``kernel_rows`` is where the greedy methods leave grouped calls.  Without it all samples
    are decomposed; a caller who gives one to ``flow_decomposition`` gets no paths of larger
    samples but a ledger row that says so.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {sorted(METHODS)}, got {method!r}")
    dag = cut(dag.select(*DAG_COLUMNS))
    ms_type = dag.schema["ms_id"].dataType.simpleString()
    schema = (f"ms_id {ms_type}, path_id long, step int, up long, dn long, kind int, edge_id long, "
              "i_gamma double, seg_len double, dphi double")
    if method == "topological":
        return cut(_topological_rounds(dag).select(*STEP_COLUMNS))
    small, large = split_by_size(dag, kernel_rows)
    parts = []
    if small is not None:
        parts.append(small.groupBy("pack").applyInPandas(_pack_decomposer(method), schema))
    if large is not None and method == "flow_decomposition" and kernel_rows is None:
        parts.append(_inlet_stored(large))
    elif large is not None and method == "flow_decomposition":
        parts.append(_ledger(large.select("ms_id").distinct(), F.lit(UNDECOMPOSED), F.lit(None).cast("double")))
    elif large is not None:
        parts.append(_greedy_rounds(large))
    if not parts:
        return dag.sparkSession.createDataFrame([], schema)
    return cut(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1].select(*parts[0].columns)))


def ledger(steps: DataFrame) -> DataFrame:
    """Stuck traces and undelivered current per sample."""
    return steps.filter(F.col("kind") == LEDGER).select(
        "ms_id", F.col("step").alias("n_stuck"), F.col("i_gamma").alias("current_dropped"), F.col("dphi").alias("current_unmatched"))


def stuck_volume(steps: DataFrame, iota: DataFrame) -> DataFrame:
    """Throat volume behind drained current, per sample."""
    gone = steps.filter(F.col("kind") == DRAINED).select("ms_id", "edge_id", "i_gamma")
    size = iota.select("ms_id", F.col("throat_id").cast("long").alias("edge_id"), F.abs("current").alias("size"), "v_total", "i_threshold")
    v = F.when(F.col("size") > F.col("i_threshold"), F.col("i_gamma") / F.nullif("size", F.lit(0.0)) * F.col("v_total")).otherwise(0.0)
    return gone.join(size, ["ms_id", "edge_id"]).groupBy("ms_id").agg(F.sum(v).alias("v_stuck_total"))


_PATH_ARCS = ["ms_id", "up", "dn", "flow", "dphi", "kind", "edge_id", "seg_len"]
_PATH_ITEM = ["up", "dn", "edge_id", "seg_len", "dphi"]
PATH_CELLS = 1 << 20    # steps of the paths that a task extends at one time
TASK_STEPS = 1 << 24    # steps that a task makes or holds before the rounds take over


def _path_walker(task_steps: int, carry: list[str]):
    """Paths of whole samples, all paths of one length extended together.

    A chunk of paths holds ``PATH_CELLS`` steps at most; chunks wait on a stack, so longer
    paths come first and memory stays bounded.  Paths that are left when a task has made
    ``task_steps`` steps, or holds as many, are returned as they are, not ``done``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows).combine_chunks()
        up, dn, kind = (t[c].to_numpy() for c in ("up", "dn", "kind"))
        sample = t["ms_id"].combine_chunks().dictionary_encode().indices.to_numpy().astype("int64")
        names, node = np.unique(np.concatenate([up, dn]), return_inverse=True)
        known, node = np.unique(np.tile(sample, 2) * len(names) + node, return_inverse=True)
        tail, head = node[:len(up)], node[len(up):]
        inlet, outlet = np.zeros(len(known), bool), np.zeros(len(known), bool)
        inlet[head[kind == 1]], outlet[tail[kind == 2]] = True, True
        arcs = np.flatnonzero(kind == 0)
        arcs = arcs[np.argsort(tail[arcs], kind="stable")]
        t, tail, head = t.take(pa.array(arcs)).combine_chunks(), tail[arcs], head[arcs]
        flow, degree = t["flow"].to_numpy(), np.bincount(tail, minlength=len(known))
        start = np.cumsum(degree) - degree
        share = flow / np.bincount(tail, flow, len(known))[tail]
        task, made, held, serial = TaskContext.get().partitionId() << 36, 0, 0, 0
        stack: list[tuple[np.ndarray, np.ndarray]] = []

        def push(paths: np.ndarray, current: np.ndarray) -> None:
            nonlocal held
            at = max(1, PATH_CELLS // paths.shape[1])
            stack.extend((paths[k:k + at], current[k:k + at]) for k in range(0, len(paths), at))
            held += paths.size

        def steps(paths: np.ndarray, current: np.ndarray, done: bool) -> pa.RecordBatch:
            nonlocal serial
            n, length = paths.shape
            item = t.select(["ms_id", *carry]).take(pa.array(paths.ravel())).combine_chunks()
            ids = (task + serial + np.arange(n)) << 1
            serial += n
            columns = {"path_id": np.repeat(ids, length), "step": np.tile(np.arange(length, dtype="int32"), n),
                       "i_gamma": np.repeat(current, length), "done": np.full(n * length, done)}
            return pa.RecordBatch.from_arrays([*[c.combine_chunks() for c in item.columns], *map(pa.array, columns.values())],
                                              names=["ms_id", *carry, *columns])

        first = np.flatnonzero(inlet[tail])
        push(first[:, None], flow[first])
        while stack:
            paths, current = stack.pop()
            held -= paths.size
            if made > task_steps or held > task_steps:
                yield steps(paths, current, False)
                continue
            at = head[paths[:, -1]]
            ended = outlet[at]
            if ended.any():
                made += int(ended.sum()) * paths.shape[1]
                yield steps(paths[ended], current[ended], True)
            n = degree[at]
            # rows are extended in runs that stay near PATH_CELLS, whatever the nodes' degrees
            run_of = np.cumsum(n) * (paths.shape[1] + 1) // PATH_CELLS
            for part in np.split(np.arange(len(n)), np.flatnonzero(np.diff(run_of)) + 1):
                times = n[part]
                row = np.repeat(part, times)
                if len(row):
                    arc = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + start[at[row]]
                    made += len(row)
                    push(np.column_stack([paths[row], arc]), current[row] * share[arc])

    return run


def _path_rounds(dag: DataFrame, carry: list[str], begun: DataFrame | None = None) -> DataFrame:
    """The same by rounds of joins, from the inlets or from paths that are ``begun``."""
    arcs = cut(dag.filter("kind = 0"))
    total = arcs.groupBy("ms_id", "up").agg(F.sum("flow").alias("out_flow"))
    arcs = cut(arcs.join(total, ["ms_id", "up"]).withColumn("share", F.col("flow") / F.col("out_flow")))
    item = F.struct(*carry)
    outlets = cut(dag.filter("kind = 2").select("ms_id", F.col("up").alias("dn")))
    if begun is None:
        inlets = dag.filter("kind = 1").select("ms_id", F.col("dn").alias("up"))
        begun = arcs.join(inlets, ["ms_id", "up"], "left_semi").select(
            "ms_id", "dn", F.col("flow").alias("i_gamma"), F.array(item).alias("path"))
    at = cut(begun)
    found = []
    while not at.isEmpty():
        found.append(at.join(outlets, ["ms_id", "dn"], "left_semi").select("ms_id", "i_gamma", "path"))
        go = at.select("ms_id", F.col("dn").alias("up"), "i_gamma", "path").join(arcs, ["ms_id", "up"])
        at = cut(go.select("ms_id", "dn", (F.col("i_gamma") * F.col("share")).alias("i_gamma"),
                           F.concat("path", F.array(item)).alias("path")))
    if not found:
        found = [at.select("ms_id", "i_gamma", "path")]
    done = found[0]
    for piece in found[1:]:
        done = done.unionByName(piece)
    # odd, so that they cannot meet those of the walkers
    done = cut(done.withColumn("path_id", F.shiftleft(F.monotonically_increasing_id(), 1) + 1))
    return done.select("ms_id", "path_id", "i_gamma", F.posexplode("path").alias("step", "p")).select(
        "ms_id", "path_id", "step", *[f"p.{c}" for c in carry], "i_gamma")


def all_simple_paths(dag: DataFrame, tot: DataFrame, kernel_rows: int | None = None, task_steps: int | None = None,
                     terms: DataFrame | None = None) -> DataFrame:
    """Every inlet -> outlet path with full-mixing weights (K7), as path steps.

    The number of rows is the number of paths, which the definition makes exponential.
    Samples within the measured bound are walked whole, in bounded packs; what a walker
    leaves and larger samples go on as rounds of joins.  ``terms``, such as
    ``throat_terms``, holds one row per edge, whose columns the steps then carry: edges
    are joined here, not their many steps later.
    """
    dag, more = dag.select(*_PATH_ARCS).dropna(subset=["ms_id", "up", "dn"]), []
    if terms is not None:
        more = [c for c in terms.columns if c not in ("ms_id", "edge_id")]
        dag = dag.join(even(terms), ["ms_id", "edge_id"], "left")
    dag, carry = cut(dag), [*_PATH_ITEM, *more]
    small, large = split_by_size(dag, kernel_rows)
    parts = []
    if small is not None:
        schema = StructType([dag.schema[c] for c in ("ms_id", *carry)]).add("path_id", "long").add("step", "integer").add(
            "i_gamma", "double").add("done", "boolean")
        walked = cut(small.mapInArrow(_path_walker(TASK_STEPS if task_steps is None else task_steps, carry), schema))
        parts.append(walked.filter("done").drop("done"))
        left = walked.filter("not done")
        if not left.isEmpty():
            begun = left.groupBy("ms_id", "path_id").agg(
                F.max_by("dn", "step").alias("dn"), F.max("i_gamma").alias("i_gamma"),
                F.array_sort(F.collect_list(F.struct("step", F.struct(*carry).alias("p")))).alias("path"))
            parts.append(_path_rounds(dag.join(left.select("ms_id").distinct(), "ms_id", "left_semi"), carry,
                                      begun.select("ms_id", "dn", "i_gamma", F.col("path.p").alias("path"))))
    if large is not None or not parts:
        parts.append(_path_rounds(dag if large is None else large, carry))
    out = parts[0]
    for piece in parts[1:]:
        out = out.unionByName(piece)
    return out.withColumn("kind", F.lit(0)).select(*STEP_COLUMNS, *more)


# --- path attributes -----------------------------------------------------------------

def node_volume_shares(steps: DataFrame, node_volume: float) -> DataFrame:
    """Split each visited node's volume over its tubes by current.

    A flow path never repeats a node, so every step head counts once.
    """
    visits = steps.filter("kind in (0, 1)").select("ms_id", "path_id", "step", F.col("dn").alias("node"), "i_gamma")
    through = visits.groupBy("ms_id", "node").agg(F.sum("i_gamma").alias("i_node"))
    return visits.join(through, ["ms_id", "node"]).withColumn(
        "share", F.col("i_gamma") / F.col("i_node") * F.lit(float(node_volume)))


def voxel_tubes(steps: DataFrame, transport: DataFrame, cfg: VoxelConfig) -> DataFrame:
    """One row per streamtube: current, length, volume, tortuosity, constriction."""
    seg = F.col("seg_len")
    geo = steps.filter(F.col("path_id") >= 0).groupBy("ms_id", "path_id").agg(
        F.max("i_gamma").alias("i_gamma"), F.sum(seg).alias("l_gamma_raw"),
        F.sum(seg * seg / F.greatest("dphi", F.lit(1e-300))).alias("sum_l2_over_dphi"), F.count(F.lit(1)).alias("n_segments"))
    vol = node_volume_shares(steps, cfg.dx ** 3).groupBy("ms_id", "path_id").agg(F.sum("share").alias("v_gamma"))
    drop = abs(cfg.inlet_value - cfg.outlet_value)
    return (geo.join(vol, ["ms_id", "path_id"]).join(transport.select("ms_id", "l_sample"), "ms_id")
            .withColumn("delta_phi", F.lit(drop))
            .withColumn("tau_sq", F.pow(F.col("l_sample") / F.col("l_gamma_raw"), F.lit(2.0)))
            .withColumn("c_gamma", drop * F.col("sum_l2_over_dphi") / (F.col("l_gamma_raw") * F.col("l_gamma_raw"))))


def voxel_summary(tubes: DataFrame, transport: DataFrame, cfg: VoxelConfig) -> DataFrame:
    """Sample-scale averages over the tubes."""
    agg = tubes.groupBy("ms_id").agg(
        F.count(F.lit(1)).alias("n_paths"), F.sum("v_gamma").alias("omega_c"), F.sum("i_gamma").alias("i_decomp"),
        F.sum(F.col("v_gamma") * F.col("tau_sq")).alias("_vt"), F.sum(F.col("i_gamma") * F.col("c_gamma")).alias("_ic"))
    t = transport.select("ms_id", (F.col("n_nodes") * cfg.dx ** 3).alias("omega"), "v_domain", "i_total", "one_over_f", "f", "g_eff", "l_sample")
    out = agg.join(t, "ms_id")
    return (out.withColumn("phi", F.col("omega") / F.col("v_domain")).withColumn("phi_c", F.col("omega_c") / F.col("v_domain"))
            .withColumn("current_loss_rel", F.abs(F.col("i_decomp") - F.col("i_total")) / F.greatest(F.abs("i_total"), F.lit(1e-300)))
            .withColumn("tau_sq_c", F.col("_vt") / F.col("omega_c"))
            .withColumn("user_tortuosity", F.sqrt(1.0 / F.col("tau_sq_c")))
            .withColumn("c_c", F.col("_ic") / F.col("i_decomp")).withColumn("one_over_c_c", 1.0 / F.col("c_c"))
            .withColumn("tortuosity_from_phi_c", F.sqrt(F.col("phi_c") * F.col("one_over_c_c") / F.col("one_over_f")))
            .withColumn("tortuosity_from_phi", F.sqrt(F.col("phi") * F.col("one_over_c_c") / F.col("one_over_f")))
            .drop("_vt", "_ic"))


def throat_terms(iota: DataFrame) -> DataFrame:
    """What a throat adds to a path through it, by ``edge_id``: ``size`` is null below the threshold, ``mix`` where the factors do not count."""
    def shape(drop, length):
        ln = F.greatest(F.col(length), F.lit(1e-8))
        return F.when(F.abs(drop) > 1e-30, ln * ln / F.nullif(F.abs(drop), F.lit(0.0))).otherwise(0.0)
    counted = F.col("phi_1t").isNotNull() & (F.col("v_total") >= 1e-30)
    mix = (F.col("v_body1") * F.col("iota1") + F.col("throat_volume") * F.col("iota_t") + F.col("v_body2") * F.col("iota2"))
    c_terms = (shape(F.col("phi_i") - F.col("phi_1t"), "l_body1") + shape(F.col("phi_1t") - F.col("phi_2t"), "l_throat")
               + shape(F.col("phi_2t") - F.col("phi_j"), "l_body2"))
    size = F.abs("current")
    return iota.select(
        "ms_id", F.col("throat_id").cast("long").alias("edge_id"), F.when(size > F.col("i_threshold"), size).alias("size"), "v_total",
        F.when(counted, mix).alias("mix"), F.when(counted, c_terms).otherwise(0.0).alias("c_terms"), "delta_s", "total_current")


def network_tubes(steps: DataFrame, iota: DataFrame) -> DataFrame:
    """Throat paths with volume shares, length, iota^2, tortuosity and constriction."""
    s = steps.filter("kind = 0")
    if "c_terms" not in steps.columns:  # else the steps carry their throats' terms
        s = s.select("ms_id", "path_id", "edge_id", "i_gamma", "seg_len").join(throat_terms(iota), ["ms_id", "edge_id"])
    share = F.coalesce(F.col("i_gamma") / F.col("size") * F.col("v_total"), F.lit(0.0))
    local = F.coalesce(F.try_divide(F.col("share") * F.col("mix"), F.col("v_total")), F.lit(0.0))
    return (s.withColumn("share", share).groupBy("ms_id", "path_id").agg(
        F.max("i_gamma").alias("i_gamma"), F.count(F.lit(1)).alias("n_path_throats"), F.sum("share").alias("v_gamma"),
        F.sum("seg_len").alias("l_gamma"), F.sum(local).alias("_iota"), F.sum("c_terms").alias("_c"),
        F.max("delta_s").alias("delta_s"), F.max("total_current").alias("total_current"))
        .withColumn("f_gamma", F.when(F.col("total_current") > 1e-30, F.col("i_gamma") / F.nullif("total_current", F.lit(0.0))).otherwise(0.0))
        .withColumn("iota_sq_gamma", F.when(F.col("v_gamma") > 1e-30, F.col("_iota") / F.nullif("v_gamma", F.lit(0.0))).otherwise(0.0))
        .withColumn("tau_gamma", F.when(F.col("l_gamma") > 1e-30, F.col("delta_s") / F.nullif("l_gamma", F.lit(0.0))).otherwise(0.0))
        .withColumn("c_num", F.col("_c")).drop("_iota", "_c"))


def network_summary(tubes: DataFrame, iota: DataFrame, delta_v: float) -> DataFrame:
    """iota^2_c, tau^2_c, C_c and their consistency per sample."""
    cond = iota.filter((F.abs("current") >= F.col("i_threshold")) & F.col("i").isNotNull()).groupBy("ms_id").agg(
        F.sum("v_total").alias("omega_c"), F.max("total_current").alias("total_current"))
    c_gamma = F.when(F.col("l_gamma") > 1e-30, delta_v * F.col("c_num") / F.nullif(F.col("l_gamma") * F.col("l_gamma"), F.lit(0.0))).otherwise(0.0)
    agg = tubes.withColumn("c_gamma", c_gamma).groupBy("ms_id").agg(
        F.count(F.lit(1)).alias("n_streamtubes"), F.sum("i_gamma").alias("i_decomp"), F.sum("v_gamma").alias("v_tubes"),
        F.sum(F.col("v_gamma") * F.col("iota_sq_gamma")).alias("_i"),
        F.sum(F.col("v_gamma") * F.col("tau_gamma") * F.col("tau_gamma")).alias("_t"),
        F.sum(F.col("i_gamma") * F.col("c_gamma")).alias("_c"))

    def ratio(num, den):
        return F.when(F.col(den) > 1e-30, F.col(num) / F.nullif(den, F.lit(0.0))).otherwise(0.0)
    return (agg.join(cond, "ms_id").withColumn("iota_sq_c", ratio("_i", "omega_c")).withColumn("tau_sq_c", ratio("_t", "omega_c"))
            .withColumn("c_c", ratio("_c", "total_current"))
            .withColumn("consistency", F.when(F.col("c_c") > 1e-30, F.col("tau_sq_c") / F.nullif("c_c", F.lit(0.0))))
            .drop("_i", "_t", "_c", "total_current"))

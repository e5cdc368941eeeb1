"""Hierarchical multi-length packing of documents into training sequences.

Context tiers are powers of two.  The part of a document beyond whole windows
of the longest tier is routed to the shortest tier that holds it; it opens a
window there, and the rest of that window is filled from shorter documents,
largest first, the last one cut where the window ends.  A window is emitted only
when it is full, so its length is its tier's and nothing is padded.  What is
left at the end of a task fills windows of ever smaller powers of two.

Steps hold windows of one length, as many tokens in every tier.  Windows are numbered
across tasks by the counts of each task, a table of one row per task and length, so
that all but the last step of a length are full.

A task packs the documents it reads, pool by pool, so no text is shuffled, no
group gathers rows of one source, and memory is bounded by the pool plus the
largest document.  A lost task is repeated from its input split alone.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from porespark.llm.vocab import JsonIds, as_bytes, kept
from porespark.plans.lineage import cut

TIERS = (256, 512, 1024, 2048)
POOL_TOKENS = 1 << 20   # tokens that wait for a place at one time
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "tier int, task int, nth long")
_ID_BYTES = 4
STEP_WINDOWS = 16       # windows of the longest tier in a step; shorter ones as many more


@dataclass(order=True)
class Part:
    """Consecutive ids of one document that still need a place."""
    length: int
    order: int
    doc_id: int | None
    start: int
    doc_tokens: int
    ids: bytes

    def split(self, n: int, order: int) -> tuple[Part, Part]:
        return (Part(n, self.order, self.doc_id, self.start, self.doc_tokens, self.ids[:n * _ID_BYTES]),
                Part(self.length - n, order, self.doc_id, self.start + n, self.doc_tokens, self.ids[n * _ID_BYTES:]))


class Packer:
    """Packs the documents of one task; ``rows`` gathers finished pieces."""

    def __init__(self, task: int, tiers: tuple[int, ...]):
        self.tiers, self.task, self.base = sorted(tiers), task, task << 36
        self.pool: list[Part] = []
        self.waiting = self.serial = self.sequences = 0
        self.of_tier: dict[int, int] = {}
        self.rows: list[tuple] = []

    def _emit(self, window: list[Part]) -> None:
        """Writes one full window."""
        tier = sum(p.length for p in window)
        nth = self.of_tier.get(tier, 0)
        self.of_tier[tier] = nth + 1
        offset = 0
        for p in window:
            self.rows.append((p.doc_id, p.start, p.length, zlib.crc32(p.ids), p.doc_tokens, self.base | self.sequences,
                              offset, tier, self.task, nth))
            offset += p.length
        self.sequences += 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n, top = len(ids) // _ID_BYTES, self.tiers[-1]
        part = Part(n, self.serial, doc_id, 0, n, ids)
        while part.length >= top:
            self.serial += 1
            window, part = part.split(top, self.serial)
            self._emit([window])
        if part.length:
            self.serial += 1
            self.pool.append(part)
            self.waiting += part.length
        if self.waiting >= POOL_TOKENS:
            self.pack()

    def pack(self) -> None:
        """Fills windows, longest tier first; parts of an unfilled window wait on."""
        parts = sorted(self.pool)
        self.pool, self.waiting = [], 0
        while parts:
            window = [parts.pop()]
            tier = next(t for t in self.tiers if t >= window[0].length)
            gap = tier - window[0].length
            while gap and parts:
                k = bisect_right(parts, gap, key=lambda p: p.length) - 1
                if k >= 0:
                    window.append(parts.pop(k))
                else:
                    self.serial += 1
                    head, tail = parts.pop(0).split(gap, self.serial)
                    window.append(head)
                    insort(parts, tail)
                gap -= window[-1].length
            if gap:
                self.pool = window
                self.waiting = sum(p.length for p in window)
            else:
                self._emit(window)

    def finish(self) -> None:
        """Cuts what is left into windows of falling powers of two."""
        self.pack()
        parts, self.pool = self.pool[::-1], []
        left, self.waiting = self.waiting, 0
        while left:
            size = min(1 << (left.bit_length() - 1), self.tiers[-1])
            window, gap = [], size
            while gap:
                part = parts.pop()
                if part.length > gap:
                    self.serial += 1
                    part, tail = part.split(gap, self.serial)
                    parts.append(tail)
                window.append(part)
                gap -= part.length
            self._emit(window)
            left -= size

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        types = [pa.int32() if c.endswith(" int") else pa.int64() for c in SCHEMA.split(", ")]
        columns = list(zip(*rows)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=names)


def with_steps(pieces: DataFrame, longest: int) -> DataFrame:
    """Adds ``step_id`` in place of ``task`` and ``nth``, the window's number among those of its length in its task."""
    counts = pieces.groupBy("task", "tier").agg((F.max("nth") + 1).alias("_n"))
    earlier = Window.partitionBy("tier").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # of one row per task
    before = counts.select("task", "tier", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    per_step = F.lit(STEP_WINDOWS) * F.greatest(F.lit(1), F.floor(F.lit(longest) / F.col("tier")))
    step = F.floor((F.col("_before") + F.col("nth")) / per_step).cast("long")
    # bit_count(tier - 1) is the power of two that the length is
    return (pieces.join(before, ["task", "tier"])
            .withColumn("step_id", F.shiftleft(step, 5).bitwiseOR(F.bit_count(F.col("tier") - 1).cast("long")))
            .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_id"))


def pack(df: DataFrame, path: str, end_id: int, tiers: tuple[int, ...] = TIERS, text_col: str = "text",
         id_col: str = "doc_id") -> DataFrame:
    """One row per piece of a document, in sequences of the lengths ``tiers``.

    A document is its ids by the tokenizer file ``path`` without added special
    tokens, then ``end_id``; a null or empty text is ``end_id`` alone.  Each id
    lies in exactly one piece.  ``start`` counts the document's ids before the
    piece, ``offset`` the sequence's; ``tier`` is the sequence's length, and
    sequences of one ``step_id`` are of one length and hold 16 windows' worth of the
    longest tier (the last step of a length may hold less).  Repeated rows are packed as
    often as they occur, null ids are kept, other columns are ignored.  The rows
    depend on how the input is split into partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = kept(JsonIds, path), as_bytes([end_id])
        packer = Packer(TaskContext.get().partitionId(), tiers)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                packer.add(doc_id.as_py(), own.ids(text.as_py()) + end)
            yield packer.taken()
        packer.finish()
        yield packer.taken()

    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return with_steps(cut(slim.mapInArrow(run, SCHEMA)), max(tiers))

"""Aligning the tokens of two tokenizers over the same bytes.

Both tokenizers see a blank and the text.  Each gives a list of byte offsets where
its tokens end; offsets that are in both lists cut the two token lists into groups.
The lists are intersected by galloping: every end of a document's shorter list is
sought in the longer one from the place its rank suggests, by steps that double until
they pass it and then by halving.  All ends of a batch of documents take these steps
together in numpy.  The rank of an end in the other list also gives the range of
tokens that a token overlaps, so links need no second search.

A pair of ids counts the documents that hold it linked.  Documents are taken in
chunks of bounded size; a chunk numbers its own distinct pairs, and only these are
shuffled: once to be summed over the corpus and once to bring the sums back to the
chunk.  The links of a document stay in its chunk's row as numbers of these pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from porespark.llm.vocab import JsonIds, PieceIds, byte_table, is_spaced, kept
from porespark.plans.lineage import cut

CHUNK_CHARS = 2 << 20      # characters of the documents of one chunk, unless one document alone has more
MEMORY_BYTES = 48 << 20    # of a worker's remembered units; there are two generations
PIECE_BYTES = 16 << 20     # of the pieces of such units
UNIT_BYTES = 170           # what a unit takes beside its own bytes and its ids
_INNER, _TURN, _LAST = 0, 1, 2
_MARKS = b",|;"
_CHUNKS = ("chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
           "groups_sha256 array<string>, n_pairs array<int>, pair binary, times binary, a array<int>, b array<int>, docs array<int>")


def gallop(wanted: np.ndarray, guess: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each value the first place of the ascending ``ends`` in [low, high) that is not below it, else ``high``.

    Starts at ``guess``, doubles the step in the direction of the value until it is
    bracketed, then halves the bracket.
    """
    left, right = low.copy(), high.copy()     # the answer lies in [left, right]
    below = ends[guess] < wanted
    left[below] = guess[below] + 1
    right[~below] = guess[~below]
    step, open_ = 1, np.arange(len(wanted))
    while len(open_):
        up = below[open_]
        at = np.where(up, guess[open_] + step, guess[open_] - step)
        inside = np.where(up, at < right[open_], at >= left[open_])
        open_, at, up = open_[inside], at[inside], up[inside]
        less = ends[at] < wanted[open_]
        left[open_[less]] = at[less] + 1
        right[open_[~less]] = at[~less]
        open_ = open_[less == up]             # a value that was passed is bracketed
        step *= 2
    open_ = np.flatnonzero(left < right)
    while len(open_):
        middle = (left[open_] + right[open_]) >> 1
        less = ends[middle] < wanted[open_]
        left[open_[less]] = middle[less] + 1
        right[open_[~less]] = middle[~less]
        open_ = open_[left[open_] < right[open_]]
    return left


def _places(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each item of consecutive runs of lengths ``n``: its run, its place in it; and the runs' starts."""
    starts = np.cumsum(n) - n
    run = np.repeat(np.arange(len(n)), n)
    return run, np.arange(len(run)) - starts[run], starts


def intersect(ends_a: np.ndarray, n_a: np.ndarray, ends_b: np.ndarray, n_b: np.ndarray):
    """Common ends and overlaps of the end lists of consecutive documents, ``n_a`` and ``n_b`` long.

    Ends ascend over all documents, and those of a document's lists end alike.
    Returns the places of common ends in both lists, then the places in both lists of
    each overlapping pair of tokens.
    """
    common, links = [], []
    for swap in (False, True):                # documents where A's list is the shorter drive from A, others from B
        chosen = (n_b < n_a) if swap else (n_a <= n_b)
        short, n_short, long, n_long = (ends_b, n_b, ends_a, n_a) if swap else (ends_a, n_a, ends_b, n_b)
        doc, place, _ = _places(n_short)
        driver = np.flatnonzero(chosen[doc])
        if not len(driver):
            continue
        doc, place = doc[driver], place[driver]
        low = (np.cumsum(n_long) - n_long)[doc]
        guess = low + place * n_long[doc] // n_short[doc]
        rank = gallop(short[driver], guess, long, low, low + n_long[doc])
        same = long[rank] == short[driver]    # the last ends are alike, so a rank is always a place
        first = np.where(place == 0, low, np.roll(rank + same, 1))
        size = rank - first + 1
        owner, nth, _ = _places(size)
        pair = (driver[owner], first[owner] + nth)
        both = (driver[same], rank[same])
        links.append(pair[::-1] if swap else pair)
        common.append(both[::-1] if swap else both)
    empty = np.zeros(0, "int64")
    return tuple(np.concatenate([x[i] for x in found]) if found else empty for found in (common, links) for i in (0, 1))


def _digits(n_ids: int) -> np.ndarray:
    """Decimal digits of each id with each mark after them, in rows padded with zeros."""
    width = len(str(n_ids)) + 1
    text = b"".join((str(i).encode() + _MARKS[m:m + 1]).ljust(width, b"\0") for i in range(n_ids) for m in range(3))
    return np.frombuffer(text, "u1").reshape(-1, width)


class Aligner:
    """Encodes and aligns documents; one per worker process.

    A text is cut at its blanks where both tokenizers may be, and what the two give for a
    unit is remembered together: its numbers of tokens and their ids.  The memory is
    bounded by bytes; units that no chunk has met for a generation are forgotten.
    """

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = JsonIds(path_a, plain=True), PieceIds(path_b)
        self.a.unit.limit = PIECE_BYTES
        self.len_a = np.array([len(x) for x in byte_table(path_a)])
        self.len_b = np.array([len(x) for x in self.b.table])
        self.base = max(len(self.len_a), len(self.len_b))
        self.digits = _digits(self.base)
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def _value(self, ids_a: bytes, ids_b: bytes) -> bytes:
        return pack("<ii", len(ids_a) // 4, len(ids_b) // 4) + ids_a + ids_b

    def _learn(self, units: set[str]) -> None:
        fresh = []
        for u in units.difference(self.memory):
            value = self.older.get(u)
            if value is None:
                fresh.append(u)
            else:
                self.memory[u] = value
                self.held += 2 * len(u) + len(value) + UNIT_BYTES
        for u, ids_b in zip(fresh, self.b.after_blanks(fresh)):
            self.memory[u] = value = self._value(self.a.unit_after_blank(u), ids_b)
            self.held += 2 * len(u) + len(value) + UNIT_BYTES

    def encode(self, texts: list[str]):
        """Ids of all texts by both tokenizers, and their numbers by text; none for a text that its tokens do not spell."""
        cuts = self.a.kind == "byte" and self.b.cuts
        parts = [t.split(" ") if t and cuts and is_spaced(t) else None for t in texts]
        self._learn(set().union(*filter(None, parts)))
        values, n_units = [], []
        for text, units in zip(texts, parts):
            if units is not None:
                values += map(self.memory.__getitem__, units)
            elif text:
                values.append(self._value(self.a.ids_after_blank(text), self.b.ids_after_blank(text)))
            n_units.append(len(units) if units is not None else int(bool(text)))
        if self.held > MEMORY_BYTES:
            self.memory, self.older, self.held = {}, self.memory, 0
        sizes = np.fromiter(map(len, values), "int64", len(values)) // 4
        stream = np.frombuffer(b"".join(values), "<i4")
        heads = np.cumsum(sizes) - sizes
        counts = (stream[heads], stream[heads + 1]) if len(heads) else (heads, heads)
        text_of = np.repeat(np.arange(len(texts)), n_units)
        starts = (heads + 2, heads + 2 + counts[0])
        ids, n = [], []
        for count, start in zip(counts, starts):
            owner, place, _ = _places(count)
            ids.append(stream[start[owner] + place].astype("int64"))
            n.append(np.bincount(text_of, count, len(texts)).astype("int64"))
        lost = np.unique(np.repeat(np.arange(len(texts)), n[1])[ids[1] < 0])
        if len(lost):
            for k in (0, 1):
                ids[k] = ids[k][~np.isin(np.repeat(np.arange(len(texts)), n[k]), lost)]
                n[k][lost] = 0
        return *ids, *n

    def _hashes(self, ids_a, ids_b, n_a, n_b, common_a, common_b) -> list[str]:
        """The digest of each document's groups, written as ``a1,a2|b1;a3|b2``."""
        order = np.argsort(common_a)          # of documents driven from either side
        common_a, common_b = common_a[order], common_b[order]
        mark_a, mark_b = np.full(len(ids_a), _INNER), np.full(len(ids_b), _INNER)
        mark_a[common_a], mark_b[common_b] = _TURN, _LAST
        size_a, size_b = np.diff(common_a, prepend=-1), np.diff(common_b, prepend=-1)
        _, nth_a, _ = _places(size_a)
        _, nth_b, _ = _places(size_b)
        before = np.cumsum(size_a + size_b) - size_a - size_b
        codes = np.empty(len(ids_a) + len(ids_b), "int64")
        codes[np.repeat(before, size_a) + nth_a] = ids_a * 3 + mark_a
        codes[np.repeat(before + size_a, size_b) + nth_b] = ids_b * 3 + mark_b
        rows = self.digits[codes]
        shown = rows != 0
        ends = np.cumsum(np.concatenate([[0], shown.sum(axis=1)]))
        text, at, found = rows[shown].tobytes(), 0, []
        for n in n_a + n_b:
            # the last mark closes no group
            found.append(hashlib.sha256(text[ends[at]:ends[at + n] - 1]).hexdigest() if n else "")
            at += n
        return found

    def chunk(self, number: int, doc_ids: list, texts: list[str]) -> dict:
        ids_a, ids_b, n_a, n_b = self.encode(texts)
        common_a, common_b, link_a, link_b = intersect(np.cumsum(self.len_a[ids_a]), n_a, np.cumsum(self.len_b[ids_b]), n_b)
        doc = np.repeat(np.arange(len(texts)), n_a)
        n_groups = np.bincount(doc[common_a], minlength=len(texts))
        n_links = np.bincount(doc[link_a], minlength=len(texts))
        key = ids_a[link_a] * self.base + ids_b[link_b]
        pairs = np.unique(key)
        held = np.sort(doc[link_a] * len(pairs) + np.searchsorted(pairs, key))
        new = np.flatnonzero(np.diff(held, prepend=-1))
        times = np.diff(new, append=len(held))
        held = held[new]
        pair, of = held % max(1, len(pairs)), held // max(1, len(pairs))
        return {"chunk": number, "doc_id": doc_ids, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links,
                "groups_sha256": self._hashes(ids_a, ids_b, n_a, n_b, common_a, common_b),
                "n_pairs": np.bincount(of, minlength=len(texts)),
                # the halves of the numbers apart, which packs better
                "pair": (pair & 0xFFFF).astype("<u2").tobytes() + (pair >> 16).astype("<u2").tobytes(),
                "times": times.astype("<u4").view("u1").reshape(-1, 4).T.tobytes(),
                "a": pairs // self.base, "b": pairs % self.base, "docs": np.bincount(pair, minlength=len(pairs))}


def _chunked(path_a: str, path_b: str):
    schema = pa.schema([("chunk", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")),
                        ("groups_sha256", pa.list_(pa.string())), ("n_pairs", pa.list_(pa.int32())), ("pair", pa.binary()),
                        ("times", pa.binary()), *((c, pa.list_(pa.int32())) for c in ("a", "b", "docs"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = kept(Aligner, path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def row() -> pa.RecordBatch:
            found = aligner.chunk(number, ids, texts)
            return pa.RecordBatch.from_arrays([pa.array([found[f.name]], type=f.type) for f in schema], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py() or ""
                if texts and size + len(text) > CHUNK_CHARS:
                    yield row()
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(doc_id.as_py())
                texts.append(text)
                size += len(text)
        if texts:
            yield row()

    return run


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each chunk, with the sums over their links."""
    for batch in batches:
        for row in batch.to_pylist():
            n = np.array(row["n_pairs"], "int64")
            size = int(n.sum())
            halves = np.frombuffer(row["pair"], "<u2").astype("int64").reshape(2, size)
            times = np.frombuffer(row["times"], "u1").reshape(4, size).T.copy().view("<u4").ravel().astype("int64")
            known = row["known"] or []
            count, best = np.array([k["count"] for k in known], "int64"), np.array([k["best"] for k in known], bool)
            pair = halves[0] + (halves[1] << 16)
            of = np.repeat(np.arange(len(n)), n)
            sums = np.zeros((2, len(n)), "int64")
            if size:
                np.add.at(sums[0], of, times * best[pair])
                np.add.at(sums[1], of, times * count[pair])
            arrays = [pa.array(row[c], type=pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
            arrays += [pa.array(sums[0]), pa.array(sums[1]), pa.array(row["groups_sha256"], type=pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                                                            "groups_sha256"])


def align(df: DataFrame, path_a: str, path_b: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document with its groups and links between the tokens of two tokenizers.

    ``path_a`` is a byte-level ``tokenizers`` file, ``path_b`` a sentencepiece file that
    puts a blank before each text; special strings inside texts are ordinary text.
    Returns ``doc_id, n_a, n_b`` (tokens), ``n_groups``, ``n_links`` (overlapping pairs of
    token occurrences), ``n_best`` (links whose pair of ids is in as many documents as any
    pair of its A id), ``count_sum`` (documents that hold the pair, summed over links) and
    ``groups_sha256``.  Null and empty texts, and texts that the tokens do not spell byte
    for byte, have no tokens: zeros and ''.  Rows with equal or null ids are documents of
    their own, equal texts count as often as they occur; an empty table gives no rows and
    other columns are ignored.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chunks = cut(docs.mapInArrow(_chunked(path_a, path_b), _CHUNKS))
    pairs = chunks.select("chunk", F.posexplode(F.arrays_zip("a", "b", "docs")).alias("place", "p"))
    counts = cut(pairs.groupBy("p.a", "p.b").agg(F.sum(F.col("p.docs").cast("long")).alias("count")))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    rated = counts.join(most, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    known = (pairs.select("chunk", "place", "p.a", "p.b").join(rated, ["a", "b"])
             .groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("place", "count", "best"))).alias("known")))
    links = chunks.select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_pairs", "pair", "times")
    return (links.join(known, "chunk", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_pairs",
                                                      "pair", "times", "known")
            .mapInArrow(_scored, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
                                 "groups_sha256 string"))

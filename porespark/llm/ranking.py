"""Ranked lexical search: exact inner products through ball trees of sparse vectors.

A document's vector holds, for each term that any query uses, a whole number that
grows with the term's occurrences and falls with the document's length; a query's
vector holds the terms' weights.  A document's score is their inner product.

Documents are range-partitioned by the term that weighs most in them, so that like
documents share a task.  A task takes them in batches of bounded size and builds a
ball tree of each: every node keeps the centroid of its documents and a radius that
holds them all.  By Cauchy and Schwarz no document of a node scores more than the
centroid does plus the radius times the length of the query, nor more than the corner
of the box around the ball's documents.  Both sides are scaled
first, documents by the root of a term's weight and queries by its inverse: their
product stays and common terms, which weigh little, widen no ball.  The bound is
computed in floating point and widened by more than its rounding can amount to.  A query walks
the tree best bound first and stops when the best bound is below the score of its
k-th document so far; documents in the leaves it reaches are scored in whole numbers.

Queries start from the k-th best score among a bounded number of documents, which no
better answer can be below; it only prunes, and changes no result.  Queries are taken
in blocks with a bounded number of distinct terms, so that what every task gets of
them is bounded however many there are.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from porespark.llm.common import width
from porespark.plans.lineage import cut

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LEAF = 64                  # documents of a leaf
BATCH_ENTRIES = 1 << 21    # vector entries of a tree
PILOT_ROWS = 4_000         # documents about, whose scores start the search
BLOCK_TERMS = 1 << 20      # distinct terms of a block of queries, about
QUERY_ROWS = 10_000        # queries of a block

# Wider than the rounding of the sums below, which have one sign and, row by row, under a million terms.
_SLACK = 1e-9
_AT_LEAST = 1.0

_find = re.compile(TERM).findall
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text: str | None) -> list[str]:
    """Terms of a whole text; only A to Z are lower-cased."""
    if not text:
        return []
    return _find(text.lower() if text.isascii() else text.translate(_LOWER))


def _vectors(vocabulary):
    """Number of terms of each document, and its query terms with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for batch in batches:
            n, term, times = [], [], []
            for text in batch.column(1):
                found = terms(text.as_py())
                of = Counter(filter(number.__contains__, found))
                n.append(len(found))
                term.append([number[t] for t in of])
                times.append(list(of.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(term, pa.list_(pa.int32())),
                                              pa.array(times, pa.list_(pa.int64()))], names=["doc_id", "n", "term", "times"])

    return run


class Vectors:
    """Sparse rows, none of them empty; the entries of a row lie together."""

    def __init__(self, start: np.ndarray, term: np.ndarray, value: np.ndarray):
        self.start, self.term, self.value = start, term, value

    def take(self, rows: np.ndarray) -> Vectors:
        size = self.start[rows + 1] - self.start[rows]
        start = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.start[rows] - start[:-1], size) + np.arange(start[-1])
        return Vectors(start, self.term[at], self.value[at])

    def dot(self, dense: np.ndarray) -> np.ndarray:
        return np.add.reduceat(dense[self.term] * self.value, self.start[:-1])


class Node:
    """A ball: centroid (sparse), radius, its box's upper corner, and two smaller balls or a leaf's rows."""
    __slots__ = ("term", "centre", "radius", "corner", "rows", "own", "sides")


class Tree:
    """A ball tree over non-negative sparse vectors of whole numbers, none of them empty; ``scale`` is positive where they are."""

    def __init__(self, vectors: Vectors, scale: np.ndarray):
        self.dense, self.exact = np.zeros(len(scale)), vectors
        self.all = Vectors(vectors.start, vectors.term, vectors.value * scale[vectors.term])
        self.square = np.add.reduceat(self.all.value ** 2, vectors.start[:-1])
        self.root = self._node(np.arange(len(vectors.start) - 1))

    def _node(self, rows: np.ndarray) -> Node:
        node, own = Node(), self.all.take(rows)
        node.term, of = np.unique(own.term, return_inverse=True)
        node.centre = np.bincount(of, own.value) / len(rows)
        self.dense[node.term] = node.centre
        squares = self.square[rows]
        away = np.maximum(squares - 2 * own.dot(self.dense) + float(node.centre @ node.centre), 0)
        self.dense[node.term] = 0
        # the differences above cancel: widened in proportion to what was subtracted
        node.radius = math.sqrt(float(away.max()) + _SLACK * float(squares.max()))
        node.corner = np.zeros(len(node.term))
        np.maximum.at(node.corner, of, own.value)
        node.rows, node.own, node.sides = None, None, ()
        if len(rows) > LEAF:
            one = int(away.argmax())
            far = squares + squares[one] - 2 * self._with(own, one)
            other = int(far.argmax())
            toward = far - (squares + squares[other] - 2 * self._with(own, other))
            order = np.argsort(toward, kind="stable")
            half = int(np.searchsorted(toward[order], 0, side="right"))
            least = max(1, len(rows) // 8)   # no side of a sliver: depth stays logarithmic
            half = min(max(half, least), len(rows) - least)
            node.sides = (self._node(rows[order[:half]]), self._node(rows[order[half:]]))
        else:
            node.rows, node.own = rows, self.exact.take(rows)
        return node

    def _with(self, own: Vectors, row: int) -> np.ndarray:
        part = slice(own.start[row], own.start[row + 1])
        self.dense[own.term[part]] = own.value[part]
        found = own.dot(self.dense)
        self.dense[own.term[part]] = 0
        return found

    def search(self, dense: np.ndarray, scaled: np.ndarray, length: float, doc_ids: np.ndarray, best: list[tuple], k: int,
               floor: int) -> int:
        """Adds the rows that may be among the ``k`` best to the heap ``best``; returns the leaves read.

        ``dense`` and ``scaled`` hold the query over all terms, ``length`` is that of the
        scaled one.  ``best`` has ``(score, -doc_id)``.
        """

        def bound(node: Node) -> float:
            query = scaled[node.term]
            inner = min(float(query @ node.centre) + length * node.radius, float(query @ node.corner))
            return inner * (1 + _SLACK) + _AT_LEAST

        waiting, serial, read = [(-bound(self.root), 0, self.root)], 0, 0
        while waiting:
            up, _, node = heapq.heappop(waiting)
            if -up < (max(best[0][0], floor) if len(best) == k else floor):
                break                       # every ball that waits has a lower bound still
            for side in node.sides:
                serial += 1
                heapq.heappush(waiting, (-bound(side), serial, side))
            if node.sides:
                continue
            read += 1
            scores = node.own.dot(dense)
            for i in np.flatnonzero(scores >= (max(best[0][0], floor) if len(best) == k else floor)):
                entry = (int(scores[i]), -int(doc_ids[node.rows[i]]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return read


def _searched(block, k: int, floors):
    """The best rows of each query among the documents of a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, queries, n_docs, n_all = block.value
        floor = floors.value if floors is not None else {}
        best: dict[int, list] = {q: [] for q in queries}
        dense, scaled, scale = np.zeros(len(weights), "int64"), np.zeros(len(weights)), np.sqrt(weights)
        waiting, held = [], 0

        def search(rows: pd.DataFrame) -> None:
            size = rows["term"].map(len).to_numpy()
            start = np.concatenate([[0], np.cumsum(size)])
            times = np.concatenate(rows["times"].to_list()).astype("int64")
            m = 25 + (75 * rows["n"].to_numpy("int64") * n_docs) // n_all
            value = (1_000_000_000 * times) // (1000 * times + 8 * np.repeat(m, size))
            tree = Tree(Vectors(start, np.concatenate(rows["term"].to_list()), value), scale)
            ids = rows["doc_id"].to_numpy("int64")
            for q, (term, repeats) in queries.items():
                dense[term], scaled[term] = weights[term] * repeats, scale[term] * repeats
                tree.search(dense, scaled, float(np.linalg.norm(scaled[term])), ids, best[q], k, max(1, floor.get(q, 1)))
                dense[term] = scaled[term] = 0

        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.iloc[at:at + 1024]
                waiting.append(part)
                held += int(part["term"].map(len).sum())
                if held >= BATCH_ENTRIES:
                    search(pd.concat(waiting))
                    waiting, held = [], 0
        if waiting:
            search(pd.concat(waiting))
        found = [(q, -d, s) for q, heap in best.items() for s, d in heap]
        yield pd.DataFrame(found, columns=["query", "doc_id", "score"]).astype("int64")

    return run


_FOUND = "query long, doc_id long, score long"


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def ranked(docs: DataFrame, queries: DataFrame, k: int, text_col: str = "text", id_col: str = "doc_id",
           query_text: str = "text", query_id: str = "item_id") -> DataFrame:
    """The ``k`` best documents of each query: ``item_id, rank, doc_id, score``.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, A to Z
    lower-cased, in whole texts.  With N documents that have a term, L terms in all, a
    document of n terms, a term in df documents and tf times in this one, its weight is
    ``w = floor(1000 ln((2N+2)/(2df+1)))``, ``m = 25 + 75 n N div L``, and a document scores
    the sum of ``w (10^9 tf div (1000 tf + 8 m))`` over the query's terms with repeats.
    Equal scores rank by ascending id; documents that score 0 are not returned, nor are
    those without an id.  Null and empty texts have no terms.  Rows that repeat a
    document are ranked each; rows that repeat a query are answered each.  Other columns
    are ignored.  Blocks of queries run one after another.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    asked = queries.select(F.col(query_id).alias("item_id"), F.col(query_text).alias("text"))
    asked = cut(asked.repartition(width(spark)).withColumn("query", F.monotonically_increasing_id()))
    n_queries = asked.count()
    if not n_queries:
        return spark.createDataFrame([], f"item_id {dict(asked.dtypes)['item_id']}, rank int, doc_id long, score long")
    split = F.udf(terms, "array<string>")
    listed = cut(asked.select("query", F.explode(split("text")).alias("term")).groupBy("query", "term")
                 .agg(F.count(F.lit(1)).alias("repeats")))
    blocks = max(1, math.ceil(max(n_queries / QUERY_ROWS, listed.count() / BLOCK_TERMS)))
    found = None
    for nth in range(blocks):
        own = listed.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == nth)
        answers = _answers(slim, own, k)
        found = answers if found is None else found.unionByName(answers)
    return found.join(asked.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


def _answers(docs: DataFrame, listed: DataFrame, k: int) -> DataFrame:
    """Answers a block of queries, given as ``(query, term, repeats)``."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    rows = listed.collect()                 # bounded by BLOCK_TERMS
    number = {t: i for i, t in enumerate(sorted({r["term"] for r in rows}))}
    vectors = cut(docs.mapInArrow(_vectors(sc.broadcast(number)), "doc_id long, n long, term array<int>, times array<long>")
                  .filter(F.col("n") > 0))
    n_docs, n_all = vectors.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs or not rows:
        return spark.createDataFrame([], _FOUND + ", rank int")
    weights = np.zeros(len(number), "int64")
    for r in vectors.select(F.explode("term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toLocalIterator():
        weights[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
    asked: dict[int, list] = {}
    for r in rows:
        asked.setdefault(r["query"], []).append((number[r["term"]], r["repeats"]))
    asked = {q: tuple(np.array(sorted(x), "int64").T) for q, x in asked.items()}
    block = sc.broadcast((weights, asked, n_docs, n_all))
    used = vectors.filter((F.size("term") > 0) & F.col("doc_id").isNotNull())
    pilot = used.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n_docs // PILOT_ROWS))) == 0)
    tried = pilot.repartition(width(spark)).mapInPandas(_searched(block, k, None), _FOUND)
    floors = {r["query"]: r["score"] for r in _top(tried, k).filter(F.col("rank") == k).collect()}
    near = used.withColumn("_heavy", _heaviest(sc.broadcast(weights))("term"))
    placed = near.repartitionByRange(width(spark), "_heavy", F.xxhash64("doc_id")).sortWithinPartitions("_heavy").drop("_heavy")
    return _top(placed.mapInPandas(_searched(block, k, sc.broadcast(floors)), _FOUND), k)


def _heaviest(weights):
    """The term of the highest weight among a document's."""

    @F.pandas_udf("int")
    def run(found: pd.Series) -> pd.Series:
        return found.map(lambda t: t[weights.value[t].argmax()])

    return run

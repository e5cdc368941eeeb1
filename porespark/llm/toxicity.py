"""Toxicity by the nearest labelled examples under exact TF-IDF cosine over telling words.

A bounded sample of labelled documents is the memory.  Its telling words - those
whose link with the label a likelihood-ratio test confirms - span the vectors;
their document frequencies come from the whole corpus.  A text without any of them gets
the base rate.  Examples lie in a dense matrix of words by examples, cut into
blocks of examples with the largest weight of each word in each block.  A query bounds every block by these
maxima and scores blocks from the best bound down, until no block left can
change its exact nearest neighbours.  Their votes, weighted by cosine, are
calibrated on the examples themselves, each judged by the others.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from porespark.plans.lineage import cut, release

EXAMPLES = 20_000       # bound of the labelled sample
VOCABULARY = 1_000      # bound of the telling words
NEIGHBOURS, BLOCK = 15, 64
_AT_ONCE = 16           # blocks that are scored between two looks at the bounds
_FALSE_SHARE = 0.1      # share of accidental words to expect among the telling ones
_WORDS = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def example_rows(df: DataFrame, labels: DataFrame, examples: int) -> DataFrame:
    """``(doc_id, text, toxic)`` of the labelled documents with the smallest hash."""
    one = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
    return df.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(sample), F.col("_id") == F.col("doc_id")).select("doc_id", "text", "toxic")


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per batch: in how many documents, and toxic documents, each word is."""
    for batch in batches:
        every, bad = Counter(), Counter()
        for text, toxic in zip(batch["text"], batch["toxic"]):
            found = set(words(text))
            every.update(found)
            if toxic:
                bad.update(found)
        if every:
            yield pd.DataFrame({"word": np.array(list(every), object), "n": list(every.values()), "bad": [bad[w] for w in every]}).astype({"word": object})


def _telling(counts: DataFrame, n: int, bad: int, most: int) -> list[str]:
    """Words that go with the label, by likelihood ratio, at a bounded share of accidents; the strongest ``most``.

    The share is held down by comparing the k-th smallest p-value with k times
    the share over the number of words tried (Benjamini and Hochberg).
    """
    share = bad / n if n else 0.0
    if not 0 < share < 1:
        return []
    counts = counts.filter("n > 1")
    tried = max(counts.count(), 1)
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    inside = part(F.col("bad"), F.col("n") * share) + part(F.col("n") - F.col("bad"), F.col("n") * (1 - share))
    rest, rest_bad = F.lit(n) - F.col("n"), F.lit(bad) - F.col("bad")
    outside = part(rest_bad, rest * share) + part(rest - rest_bad, rest * (1 - share))
    # words that speak against the label add nothing to the votes of those that speak for it
    ratio = counts.filter(F.col("bad") > F.col("n") * share).select("word", F.round(2 * (inside + outside), 6).alias("g"))
    first = [(r["word"], r["g"]) for r in ratio.orderBy(F.desc("g"), "word").limit(most).collect()]
    real = [k for k, (_, g) in enumerate(first, 1) if math.erfc(math.sqrt(max(g, 0.0) / 2)) <= _FALSE_SHARE * k / tried]
    return [w for w, _ in first[:max(real, default=0)]]


def _frequencies(known: dict[str, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = Counter()
            for text in batch["text"]:
                seen.update(known.keys() & set(words(text)))
            if seen:
                yield pd.DataFrame({"word": np.array(list(seen), object), "n": list(seen.values())}).astype({"word": object})

    return run


class Index:
    """Examples as unit TF-IDF vectors in a dense matrix with block maxima."""

    def __init__(self, known: dict[str, int], idf: np.ndarray, ids: np.ndarray, toxic: np.ndarray, counts: list[dict[int, int]]):
        self.known, self.idf = known, idf
        vectors = [self._vector(c) for c in counts]
        full = np.array([bool(len(t)) for t, _ in vectors], bool)
        self.base = self._rate(toxic[~full], toxic)
        # examples with the same words lie side by side, which keeps block maxima tight
        order = sorted(np.flatnonzero(full), key=lambda i: (vectors[i][0].tolist(), ids[i]))
        self.ids, self.toxic = ids[order], toxic[order].astype(float)
        n = len(order)
        self.n_blocks = -(-n // BLOCK)
        self.weights = np.zeros((len(known), self.n_blocks * BLOCK), np.float32)
        for at, i in enumerate(order):
            self.weights[vectors[i][0], at] = vectors[i][1]
        self.block_max = self.weights.reshape(len(known), self.n_blocks, BLOCK).max(axis=2) if n else np.zeros((len(known), 0), np.float32)
        raw = np.array([self.vote(vectors[i], without=at)[0] for at, i in enumerate(order)])
        self.steps, self.levels = self._isotonic(raw, self.toxic)

    @staticmethod
    def _rate(part: np.ndarray, every: np.ndarray) -> float:
        prior = every.mean() if len(every) else 0.0
        return float((part.sum() + prior) / (len(part) + 1))

    @staticmethod
    def _isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pool-adjacent-violators: the rising step function that fits the labels best."""
        blocks: list[list[float]] = []
        for x, v in sorted(zip(raw.tolist(), y.tolist())):
            if blocks and blocks[-1][3] == x:
                blocks[-1][1] += v
                blocks[-1][2] += 1
            else:
                blocks.append([x, v, 1.0, x])
            while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
                _, v2, n2, end = blocks.pop()
                blocks[-1][1] += v2
                blocks[-1][2] += n2
                blocks[-1][3] = end
        steps = [b for block in blocks for b in (block[0], block[3])]
        levels = [block[1] / block[2] for block in blocks for _ in (0, 1)]
        return np.array(steps), np.array(levels)

    def _vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        terms = np.array(sorted(counts), int)
        w = (1 + np.log(np.array([counts[t] for t in terms], float))) * self.idf[terms] if len(terms) else np.empty(0)
        return terms, w / np.sqrt((w * w).sum()) if len(terms) else w

    def nearest(self, terms: np.ndarray, w: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the exact nearest examples, equal cosines by position."""
        bounds = w.astype(np.float32) @ self.block_max[terms]
        order = np.argsort(-bounds, kind="stable")
        order, postings = order[bounds[order] > 0], self.weights.reshape(len(self.known), self.n_blocks, BLOCK)
        at, cos = np.empty(0, int), np.empty(0)
        for start in range(0, len(order), _AT_ONCE):
            blocks = order[start:start + _AT_ONCE]
            if len(cos) == NEIGHBOURS and bounds[blocks[0]] < cos[-1] - 1e-6:
                break
            here = np.round(w @ postings[np.ix_(terms, blocks)].reshape(len(terms), -1).astype(float), 9)
            place = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            live = (here > 0) & (place != without)
            at, cos = np.concatenate([at, place[live]]), np.concatenate([cos, here[live]])
            best = np.lexsort((at, -cos))[:NEIGHBOURS]
            at, cos = at[best], cos[best]
        return at, cos

    def vote(self, vector: tuple[np.ndarray, np.ndarray], without: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        at, cos = self.nearest(*vector, without)
        weight = cos ** 2
        return float(((weight * self.toxic[at]).sum() + self.base * 0.1) / (weight.sum() + 0.1)), at, cos

    def score(self, counts: dict[int, int]) -> tuple[float, list[int], list[float]]:
        """Calibrated score and the examples that stand behind it."""
        if not counts:
            return self.base, [], []
        raw, at, cos = self.vote(self._vector(counts))
        value = float(np.interp(raw, self.steps, self.levels)) if len(self.steps) else raw
        return min(max(value, 0.0), 1.0), self.ids[at].tolist(), cos.tolist()


def build(df: DataFrame, labels: DataFrame, examples: int = EXAMPLES, vocabulary: int = VOCABULARY) -> Index:
    """Index of at most ``examples`` labelled documents over at most ``vocabulary`` words."""
    rows = cut(example_rows(df, labels, examples))  # read four times, bounded by examples
    # copies of one text are one witness for its words
    apart = cut(rows.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")))
    counts = cut(apart.select("text", "toxic").mapInPandas(_word_counts, "word string, n long, bad long").groupBy("word").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    total = apart.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0)).alias("bad")).first()
    known = {w: i for i, w in enumerate(sorted(_telling(counts, total["n"], total["bad"], vocabulary)))}
    n_docs = df.count()
    seen = df.select("text").mapInPandas(_frequencies(known), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    idf = np.ones(len(known))
    for r in seen.collect():  # one row per telling word
        idf[known[r["word"]]] = math.log((1 + n_docs) / (1 + r["n"])) + 1e-6

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [Counter(known[w] for w in words(t) if w in known) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "terms": [list(c) for c in found], "times": [list(c.values()) for c in found]})

    got = (rows.mapInPandas(counted, "doc_id long, toxic int, terms array<int>, times array<int>").orderBy("doc_id")
           .limit(examples).toPandas())
    for stored in (counts, apart, rows):
        release(stored)
    pairs = [dict(zip(map(int, t), map(int, n))) for t, n in zip(got["terms"], got["times"])]
    return Index(known, idf, got["doc_id"].to_numpy(), got["toxic"].to_numpy(), pairs)


def toxicity(df: DataFrame, labels: DataFrame, examples: int = EXAMPLES, vocabulary: int = VOCABULARY,
             threshold: float = 0.5) -> DataFrame:
    """``(doc_id, score, predicted, nearest, evidence)`` for every row of ``(doc_id, text)``.

    ``evidence`` lists the examples that voted, nearest first, ``nearest`` the
    best cosine (null without any).  A text without telling words, null and empty
    ones among them, has the rate of the examples that have none either.  Without
    labels of both kinds there are no telling words and every score is that rate
    (0 without any label).  Of repeated labels the highest counts; null ids and
    labels teach nothing.  Other columns are ignored.
    """
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    index = build(docs, labels, examples, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[tuple, tuple] = {}
        for batch in batches:
            scored = []
            for text in batch.column(1):
                counts = Counter(index.known[w] for w in words(text.as_py()) if w in index.known)
                key = tuple(sorted(counts.items()))
                if key not in memory:
                    if len(memory) > 50_000:
                        memory.clear()
                    memory[key] = index.score(counts)
                scored.append(memory[key])
            columns = [batch.column(0), pa.array([s for s, _, _ in scored], pa.float64()),
                       pa.array([int(s >= threshold) for s, _, _ in scored], pa.int32()),
                       pa.array([c[0] if c else None for _, _, c in scored], pa.float64()),
                       pa.array([ids for _, ids, _ in scored], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "predicted", "nearest", "evidence"])

    return docs.mapInArrow(run, "doc_id long, score double, predicted int, nearest double, evidence array<long>")

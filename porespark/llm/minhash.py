"""MinHash near-duplicates with min-max signatures.

Each permutation of the shingle hashes yields two signature values, its minimum
and its maximum.  Both agree between two sets with probability equal to their
Jaccard similarity, so 64 permutations give 128 unbiased values for half the
hashing.  The values are banded four by four from distinct permutations, which
makes the chance that a band agrees exactly J^4; with 32 bands a pair at
similarity 0.8 is missed with probability 5e-8.

Candidates are confirmed on full shingle sets.  A bucket of m documents is not
turned into m^2 pairs: members are first compared with the bucket's smallest
document, and links are merged into components.  Where several components still
meet in a bucket, the documents around it are compared in pairs of blocks, each
inside one task, and only links that join components leave it.  Pairs that are
skipped lie in one component already, so components are those of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from porespark.llm.blocks import Forest, deal, per_pair, together
from porespark.llm.components import components
from porespark.plans.lineage import cut, release

PERMUTATIONS, BAND_ROWS = 64, 4     # 2 * 64 / 4 = 32 bands
_REMEMBERED = 300_000
_M64 = (1 << 64) - 1


class _WordHashes(dict):
    """64-bit hash of a word, kept while the worker lives, bounded in size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's k-word shingles.

    Words are runs of anything but ASCII white space, with A-Z lower-cased.  A
    text of fewer than k words is one shingle, one without words has none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    total = np.full(n, min(k, len(h)), np.uint64)
    for i in range(min(k, len(h))):
        total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + h[i:i + n])
    return np.unique(total)


def _permutations(seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda: rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
    return draw() * np.uint64(2) + np.uint64(1), draw()


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of the set under each permutation, block by block."""
    low, high = np.full(len(a), _M64, np.uint64), np.zeros(len(a), np.uint64)
    for at in range(0, len(hashes), 2048):
        x = hashes[None, at:at + 2048] * a[:, None]
        x ^= x >> np.uint64(32)
        x *= b[:, None] | np.uint64(1)
        np.minimum(low, x.min(axis=1), out=low)
        np.maximum(high, x.max(axis=1), out=high)
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One 64-bit key per band: two minima and two maxima of four permutations."""
    groups_low, groups_high = low.reshape(-1, BAND_ROWS), high.reshape(-1, BAND_ROWS)
    half = BAND_ROWS // 2
    bands = np.concatenate([np.concatenate([groups_low[:, :half], groups_high[:, half:]], axis=1),
                            np.concatenate([groups_high[:, :half], groups_low[:, half:]], axis=1)])
    keys = np.arange(len(bands), dtype=np.uint64)
    for column in bands.T:
        keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sketch(k: int, seed: int):
    """Per document: set size, a 128-bit digest of the set, and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _permutations(seed)
        for batch in batches:
            sizes, digests, keys = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), k)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(_signed(band_keys(*signature(s, a, b))) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "digest", "keys"])
        _HASHES.clear()  # the worker goes on to other stages

    return run


def _confirm(k: int, percent: int):
    """Keeps the pairs whose full sets are similar enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, base = None, None
        for pairs in batches:
            good = np.zeros(len(pairs), bool)
            for i, (hub, left, right) in enumerate(zip(pairs["a"].array, pairs["left"].array, pairs["right"].array)):
                if hub != last:
                    last, base = hub, shingle_set(left, k)
                other = shingle_set(right, k)
                both = len(np.intersect1d(base, other, assume_unique=True))
                good[i] = 100 * both >= percent * (len(base) + len(other) - both)
            yield pairs.loc[good, ["a", "b"]]
        _HASHES.clear()

    return run


def _links(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Confirmed links among candidate pairs ``(a, b)``; a hub's pairs stay spread over tasks."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("left"), F.col("least").alias("a_least"), F.col("most").alias("a_most"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("right"), F.col("least").alias("b_least"), F.col("most").alias("b_most"))
    # otherwise the sizes alone rule the pair out
    fits = (F.col("a_most") * 100 >= F.col("b_least") * percent) & (F.col("b_most") * 100 >= F.col("a_least") * percent)
    return (pairs.join(right, "b").join(left, "a").filter(fits).select("a", "b", "left", "right")
            .mapInPandas(_confirm(k, percent), "a long, b long"))


def near_duplicates(df: DataFrame, k: int = 5, percent: int = 80, seed: int = 7,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``df``.

    Documents are linked when the Jaccard similarity of their k-word shingle
    sets is at least ``percent`` / 100; ``component_id`` is the smallest id that
    links reach, itself included, and ``kept`` marks it.  Null, empty and
    wordless texts have no shingles and link with nothing; a null id stays alone
    with a null component and is kept.  Rows that repeat an id are one document
    per distinct text; each gets a row, and the id's links are those of all its
    texts.  Equal sets are merged before anything is compared.  Other columns
    are ignored.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = cut(docs.mapInArrow(_sketch(k, seed), "doc_id long, n_shingles long, digest binary, keys array<long>"))
    known = sketch.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    # one representative for each distinct set
    classes = cut(known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")))
    buckets = (classes.select("rep", F.posexplode("keys").alias("band", "key")).groupBy("band", "key")
               .agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    members = cut(classes.select("rep", F.posexplode("keys").alias("band", "key"))
                  .join(buckets, ["band", "key"]).select("key", "rep", "hub").distinct())
    copies = known.join(classes.select("digest", "rep"), "digest").select(
        F.col("rep").alias("a"), F.col("doc_id").alias("b")).filter("a <> b")
    pairs = cut(members.filter("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct())
    wanted = (members.select(F.col("rep").alias("doc_id")).distinct())
    sizes = known.groupBy("doc_id").agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"))
    texts = cut(docs.join(wanted.join(sizes, "doc_id"), "doc_id"))
    found = [cut(_links(pairs, texts, k, percent))]
    found.append(cut(_across(members, components(found[0]), texts, k, percent)))
    release(texts)
    final = cut(components(_union([*found, copies])))
    return (sketch.select("doc_id", "n_shingles").join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all sets on the left with all on the right."""
    counts = np.zeros((len(left), len(right)), np.float32)
    shared = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    sides = []
    for sets in (left, right):
        values, rows = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(shared, values), max(0, len(shared) - 1))
        hit = shared[at] == values if len(shared) else np.zeros(len(values), bool)
        order = np.argsort(at[hit], kind="stable")
        sides.append((at[hit][order], rows[hit][order]))
    for start in range(0, len(shared), 2048):
        blocks = []
        for (columns, rows), sets in zip(sides, (left, right)):
            block = np.zeros((len(sets), 2048), np.float32)
            lo, hi = np.searchsorted(columns, [start, start + 2048])
            block[rows[lo:hi], columns[lo:hi] - start] = 1
            blocks.append(block)
        counts += blocks[0] @ blocks[1].T
    return counts.astype(np.int64)


def _joining(k: int, percent: int):
    """Links between two blocks that join different components."""

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        sides = (left, right)
        ids, places = [s["rep"].tolist() for s in sides], [s["component"].to_numpy() for s in sides]
        sets = [[shingle_set(t, k) for t in s["text"]] for s in sides]
        n = [np.array([len(x) for x in side], np.int64) for side in sets]
        both = _overlaps(*sets)
        near = 100 * both >= percent * (n[0][:, None] + n[1][None, :] - both)
        near &= places[0][:, None] != places[1][None, :]
        joined, places = Forest(), [p.tolist() for p in places]
        links = [(ids[0][i], ids[1][j]) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(near)))
                 if joined.join(places[0][i], places[1][j])]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return compare


def _across(members: DataFrame, group: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between components that meet in a bucket.

    Documents whose buckets overlap form a cluster; one whose members all lie in
    one component is done.  Of the others all pairs of fitting sizes are
    compared, in pairs of blocks: a block holds documents of one size class and
    some 200,000 shingles, and a task gets the texts of two.  Only links that
    join two components leave the task, so rows grow with documents and not
    with their pairs.
    """
    placed = cut(members.join(group.select(F.col("node").alias("rep"), "component"), "rep", "left")
                 .select("key", "rep", "hub", F.coalesce("component", "rep").alias("component")))
    mixed = (placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
             .filter("low <> high").select("key"))
    placed = cut(placed.join(mixed, "key").select("rep", "hub", "component").distinct())
    cluster = components(placed.select(F.col("rep").alias("a"), F.col("hub").alias("b")))
    # sets link only if the smaller has `percent` of the larger: same or next class
    size_class = F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    docs = (placed.select("rep", "component").distinct().join(cluster.withColumnRenamed("node", "rep").withColumnRenamed("component", "cluster"), "rep")
            .join(texts.select(F.col("doc_id").alias("rep"), "text", F.col("least").alias("n_shingles")), "rep")
            .withColumn("class", size_class))
    per_block = F.greatest(F.lit(2.0), F.least(F.lit(1024.0), F.lit(200_000.0) / F.pow(F.lit(100.0 / percent), F.col("class") + 1)))
    dealt = deal(cut(docs), ["cluster"], "rep", per_block).select("pair", "side", "rep", "component", "text")
    return together(dealt).mapInPandas(per_pair(_joining(k, percent)), "a long, b long")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0].select("a", "b")
    for part in parts[1:]:
        out = out.unionByName(part.select("a", "b"))
    return out

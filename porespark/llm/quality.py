"""Quality classifier with hierarchical empirical-Bayes site priors.

A logistic classifier over shape statistics of the text gives each document its
own evidence.  Sites add theirs: a host's rate of good documents is shrunk
towards the global rate, a path's rate towards its host's, each by as many
pseudo-documents as the spread between sites calls for, so a site with few
documents hardly moves from its parent.  The two are combined in log-odds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from porespark.llm.common import apart
from porespark.plans.lineage import cut

TRAIN_ROWS = 20_000     # bound of the labelled sample that the classifier is fitted on
KEEP = 0.5              # posterior from which a document stays
_RIDGE = 1.0
_UNIT = 1_000_000       # probabilities are summed as whole millionths, so that reruns agree to the last bit


def _class_table() -> np.ndarray:
    """256 x classes: upper, lower, digit, blank, line end, sentence marks, shouting, symbols, other bytes."""
    table = np.zeros((256, 9))
    for b in range(256):
        c = chr(b)
        kind = (0 if "A" <= c <= "Z" else 1 if "a" <= c <= "z" else 2 if "0" <= c <= "9" else 4 if c in "\r\n" else 3 if c in " \t"
                else 5 if c in ".,;:'\"?-()" else 6 if c == "!" else 7 if 33 <= b < 127 else 8)
        table[b, kind] = 1
    return table


_CLASSES = _class_table()
N_FEATURES = 17


def features(text: str | None) -> np.ndarray:
    """Shape statistics of a whole text; all but the last three lie between 0 and 1."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return np.zeros(N_FEATURES)
    shares = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASSES / len(data)
    words, lines = data.lower().split(), data.split(b"\n")
    n, kinds = max(1, len(words)), len(set(words))
    marked = sum(1 for w in words if not w[-1:].isalnum() and w[-1] < 128)
    return np.concatenate([shares, [kinds / n, len(set(lines)) / len(lines), marked / n, np.sqrt(shares[6]), np.sqrt(shares[7]),
                                    np.log1p(len(data)) / 10, np.log1p(n) / 10, min(len(data) / n, 50) / 10]])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([features(t) for t in texts])


def _sample(labels: DataFrame, rows: int) -> DataFrame:
    """The ``rows`` labelled documents with the smallest hash; one row per id."""
    one = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("_y"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fit(df: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Ridge logistic regression by Newton steps on at most ``train_rows`` labelled rows.

    Without labels of both kinds every document gets the rate of the one kind
    (or one half).
    """
    sample = F.broadcast(_sample(labels, train_rows))  # bounded by train_rows
    rows = (df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(sample, F.col("_id") == F.col("doc_id"))
            .select("doc_id", "_y", _features(F.col("_text")).alias("_x")).orderBy("doc_id").limit(train_rows).toPandas())
    y = rows["_y"].to_numpy(float)
    rate = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    model = {"mean": np.zeros(N_FEATURES), "scale": np.ones(N_FEATURES), "weights": np.zeros(N_FEATURES + 1), "rate": rate}
    model["weights"][-1] = np.log(rate / (1 - rate))
    if len(set(y)) < 2:
        return model
    x = np.stack(rows["_x"].to_numpy())
    model["mean"], model["scale"] = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.c_[(x - model["mean"]) / model["scale"], np.ones(len(x))]
    w, ridge = model["weights"], np.diag([_RIDGE] * N_FEATURES + [1e-6])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    model["weights"] = w
    return model


def _logit(p: Column) -> Column:
    return F.log(p / (F.lit(1.0) - p))


def _own(model: dict, x: Column) -> Column:
    """Millionths of the classifier's probability that a document is good."""
    scale = model["weights"][:-1] / model["scale"]
    bias = float(model["weights"][-1] - (scale * model["mean"]).sum())
    score = sum((F.get(x, i) * F.lit(float(v)) for i, v in enumerate(scale)), F.lit(bias))
    return F.round(F.lit(float(_UNIT)) / (F.lit(1.0) + F.exp(-score))).cast("long")


def _strength(groups: DataFrame, parent: Column) -> float:
    """Pseudo-documents that shrink ``(n, good)`` towards ``parent``, by the method of moments."""
    rate = F.col("good") / F.col("n")
    row = groups.filter("n > 1").agg(
        F.sum(F.col("n") * F.pow(rate - parent, 2.0)).alias("between"), F.sum(F.lit(1)).alias("groups"),
        F.sum("n").alias("n"), F.sum(F.col("n") * parent * (F.lit(1.0) - parent)).alias("inside")).first()
    if not row["n"] or not row["inside"]:
        return 100.0
    noise = row["inside"] / row["n"]
    spread = max((row["between"] - row["groups"] * noise) / row["n"], noise * 1e-4)
    return float(np.clip(round(noise / spread, 3), 1.0, 10_000.0))


def sites(scored: DataFrame) -> tuple[DataFrame, float]:
    """Shrunk rate of each ``(host, path)`` of ``(host, path, p)``, and the global rate.

    Counts per path are combined before the shuffle and hosts are summed from
    paths, so a large host costs no more than a small one.
    """
    paths = cut(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), (F.sum("p") / F.lit(float(_UNIT))).alias("good")))
    total = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    rate = min(max(round((total["good"] or 0.0) / max(total["n"] or 0, 1), 6), 1e-4), 1 - 1e-4)
    hosts = cut(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")))
    k = _strength(hosts, F.lit(rate))
    hosts = hosts.select(F.col("host").alias("_h"), ((F.col("good") + k * rate) / (F.col("n") + k)).alias("host_rate"))
    below = cut(paths.join(hosts, F.col("host").eqNullSafe(F.col("_h"))).drop("_h"))
    k = _strength(below, F.col("host_rate"))
    path_rate = (F.col("good") + F.lit(k) * F.col("host_rate")) / (F.col("n") + k)
    return cut(below.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.round("host_rate", 6).alias("host_rate"),
                            F.round(path_rate, 6).alias("path_rate"))), rate


def posterior(rate: float) -> Column:
    """A document's log-odds with its site's rate in place of the global one, as a probability."""
    safe = lambda p: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    odds = _logit(safe(F.col("_own") / F.lit(float(_UNIT)))) + _logit(safe(F.col("path_rate"))) - float(np.log(rate / (1 - rate)))
    return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-odds)), 6)


def _at_sites(rows: DataFrame, rates: DataFrame) -> DataFrame:
    return rows.join(rates, F.col("_h").eqNullSafe(F.col("_host")) & F.col("_p").eqNullSafe(F.col("_path")))


def quality_scores(df: DataFrame, labels: DataFrame, host: Column, path: Column, train_rows: int = TRAIN_ROWS,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, doc_score, host_rate, path_rate, posterior, keep)`` for every row of ``df``.

    Null and empty texts are scored like any text, by features that are all 0.
    Null hosts and paths are sites of their own.  Labels of ids that ``df`` lacks,
    null labels and null ids teach nothing; of repeated labels the highest counts.
    Other columns are ignored.
    """
    model = fit(df, labels, train_rows, id_col, text_col)
    slim = cut(df.select(F.col(id_col).alias("doc_id"), host.alias("_h"), path.alias("_p"), _features(F.col(text_col)).alias("_x"))
               .select("doc_id", "_h", "_p", _own(model, F.col("_x")).alias("_own")))
    rates, rate = sites(slim.select(F.col("_h").alias("host"), F.col("_p").alias("path"), F.col("_own").alias("p")))
    return (_at_sites(slim, rates).withColumn("posterior", posterior(rate))
            .select("doc_id", (F.col("_own") / F.lit(float(_UNIT))).alias("doc_score"), "host_rate", "path_rate", "posterior",
                    (F.col("posterior") >= F.lit(KEEP)).alias("keep")))


def good_documents(df: DataFrame, labels: DataFrame, host: Column, path: Column, train_rows: int = TRAIN_ROWS,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that the classifier keeps, unchanged, whatever their columns' names.

    Texts are read twice and never shuffled: the second pass meets only the
    table of site rates.
    """
    model = fit(df, labels, train_rows, id_col, text_col)
    own = lambda d: d.withColumn("_x", _features(F.col("_text"))).withColumn("_own", _own(model, F.col("_x"))).drop("_x", "_text")
    marks = [host.alias("_h"), path.alias("_p"), F.col(text_col).alias("_text")]
    rates, rate = sites(own(df.select(*marks)).select(F.col("_h").alias("host"), F.col("_p").alias("path"), F.col("_own").alias("p")))
    rows, new = apart(df, *marks)
    kept = _at_sites(own(rows), rates).filter(posterior(rate) >= F.lit(KEEP))
    return kept.select(*[F.col(n).alias(c) for c, n in new.items()])

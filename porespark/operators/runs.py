"""Versioned runs: hashes, reuse pointers, latest and long tables, inventory.

A run is ``(ms_id, version, method, status, points_to_version, config_hash,
has_full, config)``; metrics are ``(ms_id, version, method, key, value)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from porespark.config import NETWORK_CONFIG_DEFAULTS
from porespark.plans.ordering import with_position


def hash_column(canonical: str = "config") -> Column:
    """First 12 hex digits of the SHA-256 of an already canonical JSON string."""
    return F.substring(F.sha2(F.col(canonical), 256), 1, 12)


def assign_versions(requests: DataFrame, keys: Sequence[str] = ("ms_id", "method"),
                    order: Sequence[str] = ("ts", "event_id"), window_rows: int | None = None) -> DataFrame:
    """Number requests 1..n per key in arrival order."""
    return with_position(requests, list(keys), [F.col(c).asc() for c in order], "version", window_rows)


def next_version(runs: DataFrame) -> DataFrame:
    """``max(version) + 1`` per sample."""
    return runs.groupBy("ms_id").agg((F.max("version") + 1).alias("next_version"))


def resolve_reuse(requests: DataFrame) -> DataFrame:
    """Decide real run or pointer for every request.

    A request reuses the earliest earlier real run with its hash; one that wants
    full results only reuses a real run that kept them.  The first request of a
    hash is always real, and so is the first that wants full results, so both
    targets are minima per (sample, method, hash).
    """
    key = ["ms_id", "method", "config_hash"]
    first = requests.groupBy(*key).agg(F.min("version").alias("_any"),
                                       F.min(F.when(F.col("save_full"), F.col("version"))).alias("_full"))
    target = F.when(F.col("save_full"), F.col("_full")).otherwise(F.col("_any"))
    out = requests.join(first, key).withColumn("_t", target)
    pointer = F.col("_t") < F.col("version")
    return (out.withColumn("status", F.when(pointer, "pointer").otherwise("real"))
            .withColumn("points_to_version", F.when(pointer, F.col("_t")))
            .withColumn("has_full", ~pointer & F.col("save_full")).drop("_any", "_full", "_t"))


def plan_versions(wanted: DataFrame, runs: DataFrame, taken: DataFrame, save_full: bool = False) -> DataFrame:
    """New ``runs`` rows that bring the store up to ``wanted`` (ms_id, method, config, config_hash).

    Samples whose latest version already has every wanted hash - and full results,
    if those are wanted - get none.  Others get one new version: a pointer where an
    earlier real run has the hash (and full results, if wanted), else a real run.
    ``taken`` has ``(ms_id, version)`` of numbers that must not be used again, such
    as those of a batch that died before its rows were written.
    """
    known = runs.select("ms_id", "version").unionByName(taken.select("ms_id", "version").distinct())
    usable = runs.filter("status = 'real'")
    if save_full:
        usable = usable.filter("has_full")
    earlier = usable.groupBy("ms_id", "method", "config_hash").agg(F.min("version").alias("points_to_version"))
    todo = wanted.join(all_match_latest(runs, wanted, need_full=save_full).filter("is_noop"), "ms_id", "left_anti")
    return (todo.join(next_version(known), "ms_id", "left").join(earlier, ["ms_id", "method", "config_hash"], "left")
            .select("ms_id", F.coalesce("next_version", F.lit(1)).cast("long").alias("version"), "method",
                    F.when(F.col("points_to_version").isNull(), "real").otherwise("pointer").alias("status"),
                    "points_to_version", "config_hash", (F.col("points_to_version").isNull() & F.lit(save_full)).alias("has_full"),
                    "config"))


def resolved(runs: DataFrame) -> DataFrame:
    """Add the version that holds the data: one hop, pointers never chain."""
    return runs.withColumn("resolved_version", F.coalesce("points_to_version", "version"))


def dereference(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Metrics of every run, taken from the run a pointer names."""
    m = metrics.select("ms_id", "method", F.col("version").alias("resolved_version"), "key", "value")
    return resolved(runs).join(m, ["ms_id", "method", "resolved_version"], "left")


def latest(runs: DataFrame, pointers: DataFrame | None = None) -> DataFrame:
    """Latest version per sample (S7).  A recorded latest that no run has falls back to the maximum."""
    top = runs.groupBy("ms_id").agg(F.max("version").alias("_top"))
    if pointers is None:
        return top.withColumnRenamed("_top", "latest_version")
    known = runs.select("ms_id", F.col("version").alias("recorded")).distinct()
    ok = pointers.select("ms_id", F.col("version").alias("recorded")).join(known, ["ms_id", "recorded"], "left_semi")
    return top.join(ok, "ms_id", "left").select("ms_id", F.coalesce("recorded", "_top").alias("latest_version"))


def all_match_latest(runs: DataFrame, wanted: DataFrame, need_full: bool = False) -> DataFrame:
    """Whether every wanted (method, hash) equals what is in effect at the latest version."""
    last = latest(runs)
    at = resolved(runs).join(last, "ms_id").filter(F.col("version") == F.col("latest_version"))
    real = runs.filter("status = 'real'").select("ms_id", "method", F.col("version").alias("resolved_version"), F.col("has_full").alias("full"))
    at = at.join(real, ["ms_id", "method", "resolved_version"], "left").select("ms_id", "method", F.col("config_hash").alias("have"), "full")
    same = F.coalesce(F.col("have") == F.col("config_hash"), F.lit(False))
    if need_full:
        same = same & F.coalesce("full", F.lit(False))
    return wanted.join(at, ["ms_id", "method"], "left").groupBy("ms_id").agg(F.bool_and(same).alias("is_noop"))


def best_full(runs: DataFrame) -> DataFrame:
    """Real run with the latest version's hash, full results preferred, then newest."""
    last = latest(runs)
    target = (runs.join(last, "ms_id").filter(F.col("version") == F.col("latest_version"))
              .select("ms_id", "method", "config_hash"))
    return (runs.filter("status = 'real'").join(target, ["ms_id", "method", "config_hash"])
            .groupBy("ms_id", "method").agg(F.max(F.struct("has_full", "version")).alias("b"))
            .select("ms_id", "method", F.col("b.version").alias("best_version"), F.col("b.has_full").alias("best_has_full")))


def matching(runs: DataFrame, criteria: dict, defaults: dict | None = None) -> DataFrame:
    """Best real run whose config meets every criterion; absent keys use defaults."""
    from porespark.config import canonical_json

    defaults = NETWORK_CONFIG_DEFAULTS if defaults is None else defaults
    parsed = F.try_parse_json(F.col("config"))
    hit = F.lit(True)
    stored = F.json_object_keys("config")
    for key, value in criteria.items():
        # numbers are compared as numbers, all else as JSON text; a default counts only where the key is absent
        is_number = isinstance(value, (int, float)) and not isinstance(value, bool)
        kind = "double" if is_number else "string"
        want = float(value) if is_number else _scalar_text(value)
        default = defaults.get(key)
        if is_number:
            default = float(default) if isinstance(default, (int, float)) and not isinstance(default, bool) else None
        else:
            default = _scalar_text(default)
        present = F.coalesce(F.array_contains(stored, key), F.lit(False))
        have = F.when(present, F.try_variant_get(parsed, f"$.{key}", kind)).otherwise(F.lit(default).cast(kind))
        known = present | F.lit(key in defaults)
        hit = hit & known & have.eqNullSafe(F.lit(want).cast(kind))
    return (runs.filter("status = 'real'").filter(hit).groupBy("ms_id", "method")
            .agg(F.max(F.struct("has_full", "version")).alias("b"))
            .select("ms_id", "method", F.col("b.version").alias("version"), F.col("b.has_full").alias("has_full")))


def _scalar_text(value) -> str | None:
    if value is None:
        return None
    return str(value).lower() if isinstance(value, bool) else str(value)


def latest_wide(runs: DataFrame, metrics: DataFrame, methods: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row per sample at its latest version, ``<method>.<key>`` columns."""
    last = latest(runs)
    at = resolved(runs).join(last, "ms_id").filter(F.col("version") == F.col("latest_version"))
    return _wide(at, metrics, methods, keys, ["ms_id", "latest_version"], ["version", "is_pointer"])


def all_versions(runs: DataFrame, metrics: DataFrame, methods: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row per sample and version with status, hash and resolved version."""
    return _wide(resolved(runs), metrics, methods, keys, ["ms_id", "version"], ["status", "config_hash", "resolved_version"])


def _wide(at, metrics, methods, keys, by, bookkeeping) -> DataFrame:
    m = metrics.select("ms_id", "method", F.col("version").alias("resolved_version"), "key", "value")
    per_run = at.join(m, ["ms_id", "method", "resolved_version"], "left")
    aggs = []
    fields = {"version": F.col("resolved_version"), "resolved_version": F.col("resolved_version"), "status": F.col("status"),
              "config_hash": F.col("config_hash"), "is_pointer": F.col("status") == "pointer"}
    for method in methods:
        mine = F.col("method") == method
        aggs += [F.max(F.when(mine, fields[b])).alias(f"{method}.{b}") for b in bookkeeping]
        aggs += [F.max(F.when(mine & (F.col("key") == k), F.col("value"))).alias(f"{method}.{k}") for k in keys]
    return per_run.groupBy(*by).agg(*aggs)


def inventory(runs: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Status, full-result flag and best version of each method at the latest version."""
    samples = latest(runs)
    grid = samples.select("ms_id", "latest_version", F.explode(F.array(*[F.lit(m) for m in methods])).alias("method"))
    at = runs.select("ms_id", "method", F.col("version").alias("latest_version"), "status", "points_to_version")
    text = F.when(F.col("status") == "pointer", F.concat(F.lit("pointer->v"), F.col("points_to_version").cast("string"))
                  ).when(F.col("status") == "real", "real").otherwise("missing")
    naive = F.coalesce("points_to_version", "latest_version")
    return (grid.join(at, ["ms_id", "method", "latest_version"], "left").join(best_full(runs), ["ms_id", "method"], "left")
            .select("ms_id", "latest_version", "method", text.alias("status"), F.coalesce("best_has_full", F.lit(False)).alias("has_full"),
                    "best_version", F.coalesce(F.col("best_version") != naive, F.lit(False)).alias("differs_from_naive")))


def inventory_counts(inv: DataFrame) -> DataFrame:
    """real / pointer / missing and full / not full per method."""
    return inv.groupBy("method").agg(
        F.count_if(F.col("status") == "real").alias("n_real"), F.count_if(F.col("status").startswith("pointer")).alias("n_pointer"),
        F.count_if(F.col("status") == "missing").alias("n_missing"), F.count_if("has_full").alias("n_full"),
        F.count_if(~F.col("has_full")).alias("n_no_full"))


def hard_stop(counts: DataFrame, method: str = "network") -> bool:
    """True when most samples lack full results of ``method``."""
    row = counts.filter(F.col("method") == method).first()
    return row is not None and row["n_full"] < (row["n_full"] + row["n_no_full"]) / 2

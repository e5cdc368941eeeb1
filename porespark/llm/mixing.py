"""Mixing sources to target weights, with built-in functions only.

Every document gets a random but repeatable key from its id.  Within a source
the mix takes whole epochs and then documents in key order up to the word at
which the source's budget is spent.  Since a source is cut at one key, the plan
of the whole mix is one small row per source: epochs, the cutting key, and the
words taken of the document there.

Keys are uniform, so cutting a source's key range into equal intervals yields
buckets of nearly equal row counts without sampling: sums per bucket are added
up along the range, and only the bucket that holds the cut is sorted.  No task
holds more than one bucket of a source, however large the source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from porespark.llm.common import apart, ranked, word_count
from porespark.plans.lineage import cut

BUCKET_ROWS = 50_000    # expected rows of one key interval of a source


def key_of(row_id: Column, seed: str) -> Column:
    """Hash-random sort key: 32 hexadecimal digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit("null"))))


def _interval(key: Column, n: Column) -> Column:
    """Which of ``n`` equal intervals of the key range a key lies in."""
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) * n).cast("long")


def targets(totals: DataFrame, weights: Sequence[int], share: float, epochs: float) -> DataFrame:
    """Adds ``target`` to ``(source, source_size, ..)``: ``share`` of all words by weight, capped.

    Sources take the weights in turn in code-point order, null last.  What a
    source would get beyond ``epochs`` times its size is shared by weight among
    the others, again until none exceeds its cap.
    """
    placed = ranked(totals, [F.col("source").isNull(), F.col("source")], "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    placed = cut(placed.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(epochs))))
    whole = share * float(placed.agg(F.sum("source_size").cast("double").alias("n")).first()["n"] or 0)
    level, capped = 0.0, -1
    while True:  # each round settles at least one source for good
        row = placed.agg(F.sum(F.when(F.col("_cap") < level * F.col("_w"), F.col("_cap"))).alias("held"),
                         F.sum(F.when(F.col("_cap") >= level * F.col("_w"), F.col("_w"))).alias("open"),
                         F.count_if(F.col("_cap") < level * F.col("_w")).alias("n")).first()
        if row["n"] == capped or not row["open"]:
            break
        capped, level = row["n"], (whole - (row["held"] or 0.0)) / row["open"]
    full = row["open"] is None or not row["open"]
    target = F.col("_cap") if full else F.when(F.col("_cap") < level * F.col("_w"), F.col("_cap")).otherwise(level * F.col("_w"))
    return placed.withColumn("target", target.cast("double")).drop("_rank", "_w", "_cap")


def plan(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """One row per source of ``sizes`` ``(source, key, size)``.

    ``source, source_size, target, whole`` (epochs taken whole), ``cut_key`` and
    ``cut_words``: documents with a smaller key are taken once more, the one at
    the key for ``cut_words`` words.
    """
    totals = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")))
    budget = F.floor("target").cast("long")
    goal = cut(targets(totals, weights, share, epochs)
               .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
               .withColumn("rest", budget - F.col("whole") * F.col("source_size"))
               .withColumn("n_intervals", F.ceil(F.col("n_docs") / F.lit(float(BUCKET_ROWS)))))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    tagged = (sizes.join(goal.select("source", "n_intervals", "rest"), same(sizes, goal)).select(
        sizes["source"], "key", "size", "rest", _interval(F.col("key"), F.col("n_intervals")).alias("interval")))
    sums = tagged.groupBy("source", "interval").agg(F.sum("size").alias("total"), F.first("rest").alias("rest"))
    before = Window.partitionBy("source").orderBy("interval").rowsBetween(Window.unboundedPreceding, -1)
    at = (sums.withColumn("before", F.coalesce(F.sum("total").over(before), F.lit(0)))
          .filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("total")))
          .select("source", "interval", (F.col("rest") - F.col("before")).alias("left")))
    # rows of one key - repeated ids - are cut alike
    keys = (tagged.select("source", "interval", "key", "size").alias("t")
            .join(at.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")) & (F.col("t.interval") == F.col("c.interval")))
            .groupBy(F.col("t.source").alias("source"), "key", "left").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")))
    within = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = (keys.withColumn("upto", F.sum("size").over(within))
            .filter((F.col("upto") - F.col("size") <= F.col("left")) & (F.col("left") < F.col("upto")))
            .select(F.col("source").alias("_s"), F.col("key").alias("cut_key"),
                    F.floor((F.col("left") - F.col("upto") + F.col("size")) / F.col("n")).cast("long").alias("cut_words")))
    return (goal.join(cuts, F.col("source").eqNullSafe(F.col("_s")), "left")
            .select("source", "source_size", "target", "whole", "cut_key", "cut_words"))


def _marks(id_col: str, source_col: str, text_col: str, seed: str) -> list[Column]:
    return [F.col(source_col).alias("_source"), key_of(F.col(id_col), seed).alias("_key"), word_count(F.col(text_col)).alias("_size")]


def _with_plan(rows: DataFrame, sources: DataFrame) -> DataFrame:
    p = sources.select(F.col("source").alias("_p"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"),
                       F.col("whole").alias("_whole"), F.col("cut_key").alias("_cut_key"), F.col("cut_words").alias("_cut_words"))
    extra = (F.when(F.col("_key") < F.col("_cut_key"), F.col("_size"))
             .when(F.col("_key") == F.col("_cut_key"), F.least(F.col("_cut_words"), F.col("_size"))).otherwise(F.lit(0)))
    return (rows.join(p, F.col("_source").eqNullSafe(F.col("_p")))
            .withColumn("_extra", extra).withColumn("_taken", F.col("_whole") * F.col("_size") + F.col("_extra")))


def mix(df: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, epochs: float = 2.0, seed: str = "mix",
        id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every row of ``df``.

    ``size`` counts the words of the text, 0 for null.  A source's taken words
    add up to its target, rounded down (less at most a word for each row that
    repeats the id at the cut).  No row is taken more than ``epochs`` times; if
    all sources reach their caps the mix is smaller than ``share``.  A null
    source is a source, null ids share one key.  Reruns give the same rows; other
    columns are ignored.
    """
    slim = cut(df.select(F.col(id_col).alias("doc_id"), *_marks(id_col, source_col, text_col, seed)))
    sources = cut(plan(slim.select(F.col("_source").alias("source"), F.col("_key").alias("key"), F.col("_size").alias("size")),
                       weights, share, epochs))
    return _with_plan(slim, sources).select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                                            F.col("_target").alias("target"), F.col("_taken").alias("taken"))


def mixed_documents(df: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, epochs: float = 2.0,
                    seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: rows of ``df``, repeated by epoch and shortened at the cut.

    A row appears once per epoch that takes it whole; at its source's cut the
    last copy holds the first words only, joined by single blanks, and its
    ``n_chars``, where the table has that column, is counted anew.  Rows that
    are not taken go.  Rows without words, null texts among them, take nothing
    from a budget and appear as often as their key says.  Other columns stay as
    they are, whatever their names.
    """
    marks = _marks(id_col, source_col, text_col, seed)
    rows, new = apart(df, F.col(text_col).alias("_text"), *marks)
    slim = cut(df.select(*marks).select(F.col("_source").alias("source"), F.col("_key").alias("key"), F.col("_size").alias("size")))
    chosen = _with_plan(rows, cut(plan(slim, weights, share, epochs)))
    at_cut = (F.col("_key") == F.col("_cut_key")) & (F.col("_extra") < F.col("_size"))
    again = F.when(F.col("_key") < F.col("_cut_key"), 1).when(at_cut & (F.col("_extra") > 0), 1).when(
        (F.col("_key") == F.col("_cut_key")) & ~at_cut, 1).otherwise(0)
    # a budget of whole epochs has no cut, so that rows without words are not repeated once more
    rest = F.floor("_target") - F.col("_whole") * F.col("_source_size")
    copies = F.col("_whole") + F.when(rest > 0, F.coalesce(again, F.lit(0))).otherwise(0)
    many = (chosen.withColumn("_copies", copies).filter("_copies > 0")
            .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))))
    short = F.coalesce(at_cut, F.lit(False)) & (F.col("_copy") > F.col("_whole"))
    words = F.regexp_extract_all(F.col("_text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(short, F.array_join(F.slice(words, F.lit(1), F.greatest(F.col("_extra"), F.lit(1)).cast("int")), " ")).otherwise(F.col("_text"))
    changed = {text_col: F.col("_cut")}
    if "n_chars" in df.columns:
        changed["n_chars"] = F.when(short, F.char_length("_cut").cast("long")).otherwise(F.col(new["n_chars"]))
    return many.withColumn("_cut", text).select(*[changed.get(c, F.col(new[c])).alias(c) for c in df.columns])

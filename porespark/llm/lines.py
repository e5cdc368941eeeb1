"""Line dedup by site-relative frequency, with built-in functions only.

A line is boilerplate of a host when the share of the host's pages that contain
it reaches a ratio.  Counts go by the line's 128-bit digest, are combined before
the shuffle, and are keyed by host and line, so neither a large host nor a line
that is on every page gathers in one task.  What comes back is a host's short
list of digests: with L lines on a page on average, at most L / ratio.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from porespark.llm.common import apart
from porespark.plans.lineage import cut

# A line goes at 0.5 % of its host's pages, on hosts of under 1,000 pages at five of them; pages that are mostly such lines stay.
RATIO, MIN_PAGES, MOST = 0.005, 5, 0.5


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def boilerplate(df: DataFrame, host: Column, text_col: str, ratio: float, min_pages: int, by_text: bool = False) -> DataFrame:
    """``(host, drop)``: the digests of each host's boilerplate lines; hosts without any are absent.

    With ``by_text`` pages of a host with the same text count as one; copies
    are combined before the shuffle, so a large group of them is one row a task.
    """
    distinct = F.filter(F.array_distinct(_lines(F.col(text_col))), lambda line: F.trim(line) != "")
    pages = df.select(host.alias("_host"), F.transform(distinct, _digest).alias("_digests"), *[_digest(F.col(text_col)).alias("_page")] * by_text)
    if by_text:
        pages = pages.distinct()
    lines = (pages.select("_host", F.explode("_digests").alias("_digest"))
             .groupBy("_host", "_digest").agg(F.count(F.lit(1)).alias("_with")))
    totals = pages.groupBy("_host").agg(F.count(F.lit(1)).alias("_pages"))
    frequent = lines.filter(F.col("_with") >= min_pages).alias("l").join(
        totals.alias("t"), F.col("l._host").eqNullSafe(F.col("t._host")))
    return (frequent.filter(F.col("_with") >= F.lit(ratio) * F.col("_pages"))
            .groupBy(F.col("l._host").alias("_host")).agg(F.collect_set("_digest").alias("_drop")))


def line_dedup(df: DataFrame, host: Column, text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES,
               most: float = 1.0, by_text: bool = False) -> DataFrame:
    """Removes boilerplate lines from ``text_col``; adds ``n_lines`` and ``n_dropped``.

    A page counts a line once.  Lines are compared exactly; blank ones are never
    dropped.  A line goes when it is on at least ``min_pages`` pages of the host
    and on at least ``ratio`` of them; with ``by_text`` copies of one page are
    one page in both counts, so that copying alone drops no text.  Every row stays, also when no line is
    left (its text is then empty); a null text stays null with 0 lines.  A null
    host is a host.  A page that would lose more than the share ``most`` of its
    characters (line ends aside) is itself what is repeated, not its frame: it
    keeps all its lines.  ``n_chars``, where the table has it, is counted anew for
    changed texts.  Existing columns named as the added ones are replaced, all
    others stay, whatever their names.
    """
    names = [c for c in df.columns if c not in ("n_lines", "n_dropped")]
    drop = cut(boilerplate(df, host, text_col, ratio, min_pages, by_text))
    rows, new = apart(df, host.alias("_of"), F.col(text_col).alias("_text"))
    joined = rows.join(drop, F.col("_of").eqNullSafe(F.col("_host")), "left")
    lines = _lines(F.col("_text"))
    kept = F.filter(lines, lambda line: (F.trim(line) == "") | ~F.array_contains(F.col("_drop"), _digest(line)))
    kept = F.when(F.col("_drop").isNull(), lines).otherwise(kept)
    joined = joined.withColumn("_kept", kept)
    if most < 1:
        chars = lambda of: F.char_length(F.array_join(of, ""))
        joined = joined.withColumn("_kept", F.when(chars(F.col("_kept")) < F.lit(1 - most) * chars(lines), lines).otherwise(F.col("_kept")))
    out = (joined
           .withColumn("_n", F.when(F.col("_text").isNull(), 0).otherwise(F.size(lines)).cast("long"))
           .withColumn("_gone", F.when(F.col("_text").isNull(), 0).otherwise(F.size(lines) - F.size("_kept")).cast("long"))
           .withColumn("_clean", F.when(F.col("_gone") > 0, F.array_join("_kept", "\n")).otherwise(F.col("_text"))))
    changed = {text_col: F.col("_clean")}
    if "n_chars" in names:
        changed["n_chars"] = F.when(F.col("_gone") > 0, F.char_length("_clean").cast("long")).otherwise(F.col(new["n_chars"]))
    return out.select(*[changed.get(c, F.col(new[c])).alias(c) for c in names], F.col("_n").alias("n_lines"), F.col("_gone").alias("n_dropped"))

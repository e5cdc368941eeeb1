"""SpotSigs fingerprints, with built-in functions only.

A spot is a common word (an anchor) that is followed by a content word; its
signature is the anchor with the chain of the next content words, however many
anchors lie between them.  Running text is full of spots, lists and boilerplate
are not; where spots are far apart, the chains at all content words between them
are signatures too.  A document's fingerprint is the sorted set of its
signatures, and two fingerprints are compared by Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from porespark.llm.common import ranked
from porespark.plans.lineage import cut

# The most common function words of English, German, French and Spanish.
ANCHORS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "he", "in", "is", "it", "of", "on", "or", "that",
           "the", "this", "to", "was", "were", "with",
           "als", "auch", "auf", "aus", "das", "dem", "den", "der", "des", "die", "ein", "eine", "ist", "mit", "nicht", "sich",
           "und", "von", "zu",
           "au", "aux", "dans", "de", "du", "elle", "en", "et", "est", "il", "la", "le", "les", "par", "pas", "pour", "que",
           "qui", "sur", "un", "une",
           "al", "como", "con", "del", "el", "es", "las", "lo", "los", "no", "para", "por", "se", "su", "y")
CHAIN = 3
# So many content words may lie before, between or after spots; longer stretches are fingerprinted in full.
GAP = 8


def with_spots(df: DataFrame, text: str, spots: str, anchors: Sequence[str] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """Adds the sorted distinct signatures of column ``text`` as ``array<int>``.

    Words are runs of letters and digits, in lower case.  A stretch of more than
    ``GAP`` content words without a spot, and a text without any, has the chains
    at all its content words: what a stretch has depends on no other part of the
    text.  A text without content words has a single signature of the whole
    text, an empty or null text none.
    """
    words, content, ends = f"_words_{spots}", f"_content_{spots}", f"_ends_{spots}"
    anchor = lambda w: w.isin(*anchors)
    split = F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+")
    df = df.withColumn(words, split)
    pairs = F.transform(F.col(words), lambda w, i: F.struct(w.alias("w"), F.get(F.col(words), i - 1).alias("before")))
    df = df.withColumn(content, F.filter(pairs, lambda x: (x["w"] != "") & ~anchor(x["w"])))
    at = F.array_compact(F.transform(F.col(content), lambda x, j: F.when(anchor(x["before"]), j)))
    df = df.withColumn(ends, F.concat(F.array(F.lit(-1)), at, F.array(F.size(content))))
    word = lambda j, k: F.get(F.col(content), j + k)["w"]
    chain_at = lambda first, j: F.hash(first, *[word(j, k) for k in range(chain)])
    found = F.transform(F.slice(ends, F.lit(2), F.size(ends) - 2), lambda j: chain_at(F.get(F.col(content), j)["before"], j))
    none = F.array().cast("array<int>")
    longest = F.when(F.size(ends) > 2, GAP).otherwise(0)
    stretch = lambda j, i: F.when(F.get(F.col(ends), i + 1) - j - 1 > longest,
                                  F.sequence(j + 1, F.get(F.col(ends), i + 1) - 1)).otherwise(none)
    everywhere = F.transform(F.flatten(F.transform(F.col(ends), stretch)), lambda j: chain_at(F.lit("*"), j))
    value = (F.when(F.size(content) > 0, F.concat(found, everywhere))
             .when(F.coalesce(F.col(text), F.lit("")) != "", F.array(F.hash(F.col(text)))).otherwise(none))
    return df.withColumn(spots, F.coalesce(F.array_sort(F.array_distinct(value)), none)).drop(words, content, ends)


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets; two empty ones are alike.

    Pruned: sets whose sizes alone keep it under ``least`` give 0 without being
    intersected.
    """
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    exact = both / (F.size(a) + F.size(b) - both).cast("double")
    return F.when(large == 0, F.lit(1.0)).when((small == 0) | (small < F.lit(least) * large), F.lit(0.0)).otherwise(exact)


def _text(spots: str) -> Column:
    return F.array_join(F.col(spots).cast("array<string>"), ",")


def spot_matches(df: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(a, b, likeness)``: pairs of distinct fingerprints that are at least ``least`` alike.

    ``a < b`` are the smallest ids of their fingerprints; equal fingerprints are
    one row.  Sets are partitioned by length, so that a set only meets sets of
    its own and the next length class.  In a class each set is looked up under
    its rarest signatures, as many as a match cannot do without, and survivors
    are intersected in full.  Documents without signatures match nothing.
    """
    docs = with_spots(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t")), "_t", "spots")
    sets = cut(docs.filter(F.size("spots") > 0).groupBy("spots").agg(F.min("doc_id").alias("doc_id")).withColumn("n", F.size("spots"))
               .withColumn("class", F.floor(F.log("n") / F.lit(-1.0) / F.log(F.lit(least)) + 1e-9).cast("int")))
    each = sets.select("doc_id", "n", "class", F.explode("spots").alias("spot"))
    often = each.groupBy("spot").agg(F.count(F.lit(1)).alias("often"))
    rare = (each.join(often, "spot").groupBy("doc_id", "n", "class")
            .agg(F.array_sort(F.collect_list(F.struct("often", "spot"))).alias("by"))
            .select("doc_id", "n", "class", F.explode(F.slice("by", F.lit(1), F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9).cast("int") + 1)).alias("r"))
            .select("doc_id", "n", "class", F.col("r.spot").alias("spot")))
    rare = cut(rare)
    meet = rare.select("spot", F.col("doc_id").alias("x"), F.col("n").alias("n_x"), F.explode(F.array(F.col("class"), F.col("class") + 1)).alias("class"))
    pairs = (meet.join(rare, ["spot", "class"]).filter((F.col("n_x") >= F.lit(least) * F.col("n")) & (F.col("n") >= F.lit(least) * F.col("n_x")))
             .filter("x <> doc_id").select(F.least("x", "doc_id").alias("a"), F.greatest("x", "doc_id").alias("b")).distinct())
    one = lambda name: sets.select(F.col("doc_id").alias(name), F.col("spots").alias(f"s_{name}"))
    return (pairs.join(one("a"), "a").join(one("b"), "b").withColumn("likeness", likeness(F.col("s_a"), F.col("s_b"), least))
            .filter(F.col("likeness") >= least).select("a", "b", "likeness"))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text, of an edited version, and their likeness.

    The edited text has the last floor(n/4) code points replaced by the first as
    many (or all) of the next document by ascending id, after the last the
    first; rows that repeat an id follow each other by their text's hash.
    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_spots``.  Null texts count as empty; null ids come
    first; other columns are ignored.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = docs.withColumn("h", F.xxhash64("text"))
    slim = keyed.select("doc_id", "h", F.char_length("text").alias("n")).dropDuplicates(["doc_id", "h"])
    slim = cut(ranked(slim, [F.col("doc_id"), F.col("h")], "rank"))
    rows = max(slim.count(), 1)
    # each document with the one before it, whose edit takes its beginning
    turn = slim.select(((F.col("rank") + 1) % F.lit(rows)).alias("rank"), F.col("doc_id").alias("to_id"), F.col("h").alias("to_h"),
                       F.floor(F.col("n") / 4).cast("int").alias("need"))
    order = slim.select("rank", F.col("doc_id").alias("own_id"), F.col("h").alias("own_h")).join(turn, "rank").drop("rank")
    # both joins hash the texts by the same keys, so they are shuffled once
    after = keyed.join(order, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("h") == F.col("own_h")))
    after = with_spots(after.select("to_id", "to_h", "need", "text"), "text", "next_spots").select(
        "to_id", "to_h", "need", F.substring("text", F.lit(1), F.col("need")).alias("begin"), "next_spots")
    after = after.dropDuplicates(["to_id", "to_h"])  # repeated rows
    paired = keyed.join(after, F.col("doc_id").eqNullSafe(F.col("to_id")) & (F.col("h") == F.col("to_h")))
    n_chars = F.char_length("text")
    edited = F.concat(F.substring("text", F.lit(1), n_chars - F.col("need")), F.col("begin"))
    paired = paired.select("doc_id", "text", edited.alias("edited"), "next_spots", n_chars.cast("long").alias("n_chars"))
    both = with_spots(with_spots(paired, "text", "spots"), "edited", "edited_spots")
    return both.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
                       _text("spots").alias("fingerprint"), _text("edited_spots").alias("edited_fingerprint"),
                       likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
                       likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
                       F.size("spots").cast("long").alias("n_spots"))

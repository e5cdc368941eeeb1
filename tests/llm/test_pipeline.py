"""The corpus pipeline stage by stage against brute force, and columns whose names clash."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from porespark.llm import alignment, lines, minhash, mixing, packing, quality, queries, sharding, spotsigs, tokens, toxicity
from tests.llm.test_operators import WORDS, brute_groups, brute_targets, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use for columns of their own.
CLASHES = ("_h", "_p", "_x", "_own", "_host", "_path", "_text", "_of", "_drop", "_kept", "_clean", "_gone", "_n", "_digest", "_page", "_pages",
           "_with", "_source", "_size", "_key", "_cut", "_cut_key", "_cut_words", "_whole", "_extra", "_taken", "_target", "_copy", "_copies",
           "_in_0", "_in_7", "_id", "_t", "mix", "key", "size", "host", "path", "posterior", "component_id", "kept", "n_shingles", "shard",
           "ids", "a.b", "x`y")


def prose(rng, n):
    return "\n".join(" ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(min(12, n - i))) for i in range(0, n, 12))


def noise(rng, n):
    return " ".join(f"${rng.randrange(10**6)}#%{rng.randrange(10**4)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Rows and labels: a hot source, copies and near copies, repeated lines, bad texts, nulls and a repeated row."""
    rng, texts = random.Random(12), []
    copied = prose(rng, 60)
    for i in range(180):
        text = prose(rng, rng.randrange(20, 90))
        if i % 9 == 0:
            text += "\nfooter of the whole site"
        if i % 6 == 1:
            text = noise(rng, 40)
        if i % 6 == 2 and i < 100:
            text = copied
        if i % 6 == 3 and i < 60:
            w = copied.split(" ")
            w[rng.randrange(len(w))] = "edited"
            text = " ".join(w)
        texts.append(text)
    rows = [(i, t, (None, "en", "de")[i % 3] if i % 7 == 0 else "en", "hot" if i % 3 else f"s{i % 4}" if i % 4 else None, len(t))
            for i, t in enumerate(texts)]
    rows += [(180, None, "en", "hot", None), (181, "", "en", "hot", 0), (182, " \n ", None, None, 3), (None, texts[5], "en", "hot", 5), rows[4],
             (183, prose(rng, 6_000), "en", "s1", 1)]
    labels = [(i, int(i % 6 != 1), 0) for i in range(0, 180, 2)] + [(i, 0, 0) for i in range(1, 180, 6)] + [(None, 1, 1), (3, None, None)]
    return rows, labels


def brute_keep(rows, scores):
    """Ids that the classifier keeps, from its own evidence of each document, by the site model in plain Python."""
    p = {i: round(s * 1e6) / 1e6 for i, s in scores.items()}
    logit = lambda x: math.log(x / (1 - x))
    safe = lambda x: min(max(x, 1e-6), 1 - 1e-6)

    def strength(groups):
        groups = [g for g in groups if g[0] > 1]
        n, inside = sum(g[0] for g in groups), sum(g[0] * g[2] * (1 - g[2]) for g in groups)
        if not n or not inside:
            return 100.0
        between = sum(m * (good / m - parent) ** 2 for m, good, parent in groups)
        noise_ = inside / n
        return min(max(round(noise_ / max((between - len(groups) * noise_) / n, noise_ * 1e-4), 3), 1.0), 10_000.0)

    path, host = defaultdict(lambda: [0, 0.0]), defaultdict(lambda: [0, 0.0])
    for i, _, lang, source, _ in rows:
        for site in (path[source, lang], host[source]):
            site[0] += 1
            site[1] += p[i]
    rate = min(max(round(sum(g for _, g in host.values()) / len(rows), 6), 1e-4), 1 - 1e-4)
    k = strength([(n, g, rate) for n, g in host.values()])
    above = {h: (g + k * rate) / (n + k) for h, (n, g) in host.items()}
    k = strength([(n, g, above[h]) for (h, _), (n, g) in path.items()])
    at = {(h, q): round((g + k * above[h]) / (n + k), 6) for (h, q), (n, g) in path.items()}
    after = {i: logit(safe(p[i])) + logit(safe(at[source, lang])) - logit(rate) for i, _, lang, source, _ in rows}
    return {i for i, x in after.items() if 1 / (1 + math.exp(-x)) >= quality.KEEP}


def brute_lines(rows, ratio, least, most):
    pages = defaultdict(set)
    for _, text, _, source, *_ in rows:
        pages[source].add(text)
    gone = {}
    for source, found in pages.items():
        seen = Counter(x for t in found if t is not None for x in set(t.split("\n")) if x.strip(" "))
        gone[source] = {x for x, n in seen.items() if n >= least and n >= ratio * len(found)}
    out = []
    for i, text, _, source, *_ in rows:
        if text is not None:
            kept = [x for x in text.split("\n") if x not in gone[source]]
            if sum(map(len, kept)) >= (1 - most) * sum(map(len, text.split("\n"))):
                text = "\n".join(kept)
        out.append((i, text))
    return out


def covered(pieces, docs):
    """Every id of every document lies in exactly one piece, and sequences are gapless and full enough."""
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.WORD_VOCABULARY))
    times, coded, got, lengths = Counter(), {}, defaultdict(Counter), defaultdict(list)
    for i, text, *_ in docs:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        coded.setdefault((i, len(ids)), []).append(ids)
        times[i, len(ids)] += 1
    for r in pieces:
        same = coded[r["doc_id"], r["doc_tokens"]]
        assert any(zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for ids in same)
        got[r["doc_id"], r["doc_tokens"]].update(range(r["start"], r["start"] + r["length"]))
        lengths[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {d: set(c.values()) for d, c in got.items()} == {d: {n} for d, n in times.items()}
    assert all(len(got[d]) == d[1] for d in got)
    for parts in lengths.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048


def test_each_stage_equals_brute_force(spark, corpus, tmp_path):
    rows, labels = corpus
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, after = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for nth, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{nth}")
        docs = spark.read.parquet(f"{tmp_path}/{nth}")
        if nth < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            after.append([tuple(r) for r in docs.collect()])
    key = lambda pairs: sorted(pairs, key=str)

    read = spark.read.parquet(f"{tmp_path}/labels.parquet")
    scored = quality.quality_scores(spark.read.parquet(f"{tmp_path}/documents.parquet"), read, F.col("source"), F.col("lang"))
    keep = brute_keep(rows, {r["doc_id"]: r["doc_score"] for r in scored.collect()})
    assert key(after[0]) == key(r for r in rows if r[0] in keep)
    ids = {r[0] for r in after[0]}
    assert ids >= {i for i in range(180) if i % 6 != 1} and not ids & {i for i in range(180) if i % 6 == 1}

    want = brute_lines(after[0], corpus_pipeline.LINE_RATIO, corpus_pipeline.LINE_PAGES, corpus_pipeline.LINE_MOST)
    assert key(r[:2] for r in after[1]) == key(want)
    before = {r[0]: r for r in after[0]}
    assert sum(t != before[i][1] for i, t in want) >= 8
    assert all(r[4] == (len(r[1]) if r[1] != before[r[0]][1] else before[r[0]][4]) for r in after[1])

    groups, _ = brute_groups([r[:2] for r in after[1] if r[0] is not None], 5, 80)
    assert key(after[2]) == key(r for r in after[1] if r[0] is None or groups[r[0]] == r[0])
    assert len(after[2]) < len(after[1]) - 15

    sizes, taken, times = defaultdict(int), defaultdict(int), Counter()
    for r in after[2]:
        sizes[r[3]] += len(words(r[1]))
    whole = {r[0]: r for r in after[2]}
    for r in after[3]:
        taken[r[3]] += len(words(r[1]))
        times[r[0]] += 1
        assert r == whole[r[0]] or (words(r[1]) == words(whole[r[0]][1])[:len(words(r[1]))] and r[2:4] == whole[r[0]][2:4] and r[4] == len(r[1]))
    assert all(n <= 2 * sum(r[0] == i for r in after[2]) for i, n in times.items())
    goal = brute_targets(sizes)
    assert taken.keys() == goal.keys() and all(0 <= goal[s] + 1e-6 - n < 3 for s, n in taken.items())

    covered(docs.collect(), after[3])
    covered(corpus_pipeline.run(spark, str(tmp_path)).collect(), after[3])


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_with_clashing_names(spark, corpus):
    rows, labels = corpus
    plain = spark.createDataFrame(rows[:60] + rows[180:185], SCHEMA).cache()
    wide = plain.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in CLASHES]).cache()
    read = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    host, lang, word = F.col("source"), F.col("lang"), public_tokenizers.path(queries.WORD_VOCABULARY)
    key = lambda df, names: sorted((str(tuple(r)) for r in df.select(*names).collect()))
    quoted = ["`" + n.replace("`", "``") + "`" for n in wide.columns]
    for whole in (lambda d: quality.good_documents(d, read, host, lang), lambda d: mixing.mixed_documents(d),
                  lambda d: lines.line_dedup(d, host, ratio=0.1, min_pages=3, by_text=True, most=0.5).drop("n_lines", "n_dropped"),
                  lambda d: corpus_pipeline.dedup_stage(spark, d, "")):
        got = whole(wide)
        assert got.columns == wide.columns
        assert key(got, plain.columns) == key(whole(plain), plain.columns)
        assert all(v == f"{n}{r[0]}" for r in got.filter("doc_id is not null").collect() for n, v in zip(CLASHES, r[5:]))
        assert len(quoted) == len(got.select(*quoted).columns)
    for part in (minhash.near_duplicates, mixing.mix, lambda d: sharding.shards(d, 5), spotsigs.fingerprints,
                 lambda d: tokens.token_counts(d, public_tokenizers.path(queries.BYTE_VOCABULARY), 50),
                 lambda d: quality.quality_scores(d, read, host, lang), lambda d: toxicity.toxicity(d, read),
                 lambda d: packing.pack(d.coalesce(1).sortWithinPartitions("doc_id", "text"), word, 1).drop("sequence_id", "step_id"),
                 lambda d: alignment.align(d, public_tokenizers.path(queries.BYTE_VOCABULARY), public_tokenizers.path(queries.PIECE_VOCABULARY))):
        want = part(plain)
        names = want.columns
        assert key(part(wide), names) == key(want, names)

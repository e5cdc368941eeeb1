"""Unit-wise token ids, token alignment, ranked search and token-id files against the libraries and brute force."""

from __future__ import annotations

import hashlib
import io
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from porespark.llm import alignment, idcoder, idfiles, oracles, packing, queries, ranking, vocab

WORD, BYTE, PIECE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = ["a  b", " a", "a ", "x\x1cy z", "É İstanbul ΑΣ Σ ǅ ŉ ﬁ", "日本語 テキスト です", "don't I'LL 's", "tab\tx \n y\r\n z",
       "<|endoftext|> a", "á é x", "\xa0x y　z  q", "▁x", "<0x41> </s> <s>", "x\x00y", "٣٤ ½² a_b __", "\U0001f600 hi", "ſ K Å",
       "", " ", "\n", "мир Йод Ѐ", "a" * 3000, "Ünïcödé WÖRDS übër", "x.y,z;(a)"]


def mixtures(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD[:21]) if rng.random() < .4 else rng.choice(["a", "B", " ", "é", ".", "'", "\n", "1", " the"]) for _ in range(rng.randrange(14)))
            for _ in range(n)]


def ids(blob):
    return np.frombuffer(blob, "<i4").tolist()


@pytest.fixture(scope="module")
def encoders():
    return vocab.JsonIds(WORD), vocab.JsonIds(BYTE, plain=True), vocab.PieceIds(PIECE)


def test_unit_ids_are_the_libraries(encoders):
    word, byte, piece = encoders
    assert (word.kind, byte.kind, piece.cuts) == ("word", "byte", True)  # the fast ways are the ones tested
    own, plain, sp = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    plain.encode_special_tokens = True
    for text in ODD + mixtures(1500, 1):
        assert ids(word.ids(text)) == own.encode(text, add_special_tokens=False).ids, text
        assert ids(byte.ids_after_blank(text)) == plain.encode(" " + text, add_special_tokens=False).ids, text
        if text:
            got = ids(piece.ids_after_blank(text))
            assert ("▁" in text) == (-1 in got) and (-1 in got or got == sp.encode(text)), text


def test_memory_is_bounded_and_keeps_what_is_met(encoders):
    made = Counter()
    memory = vocab.Memory(lambda k: made.update([k]) or k.encode(), limit=60_000)
    for i in range(5_000):
        assert memory[f"k{i % 37}"] == b"k%d" % (i % 37) and memory[f"n{i}"] == b"n%d" % i
        assert memory.held <= 60_000 and len(memory) + len(memory.older) < 800
    assert max(made[f"k{i}"] for i in range(37)) == 1
    assert memory["x" * 10_000] == b"x" * 10_000 and "x" * 10_000 not in memory


# --- alignment -------------------------------------------------------------------------------

def aligned(rows):
    """Every document by itself: quadratic overlap, sets of ends."""
    plain, sp = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    plain.encode_special_tokens = True
    table = vocab.byte_table(BYTE)

    def spell(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()

    counts, docs = Counter(), []
    for doc, text in rows:
        a, b, want = [], [], (" " + (text or "")).encode()
        if text:
            a, b = plain.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            if b"".join(table[i] for i in a) != want or b"".join(map(spell, b)) != want:
                a, b = [], []
        ends_a, ends_b = np.cumsum([len(table[i]) for i in a]).tolist(), np.cumsum([len(spell(i)) for i in b]).tolist()
        i = j = 0
        groups, links = [], []
        for end in sorted(set(ends_a) & set(ends_b)):
            i2, j2 = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            links += [(a[x], b[y]) for x in range(i, i2) for y in range(j, j2)
                      if max(([0] + ends_a)[x], ([0] + ends_b)[y]) < min(ends_a[x], ends_b[y])]
            i, j = i2, j2
        counts.update(set(links))
        docs.append((doc, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    most = Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    return sorted(((d, na, nb, ng, len(ls), sum(counts[p] == most[p[0]] for p in ls), sum(counts[p] for p in ls), h)
                   for d, na, nb, ng, ls, h in docs), key=str)


CLASHING = "doc_id long, text string, chunk string, n_a string, pair string, known string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", "n", "p", "k") for r in rows], CLASHING)


@pytest.mark.parametrize("size", [40, 4 << 20])
def test_alignment_of_hard_texts(spark, monkeypatch, size):
    monkeypatch.setattr(alignment, "CHUNK_CHARS", size)  # documents alone in a chunk, and together
    texts = [t for t in ODD if len(t) < 1000] + mixtures(60, 2) + ["the same text again"] * 5 + ["word " * 3_000]
    rows = [*enumerate(texts), (3, "the same text again"), (None, "x y"), (None, None), (900, None)]
    got = sorted((tuple(r) for r in alignment.align(frame(spark, rows), BYTE, PIECE).collect()), key=str)
    assert got == aligned(rows)


def test_alignment_of_nothing(spark):
    assert alignment.align(frame(spark, []), BYTE, PIECE).count() == 0
    rows = [(1, None), (2, ""), (3, "▁")]
    assert {tuple(r)[1:] for r in alignment.align(frame(spark, rows), BYTE, PIECE).collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_galloping_finds_lower_bounds():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        ends = np.cumsum(rng.integers(1, 9, n))
        low = np.sort(rng.integers(0, n, 30))
        wanted = rng.integers(0, ends[-1] + 1, 30)
        wanted = np.maximum(wanted, ends[low])
        guess = np.minimum(low + rng.integers(0, n, 30), n - 1)
        assert (alignment.gallop(wanted, guess, ends, low, np.full(30, n)) == np.searchsorted(ends, wanted)).all()


def test_op11_on_the_smallest_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in queries.QUERIES["op11_alignment"](spark, sf).collect()), key=str) == aligned(rows)


# --- ranked search ---------------------------------------------------------------------------

def brute_ranking(docs, items, k):
    find = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").findall

    def terms(text):
        return find("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))

    held = [(d, terms(t)) for d, t in docs]
    held = [(d, t) for d, t in held if t]
    n, total = len(held), sum(len(t) for _, t in held)
    df = Counter(x for _, t in held for x in set(t))
    out = []
    for item, text in items:
        scored = []
        for d, t in held:
            tf, m = Counter(t), 25 + 75 * len(t) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10 ** 9 * tf[x] // (1000 * tf[x] + 8 * m)) for x in terms(text))
            if s > 0 and d is not None:
                scored.append((-s, d))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    words = [a + b for a in ("ka", "lo", "mi", "né", "su", "x1") for b in ("ra", "ti", "vo", "NA", "Été", "日本")]
    docs = [(i, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(len(words))], k=rng.randrange(1, 60)))) for i in range(400)]
    docs += [(i + 400, docs[i % 7][1]) for i in range(60)] + [(5, docs[5][1]), (900, None), (901, ""), (902, "!! ??"), (None, "kara"), (903, "ka " * 40_000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for i in range(25)]
    return docs, items + [(25, None), (26, ""), (27, "absent"), (28, docs[3][1]), (29, "kara KARA kara"), (30, "Kara-kara_mira")]


@pytest.mark.parametrize("leaf,batch,blocks,pilot", [(64, 1 << 21, 1 << 20, 4000), (2, 200, 10, 20)])
def test_ranking_is_exact(spark, corpus, monkeypatch, leaf, batch, blocks, pilot):
    for name, value in (("LEAF", leaf), ("BATCH_ENTRIES", batch), ("BLOCK_TERMS", blocks), ("PILOT_ROWS", pilot)):
        monkeypatch.setattr(ranking, name, value)
    docs, items = corpus
    table = spark.createDataFrame([(d, t, "n", "s") for d, t in docs], "doc_id long, text string, n string, score string").repartition(3)
    asked = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, query string")
    got = sorted(tuple(r) for r in ranking.ranked(table, asked, 10).collect())
    assert got == brute_ranking(docs, items, 10)


def test_ranking_of_nothing(spark, corpus):
    docs, items = (spark.createDataFrame(x, s) for x, s in zip(corpus, ("doc_id long, text string", "item_id long, text string")))
    for d, q in ((docs.limit(0), items), (docs, items.limit(0)), (docs.filter("text is null"), items), (docs, items.filter("text is null"))):
        out = ranking.ranked(d, q, 3)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


def test_trees_prune_and_bound():
    """Searches read a part of the leaves only and find what reading all finds."""
    rng = np.random.default_rng(3)
    size = rng.integers(1, 8, 2000)
    start = np.concatenate([[0], np.cumsum(size)])
    term = np.concatenate([np.sort(rng.choice(40, n, replace=False)) + 40 * (i % 5) for i, n in enumerate(size)])
    rows = ranking.Vectors(start, term, rng.integers(1, 10 ** 6, len(term)))
    scale = np.sqrt(rng.integers(1, 20_000, 200))
    tree = ranking.Tree(rows, scale)
    read = total = 0
    for q in range(60):
        own = rng.choice(40, 4, replace=False) + 40 * (q % 5)
        dense, scaled = np.zeros(200, "int64"), np.zeros(200)
        dense[own] = (scale[own] ** 2).round()
        scaled[own] = dense[own] / scale[own]
        best = []
        read += tree.search(dense, scaled, float(np.linalg.norm(scaled)), np.arange(2000), best, 10, 1)
        total += 2000 / ranking.LEAF
        scores = rows.dot(dense)
        want = sorted(((int(s), -i) for i, s in enumerate(scores) if s > 0), reverse=True)[:10]
        assert sorted(best, reverse=True) == want
    assert read < total / 2


def test_op12_equals_its_sql(spark, sf):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    want = sorted(con.execute(oracles.SQL["op12_ranking"]).fetchall())
    assert want and sorted(tuple(r) for r in queries.QUERIES["op12_ranking"](spark, sf).collect()) == want


# --- coder and files ---------------------------------------------------------------------------

@pytest.mark.parametrize("n,block", [(0, 8), (1, 8), (7, 8), (8, 8), (9, 8), (1000, 64), (5000, 5000), (5001, 5000)])
@pytest.mark.parametrize("kind", ["same", "few", "skewed", "any", "runs"])
def test_coder_round_trip(n, block, kind):
    rng = np.random.default_rng(n)
    top = idcoder.MOST_IDS if kind == "any" else 49408
    x = {"same": np.zeros(n, int), "few": rng.integers(0, 3, n), "skewed": np.minimum(rng.zipf(1.3, n) - 1, top - 1),
         "any": rng.integers(0, top, n), "runs": np.arange(n) % 17 * 2900}[kind]
    payloads = idcoder.encode(x, top, block)
    assert len(payloads) == -(-n // block) and (idcoder.decode(payloads, n, top, block) == x).all()
    if n == 5000 and kind in ("same", "runs"):  # what repeats costs next to nothing
        assert sum(map(len, payloads)) < n / 8


def test_blocks_are_independent():
    x = np.random.default_rng(1).integers(0, 500, 4000)
    whole, second = idcoder.encode(x, 500, 1000), idcoder.encode(x[1000:2000], 500, 1000)
    assert whole[1] == second[0]
    with pytest.raises(ValueError):
        idcoder.encode(x, idcoder.MOST_IDS + 1)


@pytest.mark.parametrize("kind", ["words", "runs", "wide", "large"])
def test_pairs_that_stand_often_are_coded_in_one_step(kind, monkeypatch):
    monkeypatch.setattr(idfiles, "_SLICE", 1000, raising=False)
    steps, encode = [], idcoder.encode
    monkeypatch.setattr(idcoder, "encode", lambda x, n, *more: steps.append(len(x)) or encode(x, n, *more))
    rng = np.random.default_rng(3)
    words = [rng.integers(0, 200, k) for k in rng.integers(1, 5, 100)]
    x = np.concatenate([words[i] for i in rng.integers(0, 100, 8000)])
    x = {"words": x, "runs": np.repeat([7, 3, 7], [2500, 1001, 4000]), "large": x + (1 << 31),
         "wide": np.concatenate([x, rng.integers(0, 40000, 3000)])}[kind].astype("<u4")
    blob = idfiles.pack_segment([1, None], np.array([5, len(x) - 5]), x)
    docs, lengths, back = idfiles.read_segment(io.BytesIO(blob))
    assert docs == [1, None] and lengths.tolist() == [5, len(x) - 5] and (back == x).all()
    assert steps[0] < 0.8 * len(x)


def test_id_files_of_hard_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(idfiles, "SEGMENT_IDS", 50)
    texts = [t for t in ODD] + mixtures(40, 5)
    rows = [*((i * 3, t) for i, t in enumerate(texts)), (3, "again"), (3, "again"), (None, "no id"), (None, None), (2, None)]
    random.Random(0).shuffle(rows)
    folder = str(tmp_path / "ids")
    idfiles.write_ids(frame(spark, rows), WORD, 2, folder, 4)
    got = [tuple(r) for r in idfiles.read_ids(spark, folder).collect()]
    own = Tokenizer.from_file(WORD)
    want = Counter((d, tuple(own.encode(t or "", add_special_tokens=False).ids + [2])) for d, t in rows)
    assert Counter((d, tuple(ids(blob))) for d, _, _, blob in got) == want
    at = 0
    for doc, start, n, blob in sorted(got, key=lambda r: r[1]):
        assert start == at and n == len(blob) // 4
        at += n
    order = [d for d, *_ in sorted(got, key=lambda r: r[1])]
    assert order == sorted(order, key=lambda d: -1 if d is None else d)
    digests = {tuple(r) for r in idfiles.read_ids(spark, folder, digest=True).collect()}
    assert digests == {(d, s, n, zlib.crc32(blob)) for d, s, n, blob in got}


def test_damaged_files_are_refused(spark, tmp_path):
    folder = str(tmp_path / "ids")
    idfiles.write_ids(frame(spark, [(i, "some words to damage") for i in range(20)]), WORD, 2, folder, 1)
    name = next(f for f in os.listdir(folder) if f.endswith(".ids"))
    data = bytearray((tmp_path / "ids" / name).read_bytes())
    data[-3] ^= 1
    (tmp_path / "ids" / name).write_bytes(bytes(data))
    with pytest.raises(Exception, match="damaged"):
        idfiles.read_ids(spark, folder).count()


def test_id_files_of_nothing_and_leftovers(spark, tmp_path):
    folder = tmp_path / "ids"
    idfiles.write_ids(frame(spark, []), WORD, 2, str(folder), 3)
    (folder / "left-by-a-lost-task.ids").write_bytes(b"junk")
    assert idfiles.read_ids(spark, str(folder)).count() == 0


def test_op13_equals_the_library(spark, sf):
    got = [tuple(r) for r in queries.QUERIES["op13_id_files"](spark, sf).orderBy("doc_id").collect()]
    own, at, want = Tokenizer.from_file(WORD), 0, []
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect():
        x = own.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        want.append((r["doc_id"], at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    assert got == want


# --- steps of packing ----------------------------------------------------------------------------

def test_steps_are_full_across_tasks(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["the", "of", "word", "x"], k=rng.randrange(20, 1500)))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    pieces = packing.pack(df, WORD, 1)
    steps = pieces.groupBy("tier", "step_id").agg(F.countDistinct("sequence_id").alias("n")).collect()
    for tier in {r["tier"] for r in steps}:
        full = packing.STEP_WINDOWS * max(1, 2048 // tier)
        mine = [r["n"] for r in sorted(steps, key=lambda r: r["step_id"]) if r["tier"] == tier]
        assert all(n == full for n in mine[:-1]) and 0 < mine[-1] <= full


def test_workers_keep_no_more_than_they_need(monkeypatch):
    import pyarrow as pa
    import public_tokenizers
    from porespark.llm import minhash, vocab

    def parsed(*_):
        raise AssertionError("the whole file is parsed beside the library")
    monkeypatch.setattr(vocab.json, "load", parsed)
    assert vocab.JsonIds(public_tokenizers.path("word_bpe_49k.json")).kind == "word"
    assert vocab.JsonIds(public_tokenizers.path("byte_bpe_50k.json")).kind == "byte"
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a b c d e f"])], names=["doc_id", "text"])
    assert [b.num_rows for b in minhash._sketch(4, 7)(iter([batch]))] == [1]
    assert not minhash._HASHES
